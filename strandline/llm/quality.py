"""Quality classifier by co-training (operator 2).

Two views of a page give separate guesses of its quality. The *content view* is the text alone: hashed frequencies of
its three-byte sequences, how much of it repeats, and its layout (lines, shares of upper case, digits, marks, spaces).
The *metadata view* is what a catalog says of it without the text: language, source and stated size. A logistic
classifier of each view is fitted on labelled rows. In each of ``ROUNDS`` rounds each view scores all unlabelled rows, on
Spark; of all rows that it is sure of (its calibrated odds are ``SURE`` times what the prior says, or a ``SURE``-th), the
``PSEUDO`` surest, by class prior, join the other view's training rows. A view without signal so teaches nothing. Last, each view's margin is calibrated on labelled rows that took no part in fitting,
and a two-input logistic regression over the calibrated margins gives the score of every document.

Fitting takes at most ``LABELLED`` labelled rows, chosen by a hash of the id; everything else covers whole texts of all
rows: one pass a round, and one for the scores, none of which shuffles texts. Documents below the threshold are rejected:
one half, or less where that would reject more than ``LOSS`` of the good calibration rows, or where these are few.

Cases: a null text counts as empty, null metadata as a value of its own; labels that are null, or that contradict each
other for one id, teach nothing; repeated labels count once; with labels of one class only, or none, every document
scores that class (or 0.5); ties at the threshold are kept; an empty table gives an empty result. Columns other than
the named ones are not read. Rows with a null id get no pseudo-label; of rows with equal margins one gets it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import keep_rows, map_arrow, written

LABELLED = 4000
ROUNDS = 3
#: Rows that each view labels for the other in a round at most, and the odds by which it has to be sure of them.
PSEUDO, SURE = 400, 10
#: Share of good calibration rows that may be rejected, and how many of them still say little of that: they lower the threshold.
LOSS, FEW = 0.002, 20
#: Every so many labelled rows serve for calibration only.
CALIBRATION = 4
SEQUENCES = 1024
LAYOUT = 8
CONTENT = SEQUENCES + 3 + LAYOUT
HASHED = 64
META = 2 * HASHED + 3
#: Rows whose features are in memory at a time.
ROWS_AT_ONCE = 500
#: Bytes of text whose sequences are counted at a time.
BYTES_AT_ONCE = 1 << 20


def content_view(text: str) -> np.ndarray:
    """Square roots of hashed three-byte frequencies, of unit length; how often sequences repeat."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    count = np.zeros(SEQUENCES, np.int64)
    for at in range(0, max(0, len(data) - 2), BYTES_AT_ONCE):
        part = data[at : at + BYTES_AT_ONCE + 2].astype(np.uint32)
        key = (part[:-2] * np.uint32(0x9E3779B1)) ^ (part[1:-1] * np.uint32(0x85EBCA77)) ^ (part[2:] * np.uint32(0xC2B2AE3D))
        count += np.bincount((key * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=SEQUENCES)
    share = count / max(1, count.sum())
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(raw[at : at + BYTES_AT_ONCE])) for at in range(0, len(raw), BYTES_AT_ONCE)) + len(packer.flush())
    ratio = packed / (len(raw) + 20)
    repeats = [ratio, np.log(ratio), np.log(float((share**2).sum()) + 1e-4)]
    n = max(1, len(data))
    kinds = np.zeros(6)
    for at in range(0, len(data), BYTES_AT_ONCE):
        kinds += np.bincount(_KIND[data[at : at + BYTES_AT_ONCE]], minlength=6)
    lines = 1 + raw.count(b"\n")
    return np.concatenate([np.sqrt(share), repeats, [np.log1p(n / lines) / 5, np.log1p(lines) / 5], kinds / n]).astype(np.float32)


_KIND = np.array([5 if b >= 128 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 if chr(b).isspace() else 4 for b in range(256)], np.uint8)


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, and the stated size."""
    out = np.zeros(META, np.float32)
    for at, value in ((0, lang), (HASHED, source)):
        out[at + zlib.crc32(repr(value).encode()) % HASHED] = 1
    size = np.log1p(max(0, n_chars or 0)) / 5
    out[2 * HASHED :] = [size, size**2, n_chars is None]
    return out


@dataclass
class Linear:
    """A logistic classifier on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1]


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 150) -> Linear:
    """Penalised logistic regression by accelerated gradient steps; classes weigh the same."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    own = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    v = np.ones(z.shape[1])
    for _ in range(12):  # largest curvature, by power iteration
        v = z.T @ (own * (z @ v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(v @ (z.T @ (own * (z @ v)))) * 1.1 + penalty)
    now = ahead = np.zeros(z.shape[1])
    for k in range(steps):
        gradient = z.T @ (own * (_sigmoid(z @ ahead) - y)) + penalty * np.append(ahead[:-1], 0)
        last, now = now, ahead - rate * gradient
        ahead = now + k / (k + 3) * (now - last)
    return Linear(mean, scale, now)


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * m))


@dataclass
class CoTrained:
    """Two linear views and the calibrated combination; constant where there is nothing to learn."""

    constant: float | None = None
    views: list[Linear] = field(default_factory=list)
    calibration: list[tuple[float, float]] = field(default_factory=list)
    joint: np.ndarray | None = None
    threshold: float = 0.5

    def margins(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated margins of each view."""
        return [a * v.margin(x) + b for v, x, (a, b) in zip(self.views, views, self.calibration)]

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: content, metadata, combined."""
        n = len(views[0])
        if self.constant is not None:
            return (np.full(n, self.constant),) * 3
        margins = self.margins(views)
        both = np.column_stack([*margins, np.ones(n)]) @ self.joint
        return _sigmoid(margins[0]), _sigmoid(margins[1]), _sigmoid(both)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps of a small logistic regression with a weak penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
        w = np.clip(w, -50, 50)
    return w


class Training:
    """What both views learn from: labelled rows, of which some are kept for calibration, and pseudo-labelled ones."""

    def __init__(self, views: list[np.ndarray], labels: np.ndarray):
        aside = np.zeros(len(labels), bool)
        aside[::CALIBRATION] = len(labels) >= 40
        if any(len(set(labels[rows])) < 2 for rows in (aside, ~aside)):
            self.fitted = self.kept = np.ones(len(labels), bool)
        else:
            self.fitted, self.kept = ~aside, aside
        self.views, self.labels = views, labels.astype(float)
        self.prior = float(self.labels[self.fitted].mean())
        self.rows = [v[self.fitted] for v in views]
        self.given = [self.labels[self.fitted] for _ in views]

    def add(self, pupil: int, rows: np.ndarray, labels: np.ndarray) -> None:
        self.rows[pupil] = np.concatenate([self.rows[pupil], rows])
        self.given[pupil] = np.concatenate([self.given[pupil], labels])

    def model(self) -> CoTrained:
        out = CoTrained(views=[fit_linear(x.astype(float), y, 1e-3) for x, y in zip(self.rows, self.given)])
        y, margins = self.labels[self.kept], []
        # Labels as far from 0 and 1 as their number leaves open, so that a few separable rows give no steep slope.
        soft = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for view, x in zip(out.views, self.views):
            m = view.margin(x[self.kept])
            a, b = _logistic(np.column_stack([m, np.ones(len(m))]), soft)
            out.calibration.append((float(max(a, 0.0)), float(b)))
            margins.append(out.calibration[-1][0] * m + b)
        out.joint = _logistic(np.column_stack([*margins, np.ones(len(y))]), soft)
        good = out.score([v[self.kept] for v in self.views])[2][y > 0.5]
        out.threshold = float(min(0.5, np.quantile(good, LOSS, method="lower")) * len(good) / (len(good) + FEW))
        return out

    def quotas(self) -> dict[int, int]:
        """Rows of each class that a view may label in a round."""
        return {0: max(1, round(PSEUDO * (1 - self.prior))), 1: max(1, round(PSEUDO * self.prior))}


def _views(batch: pa.RecordBatch, columns: tuple[str, str, str, str]) -> list[np.ndarray]:
    text, lang, source, size = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)
    content = np.array([content_view(t or "") for t in text], np.float32).reshape(len(text), CONTENT)
    meta = np.array([metadata_view(*r) for r in zip(lang, source, size)], np.float32).reshape(len(text), META)
    return [content, meta]


def _features(docs: DataFrame, picked: list[tuple], id_col: str, columns: tuple[str, str, str, str]) -> dict[str, list[np.ndarray]]:
    """Views of some rows, by their id's text; a bounded number of ids, which are broadcast."""
    kind = docs.schema[id_col].dataType.simpleString()
    some = docs.sparkSession.createDataFrame([(i,) for i in sorted({i for i, *_ in picked}, key=repr)], f"`{id_col}` {kind}")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [pa.array([r.tobytes() for r in v], pa.binary()) for v in _views(batch, columns)]
        return pa.RecordBatch.from_arrays([pa.array([repr(v) for v in batch.column(0).to_pylist()], pa.string()), *rows], ["key", "content", "meta"])

    got = map_arrow(docs.select(id_col, *columns).join(F.broadcast(some), id_col), fn, "key string, content binary, meta binary").collect()
    # Of rows that repeat an id one counts, the same in every run.
    return {r["key"]: [np.frombuffer(r["content"], np.float32), np.frombuffer(r["meta"], np.float32)] for r in sorted(got, key=lambda r: (r["key"], bytes(r["content"]), bytes(r["meta"])))}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", columns: tuple[str, str, str, str] = ("text", "lang", "source", "n_chars"), labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Model from at most so many labelled rows (id, label), and all unlabelled rows of docs."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col)
    one = one.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("most"))
    there = one.filter("label = most").join(docs.select(id_col).distinct(), id_col, "left_semi").select(id_col, "label")
    known = [tuple(r) for r in there.orderBy(F.xxhash64(id_col), id_col).limit(labelled).collect()]
    if not known:
        return CoTrained(constant=0.5)
    if len({y for _, y in known}) == 1:
        return CoTrained(constant=float(known[0][1]))
    found = _features(docs, known, id_col, columns)
    training = Training([np.array([found[repr(i)][k] for i, _ in known]) for k in range(2)], np.array([y for _, y in known]))
    taken: list[set] = [set(), set()]
    for _ in range(rounds):
        picked = _surest(docs, one.select(id_col), training, taken, id_col, columns)
        if not any(picked):
            break
        found = _features(docs, [x for own in picked for x in own], id_col, columns)
        for pupil, own in enumerate(picked):
            taken[pupil] |= {i for i, _ in own}
            if own:
                training.add(pupil, np.array([found[repr(i)][pupil] for i, _ in own]), np.array([float(y) for _, y in own]))
    return training.model()


def _surest(docs: DataFrame, labelled: DataFrame, training: Training, taken: list[set], id_col: str, columns: tuple[str, str, str, str]) -> list[list[tuple]]:
    """For each view (id, label) of the rows that the other is surest of, of all unlabelled rows that the view has not."""
    shared = docs.sparkSession.sparkContext.broadcast(training.model())
    kind = docs.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [shared.value.margins(_views(batch.slice(at, ROWS_AT_ONCE), columns)) for at in range(0, batch.num_rows, ROWS_AT_ONCE)]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate([np.zeros(0), *[p[k] for p in parts]]).astype(float)) for k in range(2)]], [id_col, "m0", "m1"])

    margins = map_arrow(docs.select(id_col, *columns).filter(F.col(id_col).isNotNull()), fn, f"`{id_col}` {kind}, m0 double, m1 double")
    least = float(np.log(SURE))
    prior = float(np.log(training.prior / (1 - training.prior)))
    margins = margins.select(id_col, (F.col("m0") - prior).alias("m0"), (F.col("m1") - prior).alias("m1"))
    margins = written(margins.filter((F.abs("m0") >= least) | (F.abs("m1") >= least)).join(labelled, id_col, "left_anti"), "margins")
    out: list[list[tuple]] = []
    for pupil, teacher in ((0, "m1"), (1, "m0")):
        mine = []
        # Copies have the same margins and would fill the quota: one row for each pair of margins, unless it was taken.
        free = margins.groupBy("m0", "m1").agg(F.min(id_col).alias(id_col)).filter(~F.col(id_col).isin(sorted(taken[pupil], key=repr)))
        for label, n in training.quotas().items():
            sure = free.filter(F.col(teacher) >= least) if label else free.filter(F.col(teacher) <= -least)
            order = F.desc(teacher) if label else F.asc(teacher)
            mine += [(r[0], label) for r in sure.orderBy(order, id_col).limit(n).select(id_col).collect()]
        out.append(mine)
    return out


def _scores(batch: pa.RecordBatch, model: CoTrained, columns: tuple[str, str, str, str]) -> list[np.ndarray]:
    """Probabilities of a batch's rows, some rows at a time."""
    parts = [model.score(_views(batch.slice(at, ROWS_AT_ONCE), columns)) for at in range(0, max(1, batch.num_rows), ROWS_AT_ONCE)]
    return [np.concatenate([p[k] for p in parts]).astype(float) for k in range(3)]


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", columns: tuple[str, str, str, str] = ("text", "lang", "source", "n_chars")) -> DataFrame:
    """(id, content_score, metadata_score, score, keep) of each row of docs."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = _scores(batch, model, columns)
        arrays = [batch.column(0), *map(pa.array, parts), pa.array(parts[2] >= model.threshold)]
        return pa.RecordBatch.from_arrays(arrays, [id_col, "content_score", "metadata_score", "score", "keep"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, content_score double, metadata_score double, score double, keep boolean"
    return map_arrow(docs.select(id_col, *columns), fn, schema)


def good_rows(docs: DataFrame, model: CoTrained, columns: tuple[str, str, str, str] = ("text", "lang", "source", "n_chars")) -> DataFrame:
    """Rows of docs whose score reaches the model's threshold, as they are."""
    return keep_rows(docs, lambda batch: _scores(batch, model, columns)[2] >= model.threshold)
