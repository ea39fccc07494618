"""Language identification by cross-parsing entropy (operator 5).

For each language a suffix automaton of a bounded sample of labelled text knows every substring of that sample. A
text is parsed from left to right into longest matches; the closer the text is to the language, the longer the
matches and the fewer the phrases. Phrases times a logarithm, divided by the text's length, estimate the bits a letter
costs in that language; the language with the fewest wins. The logarithm is that of the longest sample's length, the same
for all labels: with each label's own, a label with few words would pay next to nothing for a phrase, and a letter that it
does not even have, which is a phrase of its own, would cost it less than one in a well-known language costs. Labels with
fewer than ``SCARCE`` symbols are named in ``Model.scarce``; they win only where their few words are indeed the closest.

The automata become plain transition tables (a missing transition starts a new phrase), so many texts are parsed at
once, one table look-up per letter and language. Every letter of the samples is a symbol of its own: a label's table has
columns for its ``DENSE`` most frequent letters (fewer where there are so many labels that all tables would exceed
``TABLE_BYTES``), and its other letters' transitions are looked up in sorted arrays, about 1.5 MB a label. So neither
scripts of thousands of letters nor hundreds of labels make large tables. Letters that no sample has are one symbol;
runs of other characters are one separator. By definition a text is parsed in stretches of ``STRETCH`` symbols, each from
its start, so one long text is as quick as many short ones; phrases of all stretches add up.

Fitting reads at most ``ROWS_PER_LANGUAGE`` rows of each label, of each at most its first ``LONGEST_SAMPLE`` characters
(a parameter of sample, like ``SHORT``), and up to ``SAMPLE_SYMBOLS`` symbols in all. Rows of ``SHORT`` or more characters
come first (the smallest by a hash of id and text), then shorter ones, if they have letters. Everything else covers whole
texts of all rows.

What a ``Gate`` rejects depends on evidence in bits, which grows with a text, not on a length from which it would begin.

Cases: null texts and texts without a letter give ``und`` and score 0; ties go to the label with the longer sample, then to
the first in order; rows
with a null label teach nothing; with no labelled rows at all every text is ``und``, and ``with_language`` keeps the
texts that have letters; without held-out labelled rows it does so too; repeated rows repeat in the result; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import keep_rows, map_arrow

UNDETERMINED = "und"
ROWS_PER_LANGUAGE = 128
SHORT, LONGEST_SAMPLE = 200, 2000
SAMPLE_SYMBOLS = 40_000
#: Letters of a label that have a column of its table at most; the others are looked up. Bytes of all columns at most.
DENSE = 61
TABLE_BYTES = 256_000_000
STRETCH = 2048
#: Symbols that are parsed at a time.
AT_ONCE = 1_000_000
#: How sharply the score falls when another language parses nearly as well.
SHARPNESS = 8
#: Symbols below which a label's sample is called scarce.
SCARCE = 2000
#: For rejecting: rows that thresholds are taken from, share of them that has to be right, margin of bits, phrases of room.
CHECKED = 2000
RIGHT = 0.999
BITS_MARGIN = 1.9
ROOM = 8
SEPARATOR, FOREIGN = 0, 1


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    return _LETTER


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of symbols; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


@dataclass
class Table:
    """Transitions of one label: a dense row of columns for each state, and sorted ones of letters that have no column.

    Columns are the separator, letters that the label has not, its most frequent letters, and (RARE) all its others.
    """

    column: np.ndarray
    flat: np.ndarray
    keys: np.ndarray
    to: np.ndarray
    start: np.ndarray
    rare: int

    def step(self, state: np.ndarray, symbols: np.ndarray, columns: np.ndarray, some_rare: bool) -> np.ndarray:
        """Entries for states (as first entries of their rows) and symbols with their columns."""
        got = self.flat[state + columns]
        if some_rare:
            at = np.flatnonzero(columns == self.rare)
            own = symbols[at].astype(np.int64)
            key = state[at].astype(np.int64) * len(self.column) + own
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            got[at] = np.where(self.keys[place] == key, self.to[place], self.start[own])
        return got


def _table(step: list[dict[int, int]], symbols: list[int], n_symbols: int, dense_letters: int) -> Table:
    counts = Counter(c for c in symbols if c > FOREIGN)
    column = np.full(n_symbols, FOREIGN, np.uint8)
    column[SEPARATOR] = SEPARATOR
    for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))):
        column[c] = min(k, dense_letters) + 2
    width = dense_letters + 3
    # A missing transition ends the phrase: the symbol is looked up from the start again.
    start = np.ones(n_symbols, np.int32)
    for c, to in step[0].items():
        start[c] = (to * width << 1) + 1
    first = np.ones(width, np.int32)
    dense = np.flatnonzero((column != FOREIGN) & (column < dense_letters + 2))
    first[column[dense]] = start[dense]
    flat = np.tile(first, (len(step), 1))
    rare: list[tuple[int, int]] = []
    for s, out in enumerate(step):
        for c, to in out.items():
            if column[c] < dense_letters + 2:
                flat[s, column[c]] = (to * width) << 1
            else:
                rare.append((s * width * n_symbols + c, (to * width) << 1))
    rare.sort()
    return Table(column, flat.ravel(), np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32), start, dense_letters + 2)


@dataclass
class Model:
    """labels in order; for each a table, its other letters' transitions, and the length of its sample.

    A table entry for (state, column) is (next state's first entry << 1) + 1 if a new phrase starts there.
    """

    labels: list[str]
    alphabet: str
    tables: list[Table]
    sizes: list[int]

    @property
    def phrase_bits(self) -> float:
        return float(np.log2(max(2, *self.sizes, 2)))

    @property
    def scarce(self) -> list[str]:
        """Labels of which little is known."""
        return [label for label, n in zip(self.labels, self.sizes) if n < SCARCE]

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text: its letters in lower case, with one separator for each run of anything else."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self._lookup.dtype.type
        known = np.where(letter_table()[points], kind(FOREIGN), kind(SEPARATOR))
        small = points < len(self._lookup)
        found = self._lookup[np.where(small, points, 0)]
        known = np.where(small & (found > 0), found, known)
        run = np.zeros(len(known), bool)
        run[1:] = (known[1:] == SEPARATOR) & (known[:-1] == SEPARATOR)
        return known[~run]

    @property
    def _lookup(self) -> np.ndarray:
        if "_table" not in self.__dict__:
            kind = np.min_scalar_type(len(self.alphabet) + 1)
            self._table = np.zeros(max(map(ord, self.alphabet), default=0) + 1, kind)
            for k, c in enumerate(self.alphabet):
                self._table[ord(c)] = k + 2
        return self._table

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """(texts, labels): phrases of each text."""
        out = np.zeros((len(codes), len(self.labels)), np.int64)
        sizes = np.array([len(c) for c in codes])
        begin = 0
        while begin < len(codes):
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), AT_ONCE)))
            self._parse(codes, begin, end, out)
            begin = end
        return out

    def _parse(self, codes: list[np.ndarray], begin: int, end: int, out: np.ndarray) -> None:
        pieces = [(t, c[at : at + STRETCH]) for t, c in enumerate(codes[begin:end], begin) for at in range(0, len(c), STRETCH)]
        if not pieces:
            return
        pieces.sort(key=lambda p: -len(p[1]))
        size = np.array([len(p) for _, p in pieces])
        text = np.array([t for t, _ in pieces])
        grid = np.zeros((len(pieces), size[0]), self._lookup.dtype)
        for row, (_, p) in zip(grid, pieces):
            row[: len(p)] = p
        steps = np.ascontiguousarray(grid.T)
        alive = np.searchsorted(-size, -np.arange(size[0]), "left")
        for k, table in enumerate(self.tables):
            columns = table.column[steps]
            rare = (columns == table.rare).any(axis=1) if len(table.keys) else np.zeros(len(steps), bool)
            state = np.zeros(len(pieces), np.int32)
            count = np.zeros(len(pieces), np.int32)
            for t, n in enumerate(alive):
                got = table.step(state[:n], steps[t, :n], columns[t, :n], rare[t])
                count[:n] += got & 1
                state[:n] = got >> 1
            np.add.at(out[:, k], text, count + 1)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Label, score, letters, bits a letter in that language (0 without letters), and by how many bits it wins."""
        labels: list[str] = []
        scores, letters, costs, margins = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        order = np.lexsort((np.arange(len(self.labels)), -np.array(self.sizes)))
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end] or "") <= AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            codes = [self.codes(t or "") for t in texts[begin:end]]
            own = np.array([np.count_nonzero(c != SEPARATOR) for c in codes], np.int64)
            letters.append(own)
            if self.labels:
                bits = self.phrases(codes)[:, order] * self.phrase_bits
                least = np.maximum(bits.min(axis=1, keepdims=True), 1e-9)
                score = 1 / ((least / np.maximum(bits, 1e-9)) ** SHARPNESS).sum(axis=1)
                labels += [self.labels[order[k]] if n else UNDETERMINED for k, n in zip(bits.argmin(axis=1), own)]
                scores.append(np.where(own > 0, score, 0.0))
                costs.append(np.where(own > 0, bits.min(axis=1) / np.maximum(own, 1), 0.0))
                two = np.sort(bits, axis=1)[:, :2]
                margins.append(np.where(own > 0, two[:, -1] - two[:, 0], 0.0))
            else:
                labels += [UNDETERMINED] * len(codes)
                scores.append(np.zeros(len(codes)))
                costs.append(np.zeros(len(codes)))
                margins.append(np.zeros(len(codes)))
            begin = end
        return labels, *map(np.concatenate, (scores, letters, costs, margins))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: crc32 of the id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", short: int = SHORT, longest: int = LONGEST_SAMPLE) -> list[tuple[str, list[str]]]:
    """Rows of each label, twice SAMPLE_SYMBOLS characters and some more at most: chosen by length and a hash of id and
    text, first within eight parts, then of those."""
    size = F.length(text_col)
    turn = F.when(size >= short, 0).otherwise(1)
    rows = labelled.filter(F.col(label_col).isNotNull() & ((turn == 0) | F.col(text_col).rlike(r"\p{L}")))
    rows = rows.select(F.col(label_col).cast("string").alias("label"), F.substring(text_col, 1, longest).alias("text"), turn.alias("turn"), F.xxhash64(id_col, text_col).alias("h"))
    picks = rows.select("label", "turn", "h", F.length("text").alias("n_chars")).withColumn("part", F.pmod("h", F.lit(8)))
    first = Window.partitionBy("label", "part").orderBy("turn", "h")
    then = Window.partitionBy("label").orderBy("turn", "h")
    picks = picks.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= ROWS_PER_LANGUAGE)
    picks = picks.withColumn("n", F.row_number().over(then)).filter(F.col("n") <= ROWS_PER_LANGUAGE)
    picks = picks.withColumn("before", F.sum("n_chars").over(then.rowsBetween(Window.unboundedPreceding, -1)))
    picks = picks.filter(F.coalesce("before", F.lit(0)) < 2 * SAMPLE_SYMBOLS).select("label", "turn", "h")
    # At most ROWS_PER_LANGUAGE rows of each label: small enough to broadcast whatever the input's size.
    keys = ["label", "turn", "h"]
    got = rows.join(F.broadcast(picks.distinct()), keys).dropDuplicates(keys).collect()
    by_label: dict[str, list[tuple[int, int, str]]] = {}
    for r in got:
        by_label.setdefault(r["label"], []).append((r["turn"], r["h"], r["text"]))
    return [(label, [t for *_, t in sorted(by_label[label])]) for label in sorted(by_label)]


def fit(samples: list[tuple[str, list[str]]]) -> Model:
    """Automata of each label's texts, each cut at SAMPLE_SYMBOLS symbols in all."""
    letters = letter_table()
    alphabet = "".join(sorted({c for _, texts in samples for t in texts for c in t.lower() if letters[ord(c)]}))
    model = Model([label for label, _ in samples], alphabet, [], [])
    for _, texts in samples:
        symbols: list[int] = []
        for t in texts:
            symbols += [SEPARATOR, *model.codes(t).tolist()]
            if len(symbols) >= SAMPLE_SYMBOLS:
                break
        symbols = symbols[:SAMPLE_SYMBOLS]
        step = suffix_automaton(symbols)
        dense = max(0, min(DENSE, len(set(symbols) - {SEPARATOR, FOREIGN}), TABLE_BYTES // (4 * len(step) * len(samples)) - 3))
        model.tables.append(_table(step, symbols, len(alphabet) + 2, dense))
        model.sizes.append(len(symbols))
    return model


_FOUND = "lang_pred string, score double, letters long, bits_per_letter double, margin_bits double"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: list[str] = ()) -> DataFrame:
    """(id, also..., lang_pred, score, letters, bits_per_letter, margin_bits) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [id_col, *also]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.judge(batch.column(len(kept)).to_pylist())
        columns = [*batch.columns[: len(kept)], pa.array(found[0], pa.string()), *map(pa.array, found[1:])]
        return pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", "letters", "bits_per_letter", "margin_bits"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_arrow(docs.select(*kept, text_col), fn, f"{schema}, {_FOUND}")


@dataclass
class Gate:
    """A model, and what rejects a text: a label that a prediction with the score ``sure`` or more contradicts by ROOM
    phrases or more, or more than ``room`` bits beyond ``most_bits`` a letter in the best language."""

    model: Model
    sure: float = np.inf
    most_bits: float = np.inf
    room: float = np.inf

    def passes(self, texts: list[str | None], given: list[str | None]) -> np.ndarray:
        labels, score, letters, bits, margin = self.model.judge(texts)
        known = set(self.model.labels)
        against = np.array([g in known and g != p for g, p in zip(given, labels)], bool)
        foreign = np.zeros(len(letters), bool) if np.isinf(self.most_bits) else (bits - self.most_bits) * letters > self.room
        return (letters > 0) & ~(against & (score >= self.sure) & (margin >= ROOM * self.model.phrase_bits) | foreign)


def fit_gate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", checked: int = CHECKED) -> Gate:
    """Thresholds from labelled rows with letters that are held out, so many of them at most, by a hash of the id.

    A prediction is sure from the least score on at which RIGHT of these rows, of those that it wins by ROOM phrases, are
    predicted right (never, if there is none): a text in two languages has a low score, however long it is. A text may need BITS_MARGIN times the bits a letter that these rows need together, and
    the room beyond it that RIGHT of these rows (of few rows all but one) stay within, ROOM phrases at least.
    """
    rows = docs.filter(held_out(id_col) & F.col(label_col).isin(model.labels) & F.col(text_col).rlike(r"\p{L}"))
    some = [(r[0],) for r in rows.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(checked).collect()]
    # A bounded number of ids is broadcast, and only their texts are looked at.
    some = docs.sparkSession.createDataFrame(some, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}")
    rows = rows.select(id_col, F.col(label_col).cast("string").alias("label"), text_col).join(F.broadcast(some), id_col)
    found = identify(rows, model, id_col, text_col, ["label"]).filter("letters > 0").select("letters", "bits_per_letter", "margin_bits", "score", (F.col("label") == F.col("lang_pred")).alias("right")).collect()
    if not found:
        return Gate(model)
    return thresholds(model, *(np.array([r[k] for r in found]) for k in range(5)))


def thresholds(model: Model, letters: np.ndarray, bits: np.ndarray, margin: np.ndarray, score: np.ndarray, right: np.ndarray) -> Gate:
    """From letters, bits a letter, margins and scores of rows, and whether their prediction is right."""
    least = ROOM * model.phrase_bits
    score_of, right_of = score[margin >= least], right[margin >= least]
    order = np.lexsort((right_of, -score_of))
    so_far = np.cumsum(right_of[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(so_far >= RIGHT)
    sure = float(score_of[order[enough[-1]]]) if len(enough) else np.inf
    most = BITS_MARGIN * float((bits * letters).sum() / letters.sum())
    room = float(np.quantile((bits - most) * letters, RIGHT, method="lower"))
    return Gate(model, sure, most, max(least, room))


def with_language(docs: DataFrame, gate: Gate, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Rows of docs in a language, as they are: those without letters go, and what the gate rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(gate)

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        text, label = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text_col, label_col))
        return shared.value.passes(text, label)

    return keep_rows(docs, mask)
