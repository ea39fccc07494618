"""Toxicity from misspelled lexicon terms in their context (operator 13).

The *lexicon* is learned: whole words, and stems of ``STEMS`` letters that many words share, which far more toxic than clean
labelled documents contain in direct speech, beyond chance even if copies of a text (with the same least hash of three-word
sequences) count as one. A trie holds it. For each different word of a batch a Levenshtein automaton (the positions reached
with 0, 1, 2 errors, as bits) walks the trie, which gives all terms within as many errors as their length allows; a stem may
match the beginning of a word. Words whose letters rule every term out are left aside before, by bit masks of letters and of
their pairs; words near a term that clean labelled documents have are ordinary words, and spared.

Of each hit the *window* of ``WINDOW`` words on both sides is read: is it inside quotation marks, near a word of reporting,
near a word that addresses somebody, and how much more often do its words surround terms in toxic than in clean labelled
documents? Hits in direct speech and reported ones, exact and misspelled ones are counted apart. A logistic regression over
these counts, fitted on labelled documents (toxic ones a second time with their exact hits counted as misspelled ones),
gives the score; so reported terms weigh what the labels say they do, and nothing where these do not tell.

Fitting takes at most ``LABELLED`` rows of each label, chosen by a hash of the id, and equal texts once. Then one pass over
all whole texts; nothing is shuffled. The model that goes to all tasks is bounded: ``TERMS`` terms, as many spared words,
``AROUND`` surrounding ones.

Cases: null texts count as empty and score like texts without hits; labels that are null, or contradict each other for one
id, teach nothing; without labels of both classes, or without terms, every document scores the share of toxic labels (0
without labels). Long texts are read in parts, cut between words. Repeated rows score alike; an empty table gives an empty
result. Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow, written

LABELLED = 4000
#: Letters of a stem, kinds of toxic documents that a term needs, and how many times as often as in clean ones.
STEMS = range(4, 9)
SUPPORT = 5
ODDS = 20
#: Terms that chance may add, of all tokens together.
CHANCE = 0.01
TERMS = 400
WINDOW = 5
#: Surrounding words that are weighed at most.
AROUND = 500
#: Clean documents that make a word near a term an ordinary one.
ORDINARY = 2
#: Errors allowed in terms of so many letters; stems need one letter more.
ERRORS = ((5, 1), (10, 2))
PART = 1_000_000
WORD = re.compile(r"[^\W_]+")
#: Fixed cues of four languages.
REPORTING = frozenset("said says say saying wrote writes written called calls quote quoted quoting according sagte sagt schrieb schreibt nannte nennt zitat zitiert laut dit disait écrit écrivait appelle citation selon dijo dice escribió escribe llamó llama cita según".split())
ADDRESSING = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split())
OPENING, CLOSING, STRAIGHT = "“„«‹", "”»›", '"'
_PIECES = re.compile(r"[^\W_]+|[\n\"“”„«»‹›]")


def words(text: str) -> set[str]:
    """The different words of a text, lower-cased."""
    out: set[str] = set()
    at = 0
    while at < len(text):
        end = at + PART
        while end < len(text) and text[end].isalnum():
            end += 1
        out.update(WORD.findall(text[at:end].lower()))
        at = end
    return out


def errors(term: str, stem: bool) -> int:
    return max((k for least, k in ERRORS if len(term) >= least + stem), default=0)


class Trie:
    """Terms by letters; a node is [children, numbers of terms that end here]."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.most = [errors(*t) for t in terms]
        self.root: list = [{}, []]
        for number, (term, _) in enumerate(terms):
            node = self.root
            for letter in term:
                node = node[0].setdefault(letter, [{}, []])
            node[1].append(number)

    def near(self, word: str) -> dict[int, int]:
        """Numbers of the terms that the word's automaton accepts, with their errors."""
        most = max(self.most, default=0)
        full, end = (1 << (len(word) + 1)) - 1, 1 << len(word)
        masks: dict[str, int] = {}
        for k, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 1 << k
        found: dict[int, int] = {}
        todo = [(self.root, [(1 << (e + 1)) - 1 & full for e in range(most + 1)])]
        while todo:
            (children, numbers), reached = todo.pop()
            for number in numbers:
                for e in range(self.most[number] + 1):
                    if reached[e] if self.terms[number][1] else reached[e] & end:
                        found[number] = e
                        break
            for letter, node in children.items():
                mask = masks.get(letter, 0)
                step = [(reached[0] & mask) << 1]
                for e in range(1, most + 1):
                    step.append((((reached[e] & mask) << 1) | reached[e - 1] | ((reached[e - 1] | step[e - 1]) << 1)) & full)
                if step[most]:
                    todo.append((node, step))
        return found


_BIT = np.array([1 << (c - 97 if 97 <= c < 123 else 26 + c % 38) for c in range(1024)], np.uint64)


def _masks(many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its length, a bit mask of its letters, and one of its pairs of letters, ends included."""
    sizes = np.array([len(w) for w in many])
    codes = np.frombuffer(("\0" + "\0".join(many) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    pairs = np.uint64(1) << ((codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(26)).astype(np.uint64)
    return sizes, np.bitwise_or.reduceat(_BIT[codes[1:] & 1023], marks), np.bitwise_or.reduceat(pairs, marks)


class Matcher:
    """Terms near words: words that may match one by their letters go to the trie."""

    def __init__(self, terms: list[tuple[str, bool]], spared: frozenset[str] = frozenset()):
        self.trie = Trie(terms)
        self.spared = spared
        self.known: dict[str, dict[int, int]] = {}

    def __call__(self, many: set[str]) -> dict[str, dict[int, int]]:
        """What matches of the given words."""
        listed = [w for w in many if w]
        out: dict[str, dict[int, int]] = {}
        if not listed or not self.trie.terms:
            return out
        if len(self.known) > 20_000:
            self.known.clear()
        for k in np.flatnonzero(self._possible(listed)).tolist():
            word = listed[k]
            if word not in self.known:
                self.known[word] = self.trie.near(word)
            if self.known[word] and word not in self.spared:
                out[word] = self.known[word]
        return out

    def _possible(self, many: list[str]) -> np.ndarray:
        """An error takes one letter and two pairs from a word at most, and adds one letter."""
        sizes, letters, pairs = _masks(many)
        out = np.zeros(len(many), bool)
        for own, own_pairs, (term, stem), most in zip(*_masks([t for t, _ in self.trie.terms])[1:], self.trie.terms, self.trie.most):
            # A stem's last pair, with the end mark, need not be there; neither need other letters of a longer word.
            fits = (sizes >= len(term) - most) & (np.bitwise_count(own & ~letters) <= most) & (np.bitwise_count(own_pairs & ~pairs) <= 2 * most + stem)
            if not stem:
                fits &= (sizes <= len(term) + most) & (np.bitwise_count(letters & ~own) <= most + 1)
            out |= fits
        return out


@dataclass
class Hit:
    """A word of a text that matches terms, with what surrounds it."""

    word: str
    quoted: bool
    around: list[str]


def hits(text: str, found: set[str]) -> Iterator[Hit]:
    """Every place of the found words in a text, with WINDOW words on both sides."""
    before: deque[str] = deque(maxlen=WINDOW)
    waiting: deque[tuple[Hit, int]] = deque()
    straight, depth, n = False, 0, 0
    for m in _PIECES.finditer(text):
        piece = m.group()
        if piece == "\n":
            straight, depth = False, 0
        elif piece in STRAIGHT:
            straight = not straight
        elif piece in OPENING:
            depth += 1
        elif piece in CLOSING:
            depth = max(0, depth - 1)
        else:
            for word in WORD.findall(piece.lower()):
                for hit, _ in waiting:
                    hit.around.append(word)
                n += 1
                while waiting and n - waiting[0][1] >= WINDOW:
                    yield waiting.popleft()[0]
                if word in found:
                    waiting.append((Hit(word, straight or depth > 0, list(before)), n))
                before.append(word)
    while waiting:
        yield waiting.popleft()[0]


def direct_words(text: str) -> set[str]:
    """The different words that stand outside quotation marks and not near a word of reporting."""
    many, direct, last = [], [], -WINDOW - 1
    straight, depth = False, 0
    out: set[str] = set()
    for m in _PIECES.finditer(text):
        piece = m.group()
        if piece == "\n":
            straight, depth = False, 0
        elif piece in STRAIGHT:
            straight = not straight
        elif piece in OPENING:
            depth += 1
        elif piece in CLOSING:
            depth = max(0, depth - 1)
        else:
            for word in WORD.findall(piece.lower()):
                if word in REPORTING:
                    last = len(many)
                    direct[-WINDOW:] = [False] * len(direct[-WINDOW:])
                many.append(word)
                direct.append(not straight and not depth and len(many) - 1 - last > WINDOW)
        if len(many) > PART:  # all but the last words are settled
            out.update(w for w, d in zip(many[:-WINDOW], direct) if d)
            last -= len(many) - WINDOW
            many, direct = many[-WINDOW:], direct[-WINDOW:]
    out.update(w for w, d in zip(many, direct) if d)
    return out


@dataclass
class Toxicity:
    """Terms with their weights, weights of surrounding words, and the regression; a constant where nothing is learned."""

    constant: float = 0.0
    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    spared: frozenset[str] = frozenset()
    around: dict[str, float] = field(default_factory=dict)
    model: np.ndarray | None = None

    def features(self, text: str, matches: dict[str, dict[int, int]], n_words: int) -> np.ndarray:
        """Counts of direct and reported, exact and misspelled hits; addressed ones; worst term; surroundings; density."""
        count, addressed, worst, said, n = np.zeros(4), 0, 0.0, 0.0, 0
        for hit in hits(text, matches.keys()):
            number, wrong = min(matches[hit.word].items(), key=lambda m: (m[1], -self.weights[m[0]], m[0]))
            reported = hit.quoted or not REPORTING.isdisjoint(hit.around)
            count[2 * (wrong > 0) + reported] += 1
            addressed += not reported and not ADDRESSING.isdisjoint(hit.around)
            worst = max(worst, 0.0 if reported else self.weights[number] / (1 + wrong))
            said += sum(self.around.get(w, 0.0) for w in hit.around)
            n += 1
        density = (count[0] + count[2]) / max(1, n_words)
        return np.array([*np.log1p(count), np.log1p(addressed), worst / 5, said / max(1, n), np.sqrt(density), 1.0])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * np.clip(rows @ self.model, -60, 60)))


FEATURES = 9
NO_HITS = np.array([0.0] * (FEATURES - 1) + [1.0])


def misspelled(rows: np.ndarray) -> np.ndarray:
    """Feature rows as if each exact hit had one error."""
    out = rows.copy()
    counts = np.expm1(rows[:, :4])
    out[:, 2:4] = np.log1p(counts[:, 2:] + counts[:, :2])
    out[:, :2] = 0
    out[:, 5] = np.where(counts[:, 0] > 0, rows[:, 5] / 2, rows[:, 5])
    return out


def _fit_logistic(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Newton steps with a weak penalty; own are the rows' weights."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 0.5)
    penalty[-1] = 1e-3
    for _ in range(60):
        p = 0.5 * (1 + np.tanh(0.5 * np.clip(x @ w, -60, 60)))
        h = (x * (own * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (own * (p - y)) + penalty * w)
        w = w - step / max(1.0, float(np.abs(step).max()) / 4)
    return w


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> DataFrame:
    """(text, label, stands_for) of at most so many labelled rows of each label, equal texts once, and the number of
    labelled rows that each stands for; written."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col)
    one = one.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("most")).filter("label = most")
    there = one.join(docs.select(id_col).distinct(), id_col, "left_semi").select(id_col, "label")
    counts = dict(there.groupBy("label").count().collect())
    picked = []
    for y, n in counts.items():
        rows = there.filter(F.col("label") == y).orderBy(F.xxhash64(id_col), id_col).limit(labelled).collect()
        picked += [(*r, n / len(rows)) for r in rows]
    some = docs.sparkSession.createDataFrame(picked, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, label int, stands_for double")
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("__text")).join(F.broadcast(some), id_col)
    return written(texts.groupBy(F.col("__text").alias("text"), "label").agg(F.sum("stands_for").alias("stands_for")), "labelled")


def _tokens(text: str) -> set[str]:
    """Direct words, each with an end mark, and their stems."""
    out = set()
    for word in direct_words(text):
        out.add(word + "$")
        out.update(word[:n] for n in STEMS if n < len(word))
    return out


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts = (Counter(), Counter())
    for text, label in zip(*(c.to_pylist() for c in batch.columns)):
        counts[label].update(_tokens(text))
    seen = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *[pa.array([c[t] for t in seen], pa.int64()) for c in counts]], ["token", "clean", "toxic"])


def _longest(found: dict[str, int]) -> list[str]:
    """Of tokens that continue each other one: the longest that nine tenths of the shorter one's documents have."""
    longer: dict[str, int] = {}
    for token in found:
        stem = next((token[:n] for n in range(min(max(STEMS), len(token) - 1), min(STEMS) - 1, -1) if token[:n] in found), "")
        longer[stem] = max(longer.get(stem, 0), found[token])
    kept: set[str] = set()
    for token in sorted(found, key=lambda t: (len(t), t)):
        if longer.get(token, 0) < 0.9 * found[token] and not any(token[:n] in kept for n in STEMS if n < len(token)):
            kept.add(token)
    return sorted(kept)


def _kind(text: str) -> int:
    """The least hash of a text's three-word sequences: copies share it, other texts do not."""
    least, last = 2**32, deque(maxlen=3)
    for m in WORD.finditer(text):
        last.append(m.group())
        least = min(least, zlib.crc32(" ".join(last).encode("utf-8", "surrogatepass"))) if len(last) == 3 else least
    return least if least < 2**32 else zlib.crc32(text.encode("utf-8", "surrogatepass"))


def lexicon(rows: DataFrame, toxic: int, clean: int) -> list[tuple[str, bool, float]]:
    """(term, stem, weight) of what tells toxic from clean rows (text, label)."""
    counts = map_arrow(rows.select("text", "label"), _counted, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts.filter(F.col("clean") + F.col("toxic") >= SUPPORT), "tokens")
    odds = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    n, share, base = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic")), toxic / (toxic + clean)
    # Bound of the probability that chance gives so high a share, for as many tokens as there are.
    surprise = n * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    least = math.log(max(1, counts.count()) / CHANCE)
    telling = counts.filter((F.col("toxic") >= SUPPORT) & (odds >= ODDS) & (surprise >= least)).select("token", "toxic", F.log(odds).alias("weight"), surprise.alias("surprise"))
    # Twenty tokens for each term that can stay.
    found = telling.orderBy(F.desc("toxic"), "token").limit(20 * TERMS).collect()
    weights = {r["token"]: r["weight"] for r in found}
    toxic_rows = {r["token"]: r["toxic"] for r in found}
    kept = _longest(toxic_rows)
    # Copies of one text are one kind of text, however many they are.
    shared = rows.sparkSession.sparkContext.broadcast(set(kept))

    def kinds(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {(t, _kind(text)) for text in batch.column(0).to_pylist() for t in _tokens(text) & shared.value}
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([k for _, k in out], pa.int64())], ["token", "kind"])

    of_kinds = map_arrow(rows.filter("label = 1").select("text"), kinds, "token string, kind long").groupBy("token").agg(F.countDistinct("kind").alias("n"))
    surprises = {r["token"]: r["surprise"] for r in found}
    enough = [t for t, n in of_kinds.collect() if n >= SUPPORT and surprises[t] * n / toxic_rows[t] >= least]
    enough = sorted(enough, key=lambda t: (-toxic_rows[t], t))[:TERMS]
    return sorted((t.removesuffix("$"), not t.endswith("$"), weights[t]) for t in enough)


def _ordinary_words(rows: DataFrame, terms: list[tuple[str, bool]]) -> frozenset[str]:
    """Words near a term that clean rows have: words of their own, not misspelled ones."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher, seen = Matcher(shared.value), Counter()
        for text in batch.column(0).to_pylist():
            seen.update(w for w, found in matcher(words(text)).items() if min(found.values()) > 0)
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = map_arrow(rows.filter("label = 0").select("text"), fn, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in counts.filter(F.col("n") >= ORDINARY).orderBy(F.desc("n"), "word").limit(TERMS).collect())


def _surrounding_words(rows: DataFrame, terms: list[tuple[str, bool]], spared: frozenset[str]) -> dict[str, float]:
    """How much more often words surround terms in toxic rows than in clean ones; nothing where clean rows have no terms."""
    shared = rows.sparkSession.sparkContext.broadcast((terms, spared))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher, counts = Matcher(*shared.value), (Counter(), Counter())
        for text, label in zip(*(c.to_pylist() for c in batch.columns)):
            counts[label].update({w for hit in hits(text, matcher(words(text)).keys()) for w in (*hit.around, "")})
        seen = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *[pa.array([c[t] for t in seen], pa.int64()) for c in counts]], ["word", "clean", "toxic"])

    counts = map_arrow(rows.select("text", "label"), fn, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    of_all = counts.filter("word = ''").first()
    if of_all is None or not of_all["clean"] or not of_all["toxic"]:
        return {}
    odds = F.log((F.col("toxic") + 1) / (of_all["toxic"] + 2) / ((F.col("clean") + 1) / (of_all["clean"] + 2)))
    some = counts.filter((F.col("word") != "") & (F.col("clean") + F.col("toxic") >= SUPPORT)).select("word", odds.alias("odds"))
    return {r["word"]: r["odds"] for r in some.orderBy(F.desc(F.abs("odds")), "word").limit(AROUND).collect()}


def _featured(texts: list[str | None], matcher: Matcher, model: Toxicity) -> np.ndarray:
    sets = [words(t or "") for t in texts]
    matches = matcher(set().union(*sets)) if sets else {}
    out = np.tile(NO_HITS, (len(texts), 1))
    for k, (text, own) in enumerate(zip(texts, sets)):
        mine = {w: matches[w] for w in own & matches.keys()}
        if mine:
            out[k] = model.features(text, mine, len(own))
    return out


def fit(rows: DataFrame) -> Toxicity:
    """Model from labelled rows (text, label, stands_for), which sample bounds."""
    share = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("stands_for").alias("of")).collect()}
    clean, toxic = (share[y]["n"] if y in share else 0 for y in (0, 1))
    of = [share[y]["of"] if y in share else 0.0 for y in (0, 1)]
    out = Toxicity(constant=of[1] / max(1.0, sum(of)))
    if not clean or not toxic:
        return out
    terms = lexicon(rows, toxic, clean)
    if not terms:
        return out
    out.terms, out.weights = [(t, stem) for t, stem, _ in terms], [w for *_, w in terms]
    out.spared = _ordinary_words(rows, out.terms)
    out.around = _surrounding_words(rows, out.terms, out.spared)
    shared = rows.sparkSession.sparkContext.broadcast(out)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _featured(batch.column(0).to_pylist(), Matcher(shared.value.terms, shared.value.spared), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    got = sorted((r["label"], bytes(r["x"])) for r in map_arrow(rows.select("text", "label"), fn, "label int, x binary").collect())
    x = np.array([np.frombuffer(b, float) for _, b in got])
    y = np.array([label for label, _ in got], float)
    hit = (y > 0.5) & (x[:, :4].sum(axis=1) > 0)
    # Each text weighs the same within its label, so that copies teach little; labels weigh as in all labelled rows.
    own = np.where(y > 0.5, of[1] / toxic, of[0] / clean) * len(y) / sum(of)
    own = np.where(hit, own / 2, own)
    out.model = _fit_logistic(np.concatenate([x, misspelled(x[hit])]), np.concatenate([y, y[hit]]), np.concatenate([own, own[hit]]))
    return out


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    matchers: list[Matcher] = []

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        if shared.value.model is None:
            found = np.full(batch.num_rows, shared.value.constant)
        else:
            if not matchers:
                matchers.append(Matcher(shared.value.terms, shared.value.spared))
            found = shared.value.score(_featured(batch.column(1).to_pylist(), matchers[0], shared.value))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return map_arrow(docs.select(id_col, text_col), fn, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
