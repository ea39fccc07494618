"""Benchmark decontamination by SimHash of item-sized windows (operator 4).

Words are runs of letters and digits, in lower case; a shingle is ``SHINGLE`` words (all of them in shorter items). For
an item the operator slides a window of the item's number of words over a document and takes the window's SimHash
(majority of its shingles' hash bits, from running sums). Fingerprints within ``RADIUS`` bits agree to within
RADIUS // 4 bits on at least one of four 16-bit blocks; windows and items that do are candidates, and each is verified
by the exact weighted similarity of the two shingle multisets, the sum of the smaller over the sum of the larger counts;
``SIMILARITY`` or more is a hit.

Blocks alone would let a third of all pairs of windows and items through (16 random bits are within 5 of 16 others in a
tenth of the cases), so documents meet only items with which they share a *rare shingle*: a hit has all but a fifth of
its item's shingles, so it has one of any set of them that weighs more than a fifth. For each item those are chosen that
the fewest items have. Windows are taken only around them. Neither loses a hit.

The benchmark stays a table: its rare shingles are hashed into a bit filter of at most ``MOST_BITS`` bits, whatever their
number, and only that is broadcast. One pass over the documents finds those with a shingle that the filter knows; these
meet the items by a join on shingles, and their texts meet the items' data in chunks of ``CHUNK_SHINGLES``.

Cases: null or wordless documents and items hit nothing; documents shorter than an item are one window; of equally
similar windows the first counts; repeated documents repeat their hits, repeated items count once; an empty table on either side gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import keep_rows, map_arrow, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS, BLOCK_BITS = 4, 16
#: Bits of the filter for each rare shingle, looked up at so many places; and bits at most.
BITS_EACH, PLACES, MOST_BITS = 32, 6, 1 << 28
#: Shingles of items that meet a document's text at a time.
CHUNK_SHINGLES = 50_000
#: Characters of documents whose words are hashed at a time.
CHARS_AT_ONCE = 1_000_000
#: Window positions whose bits are summed at a time.
SPAN_AT_ONCE = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IN_WORD: np.ndarray | None = None


def _word_table() -> np.ndarray:
    global _IN_WORD
    if _IN_WORD is None:
        _IN_WORD = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _IN_WORD


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words begin (one more than texts)."""
    joined = "\n".join(texts).lower() if all(t.isascii() for t in texts) else "\n".join(t.lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) if t.isascii() else len(t.lower()) for t in texts), np.int64, len(texts))
    text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _word_table()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    # Each word as a polynomial in an odd base modulo 2**64, from running sums: the inverse of the base undoes its place.
    power = np.full(len(points) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    back = np.full(len(points) + 1, _INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return _mix((sums[ends] - sums[starts]) * back[starts]), np.searchsorted(starts, text_at)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle that begins at each word and has all its words in the array."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _BASE + words[k : k + n]
    return _mix(total)


def simhash(hashes: np.ndarray) -> int:
    """Majority of each bit over the hashes; 0 where it is a tie."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0) > len(hashes), bitorder="little").view("<u8")[0])


def _windows(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of size shingles that begins at one of the starts (ascending)."""
    out = np.zeros(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + SPAN_AT_ONCE)))
        own = starts[begin:end]
        span = shingles[own[0] : own[-1] + size]
        bits = np.unpackbits(span.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((len(span) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        at = own - own[0]
        major = 2 * (sums[at + size] - sums[at]) > size
        out[begin:end] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
        begin = end
    return out


def near_windows(windows: np.ndarray, item: int) -> np.ndarray:
    """Windows within RADIUS bits of an item: of those with a block near enough, the ones that are so as a whole."""
    differ = windows ^ np.uint64(item)
    blocks = np.bitwise_count(differ[:, None] >> (np.arange(BLOCKS, dtype=np.uint64) * np.uint64(BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1))
    candidates = np.flatnonzero((blocks <= RADIUS // BLOCKS).any(axis=1))
    return candidates[np.bitwise_count(differ[candidates]) <= RADIUS]


class Shingles:
    """A document's shingles of each width, and where those of an item are."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order of the text, and their order by hash."""
        if width not in self.by_width:
            own = shingle_hashes(self.words, width)
            self.by_width[width] = own, np.argsort(own, kind="stable")
        return self.by_width[width]

    def places(self, width: int, some: np.ndarray) -> np.ndarray:
        own, order = self.of(width)
        low, high = np.searchsorted(own, some, sorter=order), np.searchsorted(own, some, "right", sorter=order)
        return np.concatenate([np.zeros(0, np.int64), *[order[a:b] for a, b in zip(low, high) if b > a]])


def best_window(doc: Shingles, size: int, fingerprint: int, shingles: np.ndarray, rare: np.ndarray) -> tuple[int, int, float] | None:
    """(first word, words, similarity) of the best window for an item of size words, if it is a hit."""
    width = min(SHINGLE, size)
    at = doc.places(width, rare)
    if not len(at):
        return None
    own, _ = doc.of(width)
    n = min(size, len(doc.words)) - width + 1  # shingles in a window
    last = len(own) - n
    span = np.zeros(last + 2, np.int32)
    np.add.at(span, np.clip(at - n + 1, 0, last), 1)
    np.add.at(span, np.minimum(at, last) + 1, -1)
    starts = np.flatnonzero(np.cumsum(span[:-1]) > 0)
    counts, best = Counter(shingles.tolist()), None
    for w in starts[near_windows(_windows(own, starts, n), fingerprint)].tolist():
        shared = sum((Counter(own[w : w + n].tolist()) & counts).values())
        similarity = shared / (n + len(shingles) - shared)
        if similarity >= SIMILARITY and (best is None or similarity > best[2]):
            best = w, n + width - 1, similarity
    return best


def prepared(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: items (item, id, n_words, width, fingerprint, shingles, weight) and their rare shingles (item, width, shingle)."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").distinct()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at = word_hashes(batch.column(1).to_pylist())
        own = [words[a:b] for a, b in zip(at, at[1:])]
        kept = [k for k, w in enumerate(own) if len(w)]
        sizes = [len(own[k]) for k in kept]
        shingles = [shingle_hashes(own[k], min(SHINGLE, n)) for k, n in zip(kept, sizes)]
        prints = np.array([simhash(s) for s in shingles], np.uint64).view(np.int64)
        columns = [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array([min(SHINGLE, n) for n in sizes], pa.int32())]
        columns += [pa.array(prints), pa.array([s.view(np.int64) for s in shingles], pa.list_(pa.int64())), pa.array([len(s) for s in shingles], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "width", "fingerprint", "shingles", "weight"])

    found = map_arrow(rows, fn, f"id {benchmark.schema[id_col].dataType.simpleString()}, n_words long, width int, fingerprint long, shingles array<long>, weight long")
    items = written(found.withColumn("item", F.monotonically_increasing_id()), "items")
    each = items.select("item", "width", "weight", F.explode("shingles").alias("shingle")).groupBy("item", "width", "weight", "shingle").agg(F.count("*").alias("n"))
    known = each.groupBy("width", "shingle").agg(F.count("*").alias("items"))
    before = Window.partitionBy("item").orderBy("items", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.join(known, ["width", "shingle"]).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Taken until they weigh more than what a hit may lack.
    return items, written(ranked.filter(F.col("before") <= F.col("weight") * (1 - SIMILARITY) + 1e-9).select("item", "width", "shingle"), "rare-shingles")


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(PLACES, hashes): where hashes are in a filter of so many bits, a power of two."""
    step = _mix(hashes) | np.uint64(1)
    return (hashes[None, :] + np.arange(PLACES, dtype=np.uint64)[:, None] * step[None, :]) & np.uint64(bits - 1)


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """Bits of all hashes of a table's one long column, as bytes. Made on Spark; at most MOST_BITS come to the driver."""
    distinct = hashes.distinct()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_EACH * distinct.count()).bit_length()))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.unique(_places(batch.column(0).to_numpy().view(np.uint64), bits)).view(np.int64))], ["place"])

    words = map_arrow(distinct, fn, "place long").groupBy(F.shiftright("place", 3).alias("byte")).agg(F.bit_or(F.expr("1 << cast(place & 7 as int)")).alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[words.column("byte").to_numpy()] = words.column("bits").to_numpy()
    return out


def known_to(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which hashes a filter knows; those that the first places rule out are not looked up further."""
    alive = np.arange(len(hashes))
    step = _mix(hashes) | np.uint64(1)
    for k in range(PLACES):
        place = (hashes[alive] + np.uint64(k) * step[alive]) & np.uint64(8 * len(table) - 1)
        alive = alive[(table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return alive


def _slices(texts: list[str]) -> list[tuple[int, int]]:
    out, begin = [], 0
    while begin < len(texts):
        end, chars = begin, 0
        while end < len(texts) and (end == begin or chars + len(texts[end]) <= CHARS_AT_ONCE):
            chars += len(texts[end])
            end += 1
        out.append((begin, end))
        begin = end
    return out


def met(texts: list[str | None], widths: list[int], table: np.ndarray) -> list[np.ndarray]:
    """Distinct shingles of each text that the filter knows."""
    out: list[np.ndarray] = []
    texts = [t or "" for t in texts]
    for begin, end in _slices(texts):
        words, at = word_hashes(texts[begin:end])
        found = [[np.zeros(0, np.uint64)] for _ in range(begin, end)]
        for width in widths:
            own = shingle_hashes(words, width)
            place = known_to(own, table)
            text = np.searchsorted(at, place, "right") - 1
            inside = place + width <= at[text + 1]  # not over the end of a text
            for t, s in zip(text[inside].tolist(), own[place[inside]]):
                found[t].append(np.array([s], np.uint64))
        out += [np.unique(np.concatenate(x)) for x in found]
    return out


class Search:
    """A benchmark ready for searching: its tables, the filter as a broadcast, and the widths of its shingles."""

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
        self.items, self.rare = prepared(benchmark, id_col, text_col)
        self.widths = sorted(r[0] for r in self.items.select("width").distinct().collect())
        self.table = benchmark.sparkSession.sparkContext.broadcast(bit_filter(self.rare.select("shingle")))

    def touched(self, docs: DataFrame, text_col: str) -> DataFrame:
        """Written: docs with a shingle that the filter knows, all columns, with ``__row`` and ``__met`` (these shingles)."""
        table, widths = self.table, self.widths
        at = docs.columns.index(text_col)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = met(batch.column(at).to_pylist(), widths, table.value)
            kept = [k for k, x in enumerate(found) if len(x)]
            rows = batch.take(pa.array(kept, pa.int64()))
            return rows.append_column("__met", pa.array([found[k].view(np.int64) for k in kept], pa.list_(pa.int64())))

        schema = T.StructType([*docs.schema.fields, T.StructField("__met", T.ArrayType(T.LongType()))])
        return written(map_arrow(docs, fn, schema).withColumn("__row", F.monotonically_increasing_id()), "touched")

    def hits(self, touched: DataFrame, text_col: str) -> DataFrame:
        """(__row, item, first_word, n_words, similarity) of touched()."""
        pairs = touched.select("__row", F.explode("__met").alias("shingle")).join(self.rare.select("shingle", "item"), "shingle").select("__row", "item").distinct()
        rare = self.rare.groupBy("item").agg(F.collect_list("shingle").alias("rare"))
        own = self.items.join(rare, "item").select("item", "n_words", "fingerprint", "shingles", "rare", "weight")
        # A document that touches very many items meets them in chunks.
        so_far = Window.partitionBy("__row").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
        dealt = pairs.join(self.items.select("item", "weight"), "item").withColumn("chunk", F.floor(F.coalesce(F.sum("weight").over(so_far), F.lit(0)) / CHUNK_SHINGLES))
        data = dealt.select("__row", "chunk", "item").join(own.drop("weight"), "item")
        grouped = data.groupBy("__row", "chunk").agg(F.collect_list(F.struct("item", "n_words", "fingerprint", "shingles", "rare")).alias("items"))
        rows = grouped.join(touched.select("__row", F.col(text_col).alias("text")), "__row").select("__row", "text", "items")

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for row, text, items in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc = Shingles(word_hashes([text])[0])
                for x in items:
                    shingles, some = (np.array(x[k], np.int64).view(np.uint64) for k in ("shingles", "rare"))
                    if best := best_window(doc, x["n_words"], x["fingerprint"] % (1 << 64), shingles, some):
                        out.append((row, x["item"], *best))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["__row", "item", "first_word", "n_words", "similarity"])

        return map_arrow(rows, fn, "__row long, item long, first_word long, n_words long, similarity double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, first_word, n_words, similarity): the best window of each document for each item it contains."""
    search = Search(benchmark, item_col, text_col)
    touched = search.touched(docs.select(id_col, text_col), text_col)
    found = search.hits(touched, text_col).join(search.items.select("item", F.col("id").alias(item_col)), "item")
    return found.join(touched.select("__row", id_col), "__row").select(id_col, item_col, "first_word", "n_words", "similarity")


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of docs that contain no item, as they are. Rows that share no rare shingle with any item are not shuffled."""
    search = Search(benchmark)
    touched = search.touched(docs, text_col)
    hit = search.hits(touched, text_col).select("__row").distinct()
    table, widths = search.table, search.widths

    def mask(batch: pa.RecordBatch) -> list[bool]:
        return [not len(x) for x in met(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), widths, table.value)]

    return keep_rows(docs, mask).unionByName(touched.join(hit, "__row", "left_anti").drop("__row", "__met"))
