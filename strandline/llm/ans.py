"""Token ids in a compressed binary format: static range asymmetric numeral system (operator 3).

Layout. A *file set* is a folder with ``table`` (id, frequency: one frequency table that all blocks share) and
``chunks`` (Parquet files; a row is a chunk of whole documents in ascending order of their ids). A chunk's payload is

    magic, version, scale, lanes, block tokens, checkpoint steps, tokens, number of segments, checksum of the table
    for each segment: words before it, lane states, CRC-32 of its words
    words: 32-bit little-endian renormalisation words of all segments

Tokens are cut into independent *blocks*; in a block token i belongs to lane i modulo ``LANES``, each lane being a coder
of its own that writes to the block's common stream of words. Every ``CHECKPOINT`` steps the states of all lanes are
kept, so a block can be entered at each of its segments: the reader decodes all segments of a chunk side by side.
Checksums are tested before decoding, and the lanes must end in the coder's first state.

Coding: with frequencies that sum to 2**scale, a state x takes symbol s as (x // f) * 2**scale + x % f + c, after its low
32 bits have moved to the stream if it would overflow 64 bits; the reader does the reverse.

Frequencies are counted over all tokens of the corpus and rounded up to 1 at least, so every id that occurs can be
coded. Documents are dealt by ranges of the id, so files follow one another in ascending order and none is large.

Cases: the string of an added token in a text gives that token's id, as the library does; null texts count as empty,
which gives the end id alone; rows with a null id come first; rows that repeat an id
follow one another; an empty table gives an empty file set; extra columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow, scratch, written

LANES = 128
BLOCK = 65_536
CHECKPOINT = 128
#: Tokens in a chunk at least, unless a partition ends.
CHUNK_TOKENS = 1 << 20
SCALE = 20
MAGIC = b"RANS"
HEAD = struct.Struct("<4sBBHIIQII")
FIRST_STATE = np.uint64(1 << 32)
#: Up to so many chunks (of a million tokens each) their first tokens' places are broadcast, 16 bytes each.
BROADCAST_CHUNKS = 200_000
#: Words whose ids a Python worker remembers at most.
MEMO_WORDS = 1_000_000
#: Bytes of texts whose words are looked up at a time.
BYTES_AT_ONCE = 32_000_000
#: Words whose ids are gathered at a time.
WORDS_AT_ONCE = 500_000
#: A sign that is a word of its own between words that are encoded together.
BETWEEN = "\x01"


class WordTokenizer:
    """A tokenizer of the tokenizers library whose pre-tokens never span white space, with a memo of words.

    Such a tokenizer gives a text the ids of its words in a row. It lower-cases, so words are remembered in lower
    case (ASCII letters only: the library does the rest). Texts that hold the string of an added token, in whatever
    case, go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        (self.between,) = self._plain([BETWEEN])[0]

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, texts: list[str]) -> None:
        together = [k for k, t in enumerate(texts) if BETWEEN not in t]
        apart = [k for k, t in enumerate(texts) if BETWEEN in t]
        for at in range(0, len(together), 1000):
            part = together[at : at + 1000]
            ids = np.array(self._plain([f" {BETWEEN} ".join(texts[k] for k in part)])[0], self.kind)
            ends = np.append(np.flatnonzero(ids == self.between), len(ids))
            begin = 0
            for k, end in zip(part, ends.tolist()):
                self.memo[texts[k]] = ids[begin:end].tobytes()
                begin = end + 1
        for k, ids in zip(apart, self._plain([texts[k] for k in apart])):
            self.memo[texts[k]] = np.array(ids, self.kind).tobytes()

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of different words, of which new ones are learned."""
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        if new := [w for w in words if w not in self.memo]:
            self._learn(new)
        return list(map(self.memo.__getitem__, words))

    def _some(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Ids of some texts: the different words among them are looked up, and their ids gathered in order."""
        lists = pc.ascii_split_whitespace(texts)
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        pool = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // self.kind.itemsize
        begin = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(pool), self.kind)
        words = coded.indices.to_numpy()
        out: list[bytes] = []
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(first, first[row] + WORDS_AT_ONCE)) - 1)
            word = words[first[row] : first[stop]]
            sizes = size[word]
            ends = np.cumsum(sizes)
            own = ids[np.repeat(begin[word] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
            at = np.concatenate([[0], ends])[first[row : stop + 1] - first[row]].tolist()
            out += [own[a:b].tobytes() + end for a, b in zip(at, at[1:])]
            row = stop
        return out

    def encode(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """Ids of each text with the end id, as little-endian integers of ``kind``."""
        end = np.array([end_id], self.kind).tobytes()
        plain = pc.ascii_lower(texts)
        whole = np.zeros(len(texts), bool)
        for name in self.added:
            whole |= pc.match_substring(plain, name).to_numpy(zero_copy_only=False)
        if whole.any():
            plain = pc.if_else(pa.array(whole), "", plain)
        sizes = pc.binary_length(texts).to_numpy()
        out: list[bytes] = []
        begin = 0
        while begin < len(texts):
            stop = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), BYTES_AT_ONCE)))
            out += self._some(plain.slice(begin, stop - begin), end)
            begin = stop
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self._plain([texts[k].as_py()])[0], self.kind).tobytes() + end
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**scale, of all ids up to the largest."""

    frequency: np.ndarray
    scale: int

    @staticmethod
    def of(ids: np.ndarray, counts: np.ndarray) -> Table:
        """Counts scaled and rounded, 1 at least; the largest make up for what rounding adds or leaves."""
        scale = max(SCALE, int(len(ids)).bit_length() + 2)
        full = 1 << scale
        scaled = np.maximum(1, (counts.astype(float) * (full / counts.sum())).astype(np.int64))
        order = np.lexsort((ids, -scaled))
        while (over := int(scaled.sum()) - full) != 0:
            if over < 0:
                scaled[order[0]] -= over
            else:
                spare = np.minimum(scaled[order] - 1, np.maximum(1, scaled[order] * over // full))
                spare = np.where(np.cumsum(spare) <= over, spare, np.maximum(0, over - (np.cumsum(spare) - spare)))
                scaled[order] -= spare
        frequency = np.zeros(int(ids.max()) + 1, np.int64)
        frequency[ids] = scaled
        return Table(frequency, scale)

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.frequency)])

    @property
    def checksum(self) -> int:
        return zlib.crc32(self.frequency.astype("<u4").tobytes())


def encode_chunk(tokens: np.ndarray, table: Table) -> bytes:
    """Payload of a chunk."""
    n = len(tokens)
    blocks = -(-n // BLOCK)
    steps = BLOCK // LANES
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[:n] = tokens
    used = np.arange(blocks * BLOCK) < n
    # (step, block, lane): all blocks are coded side by side, from the last step to the first.
    grid = np.ascontiguousarray(grid.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    used = np.ascontiguousarray(used.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    frequency, start = table.frequency.astype(np.uint64), table.starts.astype(np.uint64)
    scale, high = np.uint64(table.scale), np.uint64(64 - table.scale)
    state = np.full(blocks * LANES, FIRST_STATE)
    words: list[np.ndarray] = [None] * steps
    owners: list[np.ndarray] = [None] * steps
    kept: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        live = used[t]
        every = bool(live.all())
        f, c = frequency[grid[t]], start[grid[t]]
        if not every:
            f = np.where(live, f, np.uint64(1))
        full = (state >> high) >= f
        if not every:
            full &= live
        at = np.flatnonzero(full)
        words[t], owners[t] = state[at].astype(np.uint32), at // LANES
        state[at] >>= np.uint64(32)
        whole = state // f
        new = (whole << scale) + (state - whole * f) + c
        state = new if every else np.where(live, new, state)
        if t % CHECKPOINT == 0:
            kept.append(state.copy())
    kept.reverse()
    segments = steps // CHECKPOINT
    # Words in the order of blocks, then steps, then lanes.
    owner, word = np.concatenate(owners), np.concatenate(words)
    step_of = np.repeat(np.arange(steps), [len(w) for w in words])
    order = np.lexsort((step_of, owner))
    segment = owner * segments + step_of // CHECKPOINT
    word = word[order].astype("<u4")
    offsets = np.searchsorted(segment[order], np.arange(blocks * segments + 1))
    out = [HEAD.pack(MAGIC, 1, table.scale, LANES, BLOCK, CHECKPOINT, n, blocks * segments, table.checksum)]
    for b in range(blocks):
        for s in range(segments):
            k = b * segments + s
            own = word[offsets[k] : offsets[k + 1]].tobytes()
            out.append(struct.pack("<II", offsets[k], zlib.crc32(own)) + kept[s][b * LANES : (b + 1) * LANES].astype("<u8").tobytes())
    return b"".join(out) + word.tobytes()


def decode_chunk(payload: bytes, table: Table) -> np.ndarray:
    """Tokens of a chunk; raises ValueError if a checksum, the table or a final state does not fit."""
    magic, version, scale, lanes, block, checkpoint, n, segments, table_sum = HEAD.unpack_from(payload)
    if magic != MAGIC or version != 1 or scale != table.scale or table_sum != table.checksum:
        raise ValueError("not a chunk of this file set")
    size = 8 + 8 * lanes
    words = np.frombuffer(payload, "<u4", offset=HEAD.size + segments * size)
    offsets, states = np.zeros(segments + 1, np.int64), np.zeros((segments, lanes), np.uint64)
    sums = []
    for k in range(segments):
        offsets[k], crc = struct.unpack_from("<II", payload, HEAD.size + k * size)
        sums.append(crc)
        states[k] = np.frombuffer(payload, "<u8", lanes, HEAD.size + k * size + 8)
    offsets[-1] = len(words)
    for k, crc in enumerate(sums):
        if zlib.crc32(words[offsets[k] : offsets[k + 1]]) != crc:
            raise ValueError(f"segment {k} is damaged")
    steps = block // lanes
    per_block = steps // checkpoint
    symbol = _symbols(table.frequency.tobytes())
    frequency, start = table.frequency.astype(np.uint64), table.starts.astype(np.uint64)
    low, s = np.uint64((1 << scale) - 1), np.uint64(scale)
    state = states.ravel()
    out = np.zeros((checkpoint, segments * lanes), np.uint32)
    # First token of each segment, to tell which of its tokens exist.
    first = (np.arange(segments) // per_block) * block + (np.arange(segments) % per_block) * checkpoint * lanes
    index = np.repeat(first, lanes) + np.tile(np.arange(lanes), segments)
    following = offsets[:-1].copy()
    whole = n == (segments // per_block) * block
    for t in range(checkpoint):
        slot = state & low
        sym = symbol[slot.astype(np.int64)]
        new = frequency[sym] * (state >> s) + slot - start[sym]
        if whole:
            state = new
        else:
            live = index + t * lanes < n
            sym, state = np.where(live, sym, 0), np.where(live, new, state)
        out[t] = sym
        short = state < FIRST_STATE
        at = np.flatnonzero(short)
        counts = short.reshape(segments, lanes).sum(axis=1)
        places = np.repeat(following - (np.cumsum(counts) - counts), counts) + np.arange(len(at))
        state[at] = (state[at] << np.uint64(32)) | words[places]
        following += counts
    if (state.reshape(segments, lanes)[per_block - 1 :: per_block] != FIRST_STATE).any() or (following != offsets[1:]).any():
        raise ValueError("the stream does not end where it should")
    return out.reshape(checkpoint, segments, lanes).transpose(1, 0, 2).reshape(-1)[:n]


@lru_cache(maxsize=2)
def _symbols(frequency: bytes) -> np.ndarray:
    f = np.frombuffer(frequency, np.int64)
    return np.repeat(np.arange(len(f), dtype=np.uint32), f)


def tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens): binary little-endian ids of each document with its end id, of 2 or 4 bytes by the vocabulary."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(word_tokenizer(tokenizer).encode(batch.column(1), end_id), pa.binary())], [id_col, "tokens"])

    return map_arrow(rows, fn, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, tokens binary")


def frequency_table(coded: DataFrame, kind: str) -> Table | None:
    """One table from the counts of all tokens; its size is the vocabulary's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=len(total))
            own[: len(total)] += total
            total = own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    rows = coded.select("tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    rows.sort()
    return Table.of(np.array([r["id"] for r in rows]), np.array([r["n"] for r in rows]))


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise docs and write a file set to path, a folder that all machines reach."""
    spark = docs.sparkSession
    kind = word_tokenizer(tokenizer).kind.str
    coded = written(tokens(docs, tokenizer, end_id, id_col, text_col), "tokens")
    table = frequency_table(coded, kind)
    frequencies = [] if table is None else [(int(k), int(table.frequency[k])) for k in np.flatnonzero(table.frequency)]
    spark.createDataFrame(frequencies, "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[bytes] = []
        held = 0
        width = np.dtype(kind).itemsize

        def chunk() -> pa.RecordBatch:
            sizes = [len(p) // width for p in parts]
            payload = encode_chunk(np.frombuffer(b"".join(parts), kind), shared.value)
            row = [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["shard", "seq", "ids", "sizes", "payload"])

        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                parts.append(own)
                held += len(own) // width
                if held >= CHUNK_TOKENS:
                    yield chunk()
                    seq, ids, parts, held = seq + 1, [], [], 0
        if parts:
            yield chunk()

    ordered = coded.repartitionByRange(F.col(id_col).cast("long"), F.xxhash64("tokens")).sortWithinPartitions(F.col(id_col).cast("long"), F.xxhash64("tokens"))
    chunks = ordered.select(F.col(id_col).cast("long").alias(id_col), "tokens").mapInArrow(pack, "shard int, seq int, ids array<long>, sizes array<long>, payload binary")
    chunks.write.option("compression", "uncompressed").parquet(f"{path}/chunks")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of a file set; tokens as little-endian unsigned 32-bit integers.

    Where a chunk's first token stands follows from sums: of the files before its file, of the chunks before it.
    """
    rows = sorted(map(tuple, spark.read.parquet(f"{path}/table").collect()))
    table = None
    if rows:
        frequency = np.zeros(rows[-1][0] + 1, np.int64)
        for k, f in rows:
            frequency[k] = f
        table = Table(frequency, int(frequency.sum()).bit_length() - 1)
    chunks = spark.read.parquet(f"{path}/chunks")
    sizes = chunks.select("shard", "seq", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))  # a row for each file: a few thousand at most
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("files"))
    within = sizes.select("shard", "seq", (F.sum("n").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n")).alias("chunks"))
    begin = written(within.join(before, "shard").select("shard", "seq", (F.col("files") + F.col("chunks")).alias("begin")), "begin")
    if begin.count() <= BROADCAST_CHUNKS:
        begin = F.broadcast(begin)
    shared = spark.sparkContext.broadcast(table)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, seq, ids, sizes, payload = (batch.column(k)[row].as_py() for k in range(5))
                every = decode_chunk(payload, shared.value).astype("<u4")
                ends = np.cumsum(sizes)
                own = [every[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes)]
                columns = [pa.array([shard] * len(ids), pa.int32()), pa.array([seq] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(ends - np.array(sizes)), pa.array(sizes, pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "seq", "doc_id", "at", "n_tokens", "tokens"])

    found = chunks.select("shard", "seq", "ids", "sizes", "payload").mapInArrow(unpack, "shard int, seq int, doc_id long, at long, n_tokens long, tokens binary")
    return found.join(begin, ["shard", "seq"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "tokens")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs as a file set in the shared folder and read it back."""
    path = scratch(docs.sparkSession, "ans")
    write_files(docs, path, tokenizer, end_id)
    return read_files(docs.sparkSession, path)
