"""Byte-level BPE encoding and decoding (operator 6).

Bytes are mapped one to one to Latin-1 characters, so that an Aho-Corasick automaton over strings finds the longest
vocabulary entry at a place in a piece. The encoder walks from the left, takes the longest entry that is *compatible*
with the token before it, then shorter ones, and steps back when none is. Two tokens are compatible when merging their
joint bytes gives just these two again; a sequence whose neighbours are all compatible is the sequence that the merges
give, and a prefix has one such sequence only, so a position that failed once needs no second visit. Compatibility is
memoised per pair.

Texts are cut at single spaces between two characters that are no white space: the pattern always starts a match there.
The different chunks of a batch are found by Arrow dictionaries, new ones are encoded together, and ids are gathered in
the order of the texts. Of new pieces, one pass of the automaton takes the longest entries; those with an incompatible
pair are walked side by side, a step of each at a time, and very long ones alone.

Cases: null text encodes as the empty text; empty text gives no ids; repeated rows and ties are encoded row by row;
an empty table gives an empty table; other columns than id and text are not read, so their names cannot clash. A text
of many MB without a space is one piece or few and takes memory in proportion to it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import map_arrow

#: Entries that a Python worker remembers at most; beyond that a memo starts anew.
MEMO_CHUNKS = 150_000
MEMO_PAIRS = 300_000
#: Longer chunks are not remembered; pieces of more bytes are walked alone.
LONG_CHUNK = 100
LONG_PIECE = 200
#: Pieces that are walked side by side.
PIECES_AT_ONCE = 20_000
#: Bytes of texts that are encoded, and tokens that are decoded, at a time.
BYTES_AT_ONCE = 4_000_000
TOKENS_AT_ONCE = 1_000_000
#: No byte's character: between pieces that the automaton reads in one pass.
BETWEEN = "Ā"


class BpeCodec:
    """Encoder and decoder for a vocabulary of byte strings with ranks, which has every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.vocab = [b""] * (max(ranks.values()) + 1)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.vocab[rank] = token
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.longest, self.matches = automaton.iter_long, automaton.iter
        self.sizes = list(map(len, self.vocab))
        self.size = np.array(self.sizes)
        self.reach = max(self.sizes)
        self.entries = pa.array(self.vocab, pa.binary())
        #: The longest entry that is a proper prefix of each entry; -1 for a single byte.
        self.shorter = [next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1) for t in self.vocab]
        self.shorter_of = np.array(self.shorter)
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}

    def merged(self, piece: bytes, below: float = float("inf")) -> list[int]:
        """Plain merging with ranks under a bound: for vocabulary entries and tests, not for texts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; none for a single byte."""
        if token not in self.halves:
            parts = self.merged(self.vocab[token], below=token) if len(self.vocab[token]) > 1 else []
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else ()
        return self.halves[token] or None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merges leave the boundary between two tokens alone.

        Undoes the later merge of the two sides again and again; at each step the two tokens that touch the boundary
        must not have had a merge of their own that comes before the merge just undone.
        """
        key = left << 32 | right
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok = self._undo(left, right)
        return ok

    def _undo(self, left: int, right: int) -> bool:
        # A merge across beats what was undone if its rank is lower; of equal ranks the leftmost is merged first.
        bound = float("inf")
        while True:
            across = self.ranks.get(self.vocab[left] + self.vocab[right])
            if across is not None and across < bound:
                return False
            parts_l, parts_r = self.split(left), self.split(right)
            if parts_l and (not parts_r or left > right):
                bound, left = left, parts_l[1]
            elif parts_r:
                bound, right = right + 1, parts_r[0]
            else:
                return True

    def all_compatible(self, pairs: np.ndarray) -> np.ndarray:
        """compatible() of many pairs, given as left << 32 | right."""
        some, of = np.unique(pairs, return_inverse=True)
        return np.fromiter((self.compatible(p >> 32, p & 0xFFFFFFFF) for p in some.tolist()), bool, len(some))[of]

    def encode_piece(self, text: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1 characters for bytes."""
        n, reach, sizes, longest = len(text), self.reach, self.sizes, self.longest
        out: list[int] = []
        dead: set[int] = set()
        at = 0
        while at < n:
            (_, token) = next(longest(text[at : at + reach]))
            while at + sizes[token] in dead or (out and not self.compatible(out[-1], token)):
                token = self.shorter[token]
                while token < 0:  # no entry fits here: a shorter one before it
                    dead.add(at)
                    last = out.pop()
                    at -= sizes[last]
                    token = self.shorter[last]
            out.append(token)
            at += sizes[token]
        return out

    def walk(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pieces, as encode_piece() gives them one by one."""
        joined = b"\xff".join(raw).decode("latin-1").replace("\xff", BETWEEN)  # no UTF-8 text has this byte
        longest = np.zeros(len(joined) + 1, np.int64)
        found = np.fromiter(self.matches(joined), _MATCH)
        longest[found["end"] + 1 - self.size[found["token"]]] = found["token"]  # in order of ends: the last one stays
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(size + 1) - size - 1
        end = start + size
        dead = np.zeros(len(joined) + 1, bool)
        via = np.zeros(len(joined) + 1, np.int64)  # the token that ends at a place: there is one way to each
        row = np.flatnonzero(size > 0)
        at = start[row]
        token = longest[at]
        while len(row):
            back = token < 0  # no entry fits at this place: a shorter one before it
            fits = ~back
            fits[fits] = ~dead[at[fits] + self.size[token[fits]]]
            inner = np.flatnonzero(fits & (at > start[row]))
            fits[inner] = self.all_compatible(via[at[inner]] << 32 | token[inner])
            dead[at[back]] = True
            token[back] = via[at[back]]
            at[back] -= self.size[token[back]]
            token[~fits] = self.shorter_of[token[~fits]]
            at[fits] += self.size[token[fits]]
            via[at[fits]] = token[fits]
            token[fits] = longest[at[fits]]
            on = at < end[row]
            row, at, token = row[on], at[on], token[on]
        rows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        row, at = np.flatnonzero(size > 0), end[size > 0]
        while len(row):  # from the last token of each piece to its first
            rows.append(row)
            ids.append(via[at])
            at = at - self.size[ids[-1]]
            on = at > start[row]
            row, at = row[on], at[on]
        owner = np.concatenate(rows[::-1])
        order = np.argsort(owner, kind="stable")
        return np.concatenate(ids[::-1])[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(raw)))])

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of different matches of the pattern."""
        raw = [p.encode("utf-8") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        joined = b"\xff".join(raw).decode("latin-1").replace("\xff", BETWEEN)
        ids = np.fromiter(self.longest(joined), _MATCH)["token"]
        owner = np.searchsorted(np.cumsum(size), np.cumsum(self.size[ids]))
        inside = owner[1:] == owner[:-1]
        fits = self.all_compatible((ids[:-1] << 32 | ids[1:])[inside])
        walked = np.zeros(len(raw), bool)
        walked[owner[1:][inside][~fits]] = True
        together = np.flatnonzero(walked & (size <= LONG_PIECE))
        parts = [(owner[~walked[owner]], ids[~walked[owner]])]
        for k in range(0, len(together), PIECES_AT_ONCE):
            some = together[k : k + PIECES_AT_ONCE]
            found, offsets = self.walk([raw[k] for k in some.tolist()])
            parts.append((np.repeat(some, np.diff(offsets)), found))
        for k in np.flatnonzero(walked & (size > LONG_PIECE)).tolist():
            own = np.array(self.encode_piece(raw[k].decode("latin-1")), np.int64)
            parts.append((np.full(len(own), k), own))
        owner, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(raw)))])

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks. Those that begin with a space, and have no other white space at their ends, make
        one text whose matches begin anew at each of them."""
        even = [k for k, c in enumerate(chunks) if c[:1] == " " and not c[1:2].isspace() and not c[-1:].isspace()]
        others = np.ones(len(chunks), bool)
        others[even] = False
        pieces = self.find("".join([chunks[k] for k in even]))
        stops = np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.cumsum([len(chunks[k]) for k in even]))
        count = np.zeros(len(chunks), np.int64)
        count[even] = np.diff(stops + 1, prepend=0) if len(even) else 0
        order = [*even, *np.flatnonzero(others).tolist()]
        for k in order[len(even) :]:
            found = self.find(chunks[k])
            count[k] = len(found)
            pieces += found
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        if not len(coded):
            return [b""] * len(chunks)
        ids, offsets = self.encode_pieces(coded.dictionary.to_pylist())
        size = np.diff(offsets)
        piece = coded.indices.to_numpy()
        ends = np.cumsum(size[piece])
        flat = ids.astype("<u4")[np.repeat(offsets[piece] - (ends - size[piece]), size[piece]) + np.arange(ends[-1])]
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count[order])])].tolist()
        out: list[bytes] = [b""] * len(chunks)
        data = flat.tobytes()
        for k, a, b in zip(order, at, at[1:]):
            out[k] = data[4 * a : 4 * b]
        return out

    def known(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks, of which new ones are learned."""
        if len(self.memo) >= MEMO_CHUNKS:
            self.memo.clear()
        memo = self.memo
        found = [memo.get(c) for c in chunks]
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self._learn([chunks[k] for k in new])):
            found[k] = ids
            if len(chunks[k]) < LONG_CHUNK and len(memo) < MEMO_CHUNKS:
                memo[chunks[k]] = ids
        return found

    def _some(self, texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        index = words.indices.to_numpy().copy()
        pool = words.dictionary.to_pylist()
        # A word with white space at an end, or none, stands beside more than one space: such texts are cut one by one.
        plain = np.fromiter((bool(w) and not w[0].isspace() and not w[-1].isspace() for w in pool), bool, len(pool))
        uneven = np.flatnonzero(np.add.reduceat(~plain[index], first[:-1], dtype=np.int64) > 0).tolist()
        cut = [_CUT(texts[k].as_py()) for k in uneven]
        begins = pa.array([words.dictionary[i].as_py() for i in index[first[:-1]].tolist()]).dictionary_encode()
        apart = pa.array([c if k == 0 else " " + c for own in cut for k, c in enumerate(own)], pa.string()).dictionary_encode()
        spaced = [" " + w for w, even in zip(pool, plain) if even]
        names = [*spaced, *begins.dictionary.to_pylist(), *apart.dictionary.to_pylist()]
        ids = pa.array(self.known(names), pa.binary())
        place = np.cumsum(plain) - 1
        index = place[index]
        index[first[:-1]] = begins.indices.to_numpy() + len(spaced)
        if uneven:
            index = np.split(index, first[1:-1])
            sizes = np.diff(first)
            own = np.split(apart.indices.to_numpy() + len(spaced) + len(begins.dictionary), np.cumsum([len(c) for c in cut])[:-1])
            for k, x in zip(uneven, own):
                index[k], sizes[k] = x, len(x)
            index, first = np.concatenate(index), np.concatenate([[0], np.cumsum(sizes)])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), ids.take(pa.array(index))), b"")

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        parts = [self._some(texts.slice(a, b - a)) for a, b in _slices(pc.binary_length(texts).to_numpy(), BYTES_AT_ONCE)]
        return pa.chunked_array(parts, pa.binary()).combine_chunks()

    def decode(self, ids: pa.Array) -> pa.Array:
        """Bytes of sequences of ids."""
        sizes = pc.binary_length(ids).to_numpy() // 4
        parts = []
        for a, b in _slices(sizes, TOKENS_AT_ONCE):
            own = np.frombuffer(b"".join(ids.slice(a, b - a).to_pylist()), "<u4")
            offsets = np.concatenate([[0], np.cumsum(sizes[a:b])])
            parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.entries.take(pa.array(own))), b""))
        return pa.chunked_array(parts, pa.binary()).combine_chunks()


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so much in all, or of one row."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        stop = max(begin + 1, int(np.searchsorted(ends, most + (ends[begin - 1] if begin else 0), "right")))
        yield begin, stop
        begin = stop


_MATCH = np.dtype([("end", np.int64), ("token", np.int64)])
_CUT = re.compile(r"(?<=\S) (?=\S)").split


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BpeCodec:
    """One codec per vocabulary file and Python worker. The file is at the same path on every machine."""
    with open(path, "rb") as lines:
        return BpeCodec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary"


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids is binary, little-endian unsigned 32-bit."""
    rows, schema = _rows(docs, id_col, text_col)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), codec(vocabulary, pattern).encode(batch.column(1))], [id_col, "ids"])

    return map_arrow(rows, fn, schema)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to a table with ``ids``; a null in ids decodes as no bytes."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pc.fill_null(batch.column(batch.schema.get_field_index("ids")), b"")
        return batch.append_column("decoded", codec(vocabulary, pattern).decode(ids))

    return map_arrow(encoded, fn, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): encode, then decode the ids, in one Python stage."""
    rows, schema = _rows(docs, id_col, text_col)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary, pattern)
        ids = own.encode(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, own.decode(ids)], [id_col, "ids", "decoded"])

    return map_arrow(rows, fn, f"{schema}, decoded binary")
