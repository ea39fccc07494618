"""Conversation structure repair by a rank-convergence parallel Viterbi (operator 12).

A conversation's rows, by turn, are edited at the least cost so that their role initials read ``(s?(ua)+)?``: keep a row
(0), give it the role user or assistant (1), delete it (2; required for blank and repeated rows), insert an empty user or
assistant row (5); an undeleted truncated row costs 5 more. Of the cheapest edits the ASCII-least string of their initials
(D, I, K, R) is the *audit*.

Rows are sorted by range over all tasks, which gives each a *place*; ``2 ** CHUNK_BITS`` places of a conversation are one *chunk*,
a string with one character a row (role initial and first fault). What is left to pay before a row, from each of four
states, is a vector of four costs. Every chunk starts from a speculative vector at its end and works backwards. Then
fix-up passes hand each chunk the vector of the chunk after it; where that differs by more than a constant from what the
chunk has assumed, it is run again, but only back to the first mark where its vectors differ from the earlier run's by a
constant. No pass is left when no chunk is to be run again. The vectors so stitched drive the trace: forwards, the least
letter that still leads to the least cost. A chunk is traced from each of the four states it may be entered in; the
same fix-up passes then find the state that it is entered in. Conversations of one chunk need no pass.

Whether a role and text were seen earlier is an aggregate by conversation, role and digest (partial sums first), joined
by place. Texts are shuffled when they are sorted, and once with the audits. No group has to fit a task: windows run over
chunks; only a digest of a whole conversation, which is sequential, streams through one task.

Cases: null texts and roles read as one space; a null conversation is one of its own; null turns come first. Rows of one
turn come by role, then by the first ``PREFIX`` characters of the text, then by its SHA-256. Rows that repeat are
duplicates. A role without a first character, or with one other than s, u, a, can only be deleted or given another role.
A conversation without rows has no edits, cost 0 and no repaired rows. Columns other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow, written

#: A chunk has 2 ** CHUNK_BITS rows at most.
CHUNK_BITS = 14
PREFIX = 64
#: Rows between two marks of a chunk, where a rerun looks for convergence.
MARK = 256
SPACES = " \t\n\v\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing given yet, after a system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or rerolled row leads to, from each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Left to pay after the last row: what has to be inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: Role initials, by number; 3 is any other. Faults, by number.
INITIALS = "sua"
SOUND, CUT, BLANK, REPEATED = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _keeps(state: int, initial: int) -> int | None:
    """State after a kept row of this initial, if it may follow."""
    if initial == 0:
        return SYSTEM if state == EMPTY else None
    if initial == 1:
        return None if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else None


def _edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row."""
    initial, fault = divmod(symbol, 4)
    out = [("D", DELETE, state)]
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        kept = _keeps(state, initial)
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", more + REROLE, NEXT[state]))
    return out


EDITS = [[_edits(state, symbol) for symbol in range(16)] for state in range(4)]


def before(vector: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, less their least, and that least."""
    row = [min(cost + vector[to] for _, cost, to in EDITS[q][symbol]) for q in range(4)]
    once = [min(row[q], INSERT + row[NEXT[q]]) for q in range(4)]
    out = [min(once[q], INSERT + once[NEXT[q]]) for q in range(4)]
    least = min(out)
    return tuple(v - least for v in out), least


class Backward:
    """Backward runs; steps between vectors are remembered, there are few different ones."""

    def __init__(self) -> None:
        self.step: dict[tuple, tuple] = {}

    def vectors(self, symbols: str, end: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int]]:
        """(vector, gained) before each row, from the last to the first."""
        gained = 0
        for symbol in reversed(symbols):
            key = (end, symbol)
            if key not in self.step:
                self.step[key] = before(end, int(symbol, 16))
            end, more = self.step[key]
            gained += more
            yield end, gained

    def run(self, symbols: str, end: tuple[int, ...], marks: np.ndarray | None = None, gained: int = 0) -> tuple[tuple[int, ...], int, np.ndarray]:
        """(start vector, gained, marks) of a chunk; given marks of an earlier run, only as far as they differ by a constant."""
        out = np.zeros((len(symbols) // MARK, 5), np.int64)
        vector, total = end, 0
        for n, (vector, total) in enumerate(self.vectors(symbols, end), 1):
            if n % MARK == 0:
                at = n // MARK - 1
                if marks is not None and tuple(marks[at, :4].tolist()) == vector:
                    # From here on every vector is the earlier one, and all totals differ by the same.
                    shift = total - int(marks[at, 4])
                    out[at:] = marks[at:]
                    out[at:, 4] += shift
                    return None, gained + shift, out
                out[at] = *vector, total
        return vector, total, out

    def trace(self, symbols: str, end: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
        """Least letters of the cheapest edits from a state at a chunk's start, and the state at its end."""
        after = [end, *(v for v, _ in self.vectors(symbols, end))]
        after.reverse()
        out = []
        for k, symbol in enumerate(symbols):
            row = [min(cost + after[k + 1][to] for _, cost, to in EDITS[q][int(symbol, 16)]) for q in range(4)]
            while True:
                rest = min(row[state], INSERT + row[NEXT[state]], 2 * INSERT + row[NEXT[NEXT[state]]])
                letters = [(letter, to) for letter, cost, to in EDITS[state][int(symbol, 16)] if cost + after[k + 1][to] == rest]
                if rest == min(INSERT + row[NEXT[state]], 2 * INSERT + row[NEXT[NEXT[state]]]):
                    letters.append(("I", NEXT[state]))
                letter, state = min(letters)
                out.append(letter)
                if letter != "I":
                    break
        while last and END[state]:
            out.append("I")
            state = NEXT[state]
        return "".join(out), state


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults by a checksum of conversation and turn: dropped, emptied, without stops, repeated, role user."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    fault = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    ).drop("__copy")


def _key() -> Column:
    """A conversation's key that is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


def placed(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(conv, conv_id, turn, role, text, place, chunk), written: places ascend in each conversation by turn."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    keyed = rows.select(_key(), "conv_id", "turn", role, text, F.monotonically_increasing_id().alias("__row"))
    order = ["conv", F.asc_nulls_first("turn"), "role", F.substring("text", 1, PREFIX), F.sha2("text", 256), "__row"]
    in_order = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    place = in_order.select("conv", "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place"))
    return written(place.withColumn("chunk", F.shiftright("place", chunk_bits)), "turns")


def chunked(rows: DataFrame) -> DataFrame:
    """(conv, chunk, place, symbols, next, after): a string for each chunk; the next chunk and its first symbol, if any."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    own = rows.select("conv", "chunk", "place", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"))
    firsts = own.filter(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    faults = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), REPEATED).when(~F.col("ended"), CUT).otherwise(SOUND)
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    marked = own.drop("role", "digest").join(firsts, "place", "left").select("conv", "chunk", "place", F.lower(F.hex(initial * 4 + faults)).alias("symbol"))
    strings = marked.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "symbol"))).alias("own"))
    by_chunk = Window.partitionBy("conv").orderBy("chunk")
    strings = strings.select("conv", "chunk", F.col("own")[0]["place"].alias("place"), F.array_join("own.symbol", "").alias("symbols"))
    return written(
        strings.select("*", F.lead("chunk").over(by_chunk).alias("next"), F.lead(F.substring("symbols", 1, 1)).over(by_chunk).alias("after"), F.lag("chunk").over(by_chunk).isNull().alias("first")),
        "chunks",
    )


_STATE = "conv string, chunk long, place long, symbols string, next long, after string, first boolean"
_VECTORS = "end array<int>, start array<int>, gained long, marks binary"


def _rows(batch: pa.RecordBatch) -> list[dict]:
    return batch.to_pylist()


def _made(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _each(df: DataFrame, make: Callable[[Backward, dict], dict], schema: str) -> DataFrame:
    """Rows of df with what make adds to them, as schema says."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(", ")]
    kinds = pa.schema([(n, _ARROW[t]) for n, t in fields])
    worker: list[Backward] = []

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not worker:
            worker.append(Backward())
        return _made([{**r, **make(worker[0], r)} for r in _rows(batch)], kinds)

    return map_arrow(df, fn, schema)


def _first_run(costs: Backward, r: dict) -> dict:
    """A run from the vector of a conversation's end, speculative unless it is the last chunk."""
    start, gained, marks = costs.run(r["symbols"], END)
    return {"end": list(END), "start": list(start), "gained": gained, "marks": marks.tobytes()}


def _run_again(costs: Backward, r: dict) -> dict:
    marks = np.frombuffer(r["marks"], np.int64).reshape(-1, 5)
    start, gained, marks = costs.run(r["symbols"], tuple(r["now"]), marks, r["gained"])
    return {"end": r["now"], "start": list(start) if start is not None else r["start"], "gained": gained, "marks": marks.tobytes()}


def stitched(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Chunks with the true vector at each end, up to a constant, and the number of fix-up passes."""
    runs = written(_each(chunks, _first_run, f"{_STATE}, {_VECTORS}"), "vectors")
    alone = runs.filter("first AND next IS NULL")
    open_to = runs.filter("NOT first OR next IS NOT NULL")
    passes = 0
    if open_to.isEmpty():
        return alone, passes
    while True:
        given = open_to.select("conv", F.col("chunk").alias("next"), F.col("start").alias("now"))
        told = written(open_to.join(given, ["conv", "next"], "left").select(*open_to.columns, "now"), "told")
        wrong = F.col("now").isNotNull() & (F.col("now") != F.col("end"))
        if told.filter(wrong).isEmpty():
            return alone.unionByName(told.drop("now")), passes
        passes += 1
        again = _each(told.filter(wrong), _run_again, f"{_STATE}, {_VECTORS}, now array<int>")
        open_to = written(told.filter(~wrong).unionByName(again).drop("now"), "vectors")


def _traces(costs: Backward, r: dict) -> dict:
    found = {q: costs.trace(r["symbols"], tuple(r["end"]), q, r["next"] is None) for q in ((EMPTY,) if r["first"] else range(4))}
    symbols = [divmod(int(s, 16), 4) for s in r["symbols"] + (r["after"] or "")]
    faults = [f for _, f in symbols[: len(r["symbols"])]]
    pairs = zip(symbols, symbols[1:])
    return {
        "audits": [found[q][0] if q in found else None for q in range(4)],
        "exits": [found[q][1] if q in found else None for q in range(4)],
        "blank": faults.count(BLANK),
        "duplicate": faults.count(REPEATED),
        "truncated": faults.count(CUT),
        "illegal": sum((a[0], b[0]) not in LEGAL for a, b in pairs),
        "paid": r["gained"] + (r["start"][EMPTY] if r["first"] else 0),
    }


_TRACED = "audits array<string>, exits array<int>, blank long, duplicate long, truncated long, illegal long, paid long"


def audited(rows: DataFrame) -> DataFrame:
    """(conv, chunk, place, entry, audit, blank, duplicate, truncated, illegal, paid) of each chunk of placed rows, written."""
    vectors, _ = stitched(chunked(rows))
    traced = written(_each(vectors, _traces, f"{_STATE}, {_VECTORS}, {_TRACED}").drop("symbols", "marks", "end", "start", "gained", "after"), "traces")
    steps = traced.select("conv", "chunk", "next", "first", "exits", F.when(F.col("first"), EMPTY).otherwise(ASSISTANT).alias("entry"))
    alone = steps.filter("first AND next IS NULL").select("conv", "chunk", "entry")
    many = steps.filter("NOT first OR next IS NOT NULL")
    while not many.isEmpty():
        came = many.filter("next IS NOT NULL").select("conv", F.col("next").alias("chunk"), F.get("exits", "entry").alias("now"))
        told = written(many.join(came, ["conv", "chunk"], "left"), "entries")
        wrong = F.col("now").isNotNull() & (F.col("now") != F.col("entry"))
        many = told.select(*[c for c in many.columns if c != "entry"], F.coalesce("now", "entry").alias("entry"))
        if told.filter(wrong).isEmpty():
            break
    entries = alone.unionByName(many.select("conv", "chunk", "entry"))
    whole = traced.join(entries, ["conv", "chunk"])
    return written(whole.select("conv", "chunk", "place", "entry", F.get("audits", "entry").alias("audit"), "blank", "duplicate", "truncated", "illegal", "paid"), "audits")


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, str]]:
    """(conv, place, role, text) of repaired rows, from audits and rows in one stream by conversation and place."""
    conv, edits, at, state, place = None, "", 0, EMPTY, 0

    def inserted() -> Iterator[tuple[str, int, str, str]]:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            at, state = at + 1, NEXT[state]
            yield conv, place, "user" if state == USER else "assistant", ""

    for batch in batches:
        for own, here, role, text, entry, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                yield from inserted()
                conv, edits, at, state, place = own, audit, 0, entry, here
                continue
            place = here
            yield from inserted()
            letter, at = edits[at], at + 1
            if letter == "D":
                continue
            if letter == "R":
                state = NEXT[state]
                role = "user" if state == USER else "assistant"
            else:
                state = _keeps(state, INITIALS.find(role[:1]))
            yield conv, place, role, text
    yield from inserted()


def _stream(rows: DataFrame, audits: DataFrame, *keys: str) -> DataFrame:
    """Audits, each before the rows of its chunk, dealt by keys."""
    told = audits.select("conv", "chunk", "place", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "entry", "audit")
    both = told.unionByName(rows.select("conv", "chunk", "place", "role", "text", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("audit")))
    return both.repartition(*keys).sortWithinPartitions("conv", "place", F.desc_nulls_last("audit")).select("conv", "place", "role", "text", "entry", "audit")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, place, step, role, text): repaired rows; place and step order them. Chunks are handled apart."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, last, step = [], 0, None, 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))], ["conv", "place", "step", "role", "text"])

        for conv, place, role, text in _mended(batches):
            step = step + 1 if last == (conv, place) else 0
            last = (conv, place)
            out.append((conv, place, step, role, text))
            size += len(text)
            if len(out) >= 4096 or size > 4_000_000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return _stream(rows, audits, "conv", "chunk").mapInArrow(fn, "conv string, place long, step int, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): of role:text of the repaired rows, joined by newlines; one conversation at a time."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv": [now], "repaired_sha256": [state.hexdigest()]})

        for conv, _, role, text in _mended(batches):
            if conv != now:
                if now is not None:
                    yield told()
                now, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if now is not None:
            yield told()

    return _stream(rows, audits, "conv").mapInArrow(fn, "conv string, repaired_sha256 string")


NOTHING = hashlib.sha256(b"").hexdigest()


def report(rows: DataFrame, all_conversations: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that
    all_conversations (conv_id) names, for rows (conv_id, turn, role, text)."""
    rows = placed(rows, chunk_bits)
    audits = audited(rows)
    turns = rows.groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("n"))
    gaps = turns.select("conv", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = audits.groupBy("conv").agg(*[F.sum(c).alias(c) for c in counts], F.sum("paid").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "audit")))["audit"], "").alias("audit"))
    named = all_conversations.select(_key(), "conv_id").distinct()
    found = named.join(gaps, "conv", "left").join(whole, "conv", "left").join(digests(rows, audits), "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *counts, "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
