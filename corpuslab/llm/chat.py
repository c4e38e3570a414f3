"""Operator 12: chat formatting in budgeted windows.

A conversation becomes windows of at most ``budget`` tokens, each cut between turns. With the
prefix sums of the turns' tokens, a window's history begins at the first turn from which what
was there before the window takes at most ``history`` tokens (and 8 bytes for each of these), and
the window ends after the last turn that fits. The conversation's system turn (its first turn, if its role is
``system``) stands at the front of every window. The loss mask covers the assistant texts of a
window's new turns; what a window repeats has been a target before and is masked. A turn that alone exceeds the
budget makes a window of its own (``over_budget``); nothing is cut or left out.

Template: a window starts with ``<s>``; turns are ``[SYS]text[/SYS]``, ``[INST]text[/INST]``,
``[OUT]text</s>`` (assistant) and ``[ROLE]role[/ROLE]text[END]`` for any other role. Inside texts
and roles each control string gets one backslash after its first character (``<\\/s>``), and one
that has backslashes there already gets one more, so that ``unescape`` gives every text back.

On Spark, turns are dealt out by conversation, sorted, and formatted in a stream that holds one
segment: a window never goes on over a multiple of ``segment`` bytes of its conversation, which bounds
memory. A conversation with more than 1 / HOT of all bytes is cut at such multiples into chunks of 1 / CHUNKS of all bytes,
dealt out each on its own together with the turns before it that may be history. The chunks' first turns
come from prefix sums over (turn, bytes) alone; there are at most HOT + CHUNKS of them, which
bounds the broadcast table. So texts are shuffled once, whatever a conversation's length.

Defined cases: null text is empty, null role is the empty role; turns without a number come last, turns with the
same number lie in the order of a hash of role and text, repeated rows are turns of their own; rows without an id
form one conversation; an empty table gives no windows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import HOT, running
from . import bpe
from .common import by_bytes, release

BUDGET, HISTORY, SEGMENT, CHUNKS = 4096, 1024, 1 << 20, 4096
HISTORY_BYTES = 8  # for each token of ``history``
SYSTEM, LOSS = "system", "assistant"
START = "<s>"
MARKS = {SYSTEM: ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), LOSS: ("[OUT]", "</s>")}
ROLE, ROLE_END, END = "[ROLE]", "[/ROLE]", "[END]"
_CONTROL = r"(?:s>|/s>|(?:/?(?:SYS|INST|ROLE)|OUT|END)\])"
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})"), re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_TURN = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|\[OUT\](?P<assistant>.*?)</s>"
                   r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[END\]", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its text begins and ends."""
    before, after = MARKS.get(role) or (ROLE + escape(role) + ROLE_END, END)
    inside = escape(text)
    return before + inside + after, len(before), len(before) + len(inside)


def parse(window: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a window."""
    if not window.startswith(START):
        raise ValueError("not a window")
    out, at = [], len(START)
    for m in _TURN.finditer(window, at):
        if m.start() != at:
            raise ValueError(f"unmarked text at {at}")
        at = m.end()
        if m["role"] is not None:
            out.append((unescape(m["role"]), unescape(m["text"])))
        else:
            out.append((m.lastgroup, unescape(m[m.lastgroup])))
    if at != len(window):
        raise ValueError(f"unmarked text at {at}")
    return out


def spans(tokens: np.ndarray, size: np.ndarray, first: int, front: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """Windows over turns: (first repeated, first new, end). New turns begin at ``first``; ``front``: tokens before every window's turns."""
    t, b = np.concatenate([[0], np.cumsum(tokens)]), np.concatenate([[0], np.cumsum(size)])
    out, a = [], first
    while a < len(tokens):
        room = min(history, budget - front - int(tokens[a]))
        h = max(int(np.searchsorted(t, t[a] - room)), int(np.searchsorted(b, b[a] - history * HISTORY_BYTES))) if room > 0 else a
        h = min(h, a)
        end = max(a + 1, int(np.searchsorted(t, t[h] + budget - front, "right")) - 1)
        out.append((h, a, end))
        a = end
    return out


@dataclass
class Turn:
    text: str
    loss: tuple[int, int] | None
    tokens: int
    size: int  # bytes of the unmarked turn


@dataclass
class Formatter:
    """The windows of one conversation or chunk after the other, from turns in their order."""

    count: object  # tokens of a string
    budget: int
    history: int
    segment: int
    front: int = 0
    system: Turn | None = None
    before: list[Turn] = field(default_factory=list)  # may be history
    own: list[Turn] = field(default_factory=list)
    bytes_before: int = 0
    number: int = 0
    first_is_system: bool = False

    def begin(self, bytes_before: int) -> None:
        self.system, self.before, self.own, self.bytes_before, self.number, self.first_is_system = None, [], [], bytes_before, 0, False

    def turn(self, role: str, text: str, size: int) -> Turn:
        marked, a, b = format_turn(role, text)
        return Turn(marked, (a, b) if role == LOSS else None, self.count(marked), size)

    def add(self, turn: Turn, is_system: bool) -> Iterator[tuple]:
        if self.own and self.bytes_before // self.segment != (self.bytes_before - self.own[-1].size) // self.segment:
            yield from self.flush()
        if is_system:
            self.system, self.first_is_system = turn, True
        self.own.append(turn)
        self.bytes_before += turn.size

    def flush(self) -> Iterator[tuple]:
        own, new_system = self.own, self.first_is_system
        if new_system:
            own = own[1:]
        turns = self.before + own
        cut = spans(np.array([t.tokens for t in turns], np.int64), np.array([t.size for t in turns], np.int64), len(self.before),
                    self.front + (self.system.tokens if self.system else 0), self.budget, self.history)
        for h, a, end in cut or ([(0, 0, 0)] if new_system else []):
            head = [self.system] if self.system else []
            yield self.window(head + turns[h:end], (0 if new_system else len(head)) + a - h)
            new_system = False
        self.own, self.first_is_system = [], False
        kept, size = [], 0
        for t in reversed(turns):
            size += t.size
            if size > self.history * HISTORY_BYTES:
                break
            kept.append(t)
        self.before = kept[::-1]

    def window(self, turns: list[Turn], repeated: int) -> tuple:
        at, mask = len(START), []
        for k, t in enumerate(turns):
            if k >= repeated and t.loss:
                mask.append({"start": at + t.loss[0], "end": at + t.loss[1]})
            at += len(t.text)
        n = self.front + sum(t.tokens for t in turns)
        self.number += 1
        return self.number - 1, START + "".join(t.text for t in turns), mask, repeated, len(turns) - repeated, n, n > self.budget


def _sized(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    d = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    return d.select("id", F.struct(F.col("turn").isNull().alias("no"), "turn", F.xxhash64("role", "text").alias("h")).alias("key"), "role", "text",
                    (F.octet_length("text") + F.octet_length("role")).cast("long").alias("size"))


def _cuts(rows: DataFrame, segment: int, history: int) -> DataFrame:
    """(id, cuts): for each hot conversation its first key and its chunks (first key, first key that may be history, bytes before)."""
    per = rows.groupBy("id").agg(F.sum("size").alias("bytes"))
    total = per.agg(F.sum("bytes")).first()[0] or 0
    step = -(-max(total // CHUNKS, segment) // segment) * segment
    hot = per.where((F.col("bytes") * HOT > total) & (F.col("bytes") > segment)).select(F.col("id").alias("_x_id0"))
    same = F.col("id").eqNullSafe(F.col("_x_id0"))
    keys = rows.select("id", "key", "size").join(F.broadcast(hot), same, "left_semi").groupBy("id", "key").agg(F.sum("size").alias("size"))
    named = F.concat(F.when(F.col("id").isNull(), "-").otherwise("="), F.coalesce(F.col("id").cast("string"), F.lit("")))
    placed = running(keys.withColumn("conv", named), "conv", [F.col("key")], "size", "chat-sizes")
    placed = placed.withColumn("chunk", F.floor(F.col("before") / step))
    starts = placed.groupBy("conv", "chunk").agg(F.min("key").alias("key"), F.min("before").alias("before"), F.min("id").alias("id"))  # at most HOT + CHUNKS
    nxt = starts.select("conv", "chunk", F.lead("before").over(Window.partitionBy("conv").orderBy("chunk")).alias("next"),
                        F.lead("chunk").over(Window.partitionBy("conv").orderBy("chunk")).alias("to")).where("next is not null")
    tail = placed.join(F.broadcast(nxt), ["conv", "chunk"]).where(F.col("before") >= F.col("next") - history * HISTORY_BYTES)
    tail = tail.groupBy("conv", F.col("to").alias("chunk")).agg(F.min("key").alias("tail"))
    cut = starts.join(F.broadcast(tail), ["conv", "chunk"], "left")
    cuts = F.array_sort(F.collect_list(F.struct("chunk", "key", F.coalesce("tail", "key").alias("tail"), "before")))
    return cut.groupBy("conv").agg(F.min("id").alias("_x_id0"), cuts.alias("cuts")).drop("conv")


OWN, TAIL, FRONT = 2, 1, 0  # a chunk's turns, those before it, and the system turn


def windows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT, rank_file: str = bpe.DEFAULT_RANKS) -> DataFrame:
    """A row per window: the id, chunk, window, ``text``, ``loss`` (start, end in code points), ``repeated`` turns in front, new turns, tokens, over_budget.

    ``chunks`` is the number of chunks of the conversation. Rows of one chunk lie one after the other in their order.
    """
    if history * HISTORY_BYTES > segment:
        raise ValueError("the history must be shorter than a segment")
    with open(rank_file, "rb") as f:
        shared = turns.sparkSession.sparkContext.broadcast(f.read())
    rows = _sized(turns, id_col, turn_col, role_col, text_col)
    d = rows.join(F.broadcast(_cuts(rows, segment, history)), F.col("id").eqNullSafe(F.col("_x_id0")), "left").drop("_x_id0")
    one = "array(named_struct('chunk', 0, 'kind', 2, 'bytes', 0L))"
    at = "greatest(size(filter(cuts, c -> c.key <= key)), 1) - 1"
    own = f"array(named_struct('chunk', {at}, 'kind', 2, 'bytes', cuts[{at}].before))"
    tail = ("transform(filter(sequence(0, size(cuts) - 1), j -> key < cuts[j].key and key >= cuts[j].tail), "
            "j -> named_struct('chunk', j, 'kind', 1, 'bytes', cuts[j].before))")
    front = (f"if(role = '{SYSTEM}' and key = cuts[0].key and size(cuts) > 1, transform(sequence(1, size(cuts) - 1), "
             "j -> named_struct('chunk', j, 'kind', 0, 'bytes', cuts[j].before)), array())")
    d = d.withColumn("to", F.explode(F.expr(f"if(cuts is null, {one}, concat({own}, {tail}, {front}))")))
    d = d.select("id", F.col("to.chunk").alias("chunk"), F.coalesce(F.size("cuts"), F.lit(1)).alias("chunks"), F.col("to.kind").alias("kind"),
                 F.col("to.bytes").alias("before"), "key", "role", "text", "size").withColumn("chunks", F.greatest("chunks", F.lit(1)))
    d = d.repartition("id", "chunk").sortWithinPartitions("id", "chunk", "kind", "key", "role", "text").drop("key")
    schema = T.StructType([T.StructField(id_col, turns.schema[id_col].dataType), *T.StructType.fromDDL(
        "chunk int, chunks int, window int, text string, loss array<struct<start:int,end:int>>, repeated int, turns int, tokens long, over_budget boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(shared.value)
        count = lambda s: len(bpe.encode_text(enc, s))
        f = Formatter(count, budget, history, segment, front=count(START))
        at, out, first = None, [], True
        kinds = {"loss": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "tokens": pa.int64(), "text": pa.string(), "over_budget": pa.bool_()}

        def batch_of(made: list, id_type: pa.DataType) -> pa.RecordBatch:
            ids, *rest = zip(*made)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(v, kinds.get(n, pa.int32())) for n, v in zip(schema.names[1:], rest))],
                                              names=schema.names)

        for batch in by_bytes(batches, "text"):
            id_type = batch.schema.field("id").type
            for key, chunk, chunks, kind, before, role, text, size in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if at != (key, chunk, chunks):
                    if at is not None:
                        out += [(*at, *w) for w in f.flush()]
                    at, first = (key, chunk, chunks), True
                    f.begin(before)
                turn = f.turn(role, text, size)
                if kind == OWN:
                    out += [(*at, *w) for w in f.add(turn, first and chunk == 0 and role == SYSTEM)]
                elif kind == TAIL:
                    f.before.append(turn)
                elif f.system is None:
                    f.system = turn
                first = False
            if out:
                yield batch_of(out, id_type)
                out = []
        if at is not None:
            yield batch_of([(*at, *w) for w in f.flush()], id_type)
        release()

    return d.mapInArrow(run, schema)


class Reader:
    """What a conversation's windows, read back one after the other, hold: turns, loss text, characters."""

    def __init__(self) -> None:
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict], repeated: int) -> None:
        for role, inside in parse(text)[repeated:]:
            self.turns += 1
            self.turns_sha.update(f"{role}\n{inside}\n".encode())
        for x in loss:
            inside = unescape(text[x["start"]:x["end"]])
            self.loss_chars += len(inside)
            self.loss_sha.update(inside.encode())
        self.chars += len(text)

    def result(self) -> tuple:
        return self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    One chunk's windows are read where they were made. Those of a hot conversation meet in
    one stream, chunk after chunk, as a digest of its whole text takes its bytes in order; the stream holds one batch.
    """
    digests = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kind = formatted.schema[id_col].dataType
    carried = ["chunk", "chunks", "window", "text", "loss", "repeated"]
    both = T.StructType([T.StructField(id_col, kind), *[formatted.schema[c] for c in carried], *T.StructType.fromDDL(digests)])
    final = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL(digests)])

    def read(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        at, reader, out, id_type, loss_type = None, None, [], None, None

        def batch_of(made: list) -> pa.RecordBatch:
            cols = list(zip(*made))
            names = final.names if last else both.names
            types = {id_col: id_type, "loss": loss_type, "text": pa.string(), "turns_sha256": pa.string(), "loss_sha256": pa.string(),
                     **dict.fromkeys(("chunk", "chunks", "window", "repeated"), pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.int64())) for n, v in zip(names, cols)], names=names)

        def done() -> tuple:
            return (at, *reader.result()) if last else (at, 0, 1, 0, None, None, None, *reader.result())

        for batch in by_bytes(batches, "text"):
            id_type, loss_type = batch.schema.field(id_col).type, batch.schema.field("loss").type
            for row in batch.select([id_col, *carried, *([x for x in final.names[1:]] if last else [])]).to_pylist():
                key = row[id_col]
                if last and row["text"] is None:  # read before
                    out.append(tuple(row[c] for c in final.names))
                elif not last and row["chunks"] > 1:
                    out.append((key, *(row[c] for c in carried), *[None] * 5))
                else:
                    if reader is None or at != key:
                        if reader is not None:
                            out.append(done())
                        at, reader = key, Reader()
                    reader.add(row["text"], row["loss"], row["repeated"])
            if out:
                yield batch_of(out)
                out = []
        if reader is not None:
            yield batch_of([done()])
        release()

    once = formatted.select(id_col, *carried).mapInArrow(lambda b: read(b, False), both)
    dealt = once.repartition(F.col(id_col)).sortWithinPartitions(id_col, "chunk", "window")
    return dealt.mapInArrow(lambda b: read(b, True), final)
