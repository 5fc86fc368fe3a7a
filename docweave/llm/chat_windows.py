"""Conversations as training windows of a token budget.

Turns are formatted by a template and their tokens counted. Prefix sums of the tokens, the leading
system turn left out, cut a conversation at turns: a turn goes to the span in which it starts, of
three quarters of the room that the system turn and the history leave in the budget; one that goes over the span's end by
more than the last quarter holds is a window of its own. A window repeats the system turn and as many of the turns before it
as lie within the history's tokens, and its loss mask is the texts of its own assistant turns, so
each is learnt once. The room is at least a quarter of the budget. So every window is within the budget, but for two
kinds, which are marked as over: a single turn that is larger than the room, and windows of a system turn that leaves less than that quarter.

A conversation is put together by one stream of its turns, which keeps one window and the history. One with more than
hot_turns turns and over 1/512 of all turns is cut in parts instead: its turns are sorted by ranges, sums of the ranges
before are added to a range's own, each turn goes to its window and to those that may repeat it, and windows
are put together one by one; the windows are the same.

The template: <s>, then [SYS] text [/SYS], [INST] text [/INST], or a space, text and </s> for an assistant;
[ROLE] role [NAME] text [/ROLE] for other roles. In texts and roles a backslash goes into whatever looks like
one of these marks, also with backslashes in it already, so no mark can come from a text and taking one away gives it back.

Defined results: null text and null roles count as empty, null turns come first and a null conv_id is one
conversation. Turns of equal number go by role, then by a hash of the text; equal rows are turns of their own. A system
turn that isn't the first is like any other. A conversation of a system turn alone is a window without loss. Texts of any length are
formatted whole. An empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.columnar import BLOCK, blocks
from docweave.llm.packing import segment_tokenizer
from docweave.llm.storage import HEAVY, materialise, partitions_of

BUDGET, HISTORY, HOT_TURNS = 2048, 256, 10_000
BEGIN = "<s>"
#: Around the text of a turn.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
_CONTROL = r"(?=/?(?:s>|INST\]|SYS\]|ROLE\]|NAME\]))"
_ESCAPE, _UNESCAPE = re.compile(r"([<\[]\\*)" + _CONTROL), re.compile(r"([<\[]\\*)\\" + _CONTROL)


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends."""
    before, after = MARKS.get(role) or (f"[ROLE] {escaped(role)} [NAME] ", " [/ROLE]")
    own = escaped(text)
    return f"{before}{own}{after}", len(before), len(before) + len(own)


def turns_of(window: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    at = len(BEGIN)
    while at < len(window):
        for role, (before, after) in MARKS.items():
            if window.startswith(before, at):
                end = window.index(after.strip(), at + len(before)) - len(after) + len(after.strip())
                yield role, unescaped(window[at + len(before) : end])
                at = end + len(after)
                break
        else:
            name = window.index("[NAME]", at)
            end = window.index("[/ROLE]", name)
            yield unescaped(window[at + 7 : name - 1]), unescaped(window[name + 7 : end - 1])
            at = end + 7


@dataclass
class Cuts:
    """Where a conversation's windows are cut, by the tokens before a turn."""

    budget: int
    history: int
    system: int = 0
    room: int = field(init=False)
    span: int = field(init=False)

    def __post_init__(self):
        self.room = max(self.budget - self.system - self.history, self.budget // 4)
        self.span = max(self.room * 3 // 4, 1)

    def window(self, start: int, tokens: int) -> int:
        """Numbers ascend with the turns, but not without gaps."""
        span = start // self.span
        return 2 * span + (start + tokens > (span + 1) * self.span and tokens > self.room - self.span)


@dataclass
class Turn:
    role: str
    text: str
    begin: int
    end: int
    tokens: int
    start: int = 0


def assembled(conv_id: int | None, number: int, system: Turn | None, before: Iterable[Turn], own: list[Turn], cuts: Cuts) -> tuple:
    """A window's row. The first window's system turn is its own, later ones repeat it."""
    first = not own or own[0].start == 0
    before = [t for t in before if own and t.start >= own[0].start - cuts.history]
    shown = [system] * (system is not None) + before + own
    repeated = len(shown) - len(own) - (first and system is not None)
    out, size, loss = [BEGIN], len(BEGIN), []
    for k, turn in enumerate(shown):
        if turn.role == "assistant" and k >= repeated:
            loss.append({"start": size + turn.begin, "end": size + turn.end})
        out.append(turn.text)
        size += len(turn.text)
    tokens = sum(t.tokens for t in shown)
    return conv_id, number, "".join(out), repeated, len(shown) - repeated, tokens, tokens > cuts.budget, loss


WINDOWS = "conv_id long, window long, formatted string, n_repeated int, n_own int, n_tokens long, over boolean, loss array<struct<start: long, end: long>>"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
_NAMES = [c.split()[0] for c in re.split(r", (?![^<]*>)", WINDOWS)]


def batches_of(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of windows in batches of bounded bytes."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], names=_NAMES)

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > BLOCK:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def counted_turns(batches: Iterator[pa.RecordBatch], tokenizer_path: str, pattern: str) -> Iterator[tuple[int | None, Turn]]:
    """The turns of batches of (conv_id, role, text), formatted and counted a block at a time."""
    own = segment_tokenizer(tokenizer_path, pattern)
    for batch in batches:
        for a, b, _, _ in blocks(batch.column("text")):
            some = batch.slice(a, b - a)
            made = [formatted(r, t) for r, t in zip(some.column("role").to_pylist(), some.column("text").to_pylist(), strict=True)]
            tokens: list[int] = []
            for _, _, data, offsets in blocks(pa.array([t for t, _, _ in made], pa.large_string())):
                tokens += np.maximum(np.diff(own.encode_block(data, offsets)[1]), 1).tolist()
            for conv_id, role, (text, begin, end), n in zip(some.column("conv_id").to_pylist(), some.column("role").to_pylist(), made, tokens, strict=True):
                yield conv_id, Turn(role, text, begin, end, n)


def streamed(turns: Iterator[tuple[int | None, Turn]], budget: int, history: int) -> Iterator[tuple]:
    """Windows of turns that come in order, conversation by conversation; holds one window and the history."""
    conv_id, begun = None, False
    system: Turn | None = None
    cuts = Cuts(budget, history)
    own: list[Turn] = []
    past: deque[Turn] = deque()
    total = number = 0

    def done() -> Iterator[tuple]:
        if begun and (own or system):
            yield assembled(conv_id, number, system, past, own, cuts)

    for key, turn in turns:
        if not begun or key != conv_id:
            yield from done()
            conv_id, begun, system, own, total, number = key, True, None, [], 0, 0
            past.clear()
            if turn.role == "system":
                system = turn
                cuts = Cuts(budget, history, turn.tokens)
                continue
            cuts = Cuts(budget, history)
        turn.start = total
        to = cuts.window(total, turn.tokens)
        if own and to != number:
            yield from done()
            past.extend(own)
            own = []
        number = to
        if not own:  # the history of a window is fixed by its first turn
            while past and past[0].start < total - history:
                past.popleft()
        own.append(turn)
        total += turn.tokens
    yield from done()


def plain_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), text.alias("text"), F.xxhash64(text).alias("h"))


ORDER = ["conv_id", "turn", "role", "h", "text"]


def hot_conversations(turns: DataFrame, hot_turns: int) -> list[int | None]:
    """Those with more than hot_turns turns and over 1 / HEAVY of all turns: at most HEAVY."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_turns)
    large = materialise(sizes, "large-conversations")
    if large.isEmpty():
        return []
    total = turns.select("conv_id").count()
    return [r.conv_id for r in large.where(F.col("n") > total // HEAVY).collect()]


def cold_windows(turns: DataFrame, tokenizer_path: str, pattern: str, budget: int, history: int) -> DataFrame:
    """Windows of conversations that fit a task's stream; those of one are together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(streamed(counted_turns(batches, tokenizer_path, pattern), budget, history))

    return turns.repartition(F.col("conv_id")).sortWithinPartitions(*ORDER).select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


_PART = "conv_id long, role string, formatted string, begin long, end long, tokens long, part int, at long"


def hot_windows(turns: DataFrame, tokenizer_path: str, pattern: str, budget: int, history: int) -> DataFrame:
    """Windows of conversations that are larger than a task's share."""
    names = [c.split()[0] for c in _PART.split(", ")]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv_id, total = TaskContext.get().partitionId(), None, 0
        begun, held, size = False, [], 0
        for key, t in counted_turns(batches, tokenizer_path, pattern):
            if not begun or key != conv_id:
                begun, conv_id, total = True, key, 0
            held.append((key, t.role, t.text, t.begin, t.end, t.tokens, part, total))
            total += t.tokens
            size += len(t.text)
            if size > BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    # the place of a row in a written table tells equal rows apart, so that they too can go to several ranges
    placed = materialise(turns.withColumn("nth", F.monotonically_increasing_id()), "hot-turns")
    ranges = placed.repartitionByRange(partitions_of(turns.sparkSession), "conv_id", "turn", "role", "h", "nth").sortWithinPartitions("conv_id", "turn", "role", "h", "text", "nth")
    rows = materialise(ranges.select("conv_id", "role", "text").mapInArrow(local, _PART), "hot-parts")

    # a line for each conversation in each range: at most ranges + conversations
    sums = rows.groupBy("conv_id", "part").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = materialise(sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry")), "hot-carries")
    rows = rows.join(F.broadcast(carry), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("at", F.col("at") + F.col("carry"))
    leads = (F.col("at") == 0) & (F.col("role") == "system")
    systems = rows.where(leads)
    system_tokens = materialise(systems.select(F.col("conv_id").alias("c"), F.col("tokens").alias("system")), "hot-systems")  # at most HEAVY lines

    others = rows.where(~leads).drop("c").join(F.broadcast(system_tokens), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    system = F.coalesce("system", F.lit(0))
    room = F.greatest(F.lit(budget) - system - history, F.lit(budget // 4))
    span = F.greatest(F.expr("room * 3 div 4"), F.lit(1))
    start, tokens = F.col("at") - F.col("system_or_0"), F.col("tokens")
    others = others.withColumn("system_or_0", system).withColumn("room", room).withColumn("span", span).withColumn("start", start)
    nth = F.expr("start div span")
    over = (F.col("start") + tokens > (nth + 1) * F.col("span")) & (tokens > F.col("room") - F.col("span"))
    base = ["conv_id", "role", "formatted", "begin", "end", "tokens", "start", "system_or_0"]
    others = others.withColumn("window", 2 * nth + over.cast("long")).select(*base, "window", F.expr("(start + tokens) div span").alias("next"), F.expr(f"(start + {history}) div span").alias("last"))
    own = others.select(*base, "window", F.lit(2).alias("kind"))
    # a turn may be repeated by the windows that begin between its end and its reach; there are at most two spans of them
    reach = F.flatten(F.transform(F.sequence("next", "last"), lambda k: F.array(2 * k, 2 * k + 1)))
    again = others.where("next <= last").select(*base, F.col("window").alias("of"), F.explode(reach).alias("to")).where("to > of")
    again = again.select(*base, F.col("to").alias("window"), F.lit(1).alias("kind"))
    windows = own.select(F.col("conv_id").alias("c"), "window").distinct()
    system_rows = systems.drop("c").join(windows, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "role", "formatted", "begin", "end", "tokens", F.lit(0).cast("long").alias("start"), F.col("tokens").alias("system_or_0"), "window", F.lit(0).alias("kind"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            key, system, past, mine = None, None, [], []
            for batch in batches:
                for r in batch.to_pylist():
                    if key is None or key != (r["conv_id"], r["window"]):
                        if mine:
                            yield assembled(*key, system, past, mine, cuts)
                        key, system, past, mine = (r["conv_id"], r["window"]), None, [], []
                        cuts = Cuts(budget, history, r["system_or_0"])
                    turn = Turn(r["role"], r["formatted"], r["begin"], r["end"], r["tokens"], r["start"])
                    if r["kind"] == 0:
                        system = turn
                    else:
                        (past, mine)[r["kind"] - 1].append(turn)
            if mine:
                yield assembled(*key, system, past, mine, cuts)

        yield from batches_of(made())

    every = own.unionByName(again).unionByName(system_rows)
    grouped = every.repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "kind", "start")
    return grouped.mapInArrow(assemble, WINDOWS)


def both_kinds(turns: DataFrame, tokenizer_path: str, pattern: str, budget: int, history: int, hot_turns: int) -> tuple[DataFrame, DataFrame | None]:
    hot = hot_conversations(turns, hot_turns)
    if not hot:
        return cold_windows(turns, tokenizer_path, pattern, budget, history), None
    known = F.coalesce(F.col("conv_id").isin([c for c in hot if c is not None]), F.lit(None in hot))
    return cold_windows(turns.where(~known), tokenizer_path, pattern, budget, history), hot_windows(turns.where(known), tokenizer_path, pattern, budget, history)


def format_conversations(
    turns: DataFrame, tokenizer_path: str, pattern: str, budget: int = BUDGET, history: int = HISTORY, hot_turns: int = HOT_TURNS,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row for each window: conv_id, window, formatted, n_repeated, n_own, n_tokens, over, loss (places in formatted, in code points)."""
    cold, hot = both_kinds(plain_turns(turns, conv_col, turn_col, role_col, text_col), tokenizer_path, pattern, budget, history, hot_turns)
    return cold if hot is None else cold.unionByName(hot)


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame, together: bool = False) -> DataFrame:
    """What the windows of each conversation say: its own turns and the text under its loss masks, read from formatted alone.

    A digest goes over a conversation in order, so one stream reads it, a window at a time. together tells that a conversation's windows
    are in one partition and in order, as they come from one stream of its turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in REPORT.split(", ")]
        state: tuple | None = None

        def row() -> tuple:
            key, n, turns, chars, loss, size, count = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), size, count

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key, text, repeated, masks = (batch.column(c)[i].as_py() for c in ("conv_id", "formatted", "n_repeated", "loss"))
                if state is None or state[0] != key:
                    if state is not None:
                        out.append(row())
                    state = key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0
                _, n, turns, chars, loss, size, count = state
                for k, (role, said) in enumerate(turns_of(text)):
                    if k >= repeated:
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                for m in masks:
                    said = unescaped(text[m["start"] : m["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                state = key, n, turns, chars, loss, size + len(text), count + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name.endswith("sha256") else pa.int64()) for c, name in zip(zip(*out, strict=True), names, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string() if name.endswith("sha256") else pa.int64()) for c, name in zip(row(), names, strict=True)], names=names)

    ordered = windows if together else windows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, REPORT)


def chat_report(turns: DataFrame, tokenizer_path: str, pattern: str, budget: int = BUDGET, history: int = HISTORY, hot_turns: int = HOT_TURNS) -> DataFrame:
    """format_conversations, read back: one row for each conversation."""
    cold, hot = both_kinds(plain_turns(turns, "conv_id", "turn", "role", "text"), tokenizer_path, pattern, budget, history, hot_turns)
    report = read_back(cold, together=True)
    return report if hot is None else report.unionByName(read_back(hot))
