r"""Chat formatting in budgeted windows.

A conversation's turns are read in order, and the tokens of their formatted text are summed up from its start; differences of these prefix sums
choose the windows, which are spans of whole turns. A window is the conversation's system turn, then limited history (turns that an
earlier window has, up to a smaller budget), then new turns. Only new assistant texts are under the loss mask, so each is learnt once.

A window has new turns until the next one would overrun the budget. It then ends before that turn, or before the exchange that the
turn belongs to (from the last user turn on) if this one fits a window of its own, so an answer stays with its prompt where it can. History gives way
to new turns. Each window has a new turn that isn't the system turn, unless the conversation has no other; a window is above the budget only
if that is one new turn which doesn't fit beside the system turn. Nothing is cut.

Tokens are counted by the byte-level encoder (bpe.Codec) over the turn as the template writes it; its file of ranks is a parameter.

Template: a window is <s> and its turns, a turn is [INST]role[/INST]text</s>. Inside roles and texts a backslash, < and [
are written \\, \( and \{, so no control string can stand there, and the reverse is exact.

Conversations are dealt by id and sorted by turn; a task streams through its conversations and holds one window at a
time, however long a conversation is. A conversation is one task's work, as its digests are sequential.

Defined cases: null text or role: empty; rows with the same conversation and turn: by role, then text; null turn: first; null conv_id: a
conversation of its own; no turns: no row; empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

BUDGET, HISTORY = 1024, 256
OUT = {"\\": "\\\\", "<": "\\(", "[": "\\{"}
BACK = {"\\": "\\", "(": "<", "{": "["}
NEEDS, ESCAPED = re.compile(r"[\\<\[]"), re.compile(r"\\(.)")
TURN = re.compile(r"\[INST\]([^\[<]*)\[/INST\]([^<]*)</s>")


def escape(text: str) -> str:
    return NEEDS.sub(lambda m: OUT[m[0]], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: BACK[m[1]], text)


def formed(role: str, text: str) -> tuple[str, str]:
    """A turn's head and body as the template writes them; its end is </s>."""
    return f"[INST]{escape(role)}[/INST]", escape(text)


Turn = tuple[str, str]


def window(turns: list[Turn], repeated: int) -> tuple[str, list[tuple[int, int]]]:
    """The formatted window and the spans of its loss mask."""
    parts, at, spans = ["<s>"], 3, []
    for i, (role, text) in enumerate(turns):
        head, body = formed(role, text)
        if role == "assistant" and i >= repeated:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(parts), spans


def windows(turns: Iterator[Turn], tokens: Callable[[str], int], budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple[list[Turn], int]]:
    """Turns of each window and how many of them, at its start, an earlier one has: the system turn, if the first turn is one, and limited history."""
    system: list[Turn] = []
    held: list[Turn] = []  # system turn, history, new turns
    sums = [tokens("<s>")]  # of tokens before each of held, and of all
    repeated = 0

    def take(some: list[Turn], costs: list[int]) -> None:
        for turn, cost in zip(some, costs, strict=True):
            held.append(turn)
            sums.append(sums[-1] + cost)

    for nth, turn in enumerate(turns):
        cost = tokens("".join(formed(*turn)) + "</s>")
        first = max(repeated, len(system))  # the first of held that is new and not the system turn
        if len(held) > first and sums[-1] + cost > budget:
            # Before this turn, or before the exchange that it belongs to, if that leaves turns here and fits a window.
            end = len(held)
            if turn[0] != "user":
                start = next((i for i in range(end - 1, first, -1) if held[i][0] == "user"), end)
                if sums[len(system)] + sums[-1] - sums[start] + cost <= budget:
                    end = start
            yield held[:end], repeated
            moved, costs = held[end:], [b - a for a, b in zip(sums[end:], sums[end + 1 :], strict=False)]
            room = min(history, budget - cost - sums[len(system)] - sum(costs))
            back = end
            while back > len(system) and sums[end] - sums[back - 1] <= room:
                back -= 1
            past, past_costs = held[back:end], [b - a for a, b in zip(sums[back:end], sums[back + 1 : end + 1], strict=True)]
            held, sums = held[: len(system)], sums[: len(system) + 1]
            take(past, past_costs)
            repeated = len(held)
            take(moved, costs)
        take([turn], [cost])
        if nth == 0 and turn[0] == "system":
            system = [turn]
    if len(held) > repeated:
        yield held, repeated


def grouped(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with the same first column, read as they come."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(rows, None)

        own = run()
        yield key, own
        for _ in own:
            pass


def batches_of(rows: Iterator[tuple[tuple, int]], fields: pa.Schema, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each given with its weight, of about `size` in all."""
    held: list[tuple] = []
    total = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)

    for row, weight in rows:
        held.append(row)
        total += weight
        if total >= size:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


FORMATTED = "conv_id long, window int, text string, repeated int, loss_starts array<long>, loss_ends array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in schema.split(", ")])


def formatted(conversations: DataFrame, ranks: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 0), text, repeated (turns at its start that an earlier window has), loss_starts, loss_ends (code points of text)."""
    common.bounded_batches(conversations.sparkSession)
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = c.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.codec_of(ranks).encode

        def rows() -> Iterator[tuple[tuple, int]]:
            for conv, turns in grouped(batches, [0, 1, 2]):
                for n, (span, repeated) in enumerate(windows(turns, lambda text: len(encode(text)) // 4, budget, history)):
                    text, loss = window(span, repeated)
                    yield (conv, n, text, repeated, [a for a, _ in loss], [b for _, b in loss]), len(text)

        yield from batches_of(rows(), arrow(FORMATTED))

    return dealt.mapInArrow(run, FORMATTED)


def read_back(made: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the windows; made's windows must be in order within its partitions, as formatted() leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[tuple, int]]:
            for conv, parts in grouped(batches, [0, 2, 3, 4, 5]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = n_windows = 0
                for text, repeated, starts, ends in parts:
                    n_windows += 1
                    chars += len(text)
                    for role, body in TURN.findall(text)[repeated:]:
                        n_turns += 1
                        turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    for a, b in zip(starts, ends, strict=True):
                        body = unescape(text[a:b])
                        loss_chars += len(body)
                        loss.update(body.encode())
                yield (conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows), 1024

        yield from batches_of(rows(), arrow(DIGESTS))

    return made.mapInArrow(run, DIGESTS)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return read_back(formatted(told.unionByName(extra), public_tokenizers.path(bpe.RANKS)))
