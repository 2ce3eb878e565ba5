r"""Operator 2, chat formatting: budgeted windows.

A turn is written `### Role: text</turn>` and a newline.  Inside roles and
texts a backslash goes before each backslash, `###` and `</turn>` (and, in
roles, `:`), so control strings cannot be forged and everything reads back.

Prefix sums of turn tokens choose the windows: with a budget for new turns of
NEW = budget - history - system turn, the turns that start in
[w * NEW, (w + 1) * NEW) are new in window w; turns that start in the last
`history` tokens before w * NEW are repeated there, after the system turn.
Every turn is new in exactly one window, and only assistant texts that are new
are under the loss mask.  A turn is never cut: one that is longer than the
budget makes its window longer.

Prefix sums are taken in two levels, over blocks of TURN_BLOCK turn numbers
and then over blocks, and windows are put together by (conversation, window),
so a conversation of any length is spread over tasks.

Defined results: null texts and roles count as empty; turns are ordered by
turn, then role, then text, nulls first; a conversation without a system turn
first repeats none; a null conv_id is a conversation; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, TURN_BLOCK = 512, 128, 256
#: Tokens of a turn's marks, besides its words.
MARKS = 4
END = "</turn>"
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
#: A conversation whose texts are control strings.
PROBE = (-7, r"\### Assistant: </turn> ok")

_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted window: role, text, and where the escaped text starts and ends."""
    names = {v: k for k, v in LABELS.items()}
    out = []
    for m in _TURN.finditer(window):
        label = m[1]
        out.append((unescape(label[1:]) if label[:1] == "@" else names[label], unescape(m[2]), m.start(2), m.end(2)))
    return out


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '\\\\', '\\\\\\\\'), '###', '\\\\###'), '{END}', '\\\\{END}')"


def format_chat(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation.

    conversations: conv_id, turn, role, text.  Returns conv_id, window, text,
    loss (array of start and end, code points of text), n_turns, n_repeated
    (leading turns that another window has as new) and tokens.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    label = F.expr("case role when 'system' then 'System' when 'user' then 'User' when 'assistant' then 'Assistant' else concat('@', replace(" + _escaped("role") + ", ':', '\\\\:')) end")
    rows = (
        conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("raw"))
        .withColumn("head", F.concat(F.lit("### "), label, F.lit(": ")))
        .withColumn("body", F.expr(_escaped("raw")))
        .withColumn("tokens", F.expr(f"size(regexp_extract_all(raw, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) + {MARKS}").cast("long"))
        .withColumn("block", F.expr(f"coalesce(floor(turn / {TURN_BLOCK}), -9223372036854775808)"))
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "raw")
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(inside))
    along = Window.partitionBy("conv_id").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("conv_id", "block")
        .agg(F.sum("tokens").alias("total"), F.count("*").alias("turns"), F.min_by(F.when(F.col("role") == "system", F.struct("head", "body", "tokens")), "place").alias("first"))
        .withColumn("offset", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
        .withColumn("skip", F.coalesce(F.sum("turns").over(earlier), F.lit(0)))
        .withColumn("system", F.first("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "offset", "skip", "system")
    )
    placed = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    placed = (
        placed.withColumn("before", F.col("before") + F.col("offset"))
        .withColumn("idx", F.col("place") + F.col("skip"))
        .withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0))))
        .withColumn("window", F.expr("before div room"))
        .withColumn("is_system", F.expr("idx = 1 and system is not null"))
        .withColumn("again", F.expr(f"not is_system and before >= (window + 1) * room - {history}"))
    )
    # The system turn goes with the turns that may be a window's first: the others need not carry it.
    carries = F.expr("place = 1 or before - room * window < tokens_before")
    placed = placed.withColumn("tokens_before", F.coalesce(F.lag("tokens").over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "raw")), F.lit(1 << 40)))
    piece = F.struct("idx", "again_here", "role", "head", "body", "tokens")
    spread = placed.withColumn("system", F.when(carries, F.col("system"))).select(
        "conv_id", "idx", "role", "head", "body", "tokens", "system", F.explode(F.expr("if(again, array(struct(window, false as h), struct(window + 1 as window, true as h)), array(struct(window, false as h)))")).alias("to")
    )
    spread = spread.select("conv_id", F.col("to.window").alias("window"), "system", F.col("to.h").alias("again_here"), "idx", "role", "head", "body", "tokens")
    windows = spread.groupBy("conv_id", "window").agg(
        F.max("system").alias("system"), F.min("idx").alias("least"), F.min("again_here").alias("only_old"), F.array_sort(F.collect_list(piece)).alias("turns")
    ).filter("not only_old")
    lead = F.expr(
        """if(system is not null and least > 1,
             array(named_struct('idx', 1L, 'again_here', true, 'role', 'system', 'head', system.head, 'body', system.body, 'tokens', system.tokens)), array())"""
    )
    windows = windows.withColumn("turns", F.concat(lead, "turns"))
    return windows.select(
        "conv_id",
        "window",
        F.expr(f"array_join(transform(turns, t -> concat(t.head, t.body, '{END}\\n')), '')").alias("text"),
        F.expr(
            f"""aggregate(turns, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)), (a, t) -> named_struct(
                'at', a.at + length(t.head) + length(t.body) + {len(END) + 1},
                'out', if(t.role = 'assistant' and not t.again_here,
                    concat(a.out, array(named_struct('start', a.at + length(t.head), 'end', a.at + length(t.head) + length(t.body)))), a.out)),
                a -> a.out)"""
        ).alias("loss"),
        F.size("turns").alias("n_turns"),
        F.expr("size(filter(turns, t -> t.again_here))").alias("n_repeated"),
        F.expr("aggregate(turns, 0L, (n, t) -> n + t.tokens)").alias("tokens"),
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each window says once it is parsed: its new turns and the text under its mask."""
    for b in batches:
        rows = []
        for text, loss, repeated in zip(*(b.column(i).to_pylist() for i in range(2, 5)), strict=True):
            turns = parse(text)[repeated:]
            rows.append(("".join(f"{r}\n{t}\n" for r, t, _, _ in turns), len(turns), "".join(unescape(text[x["start"] : x["end"]]) for x in loss), len(text)))
        said, n, masked, chars = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(n, pa.int64()), pa.array(masked, pa.string()), pa.array(chars, pa.int64())],
            names=["conv_id", "window", "said", "n", "masked", "chars"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, whose windows come one after the other; holds one hash state, no texts."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    held: list = []

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def row() -> tuple:
        conv, n, said, chars, masked, total = held
        return conv, n, said.hexdigest(), chars, masked.hexdigest(), total

    for b in batches:
        rows = []
        for conv, _, said, n, masked, chars in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not held or held[0] != conv:
                if held:
                    rows.append(row())
                held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            held[1] += n
            held[2].update(said.encode())
            held[3] += len(masked)
            held[4].update(masked.encode())
            held[5] += chars
        if rows:
            yield out(rows)
    if held:
        yield out([row()])


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read from their texts and masks alone.

    The digest of a conversation is sequential, so its windows stream through
    one task in order; formatting and parsing come before and are spread.
    """
    parsed = windows.select(F.col("conv_id").cast("long"), "window", "text", "loss", "n_repeated").mapInArrow(_read_back, "conv_id long, window long, said string, n long, masked string, chars long")
    return parsed.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one whose two turns say control strings."""
    conv, text = PROBE
    probe = conversations.sparkSession.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).union(probe)
