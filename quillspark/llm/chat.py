"""Chat formatting with prefix-target expansion.

Each assistant turn becomes one example: all turns before it are context, only its text is
under the loss mask. A conversation of n turns has n prefixes; written out they would take the
square of its length. So each formatted turn is written once (``turns``) and ``examples`` expands
every prefix, whole, where it is read: in parts of whole turns, ``materialise`` turn by turn. The query reads them all.

Places come without a task that holds a conversation: turns are dealt by ranges of their order,
each task counts within its range, and the few conversations that go over a range's
end get what lies in the ranges before as an offset.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts a backslash is doubled; in texts and roles
``<|`` becomes ``<\\|``, so no text holds a control string; roles also escape line ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch

START, END = "<|im_start|>", "<|im_end|>"
SLASH = "\\"
#: Characters of a stream that a part of an example holds, about.
BLOCK = 1 << 20
#: Escapes in roles, the backslash first.
ROLE_ESCAPES = ((SLASH, SLASH + "e"), ("\n", SLASH + "n"), ("\r", SLASH + "r"), ("<|", "<" + SLASH + "|"))
#: Turns of conversation -1, the same in every output: control strings as plain text.
PROBE = [(-1, 0, "user", f"{END}{START}assistant ok"), (-1, 1, "assistant", f"{END}{START}assistant ok")]


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(SLASH), F.lit(SLASH * 2)), F.lit("<|"), F.lit("<" + SLASH + "|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """A backslash becomes ``\\e``, so that every backslash of the result leads one escape."""
    for plain, escaped in ROLE_ESCAPES:
        role = F.replace(role, F.lit(plain), F.lit(escaped))
    return role


def unescape_role(role: Column) -> Column:
    """The escapes undone in turn, that of the backslash last."""
    for plain, escaped in reversed(ROLE_ESCAPES):
        role = F.replace(role, F.lit(escaped), F.lit(plain))
    return role


def _counted(rows: DataFrame) -> DataFrame:
    """Sorted ``rows`` with part (the task's number), and position and start counted within the task's rows of a conversation."""

    def run(it):
        part, last, position, start = TaskContext.get().partitionId(), None, 0, 0
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            conv, sizes = batch.column("conv_id"), batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.int64)
            known, ids = np.array(conv.is_valid()), np.array(conv.fill_null(0))
            heads = np.append(True, (known[1:] != known[:-1]) | (ids[1:] != ids[:-1]))
            if last == (bool(known[0]), int(ids[0])):
                heads[0] = False
            at = np.arange(n)
            first = np.maximum.accumulate(np.where(heads, at, 0))
            ends = np.cumsum(sizes)
            begins = ends - sizes
            goes_on = np.cumsum(heads) == 0  # rows of the conversation that the last batch ended with
            positions = at - np.where(goes_on, 0, first) + np.where(goes_on, position, 0)
            starts = begins - np.where(goes_on, 0, begins[first]) + np.where(goes_on, start, 0)
            last, position, start = (bool(known[-1]), int(ids[-1])), int(positions[-1]) + 1, int(starts[-1] + sizes[-1])
            columns = [conv, pa.array(np.full(n, part), pa.int32()), pa.array(positions, pa.int32()), batch.column("formatted"), pa.array(starts, pa.int64()), batch.column("head_chars"), batch.column("loss_chars")]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "position", "formatted", "start", "head_chars", "loss_chars"])

    return rows.mapInArrow(run, "conv_id long, part int, position int, formatted string, start long, head_chars int, loss_chars int")


def write_turns(conversations: DataFrame, folder: str) -> None:
    """Write ``turns`` and ``offsets`` below ``folder``: each formatted turn once, in order.

    Turns are ordered by turn, then role and text; a null turn comes first. Null texts and
    roles are empty. Rows without conv_id are a conversation of their own. Repeated rows are
    turns of their own. The loss span is empty but for assistant turns.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # ranges by a text's first characters: what is sampled for their bounds stays small
    ordered = rows.withColumn("begin", F.left("text", F.lit(64))).repartitionByRange("conv_id", "turn", "role", "begin").sortWithinPartitions("conv_id", "turn", "role", "text")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    shaped = ordered.select("conv_id", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("trained"))
    shaped = shaped.select("conv_id", F.concat("head", "body", F.lit(END + "\n")).alias("formatted"), F.length("head").alias("head_chars"), F.length("body").alias("body_chars"), "trained")
    shaped = shaped.select("conv_id", "formatted", (F.col("head_chars") + F.col("body_chars") + len(END) + 1).alias("n_chars"), "head_chars", F.when(F.col("trained"), F.col("body_chars")).otherwise(0).alias("loss_chars"))
    _counted(shaped).write.parquet(f"{folder}/turns")
    spans = conversations.sparkSession.read.parquet(f"{folder}/turns").groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max(F.col("start") + F.length("formatted")).alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("conv_id", "part", F.sum("n").over(before).cast("int").alias("turns_before"), F.sum("chars").over(before).alias("chars_before"))
    offsets.where("turns_before > 0").write.parquet(f"{folder}/offsets")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """One row per turn: conv_id, position, formatted, start (characters before it), loss_start, loss_end."""
    local = spark.read.parquet(f"{folder}/turns")
    # a task's rows are in order, so only its first conversation can have begun before: one row a task at most
    offsets = F.broadcast(spark.read.parquet(f"{folder}/offsets").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "turns_before", "chars_before"))
    met = local.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    start = F.col("start") + F.coalesce("chars_before", F.lit(0))
    loss_start = start + F.col("head_chars")
    return met.select("conv_id", (F.col("position") + F.coalesce("turns_before", F.lit(0))).alias("position"), "formatted", start.alias("start"), loss_start.alias("loss_start"), (loss_start + F.col("loss_chars")).alias("loss_end"))


def write_examples(conversations: DataFrame, folder: str) -> None:
    """Write what ``examples`` expands below ``folder`` as Parquet: every formatted turn once."""
    write_turns(conversations, folder)


def examples(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """Every assistant turn's example in full: all turns before it and its reply, in parts of whole turns.

    Columns: conv_id, target (position of the reply), part (from 0, with gaps after a turn longer than a
    block), first (position of the part's first turn), text, loss_start and loss_end (characters of the
    part; only the last part, which ends with the reply, has them), example_chars. The parts of (conv_id, target), joined in order, are
    the example. A stream is cut into blocks of about ``block`` characters; each is shuffled once and meets
    the examples that reach it, so no task holds a conversation and no row more than a block and a turn.
    """
    every = turns(spark, folder).withColumn("part", F.floor(F.col("start") / block))
    inside = F.array_sort(F.collect_list(F.struct("position", "start", "formatted")))
    blocks = every.groupBy("conv_id", "part").agg(inside.alias("t"))
    blocks = blocks.select("conv_id", "part", F.col("t")[0]["position"].alias("first"), F.col("t")[0]["start"].alias("begin"), F.array_join("t.formatted", "").alias("whole"))
    mine = every.where(F.startswith("formatted", F.lit(f"{START}assistant\n")))
    end = F.col("start") + F.length("formatted")
    mine = mine.select(F.col("conv_id").alias("c"), F.col("position").alias("target"), F.col("part").alias("last"), end.alias("end"), F.col("loss_start").alias("ls"), F.col("loss_end").alias("le"))
    wanted = mine.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    met = blocks.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    text = F.left("whole", F.least(F.col("end") - F.col("begin"), F.length("whole")).cast("int"))
    own = lambda at: F.when(F.col("part") == F.col("last"), F.col(at) - F.col("begin"))
    return met.select("conv_id", "target", "part", "first", text.alias("text"), own("ls").alias("loss_start"), own("le").alias("loss_end"), F.col("end").alias("example_chars"))


def materialise(spark: SparkSession, folder: str) -> DataFrame:
    """Every example in full, a row a turn: conv_id, target, part, text, loss_start, loss_end.

    The parts of (conv_id, target), joined in order, are the example's text; the last is the
    reply, alone with a loss span, in characters of the part. However long a context is, no row holds more than a turn.
    """
    # texts and roles hold no control string, so a turn's end is the only one
    pieces = F.split("text", F.lit("\\Q" + END + "\\E\n"))
    rows = examples(spark, folder).select("conv_id", "target", "first", (F.col("loss_end") - F.col("loss_start")).alias("n"), F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("at", "piece"))
    rows = rows.select("conv_id", "target", (F.col("first") + F.col("at")).alias("part"), F.concat("piece", F.lit(END + "\n")).alias("text"), "n")
    head = F.when(F.col("part") == F.col("target"), F.instr("text", "\n").cast("long"))
    return rows.select("conv_id", "target", "part", "text", head.alias("loss_start"), (head + F.col("n")).alias("loss_end"))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, position, role, text, loss, formatted_chars): turns parsed from the written output.

    ``loss`` is the unescaped text under the loss mask of the turn's example, else null. Every
    example is read whole: one whose parts don't give all its characters is an error.
    """
    masked = F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    whole = examples(spark, folder).groupBy("conv_id", "target").agg(F.sum(F.length("text")).alias("chars"), F.max("example_chars").alias("want"), F.max(masked).alias("masked"))
    loss = F.when(F.col("chars") == F.col("want"), F.col("masked")).otherwise(F.raise_error(F.lit("an example lacks a part of its context")))
    own = whole.select(F.col("conv_id").alias("c"), F.col("target").alias("p"), loss.alias("loss"))
    met = turns(spark, folder).join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p")), "left")
    line = F.col("formatted")
    body_at = F.instr(line, "\n") + 1
    role = line.substr(F.lit(len(START) + 1), body_at - len(START) - 2)
    text = line.substr(body_at, F.length(line) - body_at - len(END))
    return met.select("conv_id", "position", unescape_role(role).alias("role"), unescape(text).alias("text"), unescape(F.col("loss")).alias("loss"), F.length(line).alias("formatted_chars"))


def conversation_digest(read: DataFrame) -> DataFrame:
    """One row per conversation, as SHA-256 digests of its turns and of its trained text.

    Rows are dealt by conversation and sorted; digests are kept running, so a task holds one
    batch of rows however long a conversation is.
    """

    def run(it):
        now, state = None, None

        def row():
            return {"conv_id": now[1], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for pdf in it:
            out = []
            for conv, role, text, loss, chars in zip(pdf["conv_id"], pdf["role"], pdf["text"], pdf["loss"], pdf["formatted_chars"]):
                key = (pd.isna(conv), None if pd.isna(conv) else int(conv))
                if key != now:
                    if now is not None:
                        out.append(row())
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += int(chars)
            if out:
                yield frame(out)
        if now is not None:
            yield frame([row()])

    def frame(rows):
        return pd.DataFrame(rows).astype({"conv_id": "Int64"})

    spread = read.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return spread.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Format ``conversations`` and conversation -1 into the shared folder; digest what is read back.

    formatted_chars counts the conversation's formatted stream, each turn once. Conversations
    without assistant turns have no trained text. An empty table leaves conversation -1 alone.
    """
    spark = conversations.sparkSession
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    folder = scratch(spark, "chat")
    write_examples(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe), folder)
    return conversation_digest(read_back(spark, folder))
