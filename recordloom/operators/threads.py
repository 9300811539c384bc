"""Conversation threads with a bounded memory.

Messages are rows (conv_id, turn, role, text); (conv_id, turn) is unique.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions import text as text_functions
from recordloom.functions.joins import lookup_join
from recordloom.functions.ranking import rank_in_group
from recordloom.functions.rows import first_rows
from recordloom.session import materialise

WINDOW_BLOCK = 4_096
WALK_BLOCK = 2_048  # messages of a thread that are one function
# White space a trimmed message loses, Unicode spaces and the byte-order mark included.
WHITE_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
HISTORY = "array<struct<role:string,content:string>>"


def is_blank(column: str = "text") -> Column:
    """Whether nothing is left once all white space is removed."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), WHITE_SPACE, "") == ""


def nonblank(messages: DataFrame) -> DataFrame:
    """A blank user message is ignored."""
    return messages.filter((F.col("role") != "user") | ~is_blank())


def history_messages(messages: DataFrame) -> DataFrame:
    """Rows that enter the history: no system message, no blank user message."""
    return nonblank(messages).filter(F.col("role") != "system")


def history_length(rank: Column, memory: int) -> Column:
    """Messages in memory right after the user message at ``rank``, in a thread where
    an assistant message only ever follows a user message.

    Two messages leave whenever the memory is exceeded, so the length keeps the
    parity of the rank: it is the rank itself until the memory is full, then
    the larger of ``memory`` and ``memory`` - 1 with that parity. ``histories`` looks
    for threads in another order and takes ``walked_lengths`` for them.
    """
    full = F.lit(memory) - F.pmod(F.lit(memory) - rank, F.lit(2))
    return F.least(rank, full)


def walk(users: np.ndarray, memory: int, start: np.ndarray) -> np.ndarray:
    """History lengths after the messages of a block, for every length before it."""
    length = start.copy()
    for user in users:
        length = np.where(user & (length >= memory), length - 1, length + 1)
    return length


def block_function(users: np.ndarray, memory: int) -> tuple[list[int], list[int], int]:
    """A block of messages as a function of the history length before it: from each
    of the first numbers on, that of the second list is added; the third is added
    from ``memory`` + the block's size on, where every user message takes one away."""
    before = np.arange(memory + len(users) + 1)
    added = walk(users, memory, before) - before
    new = np.flatnonzero(np.append(True, added[1:] != added[:-1]))
    return new.tolist(), added[new].tolist(), int((~users).sum() - users.sum())


def _block_functions(memory: int):
    """Map (conv_id, block, rank_no, user), sorted, to a function for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(name, users):
            starts, added, above = block_function(np.array(users), memory)
            return pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([name[0]], pa.int64()), "block": pa.array([name[1]], pa.int64()),
                    "starts": pa.array([starts], pa.list_(pa.int64())),
                    "added": pa.array([added], pa.list_(pa.int64())),
                    "above": pa.array([above], pa.int64()), "size": pa.array([len(users)], pa.int64()),
                }
            )

        name, users = None, []
        for batch in batches:
            for each in batch.to_pylist():
                here = (each["conv_id"], each["_home"])
                if here != name and name is not None:
                    yield row(name, users)
                    users = []
                name = here
                users.append(each["user"])
        if name is not None:
            yield row(name, users)

    return run


def _composed(memory: int):
    """Map the functions of every thread's blocks, in order, to the lengths before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thread, length = None, 0
        for batch in batches:
            before = []
            for each in batch.to_pylist():
                if each["conv_id"] != thread:
                    thread, length = each["conv_id"], 0
                before.append(length)
                at = bisect_right(each["starts"], length) - 1
                beyond = length >= memory + each["size"]
                length += each["above"] if beyond else each["added"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(before, pa.int64())],
                ["conv_id", "_home", "before"],
            )

    return run


def _lengths(memory: int):
    """Map (conv_id, _home, rank_no, user, before), sorted, to the length after each
    user message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, length = None, 0
        for batch in batches:
            rows = []
            for each in batch.to_pylist():
                if (each["conv_id"], each["_home"]) != name:
                    name, length = (each["conv_id"], each["_home"]), each["before"]
                length += -1 if each["user"] and length >= memory else 1
                if each["user"]:
                    rows.append({"conv_id": each["conv_id"], "rank_no": each["rank_no"], "length": length})
            yield pa.RecordBatch.from_pylist(
                rows, pa.schema([("conv_id", pa.int64()), ("rank_no", pa.int64()), ("length", pa.int64())])
            )

    return run


def walked_lengths(ranked: DataFrame, memory: int) -> DataFrame:
    """(conv_id, rank_no, length) of every user message, whatever the order of roles.

    Every block of ranks becomes a function from the history length before it to the
    one after it; these are composed thread by thread, one narrow row a block; then
    each block is walked from its own start. No task walks a whole thread.
    """
    rows = ranked.select(
        "conv_id", "rank_no", (F.col("role") == "user").alias("user"),
        F.expr(f"(rank_no - 1) div {WALK_BLOCK}").alias("_home"),
    )

    def in_blocks(frame: DataFrame) -> DataFrame:
        ordered = frame.repartition("conv_id", "_home")
        return ordered.sortWithinPartitions("conv_id", "_home", "rank_no")

    functions = in_blocks(rows).mapInArrow(
        _block_functions(memory),
        "conv_id bigint, block bigint, starts array<bigint>, added array<bigint>, above bigint, size bigint",
    )
    starts = (
        functions.repartition("conv_id").sortWithinPartitions("conv_id", "block")
        .mapInArrow(_composed(memory), "conv_id bigint, _home bigint, before bigint")
    )
    return in_blocks(rows.join(starts, ["conv_id", "_home"])).mapInArrow(
        _lengths(memory), "conv_id bigint, rank_no bigint, length bigint"
    )


def histories(messages: DataFrame, memory: int = model.THREAD_MEMORY) -> DataFrame:
    """The history each user message is sent with.

    Where an assistant message only follows a user message, lengths are a closed form
    and the window runs over rank blocks of fixed size (no smaller than the memory),
    each preceded by the last ``memory`` messages of the block before, so the longest
    thread is spread over as many tasks as it needs. Threads in another order, whose
    histories may outgrow the memory, get their lengths from ``walked_lengths`` and
    their messages by rank.
    """
    ranked = rank_in_group(history_messages(messages), "conv_id", "turn", "rank_no")
    ranked = materialise(ranked.select("conv_id", "turn", "role", "text", "rank_no"), "ranked")
    # An answer at rank r needs a user message at rank r - 1.
    users = ranked.filter("role = 'user'").select("conv_id", (F.col("rank_no") + 1).alias("rank_no"))
    odd = ranked.filter("role <> 'user'").join(users, ["conv_id", "rank_no"], "left_anti")
    odd = materialise(odd.select("conv_id").distinct(), "other-orders")
    usual = _usual_histories(lookup_join(ranked, odd, ["conv_id"], "left_anti", ["rank_no"]), memory)
    if odd.isEmpty():
        return usual
    rest = lookup_join(ranked, odd, ["conv_id"], "left_semi", ["rank_no"])
    lengths = walked_lengths(rest, memory)
    wanted = lengths.withColumn(
        "_at",
        F.explode(
            F.sequence(F.col("rank_no") - F.greatest("length", F.lit(1)) + 1, F.col("rank_no"))
        ),
    )
    entry = F.struct(F.col("role"), F.col("text").alias("content"))
    parts = rest.select("conv_id", F.col("rank_no").alias("_at"), entry.alias("_entry"))
    found = (
        wanted.join(parts, ["conv_id", "_at"])
        .groupBy("conv_id", "rank_no", "length")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_entry"))).alias("_found"))
        .select(
            "conv_id", "rank_no",
            F.when(F.col("length") > 0, F.col("_found._entry")).otherwise(F.array().cast(HISTORY)).alias("history"),
        )
    )
    turns = rest.select("conv_id", "rank_no", "turn")
    return usual.unionByName(
        found.join(turns, ["conv_id", "rank_no"]).select("conv_id", "turn", "rank_no", "history")
    )


def _usual_histories(ranked: DataFrame, memory: int) -> DataFrame:
    block = max(WINDOW_BLOCK, memory)
    position = F.col("rank_no") - 1
    home = F.expr(f"(rank_no - 1) div {block}")
    carried = F.pmod(position, F.lit(block)) >= block - memory
    blocks = ranked.withColumn("_home", home).withColumn(
        "_block",
        F.explode(
            F.when(carried, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(
                F.array(F.col("_home"))
            )
        ),
    )
    recent = (
        Window.partitionBy("conv_id", "_block")
        .orderBy("rank_no")
        .rowsBetween(-(memory - 1), Window.currentRow)
    )
    entry = F.struct(F.col("role"), F.col("text").alias("content"))
    length = history_length(F.col("rank_no"), memory).cast("int")
    # The frame is at most ``memory`` rows; only user messages keep theirs.
    return (
        blocks.withColumn("_recent", F.collect_list(entry).over(recent))
        .filter((F.col("role") == "user") & (F.col("_block") == F.col("_home")))
        .withColumn("history", F.when(length > 0, F.slice("_recent", -length, length)).otherwise(F.array().cast(HISTORY)))
        .select("conv_id", "turn", "rank_no", "history")
    )


def model_messages(histories: DataFrame, system_message: str) -> DataFrame:
    """The system message goes first and is not part of the history."""
    system = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_message).alias("content"))
    )
    return histories.withColumn(
        "messages", F.concat(system.cast(HISTORY), F.col("history").cast(HISTORY))
    )


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """C4: concatenate streamed pieces in order, a missing piece being "".

    Expects conv_id, turn, seq, delta. One answer has at most
    ``MAX_OUTPUT_TOKENS`` pieces, so a group is small by definition.
    """
    ordered = F.sort_array(
        F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta")))
    )
    return chunks.groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(ordered, lambda c: c["delta"]), "").alias("text"),
        F.count("*").alias("pieces"),
    )


def latest_results(messages: DataFrame) -> DataFrame:
    """Content of the last assistant message; reduces on the map side."""
    answers = messages.filter(F.col("role") == "assistant")
    last = first_rows(answers.select("conv_id", "turn", "text"), ["conv_id"], [F.desc("turn")])
    return last.select("conv_id", F.col("text").alias("latest_result"), "turn")


def snapshots(
    messages: DataFrame,
    agent_name: str,
    memory: int = model.THREAD_MEMORY,
) -> DataFrame:
    """One row per thread, with the history it currently holds.

    A thread holds the memory after its last user message plus the answer to
    it, so at most ``memory`` + 1 of its last messages. One aggregation of numbers
    finds where they, the system message and the last answer are; ranks come from
    turn blocks, so no thread is brought together but for what its row holds.
    ``user_id`` and ``sent_at`` are read where ``messages`` has them: a thread is
    created with its first message and updated when an answer ends.
    """
    for name, kind in (("user_id", "string"), ("sent_at", "timestamp_ntz")):
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(None).cast(kind))
    messages = messages.select("conv_id", "turn", "role", "text", "user_id", "sent_at")
    role = F.col("role")
    held = (role != "system") & ((role != "user") | ~is_blank())
    sent = F.unix_micros(F.col("sent_at").cast("timestamp"))
    known = (
        messages.groupBy("conv_id")
        .agg(
            F.count_if(held).alias("_total"),
            F.max(F.when(held & (role == "user"), F.col("turn"))).alias("_user"),
            F.min(F.when(role == "system", F.col("turn"))).alias("_system"),
            F.max(F.when(role == "assistant", F.col("turn"))).alias("_answer"),
            F.min(sent).alias("_created"),
            F.max(F.when(role == "assistant", sent)).alias("_updated"),
        )
        .filter("_total > 0")
    )
    ranked = rank_in_group(history_messages(messages), "conv_id", "turn", "rank_no").select(
        *messages.columns, "rank_no"
    )
    system = messages.filter(role == "system").withColumn("rank_no", F.lit(None).cast("bigint"))
    recent = F.coalesce(F.col("rank_no") > F.col("_total") - memory - 1, F.lit(False))
    wanted = lookup_join(
        ranked.unionByName(system), known, ["conv_id"], "inner", spread_by=("turn",)
    ).filter(recent | (F.col("turn") == F.col("_system")) | (F.col("turn") == F.col("_answer")))
    entry = F.struct("turn", "role", F.col("text").alias("content"))
    # At most memory + 3 messages of a thread.
    tails = wanted.groupBy("conv_id", "_total", "_user", "_created", "_updated").agg(
        F.sort_array(F.collect_list(F.when(recent, entry))).alias("_entries"),
        F.max(F.when(F.col("turn") == F.col("_system"), F.col("text"))).alias("system_message"),
        F.max(F.when(F.col("turn") == F.col("_answer"), F.col("text"))).alias("latest_result"),
        F.max("user_id").alias("user_id"),
    )
    after = F.size(F.filter("_entries", lambda e: e["turn"] > F.coalesce("_user", F.lit(-1))))
    length = history_length(F.col("_total") - F.col("_after"), memory) + F.col("_after")
    size = F.least(length, F.size("_entries").cast("bigint")).cast("int")
    chat = F.transform(
        F.slice("_entries", -F.col("_held"), F.col("_held")),
        lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content")),
    )

    def moment(name: str) -> Column:
        return F.timestamp_micros(F.col(name)).cast("timestamp_ntz")

    return (
        tails.withColumn("_after", after)
        .withColumn("_held", size)
        .select(
            F.col("conv_id").alias("thread_id"),
            "user_id",
            F.lit(agent_name).alias("agent_name"),
            "system_message",
            chat.alias("chat_history"),
            "latest_result",
            moment("_created").alias("created_at"),
            F.coalesce(moment("_updated"), moment("_created")).alias("updated_at"),
        )
    )


def schemas_from_threads(
    latest: DataFrame, schema_name: Column, schema_description: Column, created_at: Column
) -> DataFrame:
    """A thread's latest answer as a schema submission; answers without a
    JSON object save nothing."""
    span = text_functions.json_span(F.trim("latest_result"))
    return (
        latest.withColumn("_definition", text_functions.parse_object(span))
        .filter(F.col("_definition").isNotNull())
        .select(
            "conv_id",
            schema_name.alias("schema_name"),
            schema_description.alias("schema_description"),
            F.to_json("_definition").alias("schema_definition"),
            created_at.alias("created_at"),
        )
    )
