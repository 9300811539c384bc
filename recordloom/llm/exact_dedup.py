"""Exact deduplication behind a two-pass Bloom filter.

Pass one counts, for two independent slots of every text's hash, how many rows
fall on the slot; the slots hit more than once are kept as bitmaps. Pass two
tests every row against these bitmaps: a row with a slot of its own has no equal
and passes straight through, only the others are shuffled and grouped. False
positives of the filter are grouped like repeats and come out as groups of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import column, packed, spread_join, whole_text

SLOTS = 32_768  # bits of one bitmap
ROWS_PER_BUCKET = 4_096
#: Bound of the filter that is broadcast: 8 192 buckets of two 4 KB bitmaps, 64 MB.
#: A larger table only has more false positives, which are shuffled needlessly.
MAX_BUCKETS = 8_192


def _is_set(bits: str, place: str) -> Column:
    """Whether bit ``place`` of a bitmap is set; false where there is no bitmap."""
    byte = f"cast(conv(hex(substring({bits}, {place} div 8 + 1, 1)), 16, 10) as int)"
    return F.expr(f"coalesce(getbit({byte}, {place} % 8) = 1, false)")


def digest(text: str) -> Column:
    return F.sha2(whole_text(text), 256)


def mark_possible(docs: DataFrame, text: str = "text", max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Add ``_sha`` (of the text) and ``_possible`` (it may occur more than once).

    ``docs`` is read twice more than the caller reads it: for its row count and
    for pass one, which moves two (slot, count) rows per document.
    """
    rows = docs.count()
    buckets = max(1, min(max_buckets, -(-rows // ROWS_PER_BUCKET)))
    hashed = docs.withColumn("_sha", digest(text))
    for name, seed in (("_bucket", 0), ("_first", 1), ("_second", 2)):
        most = buckets if name == "_bucket" else SLOTS
        place = F.pmod(F.xxhash64("_sha", F.lit(seed)), F.lit(most))
        hashed = hashed.withColumn(name, place.cast("int"))

    # One number for (bucket, which of the two slots, place).
    slot = [
        (F.col("_bucket").cast("bigint") * 2 + which) * SLOTS + F.col(place)
        for which, place in enumerate(("_first", "_second"))
    ]
    hit_twice = (
        hashed.select(F.explode(F.array(*slot)).alias("slot"))
        .groupBy("slot")
        .agg(F.count("*").alias("rows"))
        .filter("rows > 1")
    )
    bitmaps = (
        hit_twice.select(
            F.expr(f"cast(slot div {2 * SLOTS} as int)").alias("_bucket"),
            F.expr(f"slot div {SLOTS} % 2").alias("which"),
            F.expr(f"slot % {SLOTS}").alias("place"),
        )
        .groupBy("_bucket")
        .agg(
            F.expr("bitmap_construct_agg(place) filter (where which = 0)").alias("_firsts"),
            F.expr("bitmap_construct_agg(place) filter (where which = 1)").alias("_seconds"),
        )
    )
    # At most max_buckets rows of 8 KB each.
    return (
        hashed.join(F.broadcast(bitmaps), "_bucket", "left")
        .withColumn(
            "_possible", _is_set("_firsts", "_first") & _is_set("_seconds", "_second")
        )
        .drop("_bucket", "_first", "_second", "_firsts", "_seconds")
    )


def _groups(possible: DataFrame, id_name: str) -> DataFrame:
    """The repeated texts; a hot one is counted on the map side first."""
    return (
        possible.groupBy("_sha")
        .agg(F.max(column(id_name)).alias("_keep"), F.count("*").alias("_size"))
        .filter("_size > 1")
    )


def exact_groups(docs: DataFrame, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; a null one is empty. Of equal texts
    the row with the largest id stays. A null id loses against any other; a group
    of nulls only keeps them. Rows that repeat both id and text share their fate:
    ``kept`` marks ids. Other columns are neither read nor returned. An empty
    table gives an empty result.
    """
    narrow = docs.select(column(id_name).alias("doc_id"), whole_text(text).alias("text"))
    marked = mark_possible(narrow, "text").select("doc_id", "_sha", "_possible")
    possible = marked.filter("_possible")
    alone = marked.filter("not _possible").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    grouped = spread_join(
        possible.drop("_possible"), _groups(possible, "doc_id"), ["_sha"], ["doc_id"]
    ).select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
    return alone.unionByName(grouped)


def drop_repeats(docs: DataFrame, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others.

    Rows the filter clears never move. A row repeated with its id stays as often
    as it came.
    """
    rows = packed(docs, _id=column(id_name), _text=whole_text(text))
    marked = mark_possible(rows, "_text").drop("_text")
    possible = marked.filter("_possible")
    alone = marked.filter("not _possible")
    joined = spread_join(possible, _groups(possible, "_id"), ["_sha"], ["_id"])
    kept = joined.filter(F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    return alone.select("_row.*").unionByName(kept.select("_row.*"))
