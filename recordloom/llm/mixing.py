"""Mixing sources to target weights by budgets that run down a tree.

The tree is domain, language, source. Its budget is shared out from the top by
the weights of the children, up to what each subtree can give (its tokens times
the epochs allowed). What a child cannot give goes to its siblings; only when all
of them are exhausted does their parent fall short, and then the parent's
siblings take over. A leaf's budget buys whole epochs and, of one more epoch in
seeded order, the prefix of documents that its remaining tokens cover.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.shared import column, packed, spread_join, whole_text
from recordloom.session import materialise

LEVELS = ("_domain", "_lang", "_source")
DIGITS = 3  # hex digits of the seeded order that name a bucket: 4 096 a leaf
#: Leaves up to this many are broadcast; beyond it documents and leaves are
#: joined on (leaf, salt).
MAX_LEAVES = 100_000


def estimated_tokens(text: str = "text") -> Column:
    """A token for every four bytes begun, at least one."""
    return F.expr("1L") + F.floor(F.octet_length(whole_text(text)) / 4).cast("bigint")


def _weight(level: str, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("bigint")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(known[F.col(level)], F.lit(default)).cast("bigint")


def _wide(value: str) -> str:
    return f"cast({value} as decimal(19, 0))"


def _share_out(nodes: DataFrame, path: Sequence[str]) -> DataFrame:
    """Add ``_budget`` to ``nodes`` (path, _cap, _weight, _given: the parent's budget).

    Children are ordered by how soon they are exhausted. As long as a child's cap
    is below its share of what the children before it left, it gives all it has;
    the others divide the rest by weight, rounded down.
    """
    parent, order = list(path[:-1]), [F.expr("_cap / _weight"), F.col(path[-1])]
    ahead = Window.partitionBy(*parent).orderBy(*order)
    usable = nodes.filter("_weight > 0")
    levels = usable.select(
        "*",
        F.coalesce(
            F.sum("_cap").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_used"),
        F.sum("_weight").over(ahead.rowsBetween(0, Window.unboundedFollowing)).alias("_open"),
    ).withColumn(
        "_gives_all",
        F.expr(
            f"{_wide('_cap')} * {_wide('_open')} <= {_wide('_given - _used')} * {_wide('_weight')}"
        ),
    )
    # The first child that is not exhausted: what is left there, and for whom.
    at = levels.withColumn(
        "_rest",
        F.min(F.expr("if(_gives_all, null, struct(_open * -1 as open, _given - _used as rest))"))
        .over(Window.partitionBy(*parent)),
    )
    shared = F.expr(f"{_wide('_rest.rest')} * {_wide('_weight')} div {_wide('_rest.open * -1')}")
    return at.withColumn(
        "_budget", F.when(F.col("_gives_all"), F.col("_cap")).otherwise(shared.cast("bigint"))
    ).drop("_used", "_open", "_gives_all", "_rest")


def leaf_budgets(
    leaves: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    budget: int | None,
    max_epochs: int,
    default_weight: int = 1,
) -> DataFrame:
    """``leaves`` (_domain, _lang, _source, _total) with ``_budget``.

    ``weights`` holds whole numbers by level and name, ``default_weight`` is for
    names it lacks; a weight of zero leaves a subtree out. Without ``budget`` the
    mixture is as large as all leaves together.
    """
    # What lies under a weight of zero can take nothing, so no ancestor counts it.
    left_out = F.lit(False)
    for level in LEVELS:
        named = _weight(level, weights.get(level.strip("_"), {}), default_weight)
        left_out |= named <= 0
    capped = leaves.withColumn(
        "_cap", F.when(left_out, 0).otherwise(F.col("_total") * max_epochs).cast("bigint")
    )
    wanted = F.lit(budget).cast("bigint") if budget is not None else F.sum("_total")
    root = capped.agg(F.least(wanted, F.sum("_cap")).alias("_given"))
    above = root
    for depth in range(1, len(LEVELS) + 1):
        path = list(LEVELS[:depth])
        nodes = capped.groupBy(*path).agg(F.sum("_cap").alias("_cap"))
        nodes = nodes.withColumn(
            "_weight", _weight(path[-1], weights.get(path[-1].strip("_"), {}), default_weight)
        )
        # The root is one row; below it every parent is a key.
        nodes = nodes.join(above, path[:-1]) if depth > 1 else nodes.join(F.broadcast(above))
        above = _share_out(nodes, path).select(*path, F.col("_budget").alias("_given"))
    return leaves.join(above.withColumnRenamed("_given", "_budget"), list(LEVELS))


def _seeded(seed: int) -> Column:
    parts = [F.lit(str(seed)), F.col("_whole").cast("string"), F.col("_id")]
    return F.md5(F.concat_ws(":", *parts))


def _bucket(order: Column) -> Column:
    return F.conv(F.substring(order, 1, DIGITS), 16, 10).cast("int")


def epochs(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    budget: int | None = None,
    max_epochs: int = 2,
    seed: int = 0,
    tokens: Column | None = None,
    id_name: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """Every row of ``docs`` as the struct ``_row``, with ``_domain``, ``_lang``,
    ``_source`` (a null name is the empty one), ``_tokens``, ``_budget`` of the leaf,
    and ``_epochs``: how often it is taken, 0 if not at all.

    Only counts per (leaf, bucket of the seeded order) are summed up, so a leaf
    with a third of all rows is never brought together: buckets before the end of
    the prefix are taken whole, and the one in which it ends is ordered by itself.
    Rows alike in id and size are ordered by the digest of their text.
    """
    rows = packed(
        docs,
        _id=column(id_name).cast("string"),
        _text=whole_text(text),
        _domain=F.coalesce(domain, F.lit("")),
        _lang=F.coalesce(column(lang).cast("string"), F.lit("")),
        _source=F.coalesce(column(source).cast("string"), F.lit("")),
        _tokens=estimated_tokens(text) if tokens is None else tokens.cast("bigint"),
    )
    leaf = list(LEVELS)
    totals = rows.groupBy(*leaf).agg(F.sum("_tokens").alias("_total"))
    budgets = leaf_budgets(totals, weights, budget, max_epochs).select(
        *leaf, "_budget", F.expr("_budget div _total").alias("_whole"),
        F.expr("_budget % _total").alias("_left"),
    )
    budgets = materialise(budgets, "leaf-budgets")
    small = budgets.count() <= MAX_LEAVES

    def with_leaf(left: DataFrame, right: DataFrame) -> DataFrame:
        if small:
            return left.join(F.broadcast(right), leaf, "left")
        return spread_join(left, right, leaf, ["_id"])

    # Where the prefix ends: the bucket, and the tokens before it.
    placed = with_leaf(rows.select(*leaf, "_tokens", "_id"), budgets)
    sizes = (
        placed.filter("_left > 0")
        .select(*leaf, "_tokens", "_left", _bucket(_seeded(seed)).alias("_bucket"))
        .groupBy(*leaf, "_bucket")
        .agg(F.sum("_tokens").alias("_sum"), F.first("_left").alias("_left"))
    )
    until = Window.partitionBy(*leaf).orderBy("_bucket")
    ends = (
        sizes.withColumn("_upto", F.sum("_sum").over(until))
        .filter("_upto > _left")
        .groupBy(*leaf)
        .agg(F.min(F.struct("_bucket", F.expr("_upto - _sum").alias("before"))).alias("_end"))
    )
    ended = materialise(budgets.join(ends, leaf, "left"), "leaf-prefixes")
    marked = with_leaf(rows, ended).withColumn("_order", _seeded(seed))
    marked = marked.withColumn("_bucket", _bucket(F.col("_order")))
    at_end = F.coalesce(F.col("_bucket") == F.col("_end._bucket"), F.lit(False))
    clear = marked.filter(~at_end).withColumn(
        "_more", F.coalesce(F.col("_bucket") < F.col("_end._bucket"), F.lit(False))
    )
    within = (
        Window.partitionBy(*leaf)
        .orderBy("_order", "_tokens", F.md5("_text"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    close = marked.filter(at_end).withColumn(
        "_more", F.col("_end.before") + F.sum("_tokens").over(within) <= F.col("_left")
    )
    both = clear.unionByName(close)
    return both.withColumn(
        "_epochs", F.coalesce(F.col("_whole"), F.lit(0)) + F.col("_more").cast("bigint")
    ).select(
        "_row", *leaf, "_tokens",
        F.coalesce("_budget", F.lit(0)).alias("_budget"), "_epochs",
    )


def mixture(taken: DataFrame) -> DataFrame:
    """The rows of the mixture, each as often as ``epochs`` takes it."""
    times = F.explode(F.sequence(F.lit(1), F.col("_epochs")))
    return taken.filter("_epochs > 0").select("_row", times).select("_row.*")
