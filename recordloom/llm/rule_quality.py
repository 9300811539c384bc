"""Text quality by a sparse ensemble of rules over text statistics.

Statistics are Spark columns. On a bounded labelled sample, shallow boosted trees
propose rules: every path from a root is a conjunction of bounds on statistics. A
lasso logistic regression over the rules keeps few of them, and these are compiled
into one Spark column, so that all texts are scored without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import column, fold, packed, whole_text

FOLDS = 4
HELD_OUT = 2
#: Bound of the sample: about so many labelled training texts.
MOST_TEXTS = 20_000
TREES = 40
DEPTH = 3
LEAST = 20  # sample rows on either side of a split
CUTS = 32  # bounds tried per statistic
SHRINKAGE = 0.3
LASSO = 2e-3
SEED = 5


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; each is zero for the empty one."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    chars = F.length(text).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1.0))

    n_words = F.size("_words").cast("double")
    n_lines = F.size("_lines").cast("double")
    return {
        "_words": words,
        "_lines": lines,
        "chars": F.log1p(chars),
        "words": F.log1p(n_words),
        "word_length": chars / F.greatest(n_words, F.lit(1.0)),
        "distinct_words": F.size(F.array_distinct("_words")) / F.greatest(n_words, F.lit(1.0)),
        "lines": F.log1p(n_lines),
        "line_length": F.log1p(chars / n_lines),
        "distinct_lines": F.size(F.array_distinct("_lines")) / n_lines,
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{Nd}"),
        "stops": share(r"[.,;:?]"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:?!'|-]"),
        "bars": share(r"\|"),
        "shouts": share("!"),
    }


NAMES = [
    "chars", "words", "word_length", "distinct_words", "lines", "line_length", "distinct_lines",
    "upper", "digits", "stops", "symbols", "bars", "shouts",
]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column ``_stats``; a null text is empty."""
    columns = statistics(F.col("_text"))
    held = docs.withColumn("_text", whole_text(text))
    held = held.withColumns({n: columns[n] for n in ("_words", "_lines")})
    stats = F.struct(*[columns[n].cast("double").alias(n) for n in NAMES])
    return held.withColumn("_stats", stats).drop("_text", "_words", "_lines")


@dataclass(frozen=True)
class Bound:
    """A statistic that is at most, or above, a value."""

    name: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        at = x[:, NAMES.index(self.name)]
        return at > self.value if self.above else at <= self.value

    def column(self) -> Column:
        at = F.col("_stats")[self.name]
        return at > F.lit(self.value) if self.above else at <= F.lit(self.value)


Rule = frozenset[Bound]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([bound.holds(x) for bound in rule])


@dataclass
class Ensemble:
    constant: float
    rules: dict[Rule, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for rule, weight in self.rules.items():
            total += weight * holds(rule, x)
        return total

    def column(self) -> Column:
        """The score as a Spark expression over ``_stats``."""
        total = F.lit(self.constant)
        for rule, weight in self.rules.items():
            condition = F.lit(True)
            for bound in sorted(rule, key=lambda b: (b.name, b.above, b.value)):
                condition = condition & bound.column()
            total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _best_split(
    x: np.ndarray, residual: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]
) -> tuple[int, float] | None:
    """The bound that takes most variance out of the residuals of these rows."""
    best, found = 1e-9, None
    total, size = residual[rows].sum(), len(rows)
    for at, bounds in enumerate(cuts):
        if not len(bounds):
            continue
        place = np.searchsorted(bounds, x[rows, at], side="left")
        counts = np.bincount(place, minlength=len(bounds) + 1).cumsum()[:-1]
        sums = np.bincount(place, residual[rows], minlength=len(bounds) + 1).cumsum()[:-1]
        usable = (counts >= LEAST) & (size - counts >= LEAST)
        rest = np.maximum(size - counts, 1)
        gain = sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / rest - total**2 / size
        gain = np.where(usable, gain, 0)
        if gain.max() > best:
            best, found = gain.max(), (at, float(bounds[gain.argmax()]))
    return found


def propose(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules from boosted trees, each grown on a seeded half of the sample."""
    random = np.random.default_rng(SEED)
    levels = np.linspace(0, 1, CUTS + 2)[1:-1]
    cuts = [np.unique(np.quantile(x[:, at], levels)) for at in range(x.shape[1])]
    margin = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        residual = y - p
        half = np.sort(random.permutation(len(y))[: max(1, len(y) // 2)])
        grown: list[tuple[Rule, np.ndarray]] = [(frozenset(), half)]
        leaves = []
        for depth in range(DEPTH + 1):
            following = []
            for rule, rows in grown:
                split = _best_split(x, residual, rows, cuts) if depth < DEPTH else None
                if split is None:
                    leaves.append((rule, rows))
                    continue
                at, value = split
                below = x[rows, at] <= value
                for above, part in ((False, rows[below]), (True, rows[~below])):
                    child = rule | {Bound(NAMES[at], above, value)}
                    rules[child] = None
                    following.append((child, part))
            grown = following
        for rule, rows in leaves:
            if rule:
                step = residual[rows].sum() / max((p[rows] * (1 - p[rows])).sum(), 1e-3)
                margin[holds(rule, x)] += SHRINKAGE * np.clip(step, -4, 4)
    return list(rules)


def lasso(rules: list[Rule], x: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> Ensemble:
    """Weights of the rules by accelerated proximal gradient; most become zero."""
    constant = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not rules:
        return Ensemble(constant, {})
    design = np.column_stack([holds(rule, x) for rule in rules]).astype(float)
    centre = design.mean(axis=0)
    design -= centre
    scale = np.maximum(design.std(axis=0), 0.05)
    design /= scale
    step = 4 * len(y) / max(np.linalg.norm(design, 2) ** 2, 1e-9)
    weights = np.zeros(len(rules))
    point, moment = weights.copy(), 1.0
    base = constant
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(base + design @ point, -30, 30)))
        gradient = design.T @ (p - y) / len(y)
        base -= 4 * (p - y).mean()
        moved = point - step * gradient
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * moment**2)) / 2
        point = new + (moment - 1) / following * (new - weights)
        weights, moment = new, following
    kept = {r: float(w / s) for r, w, s in zip(rules, weights, scale, strict=True) if w}
    return Ensemble(float(base - (weights / scale * centre).sum()), kept)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_name: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most_texts: int = MOST_TEXTS,
) -> Ensemble:
    """Fit on labelled rows outside the held-out fold.

    All of them if there are no more than ``most_texts``, else about that many by
    a hash of the id; their statistics, some numbers each, come to the driver.
    Without labels of both classes the score is their share.
    """
    marked = (
        labels.select(column(id_name).alias("_id"), column(label).cast("int").alias("_label"))
        .filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
        .filter(fold("_id", FOLDS) != HELD_OUT)
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))  # the better of labels that contradict
    )
    share = int(min(1.0, most_texts / max(1, marked.count())) * 1_000_000)
    chosen = marked.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < share)
    texts = docs.select(column(id_name).alias("_id"), column(text).alias("text"))
    # At most about most_texts (id, label) rows are broadcast.
    sample = with_statistics(texts.join(F.broadcast(chosen), "_id"), "text")
    rows = sample.select("_id", "_label", "_stats.*").toArrow().sort_by("_id")
    x = np.column_stack([rows.column(n).to_numpy() for n in NAMES])
    y = rows.column("_label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Ensemble(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), {})
    return lasso(propose(x, y), x, y)


def score(docs: DataFrame, ensemble: Ensemble, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the score from 0 to 1 as its last column (in place of one of
    that name); a null text is empty."""
    rows = with_statistics(packed(docs, _content=column(text)), "_content")
    names = [F.col("_row")[n].alias(n) for n in docs.columns if n != name]
    return rows.select(*names, ensemble.column().alias(name))
