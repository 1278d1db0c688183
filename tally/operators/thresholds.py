"""Threshold search and evaluation.

A threshold grid is integer-built: t_i = (start + i * step) / denom, i < count —
the same doubles in every engine. Each score is mapped to its *slot* (how many
grid thresholds it clears) with arithmetic plus an exact one-step correction;
rows are then aggregated to (keys, slot) — a table of at most count + 1 rows per
group — and a running sum over slots gives the confusion counts at every grid
point. Work is one pass over the rows and one tiny shuffle; there is never a
rows x grid product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.operators import metrics as M


@dataclass(frozen=True)
class Grid:
    start: int
    step: int
    count: int
    denom: int

    def at(self, i: Column) -> Column:
        return (F.lit(self.start) + i * F.lit(self.step)).cast("double") / F.lit(float(self.denom))

    def values(self) -> list[float]:
        return [float(self.start + i * self.step) / self.denom for i in range(self.count)]


# The two grids of the reference — 0.10..0.94 by 0.01 (strict >),
# and 100 evenly spaced points on [0, 1] (inclusive >=).
GRID_A = Grid(10, 1, 85, 100)
GRID_B = Grid(0, 1, 100, 99)


def slot(score: Column, g: Grid, op: str) -> Column:
    """Number of grid thresholds t with score > t (op '>') or score >= t (op '>=')."""
    pos = (score * F.lit(float(g.denom)) - F.lit(float(g.start))) / F.lit(float(g.step))
    m = F.lit(g.count)
    if op == ">":
        c0 = F.least(F.greatest(F.ceil(pos).cast("int"), F.lit(0)), m)
        under = lambda t: t >= score  # noqa: E731  (threshold not cleared)
        over = lambda t: t < score
    else:
        c0 = F.least(F.greatest((F.floor(pos) + 1).cast("int"), F.lit(0)), m)
        under = lambda t: t > score
        over = lambda t: t <= score
    c1 = F.when((c0 > 0) & under(g.at(c0 - 1)), c0 - 1).otherwise(c0)
    return F.when((c1 < m) & over(g.at(c1)), c1 + 1).otherwise(c1)


def sweep_counts(df: DataFrame, keys: list[str], g: Grid, op: str = ">", score: str = "score",
                 label: str = "y") -> DataFrame:
    """M9 core: (keys, i, threshold, tp, fp, fn, tn) for every grid point."""
    s = df.where(F.col(score).isNotNull()).groupBy(*keys, slot(F.col(score), g, op).alias("_slot")).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("_neg"))
    # at most count + 1 slots per group: a bounded array, from which every grid point is read
    at = s.groupBy(*keys).agg(F.collect_list(F.struct("_slot", "_pos", "_neg")).alias("_slots"))
    at = at.select(*keys, "_slots", F.explode(F.sequence(F.lit(0), F.lit(g.count - 1))).alias("i"))

    def total(field: str, above: bool) -> Column:
        """Sum over the slots that clear grid point i (slot > i), or over those that do not."""
        keep = F.filter("_slots", lambda x: (x["_slot"] > F.col("i")) == F.lit(above))
        return F.aggregate(keep, F.lit(0).cast("long"), lambda acc, x: acc + x[field])

    return at.select(
        *keys, F.col("i").cast("int").alias("i"), g.at(F.col("i")).alias("threshold"), total("_pos", True).alias("tp"),
        total("_neg", True).alias("fp"), total("_pos", False).alias("fn"), total("_neg", False).alias("tn"))


def threshold_sweep(df: DataFrame, keys: list[str], g: Grid = GRID_A, op: str = ">", score: str = "score",
                    label: str = "y") -> DataFrame:
    """M9: accuracy / precision / recall / F1 at every grid point."""
    return M.with_rates(sweep_counts(df, keys, g, op, score, label))


def best_f1_threshold(sweep: DataFrame, keys: list[str], default: float = 0.5) -> DataFrame:
    """First grid point with the highest F1 (strict improvement); ``default`` if no F1 > 0."""
    top = _top1(sweep, keys, F.struct("f1", (-F.col("threshold")).alias("t")), ["threshold", "f1"])
    return top.select(*keys, F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(default))
                      .alias("best_threshold"), F.col("f1").alias("best_f1"))


def _top1(df: DataFrame, keys: list[str], best: Column, cols: list[str], largest: bool = True) -> DataFrame:
    """Row with the largest (or smallest) ``best`` per group, as a distributed aggregate.

    ``max_by`` / ``min_by`` combine map-side, so a group with billions of curve
    points is never gathered in one task (a ranked window would be). ``best``
    is a struct whose later fields break ties.
    """
    pick = (F.max_by if largest else F.min_by)(F.struct(*cols), best)
    return df.groupBy(*keys).agg(pick.alias("_top")).select(*keys, "_top.*")


def pr_best_f1_threshold(df: DataFrame, keys: list[str], score: str = "score", label: str = "y",
                         pr: DataFrame | None = None) -> DataFrame:
    """Argmax of 2PR/(P+R+1e-10) over the exact PR points (lowest threshold on ties).

    ``pr``: a PR curve already computed for ``df`` (several searches can share one).
    """
    pr = (pr if pr is not None else M.pr_curve(df, keys, score, label)).where(F.col("threshold").isNotNull())
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-10))
    pr = pr.withColumn("f1", f1)
    return _top1(pr, keys, F.struct("f1", (-F.col("threshold")).alias("t")), ["threshold", "f1"])


def youden_threshold(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Argmax of tpr - fpr on the ROC curve (highest threshold on ties, as the curve descends)."""
    roc = M.roc_curve(df, keys, score, label).withColumn("j", F.col("tpr") - F.col("fpr"))
    return _top1(roc, keys, F.struct("j", "threshold"), ["threshold", "tpr", "fpr", "j"])


def target_threshold(df: DataFrame, keys: list[str], target: float, on: str = "recall", score: str = "score",
                     label: str = "y", pr: DataFrame | None = None) -> DataFrame:
    """PR point nearest to a target recall or precision (lowest threshold on ties)."""
    pr = (pr if pr is not None else M.pr_curve(df, keys, score, label)).where(F.col("threshold").isNotNull())
    pr = pr.withColumn("dist", F.abs(F.col(on) - F.lit(float(target))))
    return _top1(pr, keys, F.struct("dist", "threshold"), ["threshold", on, "dist"], largest=False)


def evaluate_thresholds(df: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "score",
                        label: str = "y", op: str = ">") -> DataFrame:
    """Confusion + metrics of each named threshold (thresholds: keys, name, threshold).

    Rows are first reduced to score groups, so the join with the (small, fixed
    number of) named thresholds multiplies distinct scores, not rows.
    """
    g = M.score_groups(df, keys, score, label)
    if keys:
        j = g.join(thresholds, keys)
    else:  # the named thresholds as one array value
        named = thresholds.select(F.collect_list(F.struct("name", "threshold"))).scalar()
        j = g.withColumn("_t", F.explode(named)).select("*", "_t.name", "_t.threshold").drop("_t")
    pred = (F.col("score") > F.col("threshold")) if op == ">" else (F.col("score") >= F.col("threshold"))
    cm = j.groupBy(*keys, "name", "threshold").agg(
        F.sum(F.when(pred, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(pred, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~pred, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~pred, F.col("neg")).otherwise(0)).alias("tn"))
    return M.with_rates(cm)
