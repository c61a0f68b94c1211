"""Subgroup and tier reports, flags, cohort tables and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stash
from .quantiles import quantiles, wide
from .stats import quantile, rank_first

#: Fewest samples for a headline, and the thresholds of the tiers.
FEWEST = 2
MEDIAN_DROP, NEGATIVE_RISE = 0.05, 0.05
ROBUST_FLOOR, LTM_CEILING, INTERNAL_DROP, NEGATIVE_FLOOR, POCKET_SAMPLES, POCKET_COUNT = 0.07, -0.05, 0.10, 0.15, 10, 3
ENRICHED, SEVERE_GAP = 2.0, 0.10
SUPPORT_FLOOR, OO_HIGH, LTM_GAP = 0.75, 0.10, 0.20


def subgroups(rows: DataFrame, alpha: float = 0.1) -> DataFrame:
    """rows: sample_id, label, confounder, margin. For every stratum, label and confounder: its own and the rest's statistics and its part in the tail
    (the first ceil(alpha n) rows by margin, then sample_id)."""
    good = stash(rows.where(F.col("margin").isNotNull()).select("sample_id", "label", "confounder", "margin"), "margins")
    n = good.count()
    tail_size = max(1, -(-int(round(alpha * n * 1e9)) // 10**9))
    good = good.withColumn("tail", _in_tail(good, n, tail_size))
    scopes = F.explode(F.array(
        F.struct(F.lit("stratum").alias("scope"), F.col("label").alias("l"), F.col("confounder").alias("c")),
        F.struct(F.lit("label").alias("scope"), F.col("label").alias("l"), F.lit("").alias("c")),
        F.struct(F.lit("confounder").alias("scope"), F.lit("").alias("l"), F.col("confounder").alias("c")),
    ))
    long = good.withColumn("s", scopes).select("sample_id", "margin", "tail", "s.scope", F.col("s.l").alias("label"), F.col("s.c").alias("confounder"))
    x, key = F.col("margin"), ["scope", "label", "confounder"]
    # labels, confounders and their products are not null: the scopes have one row each
    q = wide(long, "margin", {"q": alpha, "median": 0.5}, by=["scope"], group=key[1:], written=True)
    own = long.join(q, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.max("median").alias("median"), F.sum((x < 0).cast("long")).alias("n_negative"), F.sum(x).alias("total"),
        F.sum(F.col("tail").cast("long")).alias("n_tail"), F.avg(F.when(F.col("tail"), x)).alias("tail_mean"), F.coalesce(F.sum(F.when(F.col("tail"), x)), F.lit(0.0)).alias("tail_total"),
        F.max("q").alias("quantile"), F.avg(F.when(x <= F.col("q"), x)).alias("ltm"),
    )
    whole = good.agg(F.sum("margin").alias("W"), F.sum((x < 0).cast("long")).alias("WN"), F.sum(F.when(F.col("tail"), x)).alias("WT"))
    rest = wide(long, "margin", {"rest_median": 0.5}, by=["scope"], group=key[1:], rest=True, written=True)
    out = own.crossJoin(F.broadcast(whole)).join(rest, key, "left")  # whole is one row
    others = F.when(F.lit(n) > F.col("n"), F.lit(n) - F.col("n"))
    rest_tail = F.when(F.lit(tail_size) > F.col("n_tail"), F.lit(tail_size) - F.col("n_tail"))
    return out.select(
        *key, "n", "mean", "median", "n_negative", (F.col("n_negative") / F.col("n")).alias("negative"), "quantile", "ltm",
        ((F.col("W") - F.col("total")) / others).alias("rest_mean"), "rest_median", ((F.col("WN") - F.col("n_negative")) / others).alias("rest_negative"),
        "n_tail", (F.col("n_tail") / F.col("n")).alias("tail_prevalence"), (F.col("n_tail") / F.col("n") / F.lit(tail_size / max(n, 1))).alias("tail_ratio"),
        (F.col("n_tail") / F.lit(tail_size)).alias("tail_share"), "tail_mean", ((F.col("WT") - F.col("tail_total")) / rest_tail).alias("rest_tail_mean"), (F.col("median") - F.col("ltm")).alias("internal_drop"),
    )


def _in_tail(good: DataFrame, n: int, size: int) -> Column:
    """Whether a row is among the first `size` by margin, then sample_id. The margin at that place is an exact quantile; only rows that have just that margin are put
    in order."""
    at = quantile(good, "margin", (size - 1) / max(1, n - 1))
    if at is None:
        return F.lit(True)
    # the quantile is computed with rounding: the value itself is the greatest one not above it
    at = good.where(F.col("margin") <= at + 1e-12 * (1 + abs(at))).agg(F.max("margin").alias("m")).first()["m"]
    before = good.where(F.col("margin") < at).count()
    if before >= size:  # rounding led one value too far
        at = good.where(F.col("margin") < at).agg(F.max("margin").alias("m")).first()["m"]
        before = good.where(F.col("margin") < at).count()
    last = good.where(F.col("margin") == at).orderBy("sample_id").limit(size - before).agg(F.max("sample_id").alias("s")).first()["s"]
    return (F.col("margin") < at) | ((F.col("margin") == at) & (F.col("sample_id") <= last))


def tiers(groups: DataFrame) -> DataFrame:
    """Adds tier1 (against the rest), tier2 (within), severity and tier3 (in the tail)."""
    c = F.col
    weak = (c("median") - c("rest_median") <= -MEDIAN_DROP) & (c("negative") - c("rest_negative") >= NEGATIVE_RISE)
    tier1 = (
        F.when(c("n") < FEWEST, "insufficient_support")
        .when(weak & (c("median") < 0) & (c("rest_median") >= 0), "broad_weakness")
        .when(weak & (c("median") >= 0) & (c("rest_median") >= 0), "relative_weakness")
        .when(weak & (c("median") < 0) & (c("rest_median") < 0), "aggravated_weakness")
        .otherwise("neutral")
    )
    pocket = (c("ltm") <= LTM_CEILING) & (c("internal_drop") >= INTERNAL_DROP) & (c("negative") >= NEGATIVE_FLOOR) & (c("n_negative") >= POCKET_COUNT)
    tier2 = (
        F.when(c("n") < POCKET_SAMPLES, "insufficient_support")
        .when(pocket & (c("median") < 0), "aggravated_weakness")
        .when(pocket & (c("median") >= ROBUST_FLOOR), "hidden_pocket")
        .when((c("median") >= ROBUST_FLOOR) & (c("ltm") >= 0) & (c("internal_drop") >= INTERNAL_DROP), "internal_spread")
        .otherwise("neutral")
    )
    gap = c("tail_mean") - c("rest_tail_mean")
    severity = F.when(c("n_tail") == 0, "no_tail_samples").when(gap.isNull(), "no_rest_tail").when(gap <= -SEVERE_GAP, "more severe").when(gap >= SEVERE_GAP, "not more severe").otherwise("similar")
    rich, severe = c("tail_ratio") >= ENRICHED, c("severity") == "more severe"
    tier3 = F.when(c("n") < FEWEST, "insufficient_support").when(rich & severe, "tail_enriched_and_severe").when(rich, "tail_enriched").when(severe, "tail_severe").otherwise("neutral")
    return groups.withColumn("tier1", tier1).withColumn("tier2", tier2).withColumn("severity", severity).withColumn("tier3", tier3)


def action_flags(models: DataFrame) -> DataFrame:
    """models: model, support, undefined_oo, margin, ltm. One row for each model and flag."""
    parts = [
        models.where(F.col("support") <= SUPPORT_FLOOR).select("model", F.lit("coverage_risk").alias("flag"), F.lit("high").alias("severity"), F.col("support").alias("value"), F.lit(SUPPORT_FLOOR).alias("threshold")),
        models.where(F.col("undefined_oo") >= OO_HIGH).select("model", F.lit("poor_embedding").alias("flag"), F.lit("high").alias("severity"), F.col("undefined_oo").alias("value"), F.lit(OO_HIGH).alias("threshold")),
        models.where(F.col("margin") - F.col("ltm") >= LTM_GAP).select("model", F.lit("tail_gap").alias("flag"), F.lit("medium").alias("severity"), (F.col("margin") - F.col("ltm")).alias("value"), F.lit(LTM_GAP).alias("threshold")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = F.row_number().over(Window.partitionBy("model", "flag").orderBy("severity", F.desc("value")))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def cohort_ranks(table: DataFrame) -> DataFrame:
    """table: cohort, model, margin. Per model its rank in each cohort (ties by model) and the mean rank, for models present in all."""
    ranked = table.where("margin is not null").withColumn("rank", rank_first("margin", "model", ("cohort",)))
    cohorts = table.select("cohort").distinct()
    mean = ranked.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.avg("margin").alias("mean_margin"), F.count(F.lit(1)).alias("n"))
    full = mean.crossJoin(F.broadcast(cohorts.agg(F.count(F.lit(1)).alias("all")))).where("n = all").drop("all", "n")  # one row
    return full.withColumn("place", F.row_number().over(Window.orderBy("mean_rank", "model")))


def compare_runs(a: DataFrame, b: DataFrame, keys, values) -> DataFrame:
    """Rows of both runs with the changes of their values, the largest total change first."""
    joined = a.select(*keys, *values).join(b.select(*keys, *(F.col(v).alias(f"{v}_b") for v in values)), [*keys])
    rows = joined.withColumns({f"delta_{v}": F.col(f"{v}_b") - F.col(v) for v in values})
    return rows.withColumn("change", sum((F.abs(f"delta_{v}") for v in values), F.lit(0.0))).orderBy(F.desc("change"), *keys)


def overlap_odds(rows: DataFrame, inside: str, value: str = "margin") -> DataFrame:
    """Medians inside and outside a set, as odds (1 + c) / (1 - c), and their ratio."""
    found = quantiles(rows, value, 0.5, by=[inside])
    m = found.agg(F.max(F.when(F.col(inside), F.col("x"))).alias("inside"), F.max(F.when(~F.col(inside), F.col("x"))).alias("outside"))
    odds = lambda c: (1 + F.col(c)) / (1 - F.col(c))
    return m.withColumn("odds_inside", odds("inside")).withColumn("odds_outside", odds("outside")).withColumn("boost", odds("inside") / odds("outside"))


def margin_scale(table: DataFrame, value: str) -> DataFrame:
    """Ratios become margins: values over one and none below zero are ratios r, (r - 1) / (r + 1)."""
    s = table.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    ratio = (F.col("_low") >= 0) & (F.col("_high") > 1 + 1e-9)
    return table.crossJoin(F.broadcast(s)).withColumn(value, F.when(ratio, (F.col(value) - 1) / (F.col(value) + 1)).otherwise(F.col(value))).drop("_low", "_high")  # one row
