"""Ranks, correlations, frontiers, histograms and seeded resampling.

Draws come from numpy's generators: those of bootstraps on the driver (a bounded number of clusters and replicates is a parameter of the study), those from cells in a task.
They go to Spark as a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import finite
from ..sources.shared import stash
from .quantiles import wide


def rank_first(value: str, tie: str, by=()) -> Column:
    """Descending integer ranks, equal values by `tie`."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), tie))


def rank_average(value: str, by=()) -> Column:
    same = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2


def corr(a: str, b: str) -> Column:
    """The correlation of columns without nulls, NaN where one of them is constant (Spark's own raises there)."""
    return F.when(F.count(F.lit(1)) > 1, F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(math.nan)))


def spearman(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    good = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = good.withColumn("ra", rank_average(a, by)).withColumn("rb", rank_average(b, by))
    return rows.groupBy(*by).agg(corr("ra", "rb").alias("spearman"), corr(a, b).alias("pearson"), F.count(F.lit(1)).alias("n"))


def frontier(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Rows that no other row matches or beats in both; of equal rows one."""
    w = Window.partitionBy(*by).orderBy(F.desc(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(y).over(w)).where(F.col("_best").isNull() | (F.col(y) > F.col("_best"))).drop("_best")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins; finite values outside go to the edge bins, so none of them is lost. Nulls, NaN and infinities have no bin."""
    at = F.least(F.greatest(F.greatest(F.least((F.col(column) - low) / ((high - low) / bins), F.lit(float(bins))), F.lit(-1.0)).cast("long"), F.lit(0)), F.lit(bins - 1))
    count = df.where(finite(F.col(column)).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(count, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.withColumn("ra", F.sum("o").over(Window.partitionBy(a))).withColumn("rb", F.sum("o").over(Window.partitionBy(b)))
    # chi2 / n = sum o^2 / (ra rb) - 1, so empty cells need no rows
    return rows.agg((F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))) - 1).alias("phi2"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c")).select(
        F.sqrt(F.greatest("phi2", F.lit(0.0)) / (F.least("r", "c") - 1)).alias("cramers_v")
    )


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line, or nulls for fewer than three points or constant x."""
    good = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    rows = good.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("var"))
    ok = (F.col("n") >= 3) & (F.col("var") > 0)
    return rows.select(F.when(ok, F.col("slope")).alias("slope"), F.when(ok, F.col("intercept")).alias("intercept"))


def t_probability(t: float, df: int) -> float:
    """P(|T| <= t) of Student's t with whole degrees of freedom, by its finite sum."""
    angle = math.atan(t / math.sqrt(df))
    cos, total, term = math.cos(angle), 0.0, 1.0
    if df % 2:
        term = cos
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= cos * cos * 2 * k / (2 * k + 1)
        return 2 / math.pi * (angle + math.sin(angle) * total)
    for k in range(df // 2):
        total += term
        term *= cos * cos * (2 * k + 1) / (2 * k + 2)
    return math.sin(angle) * total


@cache
def t_quantile(df: int, level: float = 0.95) -> float:
    """t with P(|T| <= t) = level, by bisection."""
    low, high = 0.0, 1e4
    while high - low > 1e-12 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if t_probability(middle, df) < level else (low, middle)
    return high


#: Degrees of freedom up to which the beta function is tabled, and steps of the continued fraction.
TABLED, STEPS = 200, 200
#: Degrees of freedom up to which quantiles are exact, and the normal quantile that the series beyond starts from.
EXACT, Z975 = 60, 1.959963984540054


def _t975(df: Column) -> Column:
    z, out = Z975, F.lit(Z975)
    series = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    for power, c in enumerate(series, 1):
        out = out + F.lit(c) / F.pow(df, F.lit(float(power)))
    exact = F.array(*(F.lit(t_quantile(n)) for n in range(1, EXACT + 1)))
    return F.when(df <= EXACT, F.get(exact, (df - 1).cast("int"))).otherwise(out)


def _beta_half(df: Column) -> Column:
    """The beta function of df / 2 and 1 / 2: exact values for small df, beyond them the series of the ratio of gamma functions."""
    exact = F.array(*(F.lit(math.exp(math.lgamma(n / 2) + math.lgamma(0.5) - math.lgamma((n + 1) / 2))) for n in range(1, TABLED + 1)))
    i = 2 / df
    series = F.sqrt(F.lit(math.pi) * i) * (1 + i / 8 + i**2 / 128 - 5 * i**3 / 1024 - 21 * i**4 / 32768)
    return F.when(df <= TABLED, F.get(exact, (df - 1).cast("int"))).otherwise(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, STEPS pairs of terms from the front (Lentz)."""
    one = F.lit(1.0)

    def add(s: Column, term: Column) -> Column:
        d = one / (1 + term * s["d"])
        c = 1 + term / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return F.element_at(F.transform(F.array(add(s, even)), lambda t: add(t, odd)), 1)

    first = one / (1 - (a + b) * x / (a + 1))
    start = F.struct(one.alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double")), start, step, lambda s: s["h"])


def t_tail(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t, as a column: the regularised incomplete beta function."""
    df, square = df.cast("double"), t * t
    x, y, half = df / (df + square), square / (df + square), F.lit(0.5)
    front = F.coalesce(F.exp(df / 2 * F.ln(x) + F.ln(y) / 2) / _beta_half(df), F.lit(0.0))  # the logarithm of zero is null
    near = 1 - 2 * front * _fraction(half, df / 2, y)
    return F.when(df >= 1, F.when(x < (df + 2) / (df + 5), 2 * front * _fraction(df / 2, half, x) / df).otherwise(near))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n points; null for fewer than three."""
    bounded = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
    t = bounded * F.sqrt((n - 2) / (1 - bounded * bounded))
    return F.when(n > 2, F.when(F.isnan(r), F.lit(math.nan)).when(F.abs(bounded) >= 1, 0.0).otherwise(t_tail(t, n - 2)))


def correlations(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """spearman, pearson and n as `spearman` gives them, with the p-value of each."""
    rows = spearman(df, a, b, by)
    return rows.select(*by, "n", "pearson", correlation_p(F.col("pearson"), F.col("n")).alias("pearson_p"), "spearman", correlation_p(F.col("spearman"), F.col("n")).alias("spearman_p"))


def density(df: DataFrame, value: str, by=(), points: int = 64) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth, n ** (-1 / 5) sample deviations, at equally spaced points from the least to the greatest finite value: by, at, density.
    One pass adds up the kernels of all points, which are a bounded number; groups without two different values have none."""
    good = df.select(*by, finite(F.col(value)).alias("x")).where("x is not null")
    shape = good.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd")).where("low < high")
    shape = shape.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    rows = good.join(shape, [*by]) if by else good.crossJoin(F.broadcast(shape))  # one row
    at = lambda i: F.col("low") + (F.col("high") - F.col("low")) * (i / max(1, points - 1))
    sums = [F.sum(F.exp(-0.5 * F.pow((at(i) - F.col("x")) / F.col("h"), F.lit(2.0)))).alias(f"k{i}") for i in range(points)]
    found = rows.groupBy(*by).agg(*sums, *(F.max(c).alias(c) for c in ("low", "high", "n", "h")))
    each = F.explode(F.array(*(F.struct(at(i).alias("at"), (F.col(f"k{i}") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density")) for i in range(points))))
    return found.where("n is not null").select(*by, each.alias("p")).select(*by, "p.at", "p.density")


def t_interval(df: DataFrame, value: str, by=()) -> DataFrame:
    """Mean and 95 % interval; of a single value only the mean."""
    rows = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    half = F.when(F.col("n") > 1, _t975(F.col("n") - 1) * F.col("sd") / F.sqrt("n"))
    return rows.select(*by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "n")


def quantile(df: DataFrame, value: str, q: float) -> float | None:
    """The exact quantile (linear) of the finite values, or None. Approximate quantiles give a narrow band; rows outside of it are only counted, so no task holds all
    values. A band that misses (never by the approximation's error bound) is widened to everything."""
    good = df.select(finite(F.col(value)).alias("x")).where("x is not null")
    for half in (0.002, 0.5):
        band = good.agg(F.percentile_approx("x", [max(0.0, q - half), min(1.0, q + half)], 5_000).alias("q")).first()["q"]
        if band is None:
            return None
        low, high = band if half < 0.5 else (-math.inf, math.inf)
        inside = (F.col("x") >= low) & (F.col("x") <= high)
        r = good.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x") < low).cast("long")).alias("below"), F.sum(inside.cast("long")).alias("within")).first()
        at = (r["n"] - 1) * q - r["below"]
        if at >= 0 and math.ceil(at) < r["within"]:
            return good.where(inside).agg(F.percentile("x", F.lit(at / max(1, r["within"] - 1))).alias("v")).first()["v"]
    return None


def _each_draw(clusters: int, n: int, seed: int) -> Iterator[np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, clusters, clusters) for _ in range(n))


def draws(clusters: list[str], n: int, seed: int) -> np.ndarray:
    """n rows of cluster numbers, drawn with replacement from the sorted clusters."""
    return np.stack([*_each_draw(len(clusters), n, seed)])


class Draws(NamedTuple):
    """How often each replicate takes each cluster: the clusters' names, the replicates' numbers, and replicates times clusters in the smallest whole-number type."""

    names: list[str]
    reps: np.ndarray
    times: np.ndarray


def draw_counts(df: DataFrame, cluster: str, n: int, seed: int) -> Draws:
    """Counts alone: a byte or two for each replicate and cluster."""
    names = sorted(r[0] for r in df.select(cluster).distinct().collect())
    times = []
    for drawn in _each_draw(len(names), n, seed):
        row = np.bincount(drawn, minlength=len(names))
        times.append(row.astype(np.min_scalar_type(row.max(initial=0))))
    return Draws(names, np.arange(n), np.stack(times))


#: The number of the replicate that is the table itself.
WHOLE = -1


def with_whole(taken: Draws) -> Draws:
    """One replicate more, first, that takes each cluster once."""
    return Draws(taken.names, np.append(WHOLE, taken.reps), np.vstack([np.ones((1, len(taken.names)), taken.times.dtype), taken.times]))


def draw_table(df: DataFrame, cluster: str, n: int, seed: int) -> DataFrame:
    """rep, cluster, times: the same counts as a table, without zeros."""
    names, reps, times = draw_counts(df, cluster, n, seed)
    at, of = np.nonzero(times)
    rows = [(int(reps[r]), names[c], int(times[r, c])) for r, c in zip(at, of, strict=True)]
    return df.sparkSession.createDataFrame(rows, f"rep int, {cluster} string, times long")


def _counted(taken: DataFrame, cluster: str) -> Draws:
    drawn = taken.toPandas()
    reps, at = np.unique(drawn["rep"].to_numpy(int), return_inverse=True)
    names = sorted(drawn[cluster].unique())
    times = np.zeros((len(reps), len(names)), np.min_scalar_type(int(drawn["times"].max()) if len(drawn) else 0))
    times[at, drawn[cluster].map({c: i for i, c in enumerate(names)}).to_numpy(int)] = drawn["times"]
    return Draws(names, reps, times)


#: Values of a range of medians, about; ranges at most, the accuracy of the sketch that cuts them, and numbers that a step over replicates holds at once.
RANGE, RANGES, ACCURACY, CELLS = 2_000, 4_096, 20_000, 4_000_000


def weighted_medians(df: DataFrame, taken: DataFrame | Draws, cluster: str, value: str, by=()) -> DataFrame:
    """Median of each replicate's pooled rows, exactly. Equal values of a cluster are one row with a count; values are cut into ranges, and counts by cluster and range, times
    the draws, tell in which range a replicate's middle rows lie and at which place there: first among parts of some 90 ranges each, then among a part's ranges, so that a
    task's counts are the clusters times 91 at most. Each such range is then put in order once for all replicates, so rows are never joined with replicates. The draws,
    replicates times clusters, go to every task."""
    by, spark = [*by], df.sparkSession
    names, reps, times = taken if isinstance(taken, Draws) else _counted(taken, cluster)
    index = F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(names)], "name string, c int"))
    key = {"all_": "int"} | {f"by{i}": df.schema[c].dataType.simpleString() for i, c in enumerate(by)}
    rows = df.select(F.lit(0).alias("all_"), *(F.col(c).alias(f"by{i}") for i, c in enumerate(by)), F.col(cluster).alias("name"), finite(F.col(value)).alias("x"))
    rows = rows.dropna(subset=[*key, "x"]).join(index, "name")
    rows = stash(rows.groupBy(*key, "c", "x").agg(F.count(F.lit(1)).alias("n")), "values")
    most = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    cuts = min(RANGES, math.ceil(most / RANGE) + 1)
    cut = rows.groupBy(*key).agg(F.percentile_approx("x", F.array(*(F.lit(i / cuts) for i in range(1, cuts + 1))), ACCURACY).alias("b"))
    bounds = {tuple(r[c] for c in key): np.unique(r["b"]) for r in cut.collect()}  # ranges of each group
    shared = spark.sparkContext.broadcast((reps, times, bounds))
    types = ", ".join(f"{c} {t}" for c, t in key.items())

    def deal(batches):
        for pdf in batches:
            pdf["bin"] = 0
            for group, at in pdf.groupby([*key], dropna=False).indices.items():
                b, x = shared.value[2][group if isinstance(group, tuple) else (group,)], pdf["x"].to_numpy()[at]
                # a bound's own value is a range by itself
                pdf.iloc[at, pdf.columns.get_loc("bin")] = np.searchsorted(b, x, "left") + np.searchsorted(b, x, "right")
            yield pdf

    def table(pdf: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the column in order, the clusters, and the clusters' running counts."""
        values, at = np.unique(pdf[column].to_numpy(), return_inverse=True)
        clusters, of = np.unique(pdf["c"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(clusters), len(values)))
        np.add.at(counts, (of, at), pdf["n"].to_numpy())
        return values, clusters, counts.cumsum(axis=1)

    def find(upto: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a row's running counts pass the place p, and the place there."""
        at = (upto <= p[:, None]).sum(axis=1)
        return at, p - np.where(at > 0, upto[np.arange(len(at)), at - 1], 0)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, clusters, counts = table(pdf, "part")
        out = []
        for some in np.array_split(np.arange(len(reps)), len(reps) // 256 + 1):
            upto = shared.value[1][np.ix_(some, clusters)].astype(float) @ counts
            some, upto = some[upto[:, -1] > 0], upto[upto[:, -1] > 0]
            for side, p in enumerate((np.floor((upto[:, -1] - 1) / 2), np.ceil((upto[:, -1] - 1) / 2))):
                at, left = find(upto, p)
                out.append(pd.DataFrame({"r": some, "side": side, "part": parts[at], "p": left}))
        return pd.concat(out).assign(**{c: pdf[c].iloc[0] for c in key})

    def second(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        bins, clusters, counts = table(pdf, "bin")
        bin_, left = np.empty(len(asked), np.int64), np.empty(len(asked))
        for some in np.array_split(np.arange(len(asked)), len(asked) // 256 + 1):
            upto = shared.value[1][np.ix_(asked["r"].to_numpy()[some], clusters)].astype(float) @ counts
            at, left[some] = find(upto, asked["p"].to_numpy()[some])
            bin_[some] = bins[at]
        return asked.drop(columns="part").assign(bin=bin_, p=left)

    def settle(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        c, n, x = (pdf[k].to_numpy() for k in ("c", "n", "x"))
        out = np.empty(len(asked))
        for some in np.array_split(np.arange(len(asked)), min(len(asked), len(asked) * len(pdf) // CELLS + 1)):
            upto = (shared.value[1][np.ix_(asked["r"].to_numpy()[some], c)] * n).cumsum(axis=1)
            out[some] = x[find(upto, asked["p"].to_numpy()[some])[0]]
        return asked.drop(columns=["r", "p"]).assign(rep=shared.value[0][asked["r"]], x=out)

    dealt = rows.mapInPandas(deal, f"{types}, c int, x double, n long, bin int")
    per = math.isqrt(2 * cuts) + 1  # ranges of a part, about as many as there are parts
    counts = stash(dealt.groupBy(*key, "bin", "c").agg(F.sum("n").alias("n")).withColumn("part", F.floor(F.col("bin") / per).cast("int")), "counts")
    asked = counts.groupBy(*key, "part", "c").agg(F.sum("n").alias("n")).groupBy(*key).applyInPandas(first, f"{types}, r int, side int, part int, p double")
    asked = stash(asked, "asked")  # replicates of each group
    near = counts.join(F.broadcast(asked.select(*key, "part").distinct()), [*key, "part"], "left_semi")
    asked = near.groupBy(*key, "part").cogroup(asked.groupBy(*key, "part")).applyInPandas(second, f"{types}, r int, side int, bin int, p double")
    asked = stash(asked, "asked")
    held = dealt.join(F.broadcast(asked.select(*key, "bin").distinct()), [*key, "bin"], "left_semi")  # ranges of each group
    found = held.groupBy(*key, "bin").cogroup(asked.groupBy(*key, "bin")).applyInPandas(settle, f"{types}, rep int, side int, bin int, x double")
    medians = found.groupBy("rep", *key).agg(((F.min("x") + F.max("x")) / 2).alias("median"))
    return medians.select("rep", *(F.col(f"by{i}").alias(c) for i, c in enumerate(by)), "median")


def interval(reps: DataFrame, value: str, level: float = 0.95, by=()) -> DataFrame:
    low = (1 - level) / 2
    return reps.groupBy(*by).agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(1 - low)).alias("high"), F.count(value).alias("n_reps"))


def _with_point(reps: DataFrame, value: str, level: float) -> DataFrame:
    """The value of the table itself, and the interval of the other replicates."""
    reps = stash(reps, "replicates")
    point = reps.agg(F.max(F.when(F.col("rep") == WHOLE, F.col(value))).alias("point"))
    return point.crossJoin(interval(reps.where(F.col("rep") != WHOLE), value, level))  # one row each


def bootstrap_median(df: DataFrame, value: str, cluster: str, *, n: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    return _with_point(weighted_medians(df, with_whole(draw_counts(df, cluster, n, seed)), cluster, value), "median", level)


def bootstrap_delta(df: DataFrame, a: str, b: str, cluster: str, *, n: int = 2000, seed: int = 0, level: float = 0.95, subset: str | None = None) -> DataFrame:
    """median(b) - median(a) with shared draws; with subsets, medians of the subsets' medians. Both columns are searched at once, and without subsets the table itself is one
    more replicate."""
    taken, by = draw_counts(df, cluster, n, seed), ["subset"] if subset else []

    def over(meds: DataFrame, keys: list[str]) -> DataFrame:
        out = meds.groupBy(*keys).agg(F.median("a").alias("a"), F.median("b").alias("b")) if by else meds
        return out.select(*keys, (F.col("b") - F.col("a")).alias("delta"))

    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).cast("double").alias("x")) for side, c in (("a", a), ("b", b)))))
    rows = df.select(F.col(cluster).alias("cluster"), *(F.col(subset).alias(c) for c in by), sides.alias("v")).select("cluster", *by, "v.side", "v.x")
    meds = weighted_medians(rows, taken if by else with_whole(taken), "cluster", "x", [*by, "side"])
    meds = meds.groupBy("rep", *by).agg(*(F.max(F.when(F.col("side") == side, F.col("median"))).alias(side) for side in "ab")).where("a is not null and b is not null")
    if not by:
        return _with_point(over(meds, ["rep"]), "delta", level)
    own = [wide(df, c, {side: 0.5}, by=[subset]) for side, c in (("a", a), ("b", b))]
    point = over(own[0].join(own[1], subset, "outer"), [])
    return point.withColumnRenamed("delta", "point").crossJoin(interval(over(meds, ["rep"]), "delta", level))  # one row each


def rank_stability(df: DataFrame, model: str, value: str, cluster: str, *, n: int = 2000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per model its mean rank and 95 % ranks over replicates with shared draws; per ordered pair how often the first has the larger median."""
    order = df.select(model).distinct()
    meds = weighted_medians(df, draw_counts(df, cluster, n, seed), cluster, value, (model,))
    whole = order.crossJoin(meds.select("rep").distinct()).join(meds, ["rep", model], "left")  # models times replicates
    ranks = whole.withColumn("rank", rank_first("median", model, ("rep",)))
    summary = ranks.groupBy(model).agg(F.avg("rank").alias("mean_rank"), F.percentile("rank", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(model, "mean_rank", F.col("q")[0].cast("int").alias("low_rank"), F.col("q")[1].cast("int").alias("high_rank"))
    a, b = ranks.alias("a"), ranks.alias("b")
    wins = a.join(b, (F.col("a.rep") == F.col("b.rep")) & (F.col(f"a.{model}") != F.col(f"b.{model}")))
    pairs = wins.groupBy(F.col(f"a.{model}").alias("model_a"), F.col(f"b.{model}").alias("model_b")).agg(F.avg(F.coalesce(F.col("a.median") > F.col("b.median"), F.lit(False)).cast("double")).alias("p_win"))
    return summary, pairs


def bootstrap_spearman(pairs: list[tuple[float, float]], *, n: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float, float]:
    """Resamples the few (x, y) points of a panel; NaN below three points."""
    if len(pairs) < 3:
        return math.nan, math.nan, math.nan
    x = np.array(pairs, float)

    def rho(rows: np.ndarray) -> float:
        if len(np.unique(rows[:, 0])) < 2 or len(np.unique(rows[:, 1])) < 2:
            return math.nan
        ranks = []
        for c in rows.T:
            _, inverse, count = np.unique(c, return_inverse=True, return_counts=True)
            ranks.append((np.cumsum(count) - (count - 1) / 2)[inverse])
        return float(np.corrcoef(*ranks)[0, 1])

    rng = np.random.default_rng(seed)
    reps = [rho(x[rng.integers(0, len(x), len(x))]) for _ in range(n)]
    low, high = np.nanpercentile(reps, [100 * (1 - level) / 2, 100 * (1 + level) / 2])
    return rho(x), float(low), float(high)


def seeded_pick(df: DataFrame, key: str, seed: str, by=()) -> DataFrame:
    """One row of each cell: that with the smallest SHA-256 of seed, cell and key."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *by, F.col(key).cast("string")), 256)
    return df.withColumn("_h", h).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))).where("_n = 1").drop("_h", "_n")


def stratified_quota(df: DataFrame, n: int, by) -> DataFrame:
    """Seats of each stratum by largest remainder; equal remainders in order of the strata."""
    by = [by] if isinstance(by, str) else [*by]
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(Window.partitionBy())
    rows = rows.withColumn("exact", F.col("size") * n / total).withColumn("seats", F.floor("exact"))
    left = F.lit(n) - F.sum("seats").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("seats"), 12)), *by))
    return rows.withColumn("left", left).withColumn("place", place).select(*by, "size", (F.col("seats") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def placed(df: DataFrame, key: str, by) -> DataFrame:
    """Rows with their place, from 0, in each cell in order of a key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1)


def _cell_values(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)


def _drawn(df: DataFrame, by: list[str], cells: list[tuple], seed: int, draw) -> DataFrame:
    """cells: values, size and wanted rows of each, in the order in which one generator serves them; draw(generator, size, wanted) gives places. The draws are made in one task,
    which holds one cell's permutation at a time, and written from there as a table of places."""
    fields = [f.name for f in df.select(*by).schema]

    def run(batches):
        for batch in batches:
            rng = np.random.default_rng(seed)
            for *cell, size, n in cells if len(batch) else ():
                places = draw(rng, size, n)
                for at in range(0, len(places), 65_536):
                    part = places[at : at + 65_536]
                    yield pd.DataFrame({f: [v] * len(part) for f, v in zip(fields, cell, strict=True)} | {"place": np.asarray(part, np.int64)})

    return stash(df.sparkSession.range(1).coalesce(1).mapInPandas(run, f"{_cell_values(df, by)}, place long"), "draws")


def _picked(df: DataFrame, key: str, by: list[str], chosen: DataFrame) -> DataFrame:
    """chosen: the cell's values and a place."""
    return placed(df, key, by).join(chosen, [*by, "place"]).drop("place")


def seeded_draw(df: DataFrame, key: str, cells: list[tuple], by: list[str], seed: int) -> DataFrame:
    """For each (cell values, n) in turn n rows: the first of a permutation of the cell in order of the key. One generator serves all cells, so their order counts. Only
    the cells' sizes come to the driver; permutations are made in a task."""
    sizes = {tuple(r[c] for c in by): r["n"] for r in df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    for *cell, n in cells:
        if sizes.get(tuple(cell), 0) < n:
            raise ValueError(f"cell {tuple(cell)} has {sizes.get(tuple(cell), 0)} rows, fewer than {n}")
    found = [(*cell, sizes.get(tuple(cell), 0), n) for *cell, n in cells]
    return _picked(df, key, by, _drawn(df, by, found, seed, lambda rng, size, n: rng.permutation(size)[:n]))


def stratified_keep(df: DataFrame, key: str, n: int, by: str, seed: int) -> DataFrame:
    """n rows in proportion to the strata (largest remainder), drawn without replacement in order of the strata with one generator, in a task."""
    quota = sorted(stratified_quota(df, n, by).collect(), key=lambda r: r[by])  # one row a stratum
    cells = [(r[by], r["size"], int(r["quota"])) for r in quota]
    return _picked(df, key, [by], _drawn(df, [by], cells, seed, lambda rng, size, n: rng.choice(size, size=n, replace=False)))


def cell_pick(df: DataFrame, key: str, seed: int, by: list[str]) -> DataFrame:
    """One distinct key of each cell, drawn by a generator of the cell's own: it is seeded with the first 8 bytes of the SHA-256 of seed and cell."""
    import hashlib

    rows = df.select(*by, key).distinct()
    picks = []
    for r in rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect():  # one row a cell
        digest = hashlib.sha256("|".join([str(seed), *(str(r[c]) for c in by)]).encode()).digest()
        picks.append((*(r[c] for c in by), int(np.random.default_rng(int.from_bytes(digest[:8], "big")).integers(r["n"]))))
    return _picked(rows, key, by, F.broadcast(df.sparkSession.createDataFrame(picks, f"{_cell_values(df, by)}, place long")))  # one row a cell
