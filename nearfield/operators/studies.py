"""Studies across models, cohorts, k and m: scoped means, stability, comparisons of representations, distribution summaries and consistency checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import finite
from . import align, knn, scoring, stats
from .quantiles import wide as wide_quantiles

# --- names, scales and publication ---

#: Titles that no rule gives, factors of unit letters.
TITLES = {"medical_center": "Medical Center", "confounder": "Confounder"}
FACTORS = {"k": 1e3, "m": 1e6, "b": 1e9}


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def display_name(column: Column) -> Column:
    """A confounder's title: its words, each with a capital first letter; `Confounder` for nothing."""
    words = F.regexp_extract_all(column, F.lit(r"[^_\s]+"), F.lit(0))
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.char_length(w)))), " ")
    return F.coalesce(_looked_up(TITLES, F.lower(F.trim(column))), F.nullif(title, F.lit("")), F.lit(TITLES["confounder"]))


def scale(column: Column) -> Column:
    """The first number in a decorated count ($3.1$M, ${>}1$B, 6{,}093), times the factor of the letter after it; null where there is none."""
    digits, letter = (F.regexp_extract(column, r"(\d[\d{},]*(?:\.\d+)?|\.\d+)\W*([A-Za-z]?)", i) for i in (1, 2))
    return F.translate(digits, "{},", "").try_cast("double") * F.coalesce(_looked_up(FACTORS, F.lower(letter)), F.lit(1.0))


def regime(column: Column) -> Column:
    """VLFM where the cell says so or names language, else vision-only."""
    return _looked_up({True: "VLFM", False: "vision-only"}, F.coalesce(F.rlike(column, F.lit(r"(?i)^\s*vlfm\s*$|language")), F.lit(False)))


def restyled(df: DataFrame, names: dict[str, str], column: str = "model") -> DataFrame:
    return df.replace(names, subset=[column]) if names else df


def published(df: DataFrame, values=(), ranks=(), mean_ranks=()) -> DataFrame:
    """Rounds half to even: values to 6 places, ranks to 3, mean ranks to 4."""
    places = {c: p for group, p in ((values, 6), (ranks, 3), (mean_ranks, 4)) for c in group}
    return df.withColumns({c: F.bround(c, p) for c, p in places.items()})


def without_control(df: DataFrame, control: str, column: str = "model") -> DataFrame:
    """For statistics across models: the control is no competitor."""
    return df.where(F.col(column) != control)


def k_signature(ks) -> str:
    return ",".join(map(str, sorted(scoring.k_list(ks))))


def search_signature(start_k: int, growth: float, alpha: float) -> str:
    return f"start={int(start_k)};growth={float(growth):.8g};alpha={float(alpha):.8g}"


# --- means, ranks, picks ---


def scoped_means(table: DataFrame, scope=("evaluation_design", "evaluation_unit")) -> DataFrame:
    """Means of all numeric columns by model, the model named with its design and unit where these are columns."""
    there = [c for c in scope if c in table.columns]
    name = F.concat("model", F.lit(" ["), F.concat_ws(";", *there), F.lit("]")) if there else F.col("model")
    numeric = [f.name for f in table.schema if isinstance(f.dataType, T.NumericType) and f.name != "model"]
    if not numeric:
        raise ValueError("no numeric columns")
    return table.groupBy(name.alias("model")).agg(*(F.avg(c).alias(c) for c in numeric))


def rank_min(value: str, by=()) -> Column:
    """Competition ranks, descending."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(value)))


def report_rank(df: DataFrame, group, order) -> DataFrame:
    """1 to n within each group."""
    return df.withColumn("report_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def adjacent(df: DataFrame, value: str, key: str, by=()) -> DataFrame:
    """Neighbours along the falling order of a value: higher, lower, gap."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), key)
    rows = df.select(*by, F.col(key).alias("higher"), F.lead(key).over(w).alias("lower"), (F.col(value) - F.lead(value).over(w)).alias("gap"))
    return rows.where(F.col("lower").isNotNull())


def closest_pair(df: DataFrame, value: str, key: str, by=()) -> DataFrame:
    """The two neighbours along the falling order of a value with the smallest gap, the higher pair among equals: higher, lower, gap. None for fewer than two rows."""
    rows = adjacent(df, value, key, by).join(df.select(*by, F.col(key).alias("higher"), F.col(value).alias("_at")), [*by, "higher"])
    best = F.row_number().over(Window.partitionBy(*by).orderBy("gap", F.desc("_at"), "higher"))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n", "_at")


#: Fewest models for which a correlation over models is stated.
LEAST_MODELS = 8


def model_correlations(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Correlations of two measures over models with their p-values, for groups of at least LEAST_MODELS models that have both."""
    return stats.correlations(df.where(finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull()), a, b, by).where(F.col("n") >= LEAST_MODELS)


def evenly_spaced(df: DataFrame, value: str, key: str, count: int) -> DataFrame:
    """`count` rows at equal distances along the rising order of a value, both ends included."""
    n = df.count()
    if not 2 <= count <= n:
        raise ValueError(f"the count must be from 2 to {n}")
    at = [round(i * (n - 1) / (count - 1)) for i in range(count)]
    return df.withColumn("place", F.row_number().over(Window.orderBy(value, key)) - 1).where(F.col("place").isin(at))


# --- distributions ---


def ecdf(df: DataFrame, value: str, by=()) -> DataFrame:
    good = df.where(finite(F.col(value)).isNotNull())
    return good.withColumn("ecdf", F.row_number().over(Window.partitionBy(*by).orderBy(value)) / F.count(F.lit(1)).over(Window.partitionBy(*by)))


def moments(df: DataFrame, value: str, by=()) -> DataFrame:
    """Population deviation, skewness and excess kurtosis; of the values below zero their share, half variance, half deviation, third moment and skewness; the half
    variance below the median."""
    x = F.col(value)
    good = df.where(finite(x).isNotNull())
    below = F.when(x < 0, x)
    middle = wide_quantiles(good, value, {"median": 0.5}, by=by)
    rows = good.join(F.broadcast(middle), [*by]) if by else good.crossJoin(F.broadcast(middle))  # one row a group
    under = F.when(x < F.col("median"), (x - F.col("median")) ** 2)
    return rows.groupBy(*by).agg(
        F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"), F.avg((x < 0).cast("double")).alias("frac_below_0"), F.avg(below**2).alias("semivar_0"),
        F.sqrt(F.avg(below**2)).alias("semidev_0"), F.avg(below**3).alias("third_0"), F.skewness(below).alias("skew_below_0"), F.avg(under).alias("semivar_median"),
    )


# --- stability and comparisons ---


def wide(table: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """One row for each key that is present in all columns."""
    out = table.groupBy(row).pivot(column, columns).agg(F.first(value))
    return out.dropna(subset=[str(c) for c in columns])


def m_stability(table: DataFrame, ms: tuple[int, ...], value: str = "value") -> DataFrame:
    """table: model, m, value. Rank correlations between pairs of m, and the number of models below zero at each."""
    rows = wide(table, "model", "m", value, list(ms))
    out = []
    for i, a in enumerate(ms):
        for b in ms[i + 1 :]:
            rho = stats.spearman(rows, str(a), str(b))
            out.append(rho.select(F.lit(a).alias("m_a"), F.lit(b).alias("m_b"), "spearman", "n"))
    below = rows.agg(*(F.sum((F.col(f"`{m}`") < 0).cast("long")).alias(f"n{m}") for m in ms))
    same = below.select(*(F.col(f"n{m}") for m in ms), (F.size(F.array_distinct(F.array(*(F.col(f"n{m}") for m in ms)))) == 1).alias("sign_invariant"))
    return reduce(DataFrame.unionByName, out).crossJoin(F.broadcast(same.select("sign_invariant")))  # one row


def representation_changes(canonical: DataFrame, alternative: DataFrame, key: str, measures) -> DataFrame:
    """Each measure of each model in both representations, its change, and the change's rank by size within the measure."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"a.{m}").cast("double").alias("canonical"), F.col(f"b.{m}").cast("double").alias("alternative")) for m in measures)))
    rows = canonical.alias("a").join(alternative.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), pairs.alias("x")).select(key, "x.*")
    rows = rows.withColumn("delta", F.col("alternative") - F.col("canonical")).withColumn("abs_delta", F.abs("delta"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("abs_delta"), key)))


def panel_scalars(table: DataFrame) -> DataFrame:
    """table: cohort, model, margin. Per cohort its span and leader, and over pairs of cohorts the mean rank correlation of the models in both."""
    each = table.groupBy("cohort").agg(F.min("margin").alias("low"), F.max("margin").alias("high"), F.max_by("model", F.struct("margin", -F.col("model"))).alias("leader"), F.count(F.lit(1)).alias("n_models"))
    a, b = table.alias("a"), table.alias("b")
    both = a.join(b, (F.col("a.model") == F.col("b.model")) & (F.col("a.cohort") < F.col("b.cohort")))  # models times pairs of cohorts
    both = both.select(F.concat_ws("/", "a.cohort", "b.cohort").alias("pair"), F.col("a.margin").alias("x"), F.col("b.margin").alias("y"))
    rho = stats.spearman(both, "x", "y", ("pair",)).agg(F.avg("spearman").alias("mean_rho"))
    return each.withColumn("span", F.col("high") - F.col("low")).crossJoin(F.broadcast(rho))  # one row


def probe_scalars(table: DataFrame, probe: str, targets: list[str], control: str | None = None) -> DataFrame:
    """table: model, the probe's accuracy and one column for each target. Per target the correlations of its values with the probe over the models (without the control),
    with p-values."""
    rows = table if control is None else without_control(table, control)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets))).alias("t")
    return stats.correlations(rows.select(F.col(probe).cast("double").alias("x"), each).select("x", "t.*"), "x", "y", ("target",))


def saturation(table: DataFrame, low: str, high: str, probe: str, value: str) -> DataFrame:
    """How far two models lie apart by the probe and by the measure; no row unless both are there."""
    a, b = (table.where(F.col("model") == m).select(F.col(probe).alias(f"p{i}"), F.col(value).alias(f"v{i}")) for i, m in enumerate((low, high)))
    return a.crossJoin(F.broadcast(b)).select(F.abs(F.col("p1") - F.col("p0")).alias("probe_gap"), F.abs(F.col("v1") - F.col("v0")).alias("value_gap"), F.col("v0").alias("low_value"))  # one row a model


def frontier_changes(old: DataFrame, new: DataFrame, x: str, y: str) -> DataFrame:
    """Models on the frontier of either table: model, change (stays, enters or leaves)."""
    both = align.roster(stats.frontier(old, x, y), stats.frontier(new, x, y), "model")
    return both.select("model", F.when(F.col("side") == "both", "stays").when(F.col("side") == "right", "enters").otherwise("leaves").alias("change"))


def k_sweep(models: dict[str, tuple[DataFrame, DataFrame]], ks) -> DataFrame:
    """models: for each name its neighbours (up to the largest k) and its manifest. Per model and k the indices, support and accuracy, with tau the model's median typed
    distance; each model's own best k and, on all rows, the median of these."""
    ks = scoring.k_list(ks)
    out = []
    for name, (found, manifest) in models.items():
        tau = scoring.recommend_tau(found, max(ks))
        ri = scoring.robustness_index(found, ks).select("k", F.col("value").alias("ri"), "support")
        mari = scoring.margin_robustness_index(found, ks, tau=tau).select("k", F.col("value").alias("mari"))
        acc = knn.curve(knn.votes(found, manifest, ks), manifest).select("k", F.col("balanced_accuracy").alias("acc"))
        best = knn.operating_k(acc.withColumnRenamed("acc", "balanced_accuracy"), ks).select(F.col("k").alias("k_star"))
        out.append(ri.join(mari, "k").join(acc, "k").crossJoin(F.broadcast(best)).withColumn("model", F.lit(name)).withColumn("tau", F.lit(tau)))  # one row
    rows = reduce(DataFrame.unionByName, out)
    middle = rows.select("model", "k_star").distinct().agg(F.floor(F.median("k_star")).alias("median_k"))
    return rows.crossJoin(F.broadcast(middle))  # one row


def tau_values(found: DataFrame, taus, k: int) -> DataFrame:
    """found: neighbours of several models, each a subset. Per model and tau the margin robustness index at k: model, tau, value. The neighbours are read once: every tau
    adds two sums to one aggregation, with weights relative to the nearest typed row of the model."""
    typed = found.where((F.col("rank") <= k) & F.col("type").isin("SO", "OS"))
    least = typed.groupBy("subset").agg(F.min("dist").alias("least"))
    rows = typed.join(least, "subset")
    weight = lambda tau: F.exp((F.col("least") - F.col("dist")) / F.lit(float(tau)))
    sums = [a for i, tau in enumerate(taus) for a in (F.sum(F.when(F.col("type") == "SO", weight(tau)).otherwise(0.0)).alias(f"s{i}"), F.sum(weight(tau)).alias(f"w{i}"))]
    each = F.explode(F.array(*(F.struct(F.lit(float(tau)).alias("tau"), (F.col(f"s{i}") / F.col(f"w{i}")).alias("value")) for i, tau in enumerate(taus))))
    return rows.groupBy(F.col("subset").alias("model")).agg(*sums).select("model", each.alias("t")).select("model", "t.*")


def tau_agreement(values: DataFrame) -> DataFrame:
    """Rank correlation of the models' orders between all pairs of tau: tau, other, rho, n."""
    a, b = values.alias("a"), values.alias("b")
    both = a.join(b, (F.col("a.model") == F.col("b.model")) & (F.col("a.tau") < F.col("b.tau")))  # models times pairs of tau
    both = both.select(F.col("a.tau").alias("tau"), F.col("b.tau").alias("other"), F.col("a.value").alias("x"), F.col("b.value").alias("y"))
    return stats.spearman(both, "x", "y", ("tau", "other")).select("tau", "other", F.col("spearman").alias("rho"), "n")


def sweep_agreement(swept: DataFrame, value: str) -> DataFrame:
    """Over models the value at each one's own k against that at the median k: correlations, mean and largest change."""
    own = swept.where("k = k_star").select("model", F.col(value).alias("own"))
    rows = own.join(swept.where("k = median_k").select("model", F.col(value).alias("shared")), "model")
    change = rows.agg(F.avg(F.abs(F.col("own") - F.col("shared"))).alias("mean_change"), F.max(F.abs(F.col("own") - F.col("shared"))).alias("largest_change"))
    return stats.spearman(rows, "own", "shared").crossJoin(F.broadcast(change))  # one row


# --- checks ---

SHARED_FIELDS = ("support", "undefined_ss", "undefined_oo", "undefined_tie")


def shared_support(a: DataFrame, b: DataFrame, keys=("k",), fields=SHARED_FIELDS) -> DataFrame:
    """The fields that both indices share, once; raises where they differ."""
    joined = a.select(*keys, *fields).join(b.select(*keys, *(F.col(f).alias(f"{f}_b") for f in fields)), [*keys], "full_outer")
    differ = reduce(lambda x, y: x | y, (~F.col(f).eqNullSafe(F.col(f"{f}_b")) for f in fields))
    if bad := joined.where(differ).limit(1).collect():
        raise ValueError(f"support differs between the indices: {bad[0].asDict()}")
    return a.select(*keys, *fields)


def grid_check(df: DataFrame, expected: int, cell=("label", "confounder"), unit: str = "sample_id") -> DataFrame:
    """Cells whose number of distinct samples isn't the expected one; cells of the full grid without samples count as 0."""
    count = df.select(*cell, unit).distinct().groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    a, b = (df.select(c).distinct() for c in cell)
    grid = a.crossJoin(b)  # labels times confounders
    return grid.join(count, [*cell], "left").select(*cell, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") != expected)


def same_identity(a: DataFrame, b: DataFrame, columns, order: str = "occurrence_index") -> DataFrame:
    """Positions at which two tables differ in identity, or that only one has."""
    x = a.select(F.col(order), F.struct(*columns).alias("left"))
    y = b.select(F.col(order), F.struct(*columns).alias("right"))
    return x.join(y, order, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def join_report(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Every key of both sides with its part in the inner join: kept, or dropped on the left or right."""
    x, y = a.select(*keys).distinct().withColumn("l", F.lit(1)), b.select(*keys).distinct().withColumn("r", F.lit(1))
    return x.join(y, [*keys], "full_outer").select(*keys, F.when(F.col("r").isNull(), "dropped_left").when(F.col("l").isNull(), "dropped_right").otherwise("kept").alias("part"))


def bijective_slice(wanted: DataFrame, full: DataFrame, key: str, allowed: Column | None = None) -> DataFrame:
    """Positions in the full table of the wanted rows: each key once on both sides, none missing, and only allowed rows."""
    for side, name in ((wanted, "selection"), (full, "full table")):
        if bad := side.groupBy(key).count().where("count > 1").limit(1).collect():
            raise ValueError(f"repeated key in the {name}: {bad[0][0]}")
    rows = wanted.select(key, F.col("row_id").alias("position")).join(full.withColumnRenamed("row_id", "source_row"), key)
    if rows.count() != wanted.count():
        raise ValueError("some rows of the selection aren't in the full table")
    if allowed is not None and (bad := rows.where(~allowed).limit(1).collect()):
        raise ValueError(f"row outside of the allowed ones: {bad[0].asDict()}")
    return rows.select("position", key, "source_row")


def sealed(df: DataFrame, key: str, expected: set[str], digest: str | None = None) -> str:
    """SHA-256 of a small table's keys in order; raises if the roster or the digest isn't the expected one."""
    names = [r[0] for r in df.select(F.col(key).cast("string")).distinct().orderBy(key).limit(len(expected) + 1).collect()]  # one more than expected at most
    if set(names) != expected:
        raise ValueError(f"roster differs: {sorted(set(names) ^ expected)[:5]}")
    found = df.sparkSession.createDataFrame([("\n".join(names),)], "t string").select(F.sha2("t", 256)).first()[0]
    if digest is not None and found != digest:
        raise ValueError("sealed input has changed")
    return found
