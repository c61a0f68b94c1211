"""Registered queries over studies: shares at a sharp tau, probes' accuracies, published tables, stability, distributions and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoders
from ..operators import align, downstream, knn, margin, neighbors, quantiles, scoring, stats, studies
from ..sources import manifest, tables
from .catalogue import COUNTED, K, KS, NEAR, PAIRED, PAIRS, base, near, query, rounded
from .reports import COPIES, NATIONS, PANEL, _draw_sql, customers, panel

# --- indices -------------------------------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {NEAR.replace("{k}", str(K))}, w AS (SELECT *, CASE WHEN type IN ('SO', 'OS') THEN exp(-(dist - min(dist) FILTER (type IN ('SO', 'OS')) OVER (PARTITION BY q)) / 0.001) END AS w FROM n)
SELECT q, round(coalesce(sum(w) FILTER (type = 'SO'), 0) / sum(w), 6) AS share FROM w GROUP BY q""")
def mari_per_sample_sharp(spark, sf_dir):
    """At a tau at which plain weights would underflow."""
    rows = scoring.per_unit(scoring.at_k(scoring.evidence(near(spark, sf_dir), scoring.decay(0.001)), [K]))
    return rows.select("q", F.round("share", 6).alias("share"))


@query(f"""WITH {COUNTED} SELECT CAST(k AS BIGINT) AS k, round(avg((n_so + n_os > 0)::INT::DOUBLE), 9) AS support, round(avg((n_so + n_os = 0 AND n_ss > n_oo)::INT::DOUBLE), 9) AS undefined_ss,
  round(avg((n_so + n_os = 0 AND n_oo > n_ss)::INT::DOUBLE), 9) AS undefined_oo, round(avg((n_so + n_os = 0 AND n_ss = n_oo)::INT::DOUBLE), 9) AS undefined_tie FROM s GROUP BY k""")
def shared_support(spark, sf_dir):
    found = near(spark, sf_dir, max(KS))
    return rounded(studies.shared_support(scoring.robustness_index(found, KS), scoring.margin_robustness_index(found, KS, tau=0.2)))


@query()
def k_sweep(spark, sf_dir):
    """Two models: whole vectors, and their first halves."""
    m = base(spark, sf_dir)
    half = m.withColumn("embedding", F.expr("slice(embedding, 1, cast(size(embedding) / 2 as int))"))
    swept = studies.k_sweep({"whole": (neighbors.nearest(m, max(KS)), m), "half": (neighbors.nearest(half, max(KS)), half)}, KS)
    return rounded(swept)


# --- accuracies of probes ------------------------------------------------------------------------------------------------------------------------------------

#: Accuracies read from line items: a line number is a split, a supplier's remainder an iteration.
ACCURACIES = """a AS (SELECT test_set, split, iter, avg(x) AS acc FROM (SELECT 'in_domain' AS test_set, l_linenumber - 1 AS split, l_suppkey % 20 AS iter, 0.6 + l_quantity / 200 AS x FROM lineitem
  UNION ALL SELECT 'unseen', l_linenumber - 1, l_suppkey % 20, 0.6 + l_discount FROM lineitem) GROUP BY ALL)"""


def accuracies(spark, sf_dir, iterations=20):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sets = F.explode(F.array(F.struct(F.lit("in_domain").alias("t"), (F.lit(0.6) + F.col("l_quantity") / 200).alias("x")), F.struct(F.lit("unseen").alias("t"), (F.lit(0.6) + F.col("l_discount")).alias("x"))))
    rows = x.select((F.col("l_linenumber") - 1).alias("split"), (F.col("l_suppkey") % iterations).cast("int").alias("iter"), sets.alias("s"))
    return rows.groupBy(F.col("s.t").alias("test_set"), "split", "iter").agg(F.avg("s.x").alias("acc"))


def six(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


DROPS = "d AS (SELECT x.test_set, x.iter, avg(x.acc / b.acc) - 1 AS d FROM a x JOIN a b ON b.test_set = x.test_set AND b.iter = x.iter AND b.split = 0 WHERE x.split > 0 GROUP BY ALL)"
AREAS = """m AS (SELECT test_set, split, avg(acc) AS a, split / 6 AS v FROM a GROUP BY ALL), o AS (SELECT test_set, a AS a0 FROM m WHERE split = 0), g AS (SELECT test_set, v, (a - a0) / (a0 - 0.5) AS g FROM m JOIN o USING (test_set)),
t AS (SELECT test_set, (v - lag(v) OVER w) * (g + lag(g) OVER w) / 2 AS area FROM g WINDOW w AS (PARTITION BY test_set ORDER BY v)), n AS (SELECT test_set, sum(area) AS nipd FROM t GROUP BY test_set)"""


@query(f"WITH {ACCURACIES}, {DROPS} SELECT round(avg(d), 6) AS apd FROM d WHERE test_set = 'in_domain'")
def apd_table(spark, sf_dir):
    return six(downstream.average_performance_drop(downstream.check_accuracies(accuracies(spark, sf_dir).where("test_set = 'in_domain'"))))


@query(f"WITH {ACCURACIES}, {AREAS} SELECT round(nipd, 6) AS nipd FROM n WHERE test_set = 'in_domain'")
def nipd_table(spark, sf_dir):
    bias = spark.range(7).select(F.col("id").cast("int").alias("split"), (F.col("id") / 6).alias("v"))
    return six(downstream.integrated_degradation(accuracies(spark, sf_dir).where("test_set = 'in_domain'"), bias, 0.5))


@query(f"WITH {ACCURACIES}, {DROPS}, {AREAS} SELECT test_set, round(a0, 6) AS baseline, round((SELECT avg(d) FROM d WHERE d.test_set = n.test_set), 6) AS apd, round(nipd, 6) AS nipd FROM n JOIN o USING (test_set)")
def probe_reductions(spark, sf_dir):
    bias = spark.range(7).select(F.col("id").cast("int").alias("split"), (F.col("id") / 6).alias("v"))
    return six(downstream.reductions(accuracies(spark, sf_dir), bias, 0.5))


@query(f"WITH {ACCURACIES} SELECT split::BIGINT AS split, round(avg(acc), 6) AS mean, round(avg(acc) - 2.0930240544 * stddev_samp(acc) / sqrt(20), 6) AS low, round(avg(acc) + 2.0930240544 * stddev_samp(acc) / sqrt(20), 6) AS high, count(*) AS n FROM a WHERE test_set = 'in_domain' GROUP BY split")
def t_interval_by_split(spark, sf_dir):
    return six(stats.t_interval(accuracies(spark, sf_dir).where("test_set = 'in_domain'"), "acc", ("split",)))


@query("""WITH a AS (SELECT l_linenumber AS line, l_suppkey % 50 AS iter, avg(l_quantity) AS x FROM lineitem GROUP BY ALL)
SELECT line::BIGINT AS line, round(avg(x), 6) AS mean, round(avg(x) - 2.0095752371 * stddev_samp(x) / sqrt(50), 6) AS low, round(avg(x) + 2.0095752371 * stddev_samp(x) / sqrt(50), 6) AS high, count(*) AS n FROM a GROUP BY line""")
def t_interval_of_fifty(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 50).alias("iter")).agg(F.avg("l_quantity").alias("x"))
    return six(stats.t_interval(x, "x", ("line",)))


KNOWN_LANGS, KNOWN_SOURCES = ["en", "de", "fr"], ["src0", "src1", "src2", "src3"]


def cohort_rows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = d.where(F.col("source").isin(KNOWN_SOURCES) & F.col("lang").isNotNull())
    return d.select(F.col("doc_id").alias("row_id"), F.when(F.col("lang").isin(KNOWN_LANGS), "ID").otherwise("OOD").alias("subset"), F.col("lang").alias("confounder"), F.col("source").alias("label"), F.array(F.col("n_chars").cast("double")).alias("features"))


@query("""WITH c AS (SELECT doc_id AS row_id, list_position(['en', 'de', 'fr'], lang) - 1 AS i, list_position(['src0', 'src1', 'src2', 'src3'], source) - 1 AS j FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3') AND lang IS NOT NULL)
SELECT row_id, i::BIGINT AS i, j::BIGINT AS j FROM c WHERE i >= 0""")
def cohort_indices(spark, sf_dir):
    return rounded(downstream.cohort(cohort_rows(spark, sf_dir), KNOWN_LANGS, KNOWN_SOURCES)[0].select("row_id", "i", "j"))


@query("SELECT list_position(['src0', 'src1', 'src2', 'src3'], source) - 1 AS j, count(*) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3') AND lang NOT IN ('en', 'de', 'fr') GROUP BY ALL")
def unseen_rows(spark, sf_dir):
    return rounded(downstream.cohort(cohort_rows(spark, sf_dir), KNOWN_LANGS, KNOWN_SOURCES)[1].groupBy("j").agg(F.count(F.lit(1)).alias("n")))


@query()
def probe_test_sets(spark, sf_dir):
    """Probes of the label's parity from the vectors with the languages as confounders, scored on their held-out rows and on an unseen language."""
    m = base(spark, sf_dir).select("row_id", F.col("confounder").alias("lang"), (F.col("label").cast("int") % 2).alias("j"), F.col("embedding").cast("array<double>").alias("features"))
    rows = m.where("lang <> 'es'").select("row_id", (F.col("lang") == "en").cast("int").alias("i"), "j", "features")
    return downstream.probe_sweep_over(rows, downstream.schedule(spark, "camelyon", n_splits=4), {"es": m.where("lang = 'es'").select("j", "features")}, iterations=2, validation=0.2)


# --- names, scales and publication ---------------------------------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name || '__' || lower(p_type), '[_\s]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part""")
def display_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", studies.display_name(F.concat("p_name", F.lit("__"), F.lower("p_type"))).alias("title"))


@query("SELECT p_partkey, (p_size + 0.5) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END::DOUBLE AS value FROM part WHERE p_partkey % 11 > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 11 = 0")
def scale_numbers(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    unit = F.element_at(F.array(*map(F.lit, ("", "k", "M", "B"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    cell = F.when(F.col("p_partkey") % 11 == 0, "n/d").otherwise(F.concat(F.lit(r"${\sim}"), "p_size", F.lit(".5$"), unit))
    return p.select("p_partkey", studies.scale(cell).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'VLFM' ELSE 'vision-only' END AS regime FROM part")
def regimes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    cell = F.element_at(F.array(F.lit(" Vision "), F.lit("vision--Language"), F.lit("vlfm")), (F.col("p_size") % 3 + 1).cast("int"))
    return p.select("p_partkey", studies.regime(cell).alias("regime"))


@query(f"WITH {PANEL} SELECT CASE model WHEN 5 THEN 'five' ELSE CAST(model AS VARCHAR) END AS model, cohort, round_even(margin, 6) AS margin, round_even(n / 7, 3) AS rank, round_even(n / 13, 4) AS mean_rank FROM panel WHERE model <> 3")
def published_table(spark, sf_dir):
    """Without the control, with published names and places."""
    p = panel(spark, sf_dir).select(F.col("model").cast("string").alias("model"), "cohort", "margin", (F.col("n") / 7).alias("rank"), (F.col("n") / 13).alias("mean_rank"))
    return studies.published(studies.restyled(studies.without_control(p, "3"), {"5": "five"}), ["margin"], ["rank"], ["mean_rank"])


@query("SELECT c_nationkey || ' [' || c_mktsegment || ';sample]' AS model, round(avg(c_acctbal), 6) AS c_acctbal, round(avg(c_custkey), 6) AS c_custkey FROM customer GROUP BY ALL")
def scoped_means(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    t = c.select(F.col("c_nationkey").cast("string").alias("model"), F.col("c_mktsegment").alias("evaluation_design"), F.lit("sample").alias("evaluation_unit"), "c_acctbal", "c_custkey")
    return six(studies.scoped_means(t))


@query(f"WITH {PANEL} SELECT cohort, model, rank() OVER (PARTITION BY cohort ORDER BY n DESC) AS competition, row_number() OVER (PARTITION BY cohort ORDER BY ltm, model) AS report_rank FROM panel")
def competition_ranks(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("competition", studies.rank_min("n", ("cohort",)))
    return rounded(studies.report_rank(p, ["cohort"], ["ltm", "model"]).select("cohort", "model", "competition", "report_rank"))


@query(f"WITH {PANEL}, x AS (SELECT cohort, model AS higher, lead(model) OVER w AS lower, margin - lead(margin) OVER w AS gap FROM panel WINDOW w AS (PARTITION BY cohort ORDER BY margin DESC, model)) SELECT cohort, higher, lower, round(gap, 9) AS gap FROM x WHERE lower IS NOT NULL")
def adjacent_pairs(spark, sf_dir):
    return rounded(studies.adjacent(panel(spark, sf_dir), "margin", "model", ("cohort",)))


@query(f"WITH {PANEL}, x AS (SELECT model, margin, row_number() OVER (ORDER BY margin, model) - 1 AS place, count(*) OVER () AS n FROM panel WHERE cohort = 'BUILDING') SELECT model, place FROM x WHERE place IN (SELECT round_even(i * (n - 1) / 4, 0)::BIGINT FROM range(5) r(i))")
def evenly_spaced_models(spark, sf_dir):
    return rounded(studies.evenly_spaced(panel(spark, sf_dir).where("cohort = 'BUILDING'"), "margin", "model", 5).select("model", "place"))


@query(f"WITH {PANEL} SELECT cohort, model FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY margin DESC, model) AS place FROM panel) WHERE place <= 8")
def panel_head(spark, sf_dir):
    return panel(spark, sf_dir).withColumn("place", stats.rank_first("margin", "model", ("cohort",))).where("place <= 8").select("cohort", "model")


# --- distributions and stability -----------------------------------------------------------------------------------------------------------------------------


@query("SELECT c_mktsegment AS segment, c_acctbal AS value, round(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) / count(*) OVER (PARTITION BY c_mktsegment), 9) AS ecdf FROM customer")
def ecdf_values(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("value"))
    return rounded(studies.ecdf(c, "value", ("segment",)).select("segment", "value", "ecdf"))


@query("""WITH r AS (SELECT c_nationkey AS nation, c_acctbal AS x, c_custkey::DOUBLE AS y, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2 AS rx, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ry FROM customer),
c AS (SELECT nation, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM r GROUP BY nation),
a AS (SELECT *, n - 2 AS df, atan(abs(pearson) / sqrt(1 - pearson * pearson)) AS a1, atan(abs(spearman) / sqrt(1 - spearman * spearman)) AS a2 FROM c),
s AS (SELECT *, list_sum(list_transform(range(0, df // 2), lambda k: coalesce(list_product(list_transform(range(0, k), lambda j: CASE WHEN df % 2 = 1 THEN (2 * j + 2) / (2 * j + 3) ELSE (2 * j + 1) / (2 * j + 2) END * cos(a1) ** 2)), 1))) AS s1,
  list_sum(list_transform(range(0, df // 2), lambda k: coalesce(list_product(list_transform(range(0, k), lambda j: CASE WHEN df % 2 = 1 THEN (2 * j + 2) / (2 * j + 3) ELSE (2 * j + 1) / (2 * j + 2) END * cos(a2) ** 2)), 1))) AS s2 FROM a)
SELECT nation::BIGINT AS nation, n, round(pearson, 9) AS pearson, round(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (a1 + sin(a1) * cos(a1) * s1) ELSE sin(a1) * s1 END, 8) AS pearson_p,
  round(spearman, 9) AS spearman, round(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (a2 + sin(a2) * cos(a2) * s2) ELSE sin(a2) * s2 END, 8) AS spearman_p FROM s""")
def correlation_tests(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    found = stats.correlations(c, "x", "y", ("nation",))
    return rounded(found.withColumns({p: F.round(p, 8) for p in ("pearson_p", "spearman_p")}))


@query("""WITH s AS (SELECT c_mktsegment AS segment, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n, stddev_samp(c_acctbal) * count(*) ** (-0.2::DOUBLE) AS h FROM customer GROUP BY c_mktsegment),
g AS (SELECT *, low + (high - low) * (i / 63) AS place FROM s, range(64) t(i))
SELECT segment, round(place, 6) AS "at", round(sum(exp(-0.5 * ((place - c_acctbal) / h) ** 2)) / (n * h * sqrt(2 * pi())), 9) AS density FROM g JOIN customer ON c_mktsegment = segment GROUP BY segment, place, n, h""")
def density_curve(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("x"))
    return stats.density(c, "x", ("segment",)).select("segment", F.round("at", 6).alias("at"), F.round("density", 9).alias("density"))


@query("""WITH x AS (SELECT c_mktsegment AS segment, (c_acctbal - 2000) / 10000 AS x FROM customer), m AS (SELECT segment, avg(x) AS mu, median(x) AS med, avg(x) FILTER (x < 0) AS mb FROM x GROUP BY segment)
SELECT segment, round(stddev_pop(x), 6) AS std, round(avg((x - mu) ** 3) / stddev_pop(x) ** 3, 6) AS skew, round(avg((x - mu) ** 4) / var_pop(x) ** 2 - 3, 6) AS kurt, round(avg((x < 0)::INT::DOUBLE), 6) AS frac_below_0,
  round(avg(x * x) FILTER (x < 0), 6) AS semivar_0, round(sqrt(avg(x * x) FILTER (x < 0)), 6) AS semidev_0, round(avg(x ** 3) FILTER (x < 0), 6) AS third_0,
  round(avg((x - mb) ** 3) FILTER (x < 0) / (stddev_pop(x) FILTER (x < 0)) ** 3, 6) AS skew_below_0, round(avg((x - med) ** 2) FILTER (x < med), 6) AS semivar_median FROM x JOIN m USING (segment) GROUP BY segment""")
def downside_moments(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), ((F.col("c_acctbal") - 2000) / 10000).alias("x"))
    return six(studies.moments(c, "x", ("segment",)))


SWEPT = "s AS (SELECT o_custkey % 25 AS model, [1, 5, 20][o_orderkey % 3 + 1] AS m, avg(o_totalprice) / 100000 - 2.5 AS value FROM orders GROUP BY ALL), w AS (SELECT model, max(value) FILTER (m = 1) AS m1, max(value) FILTER (m = 5) AS m5, max(value) FILTER (m = 20) AS m20 FROM s GROUP BY model HAVING count(*) = 3), r AS (SELECT *, rank() OVER (ORDER BY m1) AS r1, rank() OVER (ORDER BY m5) AS r5, rank() OVER (ORDER BY m20) AS r20 FROM w)"


@query(f"""WITH {SWEPT}, b AS (SELECT count(*) FILTER (m1 < 0) = count(*) FILTER (m5 < 0) AND count(*) FILTER (m1 < 0) = count(*) FILTER (m20 < 0) AS sign_invariant FROM w)
SELECT 1::BIGINT AS m_a, 5::BIGINT AS m_b, round(corr(r1, r5), 9) AS spearman, count(*) AS n, (SELECT sign_invariant FROM b) AS sign_invariant FROM r
UNION ALL SELECT 1, 20, round(corr(r1, r20), 9), count(*), (SELECT sign_invariant FROM b) FROM r UNION ALL SELECT 5, 20, round(corr(r5, r20), 9), count(*), (SELECT sign_invariant FROM b) FROM r""")
def m_sweep_stability(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    m = F.element_at(F.array(F.lit(1), F.lit(5), F.lit(20)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    t = o.groupBy((F.col("o_custkey") % 25).alias("model"), m.alias("m")).agg((F.avg("o_totalprice") / 100000 - 2.5).alias("value"))
    return rounded(studies.m_stability(t, (1, 5, 20)))


@query(f"""WITH {PANEL}, p AS (SELECT a.model, 'margin' AS measure, a.margin AS canonical, b.margin AS alternative FROM panel a JOIN panel b USING (model) WHERE a.cohort = 'BUILDING' AND b.cohort = 'MACHINERY'
UNION ALL SELECT a.model, 'ltm', a.ltm, b.ltm FROM panel a JOIN panel b USING (model) WHERE a.cohort = 'BUILDING' AND b.cohort = 'MACHINERY')
SELECT model, measure, round(canonical, 9) AS canonical, round(alternative, 9) AS alternative, round(alternative - canonical, 9) AS delta, round(abs(alternative - canonical), 9) AS abs_delta,
  row_number() OVER (PARTITION BY measure ORDER BY abs(alternative - canonical) DESC, model) AS rank FROM p""")
def representation_changes(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(studies.representation_changes(p.where("cohort = 'BUILDING'"), p.where("cohort = 'MACHINERY'"), "model", ["margin", "ltm"]))


@query(f"""WITH {PANEL}, j AS (SELECT a.cohort || '/' || b.cohort AS pair, a.margin AS x, b.margin AS y FROM panel a JOIN panel b ON a.model = b.model AND a.cohort < b.cohort),
r AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2 AS ry FROM j),
c AS (SELECT avg(rho) AS mean_rho FROM (SELECT corr(rx, ry) AS rho FROM r GROUP BY pair))
SELECT cohort, round(min(margin), 9) AS low, round(max(margin), 9) AS high, arg_max(model, margin) AS leader, count(*) AS n_models, round(max(margin) - min(margin), 9) AS span, (SELECT round(mean_rho, 9) FROM c) AS mean_rho FROM panel GROUP BY cohort""")
def panel_scalars(spark, sf_dir):
    return rounded(studies.panel_scalars(panel(spark, sf_dir)))


@query(f"WITH {PANEL} SELECT model, round(max(margin) FILTER (cohort = 'BUILDING'), 9) AS \"BUILDING\", round(max(margin) FILTER (cohort = 'MACHINERY'), 9) AS \"MACHINERY\" FROM panel GROUP BY model HAVING count(*) FILTER (cohort IN ('BUILDING', 'MACHINERY')) = 2")
def aligned_wide(spark, sf_dir):
    return rounded(studies.wide(panel(spark, sf_dir), "model", "cohort", "margin", ["BUILDING", "MACHINERY"]))


@query(f"""WITH {NATIONS}, {_draw_sql(25, 2000, 3)}, r AS (SELECT rep, seg, median(x) AS med FROM ({COPIES}) GROUP BY rep, seg), o AS (SELECT seg, median(x) AS med FROM c GROUP BY seg),
p AS (SELECT seg AS higher, lead(seg) OVER (ORDER BY med DESC, seg) AS lower FROM o)
SELECT higher, lower, round(avg((a.med > b.med)::INT::DOUBLE), 9) AS p_win FROM p JOIN r a ON a.seg = higher JOIN r b ON b.seg = lower AND b.rep = a.rep GROUP BY ALL""")
def adjacent_wins(spark, sf_dir):
    """Along the order of medians, how often the higher one of two neighbours wins over replicates."""
    c = customers(spark, sf_dir)
    pairs = studies.adjacent(c.groupBy("segment").agg(F.median("x").alias("med")), "med", "segment")
    wins = stats.rank_stability(c, "segment", "x", "cluster", n=2000, seed=3)[1]
    return rounded(pairs.join(wins, (F.col("higher") == F.col("model_a")) & (F.col("lower") == F.col("model_b"))).select("higher", "lower", "p_win"))


@query("""WITH m AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, median(c_acctbal) AS med FROM customer GROUP BY ALL),
p AS (SELECT segment, nation AS higher, med, lead(nation) OVER w AS lower, med - lead(med) OVER w AS gap FROM m WINDOW w AS (PARTITION BY segment ORDER BY med DESC, nation)),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY gap, med DESC, higher) AS place FROM p WHERE lower IS NOT NULL)
SELECT segment, higher::BIGINT AS higher, lower::BIGINT AS lower, round(gap, 6) AS gap FROM r WHERE place = 1""")
def closest_pairs(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    medians = quantiles.wide(c, "c_acctbal", {"med": 0.5}, by=["segment", "nation"])
    return six(studies.closest_pair(medians, "med", "nation", ("segment",)).select("segment", "higher", "lower", "gap"))


@query("""WITH m AS (SELECT c_mktsegment AS segment, c_nationkey % 5 AS fold, c_nationkey AS nation, avg(c_acctbal) AS a, count(*)::DOUBLE AS b FROM customer GROUP BY ALL),
w AS (SELECT segment AS cohort, nation, a, b FROM m UNION ALL SELECT segment || fold, nation, a, b FROM m),
r AS (SELECT cohort, a, b, rank() OVER (PARTITION BY cohort ORDER BY a) + (count(*) OVER (PARTITION BY cohort, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY cohort ORDER BY b) + (count(*) OVER (PARTITION BY cohort, b) - 1) / 2 AS rb FROM w)
SELECT cohort, count(*) AS n, round(corr(a, b), 9) AS pearson, round(corr(ra, rb), 9) AS spearman FROM r GROUP BY cohort HAVING count(*) >= 8""")
def model_correlations(spark, sf_dir):
    """Nations as models: cohorts of five nations are too few and left out."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    m = c.groupBy(F.col("c_mktsegment").alias("cohort"), F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    both = m.unionByName(m.withColumn("cohort", F.concat("cohort", (F.col("nation") % 5).cast("string"))))
    return rounded(studies.model_correlations(both, "a", "b", ("cohort",)).select("cohort", "n", "pearson", "spearman"))


TAUS = (0.01, 0.05, 0.2, 1.0)


@query(f"""WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, c) AS rank FROM p WHERE q % 7 = c % 7),
t AS (SELECT q % 7 AS model, tau, sum(exp(-dist / tau)) FILTER (type = 'SO') / sum(exp(-dist / tau)) AS v FROM n, (VALUES {", ".join(f"({t}::DOUBLE)" for t in TAUS)}) g(tau) WHERE rank <= {K} AND type IN ('SO', 'OS') GROUP BY ALL),
r AS (SELECT model, tau, rank() OVER (PARTITION BY tau ORDER BY v) + (count(*) OVER (PARTITION BY tau, v) - 1) / 2 AS r FROM t)
SELECT a.tau AS tau, b.tau AS other, round(corr(a.r, b.r), 9) + 0.0 AS rho, count(*) AS n FROM r a JOIN r b ON a.model = b.model AND a.tau < b.tau GROUP BY ALL""")
def tau_agreement(spark, sf_dir):
    """Seven parts of the table as models: how far the choice of tau changes their order."""
    parts = base(spark, sf_dir).withColumn("subset", (F.col("row_id") % 7).cast("string"))
    found = rounded(studies.tau_agreement(studies.tau_values(neighbors.nearest(parts, K), TAUS, K)))
    return found.withColumn("rho", F.col("rho") + F.lit(0.0))  # no negative zero


# --- consistency checks --------------------------------------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT lang, source, count(DISTINCT doc_id) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), (SELECT DISTINCT source FROM documents WHERE lang IS NOT NULL))
SELECT lang AS label, source AS confounder, coalesce(n, 0) AS n FROM g LEFT JOIN d USING (lang, source) WHERE coalesce(n, 0) <> 10""")
def grid_mismatches(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null")
    return studies.grid_check(d.select(F.col("lang").alias("label"), F.col("source").alias("confounder"), F.col("doc_id").alias("sample_id")), 10)


@query("SELECT c_custkey AS occurrence_index FROM customer WHERE c_custkey % 97 = 0 OR c_custkey % 89 = 0")
def identity_mismatches(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("occurrence_index", F.col("c_custkey"))
    other = c.where("c_custkey % 89 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 97 == 0, -1).otherwise(F.col("c_nationkey")))
    return studies.same_identity(c, other, ["c_custkey", "c_name", "c_nationkey"]).select("occurrence_index")


@query("""SELECT coalesce(c, o) AS custkey, CASE WHEN o IS NULL THEN 'dropped_left' WHEN c IS NULL THEN 'dropped_right' ELSE 'kept' END AS part
FROM (SELECT c_custkey AS c FROM customer WHERE c_custkey % 3 > 0) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_custkey % 5 > 0) ON c = o""")
def join_parts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("custkey"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey % 5 > 0").select(F.col("o_custkey").alias("custkey"))
    return studies.join_report(c, o, ["custkey"])


@query("""WITH f AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS source_row FROM customer)
SELECT row_number() OVER (ORDER BY c_custkey DESC) - 1 AS position, c_name, source_row FROM f WHERE c_custkey % 5 = 0""")
def bijective_slice(spark, sf_dir):
    """Every fifth customer, last first, by position in the whole table."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    full = align.numbered(c, "c_custkey", ["c_name"], "row_id").select("row_id", "c_name")
    wanted = align.numbered(c.where("c_custkey % 5 = 0").withColumn("turn", -F.col("c_custkey")), "turn", ["c_name"], "row_id").select("row_id", "c_name")
    return rounded(studies.bijective_slice(wanted, full, "c_name"))


@query("SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_name)) AS digest FROM region")
def sealed_roster(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    names = {x[0] for x in r.select("r_name").collect()}  # five regions
    return spark.createDataFrame([(studies.sealed(r, "r_name", names),)], "digest string")


# --- draws ---------------------------------------------------------------------------------------------------------------------------------------------------


@query()
def cell_draws(spark, sf_dir):
    """Documents of four cells, from one generator."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cells = [("en", "src0", 3), ("de", "src0", 1), ("fr", "src0", 1), ("en", "src1", 1)]
    return stats.seeded_draw(d.select("doc_id", "lang", "source"), "doc_id", cells, ["lang", "source"], 7)


@query()
def stratified_draw(spark, sf_dir):
    return stats.stratified_keep(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id", 137, "source", 11)


@query()
def cell_picks(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null")
    return stats.cell_pick(d.select("doc_id", "lang", "source"), "doc_id", 42, ["lang", "source"])


# --- designs and tails of shares -----------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {PAIRED}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subset, q ORDER BY dist, c) AS rank FROM p) WHERE rank <= 5), g(k) AS (VALUES (1), (3), (5)),
f AS (SELECT subset, label AS value, min(row_id) AS code FROM x GROUP BY ALL), c AS (SELECT n.subset, k, q, x.label AS value, f.code, count(*) AS n FROM n, g, x, f WHERE rank <= k AND x.subset = n.subset AND x.row_id = n.c AND f.subset = n.subset AND f.value = x.label GROUP BY ALL),
v AS (SELECT subset, k, q, value AS vote FROM (SELECT *, row_number() OVER (PARTITION BY subset, k, q ORDER BY n DESC, code) AS place FROM c) WHERE place = 1),
r AS (SELECT v.subset, k, x.label AS truth, avg((vote = x.label)::INT::DOUBLE) AS recall FROM v JOIN x ON x.subset = v.subset AND x.row_id = v.q GROUP BY ALL), b AS (SELECT subset, k, avg(recall) AS acc FROM r GROUP BY ALL),
z AS (SELECT subset, count(*) AS size FROM x GROUP BY subset) SELECT k::BIGINT AS k, round(avg(acc), 9) AS balanced_accuracy FROM b JOIN z USING (subset) WHERE k < size AND size > 1 GROUP BY k""")
def paired_bacc_curve(spark, sf_dir):
    """Unweighted mean over the 2x2 subsets."""
    m = base(spark, sf_dir).drop("subset")
    x = manifest.expand_2x2(m)
    return rounded(knn.curve(knn.votes(neighbors.nearest_2x2(m, 5), x, (1, 3, 5)), x))


@query(f"""WITH {COUNTED}, shares AS (SELECT n_so / (n_so + n_os) AS x FROM s WHERE k = {K} AND n_so + n_os > 0), t AS (SELECT quantile_cont(x, 0.1) AS q FROM shares)
SELECT round(median(x), 9) AS median, round(max(q), 9) AS quantile, round(avg(x) FILTER (x <= q), 9) AS lower_tail_mean, count(*) FILTER (x <= q) AS n_tail FROM shares, t""")
def share_tail(spark, sf_dir):
    """Median and tail of the units' own shares, over the defined ones."""
    rows = scoring.per_unit(scoring.at_k(scoring.evidence(near(spark, sf_dir)), [K]))
    middle = rows.agg(F.median("share").alias("median"))
    return rounded(middle.crossJoin(F.broadcast(margin.tail(rows, "share"))))  # one row each


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def contingency(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 's3://x/' || c_name WHEN c_custkey % 3 = 1 THEN '/abs/' || c_name ELSE '/root/of/mapping/' || c_name END AS path FROM customer")
def resolved_paths(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.concat(F.when(F.col("c_custkey") % 3 == 0, "s3://x/").when(F.col("c_custkey") % 3 == 1, "/abs/").otherwise(""), "c_name")
    return c.select("c_custkey", tables.absolute(raw, "/root/of/mapping").alias("path"))


@query(f"""WITH {PANEL}, r AS (SELECT model, cohort, rank() OVER (PARTITION BY cohort ORDER BY margin) AS r FROM panel),
c AS (SELECT a.cohort AS one, b.cohort AS other, corr(a.r, b.r) AS rho, count(*) AS n FROM r a JOIN r b ON a.model = b.model AND a.cohort < b.cohort GROUP BY ALL) SELECT one, other, round(rho, 9) AS rho, n FROM c""")
def ordering_agreement(spark, sf_dir):
    """Rank correlation of the models' orders between all pairs of cohorts."""
    p = panel(spark, sf_dir)
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, (F.col("a.model") == F.col("b.model")) & (F.col("a.cohort") < F.col("b.cohort")))  # models times pairs of cohorts
    both = both.select(F.col("a.cohort").alias("one"), F.col("b.cohort").alias("other"), F.col("a.margin").alias("x"), F.col("b.margin").alias("y"))
    return rounded(stats.spearman(both, "x", "y", ("one", "other")).select("one", "other", F.col("spearman").alias("rho"), "n"))


# --- manifests from metadata, models' vectors, probes against measures ----------------------------------------------------------------------------------------


def order_metadata(spark, sf_dir):
    """Metadata and source rows of the orders, as a provider would send them: keys as text with blanks."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    metadata = o.select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("slide_id"), key.alias("patch_id"), F.col("o_orderstatus").alias("biological_class"), F.col("o_orderpriority").alias("medical_center"),
        F.when(F.col("o_orderkey") % 4 == 0, "OOD").otherwise("ID").alias("subset"),
    )
    source = o.select(F.col("o_custkey").cast("string").alias("slide_id"), F.concat(key, F.lit(" ")).alias("patch_id"), F.concat(F.lit("s"), key).alias("sample_id"), F.concat(F.lit("/img/"), key).alias("image_path"))
    return metadata, source


@query("""SELECT 's' || o_orderkey AS sample_id, '/img/' || o_orderkey AS image_path, o_orderstatus AS label, o_orderpriority AS confounder, o_custkey::VARCHAR AS group_id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'OOD' ELSE 'ID' END AS apd_split FROM orders""")
def metadata_split(spark, sf_dir):
    return align.with_metadata(*order_metadata(spark, sf_dir), "split")


@query("""WITH x AS (SELECT o_orderstatus AS label, o_orderpriority AS confounder, trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'), '_') AS t, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT a.label AS l1, b.label AS l2, a.confounder AS c1, d.confounder AS c2, a.label || '+' || b.label || '__' || a.t || '_' || d.t AS subset FROM x a JOIN x b ON a.label < b.label AND a.confounder = b.confounder
  JOIN x d ON d.label = a.label AND d.confounder > a.confounder JOIN x e ON e.label = b.label AND e.confounder = d.confounder)
SELECT subset, label, confounder, n FROM s JOIN x ON label IN (l1, l2) AND confounder IN (c1, c2)""")
def metadata_expanded(spark, sf_dir):
    rows = align.with_metadata(*order_metadata(spark, sf_dir), "expand")
    return rows.groupBy("subset", "label", "confounder").agg(F.count(F.lit(1)).alias("n"))


def four_tokens():
    """A stand-in for a model: a row's numbers as four tokens."""
    import numpy as np

    return lambda values: np.asarray(values, float).reshape(len(values), 4, -1)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) // 4 AS w FROM embeddings), t AS (SELECT vec_id, w, v, unnest(range(1, w + 1)) AS i FROM e)
SELECT 'first' AS model, vec_id, i::BIGINT AS place, round(v[i], 9) AS value FROM t
UNION ALL SELECT 'first_and_mean', vec_id, i::BIGINT, round(v[i], 9) FROM t UNION ALL SELECT 'first_and_mean', vec_id, (w + i)::BIGINT, round((v[2 * w + i] + v[3 * w + i]) / 2, 9) FROM t""")
def pooled_vectors(spark, sf_dir):
    """Two poolings of one model's tokens, the second one with a register token that is passed over."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").withColumnRenamed("embedding", "image")
    made = encoders.embed_by_model(e, "image", {"first": {"make": four_tokens, "mean": False}, "first_and_mean": {"make": four_tokens, "skip": 2}})
    return made.select("model", "vec_id", F.posexplode("embedding").alias("at", "value")).select("model", "vec_id", (F.col("at") + 1).cast("long").alias("place"), F.round("value", 9).alias("value"))


@query(f"""WITH {PANEL}, m AS (SELECT model, avg(n) AS probe, avg(margin) AS margin, min(ltm) AS ltm FROM panel WHERE model <> 0 GROUP BY model), t AS (SELECT 'margin' AS target, probe AS x, margin AS y FROM m UNION ALL SELECT 'ltm', probe, ltm FROM m),
r AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY x) + (count(*) OVER (PARTITION BY target, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY target ORDER BY y) + (count(*) OVER (PARTITION BY target, y) - 1) / 2 AS ry FROM t)
SELECT target, count(*) AS n, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY target""")
def probe_correlations(spark, sf_dir):
    """Nation 0 is the control."""
    m = panel(spark, sf_dir).groupBy("model").agg(F.avg("n").alias("probe"), F.avg("margin").alias("margin"), F.min("ltm").alias("ltm"))
    return rounded(studies.probe_scalars(m, "probe", ["margin", "ltm"], control=0).select("target", "n", "pearson", "spearman"))


@query(f"""WITH {PANEL}, f AS (SELECT cohort, model FROM panel a WHERE NOT EXISTS (SELECT 1 FROM panel b WHERE b.cohort = a.cohort AND b.margin >= a.margin AND b.ltm >= a.ltm AND (b.margin > a.margin OR b.ltm > a.ltm)))
SELECT model, CASE WHEN count(*) = 2 THEN 'stays' WHEN max(cohort) = 'MACHINERY' THEN 'enters' ELSE 'leaves' END AS change FROM f WHERE cohort IN ('BUILDING', 'MACHINERY') GROUP BY model""")
def frontier_changes(spark, sf_dir):
    p = panel(spark, sf_dir)
    return studies.frontier_changes(p.where("cohort = 'BUILDING'"), p.where("cohort = 'MACHINERY'"), "margin", "ltm")
