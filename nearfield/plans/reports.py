"""Registered queries over panels, subgroups, schedules and resampling.

Panels of models come from the star schema: a customer's nation is the model, its market segment the cohort, its balance the score.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import downstream, report, stats
from .catalogue import ALPHA, MARGIN, M, base, margin_rows, query, rounded

PANEL = "panel AS (SELECT CAST(c_nationkey AS BIGINT) AS model, c_mktsegment AS cohort, avg(c_acctbal) / 10000 AS margin, min(c_acctbal) / 10000 AS ltm, count(*) AS n FROM customer GROUP BY ALL)"


def panel(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x = F.col("c_acctbal") / 10000
    return c.groupBy(F.col("c_nationkey").cast("long").alias("model"), F.col("c_mktsegment").alias("cohort")).agg((F.avg("c_acctbal") / 10000).alias("margin"), F.min(x).alias("ltm"), F.count(F.lit(1)).alias("n"))


def samples(spark, sf_dir):
    rows = margin_rows(spark, sf_dir, (M,), False).select("q", "margin")
    m = base(spark, sf_dir).select(F.col("row_id").alias("q"), "sample_id", "label", "confounder", "group_id")
    return rows.join(m, "q")


SUBGROUPS = MARGIN + f""",
g AS (SELECT m.sample_id, m.label, m.confounder, r.margin, row_number() OVER (ORDER BY r.margin, m.sample_id) <= ceil({ALPHA} * count(*) OVER ()) AS tail FROM r JOIN m ON m.row_id = r.q WHERE r.m = {M}),
lo AS (SELECT 'stratum' AS scope, label, confounder, margin, tail FROM g UNION ALL SELECT 'label', label, '', margin, tail FROM g UNION ALL SELECT 'confounder', '', confounder, margin, tail FROM g),
qs AS (SELECT scope, label, confounder, quantile_cont(margin, {ALPHA}) AS q FROM lo GROUP BY ALL),
own AS (SELECT scope, label, confounder, count(*) AS n, avg(margin) AS mean, median(margin) AS median, count(*) FILTER (margin < 0) AS n_negative, sum(margin) AS total, count(*) FILTER (tail) AS n_tail,
  avg(margin) FILTER (tail) AS tail_mean, coalesce(sum(margin) FILTER (tail), 0) AS tail_total, avg(margin) FILTER (margin <= q) AS ltm FROM lo JOIN qs USING (scope, label, confounder) GROUP BY ALL),
wh AS (SELECT count(*) AS wc, sum(margin) AS w, count(*) FILTER (margin < 0) AS wn, sum(margin) FILTER (tail) AS wt, count(*) FILTER (tail) AS ts FROM g),
rest AS (SELECT b.scope, b.label, b.confounder, median(a.margin) AS rest_median FROM own b JOIN lo a ON a.scope = b.scope AND (a.label <> b.label OR a.confounder <> b.confounder) GROUP BY ALL),
rep AS (SELECT own.scope, own.label, own.confounder, n, mean, median, n_negative, n_negative / n AS negative, ltm, rest_median, (w - total) / (wc - n) AS rest_mean, (wn - n_negative) / (wc - n) AS rest_negative,
  n_tail, n_tail / n / (ts / wc) AS tail_ratio, n_tail / ts AS tail_share, tail_mean, CASE WHEN ts > n_tail THEN (wt - tail_total) / (ts - n_tail) END AS rest_tail_mean, median - ltm AS internal_drop FROM own JOIN rest USING (scope, label, confounder), wh)"""  # fmt: skip


@query(f"""WITH {SUBGROUPS} SELECT scope, label, confounder, n, round(mean, 6) AS mean, round(median, 6) AS median, n_negative, round(rest_mean, 6) AS rest_mean, round(rest_median, 6) AS rest_median,
  round(rest_negative, 6) AS rest_negative, n_tail, round(tail_ratio, 6) AS tail_ratio, round(tail_share, 6) AS tail_share FROM rep""")
def subgroup_report(spark, sf_dir):
    rows = report.subgroups(samples(spark, sf_dir), ALPHA)
    kept = rows.select("scope", "label", "confounder", "n", "mean", "median", "n_negative", "rest_mean", "rest_median", "rest_negative", "n_tail", "tail_ratio", "tail_share")
    return kept.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in kept.dtypes))


@query(f"""WITH {SUBGROUPS}, z AS (SELECT *, median - rest_median <= -0.05 AND negative - rest_negative >= 0.05 AS weak, tail_mean - rest_tail_mean AS gap FROM rep),
y AS (SELECT *, CASE WHEN n_tail = 0 THEN 'no_tail_samples' WHEN gap IS NULL THEN 'no_rest_tail' WHEN gap <= -0.1 THEN 'more severe' WHEN gap >= 0.1 THEN 'not more severe' ELSE 'similar' END AS severity FROM z)
SELECT scope, label, confounder, severity,
  CASE WHEN n < 2 THEN 'insufficient_support' WHEN weak AND median < 0 AND rest_median >= 0 THEN 'broad_weakness' WHEN weak AND median >= 0 AND rest_median >= 0 THEN 'relative_weakness'
    WHEN weak AND median < 0 AND rest_median < 0 THEN 'aggravated_weakness' ELSE 'neutral' END AS tier1,
  CASE WHEN n < 10 THEN 'insufficient_support' WHEN ltm <= -0.05 AND internal_drop >= 0.1 AND negative >= 0.15 AND n_negative >= 3 AND median < 0 THEN 'aggravated_weakness'
    WHEN ltm <= -0.05 AND internal_drop >= 0.1 AND negative >= 0.15 AND n_negative >= 3 AND median >= 0.07 THEN 'hidden_pocket' WHEN median >= 0.07 AND ltm >= 0 AND internal_drop >= 0.1 THEN 'internal_spread' ELSE 'neutral' END AS tier2,
  CASE WHEN n < 2 THEN 'insufficient_support' WHEN tail_ratio >= 2 AND severity = 'more severe' THEN 'tail_enriched_and_severe' WHEN tail_ratio >= 2 THEN 'tail_enriched' WHEN severity = 'more severe' THEN 'tail_severe' ELSE 'neutral' END AS tier3
FROM y""")
def tier_status(spark, sf_dir):
    return report.tiers(report.subgroups(samples(spark, sf_dir), ALPHA)).select("scope", "label", "confounder", "severity", "tier1", "tier2", "tier3")


@query(f"""WITH {PANEL}, p AS (SELECT model || '/' || cohort AS model, n / 20 AS support, 1 - n / 20 AS oo, margin, ltm FROM panel)
SELECT model, 'coverage_risk' AS flag, 'high' AS severity, round(support, 9) AS value, 0.75::DOUBLE AS threshold FROM p WHERE support <= 0.75
UNION ALL SELECT model, 'poor_embedding', 'high', round(oo, 9), 0.1::DOUBLE FROM p WHERE oo >= 0.1 UNION ALL SELECT model, 'tail_gap', 'medium', round(margin - ltm, 9), 0.2::DOUBLE FROM p WHERE margin - ltm >= 0.2""")
def action_flags(spark, sf_dir):
    p = panel(spark, sf_dir)
    p = p.select(F.concat_ws("/", F.col("model").cast("string"), "cohort").alias("model"), (F.col("n") / 20).alias("support"), (1 - F.col("n") / 20).alias("undefined_oo"), "margin", "ltm")
    return rounded(report.action_flags(p))


@query(f"""WITH {MARGIN}, x AS (SELECT median(margin) FILTER (confounder = 'en') AS inside, median(margin) FILTER (confounder <> 'en') AS outside FROM r JOIN m ON m.row_id = r.q WHERE r.m = {M})
SELECT round(inside, 9) AS inside, round(outside, 9) AS outside, round((1 + inside) / (1 - inside), 9) AS odds_inside, round((1 + outside) / (1 - outside), 9) AS odds_outside,
  round((1 + inside) / (1 - inside) / ((1 + outside) / (1 - outside)), 9) AS boost FROM x""")
def overlap_odds(spark, sf_dir):
    return rounded(report.overlap_odds(samples(spark, sf_dir).withColumn("inside_set", F.col("confounder") == "en"), "inside_set"))


RANKED = PANEL + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY margin DESC, model) AS rank FROM panel)"


@query(f"WITH {RANKED} SELECT cohort, model, round(margin, 9) AS margin, rank FROM ranked")
def cohort_table(spark, sf_dir):
    return rounded(panel(spark, sf_dir).withColumn("rank", stats.rank_first("margin", "model", ("cohort",))).select("cohort", "model", "margin", "rank"))


@query(f"""WITH {RANKED}, a AS (SELECT model, avg(rank) AS mean_rank, avg(margin) AS mean_margin, count(*) AS c FROM ranked GROUP BY model)
SELECT model, round(mean_rank, 9) AS mean_rank, round(mean_margin, 9) AS mean_margin, row_number() OVER (ORDER BY mean_rank, model) AS place FROM a WHERE c = (SELECT count(DISTINCT cohort) FROM panel)""")
def aggregate_ranks(spark, sf_dir):
    return rounded(report.cohort_ranks(panel(spark, sf_dir)))


@query(f"WITH {PANEL} SELECT cohort, model FROM panel a WHERE NOT EXISTS (SELECT 1 FROM panel b WHERE b.cohort = a.cohort AND b.margin >= a.margin AND b.ltm >= a.ltm AND (b.margin > a.margin OR b.ltm > a.ltm))")
def pareto_frontier(spark, sf_dir):
    return stats.frontier(panel(spark, sf_dir), "margin", "ltm", ("cohort",)).select("cohort", "model")


@query(f"WITH {MARGIN}, b AS (SELECT least(greatest(trunc((margin - (-0.2)) / ((0.2 - (-0.2)) / 20))::BIGINT, 0), 19) AS bin FROM r WHERE m = {M}) SELECT g.bin::BIGINT AS bin, count(b.bin) AS n FROM range(20) g(bin) LEFT JOIN b ON g.bin = b.bin GROUP BY g.bin")
def histogram(spark, sf_dir):
    return stats.histogram(margin_rows(spark, sf_dir, (M,), False), "margin", -0.2, 0.2, 20)


@query(f"""WITH {PANEL}, r AS (SELECT cohort, margin, ltm, rank() OVER (PARTITION BY cohort ORDER BY margin) + (count(*) OVER (PARTITION BY cohort, margin) - 1) / 2 AS ra, rank() OVER (PARTITION BY cohort ORDER BY ltm) + (count(*) OVER (PARTITION BY cohort, ltm) - 1) / 2 AS rb FROM panel)
SELECT cohort, round(corr(ra, rb), 9) AS spearman, round(corr(margin, ltm), 9) AS pearson, count(*) AS n FROM r GROUP BY cohort""")
def spearman_matrix(spark, sf_dir):
    return rounded(stats.spearman(panel(spark, sf_dir), "margin", "ltm", ("cohort",)))


@query("""WITH c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*)::DOUBLE AS o FROM customer GROUP BY ALL), x AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb FROM c)
SELECT round(sqrt((sum(o * o / (ra * rb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 9) AS cramers_v FROM x""")
def cramers_v(spark, sf_dir):
    return rounded(stats.cramers_v(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_mktsegment", "c_nationkey"))


@query(f"WITH {MARGIN} SELECT q, round(max(margin) FILTER (m = 1), 9) AS m1, round(max(margin) FILTER (m = 3), 9) AS m3, round(max(margin) FILTER (m = 5), 9) AS m5 FROM r GROUP BY q")
def pivot_m(spark, sf_dir):
    rows = margin_rows(spark, sf_dir, (1, 3, 5), False).groupBy("q").pivot("m", [1, 3, 5]).agg(F.first("margin"))
    return rounded(rows.withColumnsRenamed({"1": "m1", "3": "m3", "5": "m5"}))


@query(f"""WITH {PANEL}, p AS (SELECT margin AS x, ltm AS y FROM panel) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM p""")
def trend(spark, sf_dir):
    return stats.trend(panel(spark, sf_dir), "margin", "ltm").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(f"""WITH {PANEL}, j AS (SELECT a.model, a.margin, b.margin AS margin_b FROM panel a JOIN panel b ON a.model = b.model AND a.cohort = 'BUILDING' AND b.cohort = 'MACHINERY')
SELECT model, round(margin, 9) AS margin, round(margin_b, 9) AS margin_b, round(margin_b - margin, 9) AS delta_margin, round(abs(margin_b - margin), 9) AS change FROM j""")
def run_comparison(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(report.compare_runs(p.where("cohort = 'BUILDING'"), p.where("cohort = 'MACHINERY'"), ["model"], ["margin"]))


@query("SELECT p_partkey, round((p_size - 1.0::DOUBLE) / (p_size + 1.0::DOUBLE), 9) AS ratio FROM part")
def margin_scale(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("ratio"))
    return rounded(report.margin_scale(p, "ratio"))


@query("""SELECT p_partkey, CASE WHEN s < 0.25 THEN 'critical' WHEN s < 0.5 THEN 'warning' ELSE 'good' END AS band FROM (SELECT p_partkey, least(greatest(p_size / 50, 0), 1) AS s FROM part)""")
def support_bands(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", vectors.status(F.col("p_size") / 50).alias("band"))


@query("SELECT p_partkey, list_contains(string_split(replace(p_type, ' ', ';'), ';'), 'BRASS') AS hit, coalesce(nullif(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'value') AS token FROM part")
def provenance_tags(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", vectors.has_tag(F.replace("p_type", F.lit(" "), F.lit(";")), "BRASS").alias("hit"), vectors.token(F.col("p_name")).alias("token"))


# --- probes ----------------------------------------------------------------------------------------------------------------------------------------------

@query("""WITH two AS (SELECT * FROM (VALUES ('camelyon', 8, 2, 7, 1, 14), ('tolkach_esca', 4, 6, 3, 1, 6), ('prostate', 9, 2, 16, 2, 32), ('pcabiop', 11, 2, 100, 10, 200)) t(name, splits, classes, load, step, top)),
a AS (SELECT name, split, i, j, CASE WHEN (i = 0) = (j < classes // 2) THEN load - step * split ELSE load + step * split END AS take, top FROM two, range(11) s(split), range(2) x(i), range(6) y(j) WHERE split < splits AND j < classes),
b AS (SELECT 'tcga' AS name, split, i, j, CASE WHEN i = j THEN split + 2 WHEN i + j = 3 THEN (CASE WHEN split % 2 = 1 THEN 1 WHEN split < 3 THEN 2 ELSE 0 END) ELSE (CASE WHEN split < 2 THEN 2 WHEN split < 5 THEN 1 ELSE 0 END) END AS take, 8 AS top FROM range(7) s(split), range(4) x(i), range(4) y(j)),
cells AS (SELECT c_nationkey % 4 AS i, c_custkey % 6 AS j, count(*) AS n FROM customer GROUP BY ALL)
SELECT name, split::BIGINT AS split, s.i::BIGINT AS i, s.j::BIGINT AS j, take::BIGINT AS take, top::BIGINT AS max_train_slides, coalesce(n, 0) AS available, coalesce(n, 0) >= take AS enough
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) s LEFT JOIN cells c ON s.i = c.i AND s.j = c.j""")
def schedule_tables(spark, sf_dir):
    """Every schedule against the customers that its cells could take rows from."""
    parts = [downstream.schedule(spark, n).withColumn("name", F.lit(n)) for n in (*downstream.TWO_SIDED, "tcga")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    cells = customers.groupBy((F.col("c_nationkey") % 4).cast("int").alias("i"), (F.col("c_custkey") % 6).cast("int").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    found = out.join(cells, ["i", "j"], "left").withColumn("available", F.coalesce("n", F.lit(0).cast("long")))
    return rounded(found.select("name", "split", "i", "j", "take", "max_train_slides", "available", (F.col("available") >= F.col("take")).alias("enough")))


@query("""WITH o AS (SELECT c_custkey AS row_id, c_nationkey % 2 AS i, ascii(c_mktsegment) % 2 AS j FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY row_id) - 1 AS pos FROM o),
s AS (SELECT split, i, j, CASE WHEN (i = 0) = (j < 1) THEN 7 - split ELSE 7 + split END * 3 AS take FROM range(8) a(split), range(2) b(i), range(2) c(j))
SELECT split::BIGINT AS split, p.row_id, CASE WHEN pos < take THEN 'train' ELSE 'validation' END AS role FROM p JOIN s USING (i, j) WHERE pos < take + take // 14
UNION ALL SELECT split::BIGINT, p.row_id, 'held_out' FROM p JOIN s USING (i, j) WHERE pos >= 45""")
def probe_slices(spark, sf_dir):
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    cells = c.select(F.col("c_custkey").alias("row_id"), (F.col("c_nationkey") % 2).cast("int").alias("i"), (F.ascii("c_mktsegment") % 2).cast("int").alias("j"))
    order = cells.withColumn("pos", F.row_number().over(Window.partitionBy("i", "j").orderBy("row_id")) - 1).withColumn("iter", F.lit(0))
    return rounded(downstream.slices(order, downstream.schedule(spark, "camelyon", 3), 3).select("split", "row_id", "role"))


@query()
def probe_sweep(spark, sf_dir):
    """Probes of the label's parity from the vectors, languages en and not en as confounders."""
    m = base(spark, sf_dir)
    rows = m.select("row_id", (F.col("confounder") == "en").cast("int").alias("i"), (F.col("label").cast("int") % 2).alias("j"), F.col("embedding").cast("array<double>").alias("features"))
    return downstream.probe_sweep(rows, downstream.schedule(spark, "camelyon"), iterations=20, validation=0.2)


# --- resampling ------------------------------------------------------------------------------------------------------------------------------------------


def _draw_sql(clusters: int, n: int, seed: int) -> str:
    """The draws as values: cluster numbers follow the sorted names."""
    import numpy as np

    rows = []
    for rep, drawn in enumerate(stats.draws([str(i) for i in range(clusters)], n, seed)):
        at, times = np.unique(drawn, return_counts=True)
        rows += [f"({rep}, {i}, {t})" for i, t in zip(at.tolist(), times.tolist(), strict=True)]
    return "d(rep, pos, times) AS (VALUES " + ", ".join(rows) + ")"


NATIONS = "c AS (SELECT dense_rank() OVER (ORDER BY CAST(c_nationkey AS VARCHAR)) - 1 AS pos, c_acctbal AS x, c_mktsegment AS seg, c_custkey FROM customer)"
COPIES = "SELECT rep, c.* FROM d JOIN c USING (pos), range(d.times) AS u(copy)"


def customers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_nationkey").cast("string").alias("cluster"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") + F.col("c_custkey") % 7).alias("y"))


@query(f"""WITH {NATIONS}, {_draw_sql(25, 2000, 0)}, r AS (SELECT rep, median(x) AS med FROM ({COPIES}) GROUP BY rep)
SELECT (SELECT round(median(x), 6) FROM c) AS point, round(quantile_cont(med, 0.025), 6) AS low, round(quantile_cont(med, 0.975), 6) AS high, count(*) AS n_reps FROM r""")
def bootstrap_median(spark, sf_dir):
    b = stats.bootstrap_median(customers(spark, sf_dir), "x", "cluster", n=2000)
    return b.select(*(F.round(c, 6).alias(c) for c in ("point", "low", "high")), "n_reps")


@query(f"""WITH {NATIONS}, {_draw_sql(25, 2000, 1)}, r AS (SELECT rep, median(x + c_custkey % 7) - median(x) AS delta FROM ({COPIES}) GROUP BY rep)
SELECT (SELECT round(median(x + c_custkey % 7) - median(x), 6) FROM c) AS point, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, count(*) AS n_reps FROM r""")
def bootstrap_delta(spark, sf_dir):
    b = stats.bootstrap_delta(customers(spark, sf_dir), "x", "y", "cluster", n=2000, seed=1)
    return b.select(*(F.round(c, 6).alias(c) for c in ("point", "low", "high")), "n_reps")


@query(f"""WITH {NATIONS}, {_draw_sql(25, 2000, 2)}, r AS (SELECT rep, seg, median(x) AS med FROM ({COPIES}) GROUP BY rep, seg), k AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY med DESC, seg) AS rank FROM r)
SELECT seg AS segment, round(avg(rank), 9) AS mean_rank, trunc(quantile_cont(rank, 0.025))::BIGINT AS low_rank, trunc(quantile_cont(rank, 0.975))::BIGINT AS high_rank FROM k GROUP BY seg""")
def rank_stability(spark, sf_dir):
    return rounded(stats.rank_stability(customers(spark, sf_dir), "segment", "x", "cluster", n=2000, seed=2)[0])


@query(f"""WITH {NATIONS}, {_draw_sql(25, 2000, 2)}, r AS (SELECT rep, seg, median(x) AS med FROM ({COPIES}) GROUP BY rep, seg)
SELECT a.seg AS model_a, b.seg AS model_b, round(avg((a.med > b.med)::INT::DOUBLE), 9) AS p_win FROM r a JOIN r b ON a.rep = b.rep AND a.seg <> b.seg GROUP BY ALL""")
def pairwise_wins(spark, sf_dir):
    return rounded(stats.rank_stability(customers(spark, sf_dir), "segment", "x", "cluster", n=2000, seed=2)[1])


@query()
def bootstrap_spearman(spark, sf_dir):
    points = [(r["a"], r["b"]) for r in panel(spark, sf_dir).groupBy("model").agg(F.avg("margin").alias("a"), F.avg("ltm").alias("b")).orderBy("model").collect()]  # one row a model
    return spark.createDataFrame([stats.bootstrap_spearman(points, n=2000)], "rho double, low double, high double")


@query("""WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source), e AS (SELECT *, size * 137 / sum(size) OVER () AS exact FROM s), f AS (SELECT *, floor(exact) AS seats FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY round(exact - seats, 12) DESC, source) AS place, 137 - sum(seats) OVER () AS rest FROM f) SELECT source, size, (seats + (place <= rest)::INT)::BIGINT AS quota FROM p""")
def stratified_quota(spark, sf_dir):
    return stats.stratified_quota(spark.read.parquet(f"{sf_dir}/documents.parquet"), 137, "source")


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('seed|' || source || '|' || lang || '|' || doc_id), doc_id) AS n FROM documents) WHERE n = 1")
def seeded_pick(spark, sf_dir):
    return stats.seeded_pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "seed", ("source", "lang")).select("source", "lang", "doc_id")
