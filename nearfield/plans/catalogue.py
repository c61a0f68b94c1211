"""Registered queries by name, and the SQL for each.

All queries use whole tables. The manifest is embeddings joined with documents: row_id = vec_id, label = the vector's label, confounder = the document's language,
groups of four neighbouring ids. Floats are rounded to nine places for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, knn, margin, neighbors, scoring, stats
from ..sources import manifest as mf

K, K_MAX, KS, M, ALPHA, TAU = 11, 50, (1, 3, 5, 7, 9, 11, 21, 31), 5, 0.1, 0.2
MS = (1, 2, 3, 4, 5)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.from_tables(spark, sf_dir)


def units(df: DataFrame) -> DataFrame:
    return df.select("subset", F.col("row_id").alias("q"))


def near(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return neighbors.nearest(base(spark, sf_dir), k)


#: Common table expressions that the SQL shares: manifest, unit vectors, pairs, ranked neighbours.
MAN = """
m AS (SELECT e.vec_id AS row_id, 's' || e.vec_id AS sample_id, '/img/' || e.vec_id AS image_path, CAST(e.label AS VARCHAR) AS label, d.lang AS confounder, 'g' || (e.vec_id // 4) AS group_id,
  CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""
PAIRS = (
    MAN
    + """,
u AS (SELECT row_id, label, confounder, group_id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12)) AS v FROM m),
p AS (SELECT a.row_id AS q, b.row_id AS c, a.label = b.label AS same_label, a.confounder = b.confounder AS same_conf, round(1 - list_inner_product(a.v, b.v), 12) AS dist,
  CASE WHEN a.label = b.label AND a.confounder = b.confounder THEN 'SS' WHEN a.label = b.label THEN 'SO' WHEN a.confounder = b.confounder THEN 'OS' ELSE 'OO' END AS type
  FROM u a JOIN u b ON a.group_id <> b.group_id)"""
)
NEAR = PAIRS + ",\nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, c) AS rank FROM p) WHERE rank <= {k})"
TYPED = PAIRS + ",\nt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, type ORDER BY dist, c) AS rank FROM p WHERE type IN ('SO', 'OS')) WHERE rank <= {m})"
GRID = "(VALUES " + ", ".join(f"({k})" for k in KS) + ") g(k)"
#: Counts and weights of each unit at each k.
SCORED = (
    NEAR.replace("{k}", str(max(KS)))
    + f""",
w AS (SELECT *, CASE WHEN type IN ('SO', 'OS') THEN exp(-(dist - min(dist) FILTER (type IN ('SO', 'OS')) OVER ()) / {{tau}}) END AS w FROM n),
s AS (SELECT k, q, count(*) FILTER (type = 'SS') AS n_ss, count(*) FILTER (type = 'SO') AS n_so, count(*) FILTER (type = 'OS') AS n_os, count(*) FILTER (type = 'OO') AS n_oo,
  coalesce(sum(w) FILTER (type = 'SO'), 0) AS w_so, coalesce(sum(w) FILTER (type = 'OS'), 0) AS w_os FROM w, {GRID} WHERE rank <= k GROUP BY k, q)"""
)
COUNTED = SCORED.replace("exp(-(dist - min(dist) FILTER (type IN ('SO', 'OS')) OVER ()) / {tau})", "1.0::DOUBLE")


def counted_to(k_max: int) -> str:
    """Counts at every k up to k_max."""
    return COUNTED.replace(f"rank <= {max(KS)}", f"rank <= {k_max}").replace(GRID, f"range(1, {k_max + 1}) g(k)")


POOLED = """SELECT CAST(k AS BIGINT) AS k, round(sum(w_so) / sum(w_so + w_os), 9) AS value, round(avg((n_so + n_os > 0)::INT::DOUBLE), 9) AS support,
  round(avg((n_so + n_os = 0 AND n_ss > n_oo)::INT::DOUBLE), 9) AS undefined_ss, round(avg((n_so + n_os = 0 AND n_oo > n_ss)::INT::DOUBLE), 9) AS undefined_oo,
  round(avg((n_so + n_os = 0 AND n_ss = n_oo)::INT::DOUBLE), 9) AS undefined_tie, count(*) AS n_units FROM s GROUP BY k"""


# --- manifests -------------------------------------------------------------------------------------------------------------------------------------------


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw manifest over customers: spaces around names, some missing labels, some blank groups."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(
        F.col("c_custkey").alias("row_id"),
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("sample_id"),
        F.concat(F.lit("/"), "c_custkey").alias("image_path"),
        F.when(F.col("c_custkey") % 7 > 0, F.concat("c_mktsegment", F.lit("\t"))).alias("label"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.when(F.col("c_custkey") % 50 == 0, F.lit(" ")).otherwise(F.concat(F.lit("g"), F.floor(F.col("c_custkey") / 3))).alias("group_id"),
    )


PADDED = """
r AS (SELECT c_custkey AS row_id, c_name AS sample_id, '/' || c_custkey AS image_path, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment ELSE 'nan' END AS label, CAST(c_nationkey AS VARCHAR) AS confounder,
  CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'g' || (c_custkey // 3) END AS group_id FROM customer)"""


@query(f"WITH {PADDED} SELECT row_id, trim(sample_id) AS sample_id, image_path, label, confounder, group_id FROM r")
def manifest_normalized(spark, sf_dir):
    return mf.normalise(padded(spark, sf_dir), "nation", check=False).select("row_id", "sample_id", "image_path", "label", "confounder", "group_id")


@query(f"WITH {PADDED} SELECT row_id FROM r WHERE group_id = ''")
def blank_group_rows(spark, sf_dir):
    return mf.blank_groups(padded(spark, sf_dir)).select("row_id")


@query(f"WITH {MAN}, f AS (SELECT label, min(row_id) AS first_row FROM m GROUP BY label) SELECT label, first_row, row_number() OVER (ORDER BY first_row) - 1 AS code FROM f")
def factor_codes(spark, sf_dir):
    return mf.factor_codes(base(spark, sf_dir), "label")


@query(f"WITH {MAN} SELECT label, confounder, count(*) AS n FROM m GROUP BY ALL")
def strata_counts(spark, sf_dir):
    return mf.strata(base(spark, sf_dir))


EXPANDED = (
    MAN
    + """,
cells AS (SELECT DISTINCT label, confounder FROM m),
subsets AS (SELECT a.label AS l1, b.label AS l2, a.confounder AS c1, d.confounder AS c2 FROM cells a JOIN cells b ON a.confounder = b.confounder AND a.label < b.label
  JOIN cells c ON c.label = a.label AND c.confounder > a.confounder JOIN cells d ON d.label = b.label AND d.confounder = c.confounder),
x AS (SELECT l1 || '+' || l2 || '__' || c1 || '_' || c2 AS subset, m.* FROM subsets JOIN m ON m.label IN (l1, l2) AND m.confounder IN (c1, c2))"""
)


@query(f"WITH {EXPANDED} SELECT subset, row_id, label, confounder FROM x")
def paired_expansion(spark, sf_dir):
    return mf.expand_2x2(base(spark, sf_dir).drop("subset")).select("subset", "row_id", "label", "confounder")


@query(f"WITH {EXPANDED} SELECT subset, 2::BIGINT AS labels, 2::BIGINT AS confounders, 4::BIGINT AS cells, count(*) AS rows FROM x GROUP BY subset")
def complete_subsets(spark, sf_dir):
    return mf.complete_subsets(mf.expand_2x2(base(spark, sf_dir).drop("subset")))


@query("""WITH r AS (SELECT doc_id AS row_id, lang AS confounder, source AS label, CASE WHEN lang IN ('en', 'fr') THEN 'x' ELSE lang END AS subset FROM documents WHERE source IN ('src1', 'src2'))
SELECT row_id, subset FROM r WHERE subset IN (SELECT subset FROM r GROUP BY subset HAVING count(DISTINCT label) = 2 AND count(DISTINCT confounder) = 2 AND count(DISTINCT label || '|' || confounder) = 4)""")
def retained_memberships(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnsRenamed({"doc_id": "row_id", "source": "label", "lang": "confounder"})
    found = mf.keep_labels(d.withColumn("subset", F.when(F.col("confounder").isin("en", "fr"), "x").otherwise(F.col("confounder"))), "src1,src2")
    return mf.retain_complete(found).select("row_id", "subset")


@query(f"WITH {EXPANDED} SELECT subset, row_id, row_number() OVER (ORDER BY subset, row_id) - 1 AS occurrence_index FROM x")
def occurrence_table(spark, sf_dir):
    return mf.occurrences(mf.expand_2x2(base(spark, sf_dir).drop("subset"))).select("subset", "row_id", "occurrence_index")


# --- alignment -------------------------------------------------------------------------------------------------------------------------------------------


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of a view: a part and supplier for each tile, many rows a tile."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    row = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return x.select(row.alias("row_id"), F.concat(F.lit("p"), "l_partkey").alias("sample_id"), F.concat(F.lit(" /"), "l_suppkey").alias("image_path"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("confounder"), F.concat(F.lit("s"), "l_suppkey").alias("group_id"))


REPEATED = "r AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, 'p' || l_partkey AS sample_id, '/' || l_suppkey AS image_path, l_returnflag AS label, l_linestatus AS confounder, 's' || l_suppkey AS group_id FROM lineitem)"


@query(f"""WITH {REPEATED}, f AS (SELECT sample_id, image_path, label, confounder, group_id, min(row_id) AS first_row FROM r GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY first_row, sample_id, image_path, label, confounder, group_id) - 1 AS source_index FROM f""")
def dedupe_sources(spark, sf_dir):
    return align.dedupe_sources(repeated(spark, sf_dir))


@query(f"WITH {REPEATED}, t AS (SELECT sample_id, image_path, min(row_id) AS tile_index FROM r GROUP BY ALL) SELECT row_id, tile_index FROM r JOIN t USING (sample_id, image_path)")
def view_row_index(spark, sf_dir):
    r = repeated(spark, sf_dir)
    tiles = r.groupBy(*align.TILE).agg(F.min("row_id").alias("row_id"))
    return align.view_rows(r, tiles).select("row_id", "tile_index")


@query(f"WITH {MAN}, two AS (SELECT row_id, 0 AS copy, v FROM m UNION ALL SELECT row_id, 1, v FROM m) SELECT row_id, copy::BIGINT AS copy, round(list_sum(v), 9) AS total FROM two")
def expanded_rows(spark, sf_dir):
    m = base(spark, sf_dir)
    twice = m.drop("embedding").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total")
    return rounded(align.expand(twice, m).select("row_id", "copy", total))


@query("SELECT vec_id FROM embeddings ANTI JOIN labels ON vec_id = doc_id")
def missing_keys(spark, sf_dir):
    e, labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return align.missing_keys(e, labels.withColumnRenamed("doc_id", "vec_id"), ["vec_id"]).select("vec_id")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def join_cardinality_check(spark, sf_dir):
    return align.duplicates(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_partkey", "l_suppkey"])


@query("""WITH fresh AS (SELECT c_custkey, 'new' AS c_mktsegment FROM customer WHERE c_acctbal < 0)
SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN fresh USING (c_custkey) UNION ALL SELECT * FROM fresh""")
def upsert_by_key(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    fresh = c.where("c_acctbal < 0").select("c_custkey", F.lit("new").alias("c_mktsegment"))
    return align.upsert(c.select("c_custkey", "c_mktsegment"), fresh, ["c_custkey"])


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT doc_id AS k FROM labels) a FULL JOIN (SELECT DISTINCT vec_id AS k FROM embeddings) b ON a.k = b.k""")
def roster_check(spark, sf_dir):
    a, b = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return align.roster(a.withColumnRenamed("doc_id", "k"), b.withColumnRenamed("vec_id", "k"), "k")


# --- neighbours ------------------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {NEAR.replace('{k}', str(K))} SELECT q, c, rank, round(dist, 9) AS dist, type FROM n")
def knn_topk(spark, sf_dir):
    return rounded(near(spark, sf_dir).select("q", "c", "rank", "dist", "type"))


@query(f"WITH {NEAR.replace('{k}', str(K))} SELECT q, c, rank, round(dist, 9) AS dist, type FROM n")
def knn_pruned(spark, sf_dir):
    return rounded(neighbors.nearest(base(spark, sf_dir), K, pivots=32).select("q", "c", "rank", "dist", "type"))


@query(f"WITH {NEAR.replace('{k}', '3')} SELECT q, string_agg(c, ',' ORDER BY rank) AS nearest FROM n GROUP BY q")
def knn_group_excluded(spark, sf_dir):
    w = F.array_sort(F.collect_list(F.struct("rank", "c")))  # three a row
    return near(spark, sf_dir, 3).groupBy("q").agg(F.concat_ws(",", F.transform(w, lambda x: x["c"].cast("string"))).alias("nearest"))


@query(f"WITH {TYPED.replace('{m}', str(M))} SELECT q, c, type, rank, round(dist, 9) AS dist FROM t")
def typed_neighbors(spark, sf_dir):
    return rounded(neighbors.nearest_typed(base(spark, sf_dir), M).select("q", "c", "type", "rank", "dist"))


@query(f"WITH {PAIRS} SELECT q, count(*) AS n_valid FROM p GROUP BY q")
def valid_counts(spark, sf_dir):
    m = base(spark, sf_dir)
    groups = m.groupBy("group_id").agg(F.count(F.lit(1)).alias("g"))
    total = m.agg(F.count(F.lit(1)).alias("n"))
    # one row of totals
    return m.join(groups, "group_id").crossJoin(F.broadcast(total)).select(F.col("row_id").alias("q"), (F.col("n") - F.col("g")).alias("n_valid"))


@query(f"""WITH {counted_to(200)}, f AS (SELECT k, n_ss / (n_ss + n_so + n_os + n_oo) AS ss, n_so / (n_ss + n_so + n_os + n_oo) AS so, n_os / (n_ss + n_so + n_os + n_oo) AS os, n_oo / (n_ss + n_so + n_os + n_oo) AS oo FROM s)
SELECT CAST(k AS BIGINT) AS k, round(avg(ss), 9) AS mean_ss, round(avg(so), 9) AS mean_so, round(avg(os), 9) AS mean_os, round(avg(oo), 9) AS mean_oo,
  round(quantile_cont(oo, 0.25), 9) AS oo_q25, round(quantile_cont(oo, 0.75), 9) AS oo_q75, round(quantile_cont(oo, 0.9), 9) AS oo_q90 FROM f GROUP BY k""")
def composition_by_k(spark, sf_dir):
    return rounded(scoring.composition(neighbors.nearest_types(base(spark, sf_dir), 200), range(1, 201)))


@query(f"""WITH {NEAR.replace('{k}', '1000000000')}, d AS (SELECT q, min(rank) FILTER (type = 'SO') AS first_so, min(rank) FILTER (type = 'OS') AS first_os,
  avg((type = 'SS')::INT::DOUBLE) FILTER (rank <= 10) AS s10, avg((type = 'SS')::INT::DOUBLE) FILTER (rank <= 25) AS s25, avg((type = 'SS')::INT::DOUBLE) FILTER (rank <= 50) AS s50 FROM n GROUP BY q)
SELECT q, coalesce(first_so, -1) AS first_so, coalesce(first_os, -1) AS first_os, round(s10, 9) AS ss_at_10, round(s25, 9) AS ss_at_25, round(s50, 9) AS ss_at_50,
  coalesce(CASE WHEN first_so IS NOT NULL AND first_os IS NOT NULL THEN greatest(first_so, first_os) END, -1) AS first_both, coalesce(least(first_so, first_os), -1) AS first_typed FROM d""")
def typed_rank_depth(spark, sf_dir):
    firsts = ["first_so", "first_os", "first_both", "first_typed"]
    m = base(spark, sf_dir)
    return rounded(scoring.rank_depth(neighbors.nearest(m, K_MAX), neighbors.first_typed(m)).drop("subset").na.fill(-1, firsts))


# --- indices ---------------------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {COUNTED} {POOLED.replace('GROUP BY k', f'WHERE k = {K} GROUP BY k')}")
def ri_pooled(spark, sf_dir):
    return rounded(scoring.robustness_index(near(spark, sf_dir), [K]))


@query(f"""WITH {COUNTED} SELECT q, n_ss, n_so, n_os, n_oo, n_so + n_os > 0 AS defined, round(CASE WHEN n_so + n_os > 0 THEN n_so / (n_so + n_os) END, 9) AS share,
  CAST(CASE WHEN n_so + n_os > 0 THEN 0 WHEN n_ss > n_oo THEN 1 WHEN n_oo > n_ss THEN 2 ELSE 3 END AS BIGINT) AS cause FROM s WHERE k = {K}""")
def ri_per_sample(spark, sf_dir):
    rows = scoring.per_unit(scoring.at_k(scoring.evidence(near(spark, sf_dir)), [K]))
    return rounded(rows.select("q", "n_ss", "n_so", "n_os", "n_oo", "defined", "share", "cause"))


@query(f"WITH {COUNTED} {POOLED}")
def ri_curve(spark, sf_dir):
    return rounded(scoring.robustness_index(near(spark, sf_dir, max(KS)), KS))


@query(f"""WITH {COUNTED}, c AS (SELECT k, CASE WHEN n_so + n_os > 0 THEN 0 WHEN n_ss > n_oo THEN 1 WHEN n_oo > n_ss THEN 2 ELSE 3 END AS cause FROM s WHERE k = 3)
SELECT CAST(cause AS BIGINT) AS cause, count(*) AS n FROM c GROUP BY cause""")
def undefined_breakdown(spark, sf_dir):
    rows = scoring.per_unit(scoring.at_k(scoring.evidence(near(spark, sf_dir, 3)), [3]))
    return rounded(rows.groupBy("cause").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {counted_to(100)} SELECT CAST(k AS BIGINT) AS k, round(avg((n_so + n_os > 0)::INT::DOUBLE), 9) AS support FROM s GROUP BY k")
def support_by_k(spark, sf_dir):
    return rounded(scoring.robustness_index(near(spark, sf_dir, 100), range(1, 101)).select("k", "support"))


SCORED_TAU = SCORED.replace("{tau}", str(TAU))


@query(f"WITH {SCORED_TAU} {POOLED.replace('GROUP BY k', f'WHERE k = {K} GROUP BY k')}")
def mari_pooled(spark, sf_dir):
    return rounded(scoring.margin_robustness_index(near(spark, sf_dir, max(KS)), [K], tau=TAU).drop("tau"))


@query(f"WITH {SCORED_TAU} {POOLED}")
def mari_curve(spark, sf_dir):
    return rounded(scoring.margin_robustness_index(near(spark, sf_dir, max(KS)), KS, tau=TAU).drop("tau"))


AUTO = NEAR.replace("{k}", str(K)) + ", med AS (SELECT median(dist) AS med, count(*) AS n_typed FROM n WHERE type IN ('SO', 'OS'))"


@query(f"WITH {AUTO} SELECT round(med, 9) AS tau FROM med")
def auto_tau(spark, sf_dir):
    return spark.createDataFrame([(round(scoring.recommend_tau(near(spark, sf_dir), K), 9),)], "tau double")


@query(f"""WITH {AUTO} SELECT round(med, 9) AS median_distance, n_typed, CAST({TAU} AS DOUBLE) AS tau,
  CASE WHEN med <= 0 OR med IS NULL THEN 'undetermined' WHEN {TAU} < med / 4 THEN 'too_sharp' WHEN {TAU} > med * 4 THEN 'too_flat' ELSE 'principled' END AS regime FROM med""")
def tau_assessment(spark, sf_dir):
    return rounded(scoring.assess_tau(scoring.typed_distances(near(spark, sf_dir), K), TAU))


TAUS = (0.05, 0.1, 0.2, 0.5, 1.0)


@query(
    f"WITH {NEAR.replace('{k}', str(K))}, lo AS (SELECT min(dist) AS d0 FROM n WHERE type IN ('SO', 'OS')), x AS (SELECT tau, type, exp(-(dist - d0) / tau) AS w FROM n, lo, (VALUES "
    + ", ".join(f"({t}::DOUBLE)" for t in TAUS)
    + ") g(tau) WHERE type IN ('SO', 'OS')) SELECT tau, round(sum(w) FILTER (type = 'SO') / sum(w), 9) AS value FROM x GROUP BY tau"
)
def tau_sensitivity(spark, sf_dir):
    typed = near(spark, sf_dir).where("type in ('SO', 'OS')")
    low = typed.agg(F.min("dist").alias("d0"))
    x = typed.crossJoin(F.broadcast(low)).withColumn("tau", F.explode(F.array(*map(F.lit, TAUS)))).withColumn("w", F.exp(-(F.col("dist") - F.col("d0")) / F.col("tau")))
    return rounded(x.groupBy("tau").agg((F.sum(F.when(F.col("type") == "SO", F.col("w"))) / F.sum("w")).alias("value")))


@query(f"""WITH {COUNTED} SELECT round(avg((n_so + n_os > 0)::INT::DOUBLE), 9) AS defined, round(avg((n_so > 0 AND n_os = 0)::INT::DOUBLE), 9) AS pure_so,
  round(avg((n_os > 0 AND n_so = 0)::INT::DOUBLE), 9) AS pure_os, round(avg((n_so > 0 AND n_os > 0)::INT::DOUBLE), 9) AS contested FROM s WHERE k = {K}""")
def contested_fraction(spark, sf_dir):
    return rounded(scoring.contested(scoring.per_unit(scoring.at_k(scoring.evidence(near(spark, sf_dir)), [K]))))


PAIRED = (
    EXPANDED
    + """,
u AS (SELECT subset, row_id, label, confounder, group_id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12)) AS v FROM x),
p AS (SELECT a.subset, a.row_id AS q, b.row_id AS c, round(1 - list_inner_product(a.v, b.v), 12) AS dist,
  CASE WHEN a.label = b.label AND a.confounder = b.confounder THEN 'SS' WHEN a.label = b.label THEN 'SO' WHEN a.confounder = b.confounder THEN 'OS' ELSE 'OO' END AS type
  FROM u a JOIN u b ON a.subset = b.subset AND a.group_id <> b.group_id)"""
)


@query(f"""WITH {PAIRED}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subset, q ORDER BY dist, c) AS rank FROM p) WHERE rank <= 5),
s AS (SELECT subset, q, count(*) FILTER (type = 'SO') AS so, count(*) FILTER (type = 'OS') AS os FROM n GROUP BY subset, q),
e AS (SELECT subset, CASE WHEN sum(so + os) > 0 THEN sum(so) / sum(so + os) ELSE 0.5 END AS v FROM s GROUP BY subset)
SELECT 5::BIGINT AS k, round(sum(so) / sum(so + os), 9) AS value, round(avg((so + os > 0)::INT::DOUBLE), 9) AS support, (SELECT round(stddev_pop(v), 9) FROM e) AS std, (SELECT count(*) FROM e) AS n_pairs FROM s""")
def ri_paired(spark, sf_dir):
    m = base(spark, sf_dir).drop("subset")
    rows = scoring.at_k(scoring.evidence(neighbors.nearest_2x2(m, 5), scoring.ones, units(mf.expand_2x2(m))), [5])
    return rounded(scoring.over_subsets(rows).select("k", "value", "support", "std", "n_pairs"))


# --- votes -----------------------------------------------------------------------------------------------------------------------------------------------

VOTES = NEAR.replace("{k}", str(max(KS))) + f""",
f AS (SELECT {{t}} AS value, min(row_id) AS code FROM m GROUP BY 1),
c AS (SELECT k, q, m.{{t}} AS value, f.code, count(*) AS n FROM n, {GRID}, m, f WHERE rank <= k AND m.row_id = n.c AND f.value = m.{{t}} GROUP BY ALL),
v AS (SELECT k, q, value AS vote, n AS n_votes FROM (SELECT *, row_number() OVER (PARTITION BY k, q ORDER BY n DESC, code) AS place FROM c) WHERE place = 1)"""  # fmt: skip
CURVE = """, r AS (SELECT k, m.{t} AS truth, avg((vote = m.{t})::INT::DOUBLE) AS recall FROM v JOIN m ON m.row_id = v.q GROUP BY ALL), b AS (SELECT k, avg(recall) AS balanced_accuracy FROM r GROUP BY k)"""


def voted(spark, sf_dir, target="label"):
    m = base(spark, sf_dir)
    return m, knn.votes(neighbors.nearest(m, max(KS)), m, KS, target)


@query(f"WITH {VOTES.replace('{t}', 'label')} SELECT CAST(k AS BIGINT) AS k, q, vote, n_votes FROM v")
def knn_votes(spark, sf_dir):
    return rounded(voted(spark, sf_dir)[1].select("k", "q", "vote", "n_votes"))


@query(f"WITH {(VOTES + CURVE).replace('{t}', 'label')} SELECT CAST(k AS BIGINT) AS k, round(balanced_accuracy, 9) AS balanced_accuracy FROM b")
def bacc_curve(spark, sf_dir):
    m, v = voted(spark, sf_dir)
    return rounded(knn.curve(v, m))


@query(f"WITH {(VOTES + CURVE).replace('{t}', 'confounder')} SELECT CAST(k AS BIGINT) AS k, round(balanced_accuracy, 9) AS balanced_accuracy FROM b")
def confounder_bacc_curve(spark, sf_dir):
    m, v = voted(spark, sf_dir, "confounder")
    return rounded(knn.curve(v, m, "confounder"))


@query(f"WITH {(VOTES + CURVE).replace('{t}', 'label')} SELECT CAST(k AS BIGINT) AS k, round(balanced_accuracy, 9) AS balanced_accuracy FROM b ORDER BY balanced_accuracy DESC, k LIMIT 1")
def operating_k(spark, sf_dir):
    m, v = voted(spark, sf_dir)
    return rounded(knn.operating_k(knn.curve(v, m), KS))


@query("""WITH b AS (SELECT o_custkey % 7 AS model, o_orderkey % 13 AS k, count(*) AS n FROM orders GROUP BY ALL), best AS (SELECT model, k FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, k) AS p FROM b) WHERE p = 1)
SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) AS p, count(*) OVER () AS n FROM best) WHERE p = (n + 1) // 2""")
def shared_k(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    b = o.groupBy((F.col("o_custkey") % 7).alias("model"), (F.col("o_orderkey") % 13).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    best = b.withColumn("p", stats.rank_first("n", "k", ("model",))).where("p = 1")
    return knn.lower_median(best.select("k"), "k")


# --- margins ---------------------------------------------------------------------------------------------------------------------------------------------

MARGIN = TYPED.replace("{m}", str(max(MS))) + f""",
d AS (SELECT q, g.m, avg(dist) FILTER (type = 'SO') AS d_so, avg(dist) FILTER (type = 'OS') AS d_os FROM t, (VALUES {", ".join(f"({m})" for m in MS)}) g(m) WHERE rank <= g.m GROUP BY q, g.m),
r AS (SELECT q, m, d_so, d_os, (d_os - d_so) / (d_os + d_so) AS margin FROM d)"""  # fmt: skip


def margin_rows(spark, sf_dir, ms=MS, strict=True):
    m = base(spark, sf_dir)
    rows = margin.margins(neighbors.nearest_typed(m, max(ms)), ms, units(m))
    return margin.require_support(rows) if strict else rows


@query(f"WITH {MARGIN} SELECT q, CAST(m AS BIGINT) AS m, round(d_so, 9) AS d_so, round(d_os, 9) AS d_os, round(margin, 9) AS margin FROM r WHERE m = {M}")
def margin_per_sample(spark, sf_dir):
    return rounded(margin_rows(spark, sf_dir, (M,), False).select("q", "m", "d_so", "d_os", "margin"))


@query(f"WITH {MARGIN} SELECT CAST(m AS BIGINT) AS m, round(median(margin), 9) AS value, 0.0::DOUBLE AS std, 1::BIGINT AS n_pairs FROM r WHERE m = {M} GROUP BY m")
def margin_summary(spark, sf_dir):
    return rounded(margin.summary(margin_rows(spark, sf_dir, (M,))))


@query(f"WITH {MARGIN}, a AS (SELECT margin FROM r WHERE m = {M}), b AS (SELECT quantile_cont(margin, {ALPHA}) AS q FROM a) SELECT round(max(q), 6) AS quantile, round(avg(margin) FILTER (margin <= q), 6) AS lower_tail_mean, count(*) FILTER (margin <= q) AS n_tail FROM a, b")
def margin_tail(spark, sf_dir):
    t = margin.tail(margin_rows(spark, sf_dir, (M,), False), alpha=ALPHA)
    return t.select(F.round("quantile", 6).alias("quantile"), F.round("lower_tail_mean", 6).alias("lower_tail_mean"), "n_tail")


@query(f"WITH {MARGIN} SELECT CAST(m AS BIGINT) AS m, round(avg((margin <= 0)::INT::DOUBLE), 9) AS f0 FROM r GROUP BY m")
def margin_f0(spark, sf_dir):
    return rounded(margin.not_positive(margin_rows(spark, sf_dir, strict=False), by=("m",)))


@query(f"WITH {MARGIN} SELECT CAST(m AS BIGINT) AS m, round(median(margin), 9) AS value FROM r GROUP BY m")
def margin_m_sweep(spark, sf_dir):
    return rounded(margin.summary(margin_rows(spark, sf_dir, strict=False)).select("m", "value"))


@query(f"""WITH {MARGIN}, v AS (SELECT m, median(margin) AS value FROM r GROUP BY m), a AS (SELECT *, (m - lag(m) OVER (ORDER BY m)) * (value + lag(value) OVER (ORDER BY m)) / 2 AS area FROM v)
SELECT round(sum(area) / (max(m) - min(m)), 9) AS auc, round(min(value), 9) AS least, round(max_by(value, m) - min_by(value, m), 9) AS rise FROM a""")
def margin_auc(spark, sf_dir):
    return rounded(margin.sweep_shape(margin.summary(margin_rows(spark, sf_dir, strict=False))))


@query(f"""WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, c) AS rank FROM p), x AS (SELECT q, rank, row_number() OVER (PARTITION BY q, type ORDER BY rank) AS nth FROM n WHERE type IN ('SO', 'OS'))
SELECT q, max(rank) AS depth FROM x WHERE nth = {M} GROUP BY q HAVING count(*) = 2""")
def search_depth(spark, sf_dir):
    return rounded(neighbors.typed_depth(base(spark, sf_dir), M).select("q", "depth"))


@query(f"WITH {TYPED.replace('{m}', str(M))} SELECT q, c, type, rank, round(dist, 9) AS dist FROM t")
def typed_widening(spark, sf_dir):
    return rounded(neighbors.widening_typed(base(spark, sf_dir), M, start_k=20)[0].select("q", "c", "type", "rank", "dist"))


@query(f"""WITH {PAIRED}, t AS (SELECT *, row_number() OVER (PARTITION BY subset, q, type ORDER BY dist, c) AS rank FROM p WHERE type IN ('SO', 'OS')),
d AS (SELECT subset, q, avg(dist) FILTER (type = 'SO') AS so, avg(dist) FILTER (type = 'OS') AS os FROM t WHERE rank <= 1 GROUP BY subset, q),
e AS (SELECT subset, median((os - so) / (os + so)) AS v FROM d GROUP BY subset) SELECT 1::BIGINT AS m, round(median(v), 9) AS value, round(stddev_pop(v), 9) AS std, count(*) AS n_pairs FROM e""")
def margin_paired(spark, sf_dir):
    m = base(spark, sf_dir).drop("subset")
    return rounded(margin.summary(margin.margins(neighbors.nearest_typed_2x2(m, 1), (1,), units(mf.expand_2x2(m)))))


@query(f"WITH {MARGIN} SELECT q, round(d_so, 9) AS d_so, round(d_os, 9) AS d_os, round(sqrt(d_so * d_so + d_os * d_os), 9) AS radius FROM r WHERE m = {M}")
def distance_plane(spark, sf_dir):
    rows = margin_rows(spark, sf_dir, (M,), False)
    return rounded(rows.select("q", "d_so", "d_os", F.hypot("d_so", "d_os").alias("radius")))
