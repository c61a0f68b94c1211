"""Manifests: rows of samples with a label, a confounder and an independence group; designs and 2x2 subsets.

Row order is part of the data, so a manifest carries an explicit row_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import strip, token

REQUIRED = ("sample_id", "image_path", "label", "group_id")
IDENTITY = ("sample_id", "image_path", "label", "confounder", "group_id")


def require(df: DataFrame, columns, what: str = "manifest") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        hint = " (slide_id was renamed to group_id)" if "group_id" in missing and "slide_id" in df.columns else ""
        raise ValueError(f"{what} lacks the columns {missing}{hint}")


def blank_groups(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(strip(F.col("group_id")), F.lit("")) == "")


def normalise(df: DataFrame, confounder: str, *, check: bool = True) -> DataFrame:
    """Trims the contract columns, copies the named confounder to `confounder`, turns missing labels into the class "nan"."""
    require(df, (*REQUIRED, confounder))
    if check and (bad := [r["row_id"] for r in blank_groups(df).orderBy("row_id").limit(5).select("row_id").collect()]):
        raise ValueError(f"group_id is blank in rows {bad}")
    new = {c: F.coalesce(strip(F.col(c)), F.lit("nan")) for c in ("sample_id", "image_path", "label")}
    return df.withColumns(new | {"group_id": strip(F.col("group_id")), "confounder": F.coalesce(strip(F.col(confounder)), F.lit("nan"))})


def read_csv(spark: SparkSession, path: str, confounder: str) -> DataFrame:
    """All columns are strings; row_id follows the file's order; `dataset` is the file's stem."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return normalise(in_file_order(raw), confounder).withColumn("dataset", F.lit(stem))


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds row_id from 0 in the order of the files' partitions. Only the partitions' counts meet in one task."""
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_part", before.alias("_start")))  # one row a partition
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, "_part").withColumn("row_id", (F.col("_start") + place).cast("long")).drop("_at", "_part", "_start")


def read_typed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV relation with the given types and row_id in the file's order; values that don't fit raise."""
    return in_file_order(spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema, mode="FAILFAST"))


def resolve(df: DataFrame, candidates) -> str:
    """The first of the candidate columns that is there."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {list(candidates)} is there: {df.columns}")
    return found


def in_subset(df: DataFrame, wanted: str, allowed=("ID", "OOD")) -> DataFrame:
    """Rows of one subset; subsets that aren't allowed raise."""
    if bad := df.where(F.col("subset").isNull() | ~F.col("subset").isin(*allowed)).select("subset").limit(1).collect():
        raise ValueError(f"unknown subset {bad[0]['subset']}")
    return df.where(F.col("subset") == wanted)


def factor_codes(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """value, code: codes count the values in the order in which they first appear, within each scope."""
    first = df.groupBy(*by, column).agg(F.min("row_id").alias("first_row"))
    return first.withColumn("code", F.row_number().over(Window.partitionBy(*by).orderBy("first_row")).cast("long") - 1)


def complete_subsets(df: DataFrame) -> DataFrame:
    """Subsets with exactly two labels, two confounders and four non-empty cells."""
    cells = df.groupBy("subset").agg(
        F.count_distinct("label").alias("labels"), F.count_distinct("confounder").alias("confounders"), F.count_distinct(F.struct("label", "confounder")).alias("cells"), F.count(F.lit(1)).alias("rows")
    )
    return cells.where("labels = 2 and confounders = 2 and cells = 4")


def retain_complete(df: DataFrame) -> DataFrame:
    return df.join(complete_subsets(df).select("subset"), "subset", "left_semi") if "subset" in df.columns else df


def require_complete(df: DataFrame) -> DataFrame:
    bad = [r["subset"] for r in df.select("subset").distinct().join(complete_subsets(df).select("subset"), "subset", "left_anti").orderBy("subset").limit(5).collect()]
    if bad:
        raise ValueError(f"subsets without a complete 2x2 design: {bad}")
    return df


def strata(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "confounder").agg(F.count(F.lit(1)).alias("n"))


def balanced(df: DataFrame) -> bool:
    return strata(df).select("n").distinct().limit(2).count() <= 1


def keep_labels(df: DataFrame, labels: str | list[str]) -> DataFrame:
    """Rows of the named labels; a comma-separated text or a list without blanks or repetitions, all of them present."""
    names = [x.strip() for x in (labels.split(",") if isinstance(labels, str) else labels)]
    if "" in names or len(set(names)) < len(names) or len(names) < 2:
        raise ValueError("labels must be two or more different names")
    found = df.where(F.col("label").isin(names))
    have = {r["label"] for r in found.select("label").distinct().collect()}
    if have != set(names):
        raise ValueError(f"labels not in the manifest: {sorted(set(names) - have)}")
    if found.select("confounder").distinct().limit(2).count() < 2:
        raise ValueError("at least two confounders are needed")
    return found


def designs_2x2(df: DataFrame) -> DataFrame:
    """subset, l1, l2, c1, c2: every pair of labels and pair of confounders whose four cells all have rows; `subset` names the four."""
    cells = df.select("label", "confounder").distinct()
    a, b = cells.alias("a"), cells.alias("b")
    # the strata are few; corners (l1, c1) and (l2, c2) of a subset, the two others checked by semi-joins
    corners = a.join(b, (F.col("a.label") < F.col("b.label")) & (F.col("a.confounder") != F.col("b.confounder"))).select(
        F.col("a.label").alias("l1"), F.col("b.label").alias("l2"), F.least("a.confounder", "b.confounder").alias("c1"), F.greatest("a.confounder", "b.confounder").alias("c2")
    )
    full = corners.groupBy("l1", "l2", "c1", "c2").agg(F.count(F.lit(1)).alias("diagonals")).where("diagonals = 2").drop("diagonals")
    return full.withColumn("subset", F.concat(token(F.col("l1")), F.lit("+"), token(F.col("l2")), F.lit("__"), token(F.col("c1")), F.lit("_"), token(F.col("c2"))))


def expand_2x2(df: DataFrame) -> DataFrame:
    """A copy of each row for every design of `designs_2x2` that it is in."""
    full = designs_2x2(df)
    four = full.select("subset", F.explode(F.array(*(F.struct(F.col(x).alias("label"), F.col(y).alias("confounder")) for x in ("l1", "l2") for y in ("c1", "c2")))).alias("s"))
    return df.join(four.select("subset", "s.label", "s.confounder"), ["label", "confounder"])


def occurrences(df: DataFrame) -> DataFrame:
    """occurrence_index: subsets by name, rows by row_id within. Numbers come from per-subset counts, so no task holds all rows."""
    sizes = df.groupBy("subset").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.select("subset", (F.coalesce(F.sum("n").over(Window.orderBy("subset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    place = F.row_number().over(Window.partitionBy("subset").orderBy("row_id"))
    return df.withColumn("place", place).join(start, "subset").withColumn("occurrence_index", (F.col("start") + F.col("place") - 1).cast("long")).drop("place", "start")


def from_tables(spark: SparkSession, sf_dir: str, confounder: str = "lang") -> DataFrame:
    """The manifest over the given tables: vectors joined with documents, groups of four neighbouring ids."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", confounder)
    j = e.join(d, e["vec_id"] == d["doc_id"])
    return j.select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("s"), "vec_id").alias("sample_id"),
        F.concat(F.lit("/img/"), "vec_id").alias("image_path"),
        F.col("label").cast("string").alias("label"),
        F.col(confounder).alias("confounder"),
        F.concat(F.lit("g"), F.floor(F.col("vec_id") / 4)).alias("group_id"),
        F.lit("dataset").alias("subset"),
        "embedding",
    )


MANIFEST = T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in IDENTITY)])
