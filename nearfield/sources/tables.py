"""Reading and writing: CSV and JSON relations, vector files, Parquet sinks, fingerprints and cached results."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vector files that can be read; torch files need a library that isn't here.
VECTOR_SUFFIXES = (".npy", ".npz")


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of rows."""
    return spark.read.json(path, multiLine=True)


def read_json_index(spark: SparkSession, path: str, key: str) -> DataFrame:
    """JSON lines, broken ones skipped; of several lines with one key the last holds."""
    raw = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    parsed = raw.withColumn("_key", F.get_json_object("value", f"$.{key}")).where(F.col("_key").isNotNull())
    last = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_at")))
    return parsed.withColumn("_n", last).where("_n = 1").select(F.col("_key").alias(key), F.col("value").alias("json"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All strings; n/a, n/d and empty stay as they are."""
    return spark.read.csv(path, header=True, nullValue="\x00", emptyValue="", multiLine=True, escape='"')


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A two-dimensional .npy file as row_id and embedding. The file is read by one executor; use Parquet for tables of any size."""

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                if matrix.ndim != 2 or not np.isfinite(matrix).all():
                    raise ValueError("a matrix must be two-dimensional and finite")
                for at in range(0, len(matrix), 4096):
                    part = matrix[at : at + 4096].astype(float)
                    yield pd.DataFrame({"row_id": np.arange(at, at + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "row_id long, embedding array<double>")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One vector a file: .npy, or .npz with `embedding` or a single array; shapes (d) and (1, d)."""

    def rows(batches):
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                if not isinstance(found, np.ndarray):
                    if "embedding" not in found and len(found.files) != 1:
                        raise ValueError(f"{name} needs an array called embedding, or one array")
                    found = found["embedding" if "embedding" in found else found.files[0]]
                found = found[0] if found.ndim == 2 and len(found) == 1 else found
                if found.ndim != 1:
                    raise ValueError(f"{name} has the shape {found.shape}")
                out.append((name, found.astype(float)))
            yield pd.DataFrame(out, columns=["path", "embedding"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    bad = files.where(~F.lower(F.regexp_extract("path", r"\.[^.]*$", 0)).isin(*VECTOR_SUFFIXES)).select("path").limit(1).collect()
    if bad:
        raise ValueError(f"can't read {bad[0]['path']}")
    return files.select("path", "content").mapInPandas(rows, "path string, embedding array<double>")


def absolute(path: Column, root: str) -> Column:
    """Relative paths get a root; absolute ones and those with a scheme stay."""
    return F.when(path.startswith("/") | path.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """image_path, model, embedding_path: no blanks, each pair of the first two once; relative embedding paths start at the mapping's folder."""
    df = spark.read.csv(path, header=True)
    blank = F.lit(False)
    for c in ("image_path", "model", "embedding_path"):
        blank = blank | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    if df.where(blank).limit(1).count():
        raise ValueError("blank values in the embedding mapping")
    if df.groupBy("image_path", "model").count().where("count > 1").limit(1).count():
        raise ValueError("repeated images in the embedding mapping")
    return df.withColumn("embedding_path", absolute(F.col("embedding_path"), path.rstrip("/").rpartition("/")[0]))


def numbered_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Repeated ids get the suffixes __dup001, __dup002 and so on, in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.concat(key, F.format_string("__dup%03d", F.col("_n") - 1))).otherwise(F.col(key))).drop("_n")


def write_twins(df: DataFrame, path: str) -> None:
    """The same rows as CSV and as JSON."""
    df.write.mode("errorifexists").csv(f"{path}.csv", header=True)
    df.write.mode("errorifexists").json(f"{path}.json", ignoreNullFields=False)


def write_by_model(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("model").parquet(path)


def fingerprint(df: DataFrame, columns, order: str = "row_id") -> str:
    """SHA-256 of the rows in order: of the sorted digests of slices, so no task holds all rows."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    slices = df.select(F.floor(F.col(order) / 4096).alias("slice"), F.col(order).alias("o"), row.alias("h"))
    parts = slices.groupBy("slice").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"])), 256).alias("h"))
    return parts.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("slice", "h"))), lambda x: x["h"])), 256).alias("h")).first()["h"]


def canonical(value) -> str:
    """JSON with sorted keys, lists taken as sets."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple | set):
            return sorted({json.dumps(plain(v), sort_keys=True) for v in x})
        return x

    return json.dumps(plain(value), sort_keys=True)


class ResultCache:
    """Results by content: the path is a hash of what they were made from; Spark's _SUCCESS file marks complete ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, **inputs) -> str:
        import hashlib

        return f"{self.root}/{hashlib.sha256(canonical(inputs).encode()).hexdigest()}"

    def get(self, make, **inputs) -> DataFrame:
        path = self.path(**inputs)
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
