"""Publishing results: complete or not at all, with a sidecar that says what they were made from. Files go through Hadoop's file systems, so any store works."""

from __future__ import annotations

import hashlib
import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import finite
from ..operators.quantiles import quantiles
from ..operators.scoring import k_grid
from .shared import stash
from .tables import canonical

SIDECAR = "sidecar.json"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, under another name first; the rename publishes it."""
    fs, at = _path(spark, path)
    _, draft = _path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(draft, at):
        raise OSError(f"{path} can't be published")


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _path(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(df: DataFrame, path: str) -> None:
    """Writes beside the place, under a name of its own, and renames; readers see the whole table or none. An existing table is never replaced. Of several writers one
    wins: the rename is made by whoever creates the claim beside the place, the others' drafts go and they get an error."""
    spark = df.sparkSession
    if exists(spark, path):
        raise ValueError(f"{path} exists")
    draft, claim = (f"{path.rstrip('/')}.{x}" for x in (f"{uuid.uuid4().hex}.draft", "claim"))
    fs, at = _path(spark, path)
    try:
        df.write.parquet(draft)
        if not fs.createNewFile(_path(spark, claim)[1]):
            raise ValueError(f"{path} is being published by another writer (or one that ended left {claim})")
        try:
            if fs.exists(at):
                raise ValueError(f"{path} exists")
            if not fs.rename(_path(spark, draft)[1], at):
                raise OSError(f"{path} can't be published")
        finally:
            fs.delete(_path(spark, claim)[1], False)
    finally:
        fs.delete(_path(spark, draft)[1], True)  # nothing is there after the rename


#: Rows of a part that a digest is made for.
PART_ROWS = 65_536


def part_digests(df: DataFrame) -> DataFrame:
    """part, rows, digest: the rows by the leading bits of their hash, in as many parts as the number of rows asks for. Depends on the rows alone, not on how they are dealt
    to tasks. Equal rows are counted before anything is gathered, so a part's digest holds distinct hashes only."""
    # json alone leaves out nulls and calls NaN by a word that a string may also be: the types are fixed by the schema
    each = df.select(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    each = stash(each, "hashes")
    bits = max(0, math.ceil(math.log2(max(each.count(), 1) / PART_ROWS)))
    part = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits)
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", F.col("n").cast("string")))), ",")
    return each.groupBy(part.alias("part")).agg(F.sum("n").alias("rows"), F.sha2(listed, 256).alias("digest"))


def table_digest(parts: DataFrame) -> str:
    """One digest of all parts, in two steps of a thousand and more each."""
    listed = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ","), 256)
    runs = parts.groupBy(F.shiftright("part", 10).alias("run")).agg(listed("part", "digest").alias("digest"))
    return runs.agg(listed("run", "digest").alias("d")).first()["d"]


def write_artifact(df: DataFrame, path: str, **made_from) -> None:
    """A table, the digests of its parts, and a sidecar, which comes last and so marks completeness. Rows are dealt to files by hash and sorted within them, and the digests
    depend on the rows alone: equal rows give equal artifacts, however they were dealt before."""
    spark = df.sparkSession
    df = stash(df, "artifact")
    parts = stash(part_digests(df), "parts")
    n = parts.agg(F.sum("rows").alias("n")).first()["n"] or 0
    files = max(1, math.ceil(n / (16 * PART_ROWS)))
    publish(df.repartition(files, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).sortWithinPartitions(*(F.col(f"`{c}`") for c in df.columns)), f"{path}/values")
    publish(parts, f"{path}/parts")
    columns = {f.name: f.dataType.simpleString() for f in df.schema}
    write_text(spark, f"{path}/{SIDECAR}", canonical({"made_from": made_from, "columns": columns, "rows": n, "digest": table_digest(parts)}))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The parts whose rows or digest differ from what was published; none for a sound artifact."""
    told = spark.read.parquet(f"{path}/parts")
    found = part_digests(spark.read.parquet(f"{path}/values")).select("part", F.col("rows").alias("found_rows"), F.col("digest").alias("found"))
    return told.join(found, "part", "full").where(~F.col("digest").eqNullSafe(F.col("found")) | ~F.col("rows").eqNullSafe(F.col("found_rows")))


def reusable(spark: SparkSession, path: str, **made_from) -> bool:
    """Whether a complete artifact of the same origin is there. One half alone, another origin and another schema are errors, never a silent miss."""
    values, sidecar = exists(spark, f"{path}/values"), exists(spark, f"{path}/{SIDECAR}")
    if not values and not sidecar:
        return False
    if values != sidecar:
        raise ValueError(f"incomplete artifact at {path}")
    found = json.loads(read_text(spark, f"{path}/{SIDECAR}"))
    wanted = json.loads(canonical(made_from))
    if differ := sorted(k for k in wanted.keys() | found["made_from"].keys() if wanted.get(k) != found["made_from"].get(k)):
        raise ValueError(f"artifact at {path} was made from other inputs: {differ}")
    values = spark.read.parquet(f"{path}/values")
    if {f.name: f.dataType.simpleString() for f in values.schema} != found["columns"]:
        raise ValueError(f"artifact at {path} has another schema than its sidecar says")
    if values.count() != found["rows"]:
        raise ValueError(f"artifact at {path} has another number of rows than its sidecar says")
    return True


def write_distribution(df: DataFrame, path: str, value: str, alpha: float = 0.1, **meta) -> None:
    """The defined values of a measure, and a sidecar with their summary."""
    good = df.where(finite(F.col(value)).isNotNull()).select(value)
    publish(good, f"{path}/values")
    n = good.count()
    found = {r["q"]: r["x"] for r in quantiles(good, value, [0.5, alpha]).collect()}  # two rows at most
    row = {"n": n, "median": found.get(0.5), "q": found.get(alpha)}
    ltm = good.where(F.col(value) <= F.lit(row["q"])).agg(F.avg(value).alias("m")).first()["m"]
    write_text(df.sparkSession, f"{path}/{SIDECAR}", json.dumps({"measure": value, "alpha": alpha, "n": row["n"], "median": row["median"], "quantile": row["q"], "ltm": ltm} | meta, sort_keys=True))


def write_run_config(spark: SparkSession, path: str, resolved: dict) -> None:
    write_text(spark, f"{path}/run_config.json", json.dumps(resolved, sort_keys=True, indent=2))


def read_run_config(spark: SparkSession, path: str) -> dict:
    """What a run was called with, to call it again."""
    return json.loads(read_text(spark, f"{path}/run_config.json"))


def _only(row, column: str) -> str:
    if row[f"n_{column}"] != 1:
        raise ValueError(f"{row[f'n_{column}']} values of {column}: a table of one run has one")
    return row[column]


def infer_run_config(metrics: DataFrame, m_sweep: DataFrame | None = None) -> dict:
    """What a run was called with, from its table of metrics (a row a model: k_max, k_values, croma_search, tau) and, if there is one, its sweep over m. One tau for all of
    several models was given; otherwise, and for a single model, each model had its own."""
    once = ("k_max", "k_values", "croma_search")
    if missing := [c for c in (*once, "tau") if c not in metrics.columns]:
        raise ValueError(f"the metrics lack the columns {missing}")
    taus = F.col("tau").cast("double")
    found = metrics.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(taus).alias("n_tau"), F.max(taus).alias("tau"),
        *(F.max(F.col(c).cast("string")).alias(c) for c in once), *((F.count_distinct(F.col(c).cast("string")) + F.max(F.col(c).isNull().cast("int"))).alias(f"n_{c}") for c in once),
    ).first()
    if not found["n"]:
        raise ValueError("no metrics to tell a run's settings from")
    k_max = int(float(_only(found, "k_max")))
    swept = sorted({int(k) for k in _only(found, "k_values").split(",") if k.strip()})
    grid = next((name for name in ("dense", "sparse") if swept == k_grid(k_max, name == "sparse")), None)
    if grid is None:
        raise ValueError(f"no grid up to {k_max} has the values {swept}")
    out = {"k_max": k_max, "k_grid": grid, "tau": found["tau"] if found["n"] > 1 and found["n_tau"] == 1 else "auto"}
    search = dict(part.strip().split("=", 1) for part in _only(found, "croma_search").split(";") if "=" in part)
    for key, name, kind in (("start", "croma_start_k", int), ("growth", "croma_k_growth_factor", float), ("alpha", "croma_alpha", float)):
        if key in search:
            out[name] = kind(float(search[key]))
    most = None if m_sweep is None else m_sweep.agg(F.max(F.col("m").cast("double")).alias("m")).first()["m"]
    return out if most is None else out | {"croma_m_max": int(most)}


def check_run_config(config: dict, **expected) -> dict:
    """Settings that differ from what a run recorded are an error; those it did not record are not."""
    if differ := {k: config[k] for k, v in expected.items() if config.get(k) is not None and str(config[k]) != str(v)}:
        raise ValueError(f"the run recorded other settings: {differ}")
    return config


def _csv(df: DataFrame) -> str:
    """A small table as text."""
    cell = lambda x: "" if x is None else f'"{x}"' if isinstance(x, str) and any(c in x for c in ',"\n') else repr(x) if isinstance(x, float) else str(x)
    quoted = lambda x: cell(x.replace('"', '""') if isinstance(x, str) else x)
    return "".join(",".join(map(quoted, row)) + "\n" for row in [tuple(df.columns), *map(tuple, df.collect())])


def export(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Small published tables as CSV files in the order of the given columns, and their SHA-256 in PROVENANCE.json."""
    record = {}
    for name, (df, order) in sorted(tables.items()):
        text = _csv(df.orderBy(*order))
        write_text(spark, f"{path}/{name}.csv", text)
        record[f"{name}.csv"] = hashlib.sha256(text.encode()).hexdigest()
    write_text(spark, f"{path}/PROVENANCE.json", json.dumps(record, sort_keys=True, indent=2))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """The first rows of an ordered report as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *([("" if x is None else str(x)) for x in r] for r in df.limit(most).collect())]
    return "".join("|---" * len(r) + "|\n" if i == 1 else "| " + " | ".join(r) + " |\n" for i, r in enumerate(rows))
