"""Artifacts that depend on their rows alone, and writers that meet."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from nearfield.sources import publish


def frame(spark, parts):
    rows = spark.range(3000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id") % 11)).alias("b c"), (F.col("id") / 7).alias("x"))
    return rows.unionByName(rows.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1500)))).drop("n")).repartition(parts)  # a third of the rows are one


@pytest.mark.parametrize("size", [65_536, 100])
def test_digests_depend_on_rows_only(spark, monkeypatch, tmp_path, size):
    monkeypatch.setattr(publish, "PART_ROWS", size)
    told, files = [], []
    for parts in (1, 7):
        path = f"{tmp_path}/{size}-{parts}"
        publish.write_artifact(frame(spark, parts), path, model="m")
        told.append(json.loads(publish.read_text(spark, f"{path}/{publish.SIDECAR}")))
        files.append(sorted((r["n"], r["h"]) for r in spark.read.parquet(f"{path}/values").groupBy(F.xxhash64("a", "`b c`", "x").alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()))
        assert publish.reusable(spark, path, model="m") and publish.verify(spark, path).count() == 0
    assert told[0] == told[1] and told[0]["rows"] == 4500 and files[0] == files[1]
    other = publish.table_digest(publish.part_digests(frame(spark, 3).where("a <> 5")))
    assert other != told[0]["digest"]
    assert spark.read.parquet(f"{tmp_path}/{size}-1/parts").count() == (1 if size > 1000 else 32)


def test_artifact_of_nothing(spark, tmp_path):
    publish.write_artifact(frame(spark, 1).limit(0), f"{tmp_path}/none")
    assert publish.reusable(spark, f"{tmp_path}/none") and publish.verify(spark, f"{tmp_path}/none").count() == 0


def test_of_two_writers_one_wins(spark, tmp_path):
    path, errors = f"{tmp_path}/table", []

    def write(i):
        try:
            publish.publish(spark.range(1000).withColumn("writer", F.lit(i)), path)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = spark.read.parquet(path)
    assert got.count() == 1000 and got.select("writer").distinct().count() == 1 and len(errors) == 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["table"]


def test_a_claim_stops_others(spark, tmp_path):
    publish.write_text(spark, f"{tmp_path}/t.claim", "")
    with pytest.raises(ValueError, match="another writer"):
        publish.publish(spark.range(3), f"{tmp_path}/t")
    assert not publish.exists(spark, f"{tmp_path}/t")


def test_joins_that_keep_rows(spark):
    from nearfield.operators import align

    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    source = spark.createDataFrame([("a", 10), ("b", 20)], "k string, w int")
    assert sorted(tuple(r) for r in align.left_to_source(left, source, ["k"]).collect()) == [("a", 1, 10), ("a", 2, 10), ("b", 3, 20)]
    with pytest.raises(ValueError, match="became 5"):
        align.left_to_source(left, source.unionByName(source.where("k = 'a'")), ["k"])
    with pytest.raises(ValueError, match="no partner"):
        align.left_to_source(left, source.where("k = 'a'"), ["k"])
    uneven = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(ValueError, match="several widths"):
        align.expand_checked(left, uneven)
