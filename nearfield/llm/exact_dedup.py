"""Exact deduplication against a persistent digest index.

The index is a table of text digests, bucketed and sorted by digest. A batch is reduced to one keeper for each digest (partial sums
before the shuffle, so a text that a third of the rows share costs one row a task), the digests already in the index are taken out by
a sort-merge anti-join that reads the buckets as they lie, and the rest is appended. A large table may come in several batches, one after the other.
`dedup` moves digests and ids only; `filter` also moves one row for each digest and task, as it returns whole rows.

Texts are equal when identical after lower-casing A-Z. The row with the largest id of its batch stays; of repeated rows with that id, one.
Texts that the index had before keep the row of the earlier batch.

Defined results: a null text counts as empty, and all empty texts are equal. A null id is smaller than any other. An empty batch leaves
the index as it is. `dedup` ignores other columns, `filter` returns all columns untouched.

Everything here is DataFrame operations; no Python runs on the executors.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, attach, stash


def normalised(column: F.Column) -> F.Column:
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def digest(column: F.Column) -> F.Column:
    return F.sha2(normalised(column), 256)


class DigestIndex:
    """A digest index in the session's warehouse: columns digest (32 bytes) and keep_id. Without a name it is a new one, which the end of a `with`
    block drops; results that were returned stay readable."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.temporary = table is None
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.table):
            self._append(spark.createDataFrame([], "digest binary, keep_id long"))

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        if self.temporary:
            self.drop()

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")

    def _append(self, keepers: DataFrame) -> None:
        # as many tasks as buckets, each writing one sorted file: the deal is the bucketing's own hash
        dealt = keepers.select("digest", F.col("keep_id").cast("long").alias("keep_id")).repartition(self.buckets, "digest")
        dealt.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def _new(self, keepers: DataFrame) -> DataFrame:
        """Those that the index doesn't have, in a written table; appended to the index."""
        new = stash(keepers.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti"), "new")
        self._append(new)
        return new

    def dedup(self, *batches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Takes the batches in turn and returns a row for each input row: the id, keep_id, group_size (rows of all these batches with this text), kept,
        digest."""
        id_type = batches[0].schema[id_col].dataType.simpleString()
        rows, groups, new = [], [], []
        for n, batch in enumerate(batches):
            tag = F.monotonically_increasing_id() + F.lit(n << 58)
            own = stash(batch.select(F.col(f"`{id_col}`").alias("id"), F.unhex(digest(F.col(f"`{text_col}`"))).alias("digest"), tag.alias("tag")), "digests")
            first = F.max(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("tag")))
            found = own.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
            found = stash(found.select("digest", F.col("first.id").alias("keep_id"), F.col("first.tag").alias("keep_tag"), "n"), "groups")
            rows.append(own)
            groups.append(found)
            new.append(self._new(found))
        both = reduce(DataFrame.unionByName, groups).groupBy("digest").agg(F.sum("n").alias("group_size")).hint("merge")
        both = both.join(self.read().hint("merge"), "digest").hint("merge")
        both = stash(both.join(reduce(DataFrame.unionByName, new).select("digest", "keep_tag").hint("merge"), "digest", "left"), "groups")

        placed = attach(reduce(DataFrame.unionByName, rows), both, "digest", "group_size")
        columns = [F.col("id").cast(id_type).alias(id_col), F.col("keep_id").cast(id_type).alias("keep_id"), "group_size", F.coalesce(F.col("tag") == F.col("keep_tag"), F.lit(False)).alias("kept"), "digest"]
        return placed.select(*columns)

    def filter(self, batch: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of a batch that stay, with all their columns: one whole row for each digest, then the anti-join, then the append."""
        whole = [F.col(f"`{c}`") for c in batch.columns]
        order = F.struct(F.col(f"`{id_col}`").isNotNull().alias("known"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(*whole).alias("tie"))
        keyed = batch.select(F.unhex(digest(F.col(f"`{text_col}`"))).alias("digest"), order.alias("o"), F.struct(*whole).alias("r"))
        kept = keyed.groupBy("digest").agg(F.max_by("r", "o").alias("r"), F.max("o.id").alias("keep_id"))
        # the anti-join as a left join and its missing partners: the optimizer moves a plain one below the aggregation, before any partial sums
        old = self.read().select("digest", F.lit(True).alias("had"))
        new = stash(kept.hint("merge").join(old.hint("merge"), "digest", "left").where("had is null").drop("had"), "new")
        self._append(new)
        return new.select("r.*")
