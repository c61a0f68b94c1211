"""Shared pieces: the shared work folder, written intermediate tables, Arrow mapping and word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stash, unstash

# A word is a maximal run of characters other than space and the controls 9 to 13.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: For str.translate: lower-cases A-Z only.
TO_LOWER = {ord(u): ord(low) for u, low in zip(UPPER, LOWER, strict=True)}


def words(text: str | None) -> list[str]:
    """The words of a text, unchanged."""
    text = text or ""
    for space in "\n\t\r\x0b\x0c":
        text = text.replace(space, " ")
    return [w for w in text.split(" ") if w]


class Memo(dict):
    """A worker's memo of of(key), with a bound on its entries; a full memo is emptied, and all are when a task ends. Results do not depend on it."""

    #: What a worker empties at a task's end; each has a method `clear`.
    held: list = []

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        Memo.held.append(self)

    def of(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.of(key)
        return got


class WordHashes(Memo):
    """64-bit hashes of words, as they are or lower-cased A-Z (about 20 MB)."""

    def __init__(self, lower: bool):
        super().__init__(120_000)
        self.lower = lower

    def of(self, word: str) -> int:
        return xxhash.xxh64_intdigest(word.translate(TO_LOWER) if self.lower and not word.islower() else word)


@cache
def word_hashes(lower: bool) -> WordHashes:
    """One memo for a worker."""
    return WordHashes(lower)


def let_go() -> None:
    """At a task's end: idle workers stay alive, so they give back what they hold."""
    for memo in Memo.held:
        memo.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def hashed(found: list[str], lower: bool) -> np.ndarray:
    return np.fromiter(map(word_hashes(lower).__getitem__, found), np.uint64, len(found))


def collect_shuffles(spark: SparkSession) -> None:
    """Spark keeps a shuffle's files until its JVM has collected the plan; between the steps of one operator they would add up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(columns: list[str], name: str) -> str:
    """A name that no column begins with."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def smaller_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows only; texts may be long, so a batch gets 1,024 rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > 1024:
        spark.conf.set(name, "1024")


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """Maps Arrow batches. make() runs once a task and returns a function from lists by column to lists by column."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    smaller_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = out = None
        try:
            for batch in batches:
                fn = fn or make()
                if batch.num_rows:
                    out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:
            del fn, out
            let_go()

    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> F.Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def crc_mod(column: str, mod: int) -> F.Column:
    """crc32 of the decimal text of an integer column, modulo mod; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(id_col: str, text_col: str) -> F.Column:
    """16 bytes that rows with one id and one text share; such rows are alike to every operator."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = F.concat_ws("\x00", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\x01")), text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_key, _id and _text (null: empty)."""
    return docs.select(row_key(id_col, text_col).alias("_key"), F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))


#: A key with more than this share of all rows is attached by broadcast: there can be 1 / HOT_SHARE such keys at most.
HOT_SHARE = 1 / 256


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int | None = None) -> DataFrame:
    """Inner join of rows and groups by key. groups is a written table with one row a key and its number of rows in `size`; hot keys (by the number of rows, or
    `total`) go by broadcast."""
    key = [key] if isinstance(key, str) else key
    hot = F.col(size) > max((rows.count() if total is None else total) * HOT_SHARE, 1)
    if not groups.where(hot).limit(1).count():
        return rows.join(groups, key)
    one = F.broadcast(groups.where(hot))
    return rows.join(one, key).unionByName(rows.join(F.broadcast(groups.where(hot).select(*key)), key, "left_anti").join(groups.where(~hot), key))
