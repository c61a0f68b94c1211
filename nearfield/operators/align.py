"""Aligning manifests, views and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import strip
from ..sources.manifest import IDENTITY, expand_2x2, require, resolve
from ..sources.shared import stash

TILE = ("sample_id", "image_path")


def _trimmed(df: DataFrame, keys) -> DataFrame:
    return df.withColumns({k: strip(F.col(k)) for k in keys})


def dedupe_sources(df: DataFrame, keys=IDENTITY) -> DataFrame:
    """Distinct keys in order of first appearance: the keys, first_row, source_index."""
    first = stash(_trimmed(df, keys).groupBy(*keys).agg(F.min("row_id").alias("first_row")), "sources")  # read by the range, the counts and the numbering
    return numbered(first, "first_row", keys, "source_index")


def numbered(df: DataFrame, order: str, ties, name: str, slices: int = 4096) -> DataFrame:
    """Numbers rows from 0 by an integer column, then by `ties`. Rows are numbered within slices of the column's range, and only the slices'
    counts meet in one task."""
    r = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, width = r["low"] or 0, max(1, -(-((r["high"] or 0) - (r["low"] or 0) + 1) // slices))
    rows = df.withColumn("_slice", F.floor((F.col(order) - low) / width))
    counts = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_slice", before.alias("_start")))  # `slices` rows at most
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(order, *ties))
    return rows.join(starts, "_slice").withColumn(name, F.col("_start") + place - 1).drop("_slice", "_start")


def source_index(df: DataFrame, keys=IDENTITY) -> DataFrame:
    """row_id and the source_index of its key."""
    return _trimmed(df, keys).select("row_id", *keys).join(dedupe_sources(df, keys), [*keys]).select("row_id", "source_index")


def _reject(df: DataFrame, say: str, columns) -> None:
    if found := df.select(*columns).limit(5).collect():
        raise ValueError(f"{say}: {[tuple(r) for r in found]}")


def many_to_one(left: DataFrame, right: DataFrame, keys, *, what: str = "right side") -> DataFrame:
    """Left join in which each left row has exactly one partner."""
    require(left, keys)
    require(right, keys, what)
    _reject(right.groupBy(*keys).count().where("count > 1"), f"repeated keys on the {what}", keys)
    _reject(left.join(right, [*keys], "left_anti"), f"no partner on the {what}", keys)
    return left.join(right, [*keys])


def view_rows(view: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rows of a view with the tile_index of their tile; a known sample under another path is an error of its own."""
    view, tiles = _trimmed(view, TILE), _trimmed(tiles, TILE)
    missing = view.join(tiles, [*TILE], "left_anti")
    _reject(missing.join(tiles.select("sample_id").distinct(), "sample_id", "left_semi"), "known samples with another path", TILE)
    return many_to_one(view, tiles.select(*TILE, F.col("row_id").alias("tile_index")), TILE, what="tile set")


def expand(manifest: DataFrame, embedded: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors of a source table, repeated for every manifest row with its key."""
    right = _trimmed(embedded, IDENTITY).select(*IDENTITY, vector)
    return many_to_one(_trimmed(manifest, IDENTITY), right, IDENTITY, what="embedded manifest")


def expand_checked(manifest: DataFrame, embedded: DataFrame, vector: str = "embedding") -> DataFrame:
    """As expand, for vectors that all have one width; others are an error that names the widths."""
    widths = [r["w"] for r in embedded.select(F.size(vector).alias("w")).distinct().orderBy("w").limit(6).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of several widths: {widths}")
    return expand(manifest, embedded, vector)


def left_to_source(left: DataFrame, source: DataFrame, keys) -> DataFrame:
    """Left join in which every row finds a partner and none becomes two; keys may be repeated on the left."""
    found = left.join(source.withColumn("_met", F.lit(True)), [*keys], "left")
    _reject(found.where("_met is null"), "no partner in the source", keys)
    if (n := left.count()) != (m := found.count()):
        raise ValueError(f"{n} rows became {m}: keys are repeated in the source")
    return found.drop("_met")


#: What becomes of the subset of the metadata: kept, replaced by all complete 2x2 subsets, or kept as the split of a downstream study.
SUBSET_MODES = ("passthrough", "expand", "split")


def with_metadata(metadata: DataFrame, source: DataFrame, mode: str, keys=("slide_id", "patch_id")) -> DataFrame:
    """A manifest from metadata (label, confounder, subset) and the source's sample_id and image_path. Keys are trimmed; every row of the metadata must find its source. The
    first key is the independence group."""
    if mode not in SUBSET_MODES:
        raise ValueError(f"the mode must be one of {SUBSET_MODES}")
    require(metadata, keys, "metadata")
    require(source, (*keys, *TILE), "source")
    left, right = _trimmed(metadata, keys), _trimmed(source, keys).select(*keys, *TILE)
    if n := missing_keys(left, right, [*keys]).count():
        raise ValueError(f"{n} of {left.count()} metadata rows have no partner in the source")
    label, confounder = resolve(metadata, ("biological_class", "label")), resolve(metadata, ("confounder", "medical_center", "center"))
    subset = {"passthrough": [F.col("subset").cast("string").alias("subset")], "expand": [], "split": [F.col("subset").cast("string").alias("apd_split")]}[mode]
    plain = left.drop(*(c for c in TILE if c in left.columns))
    rows = plain.join(right, [*keys]).select(*TILE, F.col(label).alias("label"), F.col(confounder).alias("confounder"), F.col(keys[0]).alias("group_id"), *subset)
    return expand_2x2(rows) if mode == "expand" else rows


def missing_keys(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.join(right, [*keys], "left_anti")


def duplicates(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Full coverage both ways, each key once on each side."""
    for side, other, name in ((left, right, "left"), (right, left, "right")):
        _reject(duplicates(side, keys), f"repeated keys on the {name}", keys)
        _reject(missing_keys(side, other, keys), f"keys only on the {name}", keys)
    return left.join(right, [*keys])


def upsert(old: DataFrame, fresh: DataFrame, keys) -> DataFrame:
    """Rows of fresh replace rows of old with their keys."""
    _reject(duplicates(fresh, keys), "repeated keys among the new rows", keys)
    return old.join(fresh, [*keys], "left_anti").unionByName(fresh)


def roster(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key and where it is: both, left or right."""
    x, y = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    both = x.join(y, key, "full_outer")
    return both.select(key, F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))
