"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids (k-means on a bounded sample; their number grows with the square root of the
table's rows, so cells grow with the table); a cell is a pair of centroids. A query walks the pairs in order of summed nearness with a heap until it has
seen a given share of all rows, and its cells' rows are ranked by their exact inner product. The share is set on the sample, so that the sample's own
neighbours are found with TARGET recall: easy data need few cells, data without structure need many.

Rows lie by units of neighbouring first centroids, of about BLOCK rows each; a first centroid with more rows is a unit of several blocks. A query goes
once to each unit that it probes, with the bits of its cells there, in chunks of at most CHUNK queries, so no group outgrows a task however many rows share
one vector. Each block returns 20 rows for a query.

Nearness is the inner product in double precision; ties go to the smaller id. Rows whose vector is null, all zero, holds nulls or
non-finite numbers, or has another length than most of the sample take no part. Repeated rows (one id twice) are rows of their own, but
a query never finds its own id. A table without vectors gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stash

#: Rows of the table for each cell at least, and centroids of a half at most.
PER_CELL, CENTROIDS = 36, 256
SAMPLE = 12_000
CALIBRATION = 200
TARGET = 0.95
BLOCK = 8192
CHUNK = 32_768
TOP = 20


def usable(column: F.Column) -> F.Column:
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.7976931348623157e308))
    return F.coalesce(column.isNotNull() & fine & F.exists(column, lambda x: x != 0), F.lit(False))


def _kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """From evenly spaced rows; a centroid without rows stays where it is."""
    found = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(rows, found)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, own, rows)
        found[count > 0] = sums[count > 0] / count[count > 0, None]
    return found


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * rows @ centroids.T).argmin(1)


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Cells in falling order of left[i] + right[j] until their counts reach `least` (multi-sequence traversal)."""
    by_left, by_right = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    a, b = left[by_left].tolist(), right[by_right].tolist()
    heap, out, seen = [(-(a[0] + b[0]), 0, 0)], [], 0
    lefts, rights, count = by_left.tolist(), by_right.tolist(), counts[np.ix_(by_left, by_right)].tolist()
    while heap and seen < least:
        _, i, j = heapq.heappop(heap)
        if count[i][j]:
            out.append((lefts[i], rights[j]))
            seen += count[i][j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return out


class MultiIndex:
    def __init__(self, sample: np.ndarray, top: int, rows: int):
        self.half = max(1, sample.shape[1] // 2)
        k = max(1, min(CENTROIDS, int((rows / PER_CELL) ** 0.5), int(len(sample) ** 0.5)))
        self.centroids = (_kmeans(sample[:, : self.half], k), _kmeans(sample[:, self.half :], k) if sample.shape[1] > 1 else np.zeros((1, 0)))
        self.share = self._calibrate(sample, top)

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(rows[:, : self.half], self.centroids[0]), _nearest(rows[:, self.half :], self.centroids[1])

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.centroids[0] @ query[: self.half], self.centroids[1] @ query[self.half :]

    def _calibrate(self, sample: np.ndarray, top: int) -> float:
        a, b = self.cells(sample)
        counts = np.zeros((len(self.centroids[0]), len(self.centroids[1])), int)
        np.add.at(counts, (a, b), 1)
        needs = []
        for at in np.linspace(0, len(sample) - 1, min(CALIBRATION, len(sample))).astype(int):
            near = sample @ sample[at]
            near[at] = -np.inf
            found = np.argsort(-near, kind="stable")[: min(top, len(sample) - 1)]
            order, seen = {}, 0
            for cell in walk(*self.scores(sample[at]), counts, np.inf):
                order[cell] = seen = seen + counts[cell]
            needs += [order[a[x], b[x]] for x in found]
        return float(np.quantile(needs, TARGET)) / len(sample) if needs else 1.0


def fit(vectors: DataFrame, *, vector_col: str, top: int, id_col: str) -> MultiIndex | None:
    """From at most SAMPLE rows, those with the smallest hashes of their ids; a documented bound."""
    total = vectors.count()
    rows = vectors.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(vector_col).collect()
    if not rows:
        return None
    sizes = pd.Series([len(r[0]) for r in rows]).value_counts().sort_index()
    size = int(sizes.idxmax())
    return MultiIndex(np.array([r[0] for r in rows if len(r[0]) == size], float), top, total)


def search(table: DataFrame, queries: F.Column, *, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """The `top` nearest rows of each row for which `queries` holds: query_id, rank, the id, score."""
    spark = table.sparkSession
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    index = fit(rows.select("id", "v"), vector_col="v", top=top, id_col="id")
    out_schema = "query_id long, rank int, id long, score double"
    if index is None:
        return spark.createDataFrame([], out_schema).withColumnRenamed("id", id_col)
    size = index.centroids[0].shape[1] + index.centroids[1].shape[1]
    shared = spark.sparkContext.broadcast(index)  # a fixed number of centroids

    def make_cells():
        def run(batch):
            v = np.array(batch["v"], float).reshape(-1, size)
            a, b = shared.value.cells(v) if len(v) else ([], [])
            return {"id": batch["id"], "v": batch["v"], "q": batch["q"], "a": a, "b": b}

        return run

    placed = map_rows(rows.where(F.size("v") == size), make_cells, "id long, v array<double>, q boolean, a int, b int")
    placed = stash(placed.withColumn("tag", F.monotonically_increasing_id()), "cells")
    counts = np.zeros((len(index.centroids[0]), len(index.centroids[1])), int)
    asked = 0
    for r in placed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("nq")).collect():  # one row a cell
        counts[r["a"], r["b"]] = r["n"]
        asked += r["nq"]
    total = int(counts.sum())
    least = max(index.share * total, min(total, 20 * top))
    chunks = max(1, -(-asked // CHUNK))
    # units of neighbouring first centroids
    unit_of, first, blocks, held = [], [], [], 0
    for a, n in enumerate(counts.sum(1).tolist()):
        if not unit_of or held + n > BLOCK:
            first.append(a)
            blocks.append(max(1, -(-n // BLOCK)))
            held = 0
        held += n
        unit_of.append(len(first) - 1)
    seconds = counts.shape[1]
    widths = [(end - start) * seconds for start, end in zip(first, [*first[1:], len(unit_of)], strict=True)]

    def make_probes():
        def run(batch):
            out = {c: [] for c in ("id", "v", "unit", "cells")}
            for i, v in zip(batch["id"], batch["v"], strict=True):
                found: dict[int, list[int]] = {}
                for a, b in walk(*shared.value.scores(np.array(v)), counts, least):
                    unit = unit_of[a]
                    found.setdefault(unit, []).append((a - first[unit]) * seconds + b)
                for unit, cells in found.items():
                    allowed = np.zeros(widths[unit], bool)
                    allowed[cells] = True
                    out["id"].append(i)
                    out["v"].append(v)
                    out["unit"].append(unit)
                    out["cells"].append(np.packbits(allowed).tobytes())
            return out

        return run

    # the walk is costly, so queries are dealt evenly first
    asking = placed.where("q").select("id", "v").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    probes = map_rows(asking, make_probes, "id long, v array<double>, unit int, cells binary")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at)
    many = pick(blocks, F.col("unit"))
    probes = probes.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), many - 1)))
    entries = placed.withColumn("unit", pick(unit_of, F.col("a"))).withColumn("cell", (F.col("a") - pick(first, F.col("unit"))) * seconds + F.col("b"))
    entries = entries.select("id", "v", "unit", "cell", F.pmod(F.xxhash64("tag"), many).cast("int").alias("block")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def matrix(table, column: str) -> np.ndarray:
        return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def rank(key, asks, has):
        import pyarrow as pa

        out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asks.num_rows and has.num_rows:
            e, ids, cell = matrix(has, "v"), has.column("id").to_numpy(), has.column("cell").to_numpy()
            q, names = matrix(asks, "v"), asks.column("id").to_numpy()
            width = widths[key[0].as_py()]
            packed = np.stack([np.frombuffer(x, np.uint8) for x in asks.column("cells").to_pylist()])
            for at in range(0, len(q), 128):
                some, own = q[at : at + 128], names[at : at + 128]
                allowed = np.unpackbits(packed[at : at + 128], axis=1, count=width).astype(bool)[:, cell] & (own[:, None] != ids[None, :])
                near = np.where(allowed, some @ e.T, -np.inf)
                bar = np.partition(near, -top, axis=1)[:, [-top]] if near.shape[1] > top else np.full((len(some), 1), -np.inf)
                # equal scores may differ by rounding here: everything that may belong is scored anew, row by row alike
                slack = np.where(np.isfinite(bar), 1e-9 * (1 + np.abs(bar)), 0.0)
                row, found = np.nonzero((near >= bar - slack) & allowed)
                exact = np.empty(len(row))
                for part in range(0, len(row), 65_536):  # many, where a vector is common
                    few = slice(part, part + 65_536)
                    exact[few] = (e[found[few]] * some[row[few]]).sum(1)
                order = np.lexsort((ids[found], -exact, row))
                row, found, exact = row[order], found[order], exact[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < top
                out.append((own[row[best]], ids[found[best]], exact[best]))
        return pa.table({name: np.concatenate(x) for name, x in zip(("query_id", "id", "score"), zip(*out, strict=True), strict=True)})

    key = ["unit", "block", "chunk"]
    found = probes.groupBy(*key).cogroup(entries.groupBy(*key)).applyInArrow(rank, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
