"""Named benchmarks: which rows of which tile set are evaluated, and the vectors of a model for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import align
from . import manifest

DESIGNS = ("all", "paired_2x2")


@dataclass(frozen=True)
class Benchmark:
    name: str
    tileset: str
    manifest: str
    design: str = "all"
    k_max: int = 100
    confounder: str = "medical_center"


@dataclass(frozen=True)
class View:
    """The evaluated rows with the tile_index of each, and the models whose vectors are there."""

    spec: Benchmark
    rows: DataFrame
    models: list[str]
    root: str

    def features(self, model: str) -> DataFrame:
        """The rows with their vectors; a tile that several rows name gives its vector to each."""
        if model not in self.models:
            raise ValueError(f"no vectors of {model} for {self.spec.tileset}")
        tiles = self.rows.sparkSession.read.parquet(f"{self.root}/{self.spec.tileset}/embeddings/model={model}").withColumnRenamed("row_id", "tile_index")
        return align.many_to_one(self.rows, tiles.select("tile_index", "embedding"), ["tile_index"], what="vectors")


def models(spark: SparkSession, path: str) -> list[str]:
    """Names in order of the folders model=... below a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(x.removeprefix("model=") for x in found if x.startswith("model="))


class Registry:
    def __init__(self):
        self._specs: dict[str, Benchmark] = {}

    def add(self, spec: Benchmark) -> None:
        if spec.name in self._specs or spec.design not in DESIGNS or spec.k_max < 1:
            raise ValueError(f"{spec.name} is registered already, or its design or k isn't known")
        self._specs[spec.name] = spec

    def names(self) -> list[str]:
        return sorted(self._specs)

    def get(self, name: str) -> Benchmark:
        if name not in self._specs:
            raise ValueError(f"no benchmark {name}; there are {self.names()}")
        return self._specs[name]

    def view(self, spark: SparkSession, root: str, name: str) -> View:
        """root holds a folder for each tile set: `manifest` (row_id and the tile's identity) and `embeddings/model=...` (row_id, embedding), in Parquet."""
        spec = self.get(name)
        rows = manifest.read_csv(spark, spec.manifest, spec.confounder)
        if spec.design == "paired_2x2":
            rows = manifest.retain_complete(rows)
        tiles = spark.read.parquet(f"{root}/{spec.tileset}/manifest")
        return View(spec, align.view_rows(rows, tiles), models(spark, f"{root}/{spec.tileset}/embeddings"), root)
