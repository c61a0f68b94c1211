"""Replicate orders and draws made in tasks, models that embed, manifests from metadata, settings told from a run's metrics."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import encoders
from nearfield.operators import align, downstream, studies
from nearfield.sources import manifest, publish, tables

CELLS = {(0, 0): 7, (0, 1): 10, (1, 0): 1, (1, 1): 12}


def chain(cells, per_slide, seeds, arrange=None):
    """The same orders with plain lists of slides."""
    slides = {c: [[*range(n)][at : at + per_slide] for at in range(0, n, per_slide)] for c, n in sorted(cells.items())}
    out = set()
    for n, seed in enumerate(seeds):
        rng = random.Random(seed)
        if arrange is None:
            for own in slides.values():
                rng.shuffle(own)
        else:
            slides = arrange(slides, rng)
        for (i, j), own in slides.items():
            out |= {(n, i, j, pos, place) for pos, place in enumerate(x for slide in own for x in slide)}
    return out


@pytest.mark.parametrize("per_slide", [1, 3])
def test_orders_equal_a_chain_of_lists(spark, monkeypatch, per_slide):
    monkeypatch.setattr(downstream, "ORDER_ROWS", 4)
    seeds = downstream.replicate_seeds(1000, 5)
    got = downstream.arrangements(spark, CELLS, per_slide, seeds)
    assert {tuple(r) for r in got.collect()} == chain(CELLS, per_slide, seeds) and got.count() == 5 * sum(CELLS.values())


def test_arrangements_keep_their_slides(spark):
    def turned(slides, rng):
        return {c: own[::-1] for c, own in slides.items()}

    got = {tuple(r) for r in downstream.arrangements(spark, CELLS, 2, [1, 2], turned).collect()}
    assert got == chain(CELLS, 2, [1, 2], turned)
    with pytest.raises(Exception, match="same slides"):
        downstream.arrangements(spark, CELLS, 2, [1], lambda slides, rng: {c: own[1:] for c, own in slides.items()})


def test_cases_that_are_held_out(spark, tmp_path):
    """The drawn cases end each cell; draws before shuffles, off one generator."""
    sets = {"train": {"x": [["a", "b"], ["c"]], "y": [["d"]]}, "test": {"x": [["c"], ["a", "b"]], "y": [["a"]]}}
    (tmp_path / "splits.json").write_text(json.dumps(sets, indent=1))
    held_out = downstream.read_case_splits(spark, str(tmp_path / "splits.json"), ["x", "y"])
    assert held_out == {0: [["c"], ["a", "b"]], 1: [["a"]]}
    cases = {c: ["abcd"[s % 4] for s in range(n)] for c, n in CELLS.items()}
    seeds = [3, 4, 5, 6]
    rows = downstream.arrangements(spark, CELLS, 1, seeds, downstream.case_arrangement(cases, held_out)).collect()
    for n, seed in enumerate(seeds):
        rng = random.Random(seed)
        drawn = [rng.randint(0, len(held_out[i]) - 1) for i in (0, 1)]
        for cell, size in CELLS.items():
            own = [cases[cell][r["place"]] for r in sorted((r for r in rows if r["iter"] == n and (r["i"], r["j"]) == cell), key=lambda r: r["pos"])]
            tail = sorted(set(held_out[cell[0]][drawn[cell[0]]]) & set(own))
            assert len(own) == size and (not tail or own[-len(tail) :] == tail)
    sets["train"]["y"] = [["a"]]
    (tmp_path / "bad.json").write_text(json.dumps(sets))
    with pytest.raises(ValueError, match="both trained on"):
        downstream.read_case_splits(spark, str(tmp_path / "bad.json"), ["x", "y"])
    with pytest.raises(ValueError, match="no paired"):
        downstream.read_case_splits(spark, str(tmp_path / "splits.json"), ["z"])


def test_models_are_set_up_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(f"{folder}/setup-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def run(values):
            assert len(values) == 1 or (len(values) <= 5 and sum(map(len, values)) <= 100)
            return np.array([[[len(v), 1], [9, 9], [0, 2], [2, 4]] for v in values], float)

        return run

    rows = [(i, None if i % 7 == 3 else bytes((i * 13) % 150), f"n{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, image binary, name string").repartition(12)
    got = {r["id"]: r for r in encoders.embed(df, "image", make, skip=2, rows=5, size=100).collect()}
    assert len(got) == 200 and all(got[i]["embedding"] == (None if v is None else [len(v), 1, 1, 3]) and got[i]["name"] == name for i, v, name in rows)
    pids = [p.name.split("-")[1] for p in tmp_path.glob("setup-*")]
    assert pids and len(pids) == len(set(pids))  # twelve tasks, and no worker set its model up twice
    assert encoders.embed(df.limit(0), "image", make).count() == 0
    with pytest.raises(ValueError, match="there already"):
        encoders.embed(df, "image", make, out="name")
    with pytest.raises(Exception, match="one finite vector"):
        encoders.embed(df, "image", lambda: lambda values: np.full((len(values), 2), np.nan)).collect()


def test_batches_are_bounded():
    values = [b"x" * n for n in (10, 20, 90, 5, 5, 5, 200, 1)] + [None]
    assert [*encoders.batches(values, 3, 100)] == [(0, 2), (2, 5), (5, 6), (6, 7), (7, 9)]
    assert [*encoders.batches([], 3, 100)] == []
    with pytest.raises(ValueError):
        encoders.pooled(np.zeros((2, 2, 3)), skip=2)


def test_metadata_needs_its_source(spark):
    metadata = spark.createDataFrame([(" a", "1", "T", "x", "s1"), ("b ", "2", "N", "y", "s2")], "slide_id string, patch_id string, label string, center string, subset string")
    source = spark.createDataFrame([("a", "1", "p", "/p"), ("b", " 2", "q", "/q"), ("c", "3", "r", "/r")], "slide_id string, patch_id string, sample_id string, image_path string")
    got = {tuple(r) for r in align.with_metadata(metadata, source, "passthrough").collect()}
    assert got == {("p", "/p", "T", "x", "a", "s1"), ("q", "/q", "N", "y", "b", "s2")}
    assert align.with_metadata(metadata, source, "split").columns[-1] == "apd_split" and align.with_metadata(metadata, source, "expand").count() == 0
    with pytest.raises(ValueError, match="1 of 2 metadata rows"):
        align.with_metadata(metadata, source.where("sample_id <> 'q'"), "split")
    with pytest.raises(ValueError, match="mode"):
        align.with_metadata(metadata, source, "other")


def test_settings_from_metrics(spark):
    row = lambda tau, k_max=30, ks="1,3,5,7,9,11,21", search="start=64;growth=2;alpha=0.1": (k_max, ks, search, tau)
    make = lambda *rows: spark.createDataFrame([*rows], "k_max int, k_values string, croma_search string, tau double")
    got = publish.infer_run_config(make(row(0.2), row(0.2)), spark.createDataFrame([(1,), (5,)], "m int"))
    assert got == {"k_max": 30, "k_grid": "sparse", "tau": 0.2, "croma_start_k": 64, "croma_k_growth_factor": 2.0, "croma_alpha": 0.1, "croma_m_max": 5}
    assert publish.infer_run_config(make(row(0.2), row(0.3)))["tau"] == publish.infer_run_config(make(row(0.2)))["tau"] == "auto"
    assert publish.infer_run_config(make(row(0.2, 3, "3,1,2")))["k_grid"] == "dense"
    for rows, say in (((row(0.2, 30), row(0.2, 31)), "2 values of k_max"), ((row(0.2, 30, "1,2"),), "no grid"), ((), "no metrics")):
        with pytest.raises(ValueError, match=say):
            publish.infer_run_config(make(*rows))
    assert publish.check_run_config(got, k_max=30, other=1) == got
    with pytest.raises(ValueError, match="other settings"):
        publish.check_run_config(got, k_grid="dense")


def test_typed_csv_keeps_its_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,x\n"b, c",2\na,1\n')
    got = manifest.read_typed(spark, str(tmp_path / "t.csv"), "name string, x int").orderBy("row_id")
    assert [tuple(r) for r in got.select("row_id", "name", "x").collect()] == [(0, "b, c", 2), (1, "a", 1)]
    (tmp_path / "bad.csv").write_text("name,x\na,one\n")
    with pytest.raises(Exception, match="MALFORMED|one"):
        manifest.read_typed(spark, str(tmp_path / "bad.csv"), "name string, x int").collect()


def test_saturation(spark):
    df = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.95, -0.4), ("c", 0.2, 0.3)], "model string, probe double, margin double")
    got = studies.saturation(df, "a", "b", "probe", "margin").first()
    assert got["probe_gap"] == pytest.approx(0.05) and got["value_gap"] == pytest.approx(0.5) and got["low_value"] == 0.1
    assert studies.saturation(df, "a", "z", "probe", "margin").count() == 0
    assert tables.canonical({"b": [2, 1]}) == tables.canonical({"b": [1, 2]})
