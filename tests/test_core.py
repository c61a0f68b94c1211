"""Closed forms, properties and error paths of the neighbourhood measures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors
from nearfield.operators import align, downstream, knn, margin, neighbors, report, scoring, stats
from nearfield.sources import manifest as mf
from nearfield.sources import tables

SCHEMA = "row_id long, sample_id string, image_path string, label string, confounder string, group_id string, subset string, embedding array<double>"


def table(spark, x, labels, confs, groups=None, subset="dataset"):
    groups = groups or [f"g{i}" for i in range(len(x))]
    return spark.createDataFrame([(i, f"s{i}", f"/{i}", str(a), str(b), g, subset, [float(v) for v in row]) for i, (row, a, b, g) in enumerate(zip(x, labels, confs, groups, strict=True))], SCHEMA)


def blob(n=60, d=8, seed=0, label=1.0, conf=0.5):
    rng = np.random.default_rng(seed)
    a, b = np.arange(n) % 2, np.arange(n) // 2 % 2
    x = rng.normal(size=(n, d))
    x[:, 0] += label * (2 * a - 1)
    x[:, 1] += conf * (2 * b - 1)
    return x, ["A" if v else "B" for v in a], ["V1" if v else "V2" for v in b]


def ri(df, k):
    return scoring.robustness_index(neighbors.nearest(df, k), [k]).first()["value"]


def test_blocks_equal_pairs(spark):
    df = table(spark, *blob())
    key = ["q", "c", "rank"]
    want = neighbors.ranked(neighbors.pairs(df)).where("rank <= 7").select(*key, "dist", "type").orderBy(*key).collect()
    for block in (7, 2048):
        got = neighbors.nearest(df, 7, block=block).select(*key, "dist", "type").orderBy(*key).collect()
        assert [r[:3] + (r[4],) for r in map(tuple, got)] == [r[:3] + (r[4],) for r in map(tuple, want)]
        assert np.allclose([r["dist"] for r in got], [r["dist"] for r in want], atol=2e-12)


def test_typed_rank_has_no_limit(spark, monkeypatch):
    from nearfield.plans import catalogue

    x, _, _ = blob(150, 3, seed=5)
    x[:130, 0] += 9  # a pocket of one label and confounder, deeper than K_MAX
    df = table(spark, x, ["A"] * 140 + ["B"] * 10, ["V1"] * 130 + ["V2"] * 10 + ["V1"] * 9 + ["V3"], [f"g{i // 2}" for i in range(150)])
    monkeypatch.setattr(catalogue, "base", lambda spark, sf_dir: df)
    want = {}
    for r in neighbors.ranked(neighbors.pairs(df)).orderBy("q", "rank").collect():
        want.setdefault(r["q"], {}).setdefault(r["type"], r["rank"])
    got = {r["q"]: r for r in catalogue.typed_rank_depth(spark, "").collect()}
    assert len(got) == 150 and max(w.get("SO", -1) for w in want.values()) > 100
    assert {q: (r["first_so"], r["first_os"]) for q, r in got.items()} == {q: (w.get("SO", -1), w.get("OS", -1)) for q, w in want.items()}
    small = {r["q"]: (r["first_so"], r["first_os"]) for r in neighbors.first_typed(df, block=40).collect()}
    assert small == {q: (w.get("SO"), w.get("OS")) for q, w in want.items() if "SO" in w or "OS" in w}


def test_dominant_signals(spark):
    n = 24
    axis = np.zeros((n, 3))
    axis[np.arange(n), np.arange(n) // 12] = 1
    axis[:, 2] = 0.01 * np.arange(n)
    labels, vendors = ["A"] * 12 + ["B"] * 12, ["V1", "V2"] * 12
    assert ri(table(spark, axis, labels, vendors), 3) == 1
    assert ri(table(spark, axis, vendors, labels), 3) == 0


def test_rotation_and_role_swap(spark):
    x, labels, confs = blob(seed=3)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(8, 8)))[0]
    base = ri(table(spark, x, labels, confs), 5)
    assert ri(table(spark, x @ q, labels, confs), 5) == pytest.approx(base, abs=1e-12)
    assert ri(table(spark, x, confs, labels), 5) == pytest.approx(1 - base, abs=1e-12)


def test_no_neighbour_of_the_own_group(spark):
    x, labels, confs = blob(20)
    df = table(spark, x, labels, confs, [f"g{i // 4}" for i in range(20)])
    found = neighbors.nearest(df, 30)
    assert found.where(F.floor(F.col("q") / 4) == F.floor(F.col("c") / 4)).count() == 0
    assert {r["n_valid"] for r in neighbors.valid_counts(found).collect()} == {16}


def test_margin_closed_form_and_support(spark):
    # the same label at distance 0.2, the same confounder at 0.8
    at = lambda d: [1 - d, math.sqrt(1 - (1 - d) ** 2)]
    df = table(spark, [[1, 0], at(0.2), at(0.8), [-1, 0.0]], "AABB", ["V1", "V2", "V1", "V2"])
    rows = margin.margins(neighbors.nearest_typed(df, 1), 1)
    assert rows.where("q = 0").first()["margin"] == pytest.approx(0.6)
    with pytest.raises(RuntimeError, match="lack"):
        margin.require_support(margin.margins(neighbors.nearest_typed(df, 2), 2, df.select("subset", F.col("row_id").alias("q"))))


def test_tau_limits(spark):
    df = table(spark, *blob(seed=5))
    found = neighbors.nearest(df, 9).persist()
    flat = scoring.margin_robustness_index(found, [9], tau=1e9).first()["value"]
    assert flat == pytest.approx(scoring.robustness_index(found, [9]).first()["value"], abs=1e-6)
    assert scoring.margin_robustness_index(found, [9], tau=5e-324).first()["value"] in (0.0, 1.0)
    with pytest.raises(ValueError):
        scoring.margin_robustness_index(found, [9], tau=0.0)


def test_undefined_causes(spark):
    rows = spark.createDataFrame([("d", 1, 1, 0.1, "SS"), ("d", 2, 1, 0.1, "OO"), ("d", 3, 1, 0.1, "SO")], "subset string, q long, rank int, dist double, type string")
    every = spark.createDataFrame([("d", i) for i in range(1, 5)], "subset string, q long")
    got = scoring.per_unit(scoring.at_k(scoring.evidence(rows, scoring.ones, every), [5]))
    assert {r["q"]: r["cause"] for r in got.collect()} == {1: 1, 2: 2, 3: 0, 4: 3}


def test_tail_ignores_what_is_not_finite(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 4)] + [(math.nan,), (math.inf,), (None,)], "margin double")
    t = margin.tail(rows).first()
    assert t["quantile"] == pytest.approx(1.2) and t["lower_tail_mean"] == 1 and t["n_tail"] == 1


def test_vote_ties_go_to_first_appearance(spark):
    df = table(spark, [[1, 0], [0.9, 0.1], [0.9, -0.1]], ["z", "b", "a"], "VVV")
    found = neighbors.nearest(df, 2)
    votes = {r["q"]: r["vote"] for r in knn.votes(found, df, [2]).collect()}
    assert votes[0] == "b"


def test_search_schedule():
    assert margin.search_schedule(32, 31) == {"k_start": 31, "k_final": 31, "retries": 0}
    assert margin.search_schedule(1000, 150) == {"k_start": 200, "k_final": 400, "retries": 1}


def test_manifest_checks(spark):
    raw = spark.createDataFrame([(0, " a ", "/a", None, "g", "x "), (1, "b", "/b", "L", " ", "y")], "row_id long, sample_id string, image_path string, label string, group_id string, site string")
    with pytest.raises(ValueError, match=r"\[1\]"):
        mf.normalise(raw, "site")
    ok = mf.normalise(raw.where("row_id = 0"), "site").first()
    assert (ok["sample_id"], ok["label"], ok["confounder"]) == ("a", "nan", "x")
    with pytest.raises(ValueError, match="lacks"):
        mf.normalise(raw, "nothing")
    with pytest.raises(ValueError):
        mf.keep_labels(table(spark, *blob(8)), "A,A")


def test_expansion_needs_full_cells(spark):
    df = table(spark, np.eye(5), "AABBC", ["1", "2", "1", "2", "1"]).drop("subset")
    assert {r["subset"] for r in mf.expand_2x2(df).select("subset").collect()} == {"A+B__1_2"}


def test_alignment_errors(spark):
    a = spark.createDataFrame([(0, "s", "/p"), (1, "t", "/q")], "row_id long, sample_id string, image_path string")
    with pytest.raises(ValueError, match="another path"):
        align.view_rows(spark.createDataFrame([(0, "s", "/else")], a.schema), a)
    with pytest.raises(ValueError, match="repeated"):
        align.many_to_one(a, a.union(a), ["sample_id"])
    assert [r["tile_index"] for r in align.view_rows(a.union(a), a).orderBy("tile_index").collect()] == [0, 0, 1, 1]


def test_frontier_and_ranks(spark):
    p = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 2.0), ("c", 2.0, 2.0), ("d", 1.5, 1.0)], "m string, x double, y double")
    assert len(stats.frontier(p, "x", "y").collect()) == 2
    s = stats.spearman(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "a double, b double"), "a", "b").first()
    assert s["spearman"] == pytest.approx(0.5)


def test_bootstrap_delta_of_one_value(spark):
    rows = spark.createDataFrame([("a", 1.0, 3.0), ("b", 1.0, 3.0)], "g string, x double, y double")
    r = stats.bootstrap_delta(rows, "x", "y", "g", n=4).first()
    assert (r["point"], r["low"], r["high"]) == (2.0, 2.0, 2.0)
    assert math.isnan(stats.bootstrap_spearman([(1, 2), (2, 3)])[0])


def test_degradation_closed_form(spark):
    acc = spark.createDataFrame([(s, i, a) for s, a in enumerate((0.9, 0.7, 0.5)) for i in range(2)], "split int, iter int, acc double")
    bias = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 1.0)], "split int, v double")
    assert downstream.integrated_degradation(acc, bias, 0.5).first()["nipd"] == pytest.approx(-0.5)
    assert downstream.average_performance_drop(acc).first()["apd"] == pytest.approx((0.7 / 0.9 + 0.5 / 0.9) / 2 - 1)
    with pytest.raises(ValueError):
        downstream.check_accuracies(acc.where("split = 0"))


def test_probe_sweep(spark):
    rng = np.random.default_rng(0)
    rows = [(n, n % 4 // 2, n % 2, [float(v) for v in rng.normal(size=3) + [3 * (n % 2), 0, 0]]) for n in range(4 * 30)]
    df = spark.createDataFrame(rows, "row_id long, i int, j int, features array<double>")
    got = downstream.probe_sweep(df, downstream.schedule(spark, "camelyon", n_splits=2), iterations=2, validation=0.3).collect()
    assert len(got) == 4 and np.mean([r["acc"] for r in got]) > 0.7
    assert downstream.replicate_seeds(1000, 6) == [7028, 1624, 6448, 5783, 1031, 7666]
    with pytest.raises(ValueError):
        downstream.probe_sweep(df, downstream.schedule(spark, "pcabiop"), iterations=1)


def test_tiers_and_flags(spark):
    rows = [(f"s{i}", "A" if i < 20 else "B", "x" if i % 2 else "y", -0.3 + 0.01 * i if i < 20 else 0.5) for i in range(60)]
    t = report.tiers(report.subgroups(spark.createDataFrame(rows, "sample_id string, label string, confounder string, margin double")))
    got = {(r["scope"], r["label"]): r for r in t.where("scope = 'label'").collect()}
    assert got["label", "A"]["tier1"] == "broad_weakness" and got["label", "A"]["tier3"].startswith("tail_enriched")
    assert got["label", "B"]["tier1"] == "neutral"


def test_sources(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r["embedding"] for r in tables.read_matrix(spark, str(tmp_path / "m.npy")).orderBy("row_id").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "v").mkdir()
    np.savez(tmp_path / "v/a.npz", embedding=np.ones((1, 2)), other=np.zeros(1))
    assert tables.read_vectors(spark, str(tmp_path / "v")).first()["embedding"] == [1, 1]
    (tmp_path / "i.jsonl").write_text('{"k": "a", "x": 1}\nbroken\n{"k": "a", "x": 2}\n')
    assert '"x": 2' in tables.read_json_index(spark, str(tmp_path / "i.jsonl"), "k").first()["json"]
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    assert tables.fingerprint(df, ["row_id"]) == tables.fingerprint(df.repartition(7), ["row_id"]) != tables.fingerprint(df.where("row_id > 0"), ["row_id"])
    (tmp_path / "m.csv").write_text("sample_id,image_path,label,group_id,site\n a,/a,L,g,x\nb,/b,,h,y\n")
    assert [r["label"] for r in mf.read_csv(spark, str(tmp_path / "m.csv"), "site").orderBy("row_id").collect()] == ["L", "nan"]
    cache = tables.ResultCache(spark, str(tmp_path / "cache"))
    made = []
    for _ in range(2):
        assert cache.get(lambda: made.append(1) or spark.range(3), k=[1, 2]).count() == 3
    assert len(made) == 1 and cache.path(k=[1, 2]) == cache.path(k=[2, 1])


def test_token_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]],)], "t array<array<double>>")
    assert df.select(vectors.pool_tokens(F.col("t")).alias("p")).first()["p"] == [1, 2, 4, 5]


def test_stream_of_new_samples(spark, tmp_path):
    from nearfield.streaming import scoring as stream

    x, labels, confs = blob(40)
    df = table(spark, x, labels, confs)
    df.where("row_id >= 30").write.parquet(str(tmp_path / "in"))
    out = []
    stream.start(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), df.where("row_id < 30"), 3, lambda d, n: out.extend(d.collect()), str(tmp_path / "at")).awaitTermination()
    assert {r["q"] for r in out} == set(range(30, 40))
