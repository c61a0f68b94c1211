"""Studies, draws, test sets of probes and sinks on small tables."""

import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearfield.operators import downstream, neighbors, scoring, stats, studies
from nearfield.sources import publish


def vectors(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("dataset", i, str(i % 3), str(i % 2), f"g{i // 2}", [float(x) for x in rng.normal(size=6)]) for i in range(n)]
    return spark.createDataFrame(rows, "subset string, row_id long, label string, confounder string, group_id string, embedding array<double>")


def test_shares_at_a_sharp_tau(spark):
    found = spark.createDataFrame([("s", 0, 1, 1, 0.1, "SO"), ("s", 1, 1, 1, 0.9, "SO"), ("s", 1, 2, 2, 0.9005, "OS"), ("s", 2, 1, 1, 0.5, "SS")], "subset string, q long, c long, rank int, dist double, type string")
    rows = {r["q"]: r for r in scoring.per_unit(scoring.at_k(scoring.evidence(found, scoring.decay(0.001)), [2])).collect()}
    assert rows[0]["share"] == 1 and rows[1]["share"] == pytest.approx(1 / (1 + math.exp(-0.5))) and rows[2]["share"] is None and rows[2]["cause"] == 1


def test_pooled_weights_share_one_scale(spark):
    """Two subsets at different distances: the nearer one outweighs the other."""
    found = spark.createDataFrame([("a", 0, 1, 1, 0.1, "SO"), ("b", 0, 1, 1, 0.3, "OS")], "subset string, q long, c long, rank int, dist double, type string")
    got = scoring.margin_robustness_index(found, [1], tau=0.2).first()["value"]
    assert got == pytest.approx(math.exp(-0.5) / (math.exp(-0.5) + math.exp(-1.5)))


def test_quantiles(spark):
    for df, want in ((1, 12.706204736), (2, 4.302652730), (19, 2.093024054), (30, 2.042272456), (60, 2.000297822)):
        assert stats.t_quantile(df) == pytest.approx(want, rel=1e-8)
    for n in (40, 62, 500):
        df = spark.createDataFrame([(float(i % 7),) for i in range(n)], "x double")
        row, x = stats.t_interval(df, "x").first(), np.arange(n) % 7
        assert row["high"] - row["mean"] == pytest.approx(stats.t_quantile(n - 1) * x.std(ddof=1) / math.sqrt(n), rel=1e-8)
    assert stats.t_interval(spark.createDataFrame([(1.0,)], "x double"), "x").first()["low"] is None


def test_histogram_of_odd_values(spark):
    df = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), None, -5.0, 0.0, 0.49, 0.5, 1.0, 9.0, 1e300)], "x double")
    assert [r["n"] for r in stats.histogram(df, "x", 0.0, 1.0, 2).orderBy("bin").collect()] == [3, 4]


def test_bootstrap_medians_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=300), 1)  # ties
    c = rng.integers(0, 9, 300)
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(c, x, strict=True)], "cluster string, x double")
    got = {r["rep"]: r["median"] for r in stats.weighted_medians(df, stats.draw_table(df, "cluster", 40, 5), "cluster", "x").collect()}
    for rep, drawn in enumerate(stats.draws(sorted({str(i) for i in c}), 40, 5)):
        names = sorted({str(i) for i in c})
        assert got[rep] == pytest.approx(np.median(np.concatenate([x[c == int(names[i])] for i in drawn])))


def test_draws_equal_numpy(spark):
    rows = [(f"s{i:03d}", "ab"[i % 2], "xyz"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "sample_id string, center string, biology string")
    pdf = pd.DataFrame(rows, columns=["sample_id", "center", "biology"])
    rng = np.random.default_rng(9)
    want = []
    for center, biology, n in (("b", "x", 4), ("a", "z", 7)):
        cell = pdf[(pdf.center == center) & (pdf.biology == biology)].sort_values("sample_id").reset_index(drop=True)
        want += cell.iloc[np.sort(rng.permutation(len(cell))[:n])]["sample_id"].tolist()
    got = stats.seeded_draw(df, "sample_id", [("b", "x", 4), ("a", "z", 7)], ["center", "biology"], 9)
    assert sorted(r["sample_id"] for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError, match="fewer than"):
        stats.seeded_draw(df, "sample_id", [("a", "x", 99)], ["center", "biology"], 9)
    rng, kept = np.random.default_rng(4), []
    for biology in "xyz":
        cell = pdf[pdf.biology == biology].sort_values("sample_id")["sample_id"].to_numpy()
        kept += rng.choice(cell, size=4 if biology < "z" else 3, replace=False).tolist()
    assert sorted(r["sample_id"] for r in stats.stratified_keep(df, "sample_id", 11, "biology", 4).collect()) == sorted(kept)
    for r in stats.cell_pick(df, "sample_id", 42, ["biology", "center"]).collect():
        cell = sorted(pdf[(pdf.center == r["center"]) & (pdf.biology == r["biology"])]["sample_id"])
        seed = int.from_bytes(hashlib.sha256(f"42|{r['biology']}|{r['center']}".encode()).digest()[:8], "big")
        assert r["sample_id"] == cell[int(np.random.default_rng(seed).integers(len(cell)))]


def study(spark, n=160):
    rng = np.random.default_rng(1)
    rows = [(k, k % 2, (k // 2) % 2, [float(x) for x in rng.normal(size=4) + 2 * ((k // 2) % 2)]) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, i int, j int, features array<double>")


def test_test_sets_ride_along(spark):
    rows, plan = study(spark), downstream.schedule(spark, "camelyon", n_splits=3)
    rng = np.random.default_rng(2)
    unseen = spark.createDataFrame([(k % 2, [float(x) for x in rng.normal(size=4) + 2 * (k % 2)]) for k in range(50)], "j int, features array<double>")
    held_out = rows.where("row_id >= 150").select("j", "features")
    got = downstream.probe_sweep_over(rows, plan, {"unseen": unseen, "again": held_out}, iterations=2, validation=0.2).collect()
    own = {(r["split"], r["iter"]): r["acc"] for r in downstream.probe_sweep(rows, plan, iterations=2, validation=0.2).collect()}
    assert len(got) == 18 and {(r["split"], r["iter"]): r["acc"] for r in got if r["test_set"] == "in_domain"} == own
    # brute force: the fitted probes one by one
    probes = downstream._probes(rows, plan, 1, 2, 1000, 0.2, None, None).collect()
    x, y = np.array([r["features"] for r in unseen.collect()]), np.array([r["j"] for r in unseen.collect()])
    for p in probes:
        said = downstream._predict(np.frombuffer(p["w"], "<f8").reshape(p["k"], -1), x)
        want = np.mean([np.mean(said[y == c] == c) for c in (0, 1)])
        assert next(r["acc"] for r in got if r["test_set"] == "unseen" and (r["split"], r["iter"]) == (p["split"], p["iter"])) == pytest.approx(want)
    with pytest.raises(ValueError):
        downstream.probe_sweep_over(rows, plan, {"in_domain": unseen})
    with pytest.raises(ValueError, match="as wide"):
        downstream.probe_sweep_over(rows, plan, {"x": unseen.withColumn("features", F.array(F.lit(1.0)))})


@pytest.mark.parametrize(
    ("change", "plan", "options", "say"),
    [
        (lambda d: d.withColumn("i", F.col("i") - 1), None, {}, "indices from 0"),
        (lambda d: d.withColumn("j", F.col("j") * 2), None, {}, "without gaps"),
        (lambda d: d.withColumn("features", F.when(F.col("row_id") == 3, F.array(F.lit(1.0))).otherwise(F.col("features"))), None, {}, "one width"),
        (lambda d: d.where("false"), None, {}, "one width"),
        (lambda d: d, None, {"rows_per_slide": 0}, "at least one row"),
        (lambda d: d, None, {"validation": 1.0}, "fraction"),
        (lambda d: d, None, {"iterations": 0}, "iterations"),
        (lambda d: d, lambda p: p.where("split = 0"), {}, "two splits"),
        (lambda d: d, lambda p: p.withColumn("j", F.col("j") + 1), {}, "without rows"),
        (lambda d: d, lambda p: p.withColumn("take", F.lit(-1)), {}, "negative"),
        (lambda d: d, lambda p: p.withColumn("take", F.lit(15)), {}, "more rows"),
        (lambda d: d, lambda p: p.union(p), {}, "twice"),
        (lambda d: d.where("row_id < 60"), None, {}, "held-out"),
        (lambda d: d, lambda p: p.withColumn("take", F.when(F.col("split") == 1, 0).otherwise(F.col("take"))), {}, "no training rows"),
    ],
)
def test_schedules_that_do_not_fit(spark, change, plan, options, say):
    base = downstream.schedule(spark, "camelyon", n_splits=2)
    with pytest.raises(ValueError, match=say):
        downstream.probe_sweep(change(study(spark)), plan(base) if plan else base, **({"validation": 0.2} | options)).collect()


def test_fit_reaches_the_optimum():
    """The hand-written fit against plain gradient descent on the same objective."""
    rng = np.random.default_rng(8)
    for classes in (2, 3):
        y = rng.integers(0, classes, 60)
        x = rng.normal(size=(60, 3)) + y[:, None]
        w = downstream._logistic(x, y, classes, 0.5, rounds=500)

        def objective(flat, y=y, x=x, classes=classes):
            v = flat.reshape(w.shape)
            s = np.hstack([x, np.ones((60, 1))]) @ v.T
            loss = np.logaddexp(0, -np.where(y == 1, 1, -1) * s[:, 0]).sum() if classes == 2 else -(s - np.log(np.exp(s).sum(1, keepdims=True)))[np.arange(60), y].sum()
            return 0.5 * (v[:, :-1] ** 2).sum() + 0.5 * loss

        best = objective(w.ravel())
        for _ in range(300):
            assert objective(w.ravel() + rng.normal(scale=0.02, size=w.size)) >= best - 1e-3


def test_reductions(spark):
    acc = spark.createDataFrame([(t, s, i, 0.9 - 0.05 * s - 0.01 * i - 0.1 * (t == "u")) for t in ("in_domain", "u") for s in range(3) for i in range(2)], "test_set string, split int, iter int, acc double")
    bias = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 1.0)], "split int, v double")
    for r in downstream.reductions(acc, bias, 0.5).collect():
        a = np.array([[0.9 - 0.05 * s - 0.01 * i - 0.1 * (r["test_set"] == "u") for i in range(2)] for s in range(3)])
        g = (a.mean(1) - a[0].mean()) / (a[0].mean() - 0.5)
        assert r["apd"] == pytest.approx((a[1:] / a[0]).mean(0).mean() - 1) and r["nipd"] == pytest.approx(((g[1:] + g[:-1]) / 4).sum()) and r["baseline"] == pytest.approx(a[0].mean())
    with pytest.raises(ValueError):
        downstream.reductions(acc, bias, 0.95)
    with pytest.raises(ValueError):
        downstream.reductions(acc.where("not (test_set = 'u' and split = 1 and iter = 1)"), bias, 0.5)


def test_sweep_over_k(spark):
    a, b = vectors(spark), vectors(spark, seed=5)
    swept = studies.k_sweep({"a": (neighbors.nearest(a, 9), a), "b": (neighbors.nearest(b, 9), b)}, [1, 3, 5, 9])
    rows = swept.toPandas()
    assert len(rows) == 8
    for _, own in rows.groupby("model"):
        own = own.sort_values("k")
        assert own["k_star"].iloc[0] == own["k"].iloc[int(np.argmax(own["acc"].to_numpy()))]
    stars = rows.groupby("model")["k_star"].first()
    assert rows["median_k"].iloc[0] == int(np.median(stars))
    assert studies.sweep_agreement(swept.withColumn("k_star", F.lit(3)).withColumn("median_k", F.lit(3)), "ri").first()["largest_change"] == 0


def test_checks(spark):
    a = spark.createDataFrame([(1, 0.5, 0.1, 0.2, 0.2)], "k int, support double, undefined_ss double, undefined_oo double, undefined_tie double")
    assert studies.shared_support(a, a).count() == 1
    with pytest.raises(ValueError, match="differs"):
        studies.shared_support(a, a.withColumn("support", F.lit(0.4)))
    with pytest.raises(ValueError, match="roster"):
        studies.sealed(a, "k", {"2"})
    with pytest.raises(ValueError, match="changed"):
        studies.sealed(a, "k", {"1"}, "0")
    names = spark.createDataFrame([(x,) for x in ("medical_center", "Confounder", " scanner_type  id", "", "__")], "c string")
    assert [r[0] for r in names.select(studies.display_name(F.col("c"))).collect()] == ["Medical Center", "Confounder", "Scanner Type Id", "Confounder", "Confounder"]
    cells = spark.createDataFrame([(x,) for x in ("$3.1$M", r"${\sim}1.1$B", "${>}1$M", "$6{,}093$", "n/d", None)], "c string")
    assert [r[0] for r in cells.select(studies.scale(F.col("c"))).collect()] == [3.1e6, 1.1e9, 1e6, 6093.0, None, None]
    assert studies.k_signature([5, 1, 3, 1]) == "1,3,5" and studies.search_signature(200, 2.0, 0.1) == "start=200;growth=2;alpha=0.1"
    one = spark.createDataFrame([(i, f"k{i}") for i in range(4)], "row_id long, key string")
    with pytest.raises(ValueError, match="aren't in"):
        studies.bijective_slice(one, one.where("row_id < 3"), "key")
    with pytest.raises(ValueError, match="repeated"):
        studies.bijective_slice(one.union(one), one, "key")
    with pytest.raises(ValueError, match="outside"):
        studies.bijective_slice(one, one, "key", F.col("key") != "k2")


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([("b", 2.5), ("a", 1.25), ("c", float("nan"))], "model string, margin double")
    publish.publish(df, f"{root}/one")
    with pytest.raises(ValueError, match="exists"):
        publish.publish(df, f"{root}/one")
    assert spark.read.parquet(f"{root}/one").count() == 3
    publish.write_artifact(df, f"{root}/art", model="m", tau=0.2)
    assert publish.reusable(spark, f"{root}/art", model="m", tau=0.2) and not publish.reusable(spark, f"{root}/none", model="m")
    with pytest.raises(ValueError, match="tau"):
        publish.reusable(spark, f"{root}/art", model="m", tau=0.3)
    (tmp_path / "art" / "sidecar.json").unlink()
    with pytest.raises(ValueError, match="incomplete"):
        publish.reusable(spark, f"{root}/art", model="m", tau=0.2)
    publish.write_distribution(df, f"{root}/dist", "margin", k=5)
    assert spark.read.parquet(f"{root}/dist/values").count() == 2
    meta = json.loads((tmp_path / "dist" / "sidecar.json").read_text())
    assert meta["n"] == 2 and meta["median"] == 1.875 and meta["k"] == 5
    publish.write_run_config(spark, f"{root}/run", {"k": 5, "models": ["a"]})
    assert publish.read_run_config(spark, f"{root}/run") == {"k": 5, "models": ["a"]}
    publish.export(spark, {"panel": (df.where("model <> 'c'"), ["model"])}, f"{root}/out")
    text = (tmp_path / "out" / "panel.csv").read_text()
    record = json.loads((tmp_path / "out" / "PROVENANCE.json").read_text())
    assert text == "model,margin\na,1.25\nb,2.5\n" and record["panel.csv"] == hashlib.sha256(text.encode()).hexdigest()
    assert publish.markdown(df.where("model <> 'c'").orderBy("model")) == "| model | margin |\n|---|---|\n| a | 1.25 |\n| b | 2.5 |\n"


def test_registry(spark, tmp_path):
    from nearfield.sources import registry

    tiles = spark.createDataFrame([(0, "s0", "/0"), (1, "s1", "/1")], "row_id long, sample_id string, image_path string")
    for model in ("m2", "m1"):
        emb = tiles.select("row_id", F.array(F.col("row_id").cast("double")).alias("embedding"))
        emb.write.parquet(f"file://{tmp_path}/tiles/embeddings/model={model}")
    tiles.write.parquet(f"file://{tmp_path}/tiles/manifest")
    (tmp_path / "eval.csv").write_text("sample_id,image_path,label,group_id,center\ns1,/1,x,g1,c\ns0,/0,y,g0,c\ns1,/1,x,g1,c\n")
    known = registry.Registry()
    known.add(registry.Benchmark("small", "tiles", f"file://{tmp_path}/eval.csv", confounder="center"))
    with pytest.raises(ValueError):
        known.add(registry.Benchmark("small", "tiles", "x"))
    with pytest.raises(ValueError):
        known.get("other")
    view = known.view(spark, f"file://{tmp_path}", "small")
    assert view.models == ["m1", "m2"] and view.spec.k_max == 100
    assert sorted((r["sample_id"], r["embedding"][0]) for r in view.features("m1").collect()) == [("s0", 0.0), ("s1", 1.0), ("s1", 1.0)]


def test_correlation_of_constants(spark):
    """A constant side has no correlation; it must not stop the query."""
    from nearfield.operators import stats

    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 5.0), ("b", 1.0, 2.0), ("b", 2.0, 1.0), ("b", 3.0, 0.0), ("c", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r for r in stats.correlations(df, "x", "y", ("g",)).collect()}
    assert all(np.isnan(got["a"][c]) for c in ("spearman", "pearson", "spearman_p", "pearson_p")) and got["c"]["spearman"] is None
    assert got["b"]["spearman"] == pytest.approx(-1) and got["b"]["n"] == 3
    values = spark.createDataFrame([(m, t, v) for m in range(3) for t, v in ((0.1, 1.0), (1.0, float(m)))], "model int, tau double, value double")
    assert np.isnan(studies.tau_agreement(values).first()["rho"])


def test_weighted_medians_do_not_meet_replicates(spark, monkeypatch):
    """By group, with values that many rows share and several ranges; nothing larger than values or replicates is written."""
    from nearfield.sources import shared

    monkeypatch.setattr(stats, "RANGE", 50)
    rng = np.random.default_rng(2)
    n = 4000
    x = np.where(rng.random(n) < 0.4, 0.25, np.round(rng.normal(size=n), 2))
    rows = pd.DataFrame({"cluster": rng.integers(0, 9, n).astype(str), "model": rng.choice(["a", "b"], n), "x": x})
    df = spark.createDataFrame(rows)
    seen = len(shared._written)
    taken = stats.draw_table(df, "cluster", 30, 4)
    got = {(r["rep"], r["model"]): r["median"] for r in stats.weighted_medians(df, taken, "cluster", "x", ("model",)).collect()}
    want = {}
    for r in taken.toPandas().groupby("rep"):
        times = rows["cluster"].map(r[1].set_index("cluster")["times"]).fillna(0).astype(int)
        for m in ("a", "b"):
            want[r[0], m] = float(np.median(np.repeat(rows["x"], times)[np.repeat(rows["model"], times) == m]))
    assert got == want
    written = shared._written[seen:]
    assert written and sum(spark.read.parquet(path).count() for _, path in written) <= n + 30 * 2 * 2


def test_held_out_rows_are_scored_in_batches(spark):
    """No task holds a probe's held-out rows, which are all the table's but the schedule's."""
    rows, plan = study(spark), downstream.schedule(spark, "camelyon", n_splits=2)
    found = downstream._probes(rows, plan, 1, 2, 1000, 0.2, None, None)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    own = {(r["split"], r["iter"]): r["acc"] for r in downstream.probe_sweep(rows, plan, iterations=2, validation=0.2, eval_func=downstream._score).collect()}
    assert len(own) == 4 and {(r["split"], r["iter"]): r["acc"] for r in found.collect()} == pytest.approx(own)


def test_draws_stay_counts(spark, monkeypatch):
    """A replicate's draws are a byte for each cluster and pass through no table of the driver's rows."""
    clusters, n = 300, 20
    df = spark.createDataFrame(pd.DataFrame({"cluster": np.arange(1200) % clusters, "model": np.arange(1200) // 600, "x": np.arange(1200) % 77}).astype({"cluster": str, "model": str, "x": float}))
    names, reps, times = stats.draw_counts(df, "cluster", n, 6)
    assert names == sorted(map(str, range(clusters))) and [*reps] == [*range(n)] and times.nbytes == n * clusters
    assert (times == [np.bincount(d, minlength=clusters) for d in stats.draws(names, n, 6)]).all()
    table = {(r["rep"], r["cluster"]): r["times"] for r in stats.draw_table(df, "cluster", n, 6).collect()}
    assert table == {(r, names[c]): times[r, c] for r, c in zip(*np.nonzero(times), strict=True)}
    monkeypatch.setattr(type(df), "toPandas", None)
    summary, pairs = stats.rank_stability(df.withColumnRenamed("cluster", "c"), "model", "x", "c", n=n, seed=6)  # a name that the search uses itself
    assert summary.count() == pairs.count() == 2


def test_counts_are_searched_by_part(spark, monkeypatch):
    """Clusters of their own levels spread the medians over many parts; no task is given a group's counts by range, only a part's."""
    from nearfield.sources import shared

    monkeypatch.setattr(stats, "RANGE", 20)
    monkeypatch.setattr(stats, "CELLS", 100)
    rng = np.random.default_rng(8)
    c = rng.integers(0, 12, 3000)
    rows = pd.DataFrame({"cluster": c.astype(str), "x": 10.0 * c + rng.random(3000)})
    df = spark.createDataFrame(rows)
    seen = len(shared._written)
    got = {r["rep"]: r["median"] for r in stats.weighted_medians(df, stats.draw_counts(df, "cluster", 60, 4), "cluster", "x").collect()}
    names = sorted(set(rows["cluster"]))
    pools = [np.concatenate([rows["x"][rows["cluster"] == names[i]] for i in drawn]) for drawn in stats.draws(names, 60, 4)]
    assert got == {rep: float(np.median(pool)) for rep, pool in enumerate(pools)}
    counts = next(spark.read.parquet(path) for _, path in shared._written[seen:] if path.endswith("-counts")).toPandas()
    parts = counts.groupby("part")
    assert len(parts) > 8 and parts["bin"].nunique().max() <= len(parts) + 1 and parts.size().max() < len(counts) / 4


def test_delta_searches_both_columns_at_once(spark):
    """Values that are no numbers are left out of their own column only; the table is written once, and its own medians are a replicate's."""
    from nearfield.sources import shared

    rng = np.random.default_rng(12)
    n, reps = 1500, 50
    rows = pd.DataFrame({"cluster": rng.integers(0, 7, n).astype(str), "part": rng.choice(["p", "q", "r"], n), "x": np.round(rng.normal(size=n), 1), "y": rng.normal(size=n)})
    rows.loc[rng.random(n) < 0.2, "x"] = math.nan
    rows.loc[rng.random(n) < 0.1, "y"] = math.inf
    df = spark.createDataFrame(rows)
    seen = len(shared._written)
    got = stats.bootstrap_delta(df, "x", "y", "cluster", n=reps, seed=3).first()
    assert sum(path.endswith("-values") for _, path in shared._written[seen:]) == 1
    names = sorted(set(rows["cluster"]))

    def delta(pool, by=False):
        good = pool.replace([math.inf], math.nan)
        meds = good.groupby("part")[["x", "y"]].median().median() if by else good[["x", "y"]].median()
        return meds["y"] - meds["x"]

    pools = [pd.concat([rows[rows["cluster"] == names[i]] for i in drawn]) for drawn in stats.draws(names, reps, 3)]
    for by, r in ((False, got), (True, stats.bootstrap_delta(df, "x", "y", "cluster", n=reps, seed=3, subset="part").first())):
        low, high = np.percentile([delta(p, by) for p in pools], [2.5, 97.5])
        assert (r["point"], r["low"], r["high"], r["n_reps"]) == pytest.approx((delta(rows, by), low, high, reps))
    m = stats.bootstrap_median(df, "x", "cluster", n=reps, seed=3).first()
    low, high = np.percentile([p["x"].median() for p in pools], [2.5, 97.5])
    assert (m["point"], m["low"], m["high"], m["n_reps"]) == pytest.approx((rows["x"].median(), low, high, reps))
