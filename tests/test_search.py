"""The pruned search, the widening search, running votes and grouped quantiles."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.operators import neighbors
from test_core import blob, table


def clustered(n=1500, clusters=12, d=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[np.arange(n) % clusters] + rng.normal(scale=0.02, size=(n, d))
    x[: n // 3] = x[0]  # a third of all rows are one point: ties by id
    x[n - 3 :] = 0
    return x, [f"l{i % 3}" for i in range(n)], [f"c{i // 3 % 2}" for i in range(n)], [f"g{i // 4}" for i in range(n)]


def found(df):
    return {tuple(r) for r in df.collect()}


def test_pruned_search_is_exact(spark):
    df = table(spark, *clustered())
    want = found(neighbors.nearest(df, 5).select("q", "c", "rank", "dist"))
    assert found(neighbors.nearest(df, 5, pivots=24).select("q", "c", "rank", "dist")) == want and len(want) == 7500
    want = found(neighbors.nearest_typed(df, 3).select("q", "c", "type", "rank"))
    assert found(neighbors.nearest_typed(df, 3, pivots=24, block=100).select("q", "c", "type", "rank")) == want


def test_pruned_search_drops_block_pairs(spark):
    df = table(spark, *clustered())
    r = neighbors.around_pivots(df, k=5, pivots=24, block=100)[1].first()
    assert 0 < r["run"] < r["all_pairs"] / 2


def test_pruned_search_of_subsets_and_others(spark):
    x, labels, confs = blob(200)
    df = table(spark, x, labels, confs).withColumn("subset", F.when(F.col("row_id") < 4, "few").when(F.col("row_id") < 90, "a").otherwise("b"))
    queries = df.where("row_id % 7 = 0")
    want = found(neighbors.nearest(queries, 3, against=df).select("subset", "q", "c", "rank"))
    assert found(neighbors.nearest(queries, 3, against=df, pivots=9).select("subset", "q", "c", "rank")) == want
    assert neighbors.nearest(df.limit(0), 3, pivots=9).count() == 0


def test_search_writes_in_proportion(spark):
    """Without clusters nothing is pruned: no table of queries times pivots may be written."""
    from nearfield.sources import shared

    x, labels, confs = np.random.default_rng(5).normal(size=(1200, 8)), [f"l{i % 3}" for i in range(1200)], [f"c{i // 3 % 2}" for i in range(1200)]
    df, seen = table(spark, x, labels, confs), len(shared._written)
    got = found(neighbors.nearest(df, 3, pivots=64).select("q", "c", "rank"))
    assert got == found(neighbors.ranked(neighbors.pairs(df)).where("rank <= 3").select("q", "c", "rank"))
    assert sum(spark.read.parquet(path).count() for _, path in shared._written[seen:]) < 12 * 1200


def test_search_in_many_parts(spark, monkeypatch):
    """Parts, blocks and chunks of a few rows, ties of a third of all rows, and rows that are no numbers: as the join of all pairs has it."""
    monkeypatch.setattr(neighbors, "LEAST", 20)
    x, labels, confs, groups = clustered(300)
    x[7] = np.nan
    df = table(spark, x, labels, confs, groups)
    every = neighbors.ranked(neighbors.pairs(df))
    fields = ("q", "c", "rank", "same_label", "same_conf")
    assert found(neighbors.nearest(df, 4, block=16).select(*fields)) == found(every.where("rank <= 4").select(*fields))
    nth = F.row_number().over(neighbors.Window.partitionBy("q", "type").orderBy("rank"))
    typed = every.where("type in ('SO', 'OS')").withColumn("nth", nth).where("nth <= 2")
    assert found(neighbors.nearest_typed(df, 2, block=16).select("q", "c", "type", "rank")) == found(typed.select("q", "c", "type", "nth"))
    both = found(every.where("rank <= 4").select("q", "c")) | found(typed.select("q", "c"))
    assert sorted(tuple(r) for r in neighbors.candidates(df, k=4, m=2, block=16).select("q", "c").collect()) == sorted(both)


def test_search_in_designs(spark, monkeypatch):
    """Each row is searched for once, whatever the number of designs that it is in, and the lists are those of the expanded rows."""
    from nearfield.sources import manifest

    monkeypatch.setattr(neighbors, "LEAST", 40)
    x, _, _, groups = clustered(400)
    x[7] = np.nan
    rng = np.random.default_rng(3)
    labels, confs = [f"l{i}" for i in rng.integers(0, 4, 400)], [f"c{i}" for i in rng.integers(0, 3, 400)]
    df = table(spark, x, labels, confs, groups).where("label <> 'l3' or confounder <> 'c2'").drop("subset")
    fields = ("subset", "q", "c", "rank", "dist", "type")
    sent = []
    sweep = neighbors._sweep
    monkeypatch.setattr(neighbors, "_sweep", lambda asks, *rest: sent.append(asks.count()) or sweep(asks, *rest))
    for kind, other in ((neighbors.nearest, neighbors.nearest_2x2), (neighbors.nearest_typed, neighbors.nearest_typed_2x2)):
        for n in (60 if kind is neighbors.nearest else 3,):
            want = [tuple(r) for r in kind(manifest.expand_2x2(df), n).select(*fields).fillna(9.0).orderBy("subset", "q", "type", "rank").collect()]
            sent.clear()
            got = [tuple(r) for r in other(df, n, block=16).select(*fields).fillna(9.0).orderBy("subset", "q", "type", "rank").collect()]
            assert got == want and len(got) > 400 and sent == [df.count()]
    odd = df.replace({"l1": "l 0", "l0": "l_0"}, subset=["label"])  # two labels, one name
    assert found(neighbors.nearest_2x2(odd, 3).select("subset", "q").distinct()) == found(neighbors.nearest(manifest.expand_2x2(odd), 3).select("subset", "q").distinct())


def test_single_precision_loses_no_neighbour(spark):
    """Candidates whose distances differ by less than single precision can tell."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=16) + rng.normal(scale=1e-7, size=(600, 16))
    df = table(spark, x, [f"l{i % 3}" for i in range(600)], [f"c{i // 3 % 2}" for i in range(600)])
    every = neighbors.ranked(neighbors.pairs(df)).where("rank <= 3").select("q", "rank", F.round("dist", 11).alias("d"))
    assert found(neighbors.nearest(df, 3).select("q", "rank", F.round("dist", 11).alias("d"))) == found(every)


def test_search_sends_few_copies(spark, monkeypatch):
    """Candidates go once to each part, in single precision where they are given so."""
    sent, sweep = [], neighbors._sweep
    monkeypatch.setattr(neighbors, "_sweep", lambda asks, has, sizes, *rest: sent.append((sizes.agg(F.sum("parts")).first()[0], dict(has.dtypes)["v"])) or sweep(asks, has, sizes, *rest))
    n = 40 * neighbors.LEAST
    df = spark.range(n).select(F.col("id").alias("row_id"), F.lit("s").alias("subset"), F.lit("l").alias("label"), F.lit("c").alias("confounder"), F.col("id").cast("string").alias("group_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    assert neighbors.nearest(df, 1).count() == n and sent == [(12, "array<float>")]


def test_search_writes_candidates_once(spark, monkeypatch):
    """However many parts there are, the candidates are written once in pieces; pieces that several tasks a part go through give the same lists and counts."""
    written, stash = {}, neighbors.stash
    monkeypatch.setattr(neighbors, "stash", lambda df, name: written.setdefault(name, stash(df, name)))
    monkeypatch.setattr(neighbors, "LEAST", 20)
    monkeypatch.setattr(neighbors, "STREAM", 8000)
    x, labels, confs, groups = clustered(300)
    x[7] = np.nan
    df = table(spark, x, labels, confs, groups)
    every = neighbors.ranked(neighbors.pairs(df))
    fields = ("q", "c", "rank", "same_label", "same_conf")
    assert found(neighbors._searched(df, 4).select(*fields)) == found(every.where("rank <= 4").select(*fields))
    pieces = written["pieces"].collect()
    assert sum(len(b) for p in pieces for b in pa.ipc.open_stream(p["data"])) == 300 and sum(len(p["data"]) for p in pieces) > 8000
    assert written["parts"].agg(F.sum("parts")).first()[0] == 12
    written.clear()
    near, _ = neighbors.around_pivots(df, k=4, pivots=9, ranked=True)
    assert found(near.select("q", "c", "rank")) == found(every.where("rank <= 4").select("q", "c", "rank"))
    written.clear()
    first = every.groupBy("q").agg(*(F.min(F.when(F.col("type") == t, F.col("rank"))).alias(t) for t in ("SO", "OS"))).where("SO is not null or OS is not null")
    got = neighbors.first_typed(df).where("q <> 7").select("q", "first_so", "first_os")  # row 7 has no distances
    assert found(got) == found(first.where("q <> 7"))


def test_composition_from_types(spark):
    """Shares by k as one unit after the other has them, some with fewer neighbours than k, from written rows without ids and distances."""
    from nearfield.operators import scoring

    rng = np.random.default_rng(2)
    n = 60
    df = table(spark, rng.normal(size=(n, 4)), [f"l{i}" for i in rng.integers(0, 2, n)], [f"c{i}" for i in rng.integers(0, 2, n)], [f"g{max(0, i - 40)}" for i in range(n)])
    near = neighbors.nearest_types(df, 30)
    assert not {"c", "dist"} & {*near.columns}
    of = {}
    for r in near.orderBy("q", "rank").collect():
        of.setdefault(r["q"], []).append(r["type"])
    assert {len(x) for x in of.values()} == {19, 30}
    for r in scoring.composition(near, [1, 7, 25]).collect():
        shares = {t: np.array([np.mean([x == t for x in own[: r["k"]]]) for own in of.values()]) for t in ("SS", "SO", "OS", "OO")}
        want = [*(shares[t].mean() for t in shares), *np.quantile(shares["OO"], [0.25, 0.75, 0.9])]
        assert np.allclose([r[c] for c in ("mean_ss", "mean_so", "mean_os", "mean_oo", "oo_q25", "oo_q75", "oo_q90")], want)


# --- quantiles ---


@pytest.mark.parametrize(("small", "cuts"), [(20_000, 128), (150, 16)])
def test_grouped_quantiles(spark, monkeypatch, small, cuts):
    from nearfield.operators import quantiles as q

    monkeypatch.setattr(q, "SMALL", small)
    monkeypatch.setattr(q, "CUTS", cuts)
    monkeypatch.setattr(q, "ONE_BUFFER", 10)
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"scope": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]), "kind": rng.choice(["x", "y", "z"], n, p=[0.6, 0.3, 0.1]), "v": np.where(rng.random(n) < 0.3, 0.5, rng.normal(size=n) * 10.0 ** rng.integers(-8, 9, n))})
    pdf.loc[0, "scope"], pdf.loc[0, "kind"] = "alone", "x"
    rows = [(s, k, float(v)) for s, k, v in pdf.itertuples(index=False)] + [("b", "y", float("nan")), ("b", "y", float("inf")), ("b", "y", None), ("none", "x", None)]
    df = spark.createDataFrame(rows, "scope string, kind string, v double")
    pdf["scope"] = pdf["scope"].astype(object).where(pdf["scope"].notna(), None)
    for rest in (False, True):
        got = {(r["scope"], r["kind"], r["q"]): r["x"] for r in q.quantiles(df, "v", [0.1, 0.5, 1.0], by=["scope"], group=["kind"], rest=rest).collect()}
        want = {}
        for s in ("a", "b", None, "alone"):
            whole = pdf[pdf["scope"].isna()] if s is None else pdf[pdf["scope"] == s]
            for k in set(whole["kind"]):
                v = whole["v"][(whole["kind"] != k) if rest else (whole["kind"] == k)].to_numpy()
                want |= {(s, k, p): float(np.quantile(v, p)) for p in (0.1, 0.5, 1.0) if len(v)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_quantiles_of_one_large_group(spark):
    """A million rows in one group: no task holds them."""
    from nearfield.operators import quantiles as q

    df = spark.range(1_000_003).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"), F.lit("g").alias("k"))
    got = {r["q"]: r["x"] for r in q.quantiles(df, "v", [0.1, 0.5], by=["k"]).collect()}
    assert got == {0.1: pytest.approx(100_000.2), 0.5: 500_001.0}
    assert q.quantiles(df.limit(0), "v", [0.5]).count() == 0


# --- votes, widening, tests, densities ---


def test_running_votes(spark):
    from nearfield.operators import knn

    x, labels, confs = blob(40)
    df = table(spark, x, [f"l{i % 3}" for i in range(40)], confs)
    near = neighbors.nearest(df, 7)
    ks = [1, 2, 3, 5, 7, 50]
    got = {(r["q"], r["k"]): (r["vote"], r["n_votes"]) for r in knn.votes(near, df, ks).collect()}
    lists = near.orderBy("q", "rank").toPandas().groupby("q")["c"].apply(list)
    for q, c in lists.items():
        for k in ks:
            first = [int(i) % 3 for i in c[:k]]  # codes are in order of first appearance
            best = max(set(first), key=lambda v: (first.count(v), -v))
            assert got[q, k] == (f"l{best}", first.count(best))


def test_widening_equals_the_exhaustive_search(spark):
    from nearfield.operators import margin

    x, labels, confs = blob(90, label=3.0)
    df = table(spark, x, labels, confs)
    found, said = neighbors.widening_typed(df, 4, start_k=5, growth=1.5)
    columns = ("q", "c", "type", "rank")
    assert {tuple(r) for r in found.select(*columns).collect()} == {tuple(r) for r in neighbors.nearest_typed(df, 4).select(*columns).collect()}
    depths = {r["q"]: r["depth"] for r in neighbors.typed_depth(df, 4).collect()}
    assert depths == {r["q"]: r["depth"] for r in margin.depths(neighbors.ranked(neighbors.pairs(df)), 4).collect()}
    assert said == margin.search_schedule(90, max(depths.values()), 5, 1.5) and said["retries"] > 2


def test_p_values(spark):
    from nearfield.operators import stats

    cases = [(t, df) for t in (0.0, 0.001, 0.5, 2.0, 12.706204736, -30.0) for df in (1, 2, 3, 10, 57, 200, 201, 999)]
    rows = spark.createDataFrame([(float(t), df) for t, df in cases], "t double, df long")
    for r in rows.withColumn("p", stats.t_tail(F.col("t"), F.col("df"))).collect():
        assert r["p"] == pytest.approx(1 - stats.t_probability(abs(r["t"]), r["df"]), abs=1e-9)
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "a double, b double")
    assert stats.correlations(line, "a", "b").first()["pearson_p"] == pytest.approx(0.0, abs=1e-9) and stats.correlations(line.limit(2), "a", "b").first()["pearson_p"] is None


def test_density(spark):
    from nearfield.operators import stats

    v = np.random.default_rng(2).normal(size=200)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    got = [(r["at"], r["density"]) for r in stats.density(df, "v", points=16).orderBy("at").collect()]
    h = v.std(ddof=1) * 200**-0.2
    want = [(g, np.exp(-0.5 * ((g - v) / h) ** 2).sum() / (200 * h * np.sqrt(2 * np.pi))) for g in np.linspace(v.min(), v.max(), 16)]
    assert np.allclose(got, want) and stats.density(df.limit(0), "v").count() == 0
