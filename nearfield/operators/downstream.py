"""Probes on training sets that grow more confounded from split to split, and the summaries of their accuracies.

Schedules are tables; replicate orders are drawn in a task with CPython's generator (a replicate starts from the order that the one before left) from the cells' sizes alone,
and written from there as a table of places, which meets the rows in joins; every split of every replicate is fitted as a task of its own.
"""

from __future__ import annotations

import math
import random
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import stash

#: Splits, centres, classes, balanced load, step and most slides a cell of each two-sided schedule.
TWO_SIDED = {
    "camelyon": (8, 2, 7, 1, 14),
    "tolkach_esca": (4, 6, 3, 1, 6),
    "prostate": (9, 2, 16, 2, 32),
    "pcabiop": (11, 2, 100, 10, 200),
}
TCGA_SPLITS, TCGA_MAX = 7, 8


def schedule(spark: SparkSession, name: str, rows_per_slide: int = 1, n_splits: int | None = None) -> DataFrame:
    """split, i (confounder), j (class), take (rows), max_train_slides."""
    if name == "tcga":
        most, side = TCGA_SPLITS, (4, 4)
    elif name in TWO_SIDED:
        most, side = TWO_SIDED[name][0], (2, TWO_SIDED[name][1])
    else:
        raise ValueError(f"unknown schedule {name}")
    if n_splits is not None and not 2 <= n_splits <= most:
        raise ValueError(f"{name} has 2 to {most} splits")
    grid = spark.range(n_splits or most).select(F.col("id").cast("int").alias("split"))
    grid = grid.withColumn("i", F.explode(F.array(*map(F.lit, range(side[0]))))).withColumn("j", F.explode(F.array(*map(F.lit, range(side[1])))))
    s = F.col("split")
    if name == "tcga":
        inverse = F.when(s % 2 == 1, 1).when(s < 3, 2).otherwise(0)
        rest = F.when(s < 2, 2).when(s < 5, 1).otherwise(0)
        slides = F.when(F.col("i") == F.col("j"), s + 2).when(F.col("i") + F.col("j") == 3, inverse).otherwise(rest)
        top = TCGA_MAX
    else:
        _, classes, load, step, top = TWO_SIDED[name]
        favoured = (F.col("i") == 0) == (F.col("j") < classes // 2)
        slides = F.when(favoured, load - step * s).otherwise(load + step * s)
    return grid.select("split", "i", "j", (slides * rows_per_slide).cast("int").alias("take"), F.lit(top).alias("max_train_slides"))


def replicate_seeds(seed: int, n: int) -> list[int]:
    if not 1 <= n <= 10_000:
        raise ValueError("1 to 10000 iterations")
    return random.Random(seed).sample(range(10_000), n)


#: Rows of a batch of the order table.
ORDER_ROWS = 65_536


def arrangements(spark: SparkSession, sizes: dict[tuple[int, int], int], rows_per_slide: int, seeds: list[int], arrange=None) -> DataFrame:
    """iter, i, j, pos, place: at each position of a cell in a replicate, the place of a row among the ids of its cell. Slides are runs of places, named by their number in the
    cell. arrange(slides by cell, generator) returns the same slides in another order; by default each cell is shuffled.

    The table is written. A chain of replicates is one task, as each starts where the one before ended; what it holds is one integer a slide, and rows leave it in batches."""
    cells = sorted(sizes.items())

    def chain(batches):
        for batch in batches:
            slides = {c: array("q", range(-(-n // rows_per_slide))) if arrange is None else [*range(-(-n // rows_per_slide))] for c, n in cells}
            for n in range(len(seeds) if len(batch) else 0):
                rng = random.Random(seeds[n])
                if arrange is None:
                    for own in slides.values():
                        rng.shuffle(own)
                else:
                    slides = arrange(slides, rng)
                    if set(slides) != set(sizes) or any(sorted(own) != [*range(-(-sizes[c] // rows_per_slide))] for c, own in slides.items()):
                        raise ValueError("an arrangement must return the same slides")
                for (i, j), own in slides.items():
                    pos, step = 0, max(1, ORDER_ROWS // rows_per_slide)
                    for at in range(0, len(own), step):
                        places = (np.asarray(own[at : at + step])[:, None] * rows_per_slide + np.arange(rows_per_slide)).ravel()
                        places = places[places < sizes[i, j]]  # the last slide may be shorter
                        yield pd.DataFrame({"iter": n, "i": i, "j": j, "pos": np.arange(pos, pos + len(places)), "place": places})
                        pos += len(places)

    return stash(spark.range(1).coalesce(1).mapInPandas(chain, "iter int, i int, j int, pos long, place long"), "orders")


def case_arrangement(cases: dict[tuple[int, int], list], held_out: dict[int, list[list]]):
    """An arrangement for slides of cases that span classes: a replicate draws one of the feasible sets of held-out cases for each confounder, and moves one slide of each
    of these cases to the back of every cell, where the held-out rows come from. cases: by cell the case of each slide; held_out: by confounder the feasible sets. All draws
    come before the shuffles; cases move in order of their names."""

    def arrange(slides, rng):
        drawn = {i: rng.randrange(len(sets)) for i, sets in sorted(held_out.items())}
        out = {}
        for cell, own in sorted(slides.items()):
            own = [*own]
            rng.shuffle(own)
            for case in sorted({cases[cell][x] for x in own}.intersection(held_out[cell[0]][drawn[cell[0]]])):
                own.append(own.pop(next(at for at, x in enumerate(own) if cases[cell][x] == case)))
            out[cell] = own
        return out

    return arrange


def read_case_splits(spark: SparkSession, path: str, confounders: list[str]) -> dict[int, list[list[str]]]:
    """A JSON object with feasible sets of cases: {"train": {confounder: [[case, ...], ...]}, "test": {...}}. The held-out sets by the index of their confounder; training and
    held-out sets must pair up and share no case."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "train map<string,array<array<string>>>, test map<string,array<array<string>>>").alias("s")).select("s.*").first()
    if raw is None or not raw["train"] or not raw["test"]:
        raise ValueError(f"{path} has no case splits")
    out = {}
    for i, name in enumerate(confounders):
        train, test = raw["train"].get(name), raw["test"].get(name)
        if not train or not test or len(train) != len(test):
            raise ValueError(f"no paired case splits for {name}")
        if any(set(a) & set(b) for a, b in zip(train, test, strict=True)):
            raise ValueError(f"cases of {name} are both trained on and held out")
        out[i] = test
    return out


def slices(order: DataFrame, plan: DataFrame, rows_per_slide: int = 1, validation: float | None = None) -> DataFrame:
    """Role of each row in each split: train, then validation behind it, and the held-out rows from an offset that all splits share."""
    top = F.col("max_train_slides")
    reserve = F.floor(F.col("take") / top) if validation is None else F.bround(F.col("take") * validation)
    first = (top + 1 if validation is None else top + F.bround(top * validation) + 1) * rows_per_slide
    role = F.when(F.col("pos") < F.col("take"), "train").when(F.col("pos") < F.col("take") + reserve, "validation")
    rows = order.join(F.broadcast(plan), ["i", "j"])  # splits times cells
    held = rows.where(F.col("pos") >= first).withColumn("role", F.lit("held_out"))
    return rows.withColumn("role", role).where("role is not null").unionByName(held).select("split", *order.columns, "role")


def _logistic(x: np.ndarray, y: np.ndarray, classes: int, c: float, rounds: int = 100) -> np.ndarray:
    """Softmax (two classes: sigmoid) regression with 1/2 |w|^2 + c sum loss, free intercept, by L-BFGS with a backtracking line search."""
    x = np.hstack([x, np.ones((len(x), 1))])
    width = x.shape[1]
    k = 1 if classes == 2 else classes
    free = np.ones(width)
    free[-1] = 0

    def loss(flat):
        w = flat.reshape(k, width)
        s = x @ w.T
        if k == 1:
            t = np.where(y == 1, 1.0, -1.0) * s[:, 0]
            value = np.logaddexp(0, -t).sum()
            g = (-np.where(y == 1, 1.0, -1.0) / (1 + np.exp(np.clip(t, -500, 500))))[:, None]
        else:
            s = s - s.max(1, keepdims=True)
            log = s - np.log(np.exp(s).sum(1, keepdims=True))
            value = -log[np.arange(len(y)), y].sum()
            g = np.exp(log)
            g[np.arange(len(y)), y] -= 1
        # divided by c times the rows, so that the stopping rule means the same for every penalty
        n = len(x)
        return value / n + 0.5 / (c * n) * ((w * free) ** 2).sum(), (g.T @ x / n + w * free / (c * n)).ravel()

    w = np.zeros(k * width)
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(grad).max() <= 1e-4:
            break
        d, held = -grad, []
        for s, t in reversed(pairs):
            a = (s @ d) / (s @ t)
            held.append(a)
            d = d - a * t
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        else:
            d = d / max(1.0, np.abs(grad).sum())
        for (s, t), a in zip(pairs, reversed(held), strict=True):
            d = d + (a - (t @ d) / (s @ t)) * s
        step = 1.0
        while step > 1e-10:
            new_value, new_grad = loss(w + step * d)
            if new_value <= value + 1e-4 * step * (grad @ d):
                break
            step /= 2
        else:
            break
        s, t = step * d, new_grad - grad
        if s @ t > 1e-12:
            pairs = [*pairs[-9:], (s, t)]
        w, value, grad = w + s, new_value, new_grad
    return w.reshape(k, width)


def _predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = np.hstack([x, np.ones((len(x), 1))]) @ w.T
    return (s[:, 0] > 0).astype(int) if len(w) == 1 else s.argmax(1)


def _score(truth: np.ndarray, said: np.ndarray) -> float:
    """Balanced accuracy."""
    return float(np.mean([np.mean(said[truth == t] == t) for t in np.unique(truth)])) if len(truth) else float("nan")


def fit_probe(train, validation, tests, classes: int, eval_func=None) -> tuple[np.ndarray, list[float]]:
    """Picks the first best of 15 penalties on the validation rows and scores the test sets with a refit: the weights and the scores."""
    score = eval_func or _score
    best, penalty = -math.inf, None
    for c in 10.0 ** np.linspace(-8, 4, 15):
        got = score(validation[1], _predict(_logistic(*train, classes, c), validation[0]))
        if got > best:
            best, penalty = got, c
    w = _logistic(*train, classes, penalty)
    return w, [score(y, _predict(w, x)) for x, y in tests]


IN_DOMAIN = "in_domain"


def _checked_cells(rows: DataFrame, plan: DataFrame, rows_per_slide: int, validation: float | None) -> dict[tuple[int, int], int]:
    """Sizes of the cells, if the schedule fits them."""
    if rows_per_slide < 1:
        raise ValueError("a slide needs at least one row")
    if validation is not None and not 0 <= validation < 1:
        raise ValueError("the validation fraction must be at least 0 and below 1")
    bad = F.col("i").isNull() | F.col("j").isNull() | (F.col("i") < 0) | (F.col("j") < 0) | F.col("features").isNull()
    widths = rows.agg(F.count(F.when(bad, 1)).alias("bad"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not widths["n"] or widths["bad"] or widths["low"] != widths["high"]:
        raise ValueError("rows need indices from 0 and features of one width")
    sizes = {(r["i"], r["j"]): r["n"] for r in rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    for axis, name in ((0, "confounder"), (1, "class")):
        found = {c[axis] for c in sizes}
        if found != set(range(len(found))):
            raise ValueError(f"{name} indices must run from 0 without gaps: {sorted(found)}")
    plans = plan.groupBy("i", "j").agg(F.max("take").alias("most"), F.min("take").alias("least"), F.max("max_train_slides").alias("top"), F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("s")).collect()  # one row a cell
    if not plans or plan.select("split").distinct().limit(2).count() < 2:
        raise ValueError("a schedule needs at least two splits")
    for r in plans:
        cell = (r["i"], r["j"])
        if cell not in sizes:
            raise ValueError(f"the schedule names a cell without rows: {cell}")
        if r["n"] != r["s"]:
            raise ValueError(f"the schedule names the cell {cell} twice in a split")
        if r["least"] < 0 or r["top"] < 1:
            raise ValueError(f"the schedule asks for a negative number of rows: {cell}")
        if r["most"] > sizes[cell] or r["most"] > r["top"] * rows_per_slide:
            raise ValueError(f"the schedule asks for more rows than the cell {cell} has or the most training slides allow")
        first = (r["top"] + 1 + (0 if validation is None else round(validation * r["top"]))) * rows_per_slide
        if sizes[cell] <= first:
            raise ValueError(f"cells too small for the schedule, no held-out rows: {[cell]}")
    if empty := plan.groupBy("split").agg(F.sum("take").alias("n")).where("n = 0").limit(1).collect():
        raise ValueError(f"split {empty[0]['split']} has no training rows")
    return sizes


def _probes(rows: DataFrame, plan: DataFrame, rows_per_slide: int, iterations: int, seed: int, validation: float | None, arrange, eval_func) -> DataFrame:
    """split, iter, acc on the held-out rows, and the fitted weights."""
    spark = rows.sparkSession
    sizes = _checked_cells(rows, plan, rows_per_slide, validation)
    place = Window.partitionBy("i", "j").orderBy("row_id")
    known = rows.withColumn("place", (F.row_number().over(place) - 1).cast("long")).select("i", "j", "place", "features")
    order = arrangements(spark, sizes, rows_per_slide, replicate_seeds(seed, iterations), arrange)
    roles = slices(order, plan, rows_per_slide, validation).join(known, ["i", "j", "place"])
    classes = 1 + max(j for _, j in sizes)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j", "pos"], kind="stable")
        part = {}
        for role in ("train", "validation"):
            own = pdf[pdf["role"] == role]
            part[role] = (np.stack(own["features"].to_numpy()).astype(float) if len(own) else np.zeros((0, 1)), own["j"].to_numpy(int))
        if not len(part["validation"][1]):
            raise ValueError("no validation rows: more rows a slide or a validation fraction are needed")
        w, _ = fit_probe(part["train"], part["validation"], [], classes, eval_func)
        return pd.DataFrame({"split": [key[0]], "iter": [key[1]], "w": [w.astype("<f8").tobytes()], "k": [len(w)]})

    # training and validation rows are bounded by the schedule; held-out rows are all others, so they are scored batch by batch
    learn = roles.where("role <> 'held_out'").groupBy("split", "iter")
    fitted = stash(learn.applyInPandas(fit, "split int, iter int, w binary, k int"), "probes")
    shared = spark.sparkContext.broadcast({(r["split"], r["iter"]): np.frombuffer(r["w"], "<f8").reshape(r["k"], -1) for r in fitted.collect()})  # splits times iterations

    def said(batches):
        for pdf in batches:
            if len(pdf):
                out = np.empty(len(pdf), int)
                for probe, at in pdf.groupby(["split", "iter"]).indices.items():
                    out[at] = _predict(shared.value[probe], np.stack(pdf["features"].to_numpy()[at]).astype(float))
                yield pdf[["split", "iter", "j"]].assign(said=out)

    told = roles.where("role = 'held_out'").select("split", "iter", "j", "features").mapInPandas(said, "split int, iter int, j int, said int")
    if eval_func:
        score = lambda key, pdf: pd.DataFrame({"split": [key[0]], "iter": [key[1]], "acc": [eval_func(pdf["j"].to_numpy(int), pdf["said"].to_numpy(int))]})
        acc = told.groupBy("split", "iter").applyInPandas(score, "split int, iter int, acc double")
    else:
        recall = told.groupBy("split", "iter", "j").agg(F.avg((F.col("j") == F.col("said")).cast("double")).alias("recall"))
        acc = recall.groupBy("split", "iter").agg(F.avg("recall").alias("acc"))
    return fitted.join(acc, ["split", "iter"], "left").select("split", "iter", "acc", "w", "k")


def probe_sweep(rows: DataFrame, plan: DataFrame, *, rows_per_slide: int = 1, iterations: int = 20, seed: int = 1000, validation: float | None = None, arrange=None, eval_func=None) -> DataFrame:
    """rows: row_id, i, j, features. Returns split, iter, acc on the held-out rows. The class j is the target. eval_func(truth, said) gives a score; balanced accuracy by
    default."""
    return _probes(rows, plan, rows_per_slide, iterations, seed, validation, arrange, eval_func).select("split", "iter", "acc")


def probe_sweep_over(rows: DataFrame, plan: DataFrame, tests: dict[str, DataFrame], *, rows_per_slide: int = 1, iterations: int = 20, seed: int = 1000, validation: float | None = None, arrange=None) -> DataFrame:
    """As probe_sweep, and the same probes scored on named test sets (j, features) that no split trains on: test_set, split, iter, acc. The probes are splits times
    iterations small matrices, which go to every task; a test set is read once, in place, and only counts of hits are summed."""
    if IN_DOMAIN in tests:
        raise ValueError(f"{IN_DOMAIN} is no name for a test set")
    width = rows.select(F.size("features").alias("n")).first()
    for name, df in tests.items():
        sizes = df.agg(F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"), F.min("j").alias("j")).first()
        if sizes["j"] is None or sizes["j"] < 0 or width is None or not sizes["low"] == sizes["high"] == width["n"]:
            raise ValueError(f"the test set {name} needs rows with classes from 0 and features as wide as the training rows'")
    own = _probes(rows, plan, rows_per_slide, iterations, seed, validation, arrange, None).collect()  # splits times iterations
    spark = rows.sparkSession
    out = spark.createDataFrame([(IN_DOMAIN, r["split"], r["iter"], r["acc"]) for r in own], "test_set string, split int, iter int, acc double")
    shared = spark.sparkContext.broadcast([(r["split"], r["iter"], np.frombuffer(r["w"], "<f8").reshape(r["k"], -1)) for r in own])

    def hits(batches):
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf["features"].to_numpy()).astype(float), pdf["j"].to_numpy(int)
                found = []
                for split, n, w in shared.value:
                    right = _predict(w, x) == y
                    found += [(split, n, int(c), int((y == c).sum()), int(right[y == c].sum())) for c in np.unique(y)]
                yield pd.DataFrame(found, columns=["split", "iter", "j", "n", "hits"])

    for name, df in tests.items():
        counts = df.select("j", "features").mapInPandas(hits, "split int, iter int, j int, n long, hits long").groupBy("split", "iter", "j").agg((F.sum("hits") / F.sum("n")).alias("recall"))
        out = out.unionByName(counts.groupBy("split", "iter").agg(F.avg("recall").alias("acc")).withColumn("test_set", F.lit(name)))
    return out


def cohort(rows: DataFrame, confounders: list[str], classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows: row_id, subset (ID or OOD), confounder, label, features. The training rows with their indices in the given lists, and the rows of unseen confounders as a
    test set."""
    known = rows.where(F.col("subset").isin("ID", "OOD"))
    if bad := rows.where(F.col("subset").isNull() | ~F.col("subset").isin("ID", "OOD")).limit(1).collect():
        raise ValueError(f"unknown subset: {bad[0]['subset']}")
    index = lambda column, names: (F.array_position(F.array(*map(F.lit, names)), F.col(column)) - 1).cast("int")
    found = known.select("row_id", "subset", index("confounder", confounders).alias("i"), index("label", classes).alias("j"), "features")
    wrong = (F.col("j").isNull() | (F.col("j") < 0)) | ((F.col("subset") == "ID") & (F.col("i").isNull() | (F.col("i") < 0)))
    if bad := found.where(wrong).limit(1).collect():
        raise ValueError(f"row {bad[0]['row_id']} has a class or confounder that isn't listed")
    return found.where("subset = 'ID'").drop("subset"), found.where("subset = 'OOD'").select("j", "features")


def reductions(acc: DataFrame, bias: DataFrame, chance: float) -> DataFrame:
    """acc: test_set, split, iter, acc. Per test set the balanced baseline, the average drop and the integrated degradation; raises for accuracies outside of 0 to 1, for
    incomplete matrices, and for a baseline that isn't above chance."""
    check_accuracies(acc.groupBy("split", "iter").agg(F.max("acc").alias("acc")))
    sets = acc.groupBy("test_set").agg(F.count(F.lit(1)).alias("n"), F.min("acc").alias("low"), F.max("acc").alias("high"))
    cells = acc.select("split", "iter").distinct().count()
    if bad := sets.where((F.col("n") != cells) | (F.col("low") < 0) | (F.col("high") > 1)).limit(1).collect():
        raise ValueError(f"incomplete accuracies, or some outside of 0 to 1: {bad[0].asDict()}")
    base = acc.where("split = 0").select("test_set", "iter", F.col("acc").alias("base"))
    drop = acc.where("split > 0").join(base, ["test_set", "iter"]).groupBy("test_set", "iter").agg((F.avg(F.col("acc") / F.col("base")) - 1).alias("d"))
    drop = drop.groupBy("test_set").agg(F.avg("d").alias("apd"))
    mean = acc.groupBy("test_set", "split").agg(F.avg("acc").alias("a")).join(F.broadcast(bias), "split")  # one row a split
    first = mean.where("split = 0").select("test_set", F.col("a").alias("baseline"))
    if bad := first.where(F.col("baseline") <= chance).limit(1).collect():
        raise ValueError(f"the baseline isn't above chance: {bad[0].asDict()}")
    w = Window.partitionBy("test_set").orderBy("v")
    g = mean.join(first, "test_set").withColumn("g", (F.col("a") - F.col("baseline")) / (F.col("baseline") - chance))
    area = g.withColumn("area", (F.col("v") - F.lag("v").over(w)) * (F.col("g") + F.lag("g").over(w)) / 2).groupBy("test_set").agg(F.first("baseline").alias("baseline"), F.sum("area").alias("nipd"))
    return area.join(drop, "test_set").select("test_set", "baseline", "apd", "nipd")


def check_accuracies(acc: DataFrame) -> DataFrame:
    """At least two splits from 0, the same iterations in each, all finite."""
    r = acc.agg(F.count_distinct("split").alias("s"), F.count_distinct("iter").alias("t"), F.count(F.lit(1)).alias("n"), F.min("split").alias("first"), F.count(F.when(F.col("acc").isNull() | F.isnan("acc"), 1)).alias("bad")).first()
    if r["s"] < 2 or r["t"] < 1 or r["n"] != r["s"] * r["t"] or r["first"] != 0 or r["bad"]:
        raise ValueError("accuracies need two or more splits from 0, complete and finite")
    return acc


def average_performance_drop(acc: DataFrame) -> DataFrame:
    """Mean over iterations of the mean over biased splits of accuracy over baseline, less one."""
    base = acc.where("split = 0").select("iter", F.col("acc").alias("base"))
    each = acc.where("split > 0").join(base, "iter").groupBy("iter").agg((F.avg(F.col("acc") / F.col("base")) - 1).alias("drop"))
    return each.agg(F.avg("drop").alias("apd"))


def integrated_degradation(acc: DataFrame, bias: DataFrame, chance: float) -> DataFrame:
    """bias: split, v from 0 to 1. Trapezoid over v of the change of mean accuracy relative to the baseline's lead over chance."""
    mean = acc.groupBy("split").agg(F.avg("acc").alias("a")).join(bias, "split")
    base = mean.where("split = 0").select(F.col("a").alias("a0"))
    g = mean.crossJoin(F.broadcast(base)).withColumn("g", (F.col("a") - F.col("a0")) / (F.col("a0") - chance))  # one row
    w = Window.orderBy("v")
    return g.withColumn("area", (F.col("v") - F.lag("v").over(w)) * (F.col("g") + F.lag("g").over(w)) / 2).agg(F.sum("area").alias("nipd"))
