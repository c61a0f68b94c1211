"""Votes of neighbours, balanced accuracy and the choice of k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.manifest import factor_codes
from .scoring import at_k, k_list


def votes(found: DataFrame, manifest: DataFrame, ks, target: str = "label") -> DataFrame:
    """Per unit and k the majority value of its first k neighbours; ties go to the value that appears first in the scope. One running count
    along the rank serves every k."""
    codes = factor_codes(manifest, target, ("subset",)).select("subset", F.col(target).alias("value"), "code")
    own = manifest.select("subset", F.col("row_id").alias("c"), F.col(target).alias("value")).join(codes, ["subset", "value"])
    labelled = found.join(own, ["subset", "c"]).select("subset", "q", "rank", "value", "code")
    # a value's count at a rank stands in its last row up to there, so the running maximum over all rows is the leader's; one exchange serves both windows
    unit = labelled.where(F.col("rank") <= max(k_list(ks))).repartition("subset", "q")
    counted = unit.withColumn("n", F.row_number().over(Window.partitionBy("subset", "q", "value").orderBy("rank")))
    leader = F.max(F.struct(F.col("n"), (-F.col("code")).alias("first"), F.col("value"))).over(Window.partitionBy("subset", "q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    led = counted.withColumn("l", leader).select("subset", "q", "rank", F.col("l.value").alias("vote"), F.col("l.n").cast("long").alias("n_votes"))
    return at_k(led, ks).select("subset", "q", "k", "vote", "n_votes")


def balanced_accuracy(voted: DataFrame, manifest: DataFrame, target: str = "label") -> DataFrame:
    """Per subset and k: the mean over true classes of the share of right votes, over rows with neighbours."""
    truth = manifest.select("subset", F.col("row_id").alias("q"), F.col(target).alias("truth"))
    recall = voted.join(truth, ["subset", "q"]).groupBy("subset", "k", "truth").agg(F.avg((F.col("vote") == F.col("truth")).cast("double")).alias("recall"))
    return recall.groupBy("subset", "k").agg(F.avg("recall").alias("balanced_accuracy"))


def curve(voted: DataFrame, manifest: DataFrame, target: str = "label") -> DataFrame:
    """Per k the unweighted mean over the subsets larger than k."""
    sizes = manifest.groupBy("subset").agg(F.count(F.lit(1)).alias("size"))
    each = balanced_accuracy(voted, manifest, target).join(sizes, "subset").where("k < size and size > 1")
    return each.groupBy("k").agg(F.avg("balanced_accuracy").alias("balanced_accuracy"))


def operating_k(curve: DataFrame, ks) -> DataFrame:
    """The k with the best balanced accuracy; among equals the first in the given order."""
    place = F.array_position(F.array(*map(F.lit, k_list(ks))), F.col("k").cast("int"))
    return curve.withColumn("place", place).orderBy(F.desc("balanced_accuracy"), "place").limit(1).select("k", "balanced_accuracy")


def lower_median(df: DataFrame, column: str, by=()) -> DataFrame:
    """The order statistic at (n - 1) // 2."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("place", F.row_number().over(w.orderBy(column))).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.where(F.col("place") == F.floor((F.col("n") + 1) / 2)).select(*by, column)
