"""Substring deduplication: every word inside a run of WINDOW words that occurs more than once goes.

Seed: each window of 35 words has an anchor, the 12 words in it with the smallest hash (winnowing), so equal windows have equal anchors at equal
places. Consecutive windows with one anchor form a run; a run is the anchor extended both ways as far as its windows reach.
First only anchors are counted, and a Bloom filter of bounded size tells the second pass which runs may match at all; what it lets through wrongly
is sorted out by exact counts.
Extend: where the whole extended runs are equal (the inside of long repeats), one count settles all their windows. Where an anchor has different
surroundings (the ends of repeats, edits), a third pass writes the windows of its runs, and they are counted one by one, each different run once. Overlapping
windows merge to maximal repeats.

Words are compared by 64-bit hashes, and always by two independent ones: the anchor's and the run's or window's. No pairs of documents are made: counts are
partial sums before every shuffle, and what is common (an anchor, run or window with more than 1/256 of all runs) is joined by broadcast, so a passage that
a third of all rows share doesn't meet in one task.

Windows are judged on the input. Defined results: null texts have no words; texts under 35 words lose none. Repeated rows are
occurrences of their own, so their windows count as repeated. Null ids are ids like others.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits
from .common import attach, collect_shuffles, keyed, map_rows, stash, unstash, words

WINDOW = 35
ANCHOR = 12
MAX_BITS = 1 << 27
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Runs:
    """Windows of a list of texts. All texts are hashed as one array; windows that would cross texts are left out."""

    def __init__(self, texts: list[str | None], window: int, anchor: int):
        # of bytes, split() knows the space and the controls 9 to 13 only, as `words` does; a hash costs less than a look into a memo of words
        listed = [(t or "").encode().split() for t in texts]
        sizes = np.array([len(w) for w in listed], np.int64)
        self.window, self.found = window, np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(listed)), np.uint64, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - window + 1, 0)
        #: text and place in the array of each window
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.begin = begin
        self.at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
        n = len(self.found) - anchor + 1
        if not len(self.at):
            self.first = self.last = self.place = np.empty(0, np.int64)
            self.anchors = np.empty(0, np.uint64)
            return
        grams = np.zeros(n, np.uint64)
        for j in range(anchor):
            grams = (grams ^ self.found[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
        grams = bits.mix(grams)
        # place of the smallest hash (its top 36 bits, fewer only in lists of over 2^28 words; then the leftmost) of each window, by doubling
        reach, low = window - anchor + 1, np.uint64((1 << max(28, n.bit_length())) - 1)
        least = (grams & ~low) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: n - reach + 1], least[reach - width :])
        self.place = (least[self.at] & low).astype(np.int64)
        new = np.concatenate(([True], (self.place[1:] != self.place[:-1]) | (self.text[1:] != self.text[:-1])))
        #: numbers of the first and last window of each run
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(new)) - 1
        self.anchors = grams[self.place[self.first]]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each run with its surroundings, of each window."""
        sums = np.concatenate(([np.uint64(0)], np.cumsum(bits.mix(self.found) * _powers(_BASE, len(self.found)), dtype=np.uint64)))
        back = _powers(_INVERSE, len(self.found))
        whole = bits.mix((sums[self.at + self.window] - sums[self.at]) * back[self.at])
        start, end = self.at[self.first], self.at[self.last]
        context = (sums[end + self.window] - sums[start]) * back[start]
        shape = ((end - start) * 64 + self.place[self.first] - start).astype(np.uint64)
        return bits.mix(context + bits.mix(shape)), whole


def repeats(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """rows: _key, _text. Returns _key and `ranges`, the repeated windows as (first start, last start)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def make_anchors():
        def run(batch):
            keys, n = np.unique(Runs(batch["_text"], window, anchor).anchors, return_counts=True)
            return {"segment": bits.segment(keys), "key": keys.view(np.int64), "n": n}

        return run

    anchors = map_rows(rows.select("_text"), make_anchors, "segment int, key long, n long")
    repeated = anchors.repartition(parts, "segment").groupBy("segment", "key").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = stash(repeated.select("segment", "key", F.lit(1).alias("levels")), "anchors")
    total = repeated.count()
    may = spark.sparkContext.broadcast(bits.build(repeated.repartition(parts, "segment"), bits.size_for(total, 12, MAX_BITS)))

    def make_runs(filter_of, with_windows: bool):
        """Runs whose anchor is in a filter, and on request the hashes of their windows."""

        def make():
            columns = ("_key", "a", "c", *(("s1", "w") if with_windows else ("s1", "s2")))

            def run(batch):
                own = Runs(batch["_text"], window, anchor)
                some = np.flatnonzero(filter_of.value.has(own.anchors))
                if not len(some):
                    return {c: [] for c in columns}
                context, whole = own.hashes()
                first, last = own.first[some], own.last[some]
                text = own.text[first]
                data = whole.tobytes()
                out = {
                    "_key": [batch["_key"][t] for t in text.tolist()],
                    "a": own.anchors[some].view(np.int64),
                    "c": context[some].view(np.int64),
                    "s1": own.at[first] - own.begin[text],
                }
                if with_windows:
                    return out | {"w": [data[8 * f : 8 * e + 8] for f, e in zip(first.tolist(), last.tolist(), strict=True)]}
                return out | {"s2": own.at[last] - own.begin[text]}

            return run

        return make

    held = stash(map_rows(rows.select("_key", "_text"), make_runs(may, False), "_key binary, a long, c long, s1 int, s2 int"), "runs")
    counted = stash(held.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n")), "counts")
    # whole runs that occur again
    every = held.count()
    full = attach(held, counted.where("n > 1"), ["a", "c"], "n", every).select("_key", "s1", "s2")
    # anchors with several surroundings, one of them single: window by window, each different run once; only their windows are written, from a third pass
    mixed = stash(counted.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("a", "m"), "mixed")
    settled = stash(attach(counted, mixed, "a", "m").select("a", "c", "n"), "mixed-counts")

    def make_mixed_keys():
        return lambda batch: {"segment": bits.segment(np.array(batch["a"], np.int64).view(np.uint64)), "key": batch["a"], "levels": np.ones(len(batch["a"]), np.int32)}

    keys = map_rows(mixed.select("a"), make_mixed_keys, "segment int, key long, levels int").repartition(parts, "segment")
    among = spark.sparkContext.broadcast(bits.build(keys, bits.size_for(mixed.count(), 12, MAX_BITS)))
    collect_shuffles(spark)
    windows = map_rows(rows.select("_key", "_text"), make_runs(among, True), "_key binary, a long, c long, s1 int, w binary")
    # one pass only: two branches would read the texts twice, and Spark splits hot partitions of an inner join while it runs
    wide = stash(windows.join(settled, ["a", "c"]), "mixed-runs")
    del windows
    collect_shuffles(spark)

    def make_windows():
        def run(batch):
            out = {c: [] for c in ("_key", "a", "s", "w", "n")}
            for key, a, s1, w, n in zip(*(batch[c] for c in ("_key", "a", "s1", "w", "n")), strict=True):
                own = np.frombuffer(w, np.int64)
                out["_key"] += [key] * len(own)
                out["a"] += [a] * len(own)
                out["s"] += range(s1, s1 + len(own))
                out["w"] += own.tolist()
                out["n"] += [n] * len(own)
            return out

        return run

    schema = "_key binary, a long, s int, w long, n long"
    once = wide.groupBy("a", "c").agg(F.first("w").alias("w"), F.first("n").alias("n")).select(F.lit(b"").alias("_key"), "a", F.lit(0).alias("s1"), "w", "n")
    again = stash(map_rows(once, make_windows, schema).groupBy("a", "w").agg(F.sum("n").alias("n")).where("n > 1"), "again")
    single = map_rows(wide.where("n = 1").select("_key", "a", "s1", "w", "n"), make_windows, schema).drop("n")
    # a run has few windows, so that hot ones are at most a few times as many as hot runs
    ends = attach(single, again, ["a", "w"], "n", every).select("_key", F.col("s").alias("s1"), F.col("s").alias("s2"))
    # a set of ranges of one text: bounded by the text; equal rows give equal ranges, which collapse before the shuffle
    found = stash(full.unionByName(ends).groupBy("_key").agg(F.collect_set(F.struct("s1", "s2")).alias("ranges")), "ranges")
    for done in (repeated, held, counted, mixed, settled, wide, again):
        unstash(done)
    collect_shuffles(spark)
    return found


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """The id, n_words, n_removed, kept_sha256 and, on request, the kept text (words joined by one space)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = keyed(docs, id_col, text_col)
    found = repeats(rows, window)

    def make():
        def run(batch):
            out = {c: [] for c in ("id", "n_words", "n_removed", "kept_sha256") + ("text",) * with_text}
            for i, text, ranges in zip(batch["_id"], batch["_text"], batch["ranges"], strict=True):
                own = words(text)
                gone = np.zeros(len(own) + 1, np.int64)
                for r in ranges or ():
                    gone[r["s1"]] += 1
                    gone[min(r["s2"] + window, len(own))] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = " ".join(own if not gone.any() else [w for w, g in zip(own, gone.tolist(), strict=True) if not g])
                out["id"].append(i)
                out["n_words"].append(len(own))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept.encode()).hexdigest())
                if with_text:
                    out["text"].append(kept)
            return out

        return run

    schema = f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return map_rows(rows.join(found, "_key", "left").select("_id", "_text", "ranges"), make, schema).withColumnRenamed("id", id_col)
