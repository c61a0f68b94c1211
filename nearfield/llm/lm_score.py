"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a log scale (level 1 + floor(log2 count)) and only their levels are stored: an n-gram of level q puts
(n-gram, 1) to (n-gram, q) into a Bloom filter. A count is read back by probing levels upwards until one is missing; the mean count of the
last level stands for it. All words are stored, and all pairs that occur at least MIN_PAIR times: pairs seen once are most of all pairs and tell little, so
they are left to the smoothing, at every size of the corpus alike. Probabilities of pairs are smoothed with the word's own (Dirichlet prior of weight
PRIOR), and those of words with add-half counts: (pair + PRIOR p(word)) / (share * before + PRIOR). The share is how much of a first word's occurrences
are in stored pairs, measured on the corpus for each level of that word, so that what unstored pairs had goes to the smoothing.

The filter has PER_ENTRY bits for each stored (n-gram, level), however many there are, which holds the rate of wrong probes under 5 %. It is cut into
segments by the n-gram's hash, so each task builds whole segments from the n-grams shuffled to it. A filter of up to MAX_BITS bits (64 MB) is broadcast.
A larger one stays a table of segments: each batch of texts sends its distinct n-grams to their segments, packed by bucket, and gets their levels back.
Both ways give the same scores.

The base score needs exact word counts: the TOP_WORDS most frequent words are broadcast as two arrays, all other words of the texts are joined with
the whole count table. All training rows are counted and all rows are scored, whole.

Words are compared by 64-bit hashes. A wrong probe can only raise a level; `false_rate` of the model is the filter's measured share of such probes.

Defined results: null texts count as empty; an empty text is the end token alone. Rows in the training fold are scored like any others. Without training
rows every count is 0, N is 0, and base scores are log10(0.5 / 0.5) = 0 for each token. Repeated rows count and score row by row.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bits
from .common import collect_shuffles, crc_mod, let_go, map_rows, smaller_batches, stash, unstash

#: Bits of a stored entry at least: with two probes the fill is at most 1 - exp(-1/4), and its square 0.049.
PER_ENTRY = 8
#: Filters of up to so many bits are broadcast, larger ones probed by segment.
MAX_BITS = 1 << 29
#: Pairs with fewer occurrences are not stored.
MIN_PAIR = 2
#: Runs of neighbouring segments that requests are packed for, at least.
BUCKETS = 512
#: Requests are on disk twice, so texts go through in so many parts, one after the other.
PARTS = 4
PRIOR = 30.0
TOP_WORDS = 1_000_000
#: Tokens that a task holds before it emits their counts, and tokens that are keyed at once.
BUFFER, TOGETHER = 3_000_000, 300_000
#: Low bits of a pair's key, for its class while it is counted.
CLASSES = np.uint64(63)
END, BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x1B03738712FAD5C9)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, lower-cased A-Z, and the end token."""
    # of bytes, lower() knows A-Z only and split() the space and the controls 9 to 13; a hash costs less than a look into a memo of words
    return np.append(np.fromiter(map(xxhash.xxh64_intdigest, (text or "").encode().lower().split()), np.uint64), END)


def pair_keys(found: np.ndarray, starts: np.ndarray | int = 0) -> np.ndarray:
    """Keys of (previous token, token), 58 bits; the first token of each text comes after the beginning."""
    before = np.roll(found, 1)
    before[starts] = BEGIN
    return bits.mix(before * np.uint64(0x9E3779B97F4A7C15) + found) & ~CLASSES


def word_keys(found: np.ndarray) -> np.ndarray:
    return bits.mix(found ^ np.uint64(0x5851F42D4C957F2D))


def _counted(docs: DataFrame, keys, schema: str, classes: bool = False) -> DataFrame:
    """Distinct keys of each task's buffer with their counts; keys(tokens of some texts) gives an array. Classes in the low bits go above the segment."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        def emit(held):
            key, n = np.unique(np.concatenate(held), return_counts=True)
            segment = bits.segment(key)
            if classes:
                segment |= (key & CLASSES).astype(np.int32) << 12
                key &= ~CLASSES
            for at in range(0, len(key), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(segment[part]), pa.array(key[part].view(np.int64)), pa.array(n[part].astype(np.int64))], schema=arrow)

        held, some, size, new = [], [], 0, 0
        try:
            for batch in batches:
                for text in batch.column(0):
                    some.append(tokens(text.as_py()))
                    new += len(some[-1])
                    if new > TOGETHER:
                        held.append(keys(some))
                        some, size, new = [], size + new, 0
                        if size > BUFFER:
                            yield from emit(held)
                            held, size = [], 0
            if some:
                held.append(keys(some))
            if held:
                yield from emit(held)
        finally:
            del held, some
            let_go()

    smaller_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, schema)


def means(q: np.ndarray) -> np.ndarray:
    """The mean count of each level: of 2^(q-1) to 2^q - 1."""
    q = q.astype(np.int64)
    return np.where(q > 0, (3 * 2.0 ** (q - 1) - 1) / 2, 0.0)


def level_of(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return (np.floor(np.log2(np.maximum(n, 1))) + 1).astype(np.uint8)


def _levels(docs: DataFrame, counts: DataFrame, top: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, np.ndarray]:
    """segment, key, levels of each stored word and pair (written, as the filter's size comes from the number of entries); and for each level of a first word
    the share of its occurrences that are in stored pairs. The level is exact for the most frequent words, and one class holds all others."""
    spark = docs.sparkSession
    schema = "segment int, key long, n long"
    texts = docs.count()
    # words enter the filter under their own kind of key; the beginning counts once for each text
    begin = spark.createDataFrame([(int(BEGIN.view(np.int64)), texts)], "key long, n long").where("n > 0")

    def make():
        def run(batch):
            keys = word_keys(np.array(batch["key"], np.int64).view(np.uint64))
            return {"segment": bits.segment(keys), "key": keys.view(np.int64), "n": batch["n"]}

        return run

    singles = map_rows(counts.unionByName(begin).select("key", "n"), make, schema)
    shared = spark.sparkContext.broadcast((top[0], level_of(top[1]), level_of(np.array([texts]))[0]))

    def pairs_of(some):
        keys, levels, first = shared.value
        sizes = np.array([len(x) for x in some])
        starts, found = np.cumsum(sizes) - sizes, np.concatenate(some)
        distinct, which = np.unique(found, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
        kind = np.roll((np.where(keys[at] == distinct, levels[at], 0) if len(keys) else np.zeros(len(distinct), np.uint8))[which], 1)
        kind[starts] = first
        return pair_keys(found, starts) | kind.astype(np.uint64)

    # one shuffle by segment and class, then each task sums its own keys
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = _counted(docs, pairs_of, schema, classes=True).repartition(parts, "segment").groupBy("segment", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAIR)
    stored = stash(pairs.withColumn("kind", F.shiftright("segment", 12)).unionByName(singles.withColumn("kind", F.lit(-1))), "ngrams")
    kept = {r["kind"]: r["n"] for r in stored.where("kind >= 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # one row a level
    least = int(top[1].min(initial=1 << 62))
    level = F.length(F.bin("n"))  # the number of binary digits
    own_level = F.when(F.col("n") >= least, level).otherwise(0)
    before = counts.where(F.col("key") != int(END.view(np.int64))).unionByName(begin.select(*counts.columns))
    every = {r["kind"]: r["n"] for r in before.groupBy(own_level.alias("kind")).agg(F.sum("n").alias("n")).collect()}  # one row a level
    share = np.array([kept.get(q, 0) / every[q] if q in every else 1.0 for q in range(64)])
    share[1 : int(level_of(np.array([least]))[0]) if len(top[1]) else 64] = share[0]
    return stored.select(F.col("segment").bitwiseAND(bits.SEGMENTS - 1).alias("segment"), "key", level.alias("levels")), share


def train(docs: DataFrame) -> dict:
    """From the rows' texts: exact word counts (a written table), N, V, the filter and the arrays of the most frequent words."""
    schema = "segment int, key long, n long"
    raw = _counted(docs, np.concatenate, schema)
    counts = stash(raw.groupBy("key").agg(F.sum("n").alias("n")), "words")
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = row["n"], row["v"]
    # the most frequent words: all with a count that at most TOP_WORDS words reach; no sort of words, and columns instead of rows to the driver
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    reached = sizes.withColumn("reached", F.sum("words").over(Window.orderBy(F.desc("n"))))  # distinct counts: few
    least = reached.where(F.col("reached") <= TOP_WORDS).agg(F.min("n").alias("n")).first()["n"]
    top = counts.where(F.col("n") >= (least or 1 << 62)).select("key", "n").toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    top = keys[order], top.column("n").to_numpy()[order]
    summed, share = _levels(docs, counts, top)
    collect_shuffles(docs.sparkSession)
    size = bits.size_for(summed.agg(F.coalesce(F.sum("levels"), F.lit(0)).alias("n")).first()["n"], PER_ENTRY, 1 << 62)
    dealt = summed.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "segment")
    if size <= MAX_BITS:
        found = bits.build(dealt, size)
        fill = found.fill()
    else:
        found = stash(bits.segments(dealt, size), "filter")
        fill = found.agg(F.coalesce(F.sum("ones"), F.lit(0)).alias("n")).first()["n"] / size
    del dealt
    collect_shuffles(docs.sparkSession)
    return {"counts": counts, "n": total, "v": distinct, "filter": found, "bits": size, "top": top, "share": share, "false_rate": fill**bits.PROBES}


def _log_p(own: np.ndarray, before: np.ndarray, both: np.ndarray, below: float) -> np.ndarray:
    p = (both + PRIOR * (own + 0.5) / below) / (np.maximum(before, both) + PRIOR)
    return np.log10(np.minimum(p, 1.0))


def _answered(asked: DataFrame, model: dict, buckets: int) -> DataFrame:
    """Levels of requested keys. asked: chunk, ord (a bucket), data (keys in order); the same columns come back with a byte for each key."""
    import pyarrow as pa

    size, per = model["bits"], bits.SEGMENTS // buckets

    def run(batches):
        bucket, held = -1, None
        for batch in batches:
            out = [], [], []
            for chunk, o, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if o != bucket:
                    bucket, held = o, bits.Bits(size, o * per, per)
                if chunk < 0:
                    held.put(chunk + bits.SEGMENTS, data)
                    continue
                got = held.levels(np.frombuffer(data, np.uint64)).astype(np.uint8).tobytes()
                for column, x in zip(out, (chunk, o, got), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["chunk", "ord", "data"])

    segment = F.col("segment")
    filters = model["filter"].select((segment - bits.SEGMENTS).cast("long").alias("chunk"), F.floor(segment / per).cast("int").alias("ord"), "data")
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # segments come before the requests of their bucket, so a task holds one bucket and streams requests
    both = filters.unionByName(asked).repartition(parts, "ord").sortWithinPartitions("ord", "chunk")
    return both.mapInArrow(run, "chunk long, ord int, data binary")


def _packed(begin: int, starts: np.ndarray, own: np.ndarray, pair: np.ndarray) -> bytes:
    """Numbers of a chunk, byte by byte and compressed, as they are most of what goes to disk."""
    import pyarrow as pa

    plain = np.concatenate([[begin, len(starts)], starts, own, pair]).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow as pa

    plain = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    x = np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    texts, rest = x[1], x[2 + x[1] :]
    return x[0], x[2 : 2 + texts], rest[: len(rest) // 2], rest[len(rest) // 2 :]


def _finished(asked: DataFrame, model: dict, buckets: int, below: float, schema: str) -> DataFrame:
    """Rows of texts with their score. asked: requests, the chunk's places at ord = buckets, and its texts after that."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, share = to_arrow_schema(T.StructType.fromDDL(schema)), model["share"]

    def run(batches):
        levels, scores = [], None
        for batch in batches:
            order, data, rows, found = batch.column(1).to_numpy(), batch.column(2), np.flatnonzero(batch.column(1).to_numpy() > buckets), []
            for i, o in enumerate(order.tolist()):
                if o < buckets:
                    levels.append(data[i].as_py())
                elif o == buckets:
                    found_levels, levels = np.frombuffer(b"".join(levels), np.uint8), []
                    counts = means(found_levels)
                    first = counts * share[found_levels]
                    begin, starts, own, pair = _unpacked(data[i].as_py())
                    before = np.roll(first[own], 1)
                    before[starts] = first[begin]
                    scores = np.add.reduceat(_log_p(counts[own], before, counts[pair], below), starts)
                else:
                    found.append(scores[o - buckets - 1])
            texts = batch.take(pa.array(rows))
            columns = [pa.array(found, pa.float64()) if f.name == "score" else texts.column(texts.schema.get_field_index(f.name)).cast(f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    answers = _answered(asked.where(F.col("ord") < buckets).select("chunk", "ord", "data"), model, buckets)
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = answers.unionByName(asked.where(F.col("ord") >= buckets), allowMissingColumns=True).repartition(parts, "chunk").sortWithinPartitions("chunk", "ord")
    return both.mapInArrow(run, schema)


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, n_known, train_tokens, base_score, score."""
    id_type = docs.schema[id_col].dataType.simpleString()
    total, distinct, share = model["n"], model["v"], model["share"]
    below = total + 0.5 * (distinct + 1)
    whole = isinstance(model["filter"], bits.Bits)
    buckets = min(bits.SEGMENTS, max(BUCKETS, 1 << (model["bits"] >> 23).bit_length()))  # powers of two; from 2 GB of filter on, a bucket is a segment
    shared = docs.sparkSession.sparkContext.broadcast((model["filter"] if whole else None, *model["top"]))  # bounded by MAX_BITS and TOP_WORDS

    def make():
        held, keys, counts = shared.value
        number = count(TaskContext.get().partitionId() << 32)

        def run(batch):
            # all texts of a batch as one array; each distinct token and pair is looked up once
            texts = [tokens(t) for t in batch["text"]]
            sizes = np.array([len(t) for t in texts])
            starts = np.cumsum(sizes) - sizes
            found = np.concatenate(texts)
            distinct, which = np.unique(found, return_inverse=True)
            at = np.searchsorted(keys, distinct)
            ok = at < len(keys)
            ok[ok] = keys[at[ok]] == distinct[ok]
            base = np.zeros(len(distinct))
            base[ok] = np.log10((counts[at[ok]] + 0.5) / below)
            ok = ok[which]
            rare = [np.unique(t[~o], return_counts=True) for t, o in zip(texts, np.split(ok, starts[1:]), strict=True)]
            out = {
                "id": batch["id"],
                "n_tokens": sizes,
                "known": np.add.reduceat(ok.astype(np.int64), starts),
                "base": np.add.reduceat(base[which], starts),
                "rare": [r.view(np.int64) for r, _ in rare],
                "times": [n for _, n in rare],
            }
            if held is None:
                return asks(out, distinct, which, found, starts)
            levels = held.levels(word_keys(np.append(distinct, BEGIN)))
            own, first = means(levels)[:-1][which], means(levels) * share[levels]
            before = np.roll(first[:-1][which], 1)
            before[starts] = first[-1]
            pair, pairs_at = np.unique(pair_keys(found, starts), return_inverse=True)
            both = means(held.levels(pair))[pairs_at]
            return out | {"score": np.add.reduceat(_log_p(own, before, both, below), starts)}

        def asks(out, distinct, which, found, starts):
            """A request for each bucket, then the places of all words and pairs among the requested keys, then the texts."""
            keys, at = np.unique(np.concatenate([word_keys(np.append(distinct, BEGIN)), pair_keys(found, starts)]), return_inverse=True)
            own, begin, pair = at[: len(distinct)][which], at[len(distinct)], at[len(distinct) + 1 :]
            bucket = bits.segment(keys) // (bits.SEGMENTS // buckets)
            some, first = np.unique(bucket, return_index=True)
            n, m = len(some), len(starts)
            rows = {c: [*[None] * (n + 1), *x] for c, x in out.items()}
            rows["chunk"] = [next(number)] * (n + 1 + m)
            rows["ord"] = [*some.tolist(), *range(buckets, buckets + 1 + m)]
            rows["data"] = [*(x.tobytes() for x in np.split(keys, first[1:])), _packed(begin, starts, own, pair), *[None] * m]
            return rows

        return run

    schema = f"id {id_type}, n_tokens long, known long, base double, score double, rare array<long>, times array<long>"
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if whole:
        parts = stash(map_rows(texts, make, schema).withColumn("tag", F.monotonically_increasing_id()), "scored")
    else:
        form = f"chunk long, ord int, data binary, {schema.replace(' score double,', '')}"
        done = []
        for i in range(PARTS):
            asked = stash(map_rows(texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(PARTS)) == i), make, form), "asked")
            found = _finished(asked, model, buckets, below, schema).withColumn("tag", F.monotonically_increasing_id() + F.lit(i << 60))
            done.append(stash(found, "scored"))
            del found
            unstash(asked)
            collect_shuffles(docs.sparkSession)
        parts = reduce(DataFrame.unionByName, done)
    rest = parts.select("tag", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("tag", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    rest = rest.join(model["counts"], "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = rest.groupBy("tag").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(below))).alias("more_base"),
    )
    return parts.drop("rare", "times").join(more, "tag", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def held_out_split() -> F.Column:
    """The fixed fold of this operator: rows whose crc32 of the id modulo 5 is 1 are not learned from."""
    return crc_mod("doc_id", 5) == 1
