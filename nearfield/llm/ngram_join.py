"""Self-join of documents by the Jaccard similarity of their word shingles, through a MinHash LSH forest.

Signatures. A text is the set of its 5-word shingles; texts with equal sets are one representative with a number of copies from here on.
Forest. A representative has TREES sorted tries; its path in a trie is a row of min-hashes, kept as one number whose leading bits are the shorter prefixes,
so numbers sort as paths do. Two texts meet in a trie where their paths share a prefix. The longest prefix in use is shortened level by level until texts at
the threshold meet somewhere with the target recall, 1 - (1 - threshold^depth)^TREES. From there each matched prefix is shortened on, up to SHORTER levels,
as long as the texts below it fit a block: sparse parts of a trie are searched with short prefixes, dense ones with longer ones, and none misses the target.
Prefixes with one text are dropped by a Bloom filter of bounded size before anything is shuffled.
Candidates. The texts of a node are compared by 2-bit signatures, in blocks and pairs of blocks, and each block gives stars that span its likely
links (4.5 standard errors below the threshold), never all pairs. Connected components of these stars are the candidate groups.
Verification. Shingle sets, read once for texts in groups, are intersected exactly, again in blocks and pairs of blocks: every pair of different texts in a
group is decided. Tasks return counts of links and stars that span the true links, whose components are the classes.

Rows of a hot key are attached by broadcast (a bounded number of keys hold more than a given share each) and all others by sort-merge joins.

Defined results: words are runs without white space, lower-cased A-Z. Texts of one to four words are a single shingle of all words. Null and empty texts
have no shingles, link to nothing and are classes of their own. A null id counts as larger than any. Repeated rows are copies: they link to each other.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits
from .common import attach, hashed, keyed, let_go, map_rows, row_key, smaller_batches, stash, unstash, words

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 10
#: Levels by which a matched prefix may be shorter than the longest one; each takes 8 bits of a path's number.
SHORTER = 2
RECALL = 0.999
#: Texts of a block: of a trie node, of a candidate group.
NODE_BLOCK = 512
GROUP_BLOCK = 192
MAX_BITS = 1 << 27
SLACK = 4.5


def depth_for(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, longest: int = DEPTH) -> int:
    """Shortens the matched prefix until the recall at the threshold reaches the target."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    h = hashed(words(text), True)
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        out = (out + h[j : len(h) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(bits.mix(out + np.uint64(size)))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-hashes of a set that isn't empty."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024, None] * a + b).min(0), out=out)
    return out


def tree_paths(sig: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """A number for each tree: a hash of the shortest prefix, then 8 bits for each of the `levels` below it."""
    levels = min(SHORTER, depth - 1)
    keys = np.arange(1, trees + 1, dtype=np.uint64)
    out = np.zeros(trees, np.uint64)
    for n, level in enumerate(sig.reshape(trees, depth).T.astype(np.uint64), 1):
        keys = bits.mix(keys * np.uint64(0x9E3779B97F4A7C15) + level)
        left = 8 * (depth - n)
        if n == depth - levels:
            out = keys >> np.uint64(left) << np.uint64(left)
        elif n > depth - levels:
            out |= keys >> np.uint64(56) << np.uint64(left)
    return out


def mask(levels: int) -> int:
    """For a path's number: clears so many of the last levels (as a signed number)."""
    return -(1 << 8 * levels)


def two_bits(sig: np.ndarray) -> bytes:
    """The two best mixed bits of each min-hash, packed in 64-bit words."""
    two = (sig * np.uint32(0x9E3779B1) >> np.uint32(30)).astype(np.uint64)
    two = np.concatenate((two, np.zeros(-len(two) % 32, np.uint64))).reshape(-1, 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(1, dtype=np.uint64).tobytes()


def stars_of(linked: np.ndarray, names: list[bytes]) -> list[tuple[bytes, bytes]]:
    """For each component of a symmetric matrix an edge from its smallest name to every other one."""
    left, out = np.ones(len(linked), bool), []
    for root in sorted(range(len(linked)), key=names.__getitem__):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            new = np.flatnonzero(linked[queue.pop()] & left).tolist()
            left[new] = False
            out += [(names[root], names[x]) for x in new]
            queue += new
    return out


def _sorted_groups(batches, key: list[str]):
    """Groups of a stream sorted by key, as dicts of lists; a group may go over several batches."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        keys = [*zip(*(columns[k] for k in key), strict=True)]
        start = 0
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[start]:
                if keys[start] != now and held:
                    yield now, held
                    held = {}
                now = keys[start]
                for n, values in columns.items():
                    held.setdefault(n, []).extend(values[start:at])
                start = at
    if held:
        yield now, held


def _by_group(df: DataFrame, key: list[str], fn, schema: str) -> DataFrame:
    """fn(key, lists by column) gives lists by column for each group. Groups are bounded by their blocks."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        out: dict[str, list] = {f.name: [] for f in arrow}
        try:
            for k, rows in _sorted_groups(batches, key):
                for n, values in fn(k, rows).items():
                    out[n].extend(values)
                if len(out[arrow[0].name]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                    out = {f.name: [] for f in arrow}
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            del out
            let_go()

    smaller_batches(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _in_blocks(df: DataFrame, size: F.Column, member: str, block: int) -> DataFrame:
    """Adds x and y: a row of block i of n goes to the pairs (i, j) with any j. One block makes one copy."""
    n = F.greatest(F.lit(1), F.ceil(size / block).cast("int"))
    own = df.withColumn("own", F.pmod(F.xxhash64(member), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return own.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. Returns node and root, the smallest node of its component; nodes without edges don't occur. Each round every node goes to its
    smallest neighbour, and edges are contracted to those between different ones, so rounds get smaller."""
    left = stash(edges.where("u <> v").select("u", "v").distinct(), "edges")
    now = stash(left.select(F.col("u").alias("node")).union(left.select("v")).distinct().withColumn("root", F.col("node")), "roots")
    while left.limit(1).count():
        both = left.select(F.col("u").alias("at"), F.col("v").alias("near")).union(left.select("v", "u"))
        to = both.groupBy("at").agg(F.least(F.min("near"), F.col("at")).alias("to"))
        to = stash(to, "steps")
        # one more step along the pointers: each leads to a smaller or the same node
        jump = to.select(F.col("at").alias("to"), F.col("to").alias("next"))
        far = stash(to.join(jump, "to").select("at", F.col("next").alias("to")), "steps")
        new_left = left.join(far.select(F.col("at").alias("u"), F.col("to").alias("tu")), "u").join(far.select(F.col("at").alias("v"), F.col("to").alias("tv")), "v")
        new_left = stash(new_left.where("tu <> tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct(), "edges")
        new_now = stash(now.join(far.withColumnRenamed("at", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        for old in (left, now, to, far):
            unstash(old)
        left, now = new_left, new_now
    unstash(left)
    return now.select("node", "root")


class Join:
    """The steps' results: `rows` (_key, id, g), `groups` (g, copies, first, root, class fields)."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL):
        self.threshold, self.trees, self.id_col = threshold, trees, id_col
        self.depth = depth_for(threshold, trees, recall)
        self.id_type = docs.schema[id_col].dataType.simpleString()
        self.keyed = keyed(docs, id_col, text_col)
        self.rows = self._features()
        self.groups = stash(self._grouped(), "groups")

    def _features(self) -> DataFrame:
        trees, depth = self.trees, self.depth

        def make():
            a, b = _functions(trees * depth)

            def run(batch):
                out = {c: [] for c in ("_key", "id", "g", "paths", "sig")}
                for key, i, text in zip(batch["_key"], batch["_id"], batch["_text"], strict=True):
                    found = shingles(text)
                    out["_key"].append(key)
                    out["id"].append(i)
                    # sets are compared by 128 bits; a text without shingles is a group for itself
                    out["g"].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else b"\x00" + key)
                    sig = signature(found, a, b) if len(found) else None
                    out["paths"].append(None if sig is None else tree_paths(sig, trees, depth).view(np.int64))
                    out["sig"].append(None if sig is None else two_bits(sig))
                return out

            return run

        return stash(map_rows(self.keyed, make, f"_key binary, id {self.id_type}, g binary, paths array<long>, sig binary"), "features")

    def _candidates(self, reps: DataFrame) -> DataFrame:
        """Edges u, v of stars that span the likely links."""
        spark = reps.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

        levels = min(SHORTER, self.depth - 1)
        top = np.uint64(mask(levels) & 0xFFFFFFFFFFFFFFFF)

        def make_keys():
            def run(batch):
                keys = np.array([k for ks in batch["paths"] for k in ks], np.int64).view(np.uint64) & top
                return {"segment": bits.segment(keys), "key": keys.view(np.int64)}

            return run

        nodes = map_rows(reps.select("paths"), make_keys, "segment int, key long").groupBy("segment", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        nodes = stash(nodes.select("segment", "key", F.lit(1).alias("levels")), "nodes")
        may = spark.sparkContext.broadcast(bits.build(nodes.repartition(parts, "segment"), bits.size_for(nodes.count(), 12, MAX_BITS)))

        def make_members():
            def run(batch):
                out = {c: [] for c in ("path", "g", "sig")}
                for g, sig, paths in zip(batch["g"], batch["sig"], batch["paths"], strict=True):
                    paths = np.array(paths, np.int64)
                    for k in paths[may.value.has(paths.view(np.uint64) & top)].tolist():
                        out["path"].append(k)
                        out["g"].append(g)
                        out["sig"].append(sig)
                return out

            return run

        members = stash(map_rows(reps.select("g", "sig", "paths"), make_members, "path long, g binary, sig binary"), "paths")
        # texts below each prefix; a path's node is the shortest prefix that fits a block, or else the whole path
        own = members.groupBy("path").agg(F.count(F.lit(1)).alias("copies"))
        chosen, size, node = own, F.col("copies"), F.col("path")
        for level in range(1, levels + 1):
            prefix = F.col("path").bitwiseAND(F.lit(mask(level)))
            found = own.groupBy(prefix.alias(f"p{level}")).agg(F.sum("copies").alias(f"n{level}"))
            chosen = chosen.withColumn(f"p{level}", prefix).join(found, f"p{level}")
            fits = F.col(f"n{level}") <= NODE_BLOCK
            size, node = F.when(fits, F.col(f"n{level}")).otherwise(size), F.when(fits, F.col(f"p{level}")).otherwise(node)
        chosen = stash(chosen.select("path", "copies", node.alias("node"), size.alias("size")).where("size > 1"), "chosen")
        placed = _in_blocks(attach(members, chosen, "path", "copies"), F.col("size"), "g", NODE_BLOCK)
        count = self.trees * self.depth
        p = self.threshold + (1 - self.threshold) / 4
        least = count * p - SLACK * math.sqrt(count * p * (1 - p))
        pairs_mask = np.uint64(0x5555555555555555)

        def link(key, rows):
            if len(rows["g"]) < 2:
                return {"u": [], "v": []}
            sig = np.array([np.frombuffer(s, np.uint64) for s in rows["sig"]])
            differ = np.zeros((len(sig), len(sig)), np.int64)
            for w in range(sig.shape[1]):
                x = sig[:, None, w] ^ sig[None, :, w]
                differ += np.bitwise_count((x | x >> np.uint64(1)) & pairs_mask)
            linked = count - differ >= least
            edges = stars_of(linked, rows["g"])
            return {"u": [u for u, _ in edges], "v": [v for _, v in edges]}

        return _by_group(placed.select("node", "x", "y", "g", "sig"), ["node", "x", "y"], link, "u binary, v binary").distinct()

    def _verified(self, members: DataFrame) -> DataFrame:
        """members: g, _key, copies, root, size. Rows u, v, links: edges of stars (links null), and each text's links in a block."""
        spark = members.sparkSession
        wanted = map_rows(members.select("_key"), lambda: lambda b: _first_words(b["_key"]), "segment int, key long")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        may = spark.sparkContext.broadcast(bits.build(wanted.withColumn("levels", F.lit(1)).repartition(parts, "segment"), bits.size_for(members.count(), 12, MAX_BITS)))

        def make_sets():
            def run(batch):
                ok = may.value.has(np.array([int.from_bytes(k[:8], "little") for k in batch["_key"]], np.uint64))
                some = [(k, t) for k, t, o in zip(batch["_key"], batch["_text"], ok.tolist(), strict=True) if o]
                return {"_key": [k for k, _ in some], "found": [shingles(t).tobytes() for _, t in some]}

            return run

        sets = map_rows(self.keyed.select("_key", "_text"), make_sets, "_key binary, found binary")
        sets = sets.groupBy("_key").agg(F.first("found").alias("found"))  # repeated rows
        placed = _in_blocks(members.join(sets, "_key"), F.col("size"), "g", GROUP_BLOCK)
        threshold = self.threshold

        def verify(key, rows):
            g, copies, own = rows["g"], np.array(rows["copies"]), np.array(rows["own"])
            sets = [np.frombuffer(f, np.uint64) for f in rows["found"]]
            sizes = np.array([len(s) for s in sets])
            both = _intersections(sets)
            similar = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            np.fill_diagonal(similar, False)
            if key[1] != key[2]:  # pairs within a block are decided where it meets itself
                similar &= own[:, None] != own[None, :]
            links = similar @ copies
            edges = stars_of(similar, g)
            return {
                "u": [u for u, _ in edges] + g,
                "v": [v for _, v in edges] + [None] * len(g),
                "links": [None] * len(edges) + links.tolist(),
            }

        return _by_group(placed.select("root", "x", "y", "g", "own", "copies", "found"), ["root", "x", "y"], verify, "u binary, v binary, links long")

    def _grouped(self) -> DataFrame:
        # null ids sort last
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key"))
        reps = stash(self.rows.groupBy("g").agg(F.count(F.lit(1)).alias("copies"), first.alias("first"), F.first("paths").alias("paths"), F.first("sig").alias("sig")), "reps")
        base = reps.select("g", "copies", F.col("first.id").alias("id"), F.col("first._key").alias("_key"))
        roots = components(self._candidates(reps.where("paths is not null")))
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        members = stash(base.join(roots.withColumnRenamed("node", "g"), "g").join(sizes, "root"), "members")
        found = stash(self._verified(members), "links")
        classes = components(found.where("v is not null").select("u", "v")).select(F.col("node").alias("g"), F.col("root").alias("class"))
        links = found.where("v is null").groupBy(F.col("u").alias("g")).agg(F.sum("links").alias("links"))
        empty = F.length("g") > 16
        whole = base.join(classes, "g", "left").join(links, "g", "left").select(
            "g",
            "copies",
            "id",
            "_key",
            F.coalesce("class", "g").alias("class"),
            (F.coalesce("links", F.lit(0)) + F.when(empty, 0).otherwise(F.col("copies") - 1)).alias("n_links"),
        )
        whole = stash(whole, "whole")
        leader = whole.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key")).alias("leader"), F.sum("copies").alias("class_size"))
        return whole.join(leader, "class").select("g", "copies", F.col("leader.id").alias("class_id"), F.col("leader._key").alias("leader"), "class_size", "n_links")

    def classes(self) -> DataFrame:
        """Per row: the id, class_id (the smallest id of its class), class_size (rows), n_links (rows it is similar to)."""
        rows = attach(self.rows.select("g", "id"), self.groups.drop("leader"), "g", "copies")
        return rows.select(F.col("id").alias(self.id_col), "class_id", "class_size", "n_links")

    def filter(self, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
        """docs, one row of each class: that with the smallest id; of repeated rows with that id and text, the one whose columns hash least. docs must be
        the table that was joined."""
        leaders = self.groups.select(F.col("leader").alias("key")).distinct()
        whole = [F.col(f"`{c}`") for c in docs.columns]
        rows = docs.select(row_key(self.id_col, text_col).alias("key"), F.xxhash64(*whole).alias("tie"), F.struct(*whole).alias("row"))
        return rows.join(leaders, "key", "left_semi").groupBy("key").agg(F.min_by("row", "tie").alias("row")).select("row.*")


def _first_words(keys: list[bytes]) -> dict[str, list]:
    found = np.array([int.from_bytes(k[:8], "little") for k in keys], np.uint64)
    return {"segment": bits.segment(found), "key": found.view(np.int64)}


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, through products of 0/1 matrices in slices of columns."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    out = np.diag(sizes).astype(np.int64)
    if n == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = count > 1  # a shingle of one text is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    total = np.zeros((n, n), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 4096):
        low, high = np.searchsorted(column, [at, at + 4096])
        dense = np.zeros((n, 4096), np.float32)
        dense[row[low:high], column[low:high] - at] = 1
        total += dense @ dense.T
    out = np.rint(total).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out
