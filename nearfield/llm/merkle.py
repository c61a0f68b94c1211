"""A Merkle manifest of a table: a hash for each row, a tree of hashes for each group, one root, and a proof for each row.

A row's leaf is the hash of its fields, each as its length in bytes, a colon and its value, a null as a dash. The leaves of a group ascend by id; eight
consecutive nodes make the next one up. The place of a leaf comes from histograms of id digits (`ranks`), so nothing is sorted as a whole, and the digits of the place
to the base 8 are the leaf's key in a trie: nodes with a common prefix have a common ancestor. Three levels are reduced at a time: the rows whose places agree in all but
the last three digits form one block of 512 at most, the blocks' own nodes are dealt to blocks by their next three digits, and so on, until each group has one node.
The groups' nodes are the leaves of the last tree. Proofs come down the same blocks: each block adds its levels to what the block above it has found.

Texts are read once, for the leaves; all that is shuffled are ids and hashes.

Defined results: a null id comes before all others and a null group before all others. Rows with one id are placed by their leaves; equal rows are alike, but may
lie in different blocks and so have different proofs. A leaf alone in its group is the group's subroot. An empty table has no nodes and no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stash
from .ranks import ranks

#: Children of a node, and levels of a block.
FAN, LEVELS = 8, 3
STEP = "struct<left:string,right:string>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[Column]) -> Column:
    """The hash of values: each as its UTF-8 byte count, a colon and the value, nulls as a dash."""
    said = (F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts)
    return F.sha2(F.concat(*said).cast("binary"), 256)


def leaves(rows: DataFrame, *, fields=FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """Written table with id, g (the group, 0 for null or 1 and its text), leaf and, where `tampered` holds, alt: the leaf of the row with its text in lower case (A-Z)."""
    column = {f: F.col(f"`{f}`") for f in fields}
    changed = column | {text_col: F.translate(column[text_col], UPPER, LOWER)}
    alt = F.when(tampered, digest([*changed.values()])) if tampered is not None else F.lit(None)
    group = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group_col}`").cast("string")), F.lit("0"))
    made = rows.select(F.col(f"`{id_col}`").alias("id"), group.alias("g"), F.unhex(digest([*column.values()])).alias("leaf"), F.unhex(alt.cast("string")).alias("alt"))
    head = F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")
    return stash(made.withColumn("head", head).withColumn("tag", F.monotonically_increasing_id()), "leaves")


def _up(nodes: Column) -> Column:
    """The next level of an array of hashes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), "").cast("binary"), 256))


def _siblings(level: Column, place: Column, digit: int) -> Column:
    """What stands to the left and right of the node of `place` in its run, `digit` levels above the block's leaves."""
    at = F.shiftright(place, 3 * digit)
    first, own = F.shiftright(at, 3) * FAN, at.bitwiseAND(F.lit(FAN - 1))
    join = lambda start, n: F.array_join(F.slice(level, start + 1, n), "")
    return F.struct(join(first, own).alias("left"), join(first + own + 1, FAN - 1 - own).alias("right"))


def _depth(n: Column) -> Column:
    """Levels of a block in a group of n nodes: until one is left, three at most."""
    out = F.lit(LEVELS)
    for i in reversed(range(LEVELS)):
        out = F.when(n <= FAN**i, i).otherwise(out)
    return out


def _blocks(nodes: DataFrame, hashes: Column, *carried: str) -> DataFrame:
    """nodes: g, place, n. One row for each block: g, block, n, rows (in order of place, with the carried columns), l0 to l3 and top."""
    row = F.struct("place", *carried)
    made = nodes.groupBy("g", F.shiftright("place", 3 * LEVELS).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.first("n").alias("n"))
    made = made.withColumn("depth", _depth(F.col("n"))).withColumn("l0", hashes)
    for i in range(LEVELS):
        made = made.withColumn(f"l{i + 1}", F.when(F.col("depth") > i, _up(F.col(f"l{i}"))))
    return made.withColumn("top", F.element_at(F.coalesce(*(F.col(f"l{i}") for i in reversed(range(LEVELS + 1)))), 1))


def _path(place: Column) -> Column:
    """array<STEP> of a place in its block, then what lies above the block."""
    within = place.bitwiseAND(F.lit(FAN**LEVELS - 1))
    own = F.array(*(F.when(F.col("depth") > i, _siblings(F.col(f"l{i}"), within, i)) for i in range(LEVELS)))
    return F.concat(F.filter(own, lambda s: s.isNotNull()), F.col("above"))


def _tree(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """nodes: g, place, n, h. The written blocks of all tiers, lowest first, and one row for each g: g and root. Every g stays until it has one node."""
    tiers, roots = [], []
    while True:
        blocks = stash(_blocks(nodes, F.transform("rows", lambda r: r["h"]), "h").drop("rows"), "tier")
        tiers.append(blocks)
        roots.append(blocks.where(F.col("n") <= FAN**LEVELS).select("g", F.col("top").alias("root")))
        more = blocks.where(F.col("n") > FAN**LEVELS)
        if not more.limit(1).count():
            break
        nodes = more.select("g", F.col("block").alias("place"), F.ceil(F.col("n") / FAN**LEVELS).alias("n"), F.col("top").alias("h"))
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return found, tiers


def _paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """above: g, subroot and the path over it, one row each. For each node under the lowest tier: g, place, subroot and its path, from the highest tier down."""
    below = None
    for blocks in reversed(tiers):
        met = blocks.where(F.col("n") <= FAN**LEVELS).join(above, "g")  # one block for each g
        if below is not None:
            lower = blocks.where(F.col("n") > FAN**LEVELS).join(below.withColumnsRenamed({"place": "block", "path": "above"}), ["g", "block"])
            met = met.unionByName(lower)
        steps = F.transform("l0", lambda _, i: F.struct((F.col("block") * FAN**LEVELS + i).alias("place"), _path(i).alias("path")))
        below = met.select("g", "subroot", F.explode(steps).alias("s")).select("g", "subroot", "s.place", "s.path")
    return below


def _ordered(groups: DataFrame) -> DataFrame:
    """groups: g, subroot, one row each. Adds place in bytewise order and n, by ranges that are sorted apart."""
    parts = groups.repartitionByRange("g").withColumn("part", F.spark_partition_id())
    parts = stash(parts, "groups")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c"))  # one row for each range
    counts = counts.withColumn("first", F.sum("c").over(Window.orderBy("part")) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy()))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(counts), "part").select("g", "subroot", (F.col("first") + F.col("inside")).alias("place"), "n")


def manifest(rows: DataFrame, *, fields=FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """One row for each input row: the id, leaf, subroot, root, path (what stands left and right of it, level by level), and alt: its tampered leaf or null."""
    if rows.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer")
    given = leaves(rows, fields=fields, id_col=id_col, group_col=group_col, text_col=text_col, tampered=tampered)
    placed = ranks(given, "g", ["id", "head", "tag"], out="place", total="n")
    hexed = F.transform("rows", lambda r: F.lower(F.hex(r["leaf"])))
    bottom = stash(_blocks(placed, hexed, "id", "leaf", "alt").drop("l0"), "blocks")
    alone = F.col("n") <= FAN**LEVELS
    nodes = bottom.where(~alone).select("g", F.col("block").alias("place"), F.ceil(F.col("n") / FAN**LEVELS).alias("n"), F.col("top").alias("h"))
    subroots, tiers = bottom.where(alone).select("g", F.col("top").alias("subroot")), []
    if nodes.limit(1).count():
        high, tiers = _tree(nodes)
        subroots = subroots.unionByName(high.withColumnRenamed("root", "subroot"))
    groups = stash(_ordered(subroots), "subroots")
    root, crown = _tree(groups.select(F.lit("").alias("g"), "place", "n", F.col("subroot").alias("h")))
    nothing = F.array().cast(f"array<{STEP}>")
    over = _paths(crown, root.select("g", F.col("root").alias("subroot"), nothing.alias("above")))
    over = over.select("place", F.col("subroot").alias("root"), F.col("path").alias("above"))
    over = stash(groups.join(over, "place").select("g", "subroot", "root", "above"), "over")
    # what lies above each block of rows; the root is one row
    whole = over.select("root").distinct()
    above = bottom.where(alone).select("g", "block").join(over.select("g", "subroot", "above"), "g")
    if tiers:
        below = _paths(tiers, over.select("g", "subroot", "above")).withColumnsRenamed({"place": "block", "path": "above"})
        above = above.unionByName(below.select("g", "block", "subroot", "above"))
    found = bottom.join(above, ["g", "block"]).crossJoin(F.broadcast(whole)).withColumn("l0", hexed)
    each = F.transform("rows", lambda r, i: F.struct(r["id"].alias("id"), F.lower(F.hex(r["leaf"])).alias("leaf"), F.lower(F.hex(r["alt"])).alias("alt"), _path(i).alias("path")))
    return found.select("subroot", "root", F.explode(each).alias("r")).select(F.col("r.id").alias(id_col), "r.leaf", "subroot", "root", "r.path", "r.alt")


def proof(path: Column) -> Column:
    """The hash of all siblings, from the leaf's run up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))
