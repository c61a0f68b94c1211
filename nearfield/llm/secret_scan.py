"""Secrets in texts, judged by who owns them: column functions, aggregations and joins alone.

Candidates are the matches of three base patterns (an assignment to a telling name, an access key, a run of hex digits) and, wherever these find nothing, runs of
12 characters or more that hold a digit. Every candidate's value is hashed, and over the whole corpus the distinct repositories and owners of each hash are counted, with
partial sums before each shuffle. A value of more than MOST_OWNERS owners is an example that people copy; one that stays with its owners, looks random, has
a letter and is no placeholder is taken for a live credential. Base matches always stay. A run is added if its value is live and it has a vendor's
format (`vendor`), was assigned or used as a key elsewhere in the corpus (`known`), or mixes digits and both cases at high entropy (`opaque`).

Texts are read once; hashes and places are what is shuffled. The counts of a hash that many rows share are attached by broadcast (`attach`).

Defined results: null texts count as empty and have no spans. Positions are code points, ends exclusive. Repeated rows are judged row by row, but count as one repository.
A null owner is an owner of its own, a null repository one of each owner. Added spans touch no base span and no added span before them. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, stash
from .spans import let, matches

#: The base patterns and the fewest characters of each (of the value for assign).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]{16,}", 16),  # the runs of 16 and more: a shorter run is passed over as a whole
}
RUN = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{12,}+"
ADDED = ("vendor", "known", "opaque")
KINDS = (*BASE, *ADDED)
#: Formats that vendors publish.
VENDOR = r"^(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[rs]k_live_|sk-|AIza|ya29\.|SG\.|npm_|pypi-|eyJ)[A-Za-z0-9_.=-]{16,}$"
#: What people write in place of a secret.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|\.\.\.|0123456789|1234567890|abcdefgh|(.)\1{5}"
MOST_OWNERS = 2
#: Bits a character at least, for a value that looks random and for an opaque run; fewest characters of the latter.
RANDOM, OPAQUE, OPAQUE_LONG = 2.5, 3.5, 20
SPAN = "struct<start:int,kind:int,end:int,hash:binary,looks:boolean,opaque:boolean,vendor:boolean>"


def entropy(value: Column) -> Column:
    """Bits a character."""
    n = F.char_length(value).cast("double")
    share = lambda c: (n - F.char_length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c))))


def _long(least: int):
    return lambda m: F.char_length(m["value"]) >= least


def candidates(text: Column) -> Column:
    """array<SPAN> of base matches and, with kind null, of runs; in no order."""

    def made(kind: int | None):
        def judged(m: Column, value: Column, bits: Column) -> Column:
            mixed = reduce(and_, (F.rlike(value, F.lit(p)) for p in ("[0-9]", "[a-z]", "[A-Z]")))
            return F.struct(
                m["start"].alias("start"), F.lit(kind).cast("int").alias("kind"), m["end"].alias("end"), F.substring(F.unhex(F.sha2(value.cast("binary"), 256)), 1, 16).alias("hash"),
                ((bits >= RANDOM) & F.rlike(value, F.lit("[A-Za-z]")) & ~F.rlike(value, F.lit(PLACEHOLDER))).alias("looks"),
                (mixed & (F.char_length(value) >= OPAQUE_LONG) & (bits >= OPAQUE)).alias("opaque"), F.rlike(value, F.lit(VENDOR)).alias("vendor"),
            )

        return lambda m: let(F.regexp_replace(m["value"], r"[.=]++$", ""), lambda value: let(entropy(value), lambda bits: judged(m, value, bits)))

    parts = []
    for i, (kind, (pattern, least)) in enumerate(BASE.items()):
        found = matches(text, pattern, group=2 if kind == "assign" else 0, has=F.contains(text, F.lit("AKIA")) if kind == "access" else None)
        parts.append(F.transform(F.filter(found, _long(least)), made(i)))
    parts.append(F.transform(matches(text, RUN), made(None)))
    return F.concat(*(p.cast(f"array<{SPAN}>") for p in parts))


def owners(found: DataFrame) -> DataFrame:
    """found: hash, kind, repo, owner, one row a candidate. Written table of hash, rows, repos, owners and assigned (whether any was assigned or an access key)."""
    told = F.max(F.coalesce(F.col("kind") < 2, F.lit(False)))
    each = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("rows"), told.alias("assigned"))
    each = each.groupBy("hash", "owner").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("repos"), F.max("assigned").alias("assigned"))
    return stash(each.groupBy("hash").agg(F.sum("rows").alias("rows"), F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"), F.max("assigned").alias("assigned")), "owners")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """The id and `spans`: array<struct<start, kind, end, repos, owners, copied, live>>, in order of start, then kind."""
    name = lambda c: F.coalesce(F.concat(F.lit("1"), F.col(f"`{c}`").cast("string")), F.lit("0"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(name(owner_col)).alias("owner"), F.xxhash64(name(repo_col)).alias("repo"), candidates(text).alias("found"))
    rows = stash(rows.withColumn("tag", F.monotonically_increasing_id()), "secrets")
    each = rows.select("tag", "id", "owner", "repo", F.explode("found").alias("s")).select("tag", "id", "owner", "repo", "s.*")
    # runs count where no base match lies: what stands before and after within the text
    order, back = (F.col("start").asc(), F.col("kind").asc_nulls_last()), (F.col("start").desc(), F.col("kind").desc_nulls_first())
    base, before = F.col("kind").isNotNull(), (Window.unboundedPreceding, -1)  # running frames: a frame that is unbounded behind is made anew for each row
    passed = F.max("end").over(Window.partitionBy("tag").orderBy(*order).rowsBetween(*before))
    coming = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("tag").orderBy(*back).rowsBetween(*before))
    each = each.withColumn("free", F.coalesce(passed <= F.col("start"), F.lit(True)) & F.coalesce(coming >= F.col("end"), F.lit(True)))
    each = stash(each.where(base | F.col("free")).drop("free"), "candidates")
    judged = attach(each, owners(each), "hash", "rows")
    copied = F.col("owners") > MOST_OWNERS
    live = ~copied & F.col("looks")
    kind = F.coalesce(F.col("kind"), F.when(live & F.col("vendor"), 3).when(live & F.col("assigned"), 4).when(live & F.col("opaque"), 5))
    judged = judged.withColumns({"copied": copied, "live": live, "kind": kind}).where("kind is not null")
    span = F.struct("start", "kind", "end", "repos", "owners", "copied", "live")
    some = judged.groupBy("tag").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    spans = F.coalesce("spans", F.array().cast(some.schema["spans"].dataType)).alias("spans")
    return rows.select("tag", "id").join(some, "tag", "left").select(F.col("id").alias(id_col), spans)


def of_kind(kind: str):
    return lambda s: s["kind"] == KINDS.index(kind)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
