"""Personal data by weak supervision, in DataFrame operations alone.

Candidates are the strict matches of four kinds (email, ip, card, phone), what a strict pattern finds but its check turns down (numbers of card length, addresses with parts
over 255, short phone numbers), looser forms of the same kinds (written-out addresses, IPv6, numbers without a plus sign), and keys: values that something is set to. Four
labelers vote on each candidate: the shape with its checks, a gazetteer (top-level domains, address blocks, issuer prefixes, calling codes, key formats), keywords in the
text before it, and the characters beside it. Expectation-maximisation over the counts of vote patterns (a table of bounded size: kinds times
patterns) estimates how reliable each labeler is; the posteriors then train the final span classifier, naive Bayes over votes and shape.
Strict matches always stay, looser ones if the classifier gives them ACCEPT and they touch no strict one.

Patterns are written so that a search takes linear time: a run is only entered at its start or where the last match ended, and is never given back
where giving back can't help. Places, contexts and the rewriting are made in blocks, so a text costs about its length, whatever it holds.

Defined results: null texts count as empty and have no spans. Positions are code points, ends exclusive. Repeated rows are judged row by row.
Without any candidate nothing is estimated. Spans of one kind and one pattern never overlap; others may. A labeler's context ends at the match before.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stash, text_or_empty
from .spans import in_blocks, let, matches, touched

#: The kinds with a strict pattern, then the one without.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "key")
LOCAL = r"[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a kind can't be without; the search is skipped where it is missing.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE = {
    # joe [at] foo [dot] com, or joe at foo dot com; a full stop after a word is no dot
    "email": rf"(?<!{LOCAL}){LOCAL}++(?: ?(?:\[at\]|\(at\)|\{{at\}}) ?[A-Za-z0-9-]++(?:(?:\.| ?(?:\[dot\]|\(dot\)|\{{dot\}}) ?| dot )[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,5}(?:[ ./-][0-9]{2,5}){0,3}(?![0-9A-Za-z])",
    "key": r"""(?<=[:=] ?["']?)(?<![A-Za-z0-9+/_-])(?!//)[A-Za-z0-9+/_-]{8,}+""",
}
#: What a looser form can't be without: a cheap search before the dear one.
LOOSE_NEEDS = {"email": r"[\[({]at[\])}]| at [A-Za-z0-9-]++ dot ", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "phone": r"[0-9][) ./-]{1,2}[0-9]{2}", "key": r"""[:=] ?["']?[A-Za-z0-9+_-]"""}
#: Gazetteers, as patterns over the span.
LISTED = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|us|ca|au|br|jp|test|example|invalid)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-1][0-9]|22[0-3])\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9]",
    "key": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|gh[pousr]_.+|xox[abprs]-.+|[rs]k_live_.+|sk-.+|AIza.+|AKIA.+|eyJ.+)$",
}
#: Words of the four languages that announce each kind.
NEAR = {
    "email": r"(?i)mail|contact|write|schreib|courriel|correo|reach|kontakt|escrib",
    "ip": r"(?i)\bip\b|host|server|address|adress|login|serveur|servidor|from",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|pay|master",
    "phone": r"(?i)phone|tel|call|fax|mobil|ruf|appel|llam|contact",
    "key": r"(?i)pass|pwd|token|secret|secreto|key|auth|account|konto|clave|compte|login",
}
WINDOW = 40
ROUNDS = 8
ACCEPT = 0.9
VOTES = ("strict", "listed", "near", "apart")


def _digits(span: Column) -> Column:
    return F.char_length(F.regexp_replace(span, "[^0-9]", ""))


def _checked(kind: str, span: Column) -> Column:
    """What the strict patterns ask for beyond their form."""
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        digits = F.regexp_replace(span, "[ -]", "")
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return _digits(span).between(9, 15)
    return F.lit(True)


def _close(kind: str, span: Column) -> Column:
    """Matches that fail their check but may be meant all the same."""
    if kind == "ip":
        return F.char_length(span) <= 15
    if kind == "card":
        return _digits(span).between(12, 19)
    return _digits(span).between(7, 15) if kind == "phone" else F.lit(False)


def _shaped(kind: str, span: Column) -> Column:
    """The shape labeler's vote on a looser form."""
    if kind == "email":
        return F.rlike(span, F.lit(r"[A-Za-z]{2,}$"))
    if kind == "phone":
        return _digits(span).between(9, 15)
    if kind == "key":
        return (F.char_length(span) >= 16) & F.rlike(span, F.lit("[0-9]")) & F.rlike(span, F.lit("[A-Za-z]"))
    return F.lit(kind == "ip")


def _strict(text: Column, kind: str, number: int) -> Column:
    """Matches of a strict pattern, with whether they pass their check; those that are not even close are left out."""
    need = NEEDS[kind]
    found = matches(text, STRICT[kind], has=None if need is None else F.contains(text, F.lit(need)), context=WINDOW)
    judged = F.transform(found, lambda x: let(_checked(kind, x["value"]), lambda ok: _candidate(x, number, ~ok, ok)))
    return F.filter(judged, lambda x: ~x["loose"] | _close(kind, x["span"]))


def _loose(text: Column, kind: str, number: int) -> Column:
    found = matches(text, LOOSE[kind], has=F.rlike(text, F.lit(LOOSE_NEEDS[kind])), context=WINDOW)
    judged = F.transform(found, lambda x: _candidate(x, number, F.lit(True), _shaped(kind, x["value"])))
    return F.filter(judged, lambda x: _close(kind, x["span"])) if kind == "phone" else judged


def _candidate(x: Column, number: int, loose: Column, shaped: Column) -> Column:
    plain = (x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["value"].alias("span"))
    return F.struct(*plain, loose.alias("loose"), shaped.cast("int").alias("strict"), x["before"].alias("before"), x["after"].alias("after"))


def of_kind(kind: int):
    return lambda c: c["kind"] == kind


def _by_kind(kind: Column, make) -> Column:
    out = make(KINDS[-1])
    for i, name in reversed([*enumerate(KINDS[:-1])]):
        out = F.when(kind == i, make(name)).otherwise(out)
    return out


def with_candidates(docs: DataFrame, *, text_col: str = "text", out: str = "pii_candidates") -> DataFrame:
    """Adds an array of candidates with their votes: start, kind, end, strict, listed, near, apart, long, loose; in order of start, then kind."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tmp = {f"{out}_strict_{k}": _strict(text, k, i) for i, k in enumerate(BASE)}
    tmp[f"{out}_loose"] = F.concat(*(_loose(text, k, KINDS.index(k)) for k in LOOSE))
    joined = docs.withColumns(tmp)
    base = {k: f"{out}_base_{k}" for k in BASE}
    joined = joined.withColumns({base[k]: F.filter(f"{out}_strict_{k}", lambda x: ~x["loose"]) for k in BASE})
    close = F.concat(F.col(f"{out}_loose"), *(F.filter(f"{out}_strict_{k}", lambda x: x["loose"]) for k in BASE))
    free = F.filter(close, lambda x: ~reduce(or_, (touched(x, F.col(c)) for c in base.values())))

    def judged(x: Column) -> Column:
        beside = F.concat(F.right(x["before"], F.lit(1)), F.lit(" "), x["after"])
        return F.struct(
            x["start"].alias("start"),
            x["kind"].alias("kind"),
            x["end"].alias("end"),
            x["strict"].alias("strict"),
            _by_kind(x["kind"], lambda k: F.rlike(x["span"], F.lit(LISTED[k]))).cast("int").alias("listed"),
            F.when(_by_kind(x["kind"], lambda k: F.rlike(x["before"], F.lit(NEAR[k]))), 1).otherwise(2).alias("near"),
            (~F.rlike(beside, F.lit(r"[\p{L}\p{N}@]"))).cast("int").alias("apart"),
            F.least(F.floor((x["end"] - x["start"]) / 4), F.lit(8)).cast("int").alias("long"),
            x["loose"].alias("loose"),
        )

    kept = F.concat(*(F.col(c) for c in base.values()), free)
    return joined.withColumn(out, F.array_sort(F.transform(kept, judged))).drop(*tmp, *base.values())


def estimate(candidates: DataFrame, *, column: str = "pii_candidates", rounds: int = ROUNDS) -> dict:
    """Reliabilities by expectation-maximisation and the span classifier's log odds. candidates may be large; all that is collected are a
    few numbers for each of the five kinds and for each value of five features."""
    one = candidates.select(F.explode(column).alias("c")).select("c.*")
    patterns = stash(one.groupBy("kind", *VOTES, "long").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    params = {k: (0.5, {v: (0.7, 0.3) for v in VOTES}) for k in range(len(KINDS))}
    post = F.lit(0.5)
    for _ in range(rounds):
        post = _posterior(params)
        w1, w0 = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum(w1).alias("y1"), F.sum(w0).alias("y0")]
        for v in VOTES:
            for y, w in ((1, w1), (0, w0)):
                sums += [F.sum(F.when(F.col(v) == 1, w)).alias(f"{v}_{y}_pos"), F.sum(F.when(F.col(v) < 2, w)).alias(f"{v}_{y}_all")]
        rows = patterns.withColumn("p", post).groupBy("kind").agg(*sums).collect()  # five rows at most
        for r in rows:
            share = lambda v, y, r=r: ((r[f"{v}_{y}_pos"] or 0) + (0.7 if y else 0.3) * 4) / ((r[f"{v}_{y}_all"] or 0) + 4)
            params[r["kind"]] = ((r["y1"] + 2) / (r["y1"] + r["y0"] + 4), {v: (share(v, 1), share(v, 0)) for v in VOTES})
    # the classifier: naive Bayes with the posteriors as soft labels
    features = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("x")) for f in (*VOTES, "long")))).alias("fx")
    counts = patterns.withColumn("p", _posterior(params)).select("kind", "n", "p", features)
    table = counts.groupBy("kind", "fx.f", "fx.x").agg(F.sum(F.col("n") * F.col("p")).alias("y1"), F.sum(F.col("n") * (1 - F.col("p"))).alias("y0")).collect()
    total = {k: [1.0, 1.0] for k in range(len(KINDS))}
    for r in table:
        if r["f"] == "strict":
            total[r["kind"]][1] += r["y1"]
            total[r["kind"]][0] += r["y0"]
    odds = {(r["kind"], r["f"], r["x"]): math.log((r["y1"] + 1) / (total[r["kind"]][1] + 8) * (total[r["kind"]][0] + 8) / (r["y0"] + 1)) for r in table}
    return {"reliability": params, "prior": {k: math.log(t[1] / t[0]) for k, t in total.items()}, "odds": odds}


def _posterior(params: dict) -> Column:
    """P(personal | votes) of a pattern row."""
    out = F.lit(0.5)
    for k, (prior, votes) in params.items():
        logit = F.lit(math.log(prior / (1 - prior)))
        for v, (yes, no) in votes.items():
            logit = logit + F.when(F.col(v) == 1, math.log(yes / no)).when(F.col(v) == 0, math.log((1 - yes) / (1 - no))).otherwise(0.0)
        out = F.when(F.col("kind") == k, 1 / (1 + F.exp(-logit))).otherwise(out)
    return out


def accepted(column: Column, model: dict) -> Column:
    """The candidates that stay."""
    names = (*VOTES, "long")
    table = F.create_map(*(F.lit(x) for (k, f, v), o in sorted(model["odds"].items()) for x in (f"{k}:{f}:{v}", o))) if model["odds"] else F.create_map(F.lit(""), F.lit(0.0))
    prior = F.create_map(*(F.lit(x) for k, o in model["prior"].items() for x in (k, o)))

    def keep(c: Column) -> Column:
        logit = F.coalesce(F.try_element_at(prior, c["kind"]), F.lit(0.0))
        for f in names:
            logit = logit + F.coalesce(F.try_element_at(table, F.concat_ws(":", c["kind"].cast("string"), F.lit(f), c[f].cast("string"))), F.lit(0.0))
        return ~c["loose"] | (logit >= math.log(ACCEPT / (1 - ACCEPT)))

    return F.filter(column, keep)


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, `candidates` and `found` (arrays of spans)."""
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text_or_empty(text_col).alias("text"))
    some = stash(with_candidates(rows, out="candidates").select(id_col, "candidates"), "candidates")
    return some.withColumn("found", accepted(F.col("candidates"), estimate(some, column="candidates")))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of docs, with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    held = free_name(docs.columns, "pii_candidates")
    # found once: the written table serves the estimation and the rewriting
    marked = stash(with_candidates(docs, text_col=text_col, out=held), "marked")
    model = estimate(marked.select(held), column=held)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    # in blocks of spans: the text is cut once for each block, and spans are replaced within a block's own piece
    none = F.struct(F.lit(0).alias("upto"), F.array().cast(f"array<struct<at:int,upto:int,spans:{marked.schema[held].dataType.simpleString()}>>").alias("out"))

    def block(acc: Column, spans: Column) -> Column:
        upto = F.greatest(acc["upto"], F.array_max(F.transform(spans, lambda c: c["end"])))
        return F.struct(upto.alias("upto"), F.array_append(acc["out"], F.struct(acc["upto"].alias("at"), upto.alias("upto"), spans.alias("spans"))).alias("out"))

    def rewritten(b: Column, piece: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            new = F.concat(acc["out"], F.substring(piece, acc["at"] - b["at"] + 1, c["start"] - acc["at"]), F.get(names, c["kind"]))
            return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.when(c["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

        return F.aggregate(b["spans"], F.struct(b["at"].alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def joined(done: Column) -> Column:
        pieces = F.transform(done["out"], lambda b: let(F.substring(text, b["at"] + 1, b["upto"] - b["at"]), lambda piece: rewritten(b, piece)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, done["upto"] + 1, F.char_length(text)))

    marked = marked.withColumn(held, accepted(F.col(held), model))
    whole = let(F.aggregate(in_blocks(F.col(held)), none, block), joined)
    return marked.withColumn(text_col, F.when(F.size(held) > 0, whole).otherwise(F.col(f"`{text_col}`"))).drop(held)
