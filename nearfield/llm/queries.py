"""One query for each operator of this subpackage, over whole tables, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, language_id, lm_score, merkle, ngram_join, packing, pii, quality, resampling, secret_scan, sentencepiece_bpe, substring_dedup
from .common import crc_mod, documents


def tokenizer(name: str) -> str:
    """Path of an installed public tokenizer file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip_digests(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # in two batches, larger ids first, so that the second one meets what the first one left in the index
    middle = F.lit(docs.agg(F.avg("doc_id").alias("m")).first()["m"])
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    with exact_dedup.DigestIndex(spark) as index:
        found = index.dedup(docs.where(upper), docs.where(~upper))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"), tokenizer("word_bpe_49k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs.where(~quality.held_out_split()), labels.where(~quality.held_out_split()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out_split().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    base = F.filter("candidates", lambda c: ~c["loose"])
    count = {f"n_{k}": F.size(F.filter(base, pii.of_kind(i))).cast("long") for i, k in enumerate(pii.BASE)}
    return found.select("doc_id", *(c.alias(n) for n, c in count.items()), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.Join(documents(spark, sf_dir).select("doc_id", "text")).classes()


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(documents(spark, sf_dir).select("doc_id", "text"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (SELECT doc_id, s, array_to_string(words[s:s + 34], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM t WHERE len(words) >= 35)),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM windows SEMI JOIN again USING (k)),
one AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(table, F.col("vec_id") % 20 == 0, top=20)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = lm_score.score(docs, lm_score.train(docs.where(~lm_score.held_out_split())))
    return scored.withColumn("held_out", lm_score.held_out_split())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prototypes = language_id.learn(docs.where(~language_id.held_out_split(docs)).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), prototypes, score_col="score")
    return found.select("doc_id", language_id.held_out_split(docs).alias("held_out"), "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(documents(spark, sf_dir), tampered=crc_mod("doc_id", 3) == 0)
    folded = found.withColumn("proof_sha256", merkle.proof(F.col("path"))).withColumn("folded_root", merkle.fold(F.coalesce("alt", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE said AS (SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
  || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS crc FROM documents),
leaves AS (SELECT doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) AS alt, crc % 3 = 0 AS tampered FROM said),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree AS (SELECT 0 AS lv, g, i, n, leaf AS h FROM placed UNION ALL SELECT lv + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lv, g, i // 8, n),
subroots AS (SELECT g, h AS subroot, max(lv) OVER () AS most, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (SELECT 0 AS lv, i, n, subroot AS h FROM subroots UNION ALL SELECT lv + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY lv, i // 8, n),
low_runs AS (SELECT a.g, a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM tree a JOIN tree b ON a.g = b.g AND a.lv = b.lv AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.g, a.lv, a.i),
high_runs AS (SELECT a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM crown a JOIN crown b ON a.lv = b.lv AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.lv, a.i),
steps AS (SELECT p.doc_id, p.g, r.lv, r.lft, r.rgt FROM placed p JOIN low_runs r ON p.g = r.g AND r.i = p.i >> (3 * r.lv)
  UNION ALL SELECT p.doc_id, p.g, 1000 + r.lv, r.lft, r.rgt FROM placed p JOIN subroots s ON p.g = s.g JOIN high_runs r ON r.i = s.i >> (3 * r.lv)),
paths AS (SELECT doc_id, g, list({'lft': lft, 'rgt': rgt} ORDER BY lv) AS path FROM steps GROUP BY doc_id, g),
one AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM crown WHERE n = 1) AS root, coalesce(path, []) AS path, CASE WHEN tampered THEN alt ELSE leaf END AS start
  FROM placed p JOIN subroots s ON p.g = s.g LEFT JOIN paths q ON p.doc_id = q.doc_id AND p.g = q.g),
folds AS (SELECT doc_id, path, 0 AS lv, start AS h FROM one UNION ALL SELECT doc_id, path, lv + 1, sha256(path[lv + 1].lft || h || path[lv + 1].rgt) FROM folds WHERE lv < len(path))
SELECT one.doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(one.path, lambda s: s.lft || s.rgt), ''), '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM one JOIN folds f ON one.doc_id = f.doc_id AND f.lv = len(one.path)
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < len(secret_scan.BASE))
    count = {f"n_{k}": F.size(F.filter(spans, secret_scan.of_kind(k))).cast("long") for k in secret_scan.BASE}
    more = {"n_copied": F.size(F.filter(spans, lambda s: s["copied"])).cast("long"), "live": secret_scan.listed(F.filter(spans, lambda s: s["live"]))}
    digest = F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256")
    found = secret_scan.find(documents(spark, sf_dir))
    return found.select("doc_id", *(c.alias(n) for n, c in count.items()), digest, secret_scan.listed(spans).alias("spans"), *(c.alias(n) for n, c in more.items()))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH both_tables AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
said AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM both_tables),
features AS (SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM said),
known AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM features)),
buckets AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 10000 AS b FROM known),
held AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features JOIN buckets USING (f) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM held) + 10000)) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM held) + 10000))))::BIGINT AS gain FROM held),
weights AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN buckets USING (f) JOIN gains USING (b) WHERE side = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM said LEFT JOIN weights USING (doc_id) WHERE side = 0),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored s LEFT JOIN drawn d ON s.doc_id = d.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_exact_dedup, op3_best_fit_packing, op4_quality, op5_pii, op6_ngram_jaccard, op7_substring_dedup, op8_ann, op9_lm_score, op10_language_id, op11_merkle_manifest, op12_secret_scan, op13_importance_resampling)}
ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op7_substring_dedup": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op13_importance_resampling": OP13_SQL}
