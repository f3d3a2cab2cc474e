"""The registered queries of this package, each over whole tables, and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from opslake.llm import bpe, collocations, embed_dedup, exact_dedup, line_dedup, lm_score, merkle, minhash_dedup, mixing, secrets, suffix_dedup, token_count, toxicity
from opslake.llm.rows import remainder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_count(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return token_count.count_tokens(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op6_exact_dedup(spark, sf):
    return exact_dedup.deduplicate(documents(spark, sf))


ORACLE["op6_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""


@query
def op7_bpe_round_trip(spark, sf):
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = documents(spark, sf).select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, *ranks).drop("text"), *ranks)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_line_dedup(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op9_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""


@query
def op5_secret_scan(spark, sf):
    found = secrets.find_secrets(documents(spark, sf).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of_kind = [F.size(F.filter("spans", secrets.is_kind(k))).cast("long") for k in range(3)]
    return found.select("doc_id", of_kind[0].alias("n_assign"), of_kind[1].alias("n_access"), of_kind[2].alias("n_hex"),
                        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


@query
def op10_toxicity(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scored = toxicity.score(docs, model, threshold=0.7)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def _field(name: str):
    return lambda c: c[name]


@query
def op2_source_mixing(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", "text")
    dealt = mixing.assign(docs, mixing.plan_mix(docs))
    return dealt.select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).alias("taken"),
                        *[F.array_join(F.transform("copies", _field(n)), ",").alias(f"{n}s") for n in ("shard", "place")])


@query
def op1_lm_score(spark, sf):
    return lm_score.score(documents(spark, sf).select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


@query
def op8_minhash_dedup(spark, sf):
    found = minhash_dedup.near_groups(documents(spark, sf).select("doc_id", "text"), 85, 100)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                        F.col("_id").eqNullSafe(F.col("component")).alias("kept"))


@query
def op3_embedding_dedup(spark, sf):
    return embed_dedup.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), cosine=0.95)


@query
def op11_merkle_manifest(spark, sf):
    docs = documents(spark, sf)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs, merkle.leaf_digest(*fields, F.col("text")),
                            keep={"doc_id": F.col("doc_id"), "seen": merkle.leaf_digest(*fields, tampered)})
    text, back = merkle.text_of_digest, merkle.folded(F.col("seen"), F.col("path"))
    return found.select("doc_id", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"),
                        F.sha2(text(merkle.siblings(F.col("path"))), 256).alias("proof_sha256"), text(back).alias("folded_root"),
                        (back == F.col("root")).alias("verified"))


ORACLE["op11_merkle_manifest"] = r"""
WITH RECURSIVE field AS (
  SELECT doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS inverted
  FROM documents),
leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN inverted & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS cut, head
  FROM field),
placed AS (
  SELECT doc_id, source, leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS seen,
         row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM leaf),
low AS (
  SELECT 0 AS level, source, pos, n, leaf AS d FROM placed
  UNION ALL
  SELECT level + 1, source, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM low WHERE n > 1
  GROUP BY level, source, pos // 3),
top AS (
  SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, n, subroot AS d FROM top
  UNION ALL
  SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 3),
side_low AS (
  SELECT a.level, a.source, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM low a JOIN low b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.pos // 3 = b.pos // 3 WHERE a.n > 1
  GROUP BY ALL),
side_high AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM high a JOIN high b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
path AS (
  SELECT p.source, p.pos, s.level, s.l, s.r FROM placed p JOIN side_low s
  ON s.source IS NOT DISTINCT FROM p.source AND s.pos = p.pos // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT p.source, p.pos, 1000 + s.level, s.l, s.r FROM placed p JOIN top t ON t.source IS NOT DISTINCT FROM p.source
  JOIN side_high s ON s.pos = t.pos // (3 ** s.level)::BIGINT),
proof AS (
  SELECT source, pos, string_agg(l || r, '' ORDER BY level) AS all_, list({'l': l, 'r': r} ORDER BY level) AS steps FROM path GROUP BY source, pos),
fold AS (
  SELECT p.source, p.pos, 1 AS k, p.seen AS d, coalesce(f.steps, []) AS steps FROM placed p
  LEFT JOIN proof f ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos
  UNION ALL
  SELECT source, pos, k + 1, sha256(steps[k].l || d || steps[k].r), steps FROM fold WHERE k <= len(steps))
SELECT p.doc_id, p.leaf, t.subroot, h.d AS root, sha256(coalesce(f.all_, '')) AS proof_sha256, o.d AS folded_root, o.d = h.d AS verified
FROM placed p JOIN top t ON t.source IS NOT DISTINCT FROM p.source JOIN high h ON h.n = 1
LEFT JOIN proof f ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos
JOIN fold o ON o.source IS NOT DISTINCT FROM p.source AND o.pos = p.pos AND o.k = len(o.steps) + 1
"""


@query
def op13_collocations(spark, sf):
    return collocations.collocations(documents(spark, sf), min_count=100, max_words=5, covered=100, top=2000)


ORACLE["op13_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, n.n, k, l.f AS l, r.f AS r, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
  JOIN n ON n.lang = c.lang),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM cand)) GROUP BY ALL)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n, score
FROM worst w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase WHERE longest IS NULL OR 100 * longest < 100 * a
QUALIFY rank <= 2000
"""


@query
def op12_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeats(documents(spark, sf).select("doc_id", "text"), length=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op12_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT k, p, md5_number(substr(h, (2 * p + 1)::INT, 400)) AS m FROM (SELECT k, h, unnest(range(n - 199)) AS p FROM d WHERE n >= 200)),
twice AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
hit AS (SELECT k, p, p > coalesce(lag(p) OVER (PARTITION BY k ORDER BY p), -1000) + 200 AS new FROM s WHERE m IN (SELECT m FROM twice)),
run AS (SELECT k, min(p) AS a, max(p) + 200 AS b FROM (SELECT k, p, sum(new::INT) OVER (PARTITION BY k ORDER BY p) AS r FROM hit) GROUP BY k, r),
gap AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS free FROM run),
cut AS (
  SELECT k, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, (2 * free + 1)::INT, (2 * (a - free))::INT), '' ORDER BY a) AS head
  FROM gap JOIN d USING (k) GROUP BY k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256
FROM d LEFT JOIN cut USING (k)
"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
