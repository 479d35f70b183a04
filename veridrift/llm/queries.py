"""One thin query per corpus operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shards before and after, in the resharding query.
OLD_SHARDS, NEW_SHARDS = 16, 24
#: Tokenizer of the packing query; the path comes from the installed package.
TOKENIZER = "word_bpe_49k.json"
#: Key of the pseudonyms in the query and the pipeline; a deployment sets its own.
PII_KEY = "veridrift-example-key"


def op1_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rewritten to 24 byte-balanced shards, from an old layout by source in 16."""
    from veridrift.llm.sharding import reshard_files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.expr(f"pmod(crc32(cast(coalesce(source, '') as binary)), {OLD_SHARDS})")
    return reshard_files(docs, old, NEW_SHARDS)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, as pieces."""
    import public_tokenizers

    from veridrift.llm.packing import tokenizer_pack

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokenizer_pack(docs, public_tokenizers.path(TOKENIZER))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints of 4-word shingles differ in 4 bits or fewer."""
    from veridrift.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, distance=4)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact occurrences of 10-word windows of all benchmark items in all documents."""
    from veridrift.llm.decontaminate import decontaminate

    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items, window=10)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from veridrift.llm.html_extract import main_texts

    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that stand in an earlier document, removed from all documents."""
    from veridrift.llm.suffix_dedup import deduplicate

    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    from veridrift.llm.warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with keyed pseudonyms, and what was found in each."""
    from veridrift.llm.pii import report

    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), PII_KEY)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, outliers by language and source."""
    from veridrift.llm.quality_rules import judge

    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junk and toxicity scores of all documents, and which are kept."""
    from veridrift.llm.quality_classifier import score

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents drawn by their likeness to the benchmark, with every document's weight."""
    from veridrift.llm.importance import resample

    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    from veridrift.llm.ngram_join import similar_groups

    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all, from labels of which a seventh is moved on by one."""
    from veridrift.llm.hard_negatives import hard_negatives

    vectors, label = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(vectors, F.col("vec_id"), moved, F.col("embedding"), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {
        "op1_resharding": op1_resharding,
        "op2_packing": op2_packing,
        "op3_simhash": op3_simhash,
        "op4_decontamination": op4_decontamination,
        "op5_html": op5_html,
        "op6_suffix_array": op6_suffix_array,
        "op7_warc": op7_warc,
        "op8_pii": op8_pii,
        "op9_quality_rules": op9_quality_rules,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_importance": op11_importance,
        "op12_ngram_join": op12_ngram_join,
        "op13_hard_negatives": op13_hard_negatives,
    }


_WORDS = (
    "[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> '']"
)
#: The queries that SQL can express; tests hold the others against brute force.
_SQL = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::varchar AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + k - 1] AS win FROM (
  SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT len(win) AS k FROM win),
grams AS (SELECT doc_id, s, k, w[s:s + k - 1] AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, k WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, k, item_id FROM grams JOIN win USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(covered.n, 0)::bigint AS n_hit, coalesce(found.n, 0)::bigint AS n_items,
  coalesce(h, sha256('')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op6_suffix_array": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, id, k, substr(h, 2 * k + 1, 100) AS w FROM (SELECT r, id, h, unnest(range(0, len(h) // 2 - 49)) AS k FROM d WHERE len(h) >= 100)),
f AS (SELECT w, min(id) AS least FROM s GROUP BY w),
g AS (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS before FROM s JOIN f USING (w) WHERE id > least),
u AS (SELECT r, min(k) AS a, max(k) + 50 AS b FROM (
  SELECT r, k, sum(CASE WHEN k <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS run FROM g) GROUP BY r, run),
p AS (SELECT r, a, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS low, a AS high FROM u
  UNION ALL SELECT r, 9223372036854775807, coalesce(max(b), 0), max(len(h) // 2) FROM d LEFT JOIN u USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY a) AS x FROM p JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(b - a)::bigint AS n_removed, count(*) AS n_spans FROM u GROUP BY r)
SELECT doc_id, (len(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
  sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN n USING (r)""",
    "op7_warc": """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to, true AS verified
FROM p LEFT JOIN f USING (payload_digest)""",
    "op11_importance": f"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS k),
x AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT -row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
g AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT r, w FROM x UNION ALL SELECT r, w FROM b)),
h AS (SELECT gram, xor(list_reduce(list_transform(range(1, strlen(gram) + 1), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i - 1, 2))::bigint),
    lambda c, y: xor(c >> 8, k[(xor(c, y) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT gram FROM g), k),
f AS (SELECT r, bucket, count(*) AS n FROM g JOIN h USING (gram) GROUP BY ALL),
a AS (SELECT sum(n) FILTER (WHERE r > 0) AS big_s, coalesce(sum(n) FILTER (WHERE r < 0), 0) AS big_t FROM f),
q AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (WHERE r < 0), 0)::double + 1) * (big_s::double + 10000)
    / ((coalesce(sum(n) FILTER (WHERE r > 0), 0)::double + 1) * (big_t::double + 10000))))::bigint AS gain FROM f, a GROUP BY bucket, big_s, big_t),
v AS (SELECT r, sum(n)::bigint AS n_features, sum(n * gain)::bigint AS total FROM f JOIN q USING (bucket) WHERE r > 0 GROUP BY r),
z AS (SELECT x.r, doc_id, len(w)::bigint AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::bigint AS weight,
    ('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint::double AS h FROM x LEFT JOIN v USING (r)),
s AS (SELECT * EXCLUDE h, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint AS score FROM z),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM s WHERE n_words >= 20 AND score IS NOT NULL)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM s LEFT JOIN o USING (r)""",
    "op12_ngram_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[s:s + 3], ' ') AS gram FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
c AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN c USING (r)""",
    "op13_hard_negatives": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label END AS label,
    [floor(256 * x::double) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::bigint AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.id))::int AS rank, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
