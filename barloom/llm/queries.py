"""Registered queries of the training-data operators and their comparison SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (bpe, chat, collision_search, jaccard, language, licenses, mixing, packing, pivot_search, quality, resampling, spelling,
                         substring_dedup, vectors)
from barloom.llm.common import crc_mod, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build
    return register


@query()
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0; scores every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    weights = quality.fit_quality(docs.where(~held_out), labels.where(~held_out))
    scored = quality.score_quality(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2; predicts every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language.fit_languages(docs.where(~held_out))
    found = language.identify_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query()
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one (-1) whose texts are made of control strings."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = vectors.finite_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", drop_zero=False)
    whole = whole.select("vec_id", F.transform("vec", lambda x: F.floor(256 * x).cast("bigint")).alias("vec"))
    return pivot_search.pivot_top_k(whole, whole.where(F.col("vec_id") % 50 == 0), 5)


@query()
def op9_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = vectors.finite_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", drop_zero=True)
    return collision_search.collision_top_k(whole, whole.where(F.col("vec_id") % 20 == 0), 20)


@query(r"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON b.s = a.s AND b.doc_id > a.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM h)),
seen AS (SELECT s, min(doc_id) AS owner FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM w JOIN seen USING (s) WHERE owner < doc_id),
fresh AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS f FROM hit),
numbered AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM fresh),
spans AS (SELECT doc_id, k, min(i) AS lo, max(i) + 50 AS hi FROM numbered GROUP BY ALL),
-- What is kept lies between the end of one span and the start of the next.
kept AS (SELECT doc_id, coalesce(lag(hi) OVER o, 0) AS lo, lo AS hi FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(CASE WHEN hi IS NULL THEN substr(h, 2 * lo + 1) ELSE substr(h, 2 * lo + 1, 2 * (hi - lo)) END, '' ORDER BY lo) AS r
  FROM kept JOIN h USING (doc_id) GROUP BY doc_id),
sizes AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(r, h))) AS kept_sha256 FROM h LEFT JOIN rest USING (doc_id) LEFT JOIN sizes USING (doc_id)""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


#: crc32 of the UTF-8 bytes of a string, for DuckDB: a table of 256 remainders, then a byte at a time.
CRC = """
crc AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) ORDER BY i) AS t
  FROM range(256) r(i)
)"""


def crc32(text: str) -> str:
    codes = f"list_transform(range(0, length(hex(encode({text}))), 2), lambda i: CAST('0x' || hex(encode({text}))[i + 1:i + 2] AS BIGINT))"
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: xor(c // 256, t[1 + CAST(xor(c % 256, b) AS INTEGER)]), CAST(4294967295 AS BIGINT)))"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH RECURSIVE {CRC}, runs AS (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, times, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc WHERE length(run) >= 5
), words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), less AS MATERIALIZED (
  SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, w.word FROM less x JOIN words w ON x.rest = w.word
  UNION SELECT w.word, x.word FROM less x JOIN words w ON x.rest = w.word
), near AS (
  SELECT a, b, n AS near_n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place, count(*) OVER (PARTITION BY a) AS n_near
  FROM pairs JOIN words ON b = word
), told AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN b END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN near ON a = word AND place = 1
), way AS (
  SELECT word, word AS root, form AS onward FROM told
  UNION ALL SELECT way.word, told.word, told.form FROM way JOIN told ON way.onward = told.word
)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN way ON told.word = way.word AND way.onward IS NULL
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query(f"""
WITH {CRC}, found AS MATERIALIZED (
  SELECT 0 AS side, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), hashed AS MATERIALIZED (
  SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT unnest(words) AS word FROM found), crc
), each AS MATERIALIZED (
  SELECT side, doc_id, bucket FROM (SELECT side, doc_id, unnest(words) AS word FROM found) JOIN hashed USING (word)
), sums AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM each GROUP BY bucket
), total AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums
), gains AS (
  SELECT bucket, CAST(floor(1000.0 * ln(((t + 1.0::DOUBLE) * (all_s + 10000)::DOUBLE) / ((s + 1.0::DOUBLE) * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sums, total
), weighed AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain FROM each JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0) AS weight,
         CAST('0x' || sha256('2024:' || d.doc_id)[1:8] AS BIGINT) AS h
  FROM (SELECT doc_id FROM documents) d LEFT JOIN weighed USING (doc_id)
), noisy AS (
  SELECT doc_id, n_features, weight, CAST(weight + floor(-1000.0 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank, n_features AS n_words FROM ranked
""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def mixing_tier(i: int) -> str:
    """One tier of documents drawn in Pareto order, after the tiers before it."""
    so_far = "(SELECT key, 0 AS so_far FROM targets)" if i == 0 else f"so{i - 1}"
    return f"""
goal{i} AS (
  SELECT key, words, least(greatest(rest * (CAST(upto AS DOUBLE) / CAST(source_size AS DOUBLE)) - so_far, 0.0), CAST(words AS DOUBLE)) AS goal
  FROM by_tier JOIN {so_far} USING (key) WHERE tier = {i}
), drawn{i} AS MATERIALIZED (
  SELECT *, 2.0::DOUBLE * coalesce(sum(size) OVER (PARTITION BY key ORDER BY odds / (1.0::DOUBLE + odds), doc_id NULLS FIRST, size
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size <= 2.0::DOUBLE * goal AS drawn
  FROM (SELECT placed.*, goal, CASE WHEN goal / words >= 1 THEN 0 ELSE (u / (1.0::DOUBLE - u)) / ((goal / words) / (1.0::DOUBLE - goal / words)) END AS odds
        FROM placed JOIN goal{i} USING (key) WHERE tier = {i} AND goal > 0)
), so{i} AS MATERIALIZED (
  SELECT key, CAST(sum(so_far) AS BIGINT) AS so_far
  FROM (SELECT key, so_far FROM {so_far} UNION ALL SELECT key, size FROM drawn{i} WHERE drawn) GROUP BY key
)"""


_TIERS = range(mixing.TIERS + 1)


@query(f"""
WITH sized AS MATERIALIZED (
  SELECT row_number() OVER () AS line, doc_id, source, coalesce('s' || source, 'n') AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || md5('13:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13] AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), sums AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY key, source
), shares AS (
  SELECT *, (150 * sum(source_size) OVER () - 100 * coalesce(sum(2 * source_size) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (100 * sum(weight) OVER (s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
  FROM sums WINDOW s AS (ORDER BY source_size::DOUBLE / weight, key)
), targets AS MATERIALIZED (
  SELECT key, source_size, CASE WHEN weight * level > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE weight * level END AS target
  FROM shares, (SELECT arg_min(share, source_size::DOUBLE / weight) AS level FROM shares WHERE weight * share <= 2 * source_size)
), placed AS MATERIALIZED (
  SELECT *, CASE WHEN rest > 0 AND size > 0 THEN CASE {" ".join(f"WHEN size * {mixing.STEP ** (i + 1)}.0::DOUBLE > rest THEN {i}" for i in _TIERS[:-1])} ELSE {mixing.TIERS} END END AS tier
  FROM (SELECT *, target - whole * source_size AS rest
        FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM sized JOIN targets USING (key)))
), by_tier AS MATERIALIZED (
  SELECT *, sum(words) OVER (PARTITION BY key ORDER BY tier) AS upto
  FROM (SELECT key, tier, rest, source_size, CAST(sum(size) AS BIGINT) AS words FROM placed WHERE tier IS NOT NULL GROUP BY ALL)
), {",".join(mixing_tier(i) for i in _TIERS)}
SELECT doc_id, size, source_size, target, size * (whole + coalesce(CAST(drawn AS INTEGER), 0)) AS taken, whole + coalesce(CAST(drawn AS INTEGER), 0) AS copies
FROM placed LEFT JOIN ({" UNION ALL ".join(f"SELECT line, drawn FROM drawn{i}" for i in _TIERS)}) USING (line)
""")
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))
