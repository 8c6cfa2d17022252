"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm import (
    chat, collocations, context_tree, cotraining, decontaminate, mixing, near_dedup, paragraphs, quality_rules, resampling, secrets,
    sharding, toxicity,
)
from heliospan.llm.common import prepared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(prepared(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# Lower-cases A-Z only, then takes runs of non-space characters.
LOWER_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
)

NEAR_DEDUP_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.c AS component_id, d.doc_id = g.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) g ON g.a = d.doc_id
"""


@query("op1_super_minhash_dedup", NEAR_DEDUP_SQL)
def op1_super_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op6_hypergeometric_shards")
def op6_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


MIXING_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '')), 0)::BIGINT AS size,
  ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS MATERIALIZED (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
o AS MATERIALIZED (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS l
  FROM s WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS MATERIALIZED (
  SELECT source, source_size, least(cap, coalesce(w * (
    SELECT arg_min(l, cap / w) FROM o WHERE l * w <= cap), cap))::DOUBLE AS target FROM o)
SELECT doc_id, size, source_size, target,
  (size * (floor(r) + CASE WHEN u < r - floor(r) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""


@query("op7_source_mixing", MIXING_SQL)
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"))


CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (
  SELECT *, length('<|im_start|>' || replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') || chr(10)
    || replace(replace(text, '&', '&amp;'), '<|', '&lt;|') || '<|im_end|>' || chr(10)) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op2_fingerprint_chat", CHAT_SQL)
def op2_fingerprint_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_with_probe(table(spark, folder, "conversations"))


@query("op4_blob_ledger_secrets")
def op4_blob_ledger_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


@query("op5_ngram_quality")
def op5_ngram_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_bigru_toxicity")
def op9_bigru_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_cgk_decontamination")
def op10_cgk_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_paragraph_dedup")
def op8_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, folder, "documents"))


@query("op3_cotraining_quality")
def op3_cotraining_quality(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.quality(
        table(spark, folder, "documents"), table(spark, folder, "pages"), table(spark, folder, "labels"))


RESAMPLING_SQL = r"""
WITH c AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
w AS MATERIALIZED (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (
  SELECT side, id, f, count(*) AS n FROM (
    SELECT side, id, unnest(w) AS f FROM w
    UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)
  GROUP BY ALL),
b AS MATERIALIZED (
  SELECT f, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(f)),
    lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::UBIGINT)),
    lambda a, x: xor(c.t[((xor(a, x) & 255) + 1)::BIGINT], a >> 8)), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
  FROM (SELECT DISTINCT f FROM f), c),
s AS MATERIALIZED (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
  FROM f JOIN b USING (f) GROUP BY bucket),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
d AS MATERIALIZED (
  SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features,
    coalesce(floor(total / n)::BIGINT, 0) AS weight
  FROM (SELECT id AS doc_id, w FROM w WHERE side = 0) LEFT JOIN (
    SELECT id AS doc_id, sum(n)::BIGINT AS n, sum(n * gain)::DOUBLE AS total
    FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY id) USING (doc_id)),
e AS MATERIALIZED (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5)::DOUBLE
    / 4294967296)))::BIGINT AS score FROM d),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM e WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END::BIGINT AS rank
FROM e LEFT JOIN r USING (doc_id)
"""


@query("op12_importance_resampling", RESAMPLING_SQL)
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


COLLOCATIONS_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'),
    lambda x: x <> '') AS w FROM t),
g AS MATERIALIZED (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM p, range(1, 5) r(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
q AS MATERIALIZED (
  SELECT lang, k, g, f AS a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y
  FROM (SELECT *, string_split(g, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1)),
c AS MATERIALIZED (
  SELECT q.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score
  FROM q JOIN f l ON l.lang = q.lang AND l.g = x JOIN f r ON r.lang = q.lang AND r.g = y),
b AS MATERIALIZED (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
i AS MATERIALIZED (
  SELECT lang, array_to_string(w[s:s + z - 1], ' ') AS g, max(a) AS a
  FROM (SELECT *, string_split(g, ' ') AS w FROM b), range(2, 4) x(z), range(1, 4) y(s)
  WHERE z < k AND s + z - 1 <= k GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.g)::BIGINT AS rank,
    b.g AS phrase, b.a, b.l, b.r, b.score
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE i.a IS NULL OR 100 * i.a < 80 * b.a)
JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_setm_collocations", COLLOCATIONS_SQL)
def op11_setm_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query("op13_context_tree_scores")
def op13_context_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.text_scores(table(spark, folder, "documents"))
