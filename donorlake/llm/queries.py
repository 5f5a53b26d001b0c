"""The registered queries of this subpackage: every operator on its whole table, with the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlake.llm import bpe, hard_negatives, lines, quality, quotes, recompression, secret_scan, simhash, spelling, suffixes, tiling, topk, toxicity
from donorlake.llm.text import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), vocabulary_path())


@query
def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op3_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = written(topk.integer_vectors(table(spark, sf, "embeddings")), "topk-vectors")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL["op3_topk"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored) WHERE rank <= 10"""


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query
def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


@query
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op6_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.long_repeats(table(spark, sf, "documents"))


@query
def op7_recompression(spark: SparkSession, sf: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf, "documents"))


def _repeats_sql(size: int, columns: str) -> str:
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, s, array_to_string(w[s:s + {size - 1}], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - {size - 1})) AS s FROM docs WHERE len(w) >= {size})),
marked AS (SELECT w.r, w.s FROM windows w JOIN (SELECT g, min(doc_id) AS m FROM windows GROUP BY g) USING (g) WHERE w.doc_id > m),
gone AS (SELECT DISTINCT r, s + o AS p FROM marked, range({size}) AS t(o)),
words AS (SELECT r, doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM docs),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS k, count(gone.p) AS n,
    coalesce(list(words.p - 1 ORDER BY words.p) FILTER (gone.p IS NOT NULL), []) AS ps
  FROM words LEFT JOIN gone USING (r, p) GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, {columns}, sha256(coalesce(k, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""


SQL["op7_recompression"] = _repeats_sql(13, "coalesce(n, 0)::BIGINT AS n_removed")
SQL["op6_suffix_array"] = _repeats_sql(
    50,
    """coalesce(n, 0)::BIGINT AS n_repeated, coalesce(array_to_string(list_transform(
    list_zip(list_filter(ps, lambda x: NOT list_contains(ps, x - 1)), list_filter(ps, lambda x: NOT list_contains(ps, x + 1))),
    lambda p: p[1]::VARCHAR || ':' || (p[2] + 1)::VARCHAR), ','), '') AS spans""",
)


@query
def op4_quotation_chat(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf, "conversations"))


SQL["op4_quotation_chat"] = r"""
WITH RECURSIVE messages AS (SELECT row_number() OVER () AS m, *,
    md5(coalesce(length(role)::VARCHAR || ':' || role, '-') || coalesce(':' || text, '-')) AS mid FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
raw AS (SELECT m, conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line,
    generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS i FROM messages),
bodies AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)*'), '[^>]', '', 'g'))::INT AS level,
    regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS body FROM raw),
normal AS (SELECT *, lower(trim(regexp_replace(body, '[ \t\r\f\x0B]+', ' ', 'g'))) AS norm FROM bodies),
lines AS (SELECT *, level = 0 AND NOT (norm LIKE '%wrote:' AND coalesce(lead(level) OVER w, 0) > 0) AS own,
    CASE WHEN lag(level) OVER w IS DISTINCT FROM level THEN 1 ELSE 0 END AS fresh FROM normal WINDOW w AS (PARTITION BY m ORDER BY i)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY m ORDER BY i) AS run FROM lines),
own_units AS (SELECT m, conv_id, turn, norm AS unit FROM lines WHERE own
  UNION ALL SELECT m, conv_id, turn, string_agg(norm, ' ' ORDER BY i) FROM lines WHERE own AND norm <> '' GROUP BY m, conv_id, turn),
authors AS (SELECT o.conv_id, md5(unit) AS hash, min(o.turn) AS source, arg_min(o.m, (o.turn, mid)) AS parent
  FROM own_units o JOIN messages USING (m) WHERE unit <> '' AND o.turn IS NOT NULL GROUP BY 1, 2),
quoted AS (SELECT DISTINCT m, conv_id, turn, level, run, unit FROM (
  SELECT m, conv_id, turn, level, run, norm AS unit FROM runs WHERE level > 0
  UNION ALL SELECT m, conv_id, turn, level, run, string_agg(norm, ' ' ORDER BY i) FROM runs WHERE level > 0 AND norm <> '' GROUP BY m, conv_id, turn, level, run)),
weights AS (SELECT q.m, level, source, parent, sum(length(unit)) AS size
  FROM quoted q JOIN authors a ON q.conv_id = a.conv_id AND md5(q.unit) = a.hash AND source < q.turn WHERE unit <> '' GROUP BY 1, 2, 3, 4),
links AS (SELECT m, source AS parent_turn, parent FROM (
  SELECT w.*, row_number() OVER (PARTITION BY w.m ORDER BY level, size DESC, source DESC, p.mid DESC) AS r FROM weights w JOIN messages p ON p.m = w.parent) WHERE r = 1),
chain AS (SELECT m, parent AS anc, parent_turn AS anc_turn FROM links
  UNION ALL SELECT c.m, l.parent, l.parent_turn FROM chain c JOIN links l ON c.anc = l.m),
ends AS (SELECT m, min(anc_turn) AS root_turn FROM chain GROUP BY 1),
texts AS (SELECT m, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (own), ''), chr(32) || chr(9) || chr(13) || chr(10)) AS content,
    max(level) AS quote_level FROM lines GROUP BY m),
placed AS (SELECT s.*, parent_turn, coalesce(root_turn, s.turn) AS root_turn, quote_level, content
  FROM messages s JOIN texts USING (m) LEFT JOIN links l USING (m) LEFT JOIN ends e USING (m))
SELECT conv_id, CASE WHEN conv_id IS NULL THEN 1 ELSE row_number() OVER (
    PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) END AS position,
  turn, role, parent_turn, root_turn, quote_level, content, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || content AS chat
FROM placed"""


@query
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = written(hard_negatives.usable_rows(table(spark, sf, "embeddings"), 256, moved), "negatives-vectors")
    return hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


SQL["op11_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS alike,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
positives AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE alike) WHERE r <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
WHERE rank <= 10"""


@query
def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOWER = "'abcdefghijklmnopqrstuvwxyz'"

# crc32 by its table; near words meet at what is left of both when one code point goes: the same word, or the same one from the same place.
SQL["op12_spelling"] = f"""
WITH RECURSIVE crc_step AS (
  SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) AS t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS entries FROM crc_step WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR || ':' || run)), '..'),
    lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM runs, crc_table),
typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT DISTINCT word, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
ranked AS (
  SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS r
  FROM near JOIN words w ON w.word = other),
placed AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * words.n THEN other END AS form,
    CASE WHEN other_n >= 10 * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON words.word = ranked.word AND r = 1),
chain AS (
  SELECT word, word AS root, 0 AS depth FROM placed
  UNION ALL SELECT c.word, p.form, depth + 1 FROM chain c JOIN placed p ON c.root = p.word WHERE p.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM placed JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) USING (word)"""


@query
def op13_lines(spark: SparkSession, sf: str) -> DataFrame:
    kept = lines.drop_repeated_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL["op13_lines"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS p FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_UPPER}, {_LOWER}) AS k FROM lines),
spread AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT r, p, line, coalesce(doc_id < last, false) AS gone FROM keyed LEFT JOIN spread USING (k)),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS n FROM marked GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_lines, n::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM docs JOIN kept USING (r)"""
