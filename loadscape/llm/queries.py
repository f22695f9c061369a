"""The registered queries of the text operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loadscape.llm import cover_tree, importance, jaccard_join, language_id, lexical, mixing, packing, pii, sentencepiece_dropout, substring_dedup, topk, url_filter, warc
from loadscape.llm.common import WORD_PATTERN, table, word_count


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.annotate(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), word_count("text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "n_taken")


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.roundtrip(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_substring_dedup, op3_language_id, op4_jaccard, op5_mixing, op6_cover_tree, op7_warc, op8_topk, op9_url_filter, op10_sentencepiece, op11_lexical_search, op12_packing, op13_importance)}


_W = ", ".join(f"({i}, {float(w)})" for i, w in enumerate(mixing.WEIGHTS))
_MIXING = rf"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '/{mixing.SEED}') AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS nth
  FROM rows_ GROUP BY source),
caps AS (
  SELECT source, source_size, w AS weight, source_size::DOUBLE * {mixing.REPEATS} AS cap, source_size::DOUBLE * {mixing.REPEATS} / w AS fill,
         sum(source_size) OVER ()::DOUBLE * {mixing.SHARE} AS budget
  FROM sources JOIN (VALUES {_W}) v(i, w) ON i = nth),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
         / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
cut AS (SELECT level FROM levels WHERE level <= fill ORDER BY fill, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM cut) IS NULL THEN cap ELSE least(cap, (SELECT level FROM cut) * weight) END AS target
  FROM levels),
queued AS (
  SELECT r.*, t.source_size, t.target, sum(size) OVER (PARTITION BY r.source ORDER BY ord, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, source, ord, size, source_size, target, k, coalesce((upto + k * source_size)::DOUBLE / nullif(target, 0e0), 0e0) AS time
  FROM queued CROSS JOIN range({mixing.REPEATS}) c(k)),
taken AS (
  SELECT *, (sum(size) OVER (ORDER BY time, source NULLS LAST, ord, size, k ROWS UNBOUNDED PRECEDING) <= (SELECT sum(target) FROM targets))::BIGINT AS took
  FROM copies)
SELECT doc_id, size, source_size, target, sum(took * size)::BIGINT AS taken, source, sum(took)::BIGINT AS n_taken
FROM taken GROUP BY doc_id, source, ord, size, source_size, target"""

_WARC = f"""
WITH rows_ AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
marked AS (
  SELECT *, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS largest FROM rows_)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN n >= {warc.MIN_BYTES} AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {warc.MIN_BYTES} AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to, regexp_replace(url, '[\\x00-\\x20]', '', 'g') AS url
FROM marked"""

_TOPK = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS MATERIALIZED (SELECT * FROM v),
scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM numbered a JOIN numbered b ON a.vec_id % 20 = 0 AND a.r <> b.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {topk.K}"""


_SUBSTRING = rf"""
WITH listed AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD_PATTERN}'), []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {substring_dedup.WINDOW} + 2)) AS i FROM listed WHERE doc_id IS NOT NULL AND len(w) >= {substring_dedup.WINDOW}),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {substring_dedup.WINDOW} - 1], ' ')) AS passage FROM starts),
firsts AS (SELECT passage, min(doc_id) AS first FROM windows GROUP BY passage),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (passage) WHERE first < doc_id),
tokens AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM listed),
judged AS (
  SELECT t.doc_id, t.word, t.i,
         coalesce(t.i - max(h.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS UNBOUNDED PRECEDING) < {substring_dedup.WINDOW}, false) AS gone
  FROM tokens t LEFT JOIN hits h ON t.doc_id = h.doc_id AND t.i = h.i),
cut AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_words, 0)::BIGINT AS n_words, coalesce(c.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id"""

_JACCARD = rf"""
WITH RECURSIVE listed AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}'), []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {jaccard_join.WORDS} + 2))) AS i FROM listed WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + {jaccard_join.WORDS} - 1], ' ')) AS shingle FROM starts),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, '' ORDER BY shingle)) AS same FROM shingles GROUP BY doc_id),
members AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY same) AS rep FROM sets),
reps AS (SELECT s.doc_id, s.shingle, m.n FROM shingles s JOIN members m ON s.doc_id = m.doc_id AND m.rep = m.doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM reps a JOIN reps b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {jaccard_join.PERCENT} * (a.n + b.n - count(*))),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(id, low) AS (SELECT DISTINCT rep, rep FROM members UNION SELECT b.v, r.low FROM reach r JOIN ways b ON b.u = r.id WHERE b.v > r.low),
lowest AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_shingles, coalesce(l.low, d.doc_id) AS component_id
FROM documents d LEFT JOIN members m ON d.doc_id = m.doc_id LEFT JOIN lowest l ON l.id = m.rep"""

_COSINE = f"""
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
units AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS length FROM v),
ways AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.length * b.length) >= {cover_tree.COSINE}e0),
reach(id, low) AS (SELECT DISTINCT u, u FROM ways UNION SELECT b.v, r.low FROM reach r JOIN ways b ON b.u = r.id WHERE b.v > r.low),
lowest AS (SELECT id, min(low) AS low FROM reach GROUP BY id),
counts AS (SELECT u, count(*) AS n FROM ways GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.low, e.vec_id) AS component_id, e.vec_id = coalesce(l.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN lowest l ON l.id = e.vec_id"""


_LEXICAL = rf"""
WITH listed AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS MATERIALIZED (SELECT d, doc_id, terms, len(terms) AS n FROM listed WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM docs),
items AS MATERIALIZED (
  SELECT i, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
posts AS MATERIALIZED (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY d, doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM posts GROUP BY term) CROSS JOIN totals),
scores AS (
  SELECT i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms::BIGINT))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN posts USING (term) CROSS JOIN totals GROUP BY i, item_id, d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {lexical.K}"""

_IMPORTANCE = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
listed AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
found AS (SELECT d, unnest(w) AS word FROM listed),
wanted AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
vocabulary AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % {importance.BUCKETS} AS bucket
  FROM (SELECT word FROM found UNION SELECT word FROM wanted) CROSS JOIN crc),
per_document AS MATERIALIZED (SELECT d, bucket, count(*) AS n FROM found JOIN vocabulary USING (word) GROUP BY d, bucket),
source AS (SELECT bucket, sum(n)::BIGINT AS s FROM per_document GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN vocabulary USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM source), 0)::BIGINT AS big_s, coalesce((SELECT sum(t) FROM target), 0)::BIGINT AS big_t),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (big_s + {importance.BUCKETS}))::DOUBLE / ((s + 1) * (big_t + {importance.BUCKETS}))::DOUBLE))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket) CROSS JOIN sums),
weights AS (SELECT d, sum(n * gain)::BIGINT AS weight FROM per_document JOIN gains USING (bucket) GROUP BY d),
scored AS (
  SELECT d, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM listed LEFT JOIN weights USING (d)),
ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, d) AS nth FROM scored WHERE n_features >= {importance.LEAST_WORDS})
SELECT s.doc_id, s.n_features, s.weight, s.score,
       CASE WHEN o.nth <= (SELECT count(*) FROM ordered) * {importance.PERCENT} // 100 THEN o.nth END AS rank
FROM scored s LEFT JOIN ordered o USING (d)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": _LEXICAL, "op13_importance": _IMPORTANCE, "op2_substring_dedup": _SUBSTRING, "op4_jaccard": _JACCARD, "op5_mixing": _MIXING, "op6_cover_tree": _COSINE, "op7_warc": _WARC, "op8_topk": _TOPK}
