"""The queries of this subpackage, one for each operator, over the whole of its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate, lines, negatives, packing, phrases, quality, simhash, substrings, tokencount, topk, urls, warc
from evenkeel.session import shared_dir
from evenkeel.suite.registry import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn
    return register


def token_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, installed alike on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def quality_scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; held-out ids are not learned from."""
    model = quality.fit(docs, labels.where(~held_out()))
    return (quality.score(docs, model).withColumn("held_out", held_out())
            .withColumn("predicted", (F.col("score") >= 0.3).cast("int")))


@query("op10_quality")
def _(t: Tables) -> DataFrame:
    return quality_scored(t.documents.select("doc_id", "text"), t.labels).select("doc_id", "held_out", "score", "predicted")


def packing_settings() -> packing.Packing:
    return packing.Packing(token_file())


@query("op6_packing")
def _(t: Tables) -> DataFrame:
    return packing.pack_digests(t.documents, packing_settings())


@query("op8_packed_ids")
def _(t: Tables) -> DataFrame:
    return packing.packed_matrix(t.documents, packing_settings())


@query("op1_token_counts")
def _(t: Tables) -> DataFrame:
    pieces = tokencount.sentencepiece_pieces(token_file("piece_bpe_32k.model"))
    return tokencount.token_counts(t.documents.select("doc_id", "text"), pieces).select("doc_id", "n_words", "n_tokens")


@query("op3_decontaminate", """
WITH lowered AS (
    SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
windows AS (
    SELECT DISTINCT id AS item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
    FROM lowered, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i) WHERE side = 'b' AND len(w) > 0),
places AS (
    SELECT id AS doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
    FROM lowered, (SELECT DISTINCT n FROM windows), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE side = 'd'),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS j) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT l.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit ON hit.doc_id = l.id LEFT JOIN named ON named.doc_id = l.id WHERE side = 'd'
""")
def _(t: Tables) -> DataFrame:
    return decontaminate.summary(decontaminate.hits(t.documents.select("doc_id", "text"), t.benchmark))


@query("op7_topk", """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def _(t: Tables) -> DataFrame:
    return topk.top_k(t.embeddings, F.col("vec_id") % 50 == 0)


@query("op2_simhash")
def _(t: Tables) -> DataFrame:
    return simhash.classes(t.documents)


#: The rules (verdict, host, path) of the URL query.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query("op5_url_filter")
def _(t: Tables) -> DataFrame:
    model = urls.fit(urls.default_labels(t.spark))
    return urls.judge(t.pages.select("page_id", "url"), model, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op4_line_dedup")
def _(t: Tables) -> DataFrame:
    return lines.dedup(t.documents.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS run FROM w, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS i)),
late AS (SELECT doc_id, i FROM runs JOIN (SELECT run, min(doc_id) AS least FROM runs GROUP BY run) USING (run) WHERE doc_id > least),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM late, LATERAL (SELECT unnest(generate_series(i, i + 49)) AS j) GROUP BY doc_id),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS words, count(*) AS n
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w) WHERE NOT EXISTS
        (SELECT 1 FROM (SELECT doc_id AS d, unnest(js) AS k FROM gone) WHERE d = doc_id AND k = j) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def _(t: Tables) -> DataFrame:
    return substrings.dedup(t.documents.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_hard_negatives", """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
    FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""")
def _(t: Tables) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(t.embeddings.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op12_collocations", """
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (
    SELECT lang, k AS len, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
f AS (SELECT lang, len, phrase, count(*)::BIGINT AS f FROM g GROUP BY 1, 2, 3),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND f >= 100),
kept AS (SELECT lang, len, phrase, f AS a, w FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c b WHERE b.lang = c.lang AND b.len > c.len AND 100 * b.f >= 100 * c.f AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
    SELECT kept.lang, kept.phrase, a, n, k, l.f AS l, r.f AS r, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM kept JOIN totals USING (lang), LATERAL (SELECT unnest(generate_series(1, len - 1)) AS k)
    JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM worst
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
""")
def _(t: Tables) -> DataFrame:
    return phrases.collocations(t.documents.select("lang", "text"))


@query("op13_warc", """
WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT h, max(page_id) AS last FROM d GROUP BY 1)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (j // 4)::INTEGER + 1, 5))::INTEGER >> (15 - 5 * (j % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d JOIN m USING (h)
""")
def _(t: Tables) -> DataFrame:
    index = warc.archive(t.pages, f"{shared_dir(t.spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    return warc.read_bundles(index, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
