"""Queries on column expressions: bounds, warnings, identifiers, dates, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import labels as L
from evenkeel.functions import numeric as N
from evenkeel.functions import text as X
from evenkeel.suite.decisions import rounded
from evenkeel.suite.registry import query


@query("bound_inspection", "B13", """
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('|', CASE WHEN l_quantity = 1 THEN '0:lower' END, CASE WHEN l_quantity = 50 THEN '0:upper' END,
  CASE WHEN abs(l_discount - 0.1) <= 1e-7 THEN '1:upper' END, CASE WHEN l_tax = 0 THEN '2:lower' END) AS hits
FROM lineitem WHERE l_quantity IN (1, 50) OR abs(l_discount - 0.1) <= 1e-7 OR l_tax = 0""")
def _(t):
    hits = N.bound_hits([F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")], [(1.0, 50.0), (None, 0.1), (0.0, None)])
    text = F.array_join(F.transform(hits, lambda h: F.concat(h["parameter_index"].cast("string"), F.lit(":"), h["side"])), "|")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("hits")).where("hits <> ''")


@query("warning_types", "B14", """
WITH w AS (SELECT l_orderkey, CASE WHEN l_discount > 0.05 THEN 'RuntimeWarning: discount' ELSE 'UserWarning: none' END AS w FROM lineitem)
SELECT l_orderkey, CAST(count(*) AS INT) AS warning_count, '["' || string_agg(DISTINCT w, '","' ORDER BY w) || '"]' AS warning_types FROM w GROUP BY 1""")
def _(t):
    high = F.col("l_discount") > 0.05
    e = F.struct(F.when(high, "RuntimeWarning").otherwise("UserWarning").alias("category"),
                 F.when(high, "discount").otherwise("none").alias("message"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(e).alias("e"))
    return rows.select("l_orderkey", *[c.alias(a) for a, c in L.warning_types(F.col("e")).items()])


@query("period_from_center", "B15", "SELECT l_orderkey, l_linenumber, round(1 / exp(-3.5 - l_tax * 10), 5) AS period FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             F.round(N.period_from_log_frequency(-3.5 - F.col("l_tax") * 10), 5).alias("period"))


@query("period_errors", "B12", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity - 25, 5) AS signed_error, round(abs(l_quantity - 25), 5) AS absolute_error,
  round(abs(l_quantity - 25) / 25, 5) AS relative_error, round(100 * abs(l_quantity - 25) / 25, 5) AS relative_error_percent, round(ln(l_quantity / 25), 5) AS log_ratio FROM lineitem""")
def _(t):
    e = N.period_errors(F.col("l_quantity"), F.lit(25.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 5).alias(a) for a, c in e.items()])


def urls(t):
    d = F.col("page_id")
    form = (F.when(d % 4 == 0, F.concat(F.lit(" https://doi.org/10.1000/P"), d.cast("string"), F.lit(". ")))
            .when(d % 4 == 1, F.concat(F.lit("doi: 10.48550/arXiv.2101."), F.lpad((d % 100000).cast("string"), 5, "0")))
            .when(d % 4 == 2, F.concat(F.lit("http://dx.doi.org/10.5/x"), d.cast("string"), F.lit(";,")))
            .otherwise(F.lit("")))
    return t.pages.select("page_id", form.alias("raw"))


URL_SQL = """u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' https://doi.org/10.1000/P' || page_id || '. ' WHEN 1 THEN 'doi: 10.48550/arXiv.2101.' || lpad((page_id % 100000)::VARCHAR, 5, '0')
  WHEN 2 THEN 'http://dx.doi.org/10.5/x' || page_id || ';,' ELSE '' END AS raw FROM pages),
n AS (SELECT page_id, rtrim(regexp_replace(lower(trim(raw)), '^\\s*(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), ' .;,') AS doi FROM u)"""


@query("doi_normaliser", "B16", f"""
WITH {URL_SQL} SELECT page_id, doi, starts_with(doi, '10.48550/arxiv.') AS is_arxiv,
  CASE WHEN starts_with(doi, '10.48550/arxiv.') THEN substr(doi, 16) ELSE '' END AS arxiv FROM n""".replace("\\\\", "\\"))
def _(t):
    r = F.col("raw")
    return urls(t).select("page_id", X.doi(r).alias("doi"), X.is_arxiv_doi(r).alias("is_arxiv"), X.arxiv_from_doi(r).alias("arxiv"))


@query("arxiv_normaliser", "B17", r"""
WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://arxiv.org/abs/' WHEN 1 THEN 'arXiv: ' ELSE 'https://arxiv.org/PDF/' END
  || lpad((page_id % 100)::VARCHAR, 2, '0') || '07.' || lpad((page_id % 100000)::VARCHAR, 5, '0') || CASE page_id % 3 WHEN 2 THEN '.pdf' ELSE 'v' || (page_id % 9) END AS raw,
  lpad((page_id % 100)::VARCHAR, 2, '0') AS yy, page_id % 100 AS y, lpad((page_id % 100000)::VARCHAR, 5, '0') AS num FROM pages)
SELECT page_id, yy || '07.' || num AS arxiv, CASE WHEN y < 90 THEN '20' ELSE '19' END || yy || '-07' AS month, yy || '07.' || num AS from_bibcode FROM u""")
def _(t):
    d = F.col("page_id")
    yy, num = F.lpad((d % 100).cast("string"), 2, "0"), F.lpad((d % 100000).cast("string"), 5, "0")
    head = F.when(d % 3 == 0, "http://arxiv.org/abs/").when(d % 3 == 1, "arXiv: ").otherwise("https://arxiv.org/PDF/")
    tail = F.when(d % 3 == 2, ".pdf").otherwise(F.concat(F.lit("v"), (d % 9).cast("string")))
    raw = F.concat(head, yy, F.lit("07."), num, tail)
    bib = F.concat(F.lit("20"), yy, F.lit("arXiv"), yy, F.lit("07"), num, F.lit("Q"))
    ident = X.arxiv_id(raw)
    return t.pages.select("page_id", ident.alias("arxiv"), X.arxiv_month(ident).alias("month"), X.arxiv_from_bibcode(bib).alias("from_bibcode"))


@query("title_normaliser", "B18", """
SELECT doc_id, sha256(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS title_key FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.sha2(X.title(F.col("text")), 256).alias("title_key"))


@query("author_fields", "B19 B20", """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE lang END AS first_author,
  CASE doc_id % 3 WHEN 0 THEN upper(lang) || ', A.; ' || source WHEN 1 THEN upper(lang) || ', A.; ' || source ELSE '' END AS authors,
  CAST(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS listed FROM documents""")
def _(t):
    d = F.col("doc_id")
    name = F.concat(F.upper("lang"), F.lit(", A."))
    raw = (F.when(d % 3 == 0, F.to_json(F.array(name, F.col("source")))).when(d % 3 == 1, F.concat(name, F.lit("; "), F.col("source"))).otherwise(""))
    return t.documents.select("doc_id", X.first_author(raw).alias("first_author"), X.authors_text(raw).alias("authors"), F.size(X.listed(raw)).alias("listed"))


@query("version_types", "B21", """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'ARXIV' ELSE 'ADS_SCIX' END AS s, doc_id % 9 AS p, doc_id % 7 AS d, doc_id % 2 = 0 AS ref FROM documents),
v AS (SELECT doc_id, ref, CASE WHEN s = 'ARXIV' OR p = 0 THEN 'ARXIV_PREPRINT' WHEN p = 1 OR d = 0 THEN 'OTHER' WHEN d = 1 OR p = 2 THEN 'CONFERENCE_ABSTRACT'
  WHEN d = 2 THEN 'OTHER' WHEN ref THEN 'JOURNAL_ARTICLE' ELSE 'OTHER' END AS version_type FROM r)
SELECT doc_id, version_type, CASE version_type WHEN 'JOURNAL_ARTICLE' THEN CASE WHEN ref THEN 'PEER_REVIEWED' ELSE 'PUBLISHED_JOURNAL' END
  WHEN 'ARXIV_PREPRINT' THEN 'PREPRINT' WHEN 'CONFERENCE_ABSTRACT' THEN 'NOT_PEER_REVIEWED' ELSE 'NOT_APPLICABLE' END AS peer_status FROM v""")
def _(t):
    d = F.col("doc_id")
    ref = d % 2 == 0
    vt = X.version_type(
        F.when(d % 10 == 0, "ARXIV").otherwise("ADS_SCIX"),
        F.when(d % 9 == 0, "arXiv e-prints").when(d % 9 == 1, "VizieR Online").when(d % 9 == 2, "Proc. Symposium").otherwise("Journal"),
        F.when(d % 7 == 0, "dataset").when(d % 7 == 1, "abstract").when(d % 7 == 2, "software").otherwise("article"),
        F.when(ref, F.array(F.lit("refereed"))).otherwise(F.array().cast("array<string>")), F.lit(""), F.array().cast("array<string>"))
    return t.documents.select("doc_id", vt.alias("version_type"), X.peer_status(vt, ref).alias("peer_status"))


@query("partial_dates", "B22", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS cleaned FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    f = lambda p: F.date_format("o_orderdate", p)
    raw = (F.when(k % 3 == 0, F.concat(f("yyyy-MM-dd"), F.lit("T00:00:00Z"))).when(k % 3 == 1, F.concat(f("yyyy-MM"), F.lit("-00")))
           .otherwise(F.concat(f("yyyy"), F.lit("-00-00"))))
    return t.orders.select("o_orderkey", X.clean_date(raw).alias("cleaned"))


@query("product_names", "B23", """
SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber <> 7 AND l_suppkey % 2 = 0 AS exact FROM lineitem""")
def _(t):
    shown = F.when(F.col("l_linenumber") == 7, 1).otherwise(F.col("l_linenumber"))
    name = F.concat(F.lit("tess-"), F.format_string("s%04d-", shown.cast("int")), F.format_string("%016d-", "l_partkey"),
                    F.when(F.col("l_suppkey") % 2 == 0, "a_fast-lc.fits").otherwise("a_lc.fits"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.is_product_name(name, F.col("l_linenumber"), F.col("l_partkey")).alias("exact"))


@query("version_keys", "B24", """
SELECT p_partkey, [p_size::BIGINT, p_partkey % 10, 3, 0, 0, 0, 0, 0]::VARCHAR AS version_key FROM part""")
def _(t):
    v = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("-rc3"))
    return t.part.select("p_partkey", F.concat(F.lit("["), F.array_join(F.transform(X.version_key(v), lambda x: x.cast("string")), ", "), F.lit("]")).alias("version_key"))


@query("time_metadata", "B30", """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'OFFSET_UNREADABLE' WHEN s_suppkey % 5 = 1 THEN 'TIMESYS=UTC' WHEN s_suppkey % 5 = 2 THEN 'OFFSET=2450000.0'
  WHEN s_suppkey % 5 = 3 THEN 'TIMEUNIT=s' ELSE 'COMPATIBLE' END AS state FROM supplier""")
def _(t):
    k = F.col("s_suppkey") % 5
    state = L.time_metadata_state(F.when(k == 0, F.lit(None).cast("double")).when(k == 2, 2450000.0).otherwise(2457000.0),
                                  F.when(k == 1, "UTC").otherwise("tdb"), F.when(k == 3, "s").otherwise("Day"))
    return t.supplier.select("s_suppkey", state.alias("state"))


@query("safe_ratios", "B31 B5 K7", """
SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0)::DOUBLE, 4) AS mean_closed FROM orders GROUP BY 1""")
def _(t):
    closed = F.col("o_orderstatus") == "F"
    g = t.orders.groupBy("o_custkey").agg(F.sum(F.when(closed, F.col("o_totalprice"))).alias("s"), F.count_if(closed).alias("n"))
    return rounded(g.select("o_custkey", N.safe_ratio(F.col("s"), F.col("n")).alias("mean_closed")), "mean_closed", digits=4)
