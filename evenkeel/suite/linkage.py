"""Queries on records: normalisers, nodes, edges, components, versions, checks, hit pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import text as X
from evenkeel.operators import linkage as G
from evenkeel.operators import summaries as S
from evenkeel.operators.components import components
from evenkeel.session import materialize
from evenkeel.sources import pages as P
from evenkeel.suite.registry import query

FIRST_LINE = F.split_part


def hits(t):
    """Documents as raw hits: two per record, copies share a DOI, some records link to others."""
    g = F.floor(F.col("doc_id") / 2).cast("bigint")
    gs = g.cast("string")
    is_pre = g % 3 == 0
    code = F.concat(F.lit("10.1/"), F.substring(F.md5("text"), 1, 12))
    return t.documents.select(
        F.format_string("H%09d", "doc_id").alias("raw_hit_id"), F.when(is_pre, "ARXIV").otherwise("ADS_SCIX").alias("source"),
        F.when(is_pre, F.concat(F.lit("2101."), F.lpad(gs, 5, "0"), F.lit("v2"))).otherwise(F.concat(F.lit("R"), gs)).alias("record_id"),
        F.col("lang").alias("query"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit('["https://doi.org/'), code, F.lit('"]')).alias("doi"),
        F.when(g % 7 == 1, F.concat(F.lit("arXiv:2101."), F.lpad((g - 1).cast("string"), 5, "0"))).otherwise("").alias("arxiv_raw"),
        F.when(g % 5 == 1, F.concat(F.lit('["R'), (g + 3).cast("string"), F.lit('"]'))).otherwise("").alias("alternates"),
        F.when(g % 4 == 1, F.lit("Annual Meeting")).when(g % 4 == 2, F.lit("VizieR")).otherwise("source").alias("pub"),
        F.when(g % 11 == 0, "proposal").otherwise("article").alias("doctype"),
        F.when(g % 2 == 0, F.array(F.lit("Refereed"))).otherwise(F.array().cast("array<string>")).alias("props"),
        F.lit("").alias("bibcode"), F.when(g % 6 == 0, F.lit("J. 1")).otherwise("").alias("journal_ref"),
        F.concat(F.lit("20"), F.lpad((g % 20).cast("string"), 2, "0"), F.lit("-03-00")).alias("raw_date"),
    ).withColumns({"public_date": X.clean_date(F.col("raw_date")), "latest_date": X.clean_date(F.col("raw_date"))})


HITS_SQL = r"""hits AS (
  SELECT printf('H%09d', doc_id) AS raw_hit_id, CASE WHEN g % 3 = 0 THEN 'ARXIV' ELSE 'ADS_SCIX' END AS source,
    CASE WHEN g % 3 = 0 THEN '2101.' || lpad(g::VARCHAR, 5, '0') || 'v2' ELSE 'R' || g END AS record_id, lang AS query,
    split_part(text, chr(10), 1) AS title, '10.1/' || substr(md5(text), 1, 12) AS doi,
    CASE WHEN g % 7 = 1 THEN '2101.' || lpad((g - 1)::VARCHAR, 5, '0') END AS arxiv_raw,
    CASE WHEN g % 5 = 1 THEN 'R' || (g + 3) END AS alternate,
    CASE g % 4 WHEN 1 THEN 'annual meeting' WHEN 2 THEN 'vizier' ELSE 'source' END AS pub,
    CASE WHEN g % 11 = 0 THEN 'proposal' ELSE 'article' END AS doctype, g % 2 = 0 AS refereed, g % 6 = 0 AS journal,
    '20' || lpad((g % 20)::VARCHAR, 2, '0') || '-03' AS public_date
  FROM (SELECT *, doc_id // 2 AS g FROM documents)),
h AS (SELECT *, source || '|' || record_id AS node FROM hits),
nodes AS (SELECT node, source, record_id, min(raw_hit_id) AS min_hit, count(*) AS n_hits, arg_min(title, raw_hit_id) AS title,
  any_value(pub) AS pub, any_value(doctype) AS doctype, any_value(refereed) AS refereed, any_value(journal) AS journal,
  any_value(public_date) AS public_date FROM h GROUP BY 1, 2, 3),
keys AS (SELECT node, 'DOI' AS kind, doi AS key FROM h UNION SELECT node, 'ARXIV', arxiv_raw FROM h WHERE arxiv_raw IS NOT NULL
  UNION SELECT node, 'ARXIV', regexp_replace(record_id, 'v[0-9]+$', '') FROM h WHERE source = 'ARXIV'),
kedges AS (SELECT node AS l, lead(node) OVER (PARTITION BY kind, key ORDER BY node) AS r,
  CASE kind WHEN 'DOI' THEN 'AUTO_EXACT_DOI' ELSE 'AUTO_EXACT_ARXIV' END AS basis FROM keys),
xedges AS (SELECT DISTINCT h.node AS l, n.node AS r, 'AUTO_EXPLICIT_CROSSLINK' AS basis FROM h JOIN nodes n ON n.node = 'ADS_SCIX|' || h.alternate
  WHERE h.source = 'ADS_SCIX' AND h.node <> n.node),
edges AS (SELECT DISTINCT l, r, basis FROM kedges WHERE r IS NOT NULL UNION SELECT * FROM xedges)"""

REACH_SQL = """{name} AS (
  WITH RECURSIVE b AS (SELECT l, r FROM {edges} UNION SELECT r, l FROM {edges}),
  reach(node, m) AS (SELECT node, node FROM nodes UNION SELECT b.r, reach.m FROM reach JOIN b ON b.l = reach.node)
  SELECT node, min(m) AS component FROM reach GROUP BY 1)"""

COMP_SQL = "WITH " + HITS_SQL + ", " + REACH_SQL.format(name="comp", edges="edges")


def graph(t):
    h = materialize(hits(t))
    n = G.record_nodes(h)
    keys = G.node_keys(h)
    edges = G.exact_key_edges(keys).unionByName(G.crosslink_edges(h, n))
    return h, n, keys, edges


@query("record_nodes", "G1", f"WITH {HITS_SQL} SELECT node, min_hit, CAST(n_hits AS BIGINT) AS hits, title FROM nodes")
def _(t):
    return G.record_nodes(hits(t)).select("node", "min_hit", "hits", "title")


@query("node_keys", "G1 B16 B17 B20", f"WITH {HITS_SQL} SELECT node, kind, key FROM keys")
def _(t):
    return G.node_keys(hits(t))


@query("exact_key_edges", "G2", f"WITH {HITS_SQL} SELECT DISTINCT l AS \"left\", r AS \"right\", basis FROM kedges WHERE r IS NOT NULL")
def _(t):
    return G.exact_key_edges(G.node_keys(hits(t)))


@query("crosslink_edges", "G3", f"WITH {HITS_SQL} SELECT l AS \"left\", r AS \"right\", basis FROM xedges")
def _(t):
    h = hits(t)
    return G.crosslink_edges(h, G.record_nodes(h))


@query("linked_components", "G4", f"{COMP_SQL} SELECT node, component FROM comp")
def _(t):
    _, n, _, edges = graph(t)
    return components(n, edges)


@query("component_representatives", "E13", f"""{COMP_SQL}
SELECT component, arg_min(node, min_hit) AS node, min(min_hit) AS min_hit FROM comp JOIN nodes USING (node) GROUP BY 1""")
def _(t):
    _, n, _, edges = graph(t)
    return G.representatives(n, components(n, edges), "component").select("component", "node", "min_hit")


def manual(t, h):
    ids = t.documents.where("doc_id % 50 = 0 or doc_id % 50 = 20").select("doc_id")
    state = (F.when(F.col("doc_id") % 50 == 20, G.DISTINCT).when(F.col("doc_id") % 150 == 0, G.AMBIGUOUS).otherwise(G.SAME))
    pairs = ids.select(F.format_string("H%09d", "doc_id").alias("left_hit"), F.format_string("H%09d", F.col("doc_id") + 12).alias("right_hit"),
                       state.alias("state"))
    return G.manual_edges(pairs, h)[0]


MANUAL_SQL = f"""WITH {HITS_SQL}, man AS (
  SELECT a.node AS l, b.node AS r, CASE WHEN d.doc_id % 50 = 20 THEN 'MANUAL_CONFIRMED_DISTINCT_WORKS' WHEN d.doc_id % 150 = 0 THEN 'AMBIGUOUS_UNRESOLVED'
    ELSE 'MANUAL_CONFIRMED_SAME_WORK' END AS state
  FROM documents d JOIN h a ON a.raw_hit_id = printf('H%09d', d.doc_id) JOIN h b ON b.raw_hit_id = printf('H%09d', d.doc_id + 12)
  WHERE d.doc_id % 50 IN (0, 20)),
alledges AS (SELECT l, r FROM edges UNION SELECT l, r FROM man WHERE state = 'MANUAL_CONFIRMED_SAME_WORK'),
{REACH_SQL.format(name="comp", edges="alledges")},
works AS (SELECT node, 'W' || lpad((dense_rank() OVER (ORDER BY low))::VARCHAR, 4, '0') AS work_id FROM (
  SELECT node, min(min_hit) OVER (PARTITION BY component) AS low FROM comp JOIN nodes USING (node)))"""


def works(t):
    h, n, keys, edges = graph(t)
    man = manual(t, h)
    all_edges = edges.select("left", "right").unionByName(man.where(F.col("state") == G.SAME).select("left", "right"))
    return h, n, keys, edges, man, materialize(G.assign_works(n, all_edges))


@query("manual_overlay_works", "G5 G6 E4", f"{MANUAL_SQL} SELECT node, work_id FROM works")
def _(t):
    return works(t)[-1]


@query("adjudication_states", "G5 K4", """
SELECT 'adjudication_state' AS rule, CASE WHEN doc_id % 3 = 0 THEN 'MAYBE' ELSE 'UNSURE' END AS key, count(*)::VARCHAR AS detail
FROM documents WHERE doc_id % 3 < 2 GROUP BY 2""")
def _(t):
    pairs = t.documents.select(F.format_string("H%09d", "doc_id").alias("left_hit"), F.format_string("H%09d", "doc_id").alias("right_hit"),
                               F.when(F.col("doc_id") % 3 == 0, "MAYBE").when(F.col("doc_id") % 3 == 1, "UNSURE").otherwise(G.SAME).alias("state"))
    return G.manual_edges(pairs, hits(t))[1]


VERSIONS_SQL = MANUAL_SQL + """, firsts AS (SELECT node, min(key) FILTER (WHERE kind = 'ARXIV') AS arxiv, min(key) FILTER (WHERE kind = 'DOI') AS jdoi FROM keys GROUP BY 1),
n1 AS (SELECT *, CASE WHEN source = 'ARXIV' THEN 'ARXIV_PREPRINT' WHEN pub = 'vizier' THEN 'OTHER' WHEN pub = 'annual meeting' THEN 'CONFERENCE_ABSTRACT'
   WHEN doctype = 'proposal' THEN 'OTHER' ELSE 'JOURNAL_ARTICLE' END AS version_type FROM nodes JOIN works USING (node) JOIN firsts USING (node)),
n2 AS (SELECT *, CASE version_type WHEN 'ARXIV_PREPRINT' THEN arxiv WHEN 'JOURNAL_ARTICLE' THEN jdoi ELSE record_id END AS ident FROM n1),
real AS (SELECT work_id, version_type, ident, arg_min(title, min_hit) AS title, min(public_date) AS public_date, max(public_date) AS latest_date,
   CASE version_type WHEN 'JOURNAL_ARTICLE' THEN CASE WHEN bool_or(refereed) THEN 'PEER_REVIEWED' ELSE 'PUBLISHED_JOURNAL' END
     WHEN 'ARXIV_PREPRINT' THEN 'PREPRINT' WHEN 'CONFERENCE_ABSTRACT' THEN 'NOT_PEER_REVIEWED' ELSE 'NOT_APPLICABLE' END AS peer_status, false AS implied
   FROM n2 GROUP BY 1, 2, 3),
cand AS (SELECT work_id, 'ARXIV_PREPRINT' AS version_type, key AS ident, arg_min(title, min_hit) AS title, '2021-01' AS public_date, '2021-01' AS latest_date, 'PREPRINT' AS peer_status
   FROM keys JOIN n2 USING (node) WHERE kind = 'ARXIV' GROUP BY 1, 2, 3
  UNION ALL SELECT work_id, 'JOURNAL_ARTICLE', key, arg_min(title, min_hit), NULL, NULL, 'PUBLISHED_JOURNAL' FROM keys JOIN n2 USING (node)
   WHERE kind = 'DOI' AND source = 'ARXIV' AND journal GROUP BY 1, 2, 3),
vers AS (SELECT * FROM real UNION ALL SELECT *, true FROM cand c WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.work_id = c.work_id AND r.version_type = c.version_type AND r.ident = c.ident)),
ranked AS (SELECT *, 'V' || lpad((row_number() OVER (ORDER BY length(work_id), work_id, coalesce(public_date, '9999'),
     CASE version_type WHEN 'JOURNAL_ARTICLE' THEN 1 WHEN 'ARXIV_PREPRINT' THEN 2 WHEN 'CONFERENCE_ABSTRACT' THEN 3 ELSE 4 END, ident))::VARCHAR, 4, '0') AS version_id,
   min(public_date) OVER w AS first_public_date, max(latest_date) OVER w AS work_latest_date,
   row_number() OVER (PARTITION BY work_id ORDER BY CASE version_type WHEN 'JOURNAL_ARTICLE' THEN 1 WHEN 'ARXIV_PREPRINT' THEN 2 WHEN 'CONFERENCE_ABSTRACT' THEN 3 ELSE 4 END,
     implied, coalesce(public_date, '') DESC, coalesce(latest_date, '') DESC, title DESC, ident) = 1 AS is_preferred
   FROM vers WINDOW w AS (PARTITION BY work_id))"""


@query("work_versions", "G7 B21 B22 E11 E12", f"""{VERSIONS_SQL}
SELECT work_id, version_type, ident, title, public_date, latest_date, peer_status, implied, first_public_date, work_latest_date, is_preferred, version_id FROM ranked""")
def _(t):
    return resolved(works(t))[1].drop("preferred_reason", "version_no")


WALK_SQL = VERSIONS_SQL + """, ends AS (SELECT l AS node, basis FROM edges UNION SELECT r, basis FROM edges),
mends AS (SELECT l AS node, state FROM man UNION SELECT r, state FROM man),
same AS (SELECT DISTINCT work_id FROM mends JOIN works USING (node) WHERE state = 'MANUAL_CONFIRMED_SAME_WORK'),
autob AS (SELECT node, basis FROM ends UNION ALL SELECT node, 'AUTO_EXACT_PROVIDER_RECORD' FROM nodes),
bs AS (SELECT node, basis FROM autob UNION SELECT node, 'MANUAL_CONFIRMED_SAME_WORK' FROM works JOIN same USING (work_id)),
walk AS (SELECT h.raw_hit_id, h.node, h.source, h.query, w.work_id, r.version_id, r.is_preferred AS is_preferred_version,
  h.doi AS doi_normalized, coalesce(h.arxiv_raw, CASE WHEN h.source = 'ARXIV' THEN regexp_replace(h.record_id, 'v[0-9]+$', '') END, '') AS arxiv_normalized,
  s.work_id IS NOT NULL OR h.node IN (SELECT node FROM mends) AS manual_required, coalesce((SELECT string_agg(basis, ';' ORDER BY basis) FROM bs WHERE bs.node = h.node), '') AS mapping_basis,
  CASE WHEN s.work_id IS NOT NULL THEN 'HIGH_AFTER_MANUAL_ADJUDICATION' ELSE 'HIGH' END AS confidence,
  coalesce((SELECT string_agg(state, ';' ORDER BY state) FROM mends WHERE mends.node = h.node), CASE WHEN s.work_id IS NOT NULL THEN 'MANUAL_CONFIRMED_SAME_WORK' END, '') AS manual_state
  FROM h JOIN works w USING (node) JOIN n2 ON n2.node = h.node JOIN ranked r ON r.work_id = n2.work_id AND r.version_type = n2.version_type AND r.ident = n2.ident
  LEFT JOIN same s ON s.work_id = w.work_id)"""


def resolved(parts):
    """Nodes with their version, and the numbered versions of every work, written once."""
    _, n, keys, _, _, w = parts
    placed = materialize(G.node_versions(n, keys, w))
    return placed, materialize(G.number_versions(G.resolve_versions(G.versions(placed, keys))))


@query("hit_crosswalk", "G8", f"""{WALK_SQL}
SELECT raw_hit_id, node, work_id, version_id, is_preferred_version, mapping_basis, confidence, manual_required, manual_state, doi_normalized, arxiv_normalized FROM walk""")
def _(t):
    parts = works(t)
    h, _, _, edges, man, _ = parts
    return G.crosswalk(h, *resolved(parts), edges, man)


@query("work_registry", "G9", f"""{WALK_SQL}, states AS (
  SELECT work_id, string_agg(DISTINCT manual_state, ';' ORDER BY manual_state) AS manual_states FROM walk WHERE manual_state <> '' GROUP BY 1),
kinds AS (SELECT work_id, string_agg(DISTINCT basis, ';' ORDER BY basis) AS mapping_bases FROM autob JOIN works USING (node) GROUP BY 1),
g AS (SELECT work_id, min(raw_hit_id) AS min_hit, CAST(count(*) AS BIGINT) AS hits, string_agg(DISTINCT source, ';' ORDER BY source) AS sources,
  string_agg(DISTINCT query, ';' ORDER BY query) AS queries FROM walk GROUP BY 1),
vids AS (SELECT work_id, CAST(count(*) AS BIGINT) AS versions, string_agg(version_id, ';' ORDER BY version_id) AS version_ids FROM ranked GROUP BY 1)
SELECT g.*, mapping_bases, coalesce(manual_states, '') AS manual_states, r.version_id AS preferred_version_id, r.title, r.version_type, r.ident, r.peer_status, r.first_public_date,
  r.work_latest_date AS latest_date, versions, version_ids,
  CASE WHEN contains(coalesce(manual_states, ''), 'AMBIGUOUS') THEN 'AMBIGUOUS_UNRESOLVED' ELSE 'RESOLVED' END AS resolution
FROM g LEFT JOIN states USING (work_id) JOIN kinds USING (work_id) JOIN vids USING (work_id) JOIN ranked r ON r.work_id = g.work_id AND r.is_preferred""")
def _(t):
    parts = works(t)
    h, _, _, edges, man, _ = parts
    placed, numbers = resolved(parts)
    return G.registry(G.crosswalk(h, placed, numbers, edges, man), h, numbers)


def screening(t):
    d = F.col("doc_id")
    return t.documents.select(
        d.alias("work_id"), F.when(d % 4 == 0, "INCLUDE").when(d % 4 == 1, "EXCLUDE").when(d % 4 == 2, "BACKGROUND").otherwise("UNRESOLVED").alias("decision"),
        F.when(d % 3 == 0, "I1").otherwise(" ").alias("inclusion"), F.when(d % 5 == 0, "X").otherwise("E2").alias("exclusion"),
        F.when(d % 7 == 0, F.lit(None).cast("string")).otherwise("quoted").alias("evidence"), (d % 2 == 1).alias("full_text_required"),
        F.when(d % 9 == 0, "").otherwise("no copy").alias("notes"))


@query("screening_rules", "G10", """
SELECT * FROM (SELECT CASE WHEN d % 4 = 0 AND d % 3 <> 0 THEN 'include_without_criterion' WHEN d % 4 = 1 AND d % 5 = 0 THEN 'exclude_without_criterion'
  WHEN d % 4 = 2 AND d % 7 = 0 THEN 'background_without_justification' WHEN d % 4 = 3 AND d % 9 = 0 THEN 'unresolved_not_documented' END AS rule,
  d::VARCHAR AS key, CASE d % 4 WHEN 0 THEN 'INCLUDE' WHEN 1 THEN 'EXCLUDE' WHEN 2 THEN 'BACKGROUND' ELSE 'UNRESOLVED' END AS detail
FROM (SELECT doc_id AS d FROM documents)) WHERE rule IS NOT NULL""")
def _(t):
    return G.screening_rules(screening(t))


@query("screening_outcomes", "G10", """
SELECT CASE doc_id % 4 WHEN 0 THEN 'INCLUDE' WHEN 1 THEN 'EXCLUDE' WHEN 2 THEN 'BACKGROUND' ELSE 'UNRESOLVED' END AS decision, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1""")
def _(t):
    return screening(t).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("identity_scaffold", "G11", f"""{VERSIONS_SQL}, low AS (SELECT work_id, min(min_hit) AS min_hit FROM works JOIN nodes USING (node) GROUP BY 1)
SELECT work_id, min_hit, coalesce(nullif(trim(title), ''), 'NOT_REPORTED') AS title, coalesce(public_date, 'NOT_REPORTED') AS public_date, ident
FROM ranked JOIN low USING (work_id) WHERE is_preferred AND right(work_id, 1) IN ('0', '5')""")
def _(t):
    parts = works(t)
    n, w = parts[1], parts[-1]
    low = w.join(n, "node").groupBy("work_id").agg(F.min("min_hit").alias("min_hit"))
    inc = low.select("work_id", F.when(F.col("work_id").rlike("[05]$"), "INCLUDE").otherwise("EXCLUDE").alias("decision"))
    return G.identity_scaffold(inc, low, resolved(parts)[1],
                               {"title": "NOT_REPORTED", "public_date": "NOT_REPORTED", "ident": "NOT_APPLICABLE"})


@query("evidence_checks", "G12", """
WITH c AS (SELECT doc_id AS w, CASE doc_id % 3 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'PARTIAL' ELSE 'NONE' END AS level,
  CASE WHEN doc_id % 4 = 0 THEN 'REVISE' ELSE 'NO_DESIGN_IMPACT' END AS impact,
  CASE WHEN doc_id % 8 = 0 THEN 'NONE' ELSE 'B' || (doc_id % 50) || ';B' || (doc_id % 7) END AS ids FROM documents),
x AS (SELECT w, unnest(string_split(ids, ';')) AS e FROM c)
SELECT 'unknown_evidence' AS rule, w::VARCHAR AS key, e AS detail FROM x WHERE e <> 'NONE' AND e NOT IN (SELECT 'B' || item_id FROM benchmark)
UNION ALL SELECT 'overlap_without_dimension', w::VARCHAR, level FROM c WHERE level <> 'NONE' AND w NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'impact_without_reference', w::VARCHAR, impact FROM c WHERE impact <> 'NO_DESIGN_IMPACT' AND ids = 'NONE'""")
def _(t):
    d = F.col("doc_id")
    ids = F.when(d % 8 == 0, "NONE").otherwise(F.concat(F.lit("B"), (d % 50).cast("string"), F.lit(";B"), (d % 7).cast("string")))
    claims = t.documents.select(d.alias("work_id"), F.when(d % 3 == 0, "DIRECT").when(d % 3 == 1, "PARTIAL").otherwise("NONE").alias("level"),
                                F.when(d % 4 == 0, "REVISE").otherwise("NO_DESIGN_IMPACT").alias("impact"), ids.alias("evidence_ids"))
    evidence = t.benchmark.select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("evidence_id"))
    return G.evidence_checks(claims, evidence, t.labels.select(F.col("doc_id").alias("work_id")))


@query("corpus_counts", "D27", f"""WITH {HITS_SQL}
SELECT source, query, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT record_id) AS BIGINT) AS records
FROM hits GROUP BY GROUPING SETS ((source), (query), (source, query))""")
def _(t):
    return S.corpus_counts(hits(t))


# --- result pages ------------------------------------------------------------------------------

PAGE = 20


def json_pages(t):
    """Documents packed into provider pages of 20, one JSON text per page."""
    doc = F.struct(F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("bibcode"), F.array("source").alias("title"),
                   F.array("lang").alias("author"), F.lit("2020-01-00").alias("pubdate"), F.col("text").alias("abstract"))
    rows = t.documents.select(F.col("lang").alias("query"), F.floor(F.col("doc_id") / PAGE).cast("bigint").alias("page"), "doc_id", doc.alias("d"))
    packed = rows.groupBy("query", "page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "d"))).alias("a"))
    body = F.to_json(F.struct(F.struct(F.transform("a", lambda x: x["d"]).alias("docs")).alias("response")))
    return packed.select("query", "page", body.alias("body"))


PAGES_SQL = f"""p AS (SELECT *, doc_id // {PAGE} AS page, CAST(row_number() OVER (PARTITION BY lang, doc_id // {PAGE} ORDER BY doc_id) - 1 AS BIGINT) AS pos FROM documents)"""


@query("json_page_hits", "A4", f"""WITH {PAGES_SQL}
SELECT lang AS query, page, CAST(pos AS INT) AS pos, 'R' || doc_id AS record_id, source AS title, '["' || lang || '"]' AS authors, '2020-01-00' AS source_date,
  text <> '' AS abstract_available, sha256(text) AS abstract_sha256, 'response.docs[' || pos || ']' AS locator FROM p""")
def _(t):
    return P.json_hits(json_pages(t)).select("query", "page", "pos", "record_id", "title", "authors", "source_date",
                                             "abstract_available", "abstract_sha256", "locator")


def atom_pages(t):
    esc = F.replace(F.replace("source", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<entry><id>http://x.org/abs/"), F.col("doc_id").cast("string"), F.lit("</id><published>2020-01-02T00:00:00Z</published><title>  "),
                     esc, F.lit("\n  title</title><summary>s</summary><author><name>"), F.col("lang"),
                     F.lit("</name></author><author><name>Second</name></author><arxiv:doi>10.1/x</arxiv:doi></entry>"))
    rows = t.documents.select(F.col("lang").alias("query"), F.floor(F.col("doc_id") / PAGE).cast("bigint").alias("page"), "doc_id", entry.alias("e"))
    packed = rows.groupBy("query", "page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "e"))).alias("a"))
    return packed.select("query", "page", F.concat(F.lit("<feed>"), F.array_join(F.transform("a", lambda x: x["e"]), ""), F.lit("</feed>")).alias("body"))


@query("atom_page_hits", "A5", f"""WITH {PAGES_SQL}
SELECT lang AS query, page, CAST(pos AS INT) AS pos, doc_id::VARCHAR AS record_id, source || ' title' AS title, '["' || lang || '","Second"]' AS authors,
  '10.1/x' AS doi, 'feed/entry[' || (pos + 1) || ']' AS locator FROM p""")
def _(t):
    return P.atom_hits(atom_pages(t)).select("query", "page", "pos", "record_id", "title", "authors", "doi", "locator")


@query("hit_ledger", "A6 E4", f"""WITH {PAGES_SQL}
SELECT lang AS query, 'R' || doc_id AS record_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY page, pos) AS BIGINT) AS source_rank,
  'H' || lpad((row_number() OVER (ORDER BY lang, page, pos))::VARCHAR, 6, '0') AS raw_hit_id FROM p""")
def _(t):
    return P.ledger(P.json_hits(json_pages(t))).select("query", "record_id", "source_rank", "raw_hit_id")


@query("receipt_reconciliation", "D29", f"""WITH {PAGES_SQL}
SELECT lang AS query, CAST(count(*) - (CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS BIGINT) AS reported, CAST(count(*) AS BIGINT) AS actual,
  'R' || arg_min(doc_id, doc_id) AS first_record, 'R' || max(doc_id) AS last_record, CASE WHEN lang = 'fr' THEN 'PARTIAL' ELSE 'COMPLETE' END AS state FROM p GROUP BY lang""")
def _(t):
    rec = t.documents.groupBy(F.col("lang").alias("query")).agg(F.count(F.lit(1)).alias("n"))
    rec = rec.select("query", (F.col("n") - F.when(F.col("query") == "fr", 1).otherwise(0)).alias("reported"))
    return P.receipt_check(rec, P.ledger(P.json_hits(json_pages(t))))


# No SQL twin: the ratio has no SQL form; a brute-force loop checks it in the tests.
@query("fuzzy_titles", "C19", None)
def _(t):
    from evenkeel.operators.fuzzy import fuzzy_candidates, profiles

    nodes = t.documents.select(F.format_string("H%09d", "doc_id").alias("node"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                               F.col("source").alias("author"), F.col("lang").alias("year"))
    out = fuzzy_candidates(profiles(nodes))
    return out.select("left", "right", "left_nodes", "right_nodes", F.round("similarity", 6).alias("similarity"), "basis")
