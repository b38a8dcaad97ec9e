"""Record linkage: hits to record nodes, edges, works, versions, crosswalk and registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import text as X
from evenkeel.operators.components import components
from evenkeel.operators.ordered import neighbours, number_rows
from evenkeel.operators.quality import domain
from evenkeel.plans.expansion import numbered, surrogate_ids

# Adjudication states, version order and edge bases.
SAME, DISTINCT, AMBIGUOUS = "MANUAL_CONFIRMED_SAME_WORK", "MANUAL_CONFIRMED_DISTINCT_WORKS", "AMBIGUOUS_UNRESOLVED"
TYPE_ORDER = ("JOURNAL_ARTICLE", "ARXIV_PREPRINT", "CONFERENCE_ABSTRACT", "OTHER")
BASES = {"DOI": "AUTO_EXACT_DOI", "ARXIV": "AUTO_EXACT_ARXIV"}
CROSSLINK = "AUTO_EXPLICIT_CROSSLINK"
PROVIDER = "AUTO_EXACT_PROVIDER_RECORD"


def node_name() -> Column:
    return F.concat_ws("|", "source", "record_id")


def record_nodes(hits: DataFrame) -> DataFrame:
    """One node per (source, record): attributes of its lowest hit, and its hit count.

    Hit lists stay in the crosswalk table; a record with very many hits is still one small row.
    """
    rest = [c for c in hits.columns if c not in ("source", "record_id", "raw_hit_id")]
    g = hits.groupBy("source", "record_id").agg(
        F.min_by(F.struct(*rest), "raw_hit_id").alias("_a"), F.min("raw_hit_id").alias("min_hit"),
        F.count(F.lit(1)).alias("hits"))
    return g.select(node_name().alias("node"), "source", "record_id", "min_hit", "hits", "_a.*")


def node_keys(hits: DataFrame) -> DataFrame:
    """Distinct (node, kind, key) from DOI lists, identifier fields and alternate codes."""
    dois = F.transform(X.listed(F.col("doi")), X.doi)
    journal = F.filter(dois, lambda d: (d != "") & ~F.startswith(d, F.lit(X.ARXIV_DOI)))
    ids = F.concat(
        F.transform(dois, lambda d: X.arxiv_id(X.arxiv_from_doi(d))),
        F.array(X.arxiv_id(F.coalesce("arxiv_raw", F.lit(""))),
                F.when(F.col("source") == "ARXIV", X.arxiv_id(F.col("record_id"))).otherwise("")),
        F.transform(X.listed(F.col("alternates")), X.arxiv_from_bibcode))
    pair = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    both = F.concat(F.transform(journal, pair("DOI")), F.transform(F.filter(ids, lambda i: i != ""), pair("ARXIV")))
    return hits.select(node_name().alias("node"), F.explode(both).alias("_k")).select("node", "_k.*").distinct()


def exact_key_edges(keys: DataFrame) -> DataFrame:
    """Chain the sorted members of every key: n - 1 edges, however many nodes share the key."""
    chain = neighbours(keys, ["kind", "key"], [F.col("node")], next={"right": F.col("node")})
    basis = F.when(F.col("kind") == "DOI", BASES["DOI"]).otherwise(BASES["ARXIV"])
    return chain.where("right is not null").select(F.col("node").alias("left"), "right", basis.alias("basis")).distinct()


def crosslink_edges(hits: DataFrame, nodes: DataFrame, source: str = "ADS_SCIX") -> DataFrame:
    """Edges to alternate records of the same source, where those are nodes themselves."""
    alt = hits.where(F.col("source") == source).select(
        node_name().alias("left"), F.explode(X.listed(F.col("alternates"))).alias("_a"))
    alt = alt.select("left", F.concat_ws("|", F.lit(source), "_a").alias("right")).distinct().where("left <> right")
    return alt.join(nodes.select(F.col("node").alias("right")), "right", "left_semi").select(
        "left", "right", F.lit(CROSSLINK).alias("basis"))


def manual_edges(adjudications: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of confirmed-same pairs, and violations for unknown states.

    ``adjudications(left_hit, right_hit, state)``. Distinct and ambiguous pairs add no edge.
    """
    at = hits.select("raw_hit_id", node_name().alias("_n"))
    pairs = adjudications.join(at.select(F.col("raw_hit_id").alias("left_hit"), F.col("_n").alias("left")), "left_hit")
    pairs = pairs.join(at.select(F.col("raw_hit_id").alias("right_hit"), F.col("_n").alias("right")), "right_hit")
    bad = domain(adjudications, "state", [SAME, DISTINCT, AMBIGUOUS], "adjudication_state")
    return pairs.select("left", "right", "state"), bad


def assign_works(nodes: DataFrame, edges: DataFrame, prefix: str = "W", width: int = 4) -> DataFrame:
    """``(node, work_id)``; works are numbered by the lowest hit of their component."""
    comp = components(nodes, edges)
    low = comp.join(nodes.select("node", "min_hit"), "node").groupBy("component").agg(F.min("min_hit").alias("min_hit"))
    ids = surrogate_ids(low, [F.col("min_hit")], prefix, width, "work_id")
    return comp.join(ids.select("component", "work_id"), "component").select("node", "work_id")


def representatives(nodes: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Node that holds the lowest hit of each group."""
    both = members.join(nodes, "node")
    rest = [c for c in nodes.columns if c != "node"]
    return both.groupBy(group).agg(F.min_by(F.struct("node", *rest), "min_hit").alias("_r")).select(group, "_r.*")


def _type_rank(vtype: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in TYPE_ORDER]), vtype)


def node_versions(nodes: DataFrame, keys: DataFrame, works: DataFrame) -> DataFrame:
    """``nodes`` with their work and the (``version_type``, ``ident``) of the version that they stand for.

    ``nodes`` carry ``pub, doctype, props, bibcode, public_date, latest_date, journal_ref``.
    """
    first = keys.groupBy("node").agg(
        F.min(F.when(F.col("kind") == "ARXIV", F.col("key"))).alias("arxiv"),
        F.min(F.when(F.col("kind") == "DOI", F.col("key"))).alias("jdoi"))
    n = nodes.join(works, "node").join(first, "node", "left")
    dois = F.when(F.col("jdoi").isNotNull(), F.array("jdoi")).otherwise(F.array().cast("array<string>"))
    n = n.withColumn("version_type", X.version_type(F.col("source"), F.col("pub"), F.col("doctype"), F.col("props"),
                                                    F.col("bibcode"), dois))
    other = F.coalesce(F.nullif(F.col("bibcode"), F.lit("")), F.col("record_id"))
    ident = (F.when(F.col("version_type") == "ARXIV_PREPRINT", F.coalesce("arxiv", X.arxiv_id(F.col("record_id"))))
             .when(F.col("version_type") == "JOURNAL_ARTICLE", F.coalesce(F.col("jdoi"), other)).otherwise(other))
    return n.withColumn("ident", ident)


def versions(n: DataFrame, keys: DataFrame) -> DataFrame:
    """Versions per work: real ones keyed by (type, identifier), and ones only implied by a link.

    ``n`` comes from :func:`node_versions`.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    refereed = F.coalesce(F.array_contains(F.transform("props", F.upper), "REFEREED"), F.lit(False))
    real = n.groupBy("work_id", "version_type", "ident").agg(
        F.min_by("title", "min_hit").alias("title"), F.min(blank("public_date")).alias("public_date"),
        F.max(blank("latest_date")).alias("latest_date"), F.bool_or(refereed).alias("_ref"))
    real = real.select("work_id", "version_type", "ident", "title", "public_date",
                       F.coalesce("latest_date", "public_date").alias("latest_date"),
                       X.peer_status(F.col("version_type"), F.col("_ref")).alias("peer_status"), F.lit(False).alias("implied"))
    at = ["work_id", "version_type", "ident"]
    linked = keys.join(n.select("node", "work_id", "source", "title", "min_hit", "journal_ref"), "node")
    pre = linked.where("kind = 'ARXIV'").groupBy("work_id", F.lit("ARXIV_PREPRINT").alias("version_type"),
                                                 F.col("key").alias("ident")).agg(F.min_by("title", "min_hit").alias("title"))
    month = F.nullif(X.arxiv_month(F.col("ident")), F.lit(""))
    pre = pre.select(*at, "title", month.alias("public_date"), month.alias("latest_date"), F.lit("PREPRINT").alias("peer_status"))
    jour = linked.where("kind = 'DOI' and source = 'ARXIV' and coalesce(journal_ref, '') <> ''").groupBy(
        "work_id", F.lit("JOURNAL_ARTICLE").alias("version_type"), F.col("key").alias("ident")).agg(
        F.min_by("title", "min_hit").alias("title"))
    none = F.lit(None).cast("string")
    jour = jour.select(*at, "title", none.alias("public_date"), none.alias("latest_date"),
                       F.lit("PUBLISHED_JOURNAL").alias("peer_status"))
    implied = pre.unionByName(jour).join(real.select(*at), at, "left_anti").withColumn("implied", F.lit(True))
    return real.unionByName(implied)


def resolve_versions(v: DataFrame) -> DataFrame:
    """Add first public date and latest date of the work, the preferred flag and its reason.

    Preferred: best type, real before implied, latest public date, latest date, last title; what is
    still tied goes to the smallest identifier. One map-side maximum per work decides it.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    merit = F.struct((-_type_rank(F.col("version_type"))).alias("a"), (~F.col("implied")).alias("b"),
                     blank(F.col("public_date")).alias("c"), blank(F.col("latest_date")).alias("d"), F.col("title").alias("e"))
    scored = v.withColumn("_m", merit)
    per = scored.groupBy("work_id").agg(F.max("_m").alias("_top"), F.min("public_date").alias("first_public_date"),
                                        F.max("latest_date").alias("work_latest_date"))
    out = scored.join(per, "work_id")
    lead = out.where("_m = _top").groupBy("work_id").agg(F.min(F.struct("version_type", "ident")).alias("_w"))
    out = out.join(lead, "work_id")
    pick = (F.col("_w.version_type") == F.col("version_type")) & (F.col("_w.ident") == F.col("ident"))
    why = (F.when(F.col("version_type") == "JOURNAL_ARTICLE", "journal version available")
           .when(F.col("version_type") == "ARXIV_PREPRINT", "latest available preprint version")
           .otherwise("only recoverable version"))
    return out.withColumns({"is_preferred": pick, "preferred_reason": F.when(pick, why).otherwise("")}).drop("_m", "_top", "_w")


def number_versions(resolved: DataFrame, prefix: str = "V", width: int = 4) -> DataFrame:
    """Add ``version_id``: one global order by work, public date (none last), type and identifier.

    The versions of a work have consecutive numbers, so ``version_no`` bounds them without listing them.
    """
    order = [F.length("work_id"), F.col("work_id"), F.coalesce("public_date", F.lit("9999")), _type_rank(F.col("version_type")), F.col("ident")]
    out = number_rows(resolved, [], order, "version_no")
    return out.withColumn("version_id", numbered(F.col("version_no"), prefix, width))


def hit_identifiers() -> dict[str, Column]:
    """First journal DOI and the arXiv id of a hit, both empty where it has none."""
    dois = F.transform(X.listed(F.col("doi")), X.doi)
    journal = F.filter(dois, lambda d: (d != "") & ~F.startswith(d, F.lit(X.ARXIV_DOI)))
    own = F.nullif(X.arxiv_id(F.coalesce("arxiv_raw", F.lit(""))), F.lit(""))
    linked = F.filter(F.transform(dois, lambda d: X.arxiv_id(X.arxiv_from_doi(d))), lambda i: i != "")
    record = F.when(F.col("source") == "ARXIV", X.arxiv_id(F.col("record_id")))
    none = F.lit("")
    return {"doi_normalized": F.coalesce(F.get(journal, F.lit(0)), none), "arxiv_normalized": F.coalesce(own, F.get(linked, F.lit(0)), record, none)}


def crosswalk(hits: DataFrame, placed: DataFrame, resolved: DataFrame, auto: DataFrame, manual: DataFrame) -> DataFrame:
    """Hit to work and version, with the bases that tie its node and the confidence.

    ``placed`` from :func:`node_versions`, ``resolved`` from :func:`number_versions`, ``auto(left, right, basis)``,
    ``manual(left, right, state)``. The version of a node is a real one, so versions that are only implied
    by a link have numbers of their own and no hits.
    """
    works = placed.select("node", "work_id", "version_type", "ident")
    ends = lambda e, c: e.select(F.col("left").alias("node"), c).unionByName(e.select(F.col("right").alias("node"), c)).distinct()
    basis = ends(auto, "basis").groupBy("node").agg(F.collect_set("basis").alias("_b"))
    state = ends(manual, "state").groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("state")), ";").alias("state"))
    merged = ends(manual.where(F.col("state") == SAME), "state").join(works, "node").select("work_id").distinct()
    at = ["work_id", "version_type", "ident"]
    numbers = resolved.select(*at, "version_id", F.col("is_preferred").alias("is_preferred_version"))
    out = (hits.select("raw_hit_id", node_name().alias("node"), *[c.alias(k) for k, c in hit_identifiers().items()])
           .join(works, "node").join(numbers, at).join(basis, "node", "left")
           .join(state, "node", "left").join(merged.withColumn("_same", F.lit(True)), "work_id", "left"))
    same = F.coalesce("_same", F.lit(False))
    base = F.array_append(F.coalesce("_b", F.array().cast("array<string>")), PROVIDER)
    bases = F.array_sort(F.when(same, F.array_append(base, SAME)).otherwise(base))
    return out.select("raw_hit_id", "node", "work_id", "version_id", "is_preferred_version", F.array_join(bases, ";").alias("mapping_basis"),
                      F.when(same, "HIGH_AFTER_MANUAL_ADJUDICATION").otherwise("HIGH").alias("confidence"),
                      (same | F.col("state").isNotNull()).alias("manual_required"),
                      F.coalesce("state", F.when(same, SAME), F.lit("")).alias("manual_state"), "doi_normalized", "arxiv_normalized")


def registry(walk: DataFrame, hits: DataFrame, resolved: DataFrame, prefix: str = "V", width: int = 4) -> DataFrame:
    """One row per work: lowest hit, counts, source and query sets, versions, preferred fields, dates.

    ``resolved`` from :func:`number_versions`; the list of a work's versions is written out of its first and last number.
    """
    h = walk.join(hits.select("raw_hit_id", "source", "query"), "raw_hit_id")
    states = F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("manual_state"), F.lit("")))), ";")
    # few kinds of bases: those of each hit are told apart by their text before they are split
    kinds = h.groupBy("work_id", "mapping_basis").agg(F.count(F.lit(1)).alias("_n")).groupBy("work_id").agg(
        F.array_join(F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_list(F.split("mapping_basis", ";")))), SAME)), ";").alias("mapping_bases"))
    g = h.groupBy("work_id").agg(
        F.min("raw_hit_id").alias("min_hit"), F.count(F.lit(1)).alias("hits"),
        F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("query")), ";").alias("queries"), states.alias("manual_states")).join(kinds, "work_id")
    best = resolved.where("is_preferred").select(
        "work_id", F.col("version_id").alias("preferred_version_id"), "title", "version_type", "ident", "peer_status", "first_public_date",
        F.col("work_latest_date").alias("latest_date"))
    n = resolved.groupBy("work_id").agg(F.count(F.lit(1)).alias("versions"), F.min("version_no").alias("_lo"), F.max("version_no").alias("_hi"))
    ids = F.array_join(F.transform(F.sequence("_lo", "_hi"), lambda i: numbered(i, prefix, width)), ";")
    status = F.when(F.contains(F.col("manual_states"), F.lit("AMBIGUOUS")), AMBIGUOUS).otherwise("RESOLVED")
    return (g.join(best, "work_id").join(n.withColumn("version_ids", ids).drop("_lo", "_hi"), "work_id").withColumn("resolution", status))


# --- consistency of screening and extraction ---------------------------------------------------

def screening_rules(decisions: DataFrame) -> DataFrame:
    """Violations of the rule that each screening outcome must satisfy.

    ``decisions(work_id, decision, inclusion, exclusion, evidence, full_text_required, notes)``.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    d = F.col("decision")
    rule = (F.when((d == "INCLUDE") & empty("inclusion"), "include_without_criterion")
            .when((d == "EXCLUDE") & ~F.startswith(F.coalesce("exclusion", F.lit("")), F.lit("E")), "exclude_without_criterion")
            .when((d == "BACKGROUND") & empty("evidence"), "background_without_justification")
            .when((d == "UNRESOLVED") & (~F.coalesce("full_text_required", F.lit(False)) | empty("notes")),
                  "unresolved_not_documented"))
    return decisions.select(rule.alias("rule"), F.col("work_id").cast("string").alias("key"), d.alias("detail")).where("rule is not null")


def identity_scaffold(screened: DataFrame, works: DataFrame, resolved: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Included works with their preferred version, blanks replaced by declared placeholders."""
    inc = screened.where("decision = 'INCLUDE'").select("work_id").distinct()
    best = resolved.where("is_preferred")
    out = inc.join(works.select("work_id", "min_hit"), "work_id").join(best, "work_id")
    return out.select("work_id", "min_hit", *[F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(d)).alias(c)
                                              for c, d in defaults.items()])


def evidence_checks(claims: DataFrame, evidence: DataFrame, dimensions: DataFrame, levels: Sequence[str] = ("DIRECT", "PARTIAL")) -> DataFrame:
    """Cited evidence must exist; an overlap level implies dimension rows; an impact implies references.

    ``claims(work_id, level, impact, evidence_ids)``, ``evidence(evidence_id)``, ``dimensions(work_id)``.
    """
    row = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), F.col("work_id").cast("string").alias("key"),
                                             detail.cast("string").alias("detail"))
    cited = claims.withColumn("evidence_id", F.explode(X.id_list(F.col("evidence_ids"))))
    unknown = cited.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")
    deep = claims.where(F.col("level").isin(*levels)).join(dimensions.select("work_id").distinct(), "work_id", "left_anti")
    bare = claims.where((F.col("impact") != "NO_DESIGN_IMPACT") & (F.size(X.id_list(F.col("evidence_ids"))) == 0))
    return (row(unknown, "unknown_evidence", F.col("evidence_id")).unionByName(row(deep, "overlap_without_dimension", F.col("level")))
            .unionByName(row(bare, "impact_without_reference", F.col("impact"))))
