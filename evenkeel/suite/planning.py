"""Queries on plans: splits, samples, expansion, resume, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evenkeel.operators import quality as K
from evenkeel.plans import expansion as E
from evenkeel.plans import sampling as P
from evenkeel.session import shared_dir
from evenkeel.sources.tables import append_results
from evenkeel.suite.registry import query

SPLIT_SQL = """split AS (SELECT o_orderpriority, o_orderkey, rn AS hash_rank, CASE WHEN rn * 2 <= n THEN 'DEVELOPMENT' ELSE 'HELDOUT' END AS split FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('v1:' || o_orderkey), o_orderkey) AS rn,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders))"""


def split(t):
    return P.hash_split(t.orders, "o_orderkey", ["o_orderpriority"], "v1")


@query("hash_split", "E5", f"WITH {SPLIT_SQL} SELECT * FROM split")
def _(t):
    return split(t)


@query("split_leakage", "K8 H6", f"""
WITH {SPLIT_SQL} SELECT 'split_leakage' AS rule, o_custkey::VARCHAR AS key, 'DEVELOPMENT|HELDOUT' AS detail
FROM split JOIN orders USING (o_orderkey) GROUP BY o_custkey HAVING count(DISTINCT split) > 1""")
def _(t):
    rows = split(t).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return K.leakage(rows, "o_custkey", "split")


@query("split_contamination", "C18 H6", f"""
WITH {SPLIT_SQL}, c AS (SELECT o_custkey, split.split FROM split JOIN orders USING (o_orderkey))
SELECT o_custkey FROM c WHERE split = 'DEVELOPMENT' INTERSECT SELECT o_custkey FROM c WHERE split = 'HELDOUT'""")
def _(t):
    rows = split(t).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    side = lambda s: rows.where(F.col("split") == s).select("o_custkey")
    return side("DEVELOPMENT").intersect(side("HELDOUT"))


@query("key_set_difference", "H6 C18", """
SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25""")
def _(t):
    used = t.lineitem.where("l_returnflag = 'R' and l_quantity > 25").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return t.part.select("p_partkey").exceptAll(used)


WANTED = [("O", "1-URGENT"), ("O", "3-MEDIUM"), ("F", "2-HIGH"), ("P", "5-LOW"), ("P", "9-NONE")]


def decisions(t):
    """Orders as planned decisions: status as role, priority as window, price in whole units as length."""
    return t.orders.select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_orderstatus").alias("role"), F.col("o_orderpriority").alias("window"),
        F.floor("o_totalprice").cast("bigint").alias("length"), F.col("o_custkey").alias("event_id"))


DEC_SQL = """dec AS (SELECT o_orderkey AS decision_id, o_orderstatus AS role, o_orderpriority AS "window", floor(o_totalprice)::BIGINT AS length, o_custkey AS event_id FROM orders),
cov AS (SELECT * FROM dec WHERE (role, "window") IN (('O', '1-URGENT'), ('O', '3-MEDIUM'), ('F', '2-HIGH'), ('P', '5-LOW'), ('P', '9-NONE'))
  QUALIFY row_number() OVER (PARTITION BY role, "window" ORDER BY event_id, decision_id) = 1)"""


def coverage(t):
    return P.coverage_sample(decisions(t), ["role", "window"], WANTED, ["role", "window"], ["event_id", "decision_id"])


@query("coverage_sample", "E6", f"""WITH {DEC_SQL} SELECT * FROM cov""")
def _(t):
    return coverage(t)


@query("coverage_gaps", "E6", """
SELECT 'coverage' AS rule, role || '|' || "window" AS key, 'no row' AS detail
FROM (VALUES ('O', '1-URGENT'), ('O', '3-MEDIUM'), ('F', '2-HIGH'), ('P', '5-LOW'), ('P', '9-NONE')) w(role, "window")
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = role AND o_orderpriority = "window")""")
def _(t):
    return P.coverage_gaps(decisions(t), WANTED, ["role", "window"])


@query("extremes_sample", "E7", f"""
WITH {DEC_SQL}, a AS (SELECT * FROM dec WHERE decision_id NOT IN (SELECT decision_id FROM cov)),
s AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY role ORDER BY length, decision_id) = 1),
l AS (SELECT * FROM a WHERE decision_id NOT IN (SELECT decision_id FROM s) QUALIFY row_number() OVER (PARTITION BY role ORDER BY length DESC, decision_id) = 1)
SELECT *, 'SHORTEST' AS component FROM s UNION ALL SELECT *, 'LONGEST' FROM l""")
def _(t):
    return P.extremes_sample(decisions(t), ["role"], "length", "decision_id", coverage(t))


@query("anchor_sample", "E8", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS seed, l_partkey FROM lineitem
WHERE l_linenumber IN (1, 6) AND l_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_orderstatus, o_orderpriority)""")
def _(t):
    anchors = P.first_rows(t.orders.select("o_orderstatus", "o_orderpriority", "o_orderkey"), ["o_orderstatus", "o_orderpriority"],
                           [F.col("o_orderkey")]).select(F.col("o_orderkey").alias("l_orderkey"))
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("seed"), "l_partkey")
    return P.anchor_sample(anchors, rows, "l_orderkey", (1, 6))


PLAN_SQL = """d AS (SELECT o_orderkey AS decision, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS ord FROM orders),
plan AS (SELECT 'D' || lpad(ord::VARCHAR, 6, '0') AS decision_id, decision, ord AS decision_order, model, CAST((ord - 1) * 3 + i AS BIGINT) AS job_order,
  decision || ':' || model AS job_id FROM d, (VALUES ('M0', 1), ('M1', 2), ('M2', 3)) m(model, i))"""


def plan(t):
    base = t.orders.select(F.col("o_orderkey").alias("decision"), "o_custkey")
    ids = E.surrogate_ids(base, [F.col("o_custkey"), F.col("decision")], "D", 6, "decision_id")
    ids = ids.withColumn("decision_order", F.substring("decision_id", 2, 20).cast("bigint")).drop("o_custkey")
    return E.plan_jobs(ids).withColumn("job_id", F.concat_ws(":", F.col("decision").cast("string"), "model"))


@query("decision_plan", "H5 E4", f"WITH {PLAN_SQL} SELECT * FROM plan")
def _(t):
    return plan(t)


@query("decision_union", "H4", """
SELECT o_orderkey AS decision, 'PRIMARY' AS class, 0::BIGINT AS seed FROM orders
UNION ALL SELECT o_orderkey, 'STABILITY', seed FROM orders, range(1, 10) r(seed) WHERE o_orderpriority = '1-URGENT'""")
def _(t):
    first = t.orders.select(F.col("o_orderkey").alias("decision"), F.lit("PRIMARY").alias("class"), F.lit(0).cast("bigint").alias("seed"))
    more = t.orders.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("decision"), F.lit("STABILITY").alias("class"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(9).cast("bigint"))).alias("seed"))
    return first.unionByName(more)


def done(p):
    return p.where(F.col("decision") % 4 == 0).select("job_id", F.col("decision").cast("double").alias("score"))


@query("pending_jobs", "A8 C18", f"WITH {PLAN_SQL} SELECT job_id, job_order FROM plan WHERE decision % 4 <> 0")
def _(t):
    p = plan(t)
    return E.pending(p, done(p)).select("job_id", "job_order")


@query("next_jobs", "H2 A8", f"WITH {PLAN_SQL} SELECT job_id, job_order FROM plan WHERE decision % 4 <> 0 ORDER BY job_order LIMIT 100")
def _(t):
    p = plan(t)
    return E.next_jobs(p, done(p), 100).select("job_id", "job_order")


@query("resumed_append", "A8", f"""
WITH {PLAN_SQL} SELECT CAST(count(*) FILTER (WHERE decision % 4 = 0) AS BIGINT) AS before, CAST(count(*) FILTER (WHERE decision % 4 = 2) AS BIGINT) AS new,
  CAST(count(*) FILTER (WHERE decision % 2 = 0) AS BIGINT) AS after, CAST(count(*) FILTER (WHERE decision % 2 = 1) AS BIGINT) AS pending FROM plan""")
def _(t):
    p = plan(t)
    path = f"{shared_dir(t.spark)}/results-{uuid.uuid4().hex}"
    append_results(p, done(p), path)
    fresh = p.where(F.col("decision") % 2 == 0).select("job_id", F.lit(1.0).alias("score"))
    fresh = fresh.unionByName(fresh).unionByName(t.spark.createDataFrame([("unplanned", 2.0)], "job_id string, score double"))
    counts = append_results(p, fresh, path)
    return t.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} bigint" for k in counts))


@query("blinded_plan", "H8", """
SELECT doc_id, lang FROM documents JOIN labels USING (doc_id)""")
def _(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return E.blinded(rows, ["quality", "toxic"])


@query("surrogate_ids", "E4", """
SELECT event_id, 'E' || lpad((row_number() OVER (ORDER BY user_id, ts, event_id))::VARCHAR, 6, '0') AS phase_id FROM events""")
def _(t):
    out = E.surrogate_ids(t.events.select("event_id", "user_id", "ts"), [F.col("user_id"), F.col("ts"), F.col("event_id")], "E", 6, "phase_id")
    return out.select("event_id", "phase_id")
