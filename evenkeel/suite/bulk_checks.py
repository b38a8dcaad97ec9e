"""Queries for reconciliation, replay, fingerprints, profiles, and every data check."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators import joins as J
from evenkeel.operators import quality as K
from evenkeel.session import shared_dir
from evenkeel.sources import tables as S
from evenkeel.suite import inputs as I
from evenkeel.suite.registry import query


def edited(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    change = F.col("o_orderkey") % 97 == 0
    return o.where("o_orderkey % 101 <> 0").withColumns({
        "o_orderstatus": F.when(change, "X").otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(change, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 1e-9)})


EDIT_SQL = """r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice + 1e-9 END AS o_totalprice FROM orders WHERE o_orderkey % 101 <> 0)"""


@query("reconcile_copies", "C20", f"""
WITH {EDIT_SQL}, j AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, l.o_orderkey IS NOT NULL AS a, r.o_orderkey IS NOT NULL AS b,
  l.o_orderstatus AS ls, r.o_orderstatus AS rs, l.o_totalprice AS lp, r.o_totalprice AS rp
  FROM orders l FULL JOIN r ON l.o_orderkey = r.o_orderkey)
SELECT o_orderkey, '*row*' AS field, CASE WHEN a THEN 'present' END AS "left", CASE WHEN b THEN 'present' END AS "right" FROM j WHERE NOT (a AND b)
UNION ALL SELECT o_orderkey, 'o_orderstatus', ls, rs FROM j WHERE a AND b AND ls <> rs
UNION ALL SELECT o_orderkey, 'o_totalprice', NULL, NULL FROM j WHERE a AND b AND abs(lp - rp) > 1e-6""")
def _(t):
    out = J.reconcile(t.orders, edited(t), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice"], tol=1e-6)
    # Number text differs between engines; the pair of values is shown for text fields only.
    shown = lambda c: F.when(F.col("field") != "o_totalprice", F.col(c)).alias(c)
    return out.select("o_orderkey", "field", shown("left"), shown("right"))


@query("replay_diff", "C21", f"""
WITH {EDIT_SQL}
SELECT l.o_orderkey, concat_ws('|', CASE WHEN l.o_orderstatus <> r.o_orderstatus THEN 'o_orderstatus' END,
  CASE WHEN l.o_totalprice <> r.o_totalprice THEN 'o_totalprice' END) AS differing,
  l.o_orderstatus = r.o_orderstatus AND l.o_totalprice = r.o_totalprice AS exact
FROM orders l JOIN r ON l.o_orderkey = r.o_orderkey""")
def _(t):
    return J.replay_diff(t.orders, edited(t), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice"])


@query("variant_invariance", "C22", f"""
WITH {I.FITS_SQL}, p(a, b) AS (VALUES (0, 1), (2, 3), (4, 4)),
r AS (SELECT series_id % 5 AS v, seed, model, sum(score) AS s, CAST(sum(warnings) AS BIGINT) AS w FROM fits GROUP BY ALL)
SELECT p.a || '=' || p.b AS definition, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE x.s = y.s AND x.w = y.w) AS BIGINT) AS passed, bool_and(x.s = y.s AND x.w = y.w) AS invariant
FROM p JOIN r x ON x.v = p.a JOIN r y ON y.v = p.b AND x.seed = y.seed AND x.model = y.model GROUP BY 1""")
def _(t):
    r = I.fits(t).groupBy((F.col("series_id") % 5).cast("string").alias("v"), "seed", "model").agg(
        F.sum("score").alias("s"), F.sum("warnings").alias("w"))
    return J.variant_invariance(r, "v", [("0", "1"), ("2", "3"), ("4", "4")], ["seed", "model"], ["s", "w"])


@query("foreign_key_orphans", "K2 C18", """
SELECT 'foreign_key' AS rule, l_partkey::VARCHAR AS key, count(*)::VARCHAR AS detail FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY l_partkey""")
def _(t):
    return K.foreign_key(t.lineitem, t.part.where("p_size > 5"), ["l_partkey"], ["p_partkey"])


@query("unique_key_check", "K1", """
SELECT 'unique_key' AS rule, l_orderkey || '|' || l_linenumber AS key, count(*)::VARCHAR AS detail FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _(t):
    return K.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("row_count_check", "K3", """
SELECT 'row_count' AS rule, '' AS key, count(*)::VARCHAR AS detail FROM nation HAVING count(*) <> 24""")
def _(t):
    return K.expected_rows(t.nation, 24)


@query("group_topology", "K3", """
SELECT 'group_rows' AS rule, o_custkey::VARCHAR AS key, count(*)::VARCHAR AS detail FROM orders GROUP BY o_custkey HAVING count(*) <> 10""")
def _(t):
    return K.group_topology(t.orders, ["o_custkey"], 10)


@query("domain_check", "K4", """
SELECT 'domain' AS rule, o_orderpriority AS key, count(*)::VARCHAR AS detail FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_orderpriority""")
def _(t):
    return K.domain(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("finite_check", "K7", """
SELECT 'finite' AS rule, x.doc_id::VARCHAR AS key, 'ratio' AS detail FROM documents x LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NULL OR l.quality = 0""")
def _(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    ratio = F.when(F.col("quality") == 0, F.lit(float("inf"))).otherwise(F.col("n_chars") / F.col("quality"))
    return K.finite(rows.withColumn("ratio", ratio), ["ratio"], ["doc_id"])


@query("row_fingerprints", "K6", """
SELECT p_partkey, sha256(concat_ws(chr(31), p_brand, p_name, p_partkey::VARCHAR, CAST(round(p_retailprice * 100) AS BIGINT)::VARCHAR, p_size::VARCHAR, p_type)) AS fingerprint FROM part""")
def _(t):
    return K.row_fingerprint(t.part.withColumn("p_retailprice", F.round(F.col("p_retailprice") * 100).cast("bigint"))).select("p_partkey", "fingerprint")


@query("source_inventory", "A3 K6", """
WITH f AS (
  SELECT 'nation' AS "table", concat_ws(chr(31), n_name, n_nationkey::VARCHAR, n_regionkey::VARCHAR) AS x, 3 AS c FROM nation
  UNION ALL SELECT 'benchmark', concat_ws(chr(31), item_id::VARCHAR, text), 2 FROM benchmark
  UNION ALL SELECT 'labels', concat_ws(chr(31), doc_id::VARCHAR, quality::VARCHAR, toxic::VARCHAR), 3 FROM labels
  UNION ALL SELECT 'conversations', concat_ws(chr(31), conv_id::VARCHAR, role, text, turn::VARCHAR), 4 FROM conversations)
SELECT "table", CAST(count(*) AS BIGINT) AS row_count, CAST(max(c) AS BIGINT) AS column_count,
  sum(('0x' || substr(sha256(x), 1, 13))::BIGINT::HUGEINT)::VARCHAR AS content_sum FROM f GROUP BY 1""")
def _(t):
    return S.inventory({n: getattr(t, n) for n in ("nation", "benchmark", "labels", "conversations")})


@query("column_profile", "A2", r"""
WITH u AS (
  SELECT 'part' AS "table", 1 AS column_order, 'p_partkey' AS "column", p_partkey::VARCHAR AS x FROM part
  UNION ALL SELECT 'part', 2, 'p_name', p_name FROM part UNION ALL SELECT 'part', 3, 'p_brand', p_brand FROM part
  UNION ALL SELECT 'part', 4, 'p_type', p_type FROM part UNION ALL SELECT 'part', 5, 'p_size', p_size::VARCHAR FROM part
  UNION ALL SELECT 'part', 6, 'p_retailprice', p_retailprice::VARCHAR FROM part
  UNION ALL SELECT 'orders', 1, 'o_orderkey', o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT 'orders', 2, 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'orders', 3, 'blank', '' FROM orders)
SELECT "table", column_order, "column", CASE WHEN count(*) FILTER (WHERE trim(x) <> '') = 0 THEN 'empty'
  WHEN bool_and(regexp_full_match(trim(x), '[+-]?[0-9]+')) THEN 'integer'
  WHEN bool_and(regexp_full_match(trim(x), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN 'decimal' ELSE 'string' END AS type
FROM u GROUP BY 1, 2, 3""")
def _(t):
    return S.profile_types({"part": t.part, "orders": t.orders.select("o_orderkey", "o_orderpriority", F.lit("").alias("blank"))})


CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("active", T.BooleanType())])


@query("typed_scan", "A1 A7", """
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal > 0 END AS active FROM customer""")
def _(t):
    k = F.col("c_custkey")
    text = t.customer.select(
        k.cast("string").alias("c_custkey"), F.when(k % 7 != 0, F.col("c_name")).otherwise("  ").alias("c_name"),
        F.when(k % 5 != 0, F.col("c_acctbal").cast("string")).otherwise("NaN").alias("c_acctbal"),
        F.when(k % 3 == 0, "").when(F.col("c_acctbal") > 0, "True").otherwise("FALSE").alias("active"))
    path = f"{shared_dir(t.spark)}/scan-{uuid.uuid4().hex}"
    text.write.option("header", True).csv(path)
    return S.scan(t.spark, path, CUSTOMER)


@query("published_table", "A7 H1", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders""")
def _(t):
    path = f"{shared_dir(t.spark)}/table-{uuid.uuid4().hex}"
    S.write_table(t.orders, path, ["o_orderkey", "o_custkey", "o_orderstatus"],
                  ["o_custkey", "o_orderkey"])
    return t.spark.read.parquet(path)


@query("contiguous_ranks", "E15", """
SELECT 'contiguous_ranks' AS rule, l_orderkey::VARCHAR AS key, count(*) || '|' || min(l_linenumber) || '|' || max(l_linenumber) || '|' || count(DISTINCT l_linenumber) AS detail
FROM lineitem GROUP BY l_orderkey
HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*))""")
def _(t):
    return K.contiguous_ranks(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("three_copy_reconciliation", "C20", f"""
WITH {EDIT_SQL}, j AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS k, l.o_orderkey IS NOT NULL AS a, r.o_orderkey IS NOT NULL AS b,
   l.o_orderstatus <> r.o_orderstatus AS d FROM orders l FULL JOIN r ON l.o_orderkey = r.o_orderkey)
SELECT 'second' AS copy, CASE WHEN a AND b THEN 'o_orderstatus' ELSE '*row*' END AS field, CAST(count(*) AS BIGINT) AS n FROM j WHERE NOT (a AND b) OR d GROUP BY 1, 2
UNION ALL SELECT 'third', 'o_orderstatus', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderkey % 89 = 0""")
def _(t):
    fields = ["o_custkey", "o_orderstatus"]
    third = t.orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 89 == 0, "Z").otherwise(F.col("o_orderstatus")))
    parts = [J.reconcile(t.orders, c, ["o_orderkey"], fields).select(F.lit(n).alias("copy"), "field")
             for n, c in (("second", edited(t)), ("third", third))]
    return parts[0].unionByName(parts[1]).groupBy("copy", "field").agg(F.count(F.lit(1)).alias("n"))
