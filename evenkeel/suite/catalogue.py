"""Queries on the catalogue: lookups, range joins, nearest samples, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import numeric as N
from evenkeel.functions import text as X
from evenkeel.operators import joins as J
from evenkeel.operators import matching as M
from evenkeel.operators import quality as K
from evenkeel.plans import sampling as P
from evenkeel.suite.decisions import rounded
from evenkeel.suite.registry import query

DAY = 86_400_000_000


def day(c: str):
    return (N.epoch_micros(F.col(c)) / F.lit(DAY)).cast("double")


DAY_SQL = "epoch_us({c}) / 86400000000.0::DOUBLE"


@query("parent_lookup", "C1", """
SELECT l_orderkey, l_linenumber, o_custkey, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE, 6) AS residual_days
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def _(t):
    child = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", day("l_shipdate").alias("ship"))
    parent = t.orders.select("o_orderkey", "o_custkey", day("o_orderdate").alias("ordered"))
    good, _ = J.unique_lookup(child, parent, ["o_orderkey"])
    return good.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_custkey",
                       F.round(F.col("ship") - F.col("ordered"), 6).alias("residual_days"))


@query("lookup_violations", "C1 K2", """
SELECT 'lookup' AS rule, k::VARCHAR AS key,
  CASE WHEN p.n IS NULL THEN 'missing_parent|' ELSE 'ambiguous_parent|' END || c.n AS detail
FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) c
LEFT JOIN (SELECT l_suppkey * 7 AS k, count(DISTINCT l_linenumber || l_returnflag) AS n FROM lineitem WHERE l_quantity = 50 GROUP BY 1) p USING (k)
WHERE p.n IS NULL OR p.n > 1""")
def _(t):
    child = t.lineitem.select(F.col("l_partkey").alias("k"))
    parent = t.lineitem.where("l_quantity = 50").select(
        (F.col("l_suppkey") * 7).alias("k"), F.concat("l_linenumber", "l_returnflag").alias("v")).distinct()
    return J.unique_lookup(child, parent, ["k"])[1]


QUARTERS_SQL = """q AS (
  SELECT lo, lead(lo) OVER (ORDER BY lo) AS hi, part FROM (
    SELECT min(epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS lo, year(o_orderdate) * 10 + quarter(o_orderdate) AS part
    FROM orders GROUP BY year(o_orderdate) * 10 + quarter(o_orderdate)))"""


def quarters(t):
    part = (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).cast("bigint").alias("part")
    return t.orders.groupBy(part).agg(F.min(day("o_orderdate")).alias("lo"))


def shipped(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", day("l_shipdate").alias("t"))


@query("partition_join", "C2", f"""
WITH {QUARTERS_SQL}
SELECT l_orderkey, l_linenumber, part, least(t - lo, hi - t) AS margin
FROM (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) / 86400000000.0::DOUBLE AS t FROM lineitem) l
LEFT JOIN q ON t >= lo AND t < hi""")
def _(t):
    return J.partition_join(shipped(t), quarters(t), "t", "lo", "part").drop("t")


@query("partition_violations", "C2", f"""
WITH {QUARTERS_SQL}
SELECT CAST(count(*) AS BIGINT) AS outside FROM (SELECT epoch_us(l_shipdate) / 86400000000.0::DOUBLE AS t FROM lineitem) l
LEFT JOIN q ON t >= lo AND t < hi WHERE part IS NULL""")
def _(t):
    out = J.partition_join(shipped(t), quarters(t), "t", "lo", "part")
    return out.where("part is null").agg(F.count(F.lit(1)).alias("outside"))


CONTACTS_SQL = """c AS (
  SELECT min(epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS s, min(epoch_us(o_orderdate)) / 86400000000.0::DOUBLE + 60 AS e,
         year(o_orderdate) * 10 + quarter(o_orderdate) AS part FROM orders GROUP BY 3)"""


@query("containment_join", "C3", f"""
WITH {CONTACTS_SQL}
SELECT o_orderkey, CAST(count(part) AS BIGINT) AS matches, CASE WHEN count(part) = 1 THEN max(part) END AS part
FROM (SELECT o_orderkey, epoch_us(o_orderdate) / 86400000000.0::DOUBLE AS t FROM orders) o LEFT JOIN c ON t BETWEEN s AND e GROUP BY 1""")
def _(t):
    contact = quarters(t).select("part", F.col("lo").alias("s"), (F.col("lo") + 60).alias("e"))
    events = t.orders.select("o_orderkey", day("o_orderdate").alias("t"))
    return J.containment_join(events, contact, ["o_orderkey"], "t", "s", "e", "part").drop("t")


@query("partition_crosscheck", "C2 C3", f"""
WITH {CONTACTS_SQL}, {QUARTERS_SQL}, x AS (
  SELECT q.part AS a, c.part AS b FROM (SELECT epoch_us(o_orderdate) / 86400000000.0::DOUBLE AS t FROM orders) o
  LEFT JOIN q ON t >= q.lo AND t < q.hi LEFT JOIN c ON t BETWEEN c.s AND c.e)
SELECT CASE WHEN b IS NULL THEN 'PARTITION_ONLY' WHEN a = b THEN 'CONFIRMED' ELSE 'DISAGREES' END AS evidence,
  CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1""")
def _(t):
    q = quarters(t)
    contact = q.select("part", F.col("lo").alias("s"), (F.col("lo") + 60).alias("e"))
    events = t.orders.select("o_orderkey", day("o_orderdate").alias("t"))
    a = J.partition_join(events, q, "t", "lo", "part").select("o_orderkey", F.col("part").alias("a"))
    b = J.containment_join(events, contact, ["o_orderkey"], "t", "s", "e", "part").select("o_orderkey", F.col("part").alias("b"))
    kind = (F.when(F.col("b").isNull(), "PARTITION_ONLY").when(F.col("a") == F.col("b"), "CONFIRMED").otherwise("DISAGREES"))
    return a.join(b, "o_orderkey").groupBy(kind.alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


MARKS_SQL = """m AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id, event_id AS idx, epoch_us(ts) / 1e6::DOUBLE AS t FROM events WHERE event_type = 'view')"""


def marks(t):
    ev = t.events.select("user_id", "event_id", (N.epoch_micros(F.col("ts")) / 1e6).alias("t"), "event_type")
    return (ev.where("event_type = 'purchase'").drop("event_type"),
            ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("idx"), "t"))


@query("nearest_sample", "C4", f"""
WITH {MARKS_SQL}
SELECT m.user_id, m.event_id, first(s.idx ORDER BY abs(s.t - m.t), s.idx) AS idx,
  round(first(s.t - m.t ORDER BY abs(s.t - m.t), s.idx), 4) AS residual
FROM m JOIN s ON s.user_id = m.user_id GROUP BY 1, 2""")
def _(t):
    m, s = marks(t)
    return J.nearest_join(m, s, ["user_id"]).select("user_id", "event_id", "idx", F.round("residual", 4).alias("residual"))


@query("neighbour_audit", "C5", f"""
WITH {MARKS_SQL}, n AS (SELECT *, lag(t) OVER w AS prev_t, lead(t) OVER w AS next_t FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, idx)),
h AS (SELECT m.user_id, m.event_id, m.t AS mt, first({{'idx': n.idx, 't': n.t, 'p': prev_t, 'n': next_t}} ORDER BY abs(n.t - m.t), n.idx) AS x
      FROM m JOIN n ON n.user_id = m.user_id GROUP BY 1, 2, 3)
SELECT user_id, event_id, x.idx AS idx, round(x.p, 3) AS prev_t, round(x.n, 3) AS next_t,
  CAST((abs(x.t - mt) <= 36000)::INT + coalesce((abs(x.p - mt) <= 36000)::INT, 0) + coalesce((abs(x.n - mt) <= 36000)::INT, 0) AS BIGINT) AS tolerance_hits,
  (abs(x.t - mt) <= 36000)::INT + coalesce((abs(x.p - mt) <= 36000)::INT, 0) + coalesce((abs(x.n - mt) <= 36000)::INT, 0) = 1 AS unique_hit
FROM h""")
def _(t):
    m, s = marks(t)
    out = J.neighbour_audit(m, s, ["user_id"], tol=36000.0)
    return rounded(out.drop("residual", "t"), "prev_t", "next_t", digits=3)


@query("event_identity", "B1 B4 K1", """
SELECT o_orderkey, sha256('src|' || o_orderkey || '|' || o_custkey || '|' || year(o_orderdate) || '|' || rtrim(rtrim(printf('%.2f', o_totalprice), '0'), '.')) AS event_identity,
  'W0001|T' || o_custkey || '|S' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') AS event_key FROM orders""")
def _(t):
    y = F.year("o_orderdate")
    raw = F.concat_ws("|", F.lit("src"), "o_orderkey", "o_custkey", y, N.canonical_decimal(F.col("o_totalprice")))
    key = F.concat(F.lit("W0001|T"), F.col("o_custkey").cast("string"), F.lit("|S"), F.lpad((y % 100).cast("string"), 2, "0"))
    return t.orders.select("o_orderkey", F.sha2(raw, 256).alias("event_identity"), key.alias("event_key"))


@query("event_times", "B2 B3 B5", """
SELECT l_orderkey, l_linenumber, round(epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 2440587.5 - 2457000.0, 6) AS relative_day,
  round(ln(greatest((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE, 20.0 / 86400.0)), 6) AS log_duration,
  o_orderdate <= l_shipdate AS ordered
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    rows = li.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    a, b = day("o_orderdate"), day("l_shipdate")
    return rows.select("l_orderkey", "l_linenumber", F.round(N.relative_day(F.col("o_orderdate")), 6).alias("relative_day"),
                       F.round(N.log_duration(a, b), 6).alias("log_duration"), N.ordered_times(a, a, b).alias("ordered"))


@query("best_product", "E10 B24", """
SELECT l_partkey, first(l_suppkey ORDER BY l_linenumber DESC, l_quantity DESC, l_suppkey::VARCHAR) AS l_suppkey,
  first(l_linenumber || '.' || l_quantity::BIGINT ORDER BY l_linenumber DESC, l_quantity DESC, l_suppkey::VARCHAR) AS version,
  CAST(count(DISTINCT l_suppkey) AS BIGINT) AS candidates FROM lineitem GROUP BY 1""")
def _(t):
    rows = t.lineitem.select("l_partkey", "l_suppkey", F.col("l_suppkey").cast("string").alias("uri"), F.concat_ws(
        ".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("bigint").cast("string")).alias("version"))
    return J.best_candidates(rows, ["l_partkey"], X.version_key(F.col("version")), "uri").drop("uri")


@query("sequential_extremes", "E16", """
WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice AS margin, epoch_us(o_orderdate) AS period FROM orders WHERE o_orderpriority = '1-URGENT'),
p1 AS (SELECT 'highest_margin' AS pass, * FROM b ORDER BY margin DESC, o_custkey, o_orderkey LIMIT 1),
p2 AS (SELECT 'near_threshold' AS pass, * FROM b WHERE margin > 250000 AND o_orderkey NOT IN (SELECT o_orderkey FROM p1) ORDER BY margin, o_custkey, o_orderkey LIMIT 1),
p3 AS (SELECT 'shortest' AS pass, * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p1 UNION SELECT o_orderkey FROM p2) ORDER BY period, o_custkey, o_orderkey LIMIT 1),
p4 AS (SELECT 'longest' AS pass, * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p1 UNION SELECT o_orderkey FROM p2 UNION SELECT o_orderkey FROM p3) ORDER BY period DESC, o_custkey, o_orderkey LIMIT 1)
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4""")
def _(t):
    b = t.orders.where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("margin"), N.epoch_micros(F.col("o_orderdate")).alias("period"))
    tie = [F.col("o_custkey"), F.col("o_orderkey")]
    yes = F.lit(True)
    return P.sequential_extremes(b, "o_orderkey", [
        ("highest_margin", yes, [F.col("margin").desc(), *tie]), ("near_threshold", F.col("margin") > 250000, [F.col("margin"), *tie]),
        ("shortest", yes, [F.col("period"), *tie]), ("longest", yes, [F.col("period").desc(), *tie])])


@query("drop_repeated_keys", "E17", """
SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey, l_suppkey) = 1""")
def _(t):
    return J.drop_repeated_keys(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity"), ["l_partkey", "l_suppkey"])


@query("temporal_order_violations", "B5", """
SELECT 'temporal_order' AS rule, l_orderkey || '|' || l_linenumber AS key, epoch_us(o_orderdate) || '|' || epoch_us(l_shipdate) AS detail
FROM lineitem JOIN orders ON o_orderkey = l_orderkey + 1 WHERE o_orderdate > l_shipdate""")
def _(t):
    o = t.orders.select((F.col("o_orderkey") - 1).alias("l_orderkey"), N.epoch_micros(F.col("o_orderdate")).alias("a"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", N.epoch_micros(F.col("l_shipdate")).alias("b")).join(o, "l_orderkey")
    return K.temporal_order(rows, ["l_orderkey", "l_linenumber"], ["a", "b"])


def cohort(t):
    """Urgent orders as references, the others as the pool; customer as target, year as sector."""
    key = F.format_string("O%010d", "o_orderkey")
    rows = t.orders.select(key.alias("k"), F.log("o_totalprice").alias("value"), F.col("o_custkey").alias("tic"),
                           F.year("o_orderdate").alias("sector"), (F.col("o_orderpriority") == "1-URGENT").alias("chosen"))
    pick = lambda flag, name: rows.where(F.col("chosen") == flag).select(F.col("k").alias(name), "value", "tic", "sector")
    return pick(True, "ref"), pick(False, "cand")


def _choice_sql(rows: str, level: str, order: str) -> str:
    """References choose one after the other: a recursion that looks up all earlier choices."""
    return f"""WITH RECURSIVE rows_ AS MATERIALIZED ({rows}),
refs AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k) AS i FROM rows_ WHERE chosen),
pool AS MATERIALIZED (SELECT * FROM rows_ WHERE NOT chosen),
m(i, cand, lv, d, candidates, ties) USING KEY (i) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::DOUBLE, 0::BIGINT, 0::BIGINT
  UNION
  SELECT i, arg_min(cand, rank), min(lv), arg_min(d, rank), count(*) FILTER (WHERE lv = least_lv), count(*) FILTER (WHERE lv = least_lv AND d = least_d) FROM (
    SELECT *, min(lv) OVER (PARTITION BY i) AS least_lv, first(d) OVER (PARTITION BY i ORDER BY lv, d) AS least_d, {order} AS rank FROM (
      SELECT r.i, p.k AS cand, {level} AS lv, abs(p.value - r.value) AS d, abs(p.second - r.second) AS d2, p.tic, p.sector
      FROM (SELECT refs.* FROM refs JOIN (SELECT max(i) AS last FROM m) ON refs.i = last + 1) r
      LEFT JOIN (SELECT * FROM pool WHERE NOT EXISTS (FROM recurring.m u WHERE u.cand = pool.k)) p ON true)) GROUP BY i),
chosen AS (SELECT 'O' || lpad(r.k::VARCHAR, 10, '0') AS ref, 'O' || lpad(cand::VARCHAR, 10, '0') AS cand, lv, d, candidates, ties, i FROM m JOIN refs r USING (i))"""


COHORT_SQL = _choice_sql(
    "SELECT o_orderkey AS k, ln(o_totalprice) AS value, 0 AS second, o_custkey AS tic, year(o_orderdate) AS sector, o_orderpriority = '1-URGENT' AS chosen FROM orders",
    "CASE WHEN p.tic = r.tic AND p.sector = r.sector THEN 1 WHEN p.tic = r.tic THEN 2 WHEN p.sector = r.sector THEN 3 WHEN p.k IS NOT NULL THEN 4 END", "(lv, d, cand)")
LEVEL_SQL = "CASE lv " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(M.LEVELS, 1)) + " ELSE 'UNMATCHED' END"


@query("matched_cohort", "C8", f"""{COHORT_SQL}
SELECT ref, cand, {LEVEL_SQL} AS level, round(d, 9) AS difference, candidates, CASE WHEN cand IS NULL THEN 0 ELSE ties END AS ties,
  CASE WHEN cand IS NULL THEN 'UNMATCHED_REFERENCE' ELSE 'MATCHED_WITHOUT_REPLACEMENT' END AS status FROM chosen""")
def _(t):
    refs, pool = cohort(t)
    out = M.match_without_replacement(refs, pool)
    return rounded(out.select("ref", "cand", "level", "difference", "candidates", "ties", "status"), "difference", digits=9)


@query("cohort_manifest", "C9", f"""{COHORT_SQL},
numbered AS (SELECT *, row_number() OVER (ORDER BY ref) AS n, 'P' || lpad(i::VARCHAR, 4, '0') AS pair_id, {LEVEL_SQL} AS level FROM chosen WHERE cand IS NOT NULL)
SELECT 'E' || lpad((2 * n - 1)::VARCHAR, 6, '0') AS event_id, pair_id, ref AS event_key, 'REFERENCE' AS role, 'E' || lpad((2 * n)::VARCHAR, 6, '0') AS partner_id, level, 'ALL_REFERENCES' AS reason FROM numbered
UNION ALL SELECT 'E' || lpad((2 * n)::VARCHAR, 6, '0'), pair_id, cand, 'COMPARISON', 'E' || lpad((2 * n - 1)::VARCHAR, 6, '0'), level, 'ONE_TO_ONE_WITHOUT_REPLACEMENT' FROM numbered""")
def _(t):
    refs, pool = cohort(t)
    return M.pair_manifest(M.match_without_replacement(refs, pool, audit=False))


# Closeness in days, then in price, then the smaller customer and order number: candidates of one customer first.
@query("two_key_matching", "C23", _choice_sql(
    "SELECT o_orderkey AS k, epoch_us(o_orderdate) // 86400000000 // 7 AS value, round(o_totalprice / 1e4) AS second, o_custkey AS tic, o_orderkey % 5 AS sector, "
    "o_orderpriority = '1-URGENT' AS chosen FROM orders", "CASE WHEN p.tic = r.tic THEN 1 WHEN p.k IS NOT NULL THEN 2 END", "(lv, d, d2, tic, sector, cand)") + """
SELECT ref, cand, CASE lv WHEN 1 THEN 'SAME_TIC' WHEN 2 THEN 'GLOBAL' ELSE 'UNMATCHED' END AS level, d AS difference,
  CASE WHEN cand IS NULL THEN 'UNMATCHED_REFERENCE' ELSE 'MATCHED_WITHOUT_REPLACEMENT' END AS status FROM chosen""")
def _(t):
    key = F.format_string("O%010d", "o_orderkey")
    weeks = F.expr(f"d0 div {int(DAY)} div 7")
    rows = t.orders.withColumn("d0", N.epoch_micros(F.col("o_orderdate"))).select(
        key.alias("k"), weeks.cast("double").alias("value"), F.round(F.col("o_totalprice") / 1e4).alias("second"), F.col("o_custkey").alias("tic"),
        (F.col("o_orderkey") % 5).alias("start"), (F.col("o_orderpriority") == "1-URGENT").alias("chosen"))
    pick = lambda flag, name: rows.where(F.col("chosen") == flag).select(F.col("k").alias(name), "value", "second", "tic", "start")
    levels = (("SAME_TIC", ("tic",)), ("GLOBAL", ()))
    out = M.match_without_replacement(pick(True, "ref").drop("start"), pick(False, "cand"), levels, audit=False, second=True, tie=("tic", "start"))
    return out.select("ref", "cand", "level", "difference", "status")
