"""Queries of the relational operators, scalar functions, recursion and graphs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import table
from tidemark.functions import dialect as D
from tidemark.operators import graphs as G
from tidemark.operators import recursion
from tidemark.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; the function gets a table reader."""

    def add(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(lambda name: table(spark, sf, name))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- scans, filters, projections ----------------------------------------------------------------


@query("""SELECT n_name, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE AS revenue, count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus <> 'P' GROUP BY n_name HAVING count(*) > 3 ORDER BY revenue DESC, n_name LIMIT 10""")
def revenue_by_nation(t):
    """Flagship: join chain, filter, grouping, HAVING, ORDER BY, LIMIT."""
    o = t("orders").filter("o_orderstatus <> 'P'")
    j = R.join(R.join(o, t("customer"), [("o_custkey", "c_custkey")]), t("nation"), [("c_nationkey", "n_nationkey")])
    a = R.aggregate(j, ["n_name"], revenue=F.round(F.sum("o_totalprice"), 2), n_orders=F.count(F.lit(1)))
    return R.top_k(a.filter("n_orders > 3"), [D.desc("revenue"), D.asc("n_name")], 10)


@query("SELECT * FROM nation")
def scan_all(t):
    return t("nation").select("*")


@query("SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey")
def qualified_star(t):
    n, r = t("nation").alias("n"), t("region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.*", "r.r_name")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount > 0.02
AND l_tax <= 0.06 AND l_returnflag <> 'N' AND (l_linestatus = 'F' OR NOT (l_shipdate < TIMESTAMP '1996-01-01'))""")
def filter_predicates(t):
    c = (F.col("l_quantity") >= 10) & (F.col("l_quantity") < 40) & (F.col("l_discount") > 0.02) & (F.col("l_tax") <= 0.06)
    c = c & (F.col("l_returnflag") != "N") & ((F.col("l_linestatus") == "F") | ~(F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ'1996-01-01'")))
    return R.where(t("lineitem"), c).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9, NULL) AND p_retailprice BETWEEN 900 AND 2000
AND p_size NOT BETWEEN 2 AND 4 AND p_size NOT IN (7, 8)""")
def in_between(t):
    return t("part").filter("p_size IN (1, 5, 9, NULL) AND p_retailprice BETWEEN 900 AND 2000 AND p_size NOT BETWEEN 2 AND 4 AND p_size NOT IN (7, 8)").select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_type FROM part WHERE p_name LIKE '%o_t' AND p_brand ILIKE 'brand#%' AND p_name NOT LIKE 'small%'
AND p_type NOT ILIKE '%econ%' AND p_brand LIKE 'Brand!#1_' ESCAPE '!'""")
def like_patterns(t):
    c = D.like(F.col("p_name"), "%o_t") & D.like(F.col("p_brand"), "brand#%", ignore_case=True) & ~D.like(F.col("p_name"), "small%")
    c = c & ~D.like(F.col("p_type"), "%econ%", ignore_case=True) & D.like(F.col("p_brand"), "Brand!#1_", escape="!")
    return t("part").filter(c).select("p_partkey", "p_type")


@query("""SELECT c_custkey, o_orderkey, (o_orderstatus = 'F') IS TRUE AS is_f, (o_orderstatus = 'F') IS FALSE AS not_f, o_orderkey IS NULL AS lone,
o_orderstatus IS DISTINCT FROM 'O' AS differs, o_orderstatus IS NOT DISTINCT FROM NULL AS missing
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'""")
def null_tests(t):
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'")
    j = R.join(t("customer"), urgent, [("c_custkey", "o_custkey")], "left")
    return j.selectExpr(
        "c_custkey", "o_orderkey", "(o_orderstatus = 'F') IS TRUE AS is_f", "(o_orderstatus = 'F') IS FALSE AS not_f", "o_orderkey IS NULL AS lone",
        "o_orderstatus IS DISTINCT FROM 'O' AS differs", "o_orderstatus IS NOT DISTINCT FROM NULL AS missing",
    )


@query("""SELECT o_orderkey, o_orderkey IN (1, 3, 5) AS eq_any, o_totalprice > least(1000, 50000) AS gt_any, o_totalprice <= greatest(1000, 50000) AS le_any,
o_orderstatus IN ('F', 'P') AS text_any, FALSE AS none_any FROM orders""")
def any_array(t):
    status = F.array(*[F.lit(x) for x in D.parse_array('{F,"P"}')])
    prices = F.array(F.lit(1000.0), F.lit(50000.0))
    return t("orders").select(
        "o_orderkey", D.any_of(F.col("o_orderkey"), "=", F.array(*[F.lit(x) for x in (1, 3, 5)])).alias("eq_any"),
        D.any_of(F.col("o_totalprice"), ">", prices).alias("gt_any"), D.any_of(F.col("o_totalprice"), "<=", prices).alias("le_any"),
        D.any_of(F.col("o_orderstatus"), "=", status).alias("text_any"),
        D.any_of(F.col("o_orderkey"), "<", F.array().cast("array<bigint>")).alias("none_any"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_linenumber + 2 * 3 AS plus, -l_linenumber AS minus,
(l_orderkey // l_linenumber)::BIGINT AS whole, (l_orderkey % 7)::BIGINT AS rest, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey // (l_linenumber - 1) END AS safe,
round(l_quantity / nullif(l_tax, 0), 4) AS ratio FROM lineitem""")
def arithmetic(t):
    li = t("lineitem")
    c = F.col
    return li.select(
        "l_orderkey", "l_linenumber", F.round(c("l_extendedprice") * (1 - c("l_discount")), 4).alias("net"),
        D.add(c("l_linenumber"), F.lit(2) * 3).alias("plus"), (-c("l_linenumber")).alias("minus"),
        D.divide(li, c("l_orderkey"), c("l_linenumber")).alias("whole"), D.modulo(c("l_orderkey"), F.lit(7).cast("bigint")).alias("rest"),
        D.int_divide(c("l_orderkey"), c("l_linenumber") - 1).alias("safe"), F.round(D.divide(li, c("l_quantity"), c("l_tax")), 4).alias("ratio"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size,
CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, o_orderpriority) AS first FROM orders""")
def case_coalesce(t):
    c = F.col
    return t("orders").select(
        "o_orderkey", F.when(c("o_totalprice") > 200000, "big").when(c("o_totalprice") > 50000, "mid").otherwise("small").alias("size"),
        F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 2).alias("code"),
        F.coalesce(F.when(c("o_orderstatus") != "P", c("o_orderstatus")), c("o_orderpriority")).alias("first"),
    )


@query("""SELECT c_custkey, c_name || '/' || c_nationkey::VARCHAR AS tag, c_name || NULL AS nothing FROM customer""")
def concat_text(t):
    return t("customer").select(
        "c_custkey", D.concat_text(F.col("c_name"), F.lit("/"), F.col("c_nationkey")).alias("tag"), D.concat_text(F.col("c_name"), F.lit(None)).cast("string").alias("nothing")
    )


@query("""SELECT c_custkey, CASE WHEN regexp_matches(c_mktsegment, '^[+-]?[0-9]+$') THEN c_mktsegment::BIGINT END AS bad_int, c_custkey::VARCHAR AS as_text,
(CASE WHEN c_acctbal < 0 THEN -floor(-c_acctbal + 0.5) ELSE floor(c_acctbal + 0.5) END)::BIGINT AS rounded, c_nationkey <> 0 AS as_bool, TRY_CAST('12.5' AS DOUBLE) AS as_float,
CASE WHEN c_custkey % 2 = 0 THEN TRUE ELSE FALSE END AS from_text, 'f1aacd99-2263-d388-0002-000000000023' AS id, NULL::VARCHAR AS no_id FROM customer""")
def casts(t):
    yes = F.when(F.col("c_custkey") % 2 == 0, " Yes ").otherwise("OFF")
    return t("customer").select(
        "c_custkey", D.to_int(F.col("c_mktsegment"), "text").alias("bad_int"), D.to_text(F.col("c_custkey")).alias("as_text"),
        D.to_int(F.col("c_acctbal"), "float").alias("rounded"), D.to_bool(F.col("c_nationkey"), "number").alias("as_bool"),
        D.to_float(F.lit("12.5")).alias("as_float"), D.to_bool(yes).alias("from_text"),
        D.to_uuid(F.lit("{F1AACD992263D3880002000000000023}")).alias("id"), D.to_uuid(F.lit("none")).alias("no_id"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_int, NULL::VARCHAR AS missing FROM events")
def json_get(t):
    v = F.parse_json("props")
    return t("events").select("event_id", v.alias("v")).select(
        "event_id", D.json_scalar_text(F.col("v"), "k").alias("k_text"), F.try_variant_get("v", "$.k", "bigint").alias("k_int"), D.json_scalar_text(F.col("v"), "nope").alias("missing")
    )


@query("SELECT event_id, '[1, {\"b\": null, \"aa\": 2}]' AS nested, '{\"b\": null, \"aa\": 2}' AS last FROM events")
def json_nested(t):
    """``->>`` of nested values, and a negative index."""
    v = F.parse_json(F.lit('{"x":[1,{"aa":2,"b":null}]}'))
    x = t("events").select("event_id", v.alias("v"))
    return x.select("event_id", D.json_get_text(F.col("v"), "x").alias("nested"), D.json_get_text(D.json_get(F.col("v"), "x"), -1).alias("last"))


@query("SELECT vec_id, len(embedding) AS n, len([1, 2, 3]) AS three FROM embeddings")
def cardinality_array(t):
    return t("embeddings").select("vec_id", F.cardinality("embedding").cast("bigint").alias("n"), F.cardinality(F.array(F.lit(1), F.lit(2), F.lit(3))).cast("bigint").alias("three"))


# --- joins --------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_totalprice > 100000""")
def inner_join_chain(t):
    j = R.join(t("orders").filter("o_totalprice > 100000"), t("customer"), [("o_custkey", "c_custkey")])
    j = R.join(R.join(j, t("nation"), [("c_nationkey", "n_nationkey")]), t("region"), [("n_regionkey", "r_regionkey")])
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey AND s_nationkey = c_nationkey""")
def join_two_keys(t):
    j = R.join(R.join(t("lineitem"), t("orders"), [("l_orderkey", "o_orderkey")]), t("customer"), [("o_custkey", "c_custkey")])
    return R.join(j, t("supplier"), [("l_suppkey", "s_suppkey"), ("c_nationkey", "s_nationkey")]).select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left_join(t):
    return R.join(t("customer"), t("orders"), [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def semi_exists(t):
    return R.join(t("customer"), t("orders").filter("o_totalprice > 150000"), [("c_custkey", "o_custkey")], "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def anti_not_exists(t):
    return R.join(t("customer"), t("events"), [("c_custkey", "user_id")], "left_anti").select("c_custkey", "c_name")


@query("""WITH x AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation)
SELECT 'in' AS kind, count(*) AS n FROM x a JOIN x b ON a.k = b.k UNION ALL SELECT 'left', count(*) FROM x a LEFT JOIN x b ON a.k = b.k
UNION ALL SELECT 'anti', count(*) FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE a.k = b.k)""")
def null_keys(t):
    """NULL keys match nothing."""
    k = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey"))
    a, b = t("nation").select(k.alias("k")), t("nation").select(k.alias("k2"))
    count = lambda name, how: R.join(a, b, [("k", "k2")], how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
    return count("in", "inner").union(count("left", "left")).union(count("anti", "left_anti"))


@query("""SELECT c_custkey, s.n, s.top::DOUBLE AS top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) s ON s.o_custkey = c_custkey""")
def lateral_join(t):
    """``LEFT JOIN LATERAL (SELECT o_custkey, count(*), max(..) .. WHERE o_custkey = c_custkey GROUP BY o_custkey) ON TRUE``."""
    c = t("customer")
    t("orders").createOrReplaceTempView("tidemark_orders")
    c.createOrReplaceTempView("tidemark_customer")
    return c.sparkSession.sql(
        """SELECT c_custkey, n, top FROM tidemark_customer LEFT JOIN LATERAL
        (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM tidemark_orders WHERE o_custkey = c_custkey GROUP BY o_custkey) ON TRUE"""
    )


@query("SELECT p_partkey, unnest(range(p_size % 4)) AS k FROM part")
def join_function(t):
    array = F.when(F.col("p_size") % 4 > 0, F.sequence(F.lit(0), F.col("p_size") % 4 - 1)).otherwise(F.array().cast("array<int>"))
    return R.join_function(t("part").select("p_partkey", "p_size"), array, "k").select("p_partkey", F.col("k").cast("bigint").alias("k"))


# --- aggregates ---------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS n_tax, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price,
min(l_shipdate) AS first, max(l_shipdate) AS last, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_group(t):
    return R.aggregate(
        t("lineitem"), ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), n_tax=F.count("l_tax"), qty=F.round(F.sum("l_quantity"), 2),
        avg_price=F.round(F.avg("l_extendedprice"), 4), first=F.min("l_shipdate"), last=F.max("l_shipdate"), lines=D.saturating_sum(F.col("l_linenumber")),
    )


@query("SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, avg(l_tax) AS a, min(l_shipdate) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_quantity < 0")
def agg_global_empty(t):
    return R.aggregate(
        t("lineitem").filter("l_quantity < 0"), [], n=F.count(F.lit(1)), s=F.sum("l_linenumber"), a=F.avg("l_tax"), lo=F.min("l_shipdate"), hi=F.max("l_quantity")
    )


@query("""SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_cust, sum(DISTINCT o_custkey % 10)::BIGINT AS s_dist, round(avg(DISTINCT o_custkey % 10), 6) AS a_dist,
min(DISTINCT o_orderkey) AS lo, max(DISTINCT o_orderkey) AS hi FROM orders GROUP BY o_orderstatus""")
def agg_distinct(t):
    m = F.col("o_custkey") % 10
    return R.aggregate(
        t("orders"), ["o_orderstatus"], n_cust=F.countDistinct("o_custkey"), s_dist=F.sum_distinct(m), a_dist=F.round(F.expr("avg(DISTINCT o_custkey % 10)"), 6),
        lo=F.min("o_orderkey"), hi=F.max("o_orderkey"),
    )


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY l_suppkey HAVING avg(l_quantity) > 25 AND count(*) > 2")
def having(t):
    a = R.aggregate(t("lineitem"), ["l_suppkey"], a=F.avg("l_quantity"), n=F.count(F.lit(1)))
    return a.filter("a > 25 AND n > 2").select("l_suppkey", F.round("a", 6).alias("avg_qty"))


@query("SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")
def group_only(t):
    return R.aggregate(t("customer"), ["c_mktsegment", "c_nationkey"])


@query("""SELECT k, count(*) AS n FROM (SELECT CASE WHEN c_nationkey > 12 THEN NULL ELSE c_nationkey END AS k FROM customer) GROUP BY k""")
def null_group(t):
    return R.aggregate(t("customer").select(F.when(F.col("c_nationkey") <= 12, F.col("c_nationkey")).alias("k")), ["k"], n=F.count(F.lit(1)))


@query("SELECT 9223372036854775807 AS top, -9223372036854775808 AS low FROM region LIMIT 1")
def saturating(t):
    big = t("region").select(F.lit((1 << 63) - 1).alias("b"))
    return R.aggregate(big, [], top=D.saturating_sum(F.col("b")), low=D.saturating_sum(-F.col("b")))


@query("SELECT l_returnflag, sum(l_linenumber)::BIGINT AS total, count(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag")
def avg_pair(t):
    """An exact average as (sum, count)."""
    return R.aggregate(t("lineitem"), ["l_returnflag"], p=F.struct(F.sum("l_linenumber").alias("total"), F.count("l_linenumber").alias("n"))).select("l_returnflag", "p.total", "p.n")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def multiplicity_count(t):
    return R.multiplicities(t("customer").select("c_nationkey"))


@query("""SELECT c_nationkey FROM (SELECT c_nationkey, least(count(*), 2) AS m FROM customer GROUP BY c_nationkey), range(2) r(i) WHERE i < m""")
def threshold_two(t):
    return R.threshold(t("customer").select("c_nationkey"), lambda n: F.least(n, F.lit(2)))


@query("SELECT user_id, event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS before FROM events")
def prefix_sum(t):
    return R.prefix_sum(t("events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("user_id", "event_id", F.round("before", 4).alias("before"))


@query("SELECT o_orderpriority, mode(o_orderstatus ORDER BY o_orderstatus)::VARCHAR AS common FROM (SELECT o_orderpriority, o_orderstatus FROM orders) GROUP BY 1")
def reduce_mode(t):
    """A reducer of one's own: the most frequent status of each priority."""

    def reducer(pdf):
        top = pdf.sort_values(["n", "o_orderstatus"], ascending=[False, True]).head(1)
        return top.assign(common=top["o_orderstatus"])[["o_orderpriority", "common"]]

    def partial(pdf):  # the most frequent of a part's distinct rows
        return pdf.sort_values(["n", "o_orderstatus"], ascending=[False, True]).head(1)

    return R.reduce_groups(t("orders").select("o_orderpriority", "o_orderstatus"), ["o_orderpriority"], reducer, "o_orderpriority string, common string", partial)


# --- distinct, sort, limit, set operations ------------------------------------------------------


@query("SELECT DISTINCT c_mktsegment, c_nationkey % 5 AS m FROM customer")
def distinct_rows(t):
    return t("customer").select("c_mktsegment", (F.col("c_nationkey") % 5).alias("m")).distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on_latest(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return R.distinct_on(o, ["o_custkey"], [D.desc("o_orderdate"), D.asc("o_orderkey")]).drop("o_orderdate")


@query("""SELECT c_custkey, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS FIRST, c_custkey ASC NULLS LAST, o_orderkey) AS n
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'""")
def sort_nulls(t):
    """The place of every row in an order with NULLs."""
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'")
    j = R.join(t("customer"), urgent, [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey", "o_totalprice")
    return R.numbered(j, [D.desc("o_totalprice"), D.asc("c_custkey"), D.asc("o_orderkey")]).drop("o_totalprice")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def topk_multi_key(t):
    o = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return R.top_k(o, [D.asc("o_orderpriority"), D.desc("o_totalprice"), D.asc("o_orderkey")], 50, 20)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def hidden_sort_key(t):
    """The sort key isn't in the result."""
    return R.top_k(t("orders").select("o_orderkey", "o_totalprice"), [D.desc("o_totalprice"), D.asc("o_orderkey")], 7).select("o_orderkey")


_SETS = "SELECT o_custkey AS k FROM orders {op} SELECT user_id FROM events"


def _sets(kind: str, all_rows: bool):
    def f(t):
        return R.set_operation(t("orders").select(F.col("o_custkey").alias("k")), t("events").select("user_id"), kind, all_rows)

    return f


for _kind in ("union", "except", "intersect"):
    for _all in (False, True):
        _f = _sets(_kind, _all)
        _f.__name__ = f"{_kind}_{'bag' if _all else 'set'}"
        query(_SETS.format(op=_kind.upper() + (" ALL" if _all else "")))(_f)


@query("""WITH per AS (SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id)
SELECT a.user_id, a.n, a.total FROM per a JOIN (SELECT max(n) AS top FROM per) m ON a.n = m.top""")
def cte_shared(t):
    """One subquery used twice; Spark reuses its exchange."""
    per = R.aggregate(t("events"), ["user_id"], n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))
    return R.join(per, per.agg(F.max("n").alias("top")), [("n", "top")]).select("user_id", "n", "total")


@query("SELECT seg, count(*) AS n FROM (SELECT c_mktsegment AS seg FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal) x GROUP BY seg")
def derived_table(t):
    return R.aggregate(t("customer").filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("seg")), ["seg"], n=F.count(F.lit(1)))


# --- recursion and graphs -----------------------------------------------------------------------

_PARENTS = "SELECT p_partkey AS id, p_partkey // 3 AS parent FROM part"


@query(f"WITH RECURSIVE e AS ({_PARENTS}), r(id) AS (SELECT 2::BIGINT UNION SELECT e.id FROM e JOIN r ON e.parent = r.id) SELECT id::BIGINT AS id FROM r")
def recursive_union(t):
    e = t("part").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent"))
    base = t("region").limit(1).select(F.lit(2).cast("bigint").alias("id"))
    return recursion.fixpoint(base, lambda r: r.join(e, r["id"] == e["parent"]).select("child"))


@query(f"WITH RECURSIVE e AS ({_PARENTS}), r(id, depth) AS (SELECT 5::BIGINT, 0 UNION ALL SELECT e.id, depth + 1 FROM e JOIN r ON e.parent = r.id) SELECT id::BIGINT AS id, depth FROM r")
def recursive_union_all(t):
    e = t("part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("parent"))
    base = t("region").limit(1).select(F.lit(5).cast("bigint").alias("id"), F.lit(0).alias("depth"))
    return recursion.fixpoint(base, lambda r: r.withColumnRenamed("id", "above").join(e, F.col("above") == F.col("parent")).select("id", F.col("depth") + 1), union_all=True)


def _edges(t) -> DataFrame:
    """Parts to suppliers (negative numbers), both ways."""
    li = t("lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).distinct()
    return li.union(li.select("dst", "src"))


_EDGES = "WITH RECURSIVE li AS (SELECT DISTINCT l_partkey AS p, -l_suppkey AS s FROM lineitem), e AS (SELECT p AS src, s AS dst FROM li UNION ALL SELECT s, p FROM li)"


@query(_EDGES + """, r(node, dist) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, dist + 1 FROM r JOIN e ON e.src = r.node WHERE dist < 6)
SELECT node::BIGINT AS node, min(dist)::INT AS dist FROM r GROUP BY node""")
def graph_bfs(t):
    roots = t("region").limit(1).select(F.lit(1).cast("bigint"))
    return G.bfs(_edges(t), roots)


_TREE = "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey % 5 <> 0), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(_TREE + ", r(node, c) AS (SELECT src, src FROM u UNION SELECT u.dst, r.c FROM r JOIN u ON u.src = r.node) SELECT node::BIGINT AS node, min(c)::BIGINT AS component FROM r GROUP BY node")
def graph_components(t):
    e = t("part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return G.components(e)


@query(_TREE + ", r(node, c) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.node) SELECT node::BIGINT AS node, min(c)::BIGINT AS label FROM r GROUP BY node")
def graph_propagate(t):
    e = t("part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return G.propagate(e, e.select("src", "src").distinct())


def _rings(t) -> DataFrame:
    """Rings of ten customers, and a bridge from every other ring to the next."""
    c = t("customer").select(F.col("c_custkey").alias("src"))
    ring = c.select("src", F.expr("CASE WHEN src % 10 = 9 THEN src - 9 ELSE src + 1 END").alias("dst"))
    return ring.union(c.filter("src % 20 = 4").select("src", (F.col("src") + 10).alias("dst")))


_RING = """(SELECT CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 9 ELSE c_custkey + 1 END AS dst, c_custkey AS src FROM customer)"""


@query("""WITH c AS (SELECT c_custkey // 10 AS g, count(*) AS n, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1)
SELECT c_custkey AS node, (c_custkey // 10 * 10)::BIGINT AS component FROM customer JOIN c ON g = c_custkey // 10 WHERE n = 10""")
def graph_scc(t):
    return G.strongly_connected(_rings(t))


@query("SELECT c_custkey AS src, (c_custkey // 10 * 10 + 9)::BIGINT AS dst, (9 - c_custkey % 10)::INT AS dist FROM customer WHERE c_custkey // 10 IN (SELECT c_custkey // 10 FROM customer GROUP BY 1 HAVING count(*) = 10)")
def graph_bidijkstra(t):
    full = t("customer").groupBy(F.expr("c_custkey div 10").alias("g")).count().filter("count = 10").select("g")
    goals = t("customer").withColumn("g", F.expr("c_custkey div 10")).join(full, "g", "left_semi").select("c_custkey", (F.col("g") * 10 + 9).alias("to"))
    return G.bidijkstra(_rings(t), goals)


@query("""WITH p AS (SELECT p_partkey AS id FROM part) SELECT id AS node, (id % 2)::INT AS value FROM p""")
def graph_sequence(t):
    """Greedy colouring of paths of eight nodes in order of ids."""
    p = t("part").select(F.col("p_partkey").alias("src"))
    e = p.filter("src % 8 <> 7").select("src", (F.col("src") + 1).alias("dst")).join(p.select(F.col("src").alias("dst")), "dst", "left_semi")
    return G.sequence(e.select("src", "dst"), p).select("node", F.col("value").cast("int").alias("value"))


@query("""WITH RECURSIVE c AS (SELECT c_custkey // 10 AS g FROM customer GROUP BY 1 HAVING count(*) = 10)
SELECT least(src, dst) AS src, greatest(src, dst)::BIGINT AS dst FROM """ + _RING + """ WHERE src // 10 IN (SELECT g FROM c)
UNION SELECT c_custkey, c_custkey + 10 FROM customer WHERE c_custkey % 20 = 4 AND c_custkey // 10 IN (SELECT g FROM c) AND c_custkey // 10 + 1 IN (SELECT g FROM c)""")
def graph_kcore(t):
    return G.k_core(_rings(t), 2)


@query("SELECT DISTINCT c_mktsegment, c_nationkey, 1::BIGINT AS holders FROM customer")
def graph_identifiers(t):
    """Distinct rows, and how many of them hold each one's number."""
    ids = G.identifiers(t("customer").select("c_mktsegment", "c_nationkey"))
    return ids.join(ids.groupBy("id").agg(F.count(F.lit(1)).alias("holders")), "id").drop("id")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def arranged_join(t):
    """A join on rows that were placed and sorted by its key once."""
    a = R.arrange(t("nation"), ["n_regionkey"])
    out = R.join(a, t("region"), [("n_regionkey", "r_regionkey")]).select("n_nationkey", "r_name")
    return R.inspect(out, "arranged_join")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) IS NULL AS first FROM orders")
def prefix_sum_global(t):
    """One group of all rows, summed in ranges."""
    o = R.prefix_sum(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), [], "o_orderkey", "o_totalprice")
    return o.select("o_custkey", "o_orderkey", (F.col("before") == 0).alias("first"))
