"""Small cases of the relational operators, dialect functions, recursion and graphs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import canon
from tidemark.functions import dialect as D
from tidemark.operators import graphs as G
from tidemark.operators import recursion
from tidemark.operators import relational as R


def test_distinct_on_first_of_each(spark, rows):
    a = spark.createDataFrame([(21, "n"), (25, "n"), (23, "s"), (27, None), (28, None)], "num int, side string")
    assert rows(R.distinct_on(a, ["side"], [D.desc("num")])) == sorted([(23, "s"), (25, "n"), (28, None)], key=repr)
    assert R.distinct_on(a.limit(0), ["side"], [D.desc("num")]).count() == 0


def test_set_operations_count_rows(spark, rows):
    a, b = spark.createDataFrame([(5,), (5,), (5,), (8,), (None,)], "p int"), spark.createDataFrame([(5,), (None,), (9,)], "q int")
    got = {(k, al): rows(R.set_operation(a, b, k, al)) for k in ("except", "intersect") for al in (False, True)}
    assert got == {
        ("except", False): [(8,)], ("except", True): [(5,), (5,), (8,)],
        ("intersect", False): [(5,), (None,)], ("intersect", True): [(5,), (None,)],
    }
    with pytest.raises(ValueError):
        R.set_operation(a, a.select("p", "p"), "union")


def test_null_order_and_ties(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 1)], "id int, v int")
    assert [r.id for r in R.top_k(df, [D.asc("v")]).collect()] == [4, 2, 3, 1]
    assert [r.id for r in R.top_k(df, [D.desc("v")], 2, 1).collect()] == [2, 3]


def test_global_aggregate_over_nothing(spark, rows):
    e = spark.createDataFrame([], "value int")
    assert rows(R.aggregate(e, [], n=F.count(F.lit(1)), s=F.sum("value"))) == [(0, None)]
    assert R.aggregate(e, ["value"]).count() == 0


def test_threshold_and_assertions(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "x string")
    assert rows(R.threshold(df, lambda n: n - 1)) == [("a",), ("a",)]
    R.assert_same(df, df.repartition(3))
    with pytest.raises(AssertionError):
        R.assert_same(df, df.distinct())


def test_safe_arithmetic_and_casts(spark):
    top = (1 << 63) - 1
    df = spark.createDataFrame([(top, 1, 0, 2.5, " Yes ", "12x"), (-7, 2, 0, -2.5, "off", "-12")], "a bigint, b bigint, z bigint, f double, t string, i string")
    c = F.col
    out = df.select(
        D.add(c("a"), c("b")), D.multiply(c("a"), c("b")), D.int_divide(c("a"), c("b")), D.divide(df, c("a"), c("z")), D.modulo(c("a"), c("b")),
        D.to_int(c("f"), "float"), D.to_bool(c("t")), D.to_int(c("i"), "text"), D.to_text(F.lit(1.0), "float"), D.to_text(c("f"), "float"),
    ).collect()
    assert tuple(out[0]) == (None, top, top, None, 0, 3, True, None, "1", "2.5")
    assert tuple(out[1]) == (-5, -14, -3, None, -1, -3, False, -12, "1", "-2.5")


@pytest.mark.parametrize("text,want", [("{1,\"a b\",NULL}", [1, "a b", None]), ("{}", []), ("{ 7, 11 }", [7, 11]), ('{"NULL","\\"q",t,x,1.5}', ["NULL", '"q', True, "x", 1.5])])
def test_array_literals(text, want):
    assert D.parse_array(text) == want


@pytest.mark.parametrize("text", ["1,2", '{"a', "{1,}", "{1 2"])
def test_bad_array_literals(text):
    with pytest.raises(ValueError):
        D.parse_array(text)


def test_json_access(spark):
    df = spark.createDataFrame([('{"a":null,"b":[1,{"zz":1,"y":"ü"}],"k.d":2}',)], "j string").select(F.parse_json("j").alias("v"))
    v = F.col("v")
    r = df.select(
        F.is_variant_null(D.json_get(v, "a")), D.json_get_text(v, "a"), D.json_get_text(v, "none"), D.json_get_text(D.json_get(v, "b"), -1),
        D.json_get_text(D.json_get(v, "b"), -3), D.json_get_text(D.json_get(v, "b"), 0), D.json_get_text(v, "k.d"),
    ).first()
    assert tuple(r) == (True, None, None, '{"y": "ü", "zz": 1}', None, "1", "2")


def test_like(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("A\nB",), (None,)], "s string")
    got = lambda *a, **k: [r[0] for r in df.select(D.like(F.col("s"), *a, **k)).collect()]
    assert got("a\\%b") == [True, False, False, None]
    assert got("a!%b", escape="!") == [True, False, False, None]
    assert got("a_b", ignore_case=True) == [True, True, True, None]
    assert got("a\\%b", escape="") == [False, False, False, None]


def test_canonical_forms(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert v(canon.lsn(lit("1/a"))) == (1 << 32) + 10 and v(canon.lsn(lit(" 12 "))) == 12 and v(canon.lsn(lit("1/g"))) is None
    assert v(canon.table_name(lit(' "Core"."T" '))) == "core.t" and v(canon.table_name(lit("T"))) == "public.t"
    assert v(canon.uuid(lit("a0eebc999c0b4ef8-bb6d6bb9-bd380a11"))) == "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"
    same = ['{"a":1,"b":{"x":null,"y":[1,2.50]}}', '{ "b" : {"y":[1.0,25e-1]}, "a" : 1e0, "c":null }']
    assert len({v(canon.json_canonical(lit(s))) for s in same}) == 1
    assert v(canon.json_canonical(lit('{"a":"x,\\"b\\":null"}'))) == '{"a":"x,\\"b\\":null"}'
    assert v(canon.json_canonical(lit('{"a":[2,1]}'))) != v(canon.json_canonical(lit('{"a":[1,2]}')))
    assert v(canon.json_canonical(lit("not json"))) == "not json" and v(canon.json_canonical(lit(None).cast("string"))) is None


def test_parallel_scans(spark, rows):
    """Sums and positions over ranges equal those of one window, with a hot group, nulls and clashing names."""
    rng = random.Random(8)
    data = [(rng.choice(["hot"] * 9 + ["a", None]), i, rng.choice([None, *range(9)]), i % 3) for i in rng.sample(range(400), 400)]
    df = spark.createDataFrame(data, "g string, at int, v int, before int").drop("before")
    w = Window.partitionBy("g").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    assert rows(R.prefix_sum(df, ["g"], "at", "v")) == rows(df.withColumn("before", F.coalesce(F.sum("v").over(w), F.lit(0))))
    assert R.prefix_sum(df.limit(0), ["g"], "at", "v").count() == 0
    order = [D.desc("v"), D.asc("g")]
    want = [tuple(r) for r in df.orderBy(*D.total_order(df, order)).collect()]
    assert [tuple(r)[:3] for r in R.numbered(df, order).orderBy("n").collect()] == want


def test_reducer_with_a_partial_stage(spark, rows):
    df = spark.createDataFrame([(i % 2, i % 50) for i in range(300)], "k int, v int")
    most = lambda pdf: pdf.sort_values(["v"]).tail(2)
    out = [R.reduce_groups(df, ["k"], most, "k int, v int, n long", p, 4) for p in (None, most)]
    assert rows(out[0]) == rows(out[1]) == [(0, 46, 6), (0, 48, 6), (1, 47, 6), (1, 49, 6)]


def _reach(spark):
    e = spark.createDataFrame([(50, 7), (60, 50), (70, 60), (15, 13), (60, 7)], "inner int, outer int")
    return e.filter("outer = 7").select("inner"), lambda r: r.join(e.withColumnRenamed("inner", "next"), r["inner"] == F.col("outer")).select("next")


def test_recursion_rounds(spark, rows):
    base, step = _reach(spark)
    assert rows(recursion.fixpoint(base, step)) == [(50,), (60,), (70,)]
    assert rows(recursion.fixpoint(base, step, union_all=True)) == [(50,), (60,), (60,), (70,), (70,)]
    assert rows(recursion.fixpoint(base.limit(0), step)) == []


def test_rows_met_before(spark, rows):
    """Nulls in different columns are different rows; folding parts loses none."""
    met = recursion.Met(spark, ["a", "b"], fan=2)
    make = lambda *r: spark.createDataFrame(r, "a int, b int")
    assert rows(met.add(make((None, 1), (1, None), (1, None), (None, None)))) == sorted([(None, 1), (1, None), (None, None)], key=repr)
    assert rows(met.add(make((1, None), (1, 1)))) == [(1, 1)]
    assert rows(met.add(make((None, None), (2, 2), (1, 1)))) == [(2, 2)] and len(met.parts) == 2
    assert met.rows().count() == 5


def test_recursion_on_cycles(spark, rows):
    e = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    base = spark.createDataFrame([(1,)], "n int")
    step = lambda r: r.join(e, r["n"] == e["src"]).select("dst")
    assert rows(recursion.fixpoint(base, step)) == [(1,), (2,)]
    with pytest.raises(recursion.RecursionLimitError):
        recursion.fixpoint(base, step, union_all=True, max_rounds=4)


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8)]


def test_graphs(spark, rows):
    e = spark.createDataFrame([*EDGES, (None, 1), (1, 2)], "src bigint, dst bigint")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "n bigint")
    assert rows(G.bfs(e, node(1))) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert rows(G.components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6), (8, 8)]
    assert rows(G.strongly_connected(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (8, 8)]
    goals = spark.createDataFrame([(1, 5), (5, 1), (2, 2), (6, 7)], "a bigint, b bigint")
    assert rows(G.bidijkstra(e, goals)) == [(1, 5, 4), (2, 2, 0), (6, 7, 1)]
    assert rows(G.k_core(e, 2)) == [(1, 2), (1, 3), (2, 3)]
    assert rows(G.sequence(e, node(1, 9))) == [(1, 0), (2, 1), (3, 2), (4, 0), (5, 1), (6, 0), (7, 1), (8, 0), (9, 0)]


def test_identifiers_are_unique(spark):
    out = G.identifiers(spark.range(200).select((F.col("id") % 50).alias("x")), "i")
    assert out.count() == out.select("i").distinct().count() == 50
