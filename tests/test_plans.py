"""Served SQL: what is accepted and refused, rules, named queries, sharing."""

import pytest

from tidemark.plans import ast, parser
from tidemark.plans.ast import SqlError
from tidemark.plans.engine import Engine
from tidemark.plans.permissions import Guarded, Latest, Rule, RuleError, RuleSet, User, fold, load_toml
from tidemark.plans.prepared import QueryError, Registry, blocks
from tidemark.plans.sharing import SharedPlans, normalised, sharing_key

REFUSED = """SELECT 1 FROM a RIGHT JOIN b ON a.x = b.x
SELECT 1 FROM a FULL JOIN b ON a.x = b.x
SELECT 1 FROM a JOIN b ON a.x < b.x
SELECT 1 FROM a CROSS JOIN b
SELECT 1 FROM a JOIN b USING (x)
SELECT 1 FROM a NATURAL JOIN b
SELECT 1 FROM a, b
SELECT 1 FROM f(1)
SELECT sum(x) OVER () FROM a
SELECT (SELECT 1 FROM b) FROM a
SELECT 1 FROM a WHERE x IN (SELECT y FROM b)
SELECT 1 FROM a WHERE x = ANY(SELECT y FROM b)
SELECT 1 FROM a WHERE EXISTS (SELECT 1 FROM b)
SELECT 1 FROM a WHERE x = 1 OR EXISTS (SELECT 1 FROM b WHERE b.y = a.x)
SELECT count(*) FROM a HAVING EXISTS (SELECT 1 FROM b WHERE b.y = a.x)
SELECT 1 FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.x = a.x LIMIT 1)
SELECT x FROM a GROUP BY ALL
SELECT x FROM a GROUP BY ROLLUP(x)
SELECT x FROM a GROUP BY CUBE(x)
SELECT x FROM a GROUP BY GROUPING SETS ((x))
SELECT x FROM a GROUP BY x + 1
SELECT x FROM a HAVING x > 1
VALUES (1)
TABLE a
INSERT INTO a VALUES (1)
DELETE FROM a
SELECT 1 FROM a; SELECT 2 FROM b
SELECT INTERVAL '1 day' FROM a
SELECT 1 FROM a WHERE x ~ 'y'
SELECT 1 FROM a WHERE x SIMILAR TO 'y'
SELECT 1 FROM a WHERE x @> 'y'
SELECT TRY_CAST(x AS int) FROM a
SELECT CAST(x AS int FORMAT 'y') FROM a
SELECT CAST(x AS interval) FROM a
SELECT 1 FROM a UNION BY NAME SELECT 2 FROM b
SELECT 1 FROM a ORDER BY x LIMIT x
SELECT upper(x) FROM a
SELECT TOP 5 x FROM a
SELECT x INTO b FROM a
SELECT x FROM a QUALIFY x
SELECT x FROM a WINDOW w AS (ORDER BY x)
SELECT x FROM a CONNECT BY x
SELECT count(*) FILTER (WHERE x) FROM a
SELECT sum(x => 1) FROM a
SELECT 1 FROM a LEFT JOIN LATERAL (SELECT y FROM b WHERE b.x = a.x LIMIT 1) l ON TRUE""".splitlines()


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(sql):
    with pytest.raises(SqlError):
        parser.parse(sql)


def test_limits():
    for sql in ("SELECT " + "(" * 40 + "1" + ")" * 40 + " FROM a", "SELECT '" + "x" * 70_000 + "' FROM a"):
        with pytest.raises(SqlError):
            parser.parse(sql)


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "readings": make([(11, 3, 40), (12, 3, 40), (13, 3, 65), (14, 5, -2)], "rid int, probe int, level int"),
        "recipes": make([(1, "stew", True), (2, "pie", False), (3, "soup", True)], "num int, label string, served boolean"),
        "loans": make([(61, 9), (62, 9), (63, 4)], "loan int, reader int"),
        "readers": make([(9, "Noor")], "reader_id int, nick string"),
        "rooms": make([(20, 10), (30, 20), (40, 30), (90, 80)], "room int, within int"),
        "vault.papers": make([(5, 1, '{"desk":"d1"}'), (5, 2, '{"desk":"d2"}'), (6, 1, '{"desk":"d1","pages":[8,9]}')], "paper int, edition int, body string"),
    }


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT DISTINCT ON (reader) reader, loan FROM loans ORDER BY reader, loan DESC", [(4, 63), (9, 62)]),
        ("SELECT max(level), count(*), sum(level) FROM readings", [(65, 4, 143)]),
        ("SELECT sum(level), count(level) FROM readings WHERE probe = 77", [(None, 0)]),
        ("SELECT rid FROM readings WHERE probe = ANY('{5, 8}')", [(14,)]),
        ("SELECT rid FROM readings WHERE level BETWEEN 41 AND 70 AND probe IN (3, 4) AND rid - 3 = 10", [(13,)]),
        ("SELECT label || '?' AS q, CASE WHEN served THEN 'hot' ELSE 'cold' END FROM recipes WHERE label LIKE 's%' AND label NOT ILIKE '%TEW' AND label IS DISTINCT FROM 'pie'", [("soup?", "hot")]),
        ("SELECT rid FROM readings WHERE (level = 65 OR rid = 14) AND NOT (probe = 5) ORDER BY rid", [(13,)]),
        ("SELECT (level - rid) * 3 AS x FROM readings WHERE rid = 12", [(84,)]),
        ("WITH RECURSIVE inner_rooms AS (SELECT room FROM rooms WHERE within = 10 UNION SELECT x.room FROM rooms x JOIN inner_rooms i ON x.within = i.room) SELECT room FROM inner_rooms ORDER BY room DESC", [(40,), (30,), (20,)]),
        ("WITH RECURSIVE d(r) AS (SELECT room FROM rooms WHERE within = 20 UNION ALL SELECT x.room FROM rooms x JOIN d ON x.within = d.r) SELECT count(*) FROM d", [(2,)]),
        ("SELECT nick, loan FROM loans LEFT JOIN readers ON readers.reader_id = loans.reader ORDER BY nick, loan DESC", [("Noor", 62), ("Noor", 61), (None, 63)]),
        ("SELECT probe, min(level) AS low FROM readings GROUP BY probe HAVING avg(level) < 10", [(5, -2)]),
        ("SELECT loan FROM loans WHERE NOT EXISTS (SELECT 1 FROM readers WHERE readers.reader_id = loans.reader)", [(63,)]),
        ("SELECT one.loan, two.loan FROM loans one JOIN loans two ON one.reader = two.reader WHERE one.loan < two.loan", [(61, 62)]),
        ("SELECT level FROM readings EXCEPT ALL SELECT level FROM readings WHERE rid = 11 ORDER BY level LIMIT 2", [(-2,), (40,)]),
        ("SELECT body->>'desk', body->'pages'->>-2 FROM vault.papers WHERE paper = 6", [("d1", "8")]),
        ("SELECT 9/4, -9/4, 5%0, 2/0.0, '3.4'::float::int, 'no'::bool, 2.0::text FROM readers", [(2, -2, None, None, 3, False, "2")]),
        ("SELECT s.top FROM (SELECT probe, max(level) AS top FROM readings GROUP BY probe) AS s ORDER BY top LIMIT 1", [(-2,)]),
        ("SELECT recipes.* FROM recipes ORDER BY label OFFSET 2", [(1, "stew", True)]),
    ],
)
def test_served_rows(spark, tables, sql, want):
    assert [tuple(r) for r in Engine(spark, tables.get).sql(sql).collect()] == want


def test_long_recursion(spark):
    """A chain longer than any fixed number of rounds that one would think of in a test."""
    chain = spark.range(1, 25).selectExpr("cast(id as int) AS room", "cast(id - 1 as int) AS within")
    e = Engine(spark, {"rooms": chain}.get)
    for every in ("", "ALL"):
        sql = f"WITH RECURSIVE d(r) AS (SELECT room FROM rooms WHERE within = 0 UNION {every} SELECT x.room FROM rooms x JOIN d ON x.within = d.r) SELECT count(*), max(r) FROM d"
        assert [tuple(r) for r in e.sql(sql).collect()] == [(24, 24)]


def test_errors_of_running(spark, tables):
    e = Engine(spark, tables.get)
    for sql in ("SELECT 1 FROM nowhere", "SELECT num FROM recipes UNION SELECT num, label FROM recipes", "SELECT DISTINCT ON (num) num FROM recipes ORDER BY label", "SELECT num FROM recipes WHERE num = $1"):
        with pytest.raises(SqlError):
            e.sql(sql)


# --- rules --------------------------------------------------------------------------------------


def _rules(*rules, **fields):
    cols = {"loans": ["loan", "reader"], "vault.papers": ["paper", "edition", "body"]}
    return RuleSet(list(rules), cols, fields)


def test_rules_filter_every_scan(spark, tables, rows):
    r = _rules(Rule("own", "loans", "reader = $user.id AND (loan = 61 OR loan = 63)"), Rule("more", "loans", "reader = ANY($user.more)"), id="int", more="int")
    g = Guarded(spark, tables.get, r, User(r.fields, {"id": 9, "more": [4]}))
    assert rows(g.sql("SELECT loan FROM loans")) == [(61,), (63,)]
    assert rows(g.sql("SELECT a.loan FROM loans a JOIN loans b ON a.loan = b.loan WHERE EXISTS (SELECT 1 FROM loans c WHERE c.loan = a.loan)")) == [(61,), (63,)]
    assert rows(Guarded(spark, tables.get, r, User(r.fields, {"id": 0, "more": []})).sql("SELECT loan FROM loans")) == []
    assert g.sql("SELECT num FROM recipes").count() == 3  # no rule, no filter


def test_latest_before_filter(spark, tables, rows):
    r = _rules(Rule("p", "vault.papers", "$user.admin OR body->>'desk' = ANY($user.p)", latest=Latest(("paper",), "edition")), admin="bool", p="text")
    see = lambda **v: rows(Guarded(spark, tables.get, r, User(r.fields, v)).sql("SELECT paper, edition FROM vault.papers"))
    assert see(admin=False, p=["d1"]) == [(6, 1)]  # the newer, hidden version hides the older one
    assert see(admin=True, p=[]) == [(5, 2), (6, 1)]


@pytest.mark.parametrize(
    "rules,fields,code",
    [
        ([Rule("a", "nope", "TRUE")], {}, "UnknownTable"), ([Rule("a", "loans", "zz = 1")], {}, "UnknownColumn"),
        ([Rule("a", "loans", "loan = $user.x")], {}, "UnknownUserField"), ([Rule("a", "loans", "loan = 1"), Rule("a", "loans", "loan = 2")], {}, "DuplicateRule"),
        ([Rule("a", "loans", "loan = 1"), Rule("b", "loans", "loan  =  1")], {}, "AmbiguousRule"), ([Rule("a", "loans", "loan = 1", "sometimes")], {}, "UnknownMode"),
        ([Rule("a", "vault.papers", "paper = 1", latest=Latest(("paper",), "edition")), Rule("b", "vault.papers", "paper = 2")], {}, "LatestMismatch"),
        ([Rule("a", "loans", "loan = 1", "subscribe", Latest(("loan",), "loan"))], {}, "LatestOnSubscribe"), ([], {"x": "blob"}, "UnknownFieldType"),
    ],
)
def test_bad_rules(rules, fields, code):
    with pytest.raises(RuleError) as e:
        _rules(*rules, **fields)
    assert e.value.code == code


def test_subscribing_and_users(spark, tables):
    r = _rules(Rule("a", "loans", "$user.admin AND loan > 0", "subscribe"), admin="bool")
    with pytest.raises(RuleError):
        Guarded(spark, tables.get, r, User(r.fields, {"admin": False})).sql("SELECT loan FROM loans")
    assert Guarded(spark, tables.get, r, User(r.fields, {"admin": True})).sql("SELECT loan FROM loans").count() == 3
    for values in ({"other": 1}, {"admin": "yes"}):
        with pytest.raises(RuleError):
            User(r.fields, values).literal("admin")
    assert fold(parser.parse_predicate("1 = 2 OR loan = 1"), User({}, {})) is None
    assert fold(parser.parse_predicate("NOT (1 = 1) AND loan = 1"), User({}, {})) is False


def test_toml():
    rules, fields = load_toml('[[user_context]]\nname = "id"\ntype = "int"\n[[rule]]\nname = "r"\ntable = "loans"\npredicate = "loan = $user.id"\nlatest = { key = ["loan"], version = "v" }')
    assert rules == [Rule("r", "loans", "loan = $user.id", "both", Latest(("loan",), "v"))] and fields == {"id": "int"}


# --- named queries ------------------------------------------------------------------------------

FILE = """
-- name: Make :exec
INSERT INTO recipes VALUES ($1);
-- live
-- name: ByLabel :many
SELECT num FROM recipes WHERE label LIKE $1 AND served = sqlc.narg(p) ORDER BY num;
-- name: First :one
-- live:
SELECT loan FROM loans WHERE reader = ANY($1) ORDER BY loan LIMIT $2;
"""


def test_named_queries(spark, tables, rows):
    reg = Registry(spark, {n: t.schema for n, t in tables.items()})
    assert reg.register_file(FILE, marker="live") == ["ByLabel", "First"]
    q = reg.queries["First"]
    assert (q.params["1"].kind, q.params["1"].is_list, q.params["2"].kind, q.tables) == ("int", True, "int", {"loans"})
    assert reg.queries["ByLabel"].params["p"].kind == "bool" and reg.queries["ByLabel"].params["p"].nullable
    assert rows(reg.bind("First", {"1": [9, 4], "2": 3}, tables.get)) == [(61,)]
    assert rows(reg.bind("ByLabel", {"1": "s%", "p": True}, tables.get)) == [(1,), (3,)]
    assert rows(reg.bind("ByLabel", {"1": "s%"}, tables.get)) == []  # NULL matches nothing
    assert rows(reg.bind("ByLabel", {"1": "x' OR '1'='1", "p": True}, tables.get)) == []
    for values, code in (({"1": 5, "2": 1}, "TypeMismatch"), ({"1": [1]}, "MissingParameter"), ({"1": [1] * 2000, "2": 1}, "ListTooLong"), ({"1": [1], "2": 1, "z": 1}, "UnknownParameter"), ({"1": ["a"], "2": 1}, "TypeMismatch")):
        with pytest.raises(QueryError) as e:
            reg.bind("First", values, tables.get)
        assert e.value.code == code
    with pytest.raises(QueryError):
        reg.run_raw("SELECT num FROM recipes", tables.get)
    with pytest.raises(QueryError):
        reg.register_file(FILE)


def test_registering_checks_names(spark, tables):
    reg = Registry(spark, {n: t.schema for n, t in tables.items()})
    for sql in ("SELECT num FROM recipez", "SELECT nope FROM recipes"):
        with pytest.raises((QueryError, SqlError)):
            reg.register("q", sql)
    q = reg.register("anti", "SELECT num FROM recipes WHERE NOT EXISTS (SELECT 1 FROM loans WHERE loans.loan = recipes.num)")
    assert q.anti_join_only("loans") and not q.anti_join_only("recipes")
    assert [b[:2] for b in blocks(FILE)] == [("Make", ":exec"), ("ByLabel", ":many"), ("First", ":one")]


def test_sharing():
    assert normalised("select  NUM from recipes -- x\n;") == normalised("SELECT num FROM recipes")
    assert normalised("SELECT 'A' FROM t") != normalised("SELECT 'a' FROM t")
    r = _rules(Rule("own", "loans", "reader = $user.id"), id="int")
    key = lambda u, v=1, r=r: sharing_key("SELECT loan FROM loans", {"1": v}, r, User(r.fields, {"id": u}))
    assert key(1) == key(1) and key(1) != key(2) and key(1) != key(1, 2)
    other = r.swap([Rule("own", "loans", "reader = $user.id OR loan = 1")])
    assert key(1, r=other) != key(1) == key(1, r=other.swap(r.rules)) and other.version != r.version
    stopped = []
    s = SharedPlans(lambda k: object(), stopped.append)
    a, b = s.acquire(key(1)), s.acquire(key(1))
    assert a is b and not s.release(key(1)) and not stopped
    s.release(key(1))
    assert stopped == [a]
    assert ast.tables(parser.parse("WITH x AS (SELECT 1 FROM a) SELECT 1 FROM x JOIN b ON x.i = b.i")) == {"a", "b"}


def test_types_and_cli(tmp_path, capsys):
    from pyspark.sql import types as T

    from tidemark.cli import main
    from tidemark.plans.typegen import interface

    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("a-b", T.DoubleType())])
    assert interface("Q", schema) == 'export interface QRow {\n  id: bigint;\n  tags: (string | null)[] | null;\n  "a-b": number | null;\n}\n'
    queries, rules = tmp_path / "q.sql", tmp_path / "r.toml"
    queries.write_text("-- name: N :many\nSELECT n_name FROM nation WHERE n_regionkey = $1;\n")
    rules.write_text('[[user_context]]\nname = "r"\ntype = "int"\n[[rule]]\nname = "x"\ntable = "nation"\npredicate = "n_regionkey = $user.r"\n')
    base = ["--tables", "/root/testdata/sf0.001"]
    assert main([*base, "validate", "--rules", str(rules), "--queries", str(queries)]) == 0
    assert main([*base, "typegen", str(queries)]) == 0
    assert main([*base, "eval", "--rules", str(rules), "--user", '{"r": 1}', "SELECT count(*) AS n FROM nation"]) == 0
    out = capsys.readouterr().out
    assert "1 rules, 1 queries" in out and "n_name: string | null" in out and '{"n":5}' in out
    assert main([*base, "eval", "--rules", str(rules), "SELECT n_name FROM nation"]) == 1
