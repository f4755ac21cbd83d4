"""Served SQL to DataFrames: a syntax tree becomes Spark SQL over temporary views.

CTEs are views of their own; recursive ones run as a fixpoint.  Everything relational is left to
Catalyst; only what Spark's dialect lacks or does otherwise is rewritten.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.functions import dialect
from tidemark.operators import recursion
from tidemark.plans import ast, parser
from tidemark.plans.ast import Derived, Join, Query, Select, SetOp, SqlError, Table
from tidemark.session import ship

_serial = itertools.count()
_CAST = {"string": "STRING", "int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN", "uuid": "STRING", "jsonb": "VARIANT"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


class Engine:
    """Compiles queries over named tables.

    ``table`` gives the DataFrame of a base table (permission filters included), ``bind`` the
    literal expression of a parameter.
    """

    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame | None], bind: Callable[[tuple], tuple] | None = None) -> None:
        self.spark, self.table, self.bind = spark, table, bind
        self.views: dict[str, str] = {}

    def sql(self, text: str) -> DataFrame:
        return self.run(parser.parse(text))

    def run(self, q: Query) -> DataFrame:
        return self.spark.sql(self.query(q, {}))

    def _view(self, df: DataFrame, name: str) -> str:
        view = f"tm_{next(_serial)}_{''.join(c if c.isalnum() else '_' for c in name)}"
        df.createOrReplaceTempView(view)
        return view

    # --- queries -------------------------------------------------------------------------------

    def query(self, q: Query, scope: dict[str, str]) -> str:
        """Spark SQL text of a query; ``scope`` maps visible CTE names to views."""
        scope = dict(scope)
        for c in q.ctes:
            own = any(isinstance(n, Table) and n.name == c.name for n in ast.nodes(c.query))
            df = self._recursive(c, scope) if q.recursive and own else self.spark.sql(self.query(c.query, scope))
            if c.columns:
                df = df.toDF(*c.columns)
            scope[c.name] = self._view(df, c.name)
        limit, offset = self._number(q.limit), self._number(q.offset)
        if isinstance(q.body, Select) and (q.body.distinct_on or q.order):
            text = self._ordered(q, scope, limit is not None or bool(offset))
        else:
            text = self.body(q.body, scope)
            if q.order:
                columns = self.spark.sql(text).columns
                keys = [self._output_key(e, columns) + self._direction(asc, first) for e, asc, first in q.order]
                text = f"SELECT * FROM ({text}) ORDER BY {', '.join(keys + self._ties(text))}"
            elif limit is not None or offset:
                text = f"SELECT * FROM ({text})"
        return text + (f" LIMIT {limit}" if limit is not None else "") + (f" OFFSET {offset}" if offset else "")

    def _number(self, n) -> int | None:
        if not isinstance(n, tuple):
            return n
        value = self._bound(n)
        if value[:2] != ("lit", "int"):
            raise SqlError("NonLiteralLimit", str(value))
        return value[2]

    @staticmethod
    def _direction(ascending: bool, first: bool | None) -> str:
        """NULL is the greatest value unless the query says otherwise."""
        first = not ascending if first is None else first
        return f" {'ASC' if ascending else 'DESC'} NULLS {'FIRST' if first else 'LAST'}"

    def _ties(self, text: str) -> list[str]:
        schema = self.spark.sql(text).schema
        return [f"{i + 1} ASC NULLS LAST" for i, f in enumerate(schema) if not isinstance(f.dataType, (T.VariantType, T.MapType))]

    def _output_key(self, e: tuple, columns: list[str]) -> str:
        if e[:2] == ("lit", "int") and 1 <= e[2] <= len(columns):
            return quoted(columns[e[2] - 1])
        if e[0] == "col" and e[1][-1] in columns:
            return quoted(e[1][-1])
        raise SqlError("UnresolvedOrderKey", str(e))

    def _ordered(self, q: Query, scope: dict[str, str], cut: bool) -> str:
        """ORDER BY and DISTINCT ON: keys the result lacks are hidden columns, ties fall by the whole row."""
        s = q.body
        plain = self.select(s, scope)
        out = self.spark.sql(plain).schema
        names = [f"c{i}" for i in range(len(out))]
        aliases = {a: i for i, (e, a) in enumerate(s.items) if a} if not any(e[0] == "star" for e, _ in s.items) else {}
        if s.distinct_on:
            want = [self._same(e, s) for e in s.distinct_on]
            have = [self._same(e, s) for e, *_ in q.order[: len(want)]]
            if q.order and any(h not in want for h in have):
                raise SqlError("DistinctOnOrder", "DISTINCT ON must match the first ORDER BY keys")
        hidden: list[str] = []

        def key(e: tuple) -> str:
            if e[:2] == ("lit", "int") and 1 <= e[2] <= len(names):
                return names[e[2] - 1]
            if e[0] == "col" and len(e[1]) == 1 and e[1][0] in aliases:
                return names[aliases[e[1][0]]]
            if s.distinct:
                return names[[f.name for f in out].index(e[1][-1])]
            hidden.append(self.expr(e, s, scope))
            return f"k{len(hidden) - 1}"

        on = [key(e) for e in s.distinct_on]
        keys = [key(e) + self._direction(a, f) for e, a, f in q.order]
        ties = [f"{n} ASC NULLS LAST" for n, f in zip(names, out) if not isinstance(f.dataType, (T.VariantType, T.MapType))]
        inner = self.select(s, scope, names, hidden)
        back = ", ".join(f"{n} AS {quoted(f.name)}" for n, f in zip(names, out))
        if on:
            inner = f"SELECT *, row_number() OVER (PARTITION BY {', '.join(on)} ORDER BY {', '.join(keys + ties)}) AS rk FROM ({inner})"
            inner = f"SELECT * FROM ({inner}) WHERE rk = 1"
        return f"SELECT {back} FROM ({inner})" + (f" ORDER BY {', '.join(keys + ties)}" if q.order or cut else "")

    @staticmethod
    def _same(e: tuple, s: Select) -> tuple:
        """An ORDER BY or ON key without qualifier, aliases looked through."""
        if e[:2] == ("lit", "int") and e[2] <= len(s.items):
            e = s.items[e[2] - 1][0]
        for item, alias in s.items:
            if e == ("col", (alias,)):
                e = item
        return ("col", e[1][-1:]) if e[0] == "col" else e

    def body(self, b: object, scope: dict[str, str]) -> str:
        if isinstance(b, Query):
            return self.query(b, scope)
        if isinstance(b, SetOp):
            left, right = self.body(b.left, scope), self.body(b.right, scope)
            wl, wr = len(self.spark.sql(left).columns), len(self.spark.sql(right).columns)
            if wl != wr:
                raise SqlError("SetOperationArity", f"{wl} and {wr} columns")
            return f"(SELECT * FROM ({left})) {b.op.upper()}{' ALL' if b.all_rows else ''} (SELECT * FROM ({right}))"
        return self.select(b, scope)

    def select(self, s: Select, scope: dict[str, str], names: list[str] | None = None, hidden: list[str] | None = None) -> str:
        source = self.source(s.source, scope)
        items: list[str] = []
        for e, alias in s.items:
            if e[0] == "star":
                items.append(f"{quoted(e[1])}.*" if e[1] else "*")
            else:
                items.append(f"{self.expr(e, s, scope)} AS {quoted(alias or self.name(e))}")
        tail = f" FROM {source}"
        if s.where is not None:
            tail += f" WHERE {self.expr(s.where, s, scope)}"
        if s.group:
            tail += " GROUP BY " + ", ".join(self.expr(e, s, scope) for e in s.group)
        if s.having is not None:
            tail += f" HAVING {self.expr(s.having, s, scope)}"
        first = "SELECT DISTINCT " if s.distinct else "SELECT "
        if names is None:
            return first + ", ".join(items) + tail
        extra = [f"{h} AS k{i}" for i, h in enumerate(hidden or [])]
        if any(e[0] == "star" for e, _ in s.items):
            view = [quoted(c) for c in self._star_columns(s, scope)]
            items = view
        renamed = [f"{i.rpartition(' AS ')[0] or i} AS {n}" if " AS " in i else f"{i} AS {n}" for i, n in zip(items, names)]
        return first + ", ".join(renamed + extra) + tail

    def _star_columns(self, s: Select, scope: dict[str, str]) -> list[str]:
        columns = self.spark.sql(self.select(s, scope)).columns
        if len(set(columns)) < len(columns):
            raise SqlError("AmbiguousColumn", "sorting a * with equal names")
        return columns

    def name(self, e: tuple) -> str:
        """The name of an unaliased item."""
        if e[0] == "col":
            return e[1][-1]
        if e[0] == "cast":
            return self.name(e[1])
        if e[0] == "agg":
            arg = "*" if e[2][0] == "star" else self.name(e[2])
            return f"{e[1]}({'DISTINCT ' if e[3] else ''}{arg})"
        return e[1] if e[0] == "call" else {"case": "case", "lit": "literal"}.get(e[0], "expr")

    def source(self, f: object, scope: dict[str, str]) -> str:
        if isinstance(f, Table):
            return f"{scope.get(f.name) or self._base(f.name)} AS {quoted(f.alias)}"
        if isinstance(f, Derived):
            columns = f" ({', '.join(map(quoted, f.columns))})" if f.columns else ""
            return f"({self.query(f.query, scope) if not f.lateral else self._lateral(f.query, scope)}) AS {quoted(f.alias or f'd{next(_serial)}')}{columns}"
        left = self.source(f.left, scope)
        if "lateral" in f.kind:
            return f"{left} {'LEFT' if 'left' in f.kind else 'INNER'} JOIN LATERAL {self.source(f.right, scope)} ON TRUE"
        on = " AND ".join(f"{self._column(c[2])} = {self._column(c[3])}" for c in parser.conjuncts(f.on))
        return f"{left} {f.kind.upper()} JOIN {self.source(f.right, scope)} ON {on}"

    def _lateral(self, q: Query, scope: dict[str, str]) -> str:
        return self.select(q.body, scope)

    @staticmethod
    def _column(e: tuple) -> str:
        return ".".join(quoted(p) for p in e[1][-2:])

    def _base(self, name: str) -> str:
        if name not in self.views:
            df = self.table(name)
            if df is None:
                raise SqlError("UnknownTable", name)
            self.views[name] = self._view(df, name)
        return self.views[name]

    def _recursive(self, c: ast.Cte, scope: dict[str, str]) -> DataFrame:
        """``base UNION [ALL] step`` with exactly one self-reference in the step."""
        b = c.query.body
        if not isinstance(b, SetOp) or b.op != "union" or c.query.order or c.query.limit is not None:
            raise SqlError("UnsupportedRecursion", "base UNION [ALL] step")
        refs = lambda node: sum(isinstance(n, Table) and n.name == c.name for n in ast.nodes(node))
        if refs(b.left) or refs(b.right) != 1:
            raise SqlError("UnsupportedRecursion", "linear recursion only")
        if isinstance(b.right, Select) and (b.right.group or any(parser.aggregates(e) for e, _ in b.right.items)):
            raise SqlError("UnsupportedRecursion", "aggregate in the step")
        base = self.spark.sql(self.body(b.left, scope))
        if c.columns:
            base = base.toDF(*c.columns)
        view = self._view(base, c.name)
        text = self.body(b.right, scope | {c.name: view})
        schema = base.schema

        def step(frontier: DataFrame) -> DataFrame:
            frontier.createOrReplaceTempView(view)
            out = self.spark.sql(text).toDF(*schema.names)
            return out.select(*[out[f.name].cast(f.dataType) for f in schema])

        return recursion.fixpoint(base, step, b.all_rows)

    # --- expressions ---------------------------------------------------------------------------

    def _type(self, sql: str, s: Select, scope: dict[str, str]) -> T.DataType | None:
        """The type of an expression over the FROM of ``s``; None where outer columns are in it."""
        try:
            over = f" FROM {self.source(s.source, scope)}" if s.source is not None else ""
            return self.spark.sql(f"SELECT {sql} AS x{over}").schema[0].dataType
        except (AnalysisException, SqlError):
            return None

    def _bound(self, e: tuple) -> tuple:
        if self.bind is None:
            raise SqlError("UnboundParameter", str(e[1]))
        return self.bind(e)

    def expr(self, e: tuple, s: Select, scope: dict[str, str]) -> str:
        x = lambda y: self.expr(y, s, scope)
        kind = e[0]
        if kind == "col":
            return self._column(e)
        if kind in ("param", "user"):
            return x(self._bound(e))
        if kind == "lit":
            return self.literal(e)
        if kind == "array":
            return f"array({', '.join(map(x, e[1]))})"
        if kind == "not":
            return f"(NOT {x(e[1])})"
        if kind == "neg":
            return f"(-{x(e[1])})"
        if kind == "is":
            return f"({x(e[1])} IS {'NOT ' if e[3] else ''}{e[2].upper()})"
        if kind == "distinct":
            return f"({x(e[1])} IS {'NOT ' if e[3] else ''}DISTINCT FROM {x(e[2])})"
        if kind == "in":
            against = [self._bound(i) if i[0] in ("param", "user") else i for i in e[2]]
            return f"({self.text_key(e[1], against, s, scope)} {'NOT ' if e[3] else ''}IN ({', '.join(map(x, against))}))"
        if kind == "between":
            return f"({x(e[1])} {'NOT ' if e[4] else ''}BETWEEN {x(e[2])} AND {x(e[3])})"
        if kind == "like":
            return self.like(e, x)
        if kind == "case":
            operand = f" {x(e[1])}" if e[1] else ""
            other = f" ELSE {x(e[3])}" if e[3] else ""
            return f"(CASE{operand}" + "".join(f" WHEN {x(c)} THEN {x(v)}" for c, v in e[2]) + f"{other} END)"
        if kind == "call":
            return f"{e[1]}({', '.join(map(x, e[2]))})"
        if kind == "agg":
            return self.aggregate(e, s, scope)
        if kind == "any":
            return self.any(e, x, s, scope)
        if kind == "cast":
            return self.cast(e, s, scope)
        if kind == "exists":
            return f"EXISTS ({self.query(e[1], scope)})"
        if kind == "bin":
            return self.binary(e, s, scope)
        raise SqlError("UnsupportedFeature", kind)

    @staticmethod
    def literal(e: tuple) -> str:
        kind, v = e[1], e[2]
        if kind == "null":
            return "NULL"
        if kind == "bool":
            return "TRUE" if v else "FALSE"
        if kind == "int":
            return f"CAST({v} AS BIGINT)"
        if kind == "float":
            return f"CAST({v} AS DOUBLE)"
        if kind in ("date", "timestamp"):
            return f"{'TIMESTAMP_NTZ' if kind == 'timestamp' else 'DATE'} {string(v)}"
        return string(v)

    def aggregate(self, e: tuple, s: Select, scope: dict[str, str]) -> str:
        _, f, arg, distinct = e
        if arg[0] == "star":
            return "count(1)"
        a = self.expr(arg, s, scope)
        d = "DISTINCT " if distinct and f not in ("min", "max") else ""
        if f == "sum" and isinstance(self._type(a, s, scope), dialect.INTEGRAL):
            whole = f"sum({d}CAST({a} AS DECIMAL(38,0)))"
            return f"CAST(CASE WHEN {whole} IS NOT NULL THEN least(greatest({whole}, -9223372036854775808), 9223372036854775807) END AS BIGINT)"
        if f == "avg":
            a = f"CAST({a} AS DOUBLE)"
        return f"{f}({d}{a})"

    def like(self, e: tuple, x: Callable) -> str:
        _, value, pattern, escape, neg, folded = e
        pattern = self._bound(pattern) if pattern[0] in ("param", "user") else pattern
        no = "NOT " if neg else ""
        if pattern[:2] == ("lit", "str"):
            if escape == "\\" and "\\" not in pattern[2]:
                return f"({x(value)} {no}{'I' if folded else ''}LIKE {string(pattern[2])})"
            return f"({no}{x(value)} RLIKE {string(dialect.like_pattern(pattern[2], escape, folded))})"
        return f"({x(value)} {no}{'I' if folded else ''}LIKE {x(pattern)} ESCAPE {string(escape or chr(0xE0FF))})"

    def any(self, e: tuple, x: Callable, s: Select, scope: dict[str, str]) -> str:
        _, op, value, array = e
        array = self._bound(array) if array[0] in ("param", "user") else array
        if array[:2] == ("lit", "str"):
            kinds = {bool: "bool", int: "int", float: "float", str: "str", type(None): "null"}
            try:
                items = [("lit", kinds[type(v)], v) for v in dialect.parse_array(array[2])]
            except ValueError as error:
                raise SqlError("Parse", str(error)) from None
            if isinstance(self._type(x(value), s, scope), T.StringType):
                items = [("lit", "str", i[2] if i[1] == "str" else str(i[2])) if i[1] != "null" else i for i in items]
            array = ("array", items)
        if array == ("array", []):
            return "FALSE"
        if array[0] == "array" and all(i[0] in ("lit", "neg") for i in array[1]):
            v, items = self.text_key(value, array[1], s, scope), [x(i) for i in array[1]]
            return f"({v} IN ({', '.join(items)}))" if op == "=" else "(" + " OR ".join(f"{v} {op} {i}" for i in items) + ")"
        if op == "=":
            return f"array_contains({x(array)}, {x(value)})"
        return f"exists({x(array)}, any_item -> {x(value)} {op} any_item)"

    def text_key(self, value: tuple, against: list[tuple], s: Select, scope: dict[str, str]) -> str:
        """A value to be compared with literals.  Where none of them could be the text of an object or
        array, ``->>`` needs no such text and stays in the JVM."""
        if value[:2] == ("bin", "->>") and all(i[0] == "lit" and i[1] in ("str", "null") and (i[2] or "")[:1] not in ("{", "[") for i in against):
            return self.json(self.expr(value[2], s, scope), "->>", value[3], s, scope, exact=False)
        return self.expr(value, s, scope)

    def cast(self, e: tuple, s: Select, scope: dict[str, str]) -> str:
        _, value, target = e
        v = self.expr(value, s, scope)
        if value == ("lit", "null", None):
            return f"CAST(NULL AS {_CAST[target]})"
        t = self._type(v, s, scope)
        if target == "uuid":
            h = f"regexp_replace(lower({v}), '[{{}}-]', '')"
            parts = ", ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
            return f"(CASE WHEN {h} RLIKE '^[0-9a-f]{{32}}$' THEN concat_ws('-', {parts}) END)"
        if target == "jsonb":
            return v if isinstance(t, T.VariantType) else f"try_parse_json(CAST({v} AS STRING))"
        if isinstance(t, T.VariantType):
            return f"try_variant_get({v}, '$', '{_CAST[target].lower()}')"
        if target == "bool":
            if isinstance(t, T.NumericType):
                return f"({v} <> 0)"
            if not isinstance(t, T.BooleanType):
                w = f"lower(trim({v}))"
                return f"(CASE WHEN {w} IN ('t','true','yes','on','1') THEN TRUE WHEN {w} IN ('f','false','no','off','0') THEN FALSE END)"
        if target == "int":
            if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
                return f"try_cast(round({v}) AS BIGINT)"
            if isinstance(t, T.StringType):
                return f"(CASE WHEN trim({v}) RLIKE '^[+-]?[0-9]+$' THEN try_cast(trim({v}) AS BIGINT) END)"
        if target == "string" and isinstance(t, (T.FloatType, T.DoubleType)):
            return self._float_text(v)
        return f"try_cast({v} AS {_CAST[target]})"

    @staticmethod
    def _float_text(v: str) -> str:
        return f"(CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS DECIMAL(20,0)) AS STRING) ELSE CAST({v} AS STRING) END)"

    def binary(self, e: tuple, s: Select, scope: dict[str, str]) -> str:
        _, op, left, right = e
        right = self._bound(right) if right[0] in ("param", "user") else right
        a = self.text_key(left, [right], s, scope) if op in ("=", "<>") else self.expr(left, s, scope)
        b = self.expr(right, s, scope)
        if op in ("and", "or"):
            return f"({a} {op.upper()} {b})"
        if op in ("+", "-", "*", "%"):
            return f"{ {'+': 'try_add', '-': 'try_subtract', '*': 'try_multiply', '%': 'try_mod'}[op] }({a}, {b})"
        if op == "/":
            if all(isinstance(self._type(v, s, scope), dialect.INTEGRAL) for v in (a, b)):
                return f"(CASE WHEN {b} = 0 OR ({a} = -9223372036854775808 AND {b} = -1) THEN NULL ELSE {a} DIV {b} END)"
            return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
        if op == "||":
            text = lambda v: self._float_text(v) if isinstance(self._type(v, s, scope), (T.FloatType, T.DoubleType)) else f"CAST({v} AS STRING)"
            return f"concat({text(a)}, {text(b)})"
        if op in ("->", "->>"):
            return self.json(a, op, right, s, scope)
        types = [self._type(v, s, scope) for v in (a, b)]
        if any(isinstance(t, T.VariantType) for t in types) and op in ("=", "<>"):
            a, b = (f"to_json({v})" if isinstance(t, T.VariantType) else f"to_json(try_parse_json({v}))" for v, t in zip((a, b), types))
        return f"({a} {op} {b})"

    def json(self, a: str, op: str, key: tuple, s: Select, scope: dict[str, str], exact: bool = True) -> str:
        v = a if isinstance(self._type(a, s, scope), T.VariantType) else f"try_parse_json({a})"
        key = self._bound(key) if key[0] in ("param", "user") else key
        if key[0] == "neg" and key[1][:2] == ("lit", "int"):
            key = ("lit", "int", -key[1][2])
        if key[0] != "lit" or key[1] not in ("int", "str"):
            raise SqlError("UnsupportedFeature", "JSON key must be a literal")
        if key[1] == "str":
            path = "$[" + "'" + key[2].replace("\\", "\\\\").replace("'", "\\'") + "']"
            got = f"try_variant_get({v}, {string(path)}, 'variant')"
        elif key[2] >= 0:
            got = f"try_variant_get({v}, '$[{key[2]}]', 'variant')"
        else:
            items = f"try_variant_get({v}, '$', 'array<variant>')"
            got = f"(CASE WHEN size({items}) >= {-key[2]} THEN try_element_at({items}, {key[2]}) END)"
        if op == "->":
            return got
        if not exact:
            return f"(CASE WHEN NOT is_variant_null({got}) THEN try_variant_get({got}, '$', 'string') END)"
        ship(self.spark)
        self.spark.udf.register("tidemark_json_text", dialect.json_nested_text)
        nested = f"schema_of_variant({got}) RLIKE '^(OBJECT|ARRAY)'"
        return (
            f"(CASE WHEN {nested} THEN tidemark_json_text(CASE WHEN {nested} THEN to_json({got}) END) "
            f"WHEN NOT is_variant_null({got}) THEN try_variant_get({got}, '$', 'string') END)"
        )
