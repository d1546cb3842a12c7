"""SELECT statements of PostgreSQL's dialect as Spark SQL with the same results.

One pass over the tokens, FROM before the select list, so that each expression's type is known when it is written:
integer division, exact averages, rounding, casts, blank-insensitive char(n) comparison and the like depend on it.
What Spark does alike goes through as it is; what neither side of the translation knows raises UnsupportedFeature.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as text_functions
from ..operators.relational import unique_names, with_ties
from .explain import explained, options_of


class UnsupportedFeature(ValueError):
    """The statement uses something that has no translation."""


class Expr(NamedTuple):
    sql: str
    type: str


INTS = ("smallint", "int", "bigint")
FLOATS = ("float", "double")
#: Type names of the dialect, fixed values.
TYPES = {
    "bool": "boolean", "boolean": "boolean", "int2": "smallint", "smallint": "smallint", "int": "int", "int4": "int", "integer": "int", "int8": "bigint", "bigint": "bigint",
    "float4": "float", "real": "float", "float8": "double", "float": "double", "double precision": "double", "numeric": "numeric", "decimal": "numeric",
    "text": "string", "name": "string", "varchar": "string", "character varying": "string", "char": "bpchar", "bpchar": "bpchar", "character": "bpchar",
    "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "bytea": "binary", "uuid": "string", "interval": "interval", "time": "time",
}
OPEN = "decimal(38,16)"
TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<str>[eE]?'(?:[^']|'')*')|(?P<q>"(?:[^"]|"")*")|(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<id>[A-Za-z_][A-Za-z_0-9$]*)|(?P<op>::|<>|!=|<=|>=|\|\||<<|>>|!~~\*|!~~|~~\*|~~|!~\*|!~|~\*|[-+*/%^<>=~()\[\],.;:|&#@!?$])""", re.S)
STOPS = ("from", "where", "group", "having", "window", "order", "limit", "offset", "fetch", "union", "intersect", "except", "for")
JOINS = ("join", "inner", "left", "right", "full", "cross", "natural", "on", "using")
AGGREGATES = ("count", "sum", "avg", "min", "max", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "covar_pop", "covar_samp", "corr", "string_agg", "regr_count", "regr_sxx", "regr_syy", "regr_sxy", "regr_avgx", "regr_avgy", "regr_r2", "regr_slope", "regr_intercept")
RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value")
#: Functions that are alike on both sides, with their result type ("=" is the argument's).
ALIKE = {"abs": "=", "exp": "double", "ln": "double", "sqrt": "double", "sinh": "double", "cosh": "double", "tanh": "double", "asinh": "double", "acosh": "double", "atanh": "double", "power": "double", "reverse": "string", "lower": "string", "upper": "string", "random": "double", "greatest": "=", "least": "=", "date_trunc": "timestamp_ntz", "replace": "string", "left": "string", "right": "string", "btrim": "string", "ltrim": "string", "rtrim": "string"}


def tokens_of(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise UnsupportedFeature(f"cannot read {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup == "id":
            out.append(("id", m["id"].lower()))
        elif m.lastgroup == "q":
            out.append(("q", m["q"][1:-1].replace('""', '"')))
        elif m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
    return [*out, ("end", "")]


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Scope:
    """What names mean: relations in order, each with its columns and their types; `outer` for correlated subqueries."""

    relations: list[tuple[str, list[tuple[str, str]]]] = field(default_factory=list)
    merged: dict[str, str] = field(default_factory=dict)
    outer: Scope | None = None

    def find(self, name: str, relation: str | None = None) -> Expr | None:
        if relation is None and name in self.merged:
            return Expr(ident(name), self.merged[name])
        for alias, columns in self.relations:
            if relation in (None, alias):
                for column, kind in columns:
                    if column.lower() == name.lower():
                        return Expr(f"{ident(alias)}.{ident(column)}", kind)
        return self.outer.find(name, relation) if self.outer else None

    def star(self, relation: str | None = None) -> list[tuple[str, Expr]]:
        out, seen = [], set()
        if relation is None:
            for name, kind in self.merged.items():
                out.append((name, Expr(ident(name), kind)))
                seen.add(name)
        for alias, columns in self.relations:
            if relation in (None, alias):
                out += [(c, Expr(f"{ident(alias)}.{ident(c)}", k)) for c, k in columns if c not in seen]
        return out


class Layer(Scope):
    """The same names over one subquery, whose columns are called relation.column."""

    def find(self, name: str, relation: str | None = None) -> Expr | None:
        for alias, columns in self.relations:
            if relation in (None, alias):
                for column, kind in columns:
                    if column.lower() == name.lower():
                        return Expr(f"`__lk_w`.{ident(f'{alias}.{column}')}", kind)
        return self.outer.find(name, relation) if self.outer else None

    def star(self, relation: str | None = None) -> list[tuple[str, Expr]]:
        return [(c, self.find(c, alias)) for alias, columns in self.relations if relation in (None, alias) for c, _ in columns]


class Output(NamedTuple):
    sql: str
    columns: list[tuple[str, str]]


class Ties(NamedTuple):
    """FETCH FIRST `rows` WITH TIES by output columns, each with whether it descends."""

    rows: int
    keys: list[tuple[str, bool]]


class Translator:
    def __init__(self, text: str, tables: Mapping[str, list[tuple[str, str]]], views: Mapping[str, str] | None = None, parameters: Sequence[Any] = ()):
        self.tokens, self.at = tokens_of(text), 0
        self.tables = dict(tables)
        self.views, self.parameters = dict(views or {}), list(parameters)
        self.ties: Ties | None = None
        self.depth = 0
        self.ctes: dict[str, list[tuple[str, str]]] = {}
        self.names = 0
        self.ranks: list[str] = []

    # tokens

    def peek(self, ahead: int = 0) -> str:
        kind, text = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return text if kind in ("id", "op") else ""

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0]

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise UnsupportedFeature(f"expected {' '.join(words)} at {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, text = self.tokens[self.at]
        if kind not in ("id", "q"):
            raise UnsupportedFeature(f"expected a name at {text!r}")
        self.at += 1
        return text

    def fresh(self) -> str:
        self.names += 1
        return f"__lk_{self.names}"

    # queries

    def statement(self) -> Output:
        out = self.query(None)
        self.take(";")
        if self.kind() != "end":
            raise UnsupportedFeature(f"cannot read on from {self.tokens[self.at][1]!r}")
        return out

    def query(self, outer: Scope | None) -> Output:
        self.depth += 1
        try:
            return self.whole_query(outer)
        finally:
            self.depth -= 1

    def whole_query(self, outer: Scope | None) -> Output:
        prefix, saved = "", dict(self.ctes)
        if self.take("with"):
            if self.take("recursive"):
                raise UnsupportedFeature("recursive queries: use Spark SQL's own")
            parts = []
            while True:
                name = self.name()
                columns = self.column_names() if self.peek() == "(" else None
                self.need("as")
                self.take("not") or True
                self.take("materialized")
                self.need("(")
                made = self.query(None)
                self.need(")")
                kinds = [(n, k) for n, (_, k) in zip(columns or [c for c, _ in made.columns], made.columns, strict=False)]
                self.ctes[name] = kinds
                parts.append(f"{ident(name)}({', '.join(ident(c) for c, _ in kinds)}) AS ({made.sql})")
                if not self.take(","):
                    break
            prefix = f"WITH {', '.join(parts)} "
        out, scope = self.core(outer)
        while self.peek() in ("union", "intersect", "except"):
            word = self.name()
            every = " ALL" if self.take("all") else ""
            self.take("distinct")
            right, _ = self.core(outer)
            if len(out.columns) != len(right.columns):
                raise UnsupportedFeature("set operations need as many columns on either side")
            out = Output(f"{out.sql} {word.upper()}{every} {right.sql}", [(n, common(k, j)) for (n, k), (_, j) in zip(out.columns, right.columns, strict=True)])
        out = self.tail(out, scope)
        self.ctes = saved
        return Output(prefix + out.sql, out.columns)

    def tail(self, out: Output, scope: Scope) -> Output:
        sql, order = out.sql, ""
        if self.take("order", "by"):
            order = self.order(scope, out)
            sql += f" ORDER BY {order}"
        while self.peek() in ("limit", "offset", "fetch", "for"):
            if self.take("limit"):
                if not (self.take("null") or self.take("all")):
                    sql += f" LIMIT {self.expr(scope).sql}"
            elif self.take("offset"):
                n = self.expr(scope).sql if not self.take("null") else "0"
                self.take("rows") or self.take("row")
                sql += f" OFFSET {n}"
            elif self.take("fetch"):
                self.take("first") or self.need("next")
                n = "1" if self.peek() in ("row", "rows") else self.expr(scope).sql
                self.take("rows") or self.need("row")
                if self.take("only"):
                    sql += f" LIMIT {n}"
                else:
                    self.need("with", "ties")
                    self.ties = self.tied(out, order, n)
                    if " OFFSET " in sql:
                        raise UnsupportedFeature("OFFSET and WITH TIES")
                    sql = out.sql
            else:
                self.need("for")
                self.take("update") or self.need("share")
        if " LIMIT " in sql and " OFFSET " in sql:
            m = re.search(r" OFFSET (\S+) LIMIT (\S+)$", sql)
            sql = sql[: m.start()] + f" LIMIT {m[2]} OFFSET {m[1]}" if m else sql
        return Output(sql, out.columns)

    def tied(self, out: Output, order: str, n: str) -> Ties:
        """What WITH TIES asks for, of a statement's outermost query whose keys are output columns in their default order of nulls."""
        names = {ident(c): c for c, _ in out.columns}
        parts = [re.fullmatch(r"(`(?:[^`]|``)+`) (ASC NULLS LAST|DESC NULLS FIRST)", x) for x in order.split(", ")]
        if self.depth > 1 or not re.fullmatch(r"\(?\d+\)?", n) or not all(m and m[1] in names for m in parts):
            raise UnsupportedFeature("WITH TIES but of a whole statement by output columns")
        return Ties(int(n.strip("()")), [(names[m[1]], m[2].startswith("DESC")) for m in parts])

    def core(self, outer: Scope | None) -> tuple[Output, Scope]:
        if self.take("("):
            made = self.query(outer)
            self.need(")")
            return Output(f"({made.sql})", made.columns), Scope()
        if self.peek() == "values":
            made = self.values(outer)
            return made, Scope()
        self.need("select")
        begin = self.at
        scope = Scope(outer=outer)
        stop = self.ahead(STOPS)
        self.at = stop
        source = ""
        if self.take("from"):
            parts = [self.joined(scope)]
            while self.take(","):
                parts.append(self.joined(scope))
            source = f" FROM {' CROSS JOIN '.join(parts)}"
        after = self.at
        # the select list
        self.at = begin
        distinct, on = "", None
        if self.take("distinct"):
            if self.take("on"):
                self.need("(")
                on = [self.expr(scope)]
                while self.take(","):
                    on.append(self.expr(scope))
                self.need(")")
            else:
                distinct = "DISTINCT "
        else:
            self.take("all")
        # named windows are after the list
        list_at, self.at = self.at, after
        where = f" WHERE {self.expr(scope).sql}" if self.take("where") else ""
        saved, self.ranks = self.ranks, []
        by_groups = any(t == ("id", "groups") for t in self.tokens[begin : self.ahead(("order", "limit", "offset", "fetch", "union", "intersect", "except", "for"))])
        if by_groups:
            # ranks of peers come first, in a layer below; names then mean that layer's columns
            columns = [(alias, c, k) for alias, of in scope.relations for c, k in of]
            layer = ", ".join(f"{ident(alias)}.{ident(c)} AS {ident(f'{alias}.{c}')}" for alias, c, _ in columns)
            source, where = f"(SELECT {layer}{source}{where}) AS `__lk_w`", ""
            scope = Layer([(alias, of) for alias, of in scope.relations], dict(scope.merged), outer)
        group_at = self.at
        depth_end = self.ahead(("window", "order", "limit", "offset", "fetch", "union", "intersect", "except", "for"))
        self.at = depth_end
        named = ""
        if self.take("window"):
            parts = []
            while True:
                name = self.name()
                self.need("as")
                self.need("(")
                parts.append(f"{ident(name)} AS ({self.window(scope)})")
                self.need(")")
                if not self.take(","):
                    break
            named = f" WINDOW {', '.join(parts)}"
        end = self.at
        self.at = list_at
        items: list[tuple[str, Expr]] = []
        while self.at < stop:
            items += self.item(scope)
            if not self.take(","):
                break
        if self.at != stop:
            raise UnsupportedFeature(f"cannot read {self.tokens[self.at][1]!r} in the select list")
        self.at = group_at
        group = having = ""
        if self.take("group", "by"):
            group = f" GROUP BY {self.groups(scope, items)}"
        if self.take("having"):
            having = f" HAVING {self.expr(scope).sql}"
        if self.at != depth_end:
            raise UnsupportedFeature(f"cannot read {self.tokens[self.at][1]!r}")
        self.at = end
        if by_groups:
            if group:
                raise UnsupportedFeature("GROUPS frames over groups")
            source = f" FROM (SELECT *{''.join(f', {r}' for r in self.ranks)} FROM {source}) AS `__lk_w`"
        self.ranks = saved
        names = self.unique([n for n, _ in items])
        listed = ", ".join(f"{e.sql} AS {ident(n)}" for n, (_, e) in zip(names, items, strict=True))
        columns = [(n, e.type) for n, (_, e) in zip(names, items, strict=True)]
        if on is None:
            return Output(f"SELECT {distinct}{listed}{source}{where}{group}{having}{named}", columns), scope
        order = ""
        if self.take("order", "by"):
            order = self.order(scope, Output("", columns))
        keys = ", ".join(e.sql for e in on)
        first, alias = self.fresh(), self.fresh()
        numbered = f"SELECT {listed}, row_number() OVER (PARTITION BY {keys} ORDER BY {self.unaliased(order, columns, items) or keys}) AS {first}{source}{where}{group}{having}{named}"
        return Output(f"SELECT {', '.join(ident(n) for n, _ in columns)} FROM ({numbered}) AS {alias} WHERE {first} = 1", columns), Scope()

    def unaliased(self, order: str, columns, items) -> str:
        """The sort keys with output names replaced by what they stand for, since a window sees only input."""
        for (name, _), (_, e) in zip(columns, items, strict=True):
            order = re.sub(rf"(?<![.\w`]){re.escape(ident(name))}(?![.\w`])", lambda _, e=e: f"({e.sql})", order)
        return order

    def unique(self, names: list[str]) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for n in names:
            seen[n] = seen.get(n, 0) + 1
            out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
        return out

    def ahead(self, words: tuple[str, ...]) -> int:
        """Place of the next of the words at this depth, or of what ends the query."""
        depth, at = 0, self.at
        while self.tokens[at][0] != "end":
            kind, text = self.tokens[at]
            if kind == "op" and text in "([":
                depth += 1
            elif kind == "op" and text in ")]":
                depth -= 1
                if depth < 0:
                    return at
            elif kind == "op" and text == ";" or depth == 0 and kind == "id" and text in words and not (text == "from" and self.tokens[at - 1] == ("id", "distinct")):
                return at
            at += 1
        return at

    def item(self, scope: Scope) -> list[tuple[str, Expr]]:
        if self.take("*"):
            return scope.star()
        if self.kind() in ("id", "q") and self.peek(1) == "." and self.peek(2) == "*":
            relation = self.name()
            self.at += 2
            return scope.star(relation)
        begin = self.at
        e = self.expr(scope)
        if self.take("as"):
            return [(self.name(), e)]
        if self.kind() == "q" or self.kind() == "id" and self.peek() not in STOPS:
            return [(self.name(), e)]
        return [(self.natural_name(begin), e)]

    def natural_name(self, begin: int) -> str:
        """The name of an output column that has none: of a column or function, of a cast's type, or ?column?."""
        kind, text = self.tokens[begin]
        last = self.at - 1
        if kind in ("id", "q") and self.tokens[begin + 1] == ("op", "(") or kind == "id" and text in ("case", "exists", "coalesce", "nullif", "array"):
            return text
        if kind in ("id", "q") and all(self.tokens[i][0] in ("id", "q") or self.tokens[i] == ("op", ".") for i in range(begin, last + 1)) and last - begin in (0, 2):
            return self.tokens[last][1]
        return "?column?"

    def column_names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def values(self, outer: Scope | None) -> Output:
        self.need("values")
        rows: list[list[Expr]] = []
        while True:
            self.need("(")
            row = [self.expr(outer or Scope())]
            while self.take(","):
                row.append(self.expr(outer or Scope()))
            self.need(")")
            rows.append(row)
            if not self.take(","):
                break
        kinds = []
        for column in zip(*rows, strict=True):
            kind = column[0].type
            for e in column[1:]:
                kind = common(kind, e.type)
            kinds.append(kind)
        written = ", ".join("(" + ", ".join(f"CAST({e.sql} AS {spark_type(k)})" if k != "void" else e.sql for e, k in zip(row, kinds, strict=True)) + ")" for row in rows)
        names = [f"column{i + 1}" for i in range(len(kinds))]
        return Output(f"SELECT * FROM VALUES {written} AS {self.fresh()}({', '.join(names)})", list(zip(names, kinds, strict=True)))

    # FROM

    def joined(self, scope: Scope) -> str:
        left = self.relation(scope)
        while self.peek() in JOINS and self.peek() not in ("on", "using"):
            natural = self.take("natural")
            kind = "CROSS" if self.take("cross") else "INNER"
            for word in ("left", "right", "full"):
                if self.take(word):
                    kind = word.upper()
                    self.take("outer")
            self.take("inner")
            self.need("join")
            before = [(c, k) for _, columns in scope.relations for c, k in columns]
            right = self.relation(scope)
            added = scope.relations[-1][1]
            if natural:
                shared = [c for c, _ in before if c in {n for n, _ in added}]
                scope.merged |= {c: common(dict(before)[c], dict(added)[c]) for c in shared}
                left = f"{left} NATURAL {kind if kind != 'INNER' else ''} JOIN {right}"
            elif kind == "CROSS":
                left = f"{left} CROSS JOIN {right}"
            elif self.take("using"):
                names = self.column_names()
                scope.merged |= {c: common(dict(before).get(c, "string"), dict(added).get(c, "string")) for c in names}
                left = f"{left} {kind} JOIN {right} USING ({', '.join(map(ident, names))})"
            else:
                self.need("on")
                left = f"{left} {kind} JOIN {right} ON {self.expr(scope).sql}"
        return left

    def relation(self, scope: Scope) -> str:
        if self.peek() == "lateral":
            raise UnsupportedFeature("LATERAL: use Spark SQL's own")
        self.take("only")
        if self.take("("):
            if self.peek() in ("select", "with", "values", "("):
                made = self.query(scope.outer)
                self.need(")")
                alias, columns = self.alias(self.fresh(), made.columns)
                scope.relations.append((alias, columns))
                return f"({made.sql}) AS {ident(alias)}({', '.join(ident(c) for c, _ in columns)})"
            inner = Scope(outer=scope.outer)
            sql = self.joined(inner)
            self.need(")")
            scope.relations += inner.relations
            scope.merged |= inner.merged
            return f"({sql})"
        name = self.name()
        if self.take("."):
            name = self.name()
        if self.peek() == "(":
            raise UnsupportedFeature(f"set-returning function {name}")
        columns = self.ctes.get(name) or self.tables.get(name)
        if columns is None:
            raise UnsupportedFeature(f"relation {name} does not exist")
        view = name if name in self.ctes else self.views.get(name, name)
        alias, renamed = self.alias(name, columns)
        if self.peek() == "tablesample":
            raise UnsupportedFeature("TABLESAMPLE")
        scope.relations.append((alias, renamed))
        if renamed != columns:
            return f"{ident(view)} AS {ident(alias)}({', '.join(ident(c) for c, _ in renamed)})"
        return f"{ident(view)} AS {ident(alias)}"

    def alias(self, name: str, columns) -> tuple[str, list[tuple[str, str]]]:
        if self.take("as") or self.kind() == "q" or self.kind() == "id" and self.peek() not in (*STOPS, *JOINS, "tablesample"):
            name = self.name()
            if self.peek() == "(":
                names = self.column_names()
                columns = [(names[i] if i < len(names) else c, k) for i, (c, k) in enumerate(columns)]
        return name, columns

    # clauses

    def order(self, scope: Scope, out: Output | None = None) -> str:
        parts = []
        while True:
            begin = self.at
            known = dict(out.columns) if out else {}
            if out and self.kind() == "num" and self.peek(1) in (",", ")", ";", "asc", "desc", "limit", "offset", "nulls", ""):
                sql = ident(out.columns[int(self.tokens[self.at][1]) - 1][0])
                self.at += 1
            elif out and self.kind() in ("id", "q") and self.tokens[self.at][1] in known and self.peek(1) in (",", ")", ";", "asc", "desc", "limit", "offset", "nulls", ""):
                sql = ident(self.name())
            else:
                self.at = begin
                sql = self.expr(scope).sql
            down = self.take("desc")
            self.take("asc")
            if self.take("nulls"):
                first = self.take("first")
                first or self.need("last")
            else:
                first = down
            parts.append(f"{sql} {'DESC' if down else 'ASC'} NULLS {'FIRST' if first else 'LAST'}")
            if not self.take(","):
                return ", ".join(parts)

    def groups(self, scope: Scope, items) -> str:
        parts = []
        while True:
            parts.append(self.group(scope, items))
            if not self.take(","):
                return ", ".join(parts)

    def group(self, scope: Scope, items) -> str:
        for word in ("rollup", "cube"):
            if self.take(word):
                return f"{word.upper()} {self.group_list(scope, items)}"
        if self.take("grouping", "sets"):
            return f"GROUPING SETS {self.group_list(scope, items)}"
        if self.kind() == "num" and self.peek(1) in (",", ")", "", ";", *STOPS):
            self.at += 1
            return items[int(self.tokens[self.at - 1][1]) - 1][1].sql
        if self.kind() in ("id", "q") and self.peek(1) in (",", ")", "", ";", *STOPS) and scope.find(self.tokens[self.at][1]) is None:
            name = self.name()
            for n, e in items:
                if n == name:
                    return e.sql
            raise UnsupportedFeature(f"column {name} does not exist")
        if self.peek() == "(":
            return self.group_list(scope, items)
        return self.expr(scope).sql

    def group_list(self, scope: Scope, items) -> str:
        self.need("(")
        parts = []
        while not self.take(")"):
            parts.append(self.group(scope, items))
            self.take(",")
        return f"({', '.join(parts)})"

    def window(self, scope: Scope) -> str:
        parts = []
        if self.kind() in ("id", "q") and self.peek() not in ("partition", "order", "rows", "range", "groups"):
            parts.append(ident(self.name()))
        if self.take("partition", "by"):
            keys = [self.expr(scope).sql]
            while self.take(","):
                keys.append(self.expr(scope).sql)
            parts.append(f"PARTITION BY {', '.join(keys)}")
        if self.take("order", "by"):
            parts.append(f"ORDER BY {self.order(scope)}")
        if self.peek() in ("rows", "range", "groups"):
            mode = self.name()
            if mode == "groups":
                if not parts or not parts[-1].startswith("ORDER BY"):
                    raise UnsupportedFeature("a GROUPS frame needs an ORDER BY of its own")
                rank = ident(self.fresh())
                self.ranks.append(f"dense_rank() OVER ({' '.join(parts)}) AS {rank}")
                parts[-1], mode = f"ORDER BY {rank}", "range"
            bounds = [self.bound(scope)] if not self.take("between") else [self.bound(scope), (self.need("and"), self.bound(scope))[1]]
            if self.peek() == "exclude":
                raise UnsupportedFeature("EXCLUDE in a frame")
            parts.append(f"{mode.upper()} BETWEEN {bounds[0]} AND {bounds[1]}" if len(bounds) == 2 else f"{mode.upper()} BETWEEN {bounds[0]} AND CURRENT ROW")
        return " ".join(parts)

    def bound(self, scope: Scope) -> str:
        if self.take("current", "row"):
            return "CURRENT ROW"
        what = "UNBOUNDED" if self.take("unbounded") else self.expr(scope).sql
        return f"{what} {self.name().upper()}"

    # expressions

    def expr(self, scope: Scope) -> Expr:
        left = self.conjunction(scope)
        while self.take("or"):
            left = Expr(f"({left.sql} OR {self.conjunction(scope).sql})", "boolean")
        return left

    def conjunction(self, scope: Scope) -> Expr:
        left = self.negation(scope)
        while self.take("and"):
            left = Expr(f"({left.sql} AND {self.negation(scope).sql})", "boolean")
        return left

    def negation(self, scope: Scope) -> Expr:
        if self.take("not"):
            return Expr(f"(NOT {self.negation(scope).sql})", "boolean")
        left = self.comparison(scope)
        while self.peek() in ("is", "isnull", "notnull"):
            if self.take("isnull"):
                left = Expr(f"({left.sql} IS NULL)", "boolean")
            elif self.take("notnull"):
                left = Expr(f"({left.sql} IS NOT NULL)", "boolean")
            else:
                self.need("is")
                no = "NOT " if self.take("not") else ""
                if self.take("distinct", "from"):
                    right = self.comparison(scope)
                    a, b = self.alike(left, right)
                    left = Expr(f"({a} IS {no}DISTINCT FROM {b})", "boolean")
                else:
                    word = self.name()
                    if word not in ("null", "true", "false", "unknown"):
                        raise UnsupportedFeature(f"IS {word}")
                    left = Expr(f"({left.sql} IS {no}{word.upper()})", "boolean")
        return left

    def alike(self, a: Expr, b: Expr) -> tuple[str, str]:
        """Both sides of a comparison: without trailing blanks if one is char(n), of one numeric type if they differ."""
        if "bpchar" in (a.type, b.type):
            return f"rtrim({a.sql})", f"rtrim({b.sql})"
        if {a.type, b.type} & set(FLOATS) and a.type != b.type:
            return f"CAST({a.sql} AS DOUBLE)", f"CAST({b.sql} AS DOUBLE)"
        return a.sql, b.sql

    def comparison(self, scope: Scope) -> Expr:
        if self.peek() == "(" and (row := self.row(scope)):
            return row
        left = self.other(scope)
        while True:
            no = self.peek() == "not" and self.peek(1) in ("in", "like", "ilike", "between")
            if no:
                self.at += 1
            word = self.peek()
            if word in ("=", "<>", "!=", "<", "<=", ">", ">="):
                self.at += 1
                op = "<>" if word == "!=" else word
                if self.peek() in ("any", "some", "all") and self.peek(1) == "(":
                    left = self.quantified(left, op, scope)
                else:
                    a, b = self.alike(left, self.other(scope))
                    left = Expr(f"({a} {op} {b})", "boolean")
            elif self.take("in"):
                self.need("(")
                if self.peek() in ("select", "with", "values"):
                    made = self.query(scope)
                    left = Expr(f"({left.sql} {'NOT ' * no}IN ({made.sql}))", "boolean")
                else:
                    found = [self.expr(scope)]
                    while self.take(","):
                        found.append(self.expr(scope))
                    sides = [self.alike(left, x) for x in found]
                    left = Expr(f"({sides[0][0]} {'NOT ' * no}IN ({', '.join(b for _, b in sides)}))", "boolean") if len({a for a, _ in sides}) == 1 else Expr(("NOT " * no) + "(" + " OR ".join(f"{a} = {b}" for a, b in sides) + ")", "boolean")
                self.need(")")
            elif word in ("like", "ilike"):
                self.at += 1
                left = Expr(f"({left.sql} {'NOT ' * no}{word.upper()} {self.other(scope).sql})", "boolean")
            elif self.take("between"):
                symmetric = self.take("symmetric")
                low = self.other(scope)
                self.need("and")
                high = self.other(scope)
                (a, x), (b, y) = self.alike(left, low), self.alike(left, high)
                made = f"({a} >= {x} AND {b} <= {y})"
                if symmetric:
                    made = f"({made} OR ({a} <= {x} AND {b} >= {y}))"
                left = Expr(f"(NOT {made})" if no else made, "boolean")
            else:
                return left

    def row(self, scope: Scope) -> Expr | None:
        """(a, b) op (c, d), if that is what stands here."""
        begin, depth, comma = self.at, 0, False
        at = self.at
        while self.tokens[at][0] != "end":
            text = self.tokens[at][1] if self.tokens[at][0] == "op" else ""
            depth += (text == "(") - (text == ")")
            comma = comma or depth == 1 and text == ","
            at += 1
            if depth == 0:
                break
        if not comma or self.tokens[begin + 1] in (("id", "select"), ("id", "with")) or self.tokens[at] not in [("op", o) for o in ("=", "<>", "!=", "<", "<=", ">", ">=")] or self.tokens[at + 1] != ("op", "("):
            return None
        sides, op = [], ""
        for _ in range(2):
            self.need("(")
            side = [self.expr(scope)]
            while self.take(","):
                side.append(self.expr(scope))
            self.need(")")
            sides.append(side)
            op = op or self.tokens[self.at][1]
            self.at += len(sides) == 1
        pairs = [self.alike(a, b) for a, b in zip(*sides, strict=True)]
        if op in ("=", "<>", "!="):
            same = " AND ".join(f"{a} = {b}" for a, b in pairs)
            return Expr(f"({same})" if op == "=" else f"(NOT ({same}))", "boolean")
        made = f"{pairs[-1][0]} {op} {pairs[-1][1]}"
        for a, b in reversed(pairs[:-1]):
            made = f"({a} {op[0]} {b} OR ({a} = {b} AND {made}))"
        return Expr(f"({made})", "boolean")

    def quantified(self, left: Expr, op: str, scope: Scope) -> Expr:
        every = self.name() == "all"
        self.need("(")
        if self.peek() in ("select", "with"):
            if op == "=" and not every or op == "<>" and every:
                made = self.query(scope)
                self.need(")")
                return Expr(f"({left.sql} {'NOT ' if every else ''}IN ({made.sql}))", "boolean")
            raise UnsupportedFeature(f"{op} {'ALL' if every else 'ANY'} of a subquery")
        self.need("array")
        self.need("[")
        found = []
        while not self.take("]"):
            found.append(self.alike(left, self.expr(scope)))
            self.take(",")
        self.need(")")
        return Expr("(" + (" AND " if every else " OR ").join([f"{a} {op} {b}" for a, b in found] or ["TRUE" if every else "FALSE"]) + ")", "boolean")

    def other(self, scope: Scope) -> Expr:
        left = self.sum(scope)
        while (op := self.peek()) in ("||", "~", "!~", "~*", "!~*", "~~", "!~~", "~~*", "!~~*", "<<", ">>"):
            self.at += 1
            right = self.sum(scope)
            if op == "||":
                left = Expr(f"({text_of(left)} || {text_of(right)})", "string")
            elif op in ("<<", ">>"):
                left = Expr(f"CAST(shift{'left' if op == '<<' else 'right'}(CAST({left.sql} AS BIGINT), {right.sql}) AS {left.type})", left.type)
            elif "~~" in op:
                left = Expr(f"({left.sql} {'NOT ' * op.startswith('!')}{'I' * op.endswith('*')}LIKE {right.sql})", "boolean")
            else:
                pattern = f"concat('(?i)', {right.sql})" if op.endswith("*") else right.sql
                left = Expr(f"({'NOT ' * op.startswith('!')}regexp_like({left.sql}, {pattern}))", "boolean")
        return left

    def sum(self, scope: Scope) -> Expr:
        left = self.product(scope)
        while self.peek() in ("+", "-"):
            op = self.name_op()
            left = self.arithmetic(left, op, self.product(scope))
        return left

    def product(self, scope: Scope) -> Expr:
        left = self.unary(scope)
        while self.peek() in ("*", "/", "%"):
            op = self.name_op()
            left = self.arithmetic(left, op, self.unary(scope))
        return left

    def name_op(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def arithmetic(self, a: Expr, op: str, b: Expr) -> Expr:
        if a.type in INTS and b.type in INTS:
            kind = max(a.type, b.type, key=INTS.index)
            if op == "/":
                return Expr(f"CAST({a.sql} DIV {b.sql} AS {kind})", kind)
            return Expr(f"({a.sql} {op} {b.sql})", kind)
        if a.type == "date" and b.type == "date" and op == "-":
            return Expr(f"datediff({a.sql}, {b.sql})", "int")
        if a.type == "date" and b.type in INTS:
            return Expr(f"date_add({a.sql}, {'-' * (op == '-')}{b.sql})", "date")
        if "interval" in (a.type, b.type) or a.type in ("date", "timestamp_ntz", "timestamp"):
            return Expr(f"({a.sql} {op} {b.sql})", "timestamp_ntz" if a.type in ("date", "timestamp_ntz") and b.type == "interval" else a.type)
        if a.type in FLOATS or b.type in FLOATS:
            kind = "float" if a.type == b.type == "float" else "double"
            return Expr(f"(CAST({a.sql} AS {kind}) {op} CAST({b.sql} AS {kind}))", kind)
        s, r = scale_of(a.type), scale_of(b.type)
        if s is None or r is None:
            raise UnsupportedFeature(f"{a.type} {op} {b.type}")
        scale = {"*": s + r, "/": 16}.get(op, max(s, r))
        if op == "/":
            return Expr(f"CAST(CAST({a.sql} AS DECIMAL({18 + max(s, 5)},{max(s, 5)})) / CAST({b.sql} AS DECIMAL({12 + r},{r})) AS {OPEN})", OPEN)
        return Expr(f"CAST(({a.sql} {op} {b.sql}) AS DECIMAL(38,{min(scale, 38)}))", f"decimal(38,{min(scale, 38)})")

    def unary(self, scope: Scope) -> Expr:
        if self.take("-"):
            x = self.unary(scope)
            return Expr(f"(-{x.sql})", x.type)
        if self.take("+"):
            return self.unary(scope)
        left = self.primary(scope)
        while self.peek() in ("::", "["):
            if self.take("::"):
                left = cast(left, *self.type_name())
            else:
                self.need("[")
                i = self.expr(scope)
                self.need("]")
                left = Expr(f"CASE WHEN {i.sql} >= 1 THEN get({left.sql}, CAST({i.sql} AS INT) - 1) END", left.type.removeprefix("array<").removesuffix(">"))
        return left

    def type_name(self) -> tuple[str, list[int]]:
        name = self.name()
        if name == "double":
            self.need("precision")
            name = "double precision"
        if name == "character" and self.take("varying"):
            name = "character varying"
        if name in ("timestamp", "time") and self.take("without"):
            self.need("time", "zone")
        if name == "timestamp" and self.take("with"):
            self.need("time", "zone")
            name = "timestamptz"
        if name not in TYPES:
            raise UnsupportedFeature(f"type {name}")
        sizes = []
        if self.peek() == "(" and name in ("numeric", "decimal", "varchar", "char", "bpchar", "character", "character varying"):
            self.need("(")
            while not self.take(")"):
                sizes.append(int(self.tokens[self.at][1]))
                self.at += 1
                self.take(",")
        elif name in ("char", "character"):
            sizes = [1]
        return name, sizes

    def primary(self, scope: Scope) -> Expr:
        kind, text = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            if "e" in text.lower():
                return Expr(f"CAST({literal(text)} AS DECIMAL(38,16))", OPEN)
            if "." in text:
                after = len(text.partition(".")[2])
                return Expr(f"CAST('{text.rstrip('.')}' AS DECIMAL({max(len(text) - 1, after + 1, 1)},{after}))", f"decimal({max(len(text) - 1, after + 1, 1)},{after})")
            n = int(text)
            return Expr(text, "int") if n < 2**31 else Expr(f"{text}L", "bigint") if n < 2**63 else Expr(f"CAST('{text}' AS DECIMAL(38,0))", "decimal(38,0)")
        if kind == "str":
            self.at += 1
            return Expr(literal(string_of(text)), "string")
        if kind == "op" and text == "$" and self.kind(1) == "num":
            n = int(self.tokens[self.at + 1][1])
            self.at += 2
            if not 1 <= n <= len(self.parameters):
                raise UnsupportedFeature(f"there is no parameter ${n}")
            return parameter(self.parameters[n - 1])
        if kind == "op" and text == "(":
            self.at += 1
            if self.peek() in ("select", "with", "values"):
                made = self.query(scope)
                self.need(")")
                return Expr(f"({made.sql})", made.columns[0][1])
            e = self.expr(scope)
            self.need(")")
            return Expr(f"({e.sql})", e.type)
        if kind == "id":
            special = getattr(self, f"on_{text}", None)
            if special and (text in ("case", "null", "true", "false", "array", "exists", "cast") or self.peek(1) == "("):
                return special(scope)
            if text in TYPES and self.kind(1) == "str" or text == "double" and self.peek(1) == "precision":
                name, sizes = self.type_name()
                self.at += 1
                return cast(Expr(literal(string_of(self.tokens[self.at - 1][1])), "string"), name, sizes)
            if self.peek(1) == "(":
                return self.call(scope)
        if kind in ("id", "q"):
            name, relation = self.name(), None
            if self.take("."):
                relation, name = name, self.name()
            found = scope.find(name, relation)
            if found is None:
                raise UnsupportedFeature(f"column {name} does not exist")
            return found
        raise UnsupportedFeature(f"cannot read {text!r}")

    def on_null(self, scope):
        self.at += 1
        return Expr("NULL", "void")

    def on_true(self, scope):
        self.at += 1
        return Expr("TRUE", "boolean")

    def on_false(self, scope):
        self.at += 1
        return Expr("FALSE", "boolean")

    def on_exists(self, scope):
        self.at += 1
        self.need("(")
        made = self.query(scope)
        self.need(")")
        return Expr(f"EXISTS ({made.sql})", "boolean")

    def on_array(self, scope):
        self.at += 1
        self.need("[")
        found = []
        while not self.take("]"):
            found.append(self.expr(scope))
            self.take(",")
        kind = found[0].type if found else "string"
        for e in found[1:]:
            kind = common(kind, e.type)
        return Expr(f"array({', '.join(f'CAST({e.sql} AS {spark_type(kind)})' for e in found)})", f"array<{kind}>")

    def on_cast(self, scope):
        self.at += 1
        self.need("(")
        e = self.expr(scope)
        self.need("as")
        made = cast(e, *self.type_name())
        self.need(")")
        return made

    def on_case(self, scope):
        self.at += 1
        subject = None if self.peek() == "when" else self.expr(scope)
        sql, kind = "CASE", "void"
        while self.take("when"):
            if subject is None:
                test = self.expr(scope).sql
            else:
                a, b = self.alike(subject, self.expr(scope))
                test = f"{a} = {b}"
            self.need("then")
            e = self.expr(scope)
            sql, kind = f"{sql} WHEN {test} THEN {e.sql}", common(kind, e.type)
        if self.take("else"):
            e = self.expr(scope)
            sql, kind = f"{sql} ELSE {e.sql}", common(kind, e.type)
        self.need("end")
        return Expr(f"{sql} END", kind)

    def arguments(self, scope: Scope) -> list[Expr]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expr(scope))
            self.take(",")
        return out

    def on_coalesce(self, scope):
        self.at += 1
        found = self.arguments(scope)
        kind = "void"
        for e in found:
            kind = common(kind, e.type)
        return Expr(f"coalesce({', '.join(e.sql for e in found)})", kind)

    def on_nullif(self, scope):
        self.at += 1
        a, b = self.arguments(scope)
        return Expr(f"nullif({a.sql}, {b.sql})", a.type)

    def on_grouping(self, scope):
        self.at += 1
        found = self.arguments(scope)
        return Expr("CAST(" + " + ".join(f"grouping({e.sql}) * {1 << i}" for i, e in enumerate(reversed(found))) + " AS INT)", "int")

    def on_extract(self, scope):
        self.at += 1
        self.need("(")
        part = self.name()
        self.need("from")
        e = self.expr(scope)
        self.need(")")
        return Expr(f"CAST(extract({part} FROM {e.sql}) AS DECIMAL(38,16))", OPEN)

    def on_substring(self, scope):
        self.at += 1
        self.need("(")
        found = [self.expr(scope)]
        while self.take("from") or self.take("for") or self.take(","):
            found.append(self.expr(scope))
        self.need(")")
        return Expr(f"substring({', '.join(e.sql for e in found)})", "string")

    def call(self, scope: Scope) -> Expr:
        name = self.name()
        if name == "format":
            if self.kind(1) != "str" or self.peek(2) not in (",", ")"):
                raise UnsupportedFeature("format() with a pattern that is no literal: use functions.text.format_dynamic")
            pattern = string_of(self.tokens[self.at + 1][1])
            return formatted(pattern, self.arguments(scope)[1:])
        self.need("(")
        distinct, found = self.take("distinct"), []
        star = self.take("*")
        while self.peek() != ")" and self.kind() != "end":
            if self.peek() == "order":
                raise UnsupportedFeature("ORDER BY in an aggregate")
            found.append(self.expr(scope))
            self.take(",")
        self.need(")")
        if self.peek() == "within":
            raise UnsupportedFeature("ordered-set aggregates")
        where = None
        if self.take("filter"):
            self.need("(")
            self.need("where")
            where = self.expr(scope).sql
            self.need(")")
        over = None
        if self.take("over"):
            if self.take("("):
                over = self.window(scope)
                self.need(")")
            else:
                over = self.name()
        if distinct and over is not None:
            raise UnsupportedFeature("DISTINCT in a window")
        if name in AGGREGATES:
            return aggregate(name, found, star, distinct, where, over)
        if name in RANKS and over is not None:
            if "ORDER BY" not in over and " " in f"{over} ":
                over = f"{over} ORDER BY 1" if name not in ("first_value", "last_value", "nth_value") and not re.fullmatch(r"\w+", over) else over
            kind = found[0].type if name in ("lag", "lead", "first_value", "last_value", "nth_value") else "double" if name in ("percent_rank", "cume_dist") else "int" if name == "ntile" else "bigint"
            window = over if re.fullmatch(r"\w+", over) else f"({over})"
            made = f"{name}({', '.join(e.sql for e in found)}) OVER {window}"
            return Expr(f"CAST({made} AS BIGINT)" if kind == "bigint" and name in ("row_number", "rank", "dense_rank") else made, kind)
        if where is not None or over is not None or distinct:
            raise UnsupportedFeature(f"{name} with FILTER, OVER or DISTINCT")
        return scalar(name, found)


def parameter(value: Any) -> Expr:
    """A parameter's value as a constant of the type that it has."""
    if value is None:
        return Expr("NULL", "void")
    if isinstance(value, bool):
        return Expr("TRUE" if value else "FALSE", "boolean")
    if isinstance(value, int):
        kind = "int" if -(2**31) <= value < 2**31 else "bigint" if -(2**63) <= value < 2**63 else "decimal(38,0)"
        return Expr(f"CAST('{value}' AS {kind})", kind)
    if isinstance(value, float):
        return Expr(f"CAST('{value!r}' AS DOUBLE)", "double")
    if isinstance(value, Decimal) and value.is_finite():
        after = max(0, -value.as_tuple().exponent)
        kind = f"decimal({max(len(value.as_tuple().digits), after + 1)},{after})"
        return Expr(f"CAST('{value:f}' AS {kind})", kind)
    if isinstance(value, datetime.datetime):
        kind = "timestamp" if value.tzinfo else "timestamp_ntz"
        return Expr(f"CAST('{value.isoformat(' ')}' AS {kind})", kind)
    if isinstance(value, datetime.date):
        return Expr(f"CAST('{value.isoformat()}' AS DATE)", "date")
    if isinstance(value, datetime.time):
        return Expr(f"CAST('{value.isoformat()}' AS TIME)", "time")
    if isinstance(value, bytes):
        return Expr(f"X'{value.hex()}'", "binary")
    if isinstance(value, str):
        return Expr(literal(value), "string")
    raise UnsupportedFeature(f"a parameter of {type(value).__name__}")


def string_of(token: str) -> str:
    if token[0] in "eE":
        return token[2:-1].replace("''", "'").encode("utf-8").decode("unicode_escape").encode("latin-1").decode("utf-8")
    return token[1:-1].replace("''", "'")


def scale_of(kind: str) -> int | None:
    if kind in INTS:
        return 0
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
    return int(m[2]) if m else None


def spark_type(kind: str) -> str:
    return "string" if kind in ("bpchar", "void") else kind


def common(a: str, b: str) -> str:
    """The type that two meet in."""
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    if a in INTS and b in INTS:
        return max(a, b, key=INTS.index)
    if a in FLOATS or b in FLOATS:
        return "double"
    s, r = scale_of(a), scale_of(b)
    if s is not None and r is not None:
        return f"decimal(38,{max(s, r)})"
    return "string" if "string" in (a, b) or "bpchar" in (a, b) else a


def text_of(e: Expr, terse: bool = False) -> str:
    """An expression's text: booleans as true and false, or t and f where output functions make it."""
    if e.type == "boolean":
        return f"CASE WHEN {e.sql} THEN '{'t' if terse else 'true'}' WHEN NOT {e.sql} THEN '{'f' if terse else 'false'}' END"
    return f"rtrim({e.sql})" if e.type == "bpchar" else f"CAST({e.sql} AS STRING)"


def cast(e: Expr, name: str, sizes: list[int]) -> Expr:
    to = TYPES[name]
    if to == "numeric":
        kind = f"decimal({sizes[0]},{sizes[1] if len(sizes) > 1 else 0})" if sizes else OPEN
        return Expr(f"CAST({e.sql} AS {kind})", kind)
    if to == "boolean" and e.type in INTS:
        return Expr(f"({e.sql} <> 0)", "boolean")
    if to in INTS and e.type in FLOATS:
        return Expr(f"CAST(rint({e.sql}) AS {to})", to)
    if to in INTS and scale_of(e.type):
        return Expr(f"CAST(round({e.sql}, 0) AS {to})", to)
    if to == "string":
        sql = text_of(e)
        return Expr(f"substring({sql}, 1, {sizes[0]})" if sizes else sql, "string")
    if to == "bpchar":
        return Expr(f"rpad(substring({text_of(e)}, 1, {sizes[0]}), {sizes[0]}, ' ')" if sizes else text_of(e), "bpchar")
    if to == "interval":
        return Expr(f"INTERVAL {e.sql}", "interval")
    return Expr(f"CAST({e.sql} AS {to})", to)


def aggregate(name: str, found: list[Expr], star: bool, distinct: bool, where: str | None, over: str | None) -> Expr:
    """An aggregate with PostgreSQL's result type; FILTER becomes a CASE, since windows take none."""
    args = list(found) or [Expr("1", "int")]
    kind = args[0].type
    bare = lambda x: f"CASE WHEN {where} THEN {x} END" if where else x
    window = "" if over is None else f" OVER {over if re.fullmatch(r'[\w]+', over) else f'({over})'}"
    call = lambda f, *xs: f"{f}({'DISTINCT ' * distinct}{', '.join(bare(x) if i == 0 else x for i, x in enumerate(xs))}){window}"
    if name == "count":
        return Expr(call("count", "1" if star else args[0].sql), "bigint")
    if name == "sum":
        if kind == "bigint":
            return Expr(call("sum", f"CAST({args[0].sql} AS DECIMAL(28,0))"), "decimal(38,0)")
        if kind in INTS:
            return Expr(call("sum", args[0].sql), "bigint")
        if kind == "float":
            return Expr(f"CAST({call('sum', f'CAST({args[0].sql} AS DOUBLE)')} AS FLOAT)", "float")
        s = scale_of(kind)
        return Expr(call("sum", args[0].sql), kind) if s is None else Expr(f"CAST({call('sum', args[0].sql)} AS DECIMAL(38,{s}))", f"decimal(38,{s})")
    if name == "avg":
        s = scale_of(kind)
        if s is None:
            return Expr(call("avg", f"CAST({args[0].sql} AS DOUBLE)") if kind in FLOATS else call("avg", args[0].sql), "double" if kind in FLOATS else kind)
        total = f"CAST({call('sum', f'CAST({args[0].sql} AS DECIMAL({19 + s},{s}))')} AS DECIMAL({20 + s},{s}))"
        n = f"CAST(nullif({call('count', args[0].sql)}, 0) AS DECIMAL(15,0))"
        return Expr(f"CAST({total} / {n} AS {OPEN})", OPEN)
    if name in ("min", "max"):
        return Expr(call(name, args[0].sql), kind)
    if name == "string_agg":
        return Expr(call("string_agg", text_of(args[0]), args[1].sql), "string")
    name = {"stddev": "stddev_samp", "variance": "var_samp"}.get(name, name)
    made = call(name, *(f"CAST({e.sql} AS DOUBLE)" for e in args))
    return Expr(made, "bigint" if name == "regr_count" else "double")


def scalar(name: str, found: list[Expr]) -> Expr:
    sql = ", ".join(e.sql for e in found)
    kind = found[0].type if found else "void"
    if name in TYPES:
        return cast(found[0], name, [])
    if name == "octet_length" or name == "length" and kind == "binary":
        return Expr(f"octet_length({sql})", "int")
    if name in ("strpos", "position"):
        return Expr(f"instr({sql})", "int")
    if name in ("btrim", "ltrim", "rtrim") and len(found) == 2:
        side = {"btrim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[name]
        return Expr(f"trim({side} {found[1].sql} FROM {found[0].sql})", "string")
    if name in ("left", "right") and not re.fullmatch(r"\d+", found[1].sql):
        raise UnsupportedFeature(f"{name} by a length that is no plain number")
    if name in ("length", "char_length", "character_length"):
        return Expr(f"char_length({'rtrim(' + sql + ')' if kind == 'bpchar' else sql})", "int")
    if name == "concat":
        return Expr(f"concat_ws('', {', '.join(text_of(e, True) for e in found)})", "string")
    if name == "concat_ws":
        return Expr(f"concat_ws({found[0].sql}, {', '.join(text_of(e, True) for e in found[1:])})", "string")
    if name == "quote_literal":
        return Expr(quoted(text_of(found[0])), "string")
    if name in ("ceil", "ceiling", "floor"):
        return Expr(f"CAST({'floor' if name == 'floor' else 'ceil'}({sql}) AS {'double' if kind in FLOATS or kind in INTS else 'decimal(38,0)'})", "double" if kind in FLOATS or kind in INTS else "decimal(38,0)")
    if name == "round" and (kind in FLOATS or len(found) == 1 and kind in INTS):
        return Expr(f"rint({sql})", "double")
    if name == "round":
        n = found[1].sql if len(found) > 1 else "0"
        places = min(max(int(n.strip("()").replace(" ", "")), 0), 16) if re.fullmatch(r"\(?-?\d+\)?", n) else 16
        return Expr(f"CAST(round({found[0].sql}, {n}) AS DECIMAL(38,{places}))", f"decimal(38,{places})")
    if name == "trunc" and kind in FLOATS:
        return Expr(f"(CASE WHEN {sql} < 0 THEN -floor(-{sql}) ELSE floor({sql}) END * 1.0D)", "double")
    if name == "trunc":
        n = int(found[1].sql.strip("()").replace(" ", "")) if len(found) > 1 else 0
        unit = f"CAST('{10**-n if n <= 0 else '0.' + '0' * (n - 1) + '1'}' AS DECIMAL({30 if n <= 0 else n + 2},{max(n, 0)}))"
        x = found[0].sql
        cut = f"CASE WHEN round(abs({x}), {n}) > abs({x}) THEN round(abs({x}), {n}) - {unit} ELSE round(abs({x}), {n}) END"
        places = min(max(n, 0), 16)
        return Expr(f"CAST(CASE WHEN {x} < 0 THEN -({cut}) ELSE {cut} END AS DECIMAL(38,{places}))", f"decimal(38,{places})")
    if name in ALIKE:
        return Expr(f"{name}({sql})", kind if ALIKE[name] == "=" else ALIKE[name])
    raise UnsupportedFeature(f"function {name}")


def quoted(x: str) -> str:
    return f"concat(CASE WHEN contains({x}, '\\\\') THEN 'E' ELSE '' END, '\\'', replace(replace({x}, '\\\\', '\\\\\\\\'), '\\'', '\\'\\''), '\\'')"


def formatted(pattern: str, args: list[Expr]) -> Expr:
    """format() with a literal pattern, as one concatenation."""
    try:
        pieces = text_functions.resolved(text_functions.parse_format(pattern), len(args))
    except ValueError as e:
        raise UnsupportedFeature(str(e)) from e
    parts = ["''"]
    for piece, at, width_at in pieces:
        if isinstance(piece, str):
            parts.append(literal(piece))
            continue
        x = text_of(args[at], True)
        if piece.kind == "s":
            value = f"coalesce({x}, '')"
        elif piece.kind == "L":
            value = f"coalesce({quoted(x)}, 'NULL')"
        else:
            value = f"""CASE WHEN {x} IS NULL THEN raise_error('null values cannot be formatted as an SQL identifier') WHEN {x} RLIKE '^[_a-z][_a-z0-9]*$' THEN {x} ELSE concat('"', replace({x}, '"', '""'), '"') END"""
        if piece.width is not None:
            width = str(piece.width) if width_at is None else f"coalesce(CAST({args[width_at].sql} AS INT), 0)"
            room = f"greatest(abs({width}), char_length({value}))"
            value = f"rpad({value}, {room}, ' ')" if piece.left else f"CASE WHEN {width} < 0 THEN rpad({value}, {room}, ' ') ELSE lpad({value}, {room}, ' ') END"
        parts.append(value)
    return Expr(f"concat({', '.join(parts)})", "string")


def _kind(data_type) -> str:
    return data_type.simpleString()


def translate(text: str, tables: Mapping[str, list[tuple[str, str]]]) -> Output:
    """Spark SQL for a SELECT, and its output columns with types; `tables` has the columns and types of each table."""
    return Translator(text, tables).statement()


def pg_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], blank_padded: Mapping[str, set[str]] | None = None, parameters: Sequence[Any] = ()) -> DataFrame:
    """Runs a SELECT in PostgreSQL's dialect over the given tables; `blank_padded` names char(n) columns by table, and
    `parameters` are the values of $1, $2 and so on.

    Output columns of one name are numbered. The temporary views behind the tables have names of their own, and exist
    only while the statement is analysed. EXPLAIN of a SELECT gives rows (line, QUERY PLAN).
    """
    try:
        asked = options_of(text)
    except ValueError as e:
        raise UnsupportedFeature(str(e)) from e
    if asked is not None:
        return explained(spark, pg_sql(spark, asked[1], tables, blank_padded, parameters), asked[0])
    padded = blank_padded or {}
    schemas = {name: [(f.name, "bpchar" if f.name in padded.get(name, ()) else _kind(f.dataType)) for f in frame.schema.fields] for name, frame in tables.items()}
    views = {name: f"__lk_{uuid.uuid4().hex}" for name in tables}
    translator = Translator(text, schemas, views, parameters)
    made = translator.statement()
    for name, frame in tables.items():
        frame.createTempView(views[name])
    try:
        out = unique_names(spark.sql(made.sql))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    return out if translator.ties is None else with_ties(out, translator.ties.keys, translator.ties.rows)
