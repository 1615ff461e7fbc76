"""A small model-query language, compiled to DataFrames.

Two forms: over tables, `#>{db.table}#->filter(x|$x.a > 1)->groupBy(~k, ~n: x|$x.a : y|$y->count())`,
and over classes, `pkg::Class.all()->project([x|$x.total.amount], ['amount'])`, whose property paths
a catalog resolves to columns; a path through an owned list joins its child table. The text is read
into calls and lambdas, which become Column expressions: nothing is run before Spark plans it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QueryError(ValueError):
    pass


_TOKEN = re.compile(
    r"\s+|//[^\n]*|(?P<table>\#>\{[\w:]+(?:\.\w+)+\}\#)|(?P<string>'(?:[^'\\]|\\.)*')|(?P<number>\d+(?:\.\d+)?)|(?P<date>%\d{4}-\d{2}-\d{2}(?:T[\d:.]+)?)|(?P<var>\$\w+)|(?P<name>[A-Za-z_]\w*(?:::\w+)*)|(?P<op>->|==|!=|<=|>=|&&|\|\||[-+*/<>!~:|.,()\[\]])"
)
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6}


@dataclass
class Node:
    kind: str
    value: object = None
    args: list = field(default_factory=list)


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unreadable at {at}: {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.i = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.i + ahead][1] if self.i + ahead < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[self.i + ahead][0] if self.i + ahead < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        if self.i >= len(self.tokens) or (want and self.peek() != want):
            raise QueryError(f"{want or 'more'} expected, {self.peek() or 'the end'!r} found")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def took(self, t: str) -> bool:
        if self.peek() == t:
            self.i += 1
            return True
        return False

    def whole(self) -> Node:
        n = self.expr(0)
        if self.i < len(self.tokens):
            raise QueryError(f"{self.peek()!r} is too much")
        return n

    def expr(self, power: int) -> Node:
        left = self.unary()
        while _BINARY.get(self.peek(), 0) > power:
            op = self.take()
            left = Node("binary", op, [left, self.expr(_BINARY[op])])
        return left

    def unary(self) -> Node:
        if self.peek() in ("!", "-"):
            return Node("unary", self.take(), [self.unary()])
        n = self.atom()
        while True:
            if self.took("->"):
                n = Node("call", self.take(), [n, *self.arguments()])
            elif self.peek() == "." and self.kind(1) == "name":
                self.take()
                name = self.take()
                n = Node("call", name, [n, *self.arguments()]) if self.peek() == "(" else Node("get", name, [n])
            else:
                return n

    def arguments(self) -> list[Node]:
        self.take("(")
        out = []
        while not self.took(")"):
            out.append(self.argument())
            if self.peek() != ")":
                self.take(",")
        return out

    def argument(self) -> Node:
        if self.kind() == "name" and self.peek(1) == "|":
            var = self.take()
            self.take("|")
            return Node("lambda", var, [self.expr(0)])
        if self.peek() == "|":
            self.take()
            return Node("lambda", None, [self.expr(0)])
        return self.expr(0)

    def atom(self) -> Node:
        kind, t = self.kind(), self.take()
        if kind == "table":
            return Node("table", t[3:-2].rpartition(".")[2])
        if kind == "string":
            return Node("literal", re.sub(r"\\(.)", r"\1", t[1:-1]))
        if kind == "number":
            return Node("literal", float(t) if "." in t else int(t))
        if kind == "date":
            return Node("date", t[1:])
        if kind == "var":
            return Node("var", t[1:])
        if t == "(":
            n = self.expr(0)
            self.take(")")
            return n
        if t == "[":
            items = []
            while not self.took("]"):
                items.append(self.argument())
                if self.peek() != "]":
                    self.take(",")
            return Node("list", None, items)
        if t == "~":
            if self.took("["):
                items = []
                while not self.took("]"):
                    items.append(self.colspec())
                    if self.peek() != "]":
                        self.take(",")
                return Node("cols", None, items)
            return Node("cols", None, [self.colspec()])
        if kind == "name":
            if t in ("true", "false"):
                return Node("literal", t == "true")
            return Node("call", t, self.arguments()) if self.peek() == "(" else Node("name", t)
        raise QueryError(f"{t!r} is out of place")

    def colspec(self) -> Node:
        name = self.take()
        parts = []
        while self.took(":"):
            parts.append(self.argument())
        return Node("colspec", name, parts)


def parse(text: str) -> Node:
    return _Parser(text).whole()


_AGGREGATES: dict[str, Callable[[Column], Column]] = {"count": lambda c: F.count(c), "sum": F.sum, "average": F.avg, "avg": F.avg, "max": F.max, "min": F.min, "distinctCount": F.count_distinct, "stdDev": F.stddev}
_UNITS = {"SECONDS": ("SECOND", "second"), "MINUTES": ("MINUTE", "minute"), "HOURS": ("HOUR", "hour"), "DAYS": ("DAY", "day"), "MILLISECONDS": ("MILLISECOND", None)}


class Path:
    """A property path not yet resolved."""

    def __init__(self, steps: tuple[str, ...], resolve: Callable[[tuple[str, ...]], Column]) -> None:
        self.steps, self.resolve = steps, resolve


def _column(v: object) -> Column:
    if isinstance(v, Path):
        return v.resolve(v.steps)
    return v if isinstance(v, Column) else F.lit(v)


def _eval(n: Node, env: dict[str, object]) -> object:
    k = n.kind
    if k == "literal":
        return n.value
    if k == "date":
        return F.lit(n.value).cast("timestamp_ntz")
    if k == "var":
        if n.value not in env:
            raise QueryError(f"${n.value} isn't bound")
        return env[n.value]
    if k == "get":
        if n.args[0].kind == "name":  # Enum.VALUE
            return n.value
        base = _eval(n.args[0], env)
        if not isinstance(base, Path):
            raise QueryError(f"{n.value} has no owner")
        return Path((*base.steps, n.value), base.resolve)
    if k == "unary":
        v = _column(_eval(n.args[0], env))
        return ~v if n.value == "!" else -v
    if k == "binary":
        a, b = (_column(_eval(x, env)) for x in n.args)
        return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "&&": lambda: a & b, "||": lambda: a | b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / F.nullif(b, F.lit(0))}[n.value]()
    if k == "list":
        return [_eval(x, env) for x in n.args]
    if k == "lambda":
        return _eval(n.args[0], env)
    if k == "call":
        return _call(n, env)
    if k == "name":
        return n.value
    raise QueryError(f"{k} is out of place")


def _unit(n: Node) -> tuple[str, str | None]:
    name = n.value if n.kind in ("get", "name") else None
    if name not in _UNITS:
        raise QueryError("a unit of time is needed")
    return _UNITS[name]


def _call(n: Node, env: dict[str, object]) -> object:
    f, args = n.value, n.args
    if f == "toOne":
        return _eval(args[0], env)
    if f == "dateDiff":
        a, b = (_column(_eval(x, env)) for x in args[:2])
        unit = _unit(args[2])[0]
        us = lambda c: F.unix_micros(c.cast("timestamp"))
        per = {"MILLISECOND": 1000, "SECOND": 10**6, "MINUTE": 6 * 10**7, "HOUR": 36 * 10**8, "DAY": 864 * 10**8}[unit]
        d = us(b) - us(a)
        return ((d - F.when(d < 0, -F.pmod(-d, F.lit(per))).otherwise(F.pmod(d, F.lit(per)))) / per).cast("bigint")
    if f == "timeBucket":
        c = _column(_eval(args[0], env))
        count, (_, word) = args[1].value, _unit(args[2])
        if word is None:
            raise QueryError("buckets of a second at least")
        return F.date_trunc(word, c).cast("timestamp_ntz") if count == 1 else F.window(c.cast("timestamp"), f"{count} {word}s")["start"].cast("timestamp_ntz")
    if f == "if":
        c, a, b = (_column(_eval(x, env)) for x in args)
        return F.when(c, a).otherwise(b)
    vals = [_eval(a, env) for a in args]
    c = _column(vals[0])
    one = {
        "isEmpty": lambda: c.isNull(), "isNotEmpty": lambda: c.isNotNull(), "in": lambda: c.isin(vals[1]), "contains": lambda: c.contains(vals[1]), "startsWith": lambda: c.startswith(vals[1]), "endsWith": lambda: c.endswith(vals[1]),
        "toLower": lambda: F.lower(c), "toUpper": lambda: F.upper(c), "trim": lambda: F.trim(c), "length": lambda: F.length(c), "abs": lambda: F.abs(c), "round": lambda: F.round(c, vals[1] if len(vals) > 1 else 0), "not": lambda: ~c, "toString": lambda: c.cast("string"), "coalesce": lambda: F.coalesce(*map(_column, vals)),
    }
    if f in one:
        return one[f]()
    if f in _AGGREGATES:
        return _AGGREGATES[f](c)
    raise QueryError(f"unknown function {f}")


def _strings(n: Node) -> list[str]:
    if n.kind != "list" or any(a.kind != "literal" for a in n.args):
        raise QueryError("a list of names is needed")
    return [a.value for a in n.args]


class Catalog:
    """Tables by name, and classes: (root table, property path: column, list: (child table, property path: column)). Lists join on entity id and version."""

    def __init__(self, tables: dict[str, Callable[[], DataFrame]], classes: dict[str, tuple] | None = None) -> None:
        self.tables, self.classes = tables, classes or {}


class _Class:
    """All instances of a class; the paths that are used decide what is joined."""

    def __init__(self, catalog: Catalog, name: str) -> None:
        if name not in catalog.classes:
            raise QueryError(f"unknown class {name}")
        root, self.paths, self.lists = catalog.classes[name]
        self.catalog = catalog
        self.frame = catalog.tables[root]()
        self.joined: set[str] = set()

    def resolve(self, steps: tuple[str, ...]) -> Column:
        if steps in self.paths:
            return F.col(f"`{self.paths[steps]}`")
        if steps and steps[0] in self.lists and steps[1:] in self.lists[steps[0]][1]:
            name = steps[0]
            child, paths = self.lists[name]
            if name not in self.joined:
                c = self.catalog.tables[child]()
                c = c.select(*[F.col(f"`{x}`").alias(f"{name}.{x}") for x in c.columns])
                self.frame = self.frame.join(c, (F.col("entity_id") == F.col(f"`{name}.entity_id`")) & (F.col("entity_version") == F.col(f"`{name}.entity_version`")), "left")
                self.joined.add(name)
            return F.col(f"`{name}.{paths[steps[1:]]}`")
        raise QueryError(f"no property {'.'.join(steps)}")


def run(text: str, catalog: Catalog) -> DataFrame:
    """The DataFrame of a query; what can't be read or found raises QueryError."""
    d = _relation(parse(text), catalog)
    return d.frame if isinstance(d, _Class) else d


def _relation(n: Node, catalog: Catalog):  # noqa: ANN202
    if n.kind == "table":
        if n.value not in catalog.tables:
            raise QueryError(f"unknown table {n.value}")
        return catalog.tables[n.value]()
    if n.kind != "call":
        raise QueryError("a relation is needed")
    f, args = n.value, n.args
    if f == "all":
        return _Class(catalog, args[0].value)
    d = _relation(args[0], catalog)

    def bind(lam: Node) -> Column:
        if lam.kind != "lambda":
            raise QueryError("a lambda is needed")
        if isinstance(d, _Class):
            return _column(_eval(lam, {lam.value: Path((), d.resolve)}))

        def own(steps: tuple[str, ...]) -> Column:
            if len(steps) != 1 or steps[0] not in d.columns:
                raise QueryError(f"no column {'.'.join(steps)}")
            return F.col(f"`{steps[0]}`")

        return _column(_eval(lam, {lam.value: Path((), own)}))

    if isinstance(d, _Class):
        if f == "filter":
            cond = bind(args[1])
            d.frame = d.frame.where(cond)
            return d
        if f == "project":
            lams, names = args[1].args, _strings(args[2])
            cols = [bind(x).alias(a) for x, a in zip(lams, names, strict=True)]
            return d.frame.select(*cols)
        if f == "groupBy":
            names = _strings(args[3])
            keys = [bind(x) for x in args[1].args]
            aggs = []
            for a in args[2].args:
                if a.kind != "call" or a.value != "agg":
                    raise QueryError("agg is needed")
                value = bind(a.args[0])
                aggs.append(_column(_eval(a.args[1], {a.args[1].value: value})))
            cols = [k.alias(names[i]) for i, k in enumerate(keys)]
            return d.frame.groupBy(*cols).agg(*[a.alias(names[len(keys) + i]) for i, a in enumerate(aggs)])
        raise QueryError(f"{f} needs project or groupBy first")
    if f == "filter":
        return d.where(bind(args[1]))
    if f in ("select", "project") and args[1].kind == "cols":
        return d.select(*[(bind(c.args[0]) if c.args else F.col(f"`{c.value}`")).alias(c.value) for c in args[1].args])
    if f == "extend":
        return d.withColumns({c.value: bind(c.args[0]) for c in args[1].args})
    if f == "rename":
        return d.withColumnRenamed(args[1].args[0].value, args[2].args[0].value)
    if f == "groupBy":
        aggs = [_column(_eval(c.args[1], {c.args[1].value: bind(c.args[0])})).alias(c.value) for c in args[2].args]
        return d.groupBy(*[c.value for c in args[1].args]).agg(*aggs)
    if f == "distinct":
        return d.distinct()
    if f == "concatenate":
        return d.unionByName(_relation(args[1], catalog))
    if f in ("limit", "take"):
        return d.limit(args[1].value)
    if f == "sort":
        orders = []
        for s in args[1].args if args[1].kind == "list" else args[1:]:
            if s.kind == "call" and s.value in ("asc", "desc") and s.args[0].kind == "literal":
                name, down = s.args[0].value, s.value == "desc"
            elif s.kind == "call" and s.value in ("ascending", "descending"):
                name, down = s.args[0].args[0].value, s.value == "descending"
            else:
                raise QueryError("an order is needed")
            orders.append(F.col(f"`{name}`").desc() if down else F.col(f"`{name}`").asc())
        return d.orderBy(*orders)
    raise QueryError(f"unknown step {f}")
