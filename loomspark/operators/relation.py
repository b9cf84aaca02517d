"""A small typed, immutable relation over a DataFrame: what plain DataFrames don't check.

Names are unique ignoring case, predicates are boolean, comparisons are between equal
kinds, an order survives filters and is applied once, and expressions of another
handle are refused.  Every callback sees rows of a scope of its own, so a relation can be
counted inside a callback over itself; a column of the enclosing row becomes an outer
reference of a scalar subquery, which Catalyst turns into a join.  Everything else is the
DataFrame itself.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FIELDS = 128
MAX_TEXT = 1 << 20
MAX_INT = 2**53 - 1
MAX_NODES = 4096
MAX_NESTING = 32
MAX_SQL = 1 << 20

KINDS = {T.StringType: "string", T.BooleanType: "boolean", T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.DoubleType: "number", T.FloatType: "number"}


class RelationError(ValueError):
    """A relation or expression that isn't allowed; the message says why."""


#: How a column of a row scope is named where the expression is put: (scope, name) to a column.
Place = Callable[[str, str], Column]

_scopes = itertools.count(1)
_open: ContextVar[tuple[str, ...]] = ContextVar("open_rows", default=())


@dataclass(frozen=True)
class Expr:
    """An expression with its kind; owner is the handle it came from, text tells equal expressions."""

    at: Callable[[Place], Column]
    kind: str
    owner: int | None = None
    size: int = 1
    depth: int = 1
    text: str = ""
    counts: bool = False

    def _with(self, op: Callable[..., Column], kind: str, name: str, *others: Expr) -> Expr:
        every = (self, *others)
        owners = {e.owner for e in every if e.owner is not None}
        if len(owners) > 1:
            raise RelationError("expressions of two databases don't mix")
        size, depth = 1 + sum(e.size for e in every), 1 + max(e.depth for e in every)
        if size > MAX_NODES:
            raise RelationError(f"an expression of more than {MAX_NODES} nodes")
        if depth > MAX_NESTING:
            raise RelationError(f"an expression nested more than {MAX_NESTING} deep")
        return Expr(lambda place: op(*[e.at(place) for e in every]), kind, owners.pop() if owners else None, size, depth, f"{name}({','.join(e.text for e in every)})", any(e.counts for e in every))

    def _compare(self, other: Any, op: Callable[[Column, Column], Column], name: str) -> Expr:
        o = lift(other)
        if o.kind == "null":
            raise RelationError("compare with isNull(), not with null")
        if self.kind != o.kind and not {self.kind, o.kind} <= {"integer", "number"}:
            raise RelationError(f"a {self.kind} and a {o.kind} can't be compared")
        return self._with(op, "boolean", name, o)

    def eq(self, other: Any) -> Expr:
        return self._compare(other, lambda a, b: a == b, "eq")

    def ne(self, other: Any) -> Expr:
        return self._compare(other, lambda a, b: a != b, "ne")

    def gt(self, other: Any) -> Expr:
        return self._compare(other, lambda a, b: a > b, "gt")

    def gte(self, other: Any) -> Expr:
        return self._compare(other, lambda a, b: a >= b, "gte")

    def lt(self, other: Any) -> Expr:
        return self._compare(other, lambda a, b: a < b, "lt")

    def lte(self, other: Any) -> Expr:
        return self._compare(other, lambda a, b: a <= b, "lte")

    def _logical(self, op: Callable[..., Column], name: str, others: Sequence[Expr]) -> Expr:
        if any(e.kind != "boolean" for e in (self, *others)):
            raise RelationError("and, or and not take booleans")
        return self._with(op, "boolean", name, *others)

    def and_(self, *others: Expr) -> Expr:
        return self._logical(lambda *cs: reduce(lambda a, b: a & b, cs), "and", others)

    def or_(self, *others: Expr) -> Expr:
        return self._logical(lambda *cs: reduce(lambda a, b: a | b, cs), "or", others)

    def not_(self) -> Expr:
        return self._logical(lambda c: ~c, "not", ())

    def is_null(self) -> Expr:
        return self._with(lambda c: c.isNull(), "boolean", "is_null")

    def is_not_null(self) -> Expr:
        return self._with(lambda c: c.isNotNull(), "boolean", "is_not_null")

    def contains(self, needle: Any) -> Expr:
        """Case-sensitive; an empty needle is in every text."""
        n = lift(needle)
        if self.kind != "string" or n.kind != "string":
            raise RelationError("contains takes strings")
        return self._with(F.contains, "boolean", "contains", n)

    def asc(self) -> Order:
        return Order(self, True)

    def desc(self) -> Order:
        return Order(self, False)


@dataclass(frozen=True)
class Order:
    """Nulls come first ascending and last descending."""

    expr: Expr
    ascending: bool

    def of(self, c: Column) -> Column:
        return c.asc_nulls_first() if self.ascending else c.desc_nulls_last()


def lift(value: Any) -> Expr:
    """A literal as an expression, with its limits checked."""
    if isinstance(value, Expr):
        return value
    literal = lambda c, kind: Expr(lambda _: c, kind, text=repr(value))
    if value is None:
        return literal(F.lit(None), "null")
    if isinstance(value, bool):
        return literal(F.lit(value), "boolean")
    if isinstance(value, int):
        if abs(value) > MAX_INT:
            raise RelationError("an integer beyond 2^53 - 1")
        return literal(F.lit(value).cast("long"), "integer")
    if isinstance(value, float):
        if not math.isfinite(value):
            raise RelationError("a number that isn't finite")
        return literal(F.lit(value), "number")
    if isinstance(value, str):
        if len(value.encode()) > MAX_TEXT:
            raise RelationError("a text of more than 1 MiB")
        return literal(F.lit(value), "string")
    raise RelationError(f"no literal for {type(value).__name__}")


@dataclass(frozen=True)
class Parameter:
    """A declared parameter: name, kind, default and, of numbers, least and most."""

    name: str
    kind: str
    default: Any = None
    least: float | None = None
    most: float | None = None

    def checked(self, value: Any) -> Any:
        got = lift(value).kind
        if got not in (self.kind, "null") and not (got == "integer" and self.kind == "number"):
            raise RelationError(f"parameter {self.name} is a {self.kind}, not a {got}")
        if value is not None and ((self.least is not None and value < self.least) or (self.most is not None and value > self.most)):
            raise RelationError(f"parameter {self.name} lies outside its range")
        return value


def bind(declared: Sequence[Parameter], given: Mapping[str, Any]) -> dict[str, Any]:
    """Values by name: no unknown name, no missing one, no two declarations that differ."""
    known: dict[str, Parameter] = {}
    for p in declared:
        if known.setdefault(p.name, p) != p:
            raise RelationError(f"parameter {p.name} is declared in two ways")
    if unknown := set(given) - set(known):
        raise RelationError(f"no parameter {', '.join(sorted(unknown))}")
    if missing := [n for n, p in known.items() if n not in given and p.default is None]:
        raise RelationError(f"parameter {', '.join(missing)} has no value")
    return {n: p.checked(given.get(n, p.default)) for n, p in known.items()}


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


class Row:
    """Columns of a relation by name, case-insensitive; an unknown one is an error.  Each row has a scope of its own."""

    def __init__(self, relation: Relation):
        self._relation, self._scope = relation, f"row{next(_scopes)}"

    def __getattr__(self, name: str) -> Expr:
        return self[name]

    def __getitem__(self, name: str) -> Expr:
        r, scope = self._relation, self._scope
        for n, kind in r.fields:
            if n.lower() == name.lower():
                if kind is None:
                    raise RelationError(f"column {name} has no kind of its own")
                return Expr(lambda place: place(scope, n), kind, r.owner, text=f"{scope}.{n}")
        raise RelationError(f"no column {name}")


@contextmanager
def _rows_of(relation: Relation) -> Iterator[tuple[Row, DataFrame, Place]]:
    """A row scope: the row, the frame under its name, and how columns are named there."""
    row = Row(relation)
    scope, around = row._scope, _open.get()
    token = _open.set((*around, scope))

    def place(of: str, name: str) -> Column:
        c = F.col(f"{of}.{_quoted(name)}")
        if of == scope:
            return c
        if of not in around:
            raise RelationError("a column is used outside its callback")
        if of != around[-1]:
            raise RelationError("a column is used more than one callback further in")
        return c.outer()

    try:
        yield row, relation.frame.alias(scope), place
    finally:
        _open.reset(token)


@dataclass(frozen=True)
class Relation:
    frame: DataFrame
    owner: int
    fields: tuple[tuple[str, str | None], ...]
    order: tuple[Order, ...] = ()

    def where(self, fn: Callable[[Row], Expr]) -> Relation:
        with _rows_of(self) as (row, frame, place):
            cond = self._own(fn(row))
            if cond.kind != "boolean":
                raise RelationError("where takes a boolean")
            return replace(self, frame=frame.where(cond.at(place)))

    def select(self, fn: Callable[[Row], Mapping[str, Expr]]) -> Relation:
        """Fields by name; every expression that the present order uses has to stay."""
        with _rows_of(self) as (row, frame, place):
            fields = {k: self._own(lift(v)) for k, v in fn(row).items()}
            if not 1 <= len(fields) <= MAX_FIELDS:
                raise RelationError(f"select takes 1 to {MAX_FIELDS} fields")
            if len({k.lower() for k in fields}) < len(fields):
                raise RelationError("two fields have one name")
            kept = {e.text.replace(f"{row._scope}.", ""): k for k, e in fields.items()}
            if lost := [o.expr.text for o in self.order if o.expr.text not in kept]:
                raise RelationError(f"the order needs {', '.join(lost)}")
            out = replace(self, frame=frame.select(*[e.at(place).alias(k) for k, e in fields.items()]), fields=tuple((k, e.kind) for k, e in fields.items()), order=())
            return replace(out, order=tuple(replace(o, expr=_own_column(out, kept[o.expr.text])) for o in self.order))

    def order_by(self, fn: Callable[[Row], Any]) -> Relation:
        """Replaces the order so far."""
        with _rows_of(self) as (row, _, _):
            keys = fn(row)
            keys = [k if isinstance(k, Order) else k.asc() for k in (keys if isinstance(keys, (list, tuple)) else [keys])]
            for k in keys:
                self._own(k.expr)

        def anywhere(e: Expr) -> Expr:  # the order is applied later, to rows of another scope: its columns go by name alone
            return replace(e, at=lambda place: e.at(lambda of, n: place("" if of == row._scope else of, n)), text=e.text.replace(f"{row._scope}.", ""))

        return replace(self, order=tuple(replace(k, expr=anywhere(k.expr)) for k in keys))

    def count(self) -> Expr:
        """How many rows the relation has, 0 if none, as an expression; inside a callback it may depend on the callback's row.

        Equal columns of the two rows make it a grouped count joined by them.  Other
        comparisons make Catalyst compare the distinct values of the outer row with
        all rows of this relation: keep an equality beside them on large tables.
        """
        frame = self.frame
        return Expr(lambda _: frame.select(F.count(F.lit(1))).scalar(), "integer", self.owner, text=f"count{next(_scopes)}", counts=True)

    def count_of(self, other: Relation, on: Mapping[str, str], name: str) -> Relation:
        """Adds how many rows of other agree on the columns `on` (own name to other's): 0 where there are none."""
        self._same(other)
        n = other.frame.groupBy(*[F.col(_quoted(b)).alias(f"__{b}") for b in on.values()]).agg(F.count(F.lit(1)).alias(name))
        joined = self.frame.alias("own").join(n.alias("n"), [F.col(f"own.{_quoted(a)}") == F.col(f"n.{_quoted('__' + b)}") for a, b in on.items()], "left")
        frame = joined.select(*[F.col(f"own.{_quoted(c)}") for c, _ in self.fields], F.coalesce(F.col(f"n.{_quoted(name)}"), F.lit(0)).cast("long").alias(name))
        return replace(self, frame=frame, fields=(*self.fields, (name, "integer")))

    def use(self, fn: Callable[[Relation], Relation], requires: Sequence[str] = ()) -> Relation:
        """A reusable step: the columns that it requires are checked, and what it returns has to come from here."""
        row = Row(self)
        for name in requires:
            row[name]
        out = fn(self)
        if not isinstance(out, Relation):
            raise RelationError("use has to return a relation")
        self._same(out)
        return out

    def map_rows(self, fn: Callable[[dict], dict], schema: str) -> DataFrame:
        """The last step: one row out for each row in, in Arrow batches on the executors."""

        def run(batches):
            for pdf in batches:
                rows = [fn(r) for r in pdf.to_dict("records")]
                yield pdf.iloc[:0] if not rows else type(pdf)(rows)

        return self.build().mapInPandas(run, schema)

    def build(self) -> DataFrame:
        if not self.order:
            return self.frame
        with _rows_of(self) as (row, frame, place):
            keys = [o.expr.at(lambda of, n: place(of or row._scope, n)) for o in self.order]
            if not any(o.expr.counts for o in self.order):
                return frame.orderBy(*[o.of(k) for o, k in zip(self.order, keys)])
            # counts are no sort keys of their own: they are columns first
            names = [f"__key{i}" for i in range(len(keys))]
            sorted_ = frame.select("*", *[k.alias(n) for n, k in zip(names, keys)]).orderBy(*[o.of(F.col(n)) for o, n in zip(self.order, names)])
            return sorted_.drop(*names)

    def explain(self) -> str:
        return self.build()._jdf.queryExecution().toString()

    def _own(self, e: Expr) -> Expr:
        if e.owner not in (None, self.owner):
            raise RelationError("expressions of two databases don't mix")
        return e

    def _same(self, other: Relation) -> None:
        if other.owner != self.owner:
            raise RelationError("relations of two databases don't mix")


def _own_column(relation: Relation, name: str) -> Expr:
    return Expr(lambda place: place("", name), dict(relation.fields)[name], relation.owner, text=name)


def _fields(df: DataFrame) -> tuple[tuple[str, str | None], ...]:
    return tuple((f.name, KINDS.get(type(f.dataType))) for f in df.schema.fields)


def declare(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """df under a declaration, name to kind in order; a kind that ends in ? may be null.

    An integer column can be declared a number, or a boolean if it holds 0 and 1 alone.
    Names and types are compared at once.  Values (no null, no NaN or infinity, 0 and 1)
    are checked by metrics on the source while a query reads it: Catalyst neither
    pushes filters below them nor drops the columns they read, so each row that the
    source gives is checked whatever the query goes on to keep, in the scan that the
    query makes anyway, and the first bad one fails the query.  A query whose result
    is empty by its text alone reads nothing, and one that stops early, by a limit
    without an order, has checked what it read.
    """
    if list(columns) != df.columns:
        raise RelationError(f"declared {list(columns)}, but the query gives {df.columns}")
    checks, out = [], []
    for f, (name, said) in zip(df.schema.fields, columns.items()):
        c, kind, nullable = F.col(_quoted(name)), said.removesuffix("?"), said.endswith("?")
        have = KINDS.get(type(f.dataType), f.dataType.simpleString())
        if kind not in KINDS.values():
            raise RelationError(f"no kind {said}")
        if not (have == kind or (have == "integer" and kind in ("number", "boolean")) or (have == "void" and nullable)):
            raise RelationError(f"declared {name} a {said}, but the query gives a {have}")
        bad = [] if nullable else [c.isNull()]
        if have == kind == "number":
            bad.append(F.isnan(c) | (F.abs(c) == float("inf")))
        if have == "integer" and kind == "boolean":
            bad.append(~c.isin(0, 1))
        if bad:
            told = F.concat(F.lit(f"column {name} is declared {said}, but holds "), F.coalesce(c.cast("string"), F.lit("null")))
            checks.append(F.count(F.when(F.coalesce(reduce(lambda a, b: a | b, bad), F.lit(False)), F.raise_error(told))).alias(name))
        out.append(c if have == kind else c.cast({"number": "double", "integer": "long"}.get(kind, kind)).alias(name))
    checked = df.observe(f"declared-{uuid.uuid4().hex}", *checks) if checks else df
    return checked.select(*out)


class Database:
    """Tables under one handle."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark, self.tables = spark, {k.lower(): v for k, v in tables.items()}

    def table(self, name: str) -> Relation:
        df = self.tables.get(name.lower())
        if df is None:
            raise RelationError(f"no table {name}")
        if len(df.columns) > MAX_FIELDS or len({c.lower() for c in df.columns}) < len(df.columns):
            raise RelationError(f"{name} has too many columns or two of one name")
        return Relation(df, id(self), _fields(df))

    def sql(self, text: str, args: Sequence[Any] = (), columns: Mapping[str, str] | None = None) -> Relation:
        """A SQL source with positional values; declared columns are checked by name, order, kind and value (declare)."""
        if len(text.encode()) > MAX_SQL:
            raise RelationError("a statement of more than 1 MiB")
        for a in args:
            lift(a)
        df = self.spark.sql(text, args=list(args), **{k: v for k, v in self.tables.items() if f"{{{k}}}" in text})
        if columns is not None:
            df = declare(df, columns)
        return Relation(df, id(self), _fields(df))
