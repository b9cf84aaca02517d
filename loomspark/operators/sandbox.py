"""Read-only SQL with limits: what may run, how much comes back, and whether it is complete."""

from __future__ import annotations

import datetime
import re
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

ROWS, COLUMNS, CELL_BYTES, SECONDS = 1000, 128, 4000, 5.0
PREVIEW = 160


class SandboxError(ValueError):
    """SQL that isn't allowed."""


_HIDDEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)


def masked(sql: str) -> str:
    """sql with texts, quoted names and comments blanked, of the same length."""
    return _HIDDEN.sub(lambda m: " " * len(m[0]) if m[0][0] in "-/" else m[0][0] + "_" * (len(m[0]) - 2) + m[0][-1], sql)


def single_select(sql: str, require_order: bool = False) -> str:
    """The statement without its last semicolon; anything but one SELECT or WITH is refused."""
    plain = masked(sql).rstrip()
    text = sql[: len(plain)]
    if plain.endswith(";"):
        plain, text = plain[:-1].rstrip(), text[: len(plain) - 1].rstrip()
    if ";" in plain:
        raise SandboxError("one statement only")
    if not re.match(r"\s*\(*\s*(select|with)\b", plain, re.I):
        raise SandboxError("only SELECT or WITH")
    if re.search(r"\b(insert|update|delete|merge|drop|create|alter|truncate|set|reset|use|cache|uncache|add|load|refresh|analyze|recursive)\b\s+(into|from|table|view|database|schema|jar|file|data|\w+\s*\()", plain, re.I):
        raise SandboxError("reads only")
    if require_order and not re.search(r"\border\s+by\b", plain, re.I):
        raise SandboxError("an ORDER BY is required")
    return text


# What a statement may be made of, by the names that Spark's parser gives plan nodes, and the functions it may call.
NODES = frozenset(
    """Project Filter Join Aggregate Sort Distinct Union Intersect Except GlobalLimit LocalLimit Offset SubqueryAlias OneRowRelation
    WithWindowDefinition Pivot Unpivot LateralJoin UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedInlineTable LocalRelation
    UnresolvedSubqueryColumnAliases UnresolvedHint UnresolvedOrderBy""".split()
)
FUNCTIONS = frozenset(
    """abs acos add_months approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position
    array_size array_sort arrays_zip ascii asin atan atan2 avg base64 bigint bit_and bit_or bit_xor bool_and bool_or boolean btrim
    cardinality ceil ceiling char char_length character_length chr coalesce collect_list collect_set concat concat_ws contains corr cos
    count count_if crc32 cume_dist current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc
    datediff day dayofmonth dayofweek dayofyear dense_rank double element_at endswith every exists exp extract filter find_in_set first
    first_value flatten float floor forall format_number format_string from_json from_unixtime get get_json_object greatest grouping
    grouping_id hash hex hour if ifnull ilike initcap instr int isnan isnotnull isnull json_array_length json_object_keys json_tuple kurtosis
    lag last last_day last_value lcase lead least left len length like listagg ln locate log log10 log2 lower lpad ltrim make_date map
    map_keys map_values max max_by md5 mean median min min_by minute mod month months_between named_struct next_day nth_value ntile
    nullif nvl nvl2 octet_length overlay parse_json percent_rank percentile percentile_approx percentile_cont pmod position pow power quarter
    rank regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace regexp_substr repeat replace reverse
    right rint rlike round row_number rpad rtrim schema_of_json second sequence sha1 sha2 sign signum sin size slice some sort_array
    split split_part sqrt startswith std stddev stddev_pop stddev_samp string string_agg struct substr substring substring_index sum
    tan timestamp timestampdiff to_char to_date to_json to_timestamp to_unix_timestamp transform translate trim trunc try_add try_avg
    try_cast try_divide try_element_at try_multiply try_subtract try_sum try_to_number try_to_timestamp typeof ucase unbase64 unhex
    unix_millis unix_seconds unix_timestamp upper url_decode url_encode var_pop var_samp variance weekday weekofyear width_bucket
    xxhash64 year zip_with""".split()
)


def _each(seq) -> Iterable:
    return (seq.apply(i) for i in range(seq.size()))


def _functions(expression) -> Iterable[str]:
    kind = expression.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        yield ".".join(_each(expression.nameParts())).lower()
    elif kind in ("UnresolvedGenerator", "ScalaUDF", "CallMethodViaReflection"):
        yield kind
    for child in _each(expression.children()):
        yield from _functions(child)


def _named(expression) -> Iterable[tuple[list[str], Any]]:
    """(name parts, origin) of the column names and stars in an expression."""
    kind = expression.getClass().getSimpleName()
    if kind == "UnresolvedAttribute":
        yield list(_each(expression.nameParts())), expression.origin()
    elif kind == "UnresolvedStar" and expression.target().isDefined():
        yield list(_each(expression.target().get())), expression.origin()
    for child in _each(expression.children()):
        yield from _named(child)


@dataclass
class Reading:
    """What a statement reads: tables as (parts of the name, place in the text, aliased), and longer column names with their places."""

    tables: list[tuple[tuple[str, ...], tuple[int, int], bool]] = field(default_factory=list)
    columns: list[tuple[list[str], tuple[int, int]]] = field(default_factory=list)


def _place(origin) -> tuple[int, int]:
    return origin.startIndex().get(), origin.stopIndex().get() + 1


def _read(plan, known: frozenset[str], out: Reading, aliased: bool = False) -> None:
    """Adds the tables of a parsed plan; known are the common table expressions that its names may mean."""
    node = plan.nodeName()
    if node not in NODES:
        raise SandboxError(f"not allowed: {node}")
    if node == "UnresolvedRelation":
        parts = tuple(p.lower() for p in _each(plan.multipartIdentifier()))
        if len(parts) > 1 or parts[0] not in known:  # a common table expression has no namespace
            out.tables.append((parts, _place(plan.origin()), aliased))
    for expression in _each(plan.expressions()):
        for name in _functions(expression):
            if name not in FUNCTIONS:
                raise SandboxError(f"not allowed: {name}")
        out.columns += [(parts, _place(origin)) for parts, origin in _named(expression) if len(parts) > 1 and origin.startIndex().isDefined()]
    if node == "UnresolvedWith":
        if plan.allowRecursion():
            raise SandboxError("no recursion")
        for pair in _each(plan.cteRelations()):
            # a common table expression sees those before it, not itself
            for child in _each(pair._2().children()):
                _read(child, known, out)
            known = known | {pair._1().lower()}
    for part in (plan.subqueries(), plan.children()):
        for child in _each(part):
            _read(child, known, out, node == "SubqueryAlias")


def reading(spark: SparkSession, sql: str) -> Reading:
    """What a statement reads; node kinds and functions outside the lists are refused."""
    out = Reading()
    _read(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset(), out)
    return out


def tables_read(spark: SparkSession, sql: str) -> set[str]:
    """Lower-case names of the tables that a statement reads, namespaces before a point."""
    return {".".join(parts) for parts, _, _ in reading(spark, sql).tables}


@dataclass
class Result:
    """What a query gave: rows by column, and in which way it is incomplete."""

    columns: list[str] = field(default_factory=list)
    rows: list[dict[str, Any]] = field(default_factory=list)
    count: int = 0
    complete: bool = False
    truncated: bool = False
    rows_truncated: bool = False
    cell_diagnostics: list[dict[str, Any]] = field(default_factory=list)
    error: str | None = None


def cell(value: Any, limit: int) -> tuple[Any, int | None]:
    """A plain value, and its full size in bytes if it was cut (at a character)."""
    if isinstance(value, (bytes, bytearray)):
        value = bytes(value).decode("utf-8", "replace")
    elif isinstance(value, datetime.datetime):
        value = value.isoformat() + ("" if value.tzinfo else "Z")
    elif isinstance(value, Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    elif isinstance(value, (datetime.date, datetime.timedelta)):
        value = str(value)
    if isinstance(value, str) and len(raw := value.encode("utf-8", "replace")) > limit:
        return raw[:limit].decode("utf-8", "ignore"), len(raw)
    return value, None


class Sandbox:
    """Runs single read-only statements over an allowed set of views.

    A table named with a namespace (anno.annotations) is read by that name only.  A table may be a function that
    gives its DataFrame: it is called for every statement that reads it, so the statement sees what is there now.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], rows: int = ROWS, columns: int = COLUMNS, cell_bytes: int = CELL_BYTES, seconds: float = SECONDS):
        self.spark, self.tables = spark.newSession(), {k.lower(): v for k, v in tables.items()}
        self.rows, self.columns, self.cell_bytes, self.seconds = rows, columns, cell_bytes, seconds
        for name, df in self.tables.items():
            if not callable(df):
                self._view(name, df)

    def _view(self, name: str, df: DataFrame) -> None:
        view = name.replace(".", "__")
        df._jdf.createOrReplaceGlobalTempView(f"{view}_{id(self)}")
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{view}` AS SELECT * FROM global_temp.`{view}_{id(self)}`")

    def plan(self, sql: str, args: Sequence[Any] | Mapping[str, Any] | None = None, require_order: bool = False) -> DataFrame:
        """The checked statement as a DataFrame."""
        text = single_select(sql, require_order)
        read = reading(self.spark, text)
        names = {".".join(parts) for parts, _, _ in read.tables}
        if other := sorted(n for n in names if n not in self.tables):
            raise SandboxError(f"not allowed: {', '.join(other)}")
        for name in names:
            if callable(self.tables[name]):
                self._view(name, self.tables[name]())
        # names with a namespace become names of views, at the places that the parser gives for them
        puts = []
        for parts, place, aliased in read.tables:
            if len(parts) > 1:
                puts.append((place, f"`{'__'.join(parts)}`" + ("" if aliased else f" AS `{parts[-1]}`")))
        for parts, place in read.columns:
            star = text[slice(*place)].rstrip().endswith("*")  # of a star all parts name the table, of a column all but the last at most
            for n in range(len(parts) if star else len(parts) - 1, 1, -1):
                if ".".join(parts[:n]).lower() in names:
                    puts.append((place, ".".join(f"`{p}`" for p in parts[n - 1 :]) + (".*" if star else "")))
                    break
        for (start, stop), new in sorted(set(puts), reverse=True):
            text = text[:start] + new + text[stop:]
        return self.spark.sql(text, args=args)

    def query(self, sql: str, args: Sequence[Any] | Mapping[str, Any] | None = None, strict: bool = False, require_order: bool = False) -> Result:
        """Never raises for what is wrong with the query: the error is in the result, with no rows."""
        try:
            df = self.plan(sql, args, require_order)
            if len(df.columns) > self.columns:
                raise SandboxError(f"more than {self.columns} columns")
            got = self._collected(df.limit(self.rows + 1))
        except Exception as e:  # the envelope reports every failure of a query
            shown = " ".join(sql.split())
            return Result(error=f"{str(e).splitlines()[0]} in: {shown[:PREVIEW]}{'...' if len(shown) > PREVIEW else ''}")
        over = len(got) > self.rows
        out = Result(columns=list(df.columns), rows_truncated=over)
        for i, row in enumerate(got[: self.rows]):
            made = {}
            for name, value in zip(df.columns, row):
                made[name], full = cell(value, self.cell_bytes)
                if full is not None:
                    out.cell_diagnostics.append({"row": i, "column": name, "bytes": full})
            out.rows.append(made)
        out.count, out.truncated = len(out.rows), over or bool(out.cell_diagnostics)
        out.complete = not out.truncated
        if strict and not out.complete:
            return Result(columns=out.columns, truncated=True, rows_truncated=over, cell_diagnostics=out.cell_diagnostics, error="the result is incomplete")
        return out

    def _collected(self, df: DataFrame):
        tag = f"sandbox-{uuid.uuid4().hex}"
        timer = threading.Timer(self.seconds, lambda: self.spark.interruptTag(tag))
        self.spark.addTag(tag)
        timer.start()
        try:
            return df.collect()
        finally:
            timer.cancel()
            self.spark.removeTag(tag)


def tagged(parts: Sequence[str], values: Sequence[Any]) -> tuple[str, list[Any]]:
    """Text pieces with values between them as one text with positional markers."""
    if len(parts) != len(values) + 1:
        raise SandboxError("one value between two pieces")
    if any(re.search(r":[a-z_]\w*", masked(p), re.I) for p in parts):
        raise SandboxError("no named parameters beside values")
    return "?".join(parts), list(values)
