"""Named, parameterized queries over the ten tables.

A query is Spark SQL with tables in braces and bound parameters.  A few macros hide
what differs between engines or depends on a list's length, so the same text also
gives the SQL that the results are checked with:

    ANY(column, name)    column is among the values of parameter name; true if it has none
    JSON(column, 'path') a JSON value as text
    JOINED(column)       distinct values, sorted, comma-joined; null if there are none
    COLLECTED(a, b)      values of b in the order of a, comma-joined
    BYTES(text)          its length in UTF-8
    UPTO(name)           LIMIT by parameter name; all rows if it is null
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomspark.plans.projection import ORACLE_TABLES

_MACRO = re.compile(r"\b(ANY|JSON|JOINED|COLLECTED|BYTES|UPTO)\(([^()]*(?:\([^()]*\)[^()]*)*)\)")


def quoted(value: Any) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


@dataclass(frozen=True)
class Named:
    key: str
    path: str
    sql: str
    params: Mapping[str, Any] = field(default_factory=dict)
    about: str = ""

    def _expand(self, dialect: str, params: Mapping[str, Any]) -> tuple[str, dict[str, Any]]:
        args = {k: v for k, v in params.items() if not isinstance(v, (list, tuple))}

        def macro(m: re.Match) -> str:
            name, inner = m[1], m[2]
            head, _, tail = inner.rpartition(",")
            head, tail = head.strip(), tail.strip()
            if name == "ANY":
                values = list(params[tail])
                args.update({f"{tail}_{i}": v for i, v in enumerate(values)})
                return f"{head} IN ({', '.join(f':{tail}_{i}' for i in range(len(values)))})" if values else "TRUE"
            if name == "UPTO":
                return f"LIMIT :{tail}" if params[tail] is not None else ""
            if name == "JSON":
                return f"{'get_json_object' if dialect == 'spark' else 'json_extract_string'}({head}, {tail})"
            if name == "BYTES":
                return f"CAST({'octet_length' if dialect == 'spark' else 'strlen'}({inner}) AS BIGINT)"
            if name == "JOINED":
                return f"nullif(array_join(array_sort(collect_set({inner})), ','), '')" if dialect == "spark" else f"string_agg(DISTINCT {inner}, ',' ORDER BY {inner})"
            if dialect == "spark":
                return f"array_join(transform(array_sort(collect_list(struct({head} AS a, {tail} AS b))), x -> x.b), ',')"
            return f"string_agg({tail}, ',' ORDER BY {head})"

        return _MACRO.sub(macro, self.sql), args

    def bind(self, **given: Any) -> Named:
        """The query with other defaults (an alias)."""
        unknown = set(given) - set(self.params)
        if unknown:
            raise ValueError(f"{self.key} has no parameter {', '.join(sorted(unknown))}")
        return replace(self, params={**self.params, **given})

    def run(self, spark: SparkSession, tables: Mapping[str, DataFrame], **given: Any) -> DataFrame:
        bound = self.bind(**given)
        text, args = bound._expand("spark", bound.params)
        used = {t: tables[t] for t in set(re.findall(r"\{(\w+)\}", text))}
        return spark.sql(text, args={k: v for k, v in args.items() if f":{k}" in text}, **used)

    def oracle(self, **given: Any) -> str:
        bound = self.bind(**given)
        text, args = bound._expand("duckdb", bound.params)
        text = re.sub(r"\{(\w+)\}", lambda m: "session_events" if m[1] == "events" else m[1], text)
        for k in sorted(args, key=len, reverse=True):
            text = re.sub(rf":{k}\b", lambda _: quoted(args[k]), text)
        return f"WITH {ORACLE_TABLES}, answer AS ({text}) SELECT * FROM answer"


class Catalog:
    """Queries by key, by folder/name and by a bare name that is unique."""

    def __init__(self, queries: Iterable[Named]):
        self.by_key: dict[str, Named] = {}
        self.by_path: dict[str, Named] = {}
        for q in queries:
            if q.key in self.by_key or q.path in self.by_path:
                raise ValueError(f"{q.key} ({q.path}) is defined twice")
            self.by_key[q.key] = self.by_path[q.path] = q

    def get(self, name: str) -> Named:
        if found := self.by_key.get(name) or self.by_path.get(name):
            return found
        bare = [q for p, q in self.by_path.items() if p.rpartition("/")[2] == name]
        if len(bare) != 1:
            raise KeyError(f"{name}: {'no such query' if not bare else 'more than one query'}")
        return bare[0]

    def listing(self) -> list[tuple[str, str, str]]:
        return sorted((q.path, q.key, q.about) for q in self.by_key.values())
