"""Column functions with the lenient or byte-exact semantics that session queries rely on."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT_MARK = "\n[truncated]"


def cut_bytes(c: Column, limit: int) -> Column:
    """The longest prefix of whole characters within limit bytes."""
    raw = F.substring(c.cast("binary"), 1, limit)
    # a character that the cut broke is one replacement at the end
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\\uFFFD+$", ""))


def truncation(c: Column, limit: int = 10240) -> Column:
    """struct(text, truncated, full_bytes, full_hash) of an output; bytes and hash only where it was cut."""
    over = F.octet_length(c) > limit
    return F.struct(F.when(over, F.concat(cut_bytes(c, limit), F.lit(CUT_MARK))).otherwise(c).alias("text"), over.alias("truncated"), F.when(over, F.octet_length(c).cast("long")).alias("full_bytes"), F.when(over, F.sha2(c, 256)).alias("full_hash"))


def like_ci(c: Column, pattern: str) -> Column:
    """LIKE that ignores case."""
    return c.ilike(pattern)


def substr_zero(c: Column, start: int, length: int) -> Column:
    """substr where position 0 lies before the first character."""
    return F.substring(c, 1, max(0, length - 1)) if start == 0 else F.substring(c, start, length)


def as_number(c: Column) -> Column:
    """The numeric prefix of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def as_date(c: Column) -> Column:
    """The date of a timestamp text; null for what isn't one."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def flags_sum(*conditions: Column) -> Column:
    """How many conditions hold, as arithmetic on 0 and 1."""
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total


def json_value(c: Column, path: str) -> Column:
    """A JSON value with booleans as 1 and 0."""
    v = F.get_json_object(c, path)
    return F.when(v == "true", "1").when(v == "false", "0").otherwise(v)


def escape_like(text: str) -> str:
    return re.sub(r"([%_\\])", r"\\\1", text)


# What a command or path shows.
BADGES = (("commit", r"\bgit commit\b"), ("test", r"\b(make|pytest|go) test\b|\bpytest\b"), ("ticket", r"\b[A-Z]{2,}-[0-9]+\b"), ("document", r"\.md\b"), ("write", r">{1,2}\s*\S"))


def badges(c: Column) -> Column:
    """Sorted names of the badges that a text earns."""
    return F.array_sort(F.filter(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in BADGES]), lambda b: b.isNotNull()))
