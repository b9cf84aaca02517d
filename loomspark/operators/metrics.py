"""Session algebra over nested documents, as column expressions and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators import sequence as S

ACTIVE_GAP = 300
CUT_BYTES = 10240
# The counted operations and the states that an outcome keeps.
OPERATIONS = ("READ", "MODIFY", "NEW", "EXECUTE", "DELEGATE")


def outcome_status(success: Column, status: Column) -> Column:
    """success decides; without it only pending and cancelled survive."""
    return F.when(success, "succeeded").when(~success, "failed").when(status.isin("pending", "cancelled"), status).otherwise("unknown")


def quality(turns: Column, calls: Column, any_result: Column) -> Column:
    return F.when((turns > 5) & (calls > 10) & any_result, "A").when(turns > 0, "B").otherwise("C")


def period(started: Column) -> Column:
    return F.when(started.rlike("^[0-9]{4}-[0-9]{2}"), F.substring(started, 1, 7)).otherwise("unknown")


def clean_id(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), 1, 200)


def home_to_tilde(c: Column) -> Column:
    return F.regexp_replace(c, "^/(?:home|Users)/[^/]+", "~")


def epoch(c: Column) -> Column:
    """Epoch seconds, or milliseconds beyond 1e12, as a timestamp."""
    return F.timestamp_micros(F.when(c > 1e12, c * 1000).otherwise(c * 1000000).cast("long"))


def millis_between(a: Column, b: Column) -> Column:
    """b - a in ms of two texts; null if either isn't a time or b comes first."""
    ms = F.unix_millis(F.try_to_timestamp(b)) - F.unix_millis(F.try_to_timestamp(a))
    return F.when(ms >= 0, ms)


def cut_bytes(text: Column, most: int) -> Column:
    """The longest head of text of at most so many bytes of UTF-8."""
    # a code point has four bytes at most and one at least: the head lies between most / 4 and most characters
    sizes = F.transform(F.sequence(F.lit(most), F.lit(0), F.lit(-1)), lambda n: F.struct((F.octet_length(F.substr(text, F.lit(1), n)) <= most).alias("fits"), n.alias("n")))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substr(text, F.lit(1), F.get(F.filter(sizes, lambda x: x["fits"]), F.lit(0))["n"]))


def title_of(turns: Column) -> Column:
    """The first person's turn that isn't blank, line ends as spaces, up to 80 bytes."""
    said = F.filter(turns, lambda t: (t["role"] == "user") & (t["source"] == "human") & (F.trim(F.coalesce(t["content"], F.lit(""))) != ""))
    return cut_bytes(F.trim(F.replace(F.get(said, F.lit(0))["content"], F.lit("\n"), F.lit(" "))), 80)


def names_home(path: str) -> Column:
    """Whether any path lies in a person's home (aggregate)."""
    return F.coalesce(F.bool_or(F.contains(path, F.lit("/Users/")) | F.contains(path, F.lit("/home/"))), F.lit(False))


def timing(stamps: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """(key, started, ended, duration_seconds, hour_of_day, day_of_week, active_duration_seconds); Monday is 0."""
    t = stamps.where(F.col(ts).isNotNull()).groupBy(key).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"))
    t = t.select("*", S.seconds_between(F.col("started"), F.col("ended")).alias("duration_seconds"), F.hour("started").cast("long").alias("hour_of_day"), F.weekday("started").cast("long").alias("day_of_week"))
    return t.join(S.active_seconds(stamps, key, ts, ACTIVE_GAP).withColumnRenamed("active_seconds", "active_duration_seconds"), key, "left")


def call_metrics(calls: DataFrame) -> DataFrame:
    """Counts per session: all calls, operations of calls that aren't orchestration, read ratio cut to three decimals."""
    real = F.col("record_kind") != "orchestration"
    n = [F.count_if(real & (F.col("operation_type") == op)).alias(name) for op, name in zip(OPERATIONS, ("read_count", "modify_count", "create_count", "execute_count", "delegate_count"))]
    g = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tool_call_count"), *n, F.count_if(F.col("record_kind") == "orchestration").alias("orchestration_count"), F.count_if(F.col("record_kind") == "execution").alias("execution_record_count"),
        F.count_if(F.col("record_kind") == "file_change").alias("file_change_count"), F.min_by("timestamp", "source_ordinal").alias("first_call"), F.count("spawned_agent_type").alias("subagent_count"), F.max(F.col("result").isNotNull()).alias("any_result"),
    )
    return g.withColumn("read_ratio", S.truncated_ratio(F.col("read_count"), F.col("tool_call_count")))


def turn_metrics(turns: DataFrame) -> DataFrame:
    """Counts, token totals (0 is null), model switches and response sizes per session."""
    w = Window.partitionBy("session_id").orderBy("turn_index")
    seen = F.last("model", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = turns.withColumn("switch", F.col("model").isNotNull() & seen.isNotNull() & (F.col("model") != seen))
    total = lambda c: F.nullif(F.sum(c), F.lit(0)).alias(f"total_{c}")
    models = F.count_distinct("model")
    answered = F.when((F.col("role") == "assistant") & (F.col("output_tokens") > 0), F.col("output_tokens"))
    xs = F.array_sort(F.collect_list(answered))
    return t.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turn_count"), *[total(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens", "tool_tokens")],
        F.when(models >= 2, models).alias("unique_models"), F.when(models >= 2, F.count_if("switch")).alias("model_switches"),
        F.get(xs, F.floor(F.size(xs) / 2).cast("int")).alias("median_response_tokens"), F.max(answered).alias("max_response_tokens"),
    )


def idle_ratio(active: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.floor((1 - active / duration) * 1000) / 1000)
