"""Analyses of several steps over the ten tables, as DataFrame functions, with SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators import sequence as S
from loomspark.operators.flatten import sessions_base
from loomspark.plans.history import HISTORY, SQL, api_call_runs, compactions
from loomspark.plans.projection import ORACLE_TABLES

Tables = Mapping[str, DataFrame]

def session_activity(t: Tables, framework: list[str] | None = None, cwd: str | None = None, since: str | None = None) -> DataFrame:
    """VRB-01: sessions with the last time of any turn or call, latest first; cwd matches case-insensitively."""
    times = t["turns"].select("session_id", "timestamp").unionByName(t["tool_calls"].select("session_id", "timestamp"))
    last = times.groupBy("session_id").agg(F.max("timestamp").alias("last_activity"))
    s = t["sessions"].select("session_id", "title", "agent_framework", "working_directory", "started_at")
    if framework:
        s = s.where(F.col("agent_framework").isin(list(framework)))
    if cwd:
        s = s.where(F.contains(F.lower("working_directory"), F.lower(F.lit(cwd))))
    out = s.join(last, "session_id", "left")
    if since:
        out = out.where(F.col("last_activity") >= since)
    return out.orderBy(F.desc_nulls_last("last_activity"), "session_id")


def file_activity(t: Tables) -> DataFrame:
    """VRB-02: the latest touch of each (session, file), and how many there were."""
    named = F.coalesce("file_path", F.get_json_object("arguments_json", "$.path"), F.get_json_object("arguments_json", "$.file"))
    fw = t["sessions"].select("session_id", "agent_framework")
    structural = t["files"].join(fw.where("agent_framework = 'codex'"), "session_id").join(t["tool_calls"].select("session_id", "tool_call_id", "timestamp"), ["session_id", "tool_call_id"]).select("session_id", "path", "tool_call_id", "timestamp", "operation_type")
    scalar = t["tool_calls"].join(fw.where("agent_framework <> 'codex'"), "session_id").select("session_id", named.alias("path"), "tool_call_id", "timestamp", "operation_type").where("path is not null")
    w = Window.partitionBy("session_id", "path")
    both = structural.unionByName(scalar).select("*", F.count(F.lit(1)).over(w).alias("touches"), F.row_number().over(w.orderBy(F.desc("timestamp"), F.desc("tool_call_id"))).alias("r"))
    return both.where("r = 1").drop("r")


def api_calls(t: Tables) -> DataFrame:
    """VRB-06: naive and collapsed output totals per session, and how much the naive one overstates."""
    a = t["turns"].where((F.col("role") == "assistant") & F.col("output_tokens").isNotNull())
    naive = a.groupBy("session_id").agg(F.count(F.lit(1)).alias("records"), F.sum("output_tokens").alias("naive_output"))
    runs = api_call_runs(t).groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("output_tokens").alias("output"))
    comp = compactions(t).groupBy("session_id").agg(F.count(F.lit(1)).alias("compactions"))
    out = naive.join(runs, "session_id").join(comp, "session_id", "left").na.fill(0, ["compactions"])
    return out.withColumn("inflation", F.round(F.col("naive_output") / F.col("output"), 3))


def tool_context(t: Tables) -> DataFrame:
    """MET-03: position of each call in its session and the names of up to five calls before."""
    order = Window.partitionBy("session_id").orderBy("source_ordinal")
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    before = F.collect_list("tool_name").over(order.rowsBetween(-5, -1))
    return t["tool_calls"].select("session_id", "tool_call_id", ((F.row_number().over(order) - 1) / n).alias("position"), F.array_join(before, ",").alias("tools_before"))


def model_switches(t: Tables) -> DataFrame:
    """MET-09 and MET-10: switches, distinct models (null under two), upper median and largest response."""
    w = Window.partitionBy("session_id").orderBy("turn_index")
    a = t["turns"].where("model is not null").withColumn("switch", F.lag("model").over(w) != F.col("model"))
    names = F.count_distinct("model")
    return a.groupBy("session_id").agg(F.when(names >= 2, F.count_if("switch")).alias("model_switches"), F.when(names >= 2, names).alias("unique_models"), S.upper_median("output_tokens").alias("median_response_tokens"), F.max("output_tokens").alias("max_response_tokens"))


def active_time(t: Tables) -> DataFrame:
    """MET-01: active seconds of calls per session with gaps of at most an hour."""
    at = t["tool_calls"].select("session_id", F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ssX").alias("at"))
    return S.active_seconds(at, "session_id", "at", 3600)


def blocks(t: Tables) -> DataFrame:
    """MET-22: turns from one user turn to the next."""
    x = S.number_blocks(t["turns"], "session_id", "turn_index", F.col("role") == "user")
    return x.groupBy("session_id", "block").agg(F.min("turn_index").alias("first_turn"), F.count_if(F.col("role") == "assistant").alias("agent_turns"), F.max("timestamp").alias("last_time"))


def unassociated_calls(t: Tables) -> DataFrame:
    """MET-24: calls that no turn refers to."""
    return t["tool_calls"].select("session_id", "tool_call_id", F.col("emitting_turn_index").alias("turn_index")).join(t["turns"].select("session_id", "turn_index"), ["session_id", "turn_index"], "left_anti")


_RUNS = """a AS (SELECT session_id, turn_index, output_tokens AS o, cache_read_tokens AS r, cache_creation_tokens AS c FROM turns WHERE role = 'assistant' AND output_tokens IS NOT NULL),
 b AS (SELECT *, CASE WHEN lag(o) OVER w = o AND lag(r) OVER w IS NOT DISTINCT FROM r AND lag(c) OVER w IS NOT DISTINCT FROM c AND turn_index - lag(turn_index) OVER w <= 3 THEN 0 ELSE 1 END AS f FROM a WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)),
 i AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY turn_index) AS run FROM b),
 calls AS (SELECT session_id, run, min(turn_index) AS first_turn, max(o) AS o, max(r) AS r FROM i GROUP BY session_id, run),
 comp AS (SELECT * FROM (SELECT *, lag(r) OVER (PARTITION BY session_id ORDER BY first_turn) AS p FROM calls) x WHERE p > 100000 AND r < p * 0.2)"""
VERBS: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {
    "vrb_01": (session_activity, "SELECT s.session_id, title, agent_framework, working_directory, started_at, last_activity FROM sessions s LEFT JOIN (SELECT session_id, max(\"timestamp\") AS last_activity FROM (SELECT session_id, \"timestamp\" FROM turns UNION ALL SELECT session_id, \"timestamp\" FROM tool_calls) x GROUP BY 1) l ON l.session_id = s.session_id"),
    "vrb_02": (file_activity, "SELECT session_id, path, tool_call_id, \"timestamp\", operation_type, touches FROM (SELECT c.session_id, file_path AS path, tool_call_id, \"timestamp\", operation_type, count(*) OVER (PARTITION BY c.session_id, file_path) AS touches, row_number() OVER (PARTITION BY c.session_id, file_path ORDER BY \"timestamp\" DESC, tool_call_id DESC) AS r FROM tool_calls c JOIN sessions s ON s.session_id = c.session_id WHERE file_path IS NOT NULL) x WHERE r = 1"),
    "vrb_06": (api_calls, f"""WITH {_RUNS}, n AS (SELECT session_id, count(*) AS records, CAST(sum(o) AS BIGINT) AS naive_output FROM a GROUP BY 1), d AS (SELECT session_id, count(*) AS calls, CAST(sum(o) AS BIGINT) AS output FROM calls GROUP BY 1), q AS (SELECT session_id, count(*) AS compactions FROM comp GROUP BY 1)
      SELECT n.session_id, records, naive_output, calls, output, coalesce(compactions, 0) AS compactions, round(naive_output / output, 3) AS inflation FROM n JOIN d USING (session_id) LEFT JOIN q USING (session_id)"""),
    "met_01": (active_time, "SELECT session_id, CASE WHEN count(*) >= 2 THEN CAST(coalesce(sum(gap) FILTER (WHERE gap <= 3600000000), 0) AS BIGINT) / 1000000 END AS active_seconds FROM (SELECT session_id, epoch_us(strptime(\"timestamp\", '%Y-%m-%dT%H:%M:%SZ')) - lag(epoch_us(strptime(\"timestamp\", '%Y-%m-%dT%H:%M:%SZ'))) OVER (PARTITION BY session_id ORDER BY \"timestamp\") AS gap FROM tool_calls) x GROUP BY 1"),
    "met_03": (tool_context, "SELECT session_id, tool_call_id, source_ordinal / count(*) OVER (PARTITION BY session_id) AS position, coalesce(array_to_string(list(tool_name) OVER (PARTITION BY session_id ORDER BY source_ordinal ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ','), '') AS tools_before FROM tool_calls"),
    "met_09": (model_switches, "SELECT session_id, CASE WHEN count(DISTINCT model) >= 2 THEN count(*) FILTER (WHERE prev <> model) END AS model_switches, CASE WHEN count(DISTINCT model) >= 2 THEN count(DISTINCT model) END AS unique_models, list_sort(list(output_tokens))[count(*) // 2 + 1] AS median_response_tokens, max(output_tokens) AS max_response_tokens FROM (SELECT *, lag(model) OVER (PARTITION BY session_id ORDER BY turn_index) AS prev FROM turns WHERE model IS NOT NULL) x GROUP BY 1"),
    "met_22": (blocks, "SELECT session_id, CAST(block AS BIGINT) AS block, min(turn_index) AS first_turn, count(*) FILTER (WHERE role = 'assistant') AS agent_turns, max(\"timestamp\") AS last_time FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_index) AS block FROM turns) x GROUP BY 1, 2"),
    "met_24": (unassociated_calls, "SELECT session_id, tool_call_id, emitting_turn_index AS turn_index FROM tool_calls c WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.session_id = c.session_id AND t.turn_index = c.emitting_turn_index)"),
    "sql_29": (lambda t: sessions_base(t["sessions"]), "SELECT session_id AS id, title, summary, classification, profile, " + ", ".join(f"json_extract_string(raw_json, '$.{n}') AS {n}" for n in ("provenance", "flags", "environment", "operational_context", "timing", "turns", "tool_calls", "annotations", "metrics")) + " FROM sessions"),
} | {key: (fn, SQL[key]) for key, fn in HISTORY.items()}


def oracle(key: str) -> str:
    return f"WITH {ORACLE_TABLES}, answer AS ({VERBS[key][1]}) SELECT * FROM answer"
