"""The driver's tables seen as the ten normalized tables, for Spark and as SQL.

`events` become tool calls of a session per user, `conversations` turns, `labels`
annotations, `benchmark` attachments.  Derived values are simple integer rules, so
two engines can agree on every row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.schema import TABLES, conform
from loomspark.sources.cache import StoredTables, fingerprint

_TOOLS = {"view": ("Read", "READ"), "click": ("Bash", "EXECUTE"), "purchase": ("Edit", "MODIFY"), "signup": ("Write", "NEW"), "error": ("Task", "OTHER")}


#: Expressions that Spark and the SQL oracle share: what the calls of made-up sessions say, so that every rule of the analyses finds something.
_TOOL = """CASE WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'Bash' WHEN event_type = 'error' AND event_id % 3 = 2 THEN 'exec' WHEN event_type = 'view' AND k % 9 = 0 THEN 'Skill' ELSE CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _TOOLS.items()) + " END END"
_OPERATION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _TOOLS.items()) + " END"
_FILE = """CASE WHEN event_type = 'view' AND k % 8 = 3 THEN '/home/dev/skills/k' || k || '/SKILL.md' WHEN event_type = 'view' AND k % 8 = 4 THEN '/home/dev/repo/pkg/doc/k' || k || '.md'
  WHEN event_type = 'view' AND k % 8 = 5 THEN '/home/dev/repo/ttmp/TK-' || (k % 10) || '/tasks.md' WHEN event_type = 'purchase' AND k % 8 = 5 THEN '/home/dev/repo/ttmp/TK-' || (k % 10) || '/diary/k' || k || '.md' WHEN event_type = 'purchase' AND k % 8 = 6 THEN '/home/dev/repo/ttmp/TK-' || (k % 10) || '/changelog.md'
  WHEN event_type IN ('view', 'purchase', 'signup') THEN '/home/dev/repo/k' || k || '.md' END"""
_COMMAND = """CASE WHEN event_type = 'click' THEN CASE k % 12 WHEN 0 THEN 'git commit -m k' || k WHEN 1 THEN 'cd /tmp/k' || k || ' && ls' WHEN 2 THEN 'make test' WHEN 3 THEN 'cat k' || k || ' > out.txt' WHEN 4 THEN 'docmgr ticket create --ticket TK-' || (k % 10)
  WHEN 5 THEN CASE k % 5 WHEN 0 THEN 'docmgr task add' WHEN 1 THEN 'docmgr changelog update' WHEN 2 THEN 'docmgr doc add' WHEN 3 THEN 'docmgr doc relate' ELSE 'docmgr ticket close' END || ' --ticket TK-' || (k % 10)
  WHEN 6 THEN 'grep -rn "Sym' || (k % 7) || chr(92) || '|New' || (k % 3) || '" ../lib' || (k % 2) || '/src' WHEN 7 THEN 'sed -n ' || chr(39) || '1,40p' || chr(39) || ' ../lib' || (k % 2) || '/main.go' WHEN 8 THEN 'bin/tool' || (k % 3) || ' help topic-' || k
  WHEN 9 THEN 'cat ~/.claude/skills/s' || (k % 4) || '/SKILL.md' WHEN 10 THEN 'rg "Find' || (k % 5) || '" /go/pkg/mod/github.com/a/b' || (k % 2) || '@v1/x.go' ELSE 'cat pkg/doc/topics/t' || k || '.md' END
  WHEN event_type = 'error' AND event_id % 3 = 1 AND k % 10 = 0 THEN 'pkill -f "work' || k || '" ; work' || k WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'cd /srv/k' || k END"""
_ARGUMENTS = """CASE WHEN event_type = 'purchase' AND k % 6 = 0 THEN '{"patch":"*** Begin Patch' || chr(92) || 'n*** Update File: pkg/k' || k || '.go' || chr(92) || 'n*** Add File: docs/k' || k || '.md' || chr(92) || 'n"}' WHEN event_type = 'signup' AND k % 6 = 1 THEN '{"file_path":"/home/dev/other/k' || k || '.txt"}'
  WHEN event_type = 'view' AND k % 9 = 0 THEN '{"skill":"s' || (k % 4) || '"}' WHEN event_type = 'error' AND event_id % 3 = 2 THEN '{"cmd":"cat docs/k' || k || '.md > /tmp/out' || k || '.txt"}' ELSE props END"""
_ERROR = """CASE WHEN event_type = 'error' THEN CASE k % 11 WHEN 1 THEN '(eval):1: == not found' WHEN 2 THEN 'File has not been read yet' WHEN 3 THEN 'illegal character NUL' WHEN 4 THEN 'cat: docs/k' || k || ': No such file or directory' WHEN 5 THEN 'sed: can' || chr(39) || 't read docs/k' || k || '.md: No such file'
  WHEN 6 THEN 'command timed out' WHEN 7 THEN '--- FAIL: Test' || k WHEN 8 THEN './a.go:12:3: undefined: x' WHEN 9 THEN 'stopped' ELSE 'exit status ' || k END END"""
_RESULT = """CASE WHEN event_type = 'signup' THEN 'File created: k' || k WHEN event_type = 'purchase' THEN 'k' || k || ' has been updated' WHEN event_type = 'error' THEN CASE WHEN k % 11 = 9 THEN repeat('row k' || k || ' ', 40) END ELSE 'ok k' || k END"""
_TURN = "CASE WHEN user_id % 2 = 0 THEN source_ordinal % 8 ELSE source_ordinal % 97 END"
_RECORD = "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'orchestration' WHEN event_type = 'click' AND k % 2 = 0 THEN 'execution' WHEN event_type = 'purchase' AND k % 4 = 0 THEN 'file_change' ELSE 'tool_call' END"
_CALL_META = """CASE WHEN event_type = 'click' THEN '{"source":"agent","parsed_cmd":"c' || k || '","stdout":"ok","stderr":""}' WHEN event_type = 'purchase' THEN '{"first_changed_line":' || k || ',"diff":"-a+b' || k || '"}' ELSE props END"""
_TURN_META = """CASE WHEN (conv_id + turn) % 2 = 0 THEN '{"entrypoint":"cli","slug":"x' || conv_id || '","parent_uuid":"u' || turn || '","is_sidechain":false,"stop_reason":"end","cache_creation":{"short":' || turn || '}}' END"""
_EXIT = "CASE WHEN event_type = 'click' THEN k % 3 WHEN event_type = 'error' THEN CASE WHEN k % 10 = 0 THEN 144 ELSE 1 END END"
_CONTENT = "CASE WHEN role = 'user' AND (conv_id + turn) % 17 = 3 THEN 'This session is being continued from before. ' || text WHEN role = 'user' AND (conv_id + turn) % 19 = 4 THEN '<note> ' || text ELSE text END"


ACTIVITY = ("tool_call_record_count", "orchestration_count", "execution_record_count", "file_change_count", "model_invocation_count", "file_touch_count", "confirmed_file_target_count")


def _iso(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def tool_calls(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    e = events.select("*", k.alias("k"), (F.row_number().over(order) - 1).cast("long").alias("source_ordinal"), F.expr(_OPERATION).alias("operation_type")).withColumn("tool_name", F.expr(_TOOL))
    runs = F.col("operation_type") == "EXECUTE"
    failed = F.col("event_type") == "error"
    spawned = failed & (F.col("event_id") % 3 == 0)
    name = F.concat(F.lit("k"), F.col("k").cast("string"))
    return e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("tool_call_id"),
        "source_ordinal",
        F.expr(_TURN).alias("emitting_turn_index"),
        _iso(F.col("ts")).alias("timestamp"),
        "tool_name",
        "operation_type",
        F.expr(_FILE).alias("file_path"),
        F.expr(_RECORD).alias("record_kind"),
        F.expr(_COMMAND).alias("command"),
        F.when(runs & (F.col("k") % 5 == 0), F.concat(F.lit("needed for "), name)).alias("justification"),
        F.expr(_ARGUMENTS).alias("arguments_json"),
        F.when(failed, 0).when(F.col("event_type") != "signup", 1).cast("long").alias("success"),
        F.when(failed, "failed").when(F.col("event_type") == "signup", "unknown").otherwise("succeeded").alias("outcome_status"),
        F.expr(_RESULT).alias("result"),
        F.expr(_ERROR).alias("error"),
        F.expr(_EXIT).cast("long").alias("exit_code"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("duration_ms"),
        F.when(F.col("k") % 7 == 0, 1).otherwise(0).cast("long").alias("truncated"),
        F.when(F.col("k") % 7 == 0, F.col("k") * 1000).alias("full_bytes"),
        F.expr(_CALL_META).alias("framework_metadata_json"),
        F.when(spawned, "explorer").alias("spawned_agent_type"),
        F.when(spawned, F.concat(F.lit("s"), (F.col("user_id") + 1).cast("string"))).alias("spawned_agent_sub_session_id"),
    )


def turns(conversations: DataFrame) -> DataFrame:
    at = F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60 * (1 + (F.col("conv_id") * F.col("turn")) % 13)
    assistant = F.col("role") == "assistant"
    mod = lambda c, n: F.when(assistant, c % n).cast("long")
    return conversations.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("turn").alias("turn_index"),
        _iso(F.timestamp_seconds(at)).alias("timestamp"),
        "role",
        F.when((F.col("role") == "user") & (F.col("turn") % 3 != 2), "human").otherwise("framework").alias("source"),
        F.when(assistant, F.concat(F.lit("model-"), ((F.col("conv_id") + F.col("turn")) % 3).cast("string"))).alias("model"),
        F.expr(_CONTENT).alias("content"),
        F.expr(_TURN_META).alias("framework_metadata_json"),
        F.when(F.col("role") == "user", F.length("text")).cast("long").alias("input_tokens"),
        F.when(assistant, F.length("text")).cast("long").alias("output_tokens"),
        mod(F.col("conv_id") * 7919 + F.col("turn") * 104729, 200000).alias("cache_read_tokens"),
        mod(F.col("conv_id") * F.col("turn"), 500).alias("cache_creation_tokens"),
    )


def annotations(labels: DataFrame) -> DataFrame:
    n = F.col("doc_id")
    return labels.select(
        F.concat(F.lit("s"), (n % 150).cast("string")).alias("session_id"),
        F.concat(F.lit("a"), n.cast("string")).alias("annotation_id"),
        F.when(n % 2 == 0, "reviewer").otherwise("tool").alias("annotator"),
        F.when(n % 5 == 0, "tool_call").otherwise("session").alias("scope_type"),
        F.when(n % 5 == 0, F.concat(F.lit("c"), n.cast("string"))).otherwise(F.concat(F.lit("s"), (n % 150).cast("string"))).alias("target_id"),
        F.when(F.col("toxic") == 1, "ai-failure").when(F.col("quality") == 1, "success").otherwise("observation").alias("category"),
        F.when(n % 3 == 0, '["F1","F2"]').when(n % 3 == 1, '["F3"]').alias("minitrace_taxonomy_json"),
        F.lit('["seen"]').alias("tags_json"),
        F.concat(F.lit("note "), n.cast("string")).alias("title"),
        F.lit("").alias("detail"),
        F.when(n % 4 == 0, "public").otherwise("internal").alias("classification"),
    )


def files(calls: DataFrame) -> DataFrame:
    touched = calls.where("file_path is not null")
    return touched.select(
        "session_id", "tool_call_id", F.col("file_path").alias("path"), "operation_type", "tool_name", "success", F.col("emitting_turn_index").alias("turn_index"),
        F.lit(0).cast("long").alias("target_ordinal"), F.lit("structured").alias("evidence_kind"), F.when(F.col("success") == 1, "confirmed").otherwise("attempted").alias("evidence_status"),
        F.lit("/home/dev/repo").alias("cwd"), F.lit(1).cast("long").alias("resolved"),
    )


def metrics(calls: DataFrame, turns_: DataFrame) -> DataFrame:
    n = lambda op: F.count_if((F.col("operation_type") == op) & (F.col("record_kind") != "orchestration")).alias(f"{op}")
    kinds = lambda kind, name: F.count_if(F.col("record_kind") == kind).alias(name)
    c = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tool_call_count"), n("READ"), n("MODIFY"), n("NEW"), n("EXECUTE"), F.count("spawned_agent_type").alias("subagent_count"),
        kinds("orchestration", "orchestration_count"), kinds("execution", "execution_record_count"), kinds("file_change", "file_change_count"), kinds("tool_call", "tool_call_record_count"), kinds("tool_call", "model_invocation_count"),
        F.count("file_path").alias("file_touch_count"), F.count_if(F.col("file_path").isNotNull() & (F.col("success") == 1)).alias("confirmed_file_target_count"),
    )
    t = turns_.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turn_count"), F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"), F.sum("cache_read_tokens").alias("total_cache_read_tokens"),
        F.sum("cache_creation_tokens").alias("total_cache_creation_tokens"), F.max("output_tokens").alias("max_response_tokens"), F.when(F.count_distinct("model") >= 2, F.count_distinct("model")).alias("unique_models"),
    )
    return c.join(t, "session_id", "left").select(
        "session_id", F.coalesce("turn_count", F.lit(0)).alias("turn_count"), "tool_call_count", F.col("READ").alias("read_count"), F.col("MODIFY").alias("modify_count"), F.col("NEW").alias("create_count"), F.col("EXECUTE").alias("execute_count"),
        (F.floor(F.col("READ") * 1000 / F.col("tool_call_count")) / 1000).alias("read_ratio"), "subagent_count", *ACTIVITY,
        "total_input_tokens", "total_output_tokens", "total_cache_read_tokens", "total_cache_creation_tokens", "max_response_tokens", "unique_models",
    )


def sessions(events: DataFrame, metrics_: DataFrame) -> DataFrame:
    u = F.col("user_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("timestamp"))
    e = events.select("user_id", "ts", F.when(gap <= 3600 * 1000000, gap).alias("gap")).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.coalesce(F.sum("gap"), F.lit(0)).alias("active"))
    frameworks = F.element_at(F.array(*[F.lit(x) for x in ("claude-code", "codex", "pi", "copilot")]), (u % 4 + 1).cast("int"))
    s = lambda c: c.cast("string")
    base = e.select(
        F.concat(F.lit("s"), s(u)).alias("session_id"), F.lit("full").alias("profile"), F.concat(F.lit("Session "), s(u)).alias("title"), F.when(u % 5 == 0, "public").otherwise("internal").alias("classification"),
        F.concat(frameworks, F.lit("-jsonl")).alias("source_format"), frameworks.alias("agent_framework"), F.concat(F.lit("model-"), s(u % 3)).alias("model"), F.when(u % 2 == 0, "north").otherwise("south").alias("provider_hint"),
        F.concat(F.lit("/home/dev/p"), s(u % 7)).alias("working_directory"), _iso(F.col("a")).alias("started_at"), _iso(F.col("b")).alias("ended_at"),
        F.floor((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1000000).cast("double").alias("duration_seconds"), F.floor(F.col("active") / 1000000).cast("double").alias("active_duration_seconds"),
        F.hour("a").cast("long").alias("hour_of_day"), F.weekday("a").cast("long").alias("day_of_week"), (u % 3 != 0).cast("long").alias("for_research"), (u % 11 == 0).cast("long").alias("contains_pii"),
        F.when(u % 6 == 0, F.concat(F.lit("s"), s(u + 1))).alias("predecessor_session"), F.lit("workspace").alias("permission_level"), F.when(u % 4 == 1, F.concat(F.lit("You are helper "), s(u % 3))).alias("system_prompt"),
    )
    m = metrics_.select("session_id", "turn_count", "tool_call_count", "read_count", "modify_count", "create_count", "execute_count", *ACTIVITY)
    quality = F.when((F.col("turn_count") > 5) & (F.col("tool_call_count") > 10), "A").when(F.col("turn_count") > 0, "B").otherwise("C")
    raw = F.concat(F.lit('{"timing":{"started_at":"'), "started_at", F.lit('"},"flags":{"contains_pii":'), F.col("contains_pii").cast("string"), F.lit('},"metrics":{"turn_count":'), F.col("turn_count").cast("string"), F.lit("}}"))
    return base.join(m, "session_id").withColumn("quality", quality).withColumn("raw_json", raw)


def handovers(sessions_: DataFrame) -> DataFrame:
    return sessions_.where("predecessor_session is not null").select("session_id", F.lit("received").alias("direction"), F.col("predecessor_session").alias("from_session"), F.col("session_id").alias("to_session"), F.concat(F.lit("notes of "), F.col("title")).alias("document"))


def event_rows(turns_: DataFrame, calls: DataFrame, notes: DataFrame) -> DataFrame:
    t = turns_.select("session_id", F.format_string("turn-%06d", "turn_index").alias("event_id"), "turn_index", F.lit("turn").alias("kind"), "role", F.lit(None).cast("string").alias("tool_call_id"), F.substring("content", 1, 40).alias("summary"))
    c = calls.select("session_id", F.concat(F.lit("tool-"), F.col("tool_call_id")).alias("event_id"), F.col("emitting_turn_index").alias("turn_index"), F.lit("tool_call").alias("kind"), F.lit(None).cast("string").alias("role"), "tool_call_id", F.col("tool_name").alias("summary"))
    a = notes.select("session_id", F.concat(F.lit("annotation-"), F.col("annotation_id")).alias("event_id"), F.lit(None).cast("long").alias("turn_index"), F.lit("annotation").alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("tool_call_id"), F.col("title").alias("summary"))
    return t.unionByName(c).unionByName(a)


def _made(name: str, t: Mapping[str, DataFrame], read) -> DataFrame:
    if name == "tool_calls":
        return tool_calls(read("events"))
    if name == "turns":
        return turns(read("conversations"))
    if name == "annotations":
        return annotations(read("labels"))
    if name == "metrics":
        return metrics(t["tool_calls"], t["turns"])
    if name == "sessions":
        return sessions(read("events"), t["metrics"])
    if name == "files":
        return files(t["tool_calls"])
    if name == "handovers":
        return handovers(t["sessions"])
    if name == "events":
        return event_rows(t["turns"], t["tool_calls"], t["annotations"])
    if name == "turn_tool_calls":
        at = F.row_number().over(Window.partitionBy("session_id", "emitting_turn_index").orderBy("source_ordinal")) - 1
        return t["tool_calls"].select("session_id", F.col("emitting_turn_index").alias("turn_index"), "tool_call_id", at.cast("long").alias("ordinal"))
    item = F.col("item_id").cast("string")
    session = F.concat(F.lit("s"), (F.col("item_id") % 150).cast("string"))
    return read("benchmark").select(session.alias("session_id"), F.concat(F.lit("t"), item).alias("attachment_id"), F.lit("text").alias("kind"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").alias("text_preview"))


_PROJECTED: dict[tuple[str, str], tuple[str, StoredTables]] = {}


def project(spark: SparkSession, sf_dir: str) -> StoredTables:
    """The ten tables with their full schemas, each written once for an application and state of a folder, when it is first read.

    Files that change, come or go below the folder make another state: its tables are made anew.
    """
    key, state = (spark.sparkContext.applicationId, sf_dir), fingerprint(spark, sf_dir)
    if key not in _PROJECTED or _PROJECTED[key][0] != state or _PROJECTED[key][1].spark is not spark:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        _PROJECTED[key] = state, StoredTables(spark, f"{sf_dir}\0{state}", TABLES, lambda name, t: conform(_made(name, t, read), name))
    return _PROJECTED[key][1]


#: The same projection for the SQL oracle; `{{events}}` of queries is session_events there.
ORACLE_TABLES = f"""
tc0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS source_ordinal, {_OPERATION} AS operation_type FROM events),
tool_calls AS (SELECT 's' || user_id AS session_id, 'c' || event_id AS tool_call_id, source_ordinal, {_TURN} AS emitting_turn_index, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", {_TOOL} AS tool_name, operation_type,
  {_FILE} AS file_path, {_RECORD} AS record_kind,
  {_COMMAND} AS command,
  CASE WHEN operation_type = 'EXECUTE' AND k % 5 = 0 THEN 'needed for k' || k END AS justification, {_ARGUMENTS} AS arguments_json,
  CAST(CASE WHEN event_type = 'error' THEN 0 WHEN event_type <> 'signup' THEN 1 END AS BIGINT) AS success, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'unknown' ELSE 'succeeded' END AS outcome_status,
  {_RESULT} AS result, {_ERROR} AS error, CAST({_EXIT} AS BIGINT) AS exit_code,
  CAST(floor(value * 100 + 0.5::DOUBLE) AS BIGINT) AS duration_ms, CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS truncated, CASE WHEN k % 7 = 0 THEN k * 1000 END AS full_bytes, {_CALL_META} AS framework_metadata_json, CAST(NULL AS VARCHAR) AS output_status, CAST(NULL AS VARCHAR) AS full_hash, CAST(NULL AS VARCHAR) AS full_reference, CAST(NULL AS VARCHAR) AS raw_json,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'explorer' END AS spawned_agent_type, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 's' || (user_id + 1) END AS spawned_agent_sub_session_id, CAST(NULL AS VARCHAR) AS spawned_agent_task_scope, CAST(NULL AS VARCHAR) AS spawned_agent_outcome_summary, CAST(NULL AS DOUBLE) AS position_in_session FROM tc0),
turns AS (SELECT 's' || conv_id AS session_id, turn AS turn_index, strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60 * (1 + (conv_id * turn) % 13)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", role,
  CASE WHEN role = 'user' AND turn % 3 <> 2 THEN 'human' ELSE 'framework' END AS source, CASE WHEN role = 'assistant' THEN 'model-' || ((conv_id + turn) % 3) END AS model, {_CONTENT} AS content, CAST(NULL AS VARCHAR) AS content_type, {_TURN_META} AS framework_metadata_json, CAST(NULL AS VARCHAR) AS thinking, CAST(NULL AS BIGINT) AS reasoning_tokens, CAST(NULL AS BIGINT) AS tool_tokens, CAST(NULL AS VARCHAR) AS raw_json,
  CASE WHEN role = 'user' THEN length(text) END AS input_tokens, CASE WHEN role = 'assistant' THEN length(text) END AS output_tokens,
  CASE WHEN role = 'assistant' THEN (conv_id * 7919 + turn * 104729) % 200000 END AS cache_read_tokens, CASE WHEN role = 'assistant' THEN (conv_id * turn) % 500 END AS cache_creation_tokens FROM conversations),
annotations AS (SELECT 's' || (doc_id % 150) AS session_id, 'a' || doc_id AS annotation_id, CASE WHEN doc_id % 2 = 0 THEN 'reviewer' ELSE 'tool' END AS annotator, CASE WHEN doc_id % 5 = 0 THEN 'tool_call' ELSE 'session' END AS scope_type,
  CASE WHEN doc_id % 5 = 0 THEN 'c' || doc_id ELSE 's' || (doc_id % 150) END AS target_id, CASE WHEN toxic = 1 THEN 'ai-failure' WHEN quality = 1 THEN 'success' ELSE 'observation' END AS category,
  CASE doc_id % 3 WHEN 0 THEN '["F1","F2"]' WHEN 1 THEN '["F3"]' END AS minitrace_taxonomy_json, '["seen"]' AS tags_json, 'note ' || doc_id AS title, '' AS detail, CASE WHEN doc_id % 4 = 0 THEN 'public' ELSE 'internal' END AS classification,
  CAST(NULL AS VARCHAR) AS "timestamp", CAST(NULL AS VARCHAR) AS mast_taxonomy_json, CAST(NULL AS VARCHAR) AS toolemu_taxonomy_json FROM labels),
files AS (SELECT session_id, tool_call_id, file_path AS path, operation_type, tool_name, success, emitting_turn_index AS turn_index, CAST(0 AS BIGINT) AS target_ordinal, 'structured' AS evidence_kind,
  CASE WHEN success = 1 THEN 'confirmed' ELSE 'attempted' END AS evidence_status, '/home/dev/repo' AS cwd, CAST(1 AS BIGINT) AS resolved FROM tool_calls WHERE file_path IS NOT NULL),
m0 AS (SELECT session_id, count(*) AS tool_call_count, count(*) FILTER (WHERE operation_type = 'READ' AND record_kind <> 'orchestration') AS read_count, count(*) FILTER (WHERE operation_type = 'MODIFY' AND record_kind <> 'orchestration') AS modify_count,
  count(*) FILTER (WHERE operation_type = 'NEW' AND record_kind <> 'orchestration') AS create_count, count(*) FILTER (WHERE operation_type = 'EXECUTE' AND record_kind <> 'orchestration') AS execute_count, count(spawned_agent_type) AS subagent_count,
  count(*) FILTER (WHERE record_kind = 'orchestration') AS orchestration_count, count(*) FILTER (WHERE record_kind = 'execution') AS execution_record_count, count(*) FILTER (WHERE record_kind = 'file_change') AS file_change_count,
  count(*) FILTER (WHERE record_kind = 'tool_call') AS tool_call_record_count, count(*) FILTER (WHERE record_kind = 'tool_call') AS model_invocation_count, count(file_path) AS file_touch_count, count(*) FILTER (WHERE file_path IS NOT NULL AND success = 1) AS confirmed_file_target_count FROM tool_calls GROUP BY session_id),
m1 AS (SELECT session_id, count(*) AS turn_count, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS total_cache_read_tokens,
  CAST(sum(cache_creation_tokens) AS BIGINT) AS total_cache_creation_tokens, max(output_tokens) AS max_response_tokens, CASE WHEN count(DISTINCT model) >= 2 THEN count(DISTINCT model) END AS unique_models FROM turns GROUP BY session_id),
metrics AS (SELECT m0.session_id, coalesce(turn_count, 0) AS turn_count, tool_call_count, read_count, modify_count, create_count, execute_count, CAST(floor(read_count * 1000 / CAST(tool_call_count AS DOUBLE)) AS DOUBLE) / 1000 AS read_ratio, subagent_count, {', '.join(ACTIVITY)},
  total_input_tokens, total_output_tokens, total_cache_read_tokens, total_cache_creation_tokens, max_response_tokens, unique_models, CAST(NULL AS DOUBLE) AS idle_ratio, CAST(NULL AS DOUBLE) AS time_to_first_action, CAST(NULL AS BIGINT) AS delegate_count, CAST(NULL AS DOUBLE) AS session_cost, CAST(NULL AS BIGINT) AS total_tool_tokens FROM m0 LEFT JOIN m1 ON m0.session_id = m1.session_id),
g0 AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
g1 AS (SELECT user_id, min(ts) AS a, max(ts) AS b, coalesce(sum(gap) FILTER (WHERE gap <= 3600000000), 0) AS active FROM g0 GROUP BY user_id),
sessions AS (SELECT 's' || user_id AS session_id, 'full' AS profile, 'Session ' || user_id AS title, CASE WHEN user_id % 5 = 0 THEN 'public' ELSE 'internal' END AS classification,
  (['claude-code', 'codex', 'pi', 'copilot'])[user_id % 4 + 1] AS agent_framework, (['claude-code', 'codex', 'pi', 'copilot'])[user_id % 4 + 1] || '-jsonl' AS source_format, 'model-' || (user_id % 3) AS model,
  CASE WHEN user_id % 2 = 0 THEN 'north' ELSE 'south' END AS provider_hint, '/home/dev/p' || (user_id % 7) AS working_directory, strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(b, '%Y-%m-%dT%H:%M:%SZ') AS ended_at,
  CAST((epoch_us(b) - epoch_us(a)) // 1000000 AS DOUBLE) AS duration_seconds, CAST(CAST(active AS BIGINT) // 1000000 AS DOUBLE) AS active_duration_seconds, CAST(hour(a) AS BIGINT) AS hour_of_day, CAST(isodow(a) - 1 AS BIGINT) AS day_of_week,
  CAST(user_id % 3 <> 0 AS BIGINT) AS for_research, CAST(user_id % 11 = 0 AS BIGINT) AS contains_pii, CASE WHEN user_id % 6 = 0 THEN 's' || (user_id + 1) END AS predecessor_session, 'workspace' AS permission_level,
  CASE WHEN user_id % 4 = 1 THEN 'You are helper ' || (user_id % 3) END AS system_prompt, m.turn_count, m.tool_call_count, m.read_count, m.modify_count, m.create_count, m.execute_count, {', '.join('m.' + x for x in ACTIVITY)},
  CASE WHEN m.turn_count > 5 AND m.tool_call_count > 10 THEN 'A' WHEN m.turn_count > 0 THEN 'B' ELSE 'C' END AS quality, CAST(NULL AS VARCHAR) AS model_version, CAST(NULL AS VARCHAR) AS git_branch, CAST(NULL AS VARCHAR) AS autonomy_level, CAST(NULL AS BIGINT) AS sandbox, CAST(NULL AS VARCHAR) AS human_attention, CAST(NULL AS VARCHAR) AS agent_version, CAST(NULL AS VARCHAR) AS summary,
  '{{"timing":{{"started_at":"' || strftime(a, '%Y-%m-%dT%H:%M:%SZ') || '"}},"flags":{{"contains_pii":' || CAST(user_id % 11 = 0 AS BIGINT) || '}},"metrics":{{"turn_count":' || m.turn_count || '}}}}' AS raw_json
  FROM g1 JOIN metrics m ON m.session_id = 's' || user_id),
handovers AS (SELECT session_id, 'received' AS direction, predecessor_session AS from_session, session_id AS to_session, 'notes of ' || title AS document, CAST(NULL AS VARCHAR) AS state_description FROM sessions WHERE predecessor_session IS NOT NULL),
turn_tool_calls AS (SELECT session_id, emitting_turn_index AS turn_index, tool_call_id, row_number() OVER (PARTITION BY session_id, emitting_turn_index ORDER BY source_ordinal) - 1 AS ordinal FROM tool_calls),
attachments AS (SELECT 's' || (item_id % 150) AS session_id, 't' || item_id AS attachment_id, 'text' AS kind, CAST(strlen(text) AS BIGINT) AS size_bytes, text AS text_preview FROM benchmark),
session_events AS (SELECT session_id, 'turn-' || lpad(CAST(turn_index AS VARCHAR), 6, '0') AS event_id, turn_index, 'turn' AS kind, role, CAST(NULL AS VARCHAR) AS tool_call_id, substr(content, 1, 40) AS summary FROM turns
  UNION ALL SELECT session_id, 'tool-' || tool_call_id, emitting_turn_index, 'tool_call', NULL, tool_call_id, tool_name FROM tool_calls
  UNION ALL SELECT session_id, 'annotation-' || annotation_id, NULL, 'annotation', NULL, NULL, title FROM annotations)
""".strip()
