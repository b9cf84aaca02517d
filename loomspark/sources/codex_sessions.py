"""codex logs as sessions: the evidence of sources.codex put together to the tables.

Mirrored messages are one turn, native executions enrich the call that they name or stand for themselves, end
records are reconciled, file changes are records of their own, and file targets come with their kind of evidence.  What no
exit code tells stays unknown: such a call has no success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.metrics import call_metrics, home_to_tilde, idle_ratio, names_home, quality, timing, turn_metrics
from loomspark.operators.sequence import as_of, keep_first, truncated_ratio
from loomspark.schema import conform
from loomspark.sources import codex
from loomspark.sources.cache import stored

# Approval policies by autonomy.
AUTONOMY = {"never": "full-auto", "on-failure": "auto-edit", "on-request": "suggest", "untrusted": "suggest"}
SHELLS = ("exec_command", "shell", "local_shell", "exec")
ID_CHARS, TITLE_CHARS = 8, 80


def _j(path: str, c: str = "value") -> Column:
    return F.get_json_object(c, path)


def _some(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def _turns(lines: DataFrame) -> DataFrame:
    """Messages with their index, the model of their time, the thoughts before them and the usage told after them."""
    kind, inner = _j("$.type"), _j("$.payload.type")
    said = stored(codex.messages(lines), "messages")
    index = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    said = said.withColumn("turn_index", index.cast("long"))
    models = lines.where(kind == "turn_context").select("path", "line_no", _some(_j("$.payload.model")).alias("model")).where("model is not null")
    said = as_of(said, models, "path", "line_no", "line_no", ["model"])
    summaries = F.array_join(F.filter(F.transform(F.from_json(_j("$.payload.summary"), "array<struct<text:string>>"), lambda s: s["text"]), lambda t: t != ""), "\n")
    thought = F.when((kind == "event_msg") & (inner == "agent_reasoning"), _j("$.payload.text")).when((kind == "response_item") & (inner == "reasoning"), summaries)
    thoughts = lines.select("path", "line_no", thought.alias("thought")).where("thought <> ''")
    spoken = said.where("role = 'assistant'").select("path", "line_no", F.col("line_no").alias("spoken"))
    ahead = Window.partitionBy("path").orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    both = thoughts.unionByName(spoken, allowMissingColumns=True).withColumn("next", F.min("spoken").over(ahead)).where("thought is not null and next is not null")
    thinking = both.groupBy("path", F.col("next").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "thought"))), lambda x: x["thought"]), "\n").alias("thinking"))
    names = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cached_input_tokens", "reasoning_tokens": "reasoning_output_tokens"}
    usage = lines.where((kind == "event_msg") & (inner == "token_count") & _j("$.payload.info.last_token_usage").isNotNull()).select("path", F.col("line_no").alias("told"), *[F.nullif(_j(f"$.payload.info.last_token_usage.{p}").try_cast("long"), F.lit(0)).alias(n) for n, p in names.items()])
    told = as_of(usage, said.select("path", F.col("line_no").alias("of"), F.col("role").alias("of_role")), "path", "told", "of", ["of", "of_role"])
    last = told.where("of_role = 'assistant'").groupBy("path", F.col("of").alias("line_no")).agg(*[F.max_by(n, "told").alias(n) for n in names])
    out = said.join(thinking, ["path", "line_no"], "left").join(last, ["path", "line_no"], "left")
    role = F.col("role")
    meta = F.to_json(F.struct(F.col("message_id"), F.col("turn_id").alias("native_turn_id"), F.col("representations"), F.when(F.col("conflict"), True).alias("conflicting_content")))
    source, channel = F.when(role == "user", "human").when(role == "assistant", "model").otherwise("framework"), F.when(role == "user", "user_input").when(role == "system", "system_prompt")
    return out.select("path", "line_no", "turn_index", "turn_id", "message_id", "timestamp", "role", source.alias("source"), channel.alias("input_channel"), F.when(role == "assistant", F.col("model")).alias("model"), "content", "thinking", *names, meta.alias("framework_metadata_json"))


def _calls(lines: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, executions and file changes as rows; file targets; how many calls repeated an id, by path)."""
    from loomspark.sources.adapters import operation

    inner = _j("$.payload.type")
    folders = lines.where(_j("$.type").isin("session_meta", "turn_context")).select("path", "line_no", _some(_j("$.payload.cwd")).alias("cwd")).where("cwd is not null")
    number = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    c = codex._turns(lines).where((_j("$.type") == "response_item") & inner.endswith("_call"))
    c = c.withColumn("tool_call_id", F.coalesce(_some(_j("$.payload.call_id")), F.format_string("tc-codex-%04d", number)))
    c = as_of(c, folders, "path", "line_no", "line_no", ["cwd"])
    given = F.coalesce(_j("$.payload.arguments"), _j("$.payload.action"), _j("$.payload.input"))
    plain = F.get_json_object(given, "$").isNull()
    arguments = F.when(plain & given.isNotNull(), F.to_json(F.struct(given.alias("input")))).otherwise(given)
    c = c.select("path", "line_no", "tool_call_id", "turn_id", "cwd", _j("$.timestamp").alias("timestamp"), F.coalesce(_some(_j("$.payload.name")), F.when(inner == "local_shell_call", "local_shell"), F.lit("unknown")).alias("tool_name"), arguments.alias("arguments"), _some(_j("$.payload.emitting_message_id"), _j("$.payload.message_id")).alias("emitting_message_id"))
    repeated = c.groupBy("path", "tool_call_id").count().where("count > 1").groupBy("path").agg(F.sum(F.col("count") - 1).alias("n"))
    c = keep_first(c, ["path", "tool_call_id"], ["line_no"])
    words = F.from_json(F.get_json_object("arguments", "$.command"), "array<string>")
    command = _some(F.get_json_object("arguments", "$.cmd"), F.when(F.size(words) > 0, F.array_join(words, " ")), F.get_json_object("arguments", "$.command"))
    c = c.withColumn("command", F.when(F.col("tool_name").isin(*SHELLS), command))
    linked = codex.link_calls(c.withColumnRenamed("tool_call_id", "call_id"), turns.select("path", "line_no", "role", "message_id", "turn_id")).select("path", F.col("call_id").alias("tool_call_id"), "message_line")
    c = stored(c.join(linked, ["path", "tool_call_id"], "left").join(turns.select("path", F.col("line_no").alias("message_line"), "turn_index"), ["path", "message_line"], "left"), "calls")
    told = stored(codex.outputs(lines).withColumnRenamed("call_id", "tool_call_id").drop("tool_name"), "outputs")
    times = lines.where((_j("$.type") == "response_item") & inner.endswith("_call_output")).groupBy("path", _j("$.payload.call_id").alias("tool_call_id")).agg(F.max("line_no").alias("r_line"), F.max_by(_j("$.timestamp"), "line_no").alias("r_time"))
    runs = stored(codex.executions(lines), "executions")
    base = c.join(told, ["path", "tool_call_id"], "left").withColumn("record_kind", F.lit("tool_call")).withColumn("outcome_status", F.coalesce("outcome_status", F.lit("unknown")))
    merged = codex.with_executions(base, runs.select("path", "tool_call_id", "call_id", "command", "outcome_status", "exit_code", "result"))
    merged = stored(codex.legacy_ends(lines, merged), "merged")
    own = c.select("path", "tool_call_id", "line_no", "cwd", "timestamp", "arguments", F.col("turn_index").alias("emitting_turn_index"))
    ran = runs.select("path", "tool_call_id", F.col("line_no").alias("x_line"), F.col("cwd").alias("x_cwd"), F.col("timestamp").alias("x_time"), F.col("duration_ms").alias("x_ms"), F.col("error").alias("x_error"))
    m = merged.join(own, ["path", "tool_call_id"], "left").join(told.select("path", "tool_call_id", F.col("duration_ms").alias("o_ms")), ["path", "tool_call_id"], "left").join(times, ["path", "tool_call_id"], "left").join(ran, ["path", "tool_call_id"], "left")
    ms = F.unix_millis(F.try_to_timestamp("r_time")) - F.unix_millis(F.try_to_timestamp("timestamp"))
    m = m.select(
        "path", "tool_call_id", F.coalesce("line_no", "x_line").alias("line_no"), F.coalesce("cwd", "x_cwd").alias("cwd"), F.coalesce("timestamp", "x_time").alias("timestamp"), "emitting_turn_index", "tool_name", "record_kind", "command", "arguments", "outcome_status", "exit_code", "result",
        F.when(F.col("outcome_status") == "failed", F.coalesce("x_error", F.substring("result", 1, 500))).alias("error"), F.coalesce("o_ms", "x_ms", F.when(ms >= 0, ms)).alias("duration_ms"), operation(F.col("tool_name"), F.col("command")).alias("operation_type"),
    )
    changes = stored(codex.file_changes(lines), "changes")
    as_rows = changes.groupBy("path", "tool_call_id").agg(F.min("line_no").alias("line_no"), F.first("outcome_status").alias("outcome_status"), F.when(F.count_distinct("operation_type") == 1, F.max("operation_type")).otherwise("MODIFY").alias("operation_type")).withColumns({"tool_name": F.lit("file_change"), "record_kind": F.lit("file_change")})
    stamps = lines.select("path", "line_no", _j("$.timestamp").alias("timestamp"))
    rows = m.unionByName(as_rows.join(stamps, ["path", "line_no"], "left"), allowMissingColumns=True)
    targets = stored(codex.file_targets(m.select("path", "tool_call_id", "tool_name", "operation_type", "command", "arguments", "cwd")).withColumn("evidence_status", F.lit(None).cast("string")), "targets")
    seen = Window.partitionBy("path", "tool_call_id").orderBy("target", "operation_type")
    native = changes.select("path", "tool_call_id", (F.row_number().over(seen) - 1).alias("ordinal"), "target", "operation_type", F.lit("native_change").alias("evidence_kind"), "evidence_status")
    targets = targets.unionByName(native)
    one = targets.groupBy("path", "tool_call_id").agg(F.min_by("target", "ordinal").alias("file_path"))
    return stored(rows.join(one, ["path", "tool_call_id"], "left"), "rows"), targets, repeated


def convert(lines: DataFrame) -> dict[str, DataFrame]:
    """sessions, turns, tool_calls, turn_tool_calls, files, annotations and metrics of logs (path, line_no, value).  No lines give empty tables."""
    turns = stored(_turns(lines), "turns")
    calls, targets, repeated = _calls(lines, turns)
    kind = _j("$.type")
    at = lambda c: F.when(c.isNotNull(), F.col("line_no"))
    first = lambda c: F.min_by(c, at(c))
    last = lambda c: F.max_by(c, at(c))
    of_kind = lambda k, p: F.when(F.col("kind").isin(*k), _some(_j(p)))
    meta, context = ("session_meta",), ("turn_context",)
    policy = of_kind(context, "$.payload.approval_policy")
    heads = lines.withColumn("kind", kind).groupBy("path").agg(
        first(of_kind(meta, "$.payload.id")).alias("session_id"), last(of_kind(meta + context, "$.payload.cwd")).alias("cwd"), last(of_kind(context, "$.payload.model")).alias("model"), last(of_kind(meta, "$.payload.cli_version")).alias("agent_version"), last(of_kind(meta, "$.payload.model_provider")).alias("provider_hint"),
        last(of_kind(meta, "$.payload.base_instructions.text")).alias("system_prompt"), last(of_kind(meta, "$.payload.git.branch")).alias("git_branch"), last(of_kind(meta, "$.payload.git.commit_hash")).alias("git_ref"), last(of_kind(meta, "$.payload.parent_thread_id")).alias("predecessor_session"), last(policy).alias("policy"),
    )
    heads = stored(heads.withColumn("session_id", F.coalesce("session_id", "path")), "heads")
    of = lambda df: df.join(heads.select("path", "session_id"), "path")
    success = F.when(F.col("outcome_status") == "succeeded", 1).when(F.col("outcome_status") == "failed", 0)
    order = F.row_number().over(Window.partitionBy("path").orderBy("line_no", "tool_call_id")) - 1
    calls = of(calls.withColumns({"success": success.cast("long"), "source_ordinal": order.cast("long"), "arguments_json": F.col("arguments")}))
    t, c = stored(conform(of(turns), "turns"), "turns"), stored(conform(calls, "tool_calls"), "calls")
    listed = F.row_number().over(Window.partitionBy("session_id", "emitting_turn_index").orderBy("source_ordinal")) - 1
    files = targets.join(calls.select("path", "session_id", "tool_call_id", "tool_name", "success", "outcome_status", "cwd", F.col("emitting_turn_index").alias("turn_index")), ["path", "tool_call_id"])
    status = F.coalesce("evidence_status", F.when(F.col("outcome_status") == "succeeded", "confirmed").otherwise("attempted"))
    files = files.withColumns({"target_ordinal": F.col("ordinal"), "evidence_status": status, "resolved": F.startswith("target", F.lit("/")).cast("long")}).drop("path").withColumnRenamed("target", "path")
    stamps = of(lines.select("path", _j("$.timestamp").alias("timestamp"), F.try_to_timestamp(_j("$.timestamp")).alias("ts")))
    span = stamps.where("ts is not null").groupBy("session_id").agg(F.min_by("timestamp", "ts").alias("started_at"), F.max_by("timestamp", "ts").alias("ended_at"))
    counts = ["turn_count", "tool_call_count", "read_count", "modify_count", "create_count", "execute_count", "delegate_count", "subagent_count"]
    m = heads.select("session_id").join(turn_metrics(t), "session_id", "left").join(call_metrics(c), "session_id", "left").join(timing(stamps.select("session_id", "ts")).drop("ended", "started"), "session_id", "left").fillna(0, counts)
    m = stored(m.withColumns({"idle_ratio": idle_ratio(F.col("active_duration_seconds"), F.col("duration_seconds")), "read_ratio": truncated_ratio(F.col("read_count"), F.col("tool_call_count"))}), "metrics")
    blank = F.trim(F.replace("content", F.lit("\n"), F.lit(" ")))
    human = t.where((F.col("source") == "human") & (blank != "")).groupBy("session_id").agg(F.min_by(F.substring(blank, 1, TITLE_CHARS), "turn_index").alias("title"))
    used = c.groupBy("session_id").agg(names_home("file_path").alias("pii"), F.to_json(F.array_sort(F.collect_set("tool_name"))).alias("tools_enabled_json"))
    s = heads.join(m, "session_id").join(span, "session_id", "left").join(human, "session_id", "left").join(used, "session_id", "left")
    grade, private = quality(F.col("turn_count"), F.col("tool_call_count"), F.coalesce("any_result", F.lit(False))), F.coalesce("pii", F.lit(False))
    s = s.withColumns({
        "quality": grade, "working_directory": home_to_tilde(F.col("cwd")), "autonomy_level": F.coalesce(*[F.when(F.col("policy") == k, v) for k, v in AUTONOMY.items()]), "contains_pii": private.cast("long"), "for_research": ((grade == "A") & ~private).cast("long"), "needs_cleaning": ((grade != "A") | private).cast("long"),
        "classification": F.when(private, "confidential").otherwise("internal"), "agent_framework": F.lit("codex"), "platform_type": F.lit("agent"), "source_format": F.lit("codex-session-jsonl-v1"), "source_path": F.col("path"),
    })
    notes = of(repeated).select("session_id", F.concat(F.lit("ann-dedup-"), F.substring("session_id", 1, ID_CHARS)).alias("annotation_id"), F.lit("adapter").alias("annotator"), F.lit("session").alias("scope_type"), F.col("session_id").alias("target_id"), F.lit("observation").alias("category"), F.format_string("Deduplicated %d duplicate tool calls", "n").alias("title"), F.format_string("Removed %d tool calls with duplicate IDs.", "n").alias("detail"), F.lit('["deduplication","data-quality"]').alias("tags_json"))
    return {
        "sessions": conform(s, "sessions"), "turns": t, "tool_calls": c, "turn_tool_calls": conform(c.where("emitting_turn_index is not null").select("session_id", F.col("emitting_turn_index").alias("turn_index"), "tool_call_id", listed.alias("ordinal")), "turn_tool_calls"),
        "files": conform(files, "files"), "annotations": conform(notes, "annotations"), "metrics": conform(m, "metrics"),
    }
