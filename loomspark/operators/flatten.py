"""Session documents to the ten tables: one scan, explodes with positions, no shuffle but for the upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.metrics import outcome_status
from loomspark.schema import KEYS, TABLES, conform


def _text(c: Column) -> Column:
    """Empty text is null."""
    return F.nullif(c, F.lit(""))


def _bit(c: Column) -> Column:
    return c.cast("long")


def _json(c: Column) -> Column:
    return F.when(c.isNotNull(), F.to_json(c))


def _each(docs: DataFrame, array: str) -> DataFrame:
    return docs.select(F.col("id").alias("session_id"), F.posexplode(array).alias("pos", "x"))


def file_targets(x: Column) -> Column:
    """Explicit targets (even none) win; else the one path of the call, as older evidence."""
    one = F.struct(
        x["input"]["file_path"].alias("path"), F.lit(None).cast("string").alias("native_path"), x["operation_type"].alias("operation_type"), F.lit("legacy_scalar").alias("evidence_kind"), F.lit("reported").alias("status"),
        x["output"]["success"].alias("success"), F.lit(None).cast("string").alias("cwd"), F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("source_reference"),
    )
    scalar = F.when(F.coalesce(x["input"]["file_path"], F.lit("")) != "", F.array(one)).otherwise(F.array().cast("array<" + _TARGET + ">"))
    return F.coalesce(x["input"]["file_targets"], scalar)


_TARGET = "struct<path:string,native_path:string,operation_type:string,evidence_kind:string,status:string,success:boolean,cwd:string,resolved:boolean,source_reference:string>"


def sessions(docs: DataFrame) -> DataFrame:
    c = F.col
    text = {
        "session_id": "id", "schema_version": "schema_version", "profile": "profile", "scenario_id": "scenario_id", "quality": "quality", "title": "title", "summary": "summary", "classification": "classification",
        "source_format": "provenance.source_format", "source_path": "provenance.source_path", "converted_at": "provenance.converted_at", "converter_version": "provenance.converter_version", "original_session_id": "provenance.original_session_id",
        "model": "environment.model", "model_version": "environment.model_version", "system_prompt": "environment.system_prompt", "agent_framework": "environment.agent_framework", "agent_version": "environment.agent_version", "platform_type": "environment.platform_type", "provider_hint": "environment.provider_hint",
        "working_directory": "operational_context.working_directory", "git_branch": "operational_context.git_branch", "git_ref": "operational_context.git_ref", "autonomy_level": "operational_context.autonomy_level", "framework_config_json": "operational_context.framework_config",
        "privacy_level": "timing.privacy_level", "started_at": "timing.started_at", "ended_at": "timing.ended_at", "guidance_variant": "condition.guidance_variant", "permission_level": "condition.permission_level", "condition_custom_json": "condition.custom",
        "project_id": "coordination.project_id", "predecessor_session": "coordination.predecessor_session", "human_attention": "coordination.human_attention", "outcome_notes": "outcome.outcome_notes",
    }
    bits = {"for_research": "flags.for_research", "needs_cleaning": "flags.needs_cleaning", "contains_error": "flags.contains_error", "contains_pii": "flags.contains_pii", "sandbox": "operational_context.sandbox", "outcome_success": "outcome.success", "outcome_partial": "outcome.partial"}
    plain = {"temperature": "environment.temperature", "duration_seconds": "timing.duration_seconds", "active_duration_seconds": "timing.active_duration_seconds", "hour_of_day": "timing.hour_of_day", "day_of_week": "timing.day_of_week", "concurrent_sessions": "coordination.concurrent_sessions"}
    plain |= {n: f"metrics.{n}" for n in ("turn_count", "tool_call_count", "read_count", "modify_count", "create_count", "execute_count")}
    arrays = {"category_json": "flags.category", "tools_enabled_json": "environment.tools_enabled", "failure_codes_json": "outcome.failure_codes"}
    cols = [_text(c(p)).alias(n) for n, p in text.items()] + [_bit(c(p)).alias(n) for n, p in bits.items()] + [c(p).alias(n) for n, p in plain.items()] + [_json(c(p)).alias(n) for n, p in arrays.items()]
    return conform(docs.select(*cols, F.to_json(F.struct("*")).alias("raw_json")), "sessions")


def turns(docs: DataFrame) -> DataFrame:
    x = F.col("x")
    u = x["usage"]
    return conform(
        _each(docs, "turns").select(
            "session_id", F.coalesce(x["index"], F.col("pos").cast("long")).alias("turn_index"), *[_text(x[n]).alias(n) for n in ("timestamp", "role", "source", "model", "content_type", "input_channel", "thinking")], F.coalesce(x["content"], F.lit("")).alias("content"),
            x["framework_metadata"].alias("framework_metadata_json"), *[_bit(x["intent_markers"][n]).alias(f"intent_{n}") for n in ("requested", "inferred", "proactive")], _bit(x["streaming"]["was_streamed"]).alias("was_streamed"), _text(x["streaming"]["stream_log"]).alias("stream_log"),
            *[u[n].alias(n) for n in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens", "tool_tokens")], F.to_json(x).alias("raw_json"),
        ),
        "turns",
    )


def tool_calls(docs: DataFrame) -> DataFrame:
    x = F.col("x")
    i, o, s = x["input"], x["output"], x["spawned_agent"]
    return conform(
        _each(docs, "tool_calls").select(
            "session_id", x["id"].alias("tool_call_id"), F.col("pos").cast("long").alias("source_ordinal"), x["emitting_turn_index"].alias("emitting_turn_index"), *[_text(x[n]).alias(n) for n in ("timestamp", "tool_name", "operation_type")], _text(i["file_path"]).alias("file_path"),
            F.coalesce(_text(x["record_kind"]), _text(F.get_json_object(x["framework_metadata"], "$.record_kind")), F.lit("tool_call")).alias("record_kind"), _text(i["command"]).alias("command"), _text(i["justification"]).alias("justification"), i["arguments"].alias("arguments_json"),
            _bit(o["success"]).alias("success"), outcome_status(o["success"], o["status"]).alias("outcome_status"), _text(o["status"]).alias("output_status"), *[_text(o[n]).alias(n) for n in ("result", "error", "full_hash", "full_reference", "content_origin")],
            *[o[n].alias(n) for n in ("exit_code", "duration_ms", "full_bytes")], _bit(o["truncated"]).alias("truncated"), _bit(o["redacted"]).alias("redacted"), x["context"]["position_in_session"].alias("position_in_session"), _json(x["context"]["tools_before"]).alias("tools_before_json"),
            x["framework_metadata"].alias("framework_metadata_json"), _text(s["agent_type"]).alias("spawned_agent_type"), _text(s["task_scope"]).alias("spawned_agent_task_scope"), _text(s["sub_session_id"]).alias("spawned_agent_sub_session_id"), _text(s["outcome_summary"]).alias("spawned_agent_outcome_summary"), F.to_json(x).alias("raw_json"),
        ),
        "tool_calls",
    )


def turn_tool_calls(docs: DataFrame) -> DataFrame:
    each = _each(docs, "turns").select("session_id", F.coalesce(F.col("x.index"), F.col("pos").cast("long")).alias("turn_index"), F.posexplode("x.tool_calls_in_turn").alias("ordinal", "tool_call_id"))
    return conform(each, "turn_tool_calls")


def files(docs: DataFrame) -> DataFrame:
    each = _each(docs, "tool_calls").select("session_id", "x", F.posexplode(file_targets(F.col("x"))).alias("n", "t"))
    t = F.col("t")
    return conform(
        each.select(
            "session_id", F.col("x.id").alias("tool_call_id"), t["path"].alias("path"), F.coalesce(_text(t["operation_type"]), _text(F.col("x.operation_type"))).alias("operation_type"), F.col("x.tool_name").alias("tool_name"), _bit(t["success"]).alias("success"),
            F.col("x.emitting_turn_index").alias("turn_index"), F.col("n").alias("target_ordinal"), F.coalesce(_text(t["evidence_kind"]), F.lit("structured")).alias("evidence_kind"), F.coalesce(_text(t["status"]), F.lit("reported")).alias("evidence_status"),
            _text(t["cwd"]).alias("cwd"), F.coalesce(_bit(t["resolved"]), F.lit(0)).alias("resolved"), _text(t["native_path"]).alias("native_path"), _text(t["source_reference"]).alias("source_reference"),
        ),
        "files",
    )


def annotations(docs: DataFrame) -> DataFrame:
    x = F.col("x")
    return conform(
        _each(docs, "annotations").select(
            "session_id", x["id"].alias("annotation_id"), *[_text(x[n]).alias(n) for n in ("timestamp", "annotator", "classification")], _text(x["scope"]["type"]).alias("scope_type"), _text(x["scope"]["target_id"]).alias("target_id"), _text(x["content"]["category"]).alias("category"), _json(x["content"]["tags"]).alias("tags_json"),
            F.coalesce(x["content"]["title"], F.lit("")).alias("title"), F.coalesce(x["content"]["detail"], F.lit("")).alias("detail"), *[_json(x["taxonomy_mappings"][n]).alias(f"{n}_taxonomy_json") for n in ("minitrace", "mast", "toolemu")], F.to_json(x).alias("raw_json"),
        ),
        "annotations",
    )


def handovers(docs: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(d).alias("direction"), F.col(f"handover.{d}").alias("h")) for d in ("received", "produced")])
    each = docs.select(F.col("id").alias("session_id"), F.explode(F.filter(sides, lambda s: s["h"].isNotNull())).alias("s"))
    h = F.col("s.h")
    return conform(each.select("session_id", "s.direction", *[_text(h[n]).alias(n) for n in ("from_session", "to_session", "document", "state_description")], F.to_json(h).alias("raw_json")), "handovers")


def metrics(docs: DataFrame) -> DataFrame:
    return conform(docs.where("metrics is not null").select(F.col("id").alias("session_id"), "metrics.*", F.to_json("metrics").alias("raw_json")), "metrics")


def attachments(docs: DataFrame) -> DataFrame:
    x = F.col("x")
    return conform(_each(docs, "attachments").select("session_id", x["id"].alias("attachment_id"), *[_text(x[n]).alias(n) for n in ("timestamp", "kind", "name", "media_type", "path", "url", "hash", "content_ref", "text_preview", "tool_call_id", "event_id")], x["size_bytes"].alias("size_bytes"), x["turn_index"].alias("turn_index"), x["framework_metadata"].alias("framework_metadata_json"), F.to_json(x).alias("raw_json")), "attachments")


def events(docs: DataFrame) -> DataFrame:
    """Turns, calls, annotations and explicit events as one list; derived events have no timestamp."""
    short = lambda c: F.substring(c, 1, 120)
    t, c, a, x = turns(docs), tool_calls(docs), annotations(docs), F.col("x")
    parts = [
        t.select("session_id", F.format_string("turn-%06d", "turn_index").alias("event_id"), "turn_index", F.col("turn_index").alias("ordinal"), F.lit("turn").alias("kind"), "role", short("content").alias("summary"), F.col("content").alias("text")),
        c.select("session_id", F.concat(F.lit("tool-"), "tool_call_id").alias("event_id"), F.col("emitting_turn_index").alias("turn_index"), F.col("source_ordinal").alias("ordinal"), F.lit("tool_call").alias("kind"), "tool_call_id", F.col("tool_name").alias("title"), short(F.coalesce("command", "file_path")).alias("summary"), F.when(F.col("success") == 0, "error").alias("severity")),
        a.select("session_id", F.concat(F.lit("annotation-"), "annotation_id").alias("event_id"), F.lit("annotation").alias("kind"), "annotation_id", "title", short("detail").alias("summary")),
        _each(docs, "events").select("session_id", x["id"].alias("event_id"), *[x[n].alias(n) for n in ("timestamp", "turn_index", "ordinal", "kind", "role", "tool_call_id", "annotation_id", "attachment_id", "title", "summary", "text", "severity")], _bit(x["collapsed_by_default"]).alias("collapsed_by_default"), x["framework_metadata"].alias("framework_metadata_json"), F.to_json(x).alias("raw_json")),
    ]
    out = conform(parts[0], "events")
    for p in parts[1:]:
        out = out.unionByName(conform(p, "events"))
    return out


BUILDERS = {"sessions": sessions, "turns": turns, "tool_calls": tool_calls, "turn_tool_calls": turn_tool_calls, "files": files, "annotations": annotations, "handovers": handovers, "metrics": metrics, "attachments": attachments, "events": events}


def last_of_each(docs: DataFrame, order: str) -> DataFrame:
    """Of documents with one id, the one that was loaded last: nothing of the others is left behind."""
    w = Window.partitionBy("id").orderBy(F.desc(order))
    return docs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def flatten(docs: DataFrame) -> dict[str, DataFrame]:
    """docs (columns of a session document, one row per id) as the ten tables."""
    assert set(BUILDERS) == set(TABLES) and set(KEYS) < set(TABLES)
    return {name: build(docs) for name, build in BUILDERS.items()}


def sessions_base(sessions: DataFrame) -> DataFrame:
    """The older view of sessions: a few columns and the nested parts of the document as JSON texts."""
    plain = ("title", "summary", "classification", "profile")
    nested = ("provenance", "flags", "environment", "operational_context", "timing", "turns", "tool_calls", "annotations", "metrics")
    return sessions.select(F.col("session_id").alias("id"), *plain, *[F.get_json_object("raw_json", f"$.{n}").alias(n) for n in nested])
