"""Copilot event logs as sessions: fourteen kinds of events, permissions, redaction.

Events name their parents by id, and what an event belongs to (a turn, or the scope of a turn to
come) is inherited along parents.  That is pointer jumping over the events of all logs at once; starts and
completions of tools pair by windows, and what held at an event's time is looked up as of its line.
No log is folded in one place.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.metrics import home_to_tilde, names_home, outcome_status, quality
from loomspark.operators.pointers import climb
from loomspark.operators.sequence import as_of, keep_first
from loomspark.schema import conform
from loomspark.sources.cache import stored

# Names whose content is never kept, commands by operation, kinds and titles of events.
SENSITIVE = ("content", "encryptedContent", "reasoningOpaque", "detailedContent", "sessionLog", "textResultForLlm")
REDACTED = "<redacted>"
READING = (r"^cat\s", r"^head\s", r"^tail\s", r"^less\s", r"^more\s", r"^find\s", r"^ls\s", r"^tree\s", r"^wc\s", r"^grep\s", r"^rg\s", r"^git\s+(log|show|diff|status|branch|blame)\b")
MODIFYING = (r"^sed\s+-i", r"^perl\s+-i", r"^patch\s", r"^git\s+apply\b", r"^chmod\s", r"^chown\s", r">")
EVENTS = {
    "session.start": ("session_start", "Copilot session started"),
    "session.info": ("session_info", "Copilot session info"),
    "session.model_change": ("model_change", "Copilot model changed"),
    "system.message": ("system_message", "Copilot system message"),
    "assistant.turn_start": ("assistant_turn_start", "Copilot assistant turn started"),
    "assistant.turn_end": ("assistant_turn_end", "Copilot assistant turn ended"),
    "permission.requested": ("permission_request", "Copilot permission requested"),
    "permission.completed": ("permission_decision", "Copilot permission completed"),
    "hook.start": ("hook_start", "Copilot hook.start"),
    "hook.end": ("hook_end", "Copilot hook.end"),
    "session.shutdown": ("session_shutdown", "Copilot session shutdown"),
}
UNKNOWN = ("copilot_unknown", "Copilot unknown event")
TURNS, TOOLS = ("user.message", "assistant.message"), ("tool.execution_start", "tool.execution_complete")
LIFECYCLE = ("assistant.turn_start", "assistant.turn_end")
NO_COMPLETION = "the log ends without a result of this call"
NAMELESS = "Session Initialization"
ID_CHARS, SUMMARY_CHARS, SYSTEM_CHARS, TITLE_CHARS = 24, 200, 120, 80
_END = (1 << 62) - 1

_FIELDS = {
    "id": "$.id", "timestamp": "$.timestamp", "parent_id": "$.parentId", "content": "$.data.content", "transformed": "$.data.transformedContent", "turn_id": "$.data.turnId", "interaction_id": "$.data.interactionId", "model": "$.data.model",
    "call_id": "$.data.toolCallId", "tool_name": "$.data.toolName", "arguments": "$.data.arguments", "ok": "$.data.success", "result": "$.data.result", "request_id": "$.data.requestId",
}


def _j(path: str, c: str = "value") -> Column:
    return F.get_json_object(c, path)


def _some(*columns: Column | str) -> Column:
    """The first that isn't blank, or null."""
    return F.coalesce(*[F.when(F.trim(F.col(c) if isinstance(c, str) else c) != "", F.col(c) if isinstance(c, str) else c) for c in columns])


def _clean(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: REDACTED if k in SENSITIVE else _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, list) else value


def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json.dumps(_clean(json.loads(t)), ensure_ascii=False))


def redacted(text: Column) -> Column:
    """JSON text with the values of sensitive names replaced, at any depth."""
    return F.pandas_udf(_redact, "string")(text)


def _short(c: Column, most: int) -> Column:
    c = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def _short_id(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("-"))
    return F.when(c == "", "unknown").otherwise(F.substring(c, 1, ID_CHARS))


def operation(tool: Column, command: Column, mode: Column, redirects: Column) -> Column:
    """READ, MODIFY, NEW or EXECUTE by permission, tool name and command."""
    tool, command = F.lower(tool), F.trim(F.lower(F.coalesce(command, F.lit(""))))
    has = lambda *words: F.coalesce(*[F.when(F.contains(tool, F.lit(w)), True) for w in words], F.lit(False))
    is_ = lambda patterns: F.coalesce(*[F.when(command.rlike(p), True) for p in patterns], F.lit(False))
    return (
        F.when(F.coalesce(redirects, F.lit(False)), "MODIFY").when(has("read", "list", "search", "grep"), "READ")
        .when(has("write", "edit", "patch", "create"), F.when(has("create") | F.coalesce(mode == "create", F.lit(False)), "NEW").otherwise("MODIFY"))
        .when(is_(READING), "READ").when(is_(MODIFYING), "MODIFY").otherwise("EXECUTE")
    )


def file_of(command: Column, paths: Column) -> Column:
    """The first path of the permission, else the last word of the command, after the first, that looks like one."""
    words = F.split(F.trim(F.coalesce(command, F.lit(""))), r"\s+")
    later = F.transform(F.reverse(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))), lambda w: F.btrim(w, F.lit("'\"")))
    like = F.filter(later, lambda w: (w != "") & ~F.startswith(w, F.lit("-")) & (F.contains(w, F.lit("/")) | F.contains(w, F.lit("."))))
    return F.when(F.size(paths) > 0, F.get(paths, F.lit(0))).otherwise(F.get(like, F.lit(0)))


def _scoped(asked: DataFrame, key: str, at: str, messages: DataFrame, messages_key: str, name: str) -> DataFrame:
    """asked with the turn of the last assistant message that shares the key before a line."""
    joined = lambda k: F.when(F.col(k).isNotNull(), F.concat("path", F.lit("\0"), F.col(k)))
    right = messages.where(F.col(messages_key).isNotNull()).select(joined(messages_key).alias("_k"), F.col("line_no").alias("_line"), F.col("turn_index").alias(name))
    left = asked.withColumn("_k", joined(key))
    found = as_of(left.where("_k is not null"), right, "_k", at, "_line", [name])
    return found.unionByName(left.where("_k is null").withColumn(name, F.lit(None).cast("long"))).drop("_k")


def _events(lines: DataFrame) -> DataFrame:
    """Events with their turn index, own scope and parent's line."""
    e = lines.select("path", "line_no", "value", F.coalesce(_j("$.type"), F.lit("")).alias("kind"), *[_j(p).alias(n) for n, p in _FIELDS.items()])
    is_turn = F.col("kind").isin(*TURNS)
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    scope = F.when((F.trim("interaction_id") != "") & (F.trim("turn_id") != ""), F.concat_ws(":", F.trim("interaction_id"), F.trim("turn_id")))
    e = e.withColumn("turn_index", F.when(is_turn, F.count_if(is_turn).over(so_far) - 1)).withColumn("scope", scope)
    stable = F.when(F.coalesce("id", F.lit("")) != "", _short_id(F.col("id"))).otherwise(_short_id(F.concat_ws("-", "kind", F.coalesce("timestamp", F.lit("")))))
    e = stored(e.withColumn("stable_id", stable), "events")
    named = keep_first(e.where("id <> ''").select("path", F.col("id").alias("parent_id"), F.col("line_no").alias("up")), ["path", "parent_id"], ["up"])
    return stored(e.join(named, ["path", "parent_id"], "left").withColumn("up", F.when(F.col("up") < F.col("line_no"), F.col("up"))), "events")


def _keys(e: DataFrame) -> DataFrame:
    """e with key (the scope that the event belongs to, which children inherit) and parent_key."""
    kind = F.col("kind")
    defines = kind.isin("assistant.message", *LIFECYCLE, TOOLS[0])
    inherits = ~kind.isin(*TURNS, *LIFECYCLE, TOOLS[1])
    state = e.select("path", "line_no", F.when(inherits, F.col("up")).alias("ptr"), F.when(defines, F.col("scope")).alias("key"))
    keys = climb(stored(state, "keys"), {"key": lambda own, above: F.coalesce(above, own)}).drop("ptr")
    above = keys.select("path", F.col("line_no").alias("up"), F.col("key").alias("parent_key"))
    return e.join(keys, ["path", "line_no"]).join(above, ["path", "up"], "left")


def _paired(e: DataFrame) -> DataFrame:
    """Starts and completions of tools: each completion with its start, each start without one at the log's end."""
    is_start = F.col("kind") == TOOLS[0]
    own_id = F.concat(F.lit("copilot-tool-"), "stable_id")
    t = e.where(F.col("kind").isin(*TOOLS)).withColumn("call", F.when(F.coalesce("call_id", F.lit("")) != "", F.col("call_id")).when(is_start, own_id))
    w = Window.partitionBy("path", "call").orderBy("line_no")
    named = t.where("call is not null").withColumns({"before": F.lag("kind").over(w), "start_line": F.lag("line_no").over(w), "after": F.lead("kind").over(w)})
    nameless = t.where("call is null").withColumns({"before": F.lit(None).cast("string"), "start_line": F.lit(None).cast("long"), "after": F.lit(None).cast("string")})
    t = named.unionByName(nameless.withColumn("call", own_id))
    done = t.where(~is_start).withColumn("start_line", F.when(F.col("before") == TOOLS[0], F.col("start_line"))).withColumn("complete", F.lit(True))
    # a start that another follows is forgotten
    left = t.where(is_start & F.col("after").isNull()).withColumn("start_line", F.col("line_no")).withColumn("complete", F.lit(False))
    return done.unionByName(left).select("path", "line_no", "call", "start_line", "complete").withColumn("built", F.when(F.col("complete"), F.col("line_no")).otherwise(_END))


def _permissions(e: DataFrame, tools: DataFrame) -> DataFrame:
    """(path, call, built, permission, permission_result): the last request before the call was built, and what was decided since."""
    request = F.coalesce(_j("$.data.permissionRequest"), _j("$.data.promptRequest"))
    asked = e.where(F.col("kind") == "permission.requested").select("path", F.get_json_object(request, "$.toolCallId").alias("call"), "line_no", F.struct("line_no", request.alias("request")).alias("asked")).where("call <> ''")
    decided = e.where(F.col("kind") == "permission.completed").select("path", F.col("call_id").alias("call"), "line_no", F.struct("line_no", _j("$.data.result.kind").alias("result")).alias("decided")).where("call <> ''")
    builds = tools.select("path", "call", F.col("built").alias("line_no"), "start_line", F.lit(True).alias("build"))
    rows = asked.unionByName(decided, allowMissingColumns=True).unionByName(builds, allowMissingColumns=True)
    w = Window.partitionBy("path", "call").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"asked": F.last("asked", ignorenulls=True).over(w), "decided": F.last("decided", ignorenulls=True).over(w)}).where("build")
    since = F.coalesce("asked.line_no", "start_line")
    return rows.select("path", "call", F.col("line_no").alias("built"), F.col("asked.request").alias("permission"), F.when(F.col("decided.line_no") > since, F.col("decided.result")).alias("permission_result"))


def _placed(e: DataFrame, tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, line_no, idx): the turn of each event at its time; tools with key and the turn they end up with)."""
    messages = e.where(F.col("kind") == "assistant.message").select("path", "line_no", "turn_index", F.col("key").alias("m_key"), _some("turn_id").alias("m_turn"))
    starts = e.where(F.col("kind") == TOOLS[0]).select("path", F.col("line_no").alias("start_line"), F.col("key").alias("start_key"), F.col("turn_id").alias("start_turn"))
    t = tools.join(starts, ["path", "start_line"], "left").join(e.select("path", "line_no", "up", "scope", "parent_key", "turn_id"), ["path", "line_no"])
    matched = F.col("start_line").isNotNull()
    t = t.withColumn("tool_key", F.when(matched, F.col("start_key")).otherwise(F.coalesce("parent_key", "scope"))).withColumn("of_turn", _some(F.when(matched, F.col("start_turn")).otherwise(F.col("turn_id"))))
    t = _scoped(t, "tool_key", "built", messages, "m_key", "by_key")
    t = stored(_scoped(t, "of_turn", "built", messages, "m_turn", "by_turn"), "tools")
    done = t.where("complete").select("path", "line_no", F.coalesce("start_line", "up").alias("ptr"), F.coalesce("by_key", "by_turn").alias("idx"))
    others = e.where(~F.col("kind").isin("user.message", "assistant.message", *LIFECYCLE, TOOLS[1])).select("path", "line_no", "up", "parent_key")
    others = _scoped(others, "parent_key", "line_no", messages, "m_key", "idx").select("path", "line_no", F.col("up").alias("ptr"), "idx")
    fixed = e.where(F.col("kind").isin("user.message", "assistant.message", *LIFECYCLE)).select("path", "line_no", F.lit(None).cast("long").alias("ptr"), F.when(F.col("kind") == "assistant.message", F.col("turn_index")).alias("idx"))
    idx = climb(stored(done.unionByName(others).unionByName(fixed), "places"), {"idx": lambda own, above: F.coalesce(above, own)}).drop("ptr")
    # a message of the call's scope that comes after the call takes it over
    last = messages.where("m_key is not null").groupBy("path", F.col("m_key").alias("tool_key")).agg(F.max("line_no").alias("last_line"), F.max_by("turn_index", "line_no").alias("last_turn"))
    own = idx.select("path", "line_no", F.col("idx").alias("own_idx"))
    t = t.join(own, ["path", "line_no"]).join(last, ["path", "tool_key"], "left")
    at_end = F.when(F.col("complete"), F.col("own_idx")).otherwise(F.coalesce("own_idx", "by_key", "by_turn"))
    taken = (F.col("last_line") > F.col("built")) & (matched | F.col("own_idx").isNull())
    return idx, stored(t.withColumn("idx", F.when(taken, F.col("last_turn")).otherwise(at_end)).withColumn("built_idx", at_end), "tools")


def _calls(e: DataFrame, tools: DataFrame) -> DataFrame:
    starts = e.where(F.col("kind") == TOOLS[0]).select("path", F.col("line_no").alias("start_line"), F.col("value").alias("start_value"), F.col("timestamp").alias("start_time"), F.col("tool_name").alias("start_tool"), "arguments", F.col("model").alias("start_model"), F.col("turn_id").alias("s_turn"))
    ends = e.select("path", "line_no", F.col("value").alias("end_value"), F.col("timestamp").alias("end_time"), F.col("ok"), F.col("result").alias("r"), F.col("id").alias("end_id"), F.col("model").alias("end_model"), F.col("turn_id").alias("e_turn"))
    c = tools.select("path", "line_no", "call", "start_line", "complete", "built", "idx").join(starts, ["path", "start_line"], "left").join(ends, ["path", "line_no"]).join(_permissions(e, tools), ["path", "call", "built"], "left")
    arg = lambda *names: _some(*[F.get_json_object("arguments", f"$.{n}") for n in names])
    granted = lambda n: F.get_json_object("permission", f"$.{n}")
    command, tool = arg("command", "cmd", "script", "input"), F.coalesce(_some("start_tool"), F.lit("unknown"))
    done = F.col("complete")
    text = F.when(done, _some(F.get_json_object("r", "$.content"), F.get_json_object("r", "$.detailedContent")))
    success = done & F.coalesce(F.col("ok") != "false", F.lit(True))
    error = F.when(~done, NO_COMPLETION).when(~success, F.coalesce(text, _some(F.get_json_object("end_value", "$.data.error.message"), F.get_json_object("end_value", "$.data.error"))))
    paths = F.from_json(granted("possiblePaths"), "array<string>")
    ms = F.unix_millis(F.try_to_timestamp("end_time")) - F.unix_millis(F.try_to_timestamp("start_time"))
    variant = lambda c: F.try_parse_json(redacted(c))
    asked = F.struct(variant(F.col("permission")).alias("request"), F.col("permission_result").alias("result"))
    meta = F.to_json(F.struct(
        F.when(done, F.col("end_id")).otherwise(F.col("call")).alias("copilot_event_id"), F.coalesce(_some("s_turn", "e_turn"), F.lit("")).alias("turn_id"), F.coalesce(_some("start_model", "end_model"), F.lit("")).alias("model"), done.alias("completion_event_present"),
        variant(F.col("start_value")).alias("start_event"), variant(F.when(done, F.get_json_object("end_value", "$.data.toolTelemetry"))).alias("tool_telemetry"), F.when(F.col("permission").isNotNull() | F.col("permission_result").isNotNull(), asked).alias("permission"),
    ))
    order = F.row_number().over(Window.partitionBy("path").orderBy("built", "call")) - 1
    return c.select(
        "path", F.col("call").alias("tool_call_id"), order.cast("long").alias("source_ordinal"), F.col("idx").alias("emitting_turn_index"), _some("start_time", F.when(done, F.col("end_time"))).alias("timestamp"), tool.alias("tool_name"),
        operation(tool, command, F.get_json_object("arguments", "$.mode"), granted("hasWriteFileRedirection") == "true").alias("operation_type"), _some(file_of(command, paths), arg("path", "file_path", "filePath")).alias("file_path"), F.lit("tool_call").alias("record_kind"), command.alias("command"),
        F.coalesce(arg("description"), _some(granted("intention"))).alias("justification"), F.coalesce("arguments", F.lit("{}")).alias("arguments_json"), success.cast("long").alias("success"), outcome_status(success, F.lit(None).cast("string")).alias("outcome_status"), text.alias("result"), error.alias("error"),
        F.when(done & (ms >= 0), ms).alias("duration_ms"), F.lit("tool_output").alias("content_origin"), meta.alias("framework_metadata_json"), done.alias("complete"),
    )


def _listed(e: DataFrame, idx: DataFrame, tools: DataFrame) -> DataFrame:
    """(path, turn_index, tool_call_id, ordinal): the calls of each turn, in the order in which it got them."""
    messages = e.where((F.col("kind") == "assistant.message") & F.col("key").isNotNull()).select("path", F.col("key").alias("tool_key"), F.col("line_no").alias("at"), "turn_index")
    started = tools.where("start_line is not null")
    first = started.join(idx.select("path", F.col("line_no").alias("start_line"), F.col("idx").alias("turn_index")), ["path", "start_line"]).select("path", "turn_index", "call", F.col("start_line").alias("at"))
    waiting = F.when(F.col("start_line").isNotNull(), F.col("start_line")).when(F.col("built_idx").isNull(), F.col("built"))
    taken = tools.withColumn("since", waiting).select("path", "tool_key", "call", "since").join(messages, ["path", "tool_key"]).where("at > since").select("path", "turn_index", "call", "at")
    built = tools.select("path", F.col("built_idx").alias("turn_index"), "call", F.col("built").alias("at"))
    pairs = first.unionByName(taken).unionByName(built).where("turn_index is not null").groupBy("path", "turn_index", "call").agg(F.min("at").alias("at"))
    ordinal = F.row_number().over(Window.partitionBy("path", "turn_index").orderBy("at", "call")) - 1
    return pairs.select("path", "turn_index", F.col("call").alias("tool_call_id"), ordinal.cast("long").alias("ordinal"))


def _turns(e: DataFrame) -> DataFrame:
    is_user, data = F.col("kind") == "user.message", lambda n: F.coalesce(_j(f"$.data.{n}"), F.lit(""))
    size = F.when(_j("$.data.attachments").startswith("["), F.coalesce(F.json_array_length(_j("$.data.attachments")), F.lit(0))).otherwise(0)
    asked = F.to_json(F.struct(F.col("id").alias("copilot_event_id"), data("interactionId").alias("interaction_id"), data("parentAgentTaskId").alias("parent_agent_task_id"), size.alias("attachment_count")))
    said = F.to_json(F.struct(
        F.col("id").alias("copilot_event_id"), data("turnId").alias("turn_id"), data("interactionId").alias("interaction_id"), data("messageId").alias("message_id"), data("phase").alias("phase"), data("requestId").alias("request_id"), data("serviceRequestId").alias("service_request_id"),
        (data("reasoningOpaque") != "").alias("reasoning_opaque_present"), (data("encryptedContent") != "").alias("encrypted_content_present"),
    ))
    tokens = _j("$.data.outputTokens").try_cast("long")
    return e.where(F.col("kind").isin(*TURNS)).select(
        "path", "turn_index", _some("timestamp").alias("timestamp"), F.when(is_user, "user").otherwise("assistant").alias("role"), F.when(is_user, "human").otherwise("model").alias("source"), F.when(~is_user, _some("model")).alias("model"), F.when(is_user, "user_input").alias("input_channel"),
        F.when(is_user, F.coalesce(_some("transformed", "content"), F.lit(""))).otherwise(F.coalesce("content", F.lit(""))).alias("content"), F.when(~is_user & (tokens > 0), tokens).alias("output_tokens"), F.when(is_user, asked).otherwise(said).alias("framework_metadata_json"),
    )


def _lifecycle(e: DataFrame, idx: DataFrame, session: Column) -> DataFrame:
    """Rows of the table of events.  session: the id so far, which a start tells."""
    kind = F.col("kind")
    pick = lambda i: F.coalesce(*[F.when(kind == k, v[i]) for k, v in EVENTS.items()], F.lit(UNKNOWN[i]))
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    model = F.last(_some(_j("$.data.newModel"), F.when(kind.isin("assistant.message"), F.col("model")), _j("$.data.currentModel")), ignorenulls=True).over(so_far)
    e = e.withColumn("latest", model).withColumn("known", F.last(session, ignorenulls=True).over(so_far))
    v = e.where(~kind.isin(*TURNS, *TOOLS)).join(idx, ["path", "line_no"])
    asked, lifecycle = F.coalesce(_j("$.data.permissionRequest"), _j("$.data.promptRequest")), kind.isin(*LIFECYCLE)
    permission = kind.isin("permission.requested", "permission.completed")
    summary = (
        F.when(kind == "session.start", F.col("known")).when(kind == "session.info", _j("$.data.message")).when(kind == "session.model_change", F.col("latest")).when(kind == "system.message", _short(F.col("content"), SYSTEM_CHARS)).when(lifecycle, F.col("turn_id"))
        .when(kind == "permission.requested", F.get_json_object(asked, "$.intention")).when(kind == "permission.completed", F.get_json_object("result", "$.kind")).when(kind.isin("hook.start", "hook.end"), _j("$.data.hookType")).when(kind == "session.shutdown", _j("$.data.shutdownType")).otherwise(kind)
    )
    prefix = F.when(permission, F.replace(kind, F.lit("."), F.lit("-"))).otherwise(pick(0))
    event_id = F.concat(F.lit("copilot-"), prefix, F.lit("-"), F.when(permission, F.coalesce(_some("request_id"), F.col("stable_id"))).otherwise(F.col("stable_id")))
    about = F.when(kind == "permission.requested", F.get_json_object(asked, "$.toolCallId")).when(kind == "permission.completed", F.col("call_id"))
    plain = F.to_json(F.struct(F.col("id").alias("copilot_event_id"), kind.alias("copilot_type")))
    of_turn = F.to_json(F.struct(F.col("id").alias("copilot_event_id"), F.coalesce("turn_id", F.lit("")).alias("turn_id"), _some("interaction_id").alias("interaction_id")))
    decided = F.to_json(F.struct(F.coalesce("request_id", F.lit("")).alias("request_id"), F.coalesce("call_id", F.lit("")).alias("tool_call_id"), F.coalesce(F.get_json_object("result", "$.kind"), F.lit("")).alias("result"), F.col("id").alias("event_id")))
    # an event id that repeats gets its line
    same = Window.partitionBy("path", "event_id").orderBy("line_no")
    v = v.withColumn("event_id", event_id).withColumn("again", F.row_number().over(same))
    order = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    return v.select(
        "path", F.when(F.col("again") > 1, F.concat_ws("-", "event_id", "line_no")).otherwise(F.col("event_id")).alias("event_id"), _some("timestamp").alias("timestamp"), F.when(~lifecycle, F.col("idx")).alias("turn_index"), order.cast("long").alias("ordinal"), pick(0).alias("kind"),
        F.when(lifecycle, "assistant").otherwise("system").alias("role"), _some(about).alias("tool_call_id"), pick(1).alias("title"), F.when(lifecycle | permission, F.coalesce(summary, F.lit(""))).otherwise(_short(summary, SUMMARY_CHARS)).alias("summary"),
        F.when(lifecycle, of_turn).when(kind == "permission.requested", redacted(asked)).when(kind == "permission.completed", decided).otherwise(plain).alias("framework_metadata_json"), F.when(lifecycle, of_turn).otherwise(redacted(F.col("value"))).alias("raw_json"),
    )


def _sessions(e: DataFrame, turns: DataFrame, calls: DataFrame, workspaces: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    kind = F.col("kind")
    at = lambda c: F.when(c.isNotNull(), F.col("line_no"))
    last = lambda c: F.max_by(c, at(c))
    first = lambda c: F.min_by(c, at(c))
    on = lambda k, c: F.when(kind == k, c)
    model = F.when(kind == "session.model_change", _some(_j("$.data.newModel"))).when(kind == "assistant.message", _some("model")).when(kind == "session.shutdown", _some(_j("$.data.currentModel")))
    context = on("session.start", _j("$.data.context"))
    tokens = on("session.shutdown", _j("$.data.tokenDetails"))
    stamp = F.try_to_timestamp("timestamp")
    folder = F.nullif(F.regexp_extract("path", "([^/]+)/[^/]+$", 1), F.lit(""))
    s = e.groupBy("path").agg(
        last(on("session.start", _some(_j("$.data.sessionId")))).alias("told_id"), last(on("session.start", _some(_j("$.data.copilotVersion")))).alias("agent_version"), last(model).alias("model"), first(on("system.message", F.nullif("content", F.lit("")))).alias("system_prompt"),
        last(context).alias("context"), last(tokens).alias("tokens"), last(on("session.start", _some(_j("$.data.producer")))).alias("producer"), last(on("session.start", _j("$.data.version"))).alias("version"), last(on("session.shutdown", _j("$.data.modelMetrics"))).alias("model_metrics"), last(on("session.shutdown", _j("$.data.codeChanges"))).alias("code_changes"),
        last(on("session.shutdown", _j("$.data.totalApiDurationMs").try_cast("long"))).alias("total_api_duration_ms"), F.min_by("timestamp", stamp).alias("started_at"), F.max_by("timestamp", stamp).alias("ended_at"), F.min(stamp).alias("t0"), F.max(stamp).alias("t1"),
    )
    blank = F.trim(F.replace("content", F.lit("\n"), F.lit(" ")))
    said = turns.groupBy("path").agg(F.count(F.lit(1)).alias("turn_count"), F.min_by(F.when((F.col("role") == "user") & (blank != ""), F.substring(blank, 1, TITLE_CHARS)), F.when((F.col("role") == "user") & (blank != ""), F.col("turn_index"))).alias("said"), F.sum("output_tokens").alias("said_tokens"))
    count = lambda op: F.count_if(F.col("operation_type") == op)
    did = calls.groupBy("path").agg(F.count(F.lit(1)).alias("tool_call_count"), count("READ").alias("read_count"), count("MODIFY").alias("modify_count"), count("NEW").alias("create_count"), count("EXECUTE").alias("execute_count"), F.count_if(F.col("complete") & (F.col("success") == 0)).alias("failed"), F.count("result").alias("results"), F.to_json(F.array_sort(F.collect_set("tool_name"))).alias("tools_enabled_json"), names_home("file_path").alias("pii"))
    s = s.join(said, "path", "left").join(did, "path", "left").fillna(0, ["turn_count", "tool_call_count", "read_count", "modify_count", "create_count", "execute_count", "failed", "results"])
    if workspaces is not None:
        s = s.withColumn("folder", F.regexp_replace("path", "/[^/]+$", "")).join(workspaces.select("folder", *[F.col(c).alias(f"w_{c}") for c in ("id", "name", "cwd", "branch", "repository", "git_root")]), "folder", "left")
    else:
        s = s.withColumns({f"w_{c}": F.lit(None).cast("string") for c in ("id", "name", "cwd", "branch", "repository", "git_root")})
    of = lambda n: _some(F.get_json_object("context", f"$.{n}"))
    private = F.coalesce("pii", F.lit(False))
    grade = quality(F.col("turn_count"), F.col("tool_call_count"), F.col("results") > 0)
    variant = lambda c: F.try_parse_json(redacted(F.col(c)))
    config = F.to_json(F.struct("producer", "version", variant("context").alias("context"), variant("model_metrics").alias("model_metrics"), variant("code_changes").alias("code_changes"), F.when(F.col("total_api_duration_ms") > 0, F.col("total_api_duration_ms")).alias("total_api_duration_ms")))
    total = lambda n: F.coalesce(F.get_json_object("tokens", f"$.{n}.tokenCount").try_cast("long"), F.when(F.col("tokens").isNotNull(), 0))
    s = s.select(
        "*", F.coalesce("told_id", _some("w_id"), folder, F.lit("copilot-session")).alias("session_id"), grade.alias("quality"), F.coalesce(F.when(F.lower("w_name") != NAMELESS.lower(), _some("w_name")), F.col("said")).alias("title"), home_to_tilde(F.coalesce(_some("w_cwd"), of("cwd"))).alias("working_directory"),
        F.coalesce(_some("w_branch"), of("branch")).alias("git_branch"), F.coalesce(of("headCommit"), of("baseCommit")).alias("git_ref"), F.when(F.col("w_git_root") != "", _some("w_repository")).alias("project_id"), config.alias("framework_config_json"), (F.col("failed") > 0).cast("long").alias("contains_error"),
        ((F.unix_micros("t1") - F.unix_micros("t0")) / 1000000).alias("duration_seconds"), ((grade == "A") & ~private).cast("long").alias("for_research"), ((grade != "A") | private).cast("long").alias("needs_cleaning"), private.cast("long").alias("contains_pii"), F.when(private, "confidential").otherwise("internal").alias("classification"), F.lit("copilot").alias("agent_framework"), F.lit("agent").alias("platform_type"), F.lit("github-copilot").alias("provider_hint"),
        F.lit("copilot-cli-events-jsonl-v1").alias("source_format"), F.col("path").alias("source_path"), total("input").alias("total_input_tokens"), F.coalesce(total("output"), "said_tokens").alias("total_output_tokens"), total("cache_read").alias("total_cache_read_tokens"),
        F.when(F.col("tool_call_count") > 0, F.floor(F.col("read_count") * 1000 / F.col("tool_call_count")) / 1000).alias("read_ratio"), F.lit(0).cast("long").alias("delegate_count"),
    )
    return s, s


def workspaces_of(files: DataFrame) -> DataFrame:
    """(folder, id, name, cwd, branch, repository, git_root) of workspace.yaml texts (path, content): plain `name: value` lines."""
    at = lambda n: F.btrim(F.regexp_extract("content", rf"(?m)^{n}:[ \t]*(.*?)[ \t\r]*$", 1), F.lit("'\""))
    return files.select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"), *[at(n).alias(n) for n in ("id", "name", "cwd", "branch", "repository", "git_root")])


def convert(lines: DataFrame, workspaces: DataFrame | None = None, bad: DataFrame | None = None) -> dict[str, DataFrame]:
    """sessions, turns, tool_calls, turn_tool_calls, events, annotations and metrics of logs (path, line_no, value).

    workspaces: as workspaces_of() gives them, by the folder of the log.  bad: (path, line_no, message) of lines
    that could not be read, which become annotations of the session.  A tool started but never completed
    fails; a completion without a start is a call of an unknown tool.  No lines give empty tables.
    """
    e = stored(_keys(_events(lines)), "events")
    tools = stored(_paired(e), "tools")
    idx, tools = _placed(e, tools)
    turns, calls = _turns(e), stored(_calls(e, tools), "calls")
    sessions, metrics = _sessions(e, turns, calls, workspaces)
    named = stored(sessions.select("path", "session_id"), "sessions")
    of = lambda df: df.join(named, "path")
    note = {"annotator": "adapter", "category": "data-quality"}
    open_ = of(calls.where(~F.col("complete"))).select("session_id", F.concat(F.lit("ann-copilot-incomplete-tool-"), _short_id(F.col("tool_call_id"))).alias("annotation_id"), F.lit("tool_call").alias("scope_type"), F.col("tool_call_id").alias("target_id"), F.lit("Incomplete Copilot tool call").alias("title"), F.lit(NO_COMPLETION).alias("detail"), F.lit('["copilot","tool-call","incomplete"]').alias("tags_json"))
    if bad is not None:
        line = F.col("line_no").cast("string")
        open_ = open_.unionByName(of(bad).select("session_id", F.concat(F.lit("ann-copilot-bad-json-"), line).alias("annotation_id"), F.lit("session").alias("scope_type"), F.col("session_id").alias("target_id"), F.concat(F.lit("Skipped malformed Copilot JSONL line "), line).alias("title"), F.col("message").alias("detail"), F.lit('["copilot","jsonl","malformed"]').alias("tags_json")))
    return {
        "sessions": conform(sessions, "sessions"),
        "turns": conform(of(turns), "turns"),
        "tool_calls": conform(of(calls), "tool_calls"),
        "turn_tool_calls": conform(of(_listed(e, idx, tools)), "turn_tool_calls"),
        "events": conform(of(_lifecycle(e, idx, F.when(F.col("kind") == "session.start", _some(_j("$.data.sessionId"))))), "events"),
        "annotations": conform(open_.select("*", *[F.lit(v).alias(k) for k, v in note.items()]), "annotations"),
        "metrics": conform(metrics, "metrics"),
    }
