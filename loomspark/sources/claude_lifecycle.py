"""claude-code logs as sessions: turns, tool uses paired with their results, lifecycle events, attachments.

A use waits until a result of its id comes: uses and results of an id form intervals in the order of the log, which
windows match.  A use that another use of its id follows first is forgotten, a use without a result is an
orphan and failed, a result that nothing waits for is told by unmatched_results().  Interruption, exit codes and errors come from what
the log says beside the result.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.metrics import call_metrics, home_to_tilde, idle_ratio, names_home, outcome_status, quality, timing, turn_metrics
from loomspark.operators.sequence import truncated_ratio
from loomspark.schema import conform
from loomspark.sources.cache import stored
from loomspark.sources.claude_code import classified, content_origin, operation, spawned

# Records without a place in the session, modes by autonomy, marks of images, limits.
SKIPPED = ("file-history-snapshot", "last-prompt", "progress")
AUTONOMY = {"bypassPermissions": "full-auto", "plan": "suggest"}
LIFECYCLE = {
    "mode": ("mode", "mode_change", "Claude Code mode change"),
    "permission-mode": ("permissionMode", "permission_mode_change", "Claude Code permission mode change"),
    "ai-title": ("aiTitle", "title_change", "Claude Code title change"),
}
IMAGE_ENDS = (".png", ".jpg", ".jpeg", ".webp")
EXIT_CODE = r"^Error: Exit code (\d+)"
INTERRUPTED = "interrupted by user"
NO_RESULT = "the log ends without a result of this call"
RESULT_BYTES, RESULT_TOTAL, RESULT_FIELD, STDERR_CHARS, ERROR_CHARS, PREVIEW_CHARS, TITLE_CHARS, ID_CHARS = 10240, 16 * 1024, 2 * 1024, 1024, 500, 240, 80, 8

_BLOCK = "struct<type:string,text:string,thinking:string,signature:string,id:string,name:string,input:string,caller:string,tool_use_id:string,content:string,is_error:boolean>"


def _j(path: str, c: str = "value") -> Column:
    return F.get_json_object(c, path)


def _some(*columns: Column) -> Column:
    """The first that isn't empty, or null."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def _type(path: str, c: str = "value") -> Column:
    """STRING, OBJECT<...>, ARRAY<...>, ... of a JSON value, VOID without one."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant")), F.lit("VOID"))


def _blocks(content: Column, schema: str) -> Column:
    """The objects of an array, null for any other content; what isn't an object is passed over."""
    each = F.from_json(F.when(content.startswith("["), content), "array<string>")
    return F.transform(F.filter(each, lambda x: F.startswith(x, F.lit("{"))), lambda x: F.from_json(x, schema))


def _text_of(content: Column) -> Column:
    """A content as text: a string, or the texts of its blocks, one a line."""
    blocks = _blocks(content, "struct<type:string,text:string,thinking:string,content:string>")
    each = F.transform(blocks, lambda b: F.when(b["type"] == "thinking", b["thinking"]).when(b["type"] == "tool_result", b["content"]).otherwise(b["text"]))
    return F.coalesce(F.array_join(F.filter(each, lambda t: t != ""), "\n"), content, F.lit(""))


def cut_result(text: Column) -> dict[str, Column]:
    """result, truncated, full_bytes and full_hash: more than 10 KiB are cut at a whole character and marked."""
    size = F.octet_length(text)
    long = size > RESULT_BYTES
    head = F.rtrim(F.make_valid_utf8(F.substring(text.cast("binary"), 1, RESULT_BYTES).cast("string")), F.lit("�"))
    return {"result": F.when(long, F.concat(head, F.lit("\n[truncated]"))).otherwise(text), "truncated": F.coalesce(long, F.lit(False)).cast("long"), "full_bytes": F.when(long, size).cast("long"), "full_hash": F.when(long, F.concat(F.lit("sha256:"), F.sha2(text, 256)))}


def _cap(texts: pd.Series) -> pd.Series:
    """Objects beyond the total limit with each long field cut."""

    def one(text: str | None) -> str | None:
        if text is None or len(text.encode()) <= RESULT_TOTAL:
            return text
        out = {}
        for k, v in json.loads(text).items():
            flat = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
            out[k] = flat[:RESULT_FIELD] if len(flat) > RESULT_FIELD or isinstance(v, str) else v
        return json.dumps(out, ensure_ascii=False)

    return texts.map(one)


def _meta(slug: bool = True) -> list[Column]:
    """What records tell of themselves, as columns of a metadata struct; what is not there is left out of its JSON."""
    names = {"entrypoint": "entrypoint", "agent_id": "agentId", "session_id": "sessionId", "parent_uuid": "parentUuid", "attribution_agent": "attributionAgent"} if not slug else {"entrypoint": "entrypoint", "slug": "slug", "agent_id": "agentId", "session_id": "sessionId", "parent_uuid": "parentUuid"}
    return [*[_some(_j(f"$.{p}")).alias(n) for n, p in names.items()], (_j("$.isSidechain") == "true").alias("is_sidechain")]


def _records(lines: DataFrame) -> DataFrame:
    r = lines.select("path", "line_no", "value", F.coalesce(_j("$.type"), F.lit("")).alias("kind"), _some(_j("$.timestamp")).alias("timestamp"), _j("$.message.content").alias("content"), _some(_j("$.message.model")).alias("said_model"))
    r = r.where(~F.col("kind").isin(*SKIPPED)).join(classified(lines), ["path", "line_no"])
    r = r.withColumn("blocks", _blocks(F.col("content"), _BLOCK))
    results = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    is_turn = F.col("kind").isin("system", "assistant") | ((F.col("kind") == "user") & ~results)
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    model = F.last(F.when(F.col("kind") == "assistant", F.col("said_model")), ignorenulls=True).over(so_far)
    return stored(r.withColumn("turn_index", F.when(is_turn, F.count_if(is_turn).over(so_far) - 1)).withColumn("model", model), "records")


def _turns(r: DataFrame) -> DataFrame:
    blocks, assistant = F.col("blocks"), F.col("kind") == "assistant"
    of = lambda kind, field: F.array_join(F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: b[field]), lambda t: t != ""), "\n")
    texts = of("text", "text")
    plain = _text_of(F.col("content"))
    content = F.when(assistant, F.coalesce(texts, F.lit(""))).when(F.col("kind") == "system", F.coalesce(F.nullif(texts, F.lit("")), plain)).otherwise(plain)
    signed = F.size(F.filter(blocks, lambda b: (b["type"] == "thinking") & (b["signature"] != "")))
    used = lambda n: F.when(assistant, F.nullif(_j(f"$.message.usage.{n}").try_cast("long"), F.lit(0)))
    stops = [_j("$.message.stop_reason").alias("stop_reason"), _j("$.message.stop_sequence").alias("stop_sequence"), F.try_parse_json(_j("$.message.usage.cache_creation")).alias("cache_creation"), F.when(assistant & (signed > 0), signed).alias("signed_thinking_blocks"), F.when(assistant & (signed > 0), True).alias("thinking_signature_present")]
    return r.where("turn_index is not null").select(
        "path", "turn_index", "timestamp", F.col("kind").alias("role"), F.when(F.col("kind") == "system", "framework").otherwise(F.col("source")).alias("source"), F.when(assistant, F.col("model")).alias("model"), F.when(~assistant, F.col("input_channel")).alias("input_channel"), content.alias("content"),
        F.when(assistant, _some(of("thinking", "thinking"))).alias("thinking"), assistant.cast("long").alias("was_streamed"), used("input_tokens").alias("input_tokens"), used("output_tokens").alias("output_tokens"), used("cache_read_input_tokens").alias("cache_read_tokens"), used("cache_creation_input_tokens").alias("cache_creation_tokens"),
        F.to_json(F.struct(*_meta(), *stops)).alias("framework_metadata_json"),
    )


def _ends(r: DataFrame) -> DataFrame:
    """Uses and results with what stands beside them in order: (path, line_no, part, call, what, before, use_line, use_part, after, ...)."""
    b = r.where(F.col("kind").isin("user", "assistant")).select("path", "line_no", "kind", "timestamp", "value", "turn_index", F.posexplode("blocks").alias("part", "b"))
    is_use = (F.col("kind") == "assistant") & (F.col("b.type") == "tool_use")
    is_result = (F.col("kind") == "user") & (F.col("b.type") == "tool_result")
    b = b.where(is_use | is_result).withColumn("what", F.when(is_use, "use").otherwise("result"))
    in_order = Window.partitionBy("path").orderBy("line_no", "part").rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.count_if(F.col("what") == "use").over(in_order), F.lit(0))
    b = b.withColumn("call", F.when(F.col("what") == "result", F.coalesce("b.tool_use_id", F.lit(""))).otherwise(F.coalesce(_some(F.col("b.id")), F.format_string("tc-%04d", number))))
    w = Window.partitionBy("path", "call").orderBy("line_no", "part")
    return b.withColumns({"before": F.lag("what").over(w), "use_line": F.lag("line_no").over(w), "use_part": F.lag("part").over(w), "after": F.lead("what").over(w)})


def unmatched_results(lines: DataFrame) -> DataFrame:
    """(path, line_no, tool_call_id, message) of results that no use of their id waits for: never called, or answered before."""
    lost = _ends(_records(lines)).where("what = 'result' and coalesce(before, '') <> 'use'")
    return lost.select("path", "line_no", F.col("call").alias("tool_call_id"), F.when(F.col("before") == "result", "a second result of this call").otherwise("a result without a call").alias("message"))


def _calls(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, those that repeat an id): all uses but forgotten ones, with their results."""
    uses = ends.where("what = 'use'")
    results = ends.where("what = 'result' and before = 'use'").select("path", F.col("use_line").alias("line_no"), F.col("use_part").alias("part"), F.col("b.content").alias("r_content"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), F.col("timestamp").alias("r_time"), F.col("value").alias("r_value"), F.col("line_no").alias("r_line"))
    c = uses.where("after is null or after = 'result'").join(results, ["path", "line_no", "part"], "left")
    done, name, given = F.col("r_line").isNotNull(), F.col("b.name"), F.col("b.input")
    arg = lambda *names: _some(*[F.get_json_object(given, f"$.{n}") for n in names])
    beside, kind = _j("$.toolUseResult", "r_value"), _type("$.toolUseResult", "r_value")
    is_text, is_object = kind == "STRING", kind.startswith("OBJECT")
    interrupted = F.coalesce(is_object & (F.get_json_object(beside, "$.interrupted") == "true"), F.lit(False))
    stderr = F.when(is_object & F.col("is_error"), F.get_json_object(beside, "$.stderr"))
    code = F.when(is_text, F.nullif(F.regexp_extract(beside, EXIT_CODE, 1), F.lit(""))).when(is_object, F.coalesce(F.get_json_object(beside, "$.exitCode"), F.get_json_object(beside, "$.exit_code")))
    text = F.when(done, _text_of(F.col("r_content")))
    success = done & ~F.col("is_error") & ~interrupted
    error = F.when(~done, NO_RESULT).when(interrupted, INTERRUPTED).when(F.trim(stderr) != "", F.substring(stderr, 1, STDERR_CHARS)).when(F.col("is_error"), F.substring(text, 1, ERROR_CHARS))
    ms = F.unix_millis(F.try_to_timestamp("r_time")) - F.unix_millis(F.try_to_timestamp("timestamp"))
    cap = F.pandas_udf(_cap, "string")
    kept = F.when(is_text, F.to_json(F.struct(F.substring(beside, 1, RESULT_FIELD).alias("t")))).when(is_object, F.concat(F.lit('{"t":'), cap(F.when(is_object, beside)), F.lit("}"))).when(kind != "VOID", F.concat(F.lit('{"t":'), beside, F.lit("}")))
    meta = F.to_json(F.struct(F.try_parse_json(F.col("b.caller")).alias("caller"), *_meta(), F.try_variant_get(F.try_parse_json(kept), "$.t", "variant").alias("tool_use_result"), F.when(interrupted, True).alias("interrupted")))
    c = c.select(
        "path", F.col("call").alias("tool_call_id"), "line_no", "part", F.col("turn_index").alias("emitting_turn_index"), F.coalesce("timestamp", "r_time").alias("timestamp"), F.coalesce(name, F.lit("")).alias("tool_name"), operation(F.coalesce(name, F.lit(""))).alias("operation_type"), arg("file_path", "path").alias("file_path"),
        arg("command").alias("command"), given.alias("arguments_json"), F.lit("tool_call").alias("record_kind"), F.coalesce(success, F.lit(False)).cast("long").alias("success"), outcome_status(F.coalesce(success, F.lit(False)), F.lit(None).cast("string")).alias("outcome_status"),
        *[v.alias(k) for k, v in cut_result(text).items()], error.alias("error"), code.try_cast("long").alias("exit_code"), F.when(ms >= 0, ms).alias("duration_ms"), content_origin(F.coalesce(name, F.lit(""))).alias("content_origin"), meta.alias("framework_metadata_json"), done.alias("answered"),
    )
    c = spawned(c)
    order = [F.coalesce("timestamp", F.lit("")), "line_no", "part"]
    again = F.row_number().over(Window.partitionBy("path", "tool_call_id").orderBy(*order))
    c = stored(c.withColumn("again", again), "calls")
    first = c.where("again = 1").drop("again")
    place = F.row_number().over(Window.partitionBy("path").orderBy(*order)) - 1
    before = F.collect_list("tool_name").over(Window.partitionBy("path").orderBy(*order).rowsBetween(-5, -1))
    first = first.withColumn("source_ordinal", place.cast("long")).withColumn("tools_before_json", F.to_json(before))
    total = F.count(F.lit(1)).over(Window.partitionBy("path"))
    return first.withColumn("position_in_session", F.col("source_ordinal") / total), c.where("again > 1").select("path")


def _lifecycle(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, attachments)."""
    kind, a = F.col("kind"), lambda n: _j(f"$.attachment.{n}")
    pick = lambda i: F.coalesce(*[F.when(kind == k, v[i]) for k, v in LIFECYCLE.items()])
    said = F.coalesce(*[F.when(kind == k, _some(_j(f"$.{v[0]}"))) for k, v in LIFECYCLE.items()])
    e = r.withColumn("said", said).where((kind == "attachment") | F.col("said").isNotNull())
    w = Window.partitionBy("path").orderBy("line_no")
    number = F.count_if(kind == "attachment").over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("attachment_id", F.when(kind == "attachment", F.coalesce(_some(_j("$.uuid")), F.format_string("attachment-%d", number))))
    event_id = F.format_string("claude-%s-%06d", F.coalesce(F.replace(pick(1), F.lit("_"), F.lit("-")), F.lit("attachment")), "ordinal")
    media = _some(a("mediaType"), a("mimeType"))
    signal = [F.lower(F.coalesce(a(n), F.lit(""))) for n in ("type", "fileName", "mediaType", "mimeType")]
    image = F.greatest(*[F.contains(s, F.lit("image")) | F.coalesce(*[F.when(F.endswith(s, F.lit(x)), True) for x in IMAGE_ENDS], F.lit(False)) for s in signal])
    of_type = F.coalesce(_some(a("type")), F.lit("attachment"))
    labelled = {"uuid": _j("$.uuid"), "parent_uuid": _j("$.parentUuid"), "agent_id": _j("$.agentId"), "type": a("type"), "file": a("fileName"), "media": media, "items": F.nullif(a("itemCount"), F.lit("0")), "content": F.substring(a("content"), 1, PREVIEW_CHARS)}
    summary = F.nullif(F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), _some(v)) for k, v in labelled.items()]), F.lit(""))
    summary = F.when(_j("$.attachment").isNull(), "Claude Code attachment with no structured payload.").otherwise(F.coalesce(summary, F.lit("Claude Code attachment metadata preserved.")))
    about = F.to_json(F.struct(*_meta(slug=False), F.when(kind == "attachment", of_type).alias("attachment_type"), F.when(kind == "attachment", image).alias("has_image_signal")))
    e = e.withColumn("event_id", event_id).withColumn("about", about)
    events = e.select("path", "event_id", "timestamp", F.col("ordinal").cast("long").alias("ordinal"), F.coalesce(pick(1), F.lit("attachment")).alias("kind"), F.lit("system").alias("role"), "attachment_id", F.coalesce(pick(2), F.lit("Claude Code attachment")).alias("title"), F.coalesce("said", summary).alias("summary"), F.col("about").alias("framework_metadata_json"), F.col("value").alias("raw_json"))
    size = F.nullif(F.coalesce(a("sizeBytes"), a("fileSize")).try_cast("long"), F.lit(0))
    attachments = e.where("attachment_id is not null").select(
        "path", "attachment_id", "timestamp", F.when(image, "image").otherwise(of_type).alias("kind"), F.coalesce(_some(a("fileName"), a("name")), F.col("attachment_id")).alias("name"), media.alias("media_type"), home_to_tilde(_some(a("path"), a("filePath"))).alias("path_"), a("url").alias("url"), size.alias("size_bytes"),
        _some(a("hash"), a("sha256"), a("contentHash")).alias("hash"), _some(a("contentRef"), a("reference"), a("ref")).alias("content_ref"), _some(F.substring(a("content"), 1, PREVIEW_CHARS)).alias("text_preview"), "event_id", F.col("about").alias("framework_metadata_json"), F.col("value").alias("raw_json"),
    )
    return events, attachments


def _sessions(lines: DataFrame, r: DataFrame) -> DataFrame:
    at = lambda c: F.when(c.isNotNull(), F.col("line_no"))
    first = lambda c: F.min_by(c, at(c))
    last = lambda c: F.max_by(c, at(c))
    value = lambda n: _some(_j(f"$.{n}"))
    kept = {"entrypoint": "entrypoint", "agent_id": "agentId", "parent_uuid": "parentUuid", "is_sidechain": "isSidechain", "user_type": "userType", "attribution_agent": "attributionAgent"}
    said = lines.withColumn("kind", _j("$.type"))
    on = lambda k, n: F.when(F.col("kind") == k, value(n))
    s = said.groupBy("path").agg(
        first(value("sessionId")).alias("session_id"), last(value("sessionId")).alias("last_session"), first(value("cwd")).alias("cwd"), first(value("version")).alias("agent_version"), first(value("gitBranch")).alias("git_branch"), *[last(value(p)).alias(n) for n, p in kept.items()],
        last(on("mode", "mode")).alias("mode"), last(on("permission-mode", "permissionMode")).alias("permission_mode"), last(on("ai-title", "aiTitle")).alias("ai_title"),
        last(F.when((F.col("kind") == "permission-mode") & value("permissionMode").isin(*AUTONOMY), F.coalesce(*[F.when(value("permissionMode") == k, v) for k, v in AUTONOMY.items()]))).alias("autonomy_level"),
    )
    model = r.groupBy("path").agg(F.max_by("model", F.when(F.col("model").isNotNull(), F.col("line_no"))).alias("model"))
    config = F.to_json(F.struct(*[F.when(F.col(n).isin("true", "false"), F.col(n) == "true").alias(n) if n == "is_sidechain" else F.col(n) for n in kept], F.col("last_session").alias("session_id"), "mode", "permission_mode", "ai_title"))
    return s.join(model, "path", "left").select("path", F.coalesce("session_id", "path").alias("session_id"), home_to_tilde(F.col("cwd")).alias("working_directory"), "agent_version", "git_branch", "autonomy_level", "ai_title", "model", F.nullif(config, F.lit("{}")).alias("framework_config_json"))


def convert(lines: DataFrame) -> dict[str, DataFrame]:
    """sessions, turns, tool_calls, turn_tool_calls, events, attachments, annotations and metrics of logs (path, line_no, value).

    Records with results alone make no turn.  Of calls that repeat an id the earliest stays, which an annotation tells.
    No lines give empty tables.
    """
    r = _records(lines)
    turns = _turns(r)
    calls, repeated = _calls(_ends(r))
    sessions = stored(_sessions(lines, r), "sessions")
    named = sessions.select("path", "session_id")
    of = lambda df: df.join(named, "path")
    turns, calls = stored(conform(of(turns), "turns"), "turns"), stored(of(calls), "calls")
    events, attachments = _lifecycle(r)
    open_ = calls.where(~F.col("answered")).select(
        "session_id", F.concat(F.lit("ann-orphan-"), F.substring("tool_call_id", 1, ID_CHARS)).alias("annotation_id"), F.lit("tool_call").alias("scope_type"), F.col("tool_call_id").alias("target_id"), F.format_string("Tool call %s never received result", "tool_name").alias("title"),
        F.format_string("tool_use id=%s has no matching tool_result. Model may have crashed or timed out.", "tool_call_id").alias("detail"), F.lit('["data-quality","orphan-tool-call"]').alias("tags_json"),
    )
    # annotation ids are cut: those that fall together are told apart by their call
    same = Window.partitionBy("session_id", "annotation_id").orderBy("target_id")
    open_ = open_.withColumn("_n", F.row_number().over(same)).withColumn("annotation_id", F.when(F.col("_n") > 1, F.concat_ws("-", F.lit("ann-orphan"), "target_id")).otherwise(F.col("annotation_id"))).drop("_n")
    doubled = of(repeated).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select(
        "session_id", F.concat(F.lit("ann-dedup-"), F.substring("session_id", 1, ID_CHARS)).alias("annotation_id"), F.lit("session").alias("scope_type"), F.col("session_id").alias("target_id"), F.format_string("Deduplicated %d duplicate tool calls", "n").alias("title"),
        F.format_string("Removed %d tool calls with duplicate IDs.", "n").alias("detail"), F.lit('["deduplication","data-quality"]').alias("tags_json"),
    )
    notes = open_.unionByName(doubled).withColumn("annotator", F.lit("adapter")).withColumn("category", F.lit("observation"))
    stamps = of(r.select("path", F.try_to_timestamp("timestamp").alias("ts"), "timestamp"))
    span = stamps.where("ts is not null").groupBy("session_id").agg(F.min_by("timestamp", "ts").alias("started_at"), F.max_by("timestamp", "ts").alias("ended_at"))
    when = timing(stamps.select("session_id", "ts")).drop("ended")
    m = named.select("session_id").join(turn_metrics(turns), "session_id", "left").join(call_metrics(calls), "session_id", "left").join(when, "session_id", "left").fillna(0, ["turn_count", "tool_call_count", "read_count", "modify_count", "create_count", "execute_count", "delegate_count", "subagent_count"])
    acted = seconds_after(F.col("started"), F.try_to_timestamp("first_call"))
    m = stored(m.withColumns({"idle_ratio": idle_ratio(F.col("active_duration_seconds"), F.col("duration_seconds")), "time_to_first_action": acted, "read_ratio": truncated_ratio(F.col("read_count"), F.col("tool_call_count"))}).drop("timestamp"), "metrics")
    pii = calls.groupBy("session_id").agg(names_home("file_path").alias("pii"))
    blank = F.trim(F.replace("content", F.lit("\n"), F.lit(" ")))
    human = turns.where((F.col("role") == "user") & (F.col("source") == "human") & (blank != "")).groupBy("session_id").agg(F.min_by(F.substring(blank, 1, TITLE_CHARS), "turn_index").alias("said"))
    tools = calls.where("tool_name <> ''").groupBy("session_id").agg(F.to_json(F.array_sort(F.collect_set("tool_name"))).alias("tools_enabled_json"))
    s = sessions.join(m, "session_id").join(span, "session_id", "left").join(pii, "session_id", "left").join(human, "session_id", "left").join(tools, "session_id", "left")
    grade, private = quality(F.col("turn_count"), F.col("tool_call_count"), F.coalesce("any_result", F.lit(False))), F.coalesce("pii", F.lit(False))
    s = s.withColumns({
        "quality": grade, "title": F.coalesce("ai_title", "said"), "contains_pii": private.cast("long"), "for_research": ((grade == "A") & ~private).cast("long"), "needs_cleaning": ((grade != "A") | private).cast("long"), "classification": F.when(private, "confidential").otherwise("internal"),
        "agent_framework": F.lit("claude-code"), "platform_type": F.lit("agent"), "provider_hint": F.lit("anthropic"), "source_format": F.lit("claude-code-jsonl-v2"), "source_path": F.col("path"),
    })
    listed = F.row_number().over(Window.partitionBy("session_id", "emitting_turn_index").orderBy("line_no", "part")) - 1
    return {
        "sessions": conform(s, "sessions"),
        "turns": turns,
        "tool_calls": conform(calls, "tool_calls"),
        "turn_tool_calls": conform(calls.where("emitting_turn_index is not null").select("session_id", F.col("emitting_turn_index").alias("turn_index"), "tool_call_id", listed.alias("ordinal")), "turn_tool_calls"),
        "events": conform(of(events), "events"),
        "attachments": conform(of(attachments).drop("path").withColumnRenamed("path_", "path"), "attachments"),
        "annotations": conform(notes, "annotations"),
        "metrics": conform(m, "metrics"),
    }


def seconds_after(a: Column, b: Column) -> Column:
    """Seconds from a to b, null if b comes first."""
    ms = F.unix_millis(b) - F.unix_millis(a)
    return F.when(ms >= 0, ms / 1000)
