"""Native logs and exports to turns and tool calls.

Each format is mapped to one list of items (texts, calls and results with their place
in the log); a common plan pairs calls with results by id and groups texts to turns.
Everything is keyed by source path, so sessions never mix and the joins are
co-located on one key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.metrics import outcome_status
from loomspark.operators.sequence import keep_first
from loomspark.schema import conform
from loomspark.sources import claude_lifecycle, codex_sessions, copilot

NO_RESULT = "the log ends without a result of this call"
ERROR_CHARS = 500

_ITEM = {
    "path": "string", "line_no": "long", "part": "int", "item": "string", "role": "string", "text": "string", "call_id": "string", "tool_name": "string", "arguments": "string", "is_error": "boolean", "timestamp": "string", "model": "string",
    "input_tokens": "long", "output_tokens": "long", "cache_read_tokens": "long", "cache_creation_tokens": "long",
}


def _j(path: str, c: str = "value") -> Column:
    return F.get_json_object(c, path)


def _items(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in _ITEM.items()])


def _parts(content: Column, schema: str) -> Column:
    """Content that is either a text or an array of parts, as an array of parts."""
    parsed = F.from_json(content, f"array<struct<{schema}>>")
    return F.when(content.startswith("["), parsed)


def pi_items(lines: DataFrame) -> DataFrame:
    m = lines.where(_j("$.type") == "message").select("path", "line_no", _j("$.message.role").alias("who"), _j("$.message.content").alias("content"), F.coalesce(_j("$.message.timestamp"), _j("$.timestamp")).alias("timestamp"), _j("$.message.model").alias("model"), _j("$.message.toolCallId").alias("result_of"), _j("$.message.toolName").alias("tool_name"), _j("$.message.isError").alias("err"), *[_j(f"$.message.usage.{a}").alias(b) for a, b in (("input", "input_tokens"), ("output", "output_tokens"), ("cacheRead", "cache_read_tokens"), ("cacheWrite", "cache_creation_tokens"))])
    parts = _parts(F.col("content"), "type:string,text:string,thinking:string,id:string,name:string,arguments:string")
    results = m.where("who = 'toolResult'").select("path", "line_no", F.lit(0).alias("part"), F.lit("result").alias("item"), F.col("result_of").alias("call_id"), "tool_name", F.coalesce(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), "content").alias("text"), (F.col("err") == "true").alias("is_error"), "timestamp")
    said = m.where("who <> 'toolResult'").select("*", F.posexplode(F.coalesce(parts, F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("thinking", "id", "name", "arguments")])))).alias("part", "p"))
    p = F.col("p")
    kind = F.when(p["type"] == "toolCall", "call").when(p["type"] == "thinking", "thinking").otherwise("text")
    said = said.select("path", "line_no", "part", kind.alias("item"), F.col("who").alias("role"), F.coalesce(p["text"], p["thinking"]).alias("text"), p["id"].alias("call_id"), p["name"].alias("tool_name"), p["arguments"].alias("arguments"), "timestamp", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return _items(said).unionByName(_items(results))


def claude_ai_items(conversations: DataFrame) -> DataFrame:
    """conversations: (path, conversation_id, value) of an export; path becomes the conversation's id."""
    messages = F.from_json(_j("$.chat_messages"), "array<struct<sender:string,text:string,created_at:string,content:array<struct<type:string,text:string,name:string,input:string,content:string,is_error:boolean>>>>")
    m = conversations.select(F.col("conversation_id").alias("path"), F.posexplode(messages).alias("line_no", "m"))
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("m.text").alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("name", "input", "content")], F.lit(None).cast("boolean").alias("is_error")))
    e = m.select("*", F.posexplode(F.when(F.size("m.content") > 0, F.col("m.content")).otherwise(plain)).alias("part", "p"))
    p, order = F.col("p"), Window.partitionBy("path", "line_no").orderBy("part")
    kind = F.when(p["type"] == "tool_use", "call").when(p["type"] == "tool_result", "result").otherwise("text")
    e = e.select("*", kind.alias("item"))
    # a use is answered by the next block of its message only
    call = F.when(F.col("item") == "call", F.col("part")).when((F.col("item") == "result") & (F.lag("item").over(order) == "call"), F.lag("part").over(order))
    return _items(e.select("path", "line_no", "part", "item", F.when(F.col("m.sender") == "human", "user").otherwise("assistant").alias("role"), F.coalesce(p["text"], p["content"]).alias("text"), F.concat_ws("-", "line_no", call).alias("call_id"), p["name"].alias("tool_name"), p["input"].alias("arguments"), p["is_error"].alias("is_error"), F.col("m.created_at").alias("timestamp")))


def _linear(value: str) -> Iterator[tuple]:
    """Messages of a ChatGPT tree from the root to the current node."""
    doc = json.loads(value)
    nodes, at, chain, seen = doc.get("mapping") or {}, doc.get("current_node"), [], set()
    while at in nodes and at not in seen:
        seen.add(at)
        chain.append(nodes[at])
        at = nodes[at].get("parent")
    for node in reversed(chain):
        m = node.get("message") or {}
        meta, role = m.get("metadata") or {}, (m.get("author") or {}).get("role")
        if not role or meta.get("is_visually_hidden_from_conversation") or (role == "system" and m.get("weight") == 0):
            continue
        content = m.get("content") or {}
        text = "\n".join(p if isinstance(p, str) else p.get("text", "") for p in content.get("parts") or []) or content.get("text") or ""
        if text.strip() or role == "user":
            yield "system" if role == "tool" else role, text, m.get("create_time"), meta.get("model_slug")


def chatgpt_items(conversations: DataFrame) -> DataFrame:
    """conversations: (path, conversation_id, value); the tree is walked per conversation, path becomes its id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, i, role, text, at, model) for key, value in zip(pdf["conversation_id"], pdf["value"]) for i, (role, text, at, model) in enumerate(_linear(value))]
            yield pd.DataFrame(rows, columns=["path", "line_no", "role", "text", "at", "model"])

    m = conversations.select("conversation_id", "value").mapInPandas(run, "path string, line_no long, role string, text string, at double, model string")
    return _items(m.select("path", "line_no", F.lit(0).alias("part"), F.lit("text").alias("item"), "role", "text", F.date_format(F.timestamp_micros((F.col("at") * 1000000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "model"))


def operation(tool: Column, command: Column) -> Column:
    """READ, MODIFY, NEW, EXECUTE, DELEGATE or OTHER by tool name, for shells by the command's first word."""
    t, c = F.lower(F.coalesce(tool, F.lit(""))), F.ltrim(F.coalesce(command, F.lit("")))
    shell = t.isin("bash", "shell", "exec", "exec_command", "local_shell", "run_terminal_cmd")
    return (
        F.when(shell & c.rlike(r"^(cat|ls|head|tail|grep|rg|find|wc|stat|git (status|log|diff|show))\b") & ~c.contains(">"), "READ")
        .when(shell, "EXECUTE")
        .when(t.isin("read", "view", "grep", "glob", "ls", "search", "webfetch", "websearch", "notebookread"), "READ")
        .when(t.isin("write", "create", "create_file"), "NEW")
        .when(t.isin("edit", "multiedit", "notebookedit", "apply_patch", "str_replace", "str_replace_editor"), "MODIFY")
        .when(t.isin("task", "agent", "spawn", "delegate"), "DELEGATE")
        .otherwise("OTHER")
    )


def turns_of(items: DataFrame) -> DataFrame:
    """Records with a text, thought or call as turns; records that only carry results make none."""
    said = items.where("item <> 'result'")
    ordered = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("item") == kind, F.struct("part", F.coalesce("text", F.lit("")).alias("text"))))), lambda s: s["text"]), "\n")
    first = lambda c: F.max(c).alias(c)
    g = said.groupBy("path", "line_no").agg(F.min("role").alias("role"), ordered("text").alias("content"), F.nullif(ordered("thinking"), F.lit("")).alias("thinking"), *[first(c) for c in ("timestamp", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])
    index = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    return g.withColumn("turn_index", index.cast("long")).withColumn("source", F.when(F.col("role") == "user", "human").otherwise("framework"))


def calls_of(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Calls with their results: the first of each id; a call without a result failed."""
    calls = keep_first(items.where("item = 'call'"), ["path", "call_id"], ["line_no", "part"])
    results = keep_first(items.where("item = 'result'"), ["path", "call_id"], ["line_no", "part"]).where("coalesce(call_id, '') <> ''")
    r = results.select("path", "call_id", F.col("text").alias("result"), F.col("is_error").alias("failed"), F.col("timestamp").alias("ended"), F.lit(True).alias("answered"))
    at = turns.select("path", "line_no", F.col("turn_index").alias("emitting_turn_index"))
    c = calls.drop("is_error").join(r, ["path", "call_id"], "left").join(at, ["path", "line_no"], "left")
    command = F.coalesce(*[F.get_json_object("arguments", f"$.{n}") for n in ("command", "cmd", "script")])
    path = F.coalesce(*[F.get_json_object("arguments", f"$.{n}") for n in ("file_path", "path", "filePath", "filename", "notebook_path")])
    success = F.when(F.col("answered").isNull(), F.lit(False)).otherwise(~F.coalesce("failed", F.lit(False)))
    ms = F.unix_millis(F.try_to_timestamp("ended")) - F.unix_millis(F.try_to_timestamp("timestamp"))
    ordinal = F.row_number().over(Window.partitionBy("path").orderBy("line_no", "part")) - 1
    return c.select(
        "path", F.col("call_id").alias("tool_call_id"), ordinal.cast("long").alias("source_ordinal"), "emitting_turn_index", "timestamp", "tool_name", operation(F.col("tool_name"), command).alias("operation_type"), path.alias("file_path"), command.alias("command"),
        F.col("arguments").alias("arguments_json"), success.cast("long").alias("success"), outcome_status(success, F.lit(None).cast("string")).alias("outcome_status"), F.when(success, F.col("result")).alias("result"),
        F.when(~success, F.substring(F.coalesce("result", F.lit(NO_RESULT)), 1, ERROR_CHARS)).alias("error"), F.when(ms >= 0, ms).alias("duration_ms"), F.lit("tool_call").alias("record_kind"), F.col("answered").isNull().alias("orphan"),
    )


def headers(lines: DataFrame, framework: str) -> DataFrame:
    """(path, session_id, agent_framework, working_directory, agent_version, git_branch): the first non-empty value of each."""
    names = {"session_id": ("$.sessionId", "$.payload.id", "$.data.sessionId", "$.id"), "working_directory": ("$.cwd", "$.payload.cwd", "$.data.cwd", "$.data.context.cwd"), "agent_version": ("$.version", "$.payload.cli_version", "$.data.copilotVersion"), "git_branch": ("$.gitBranch", "$.payload.git.branch")}
    # only the first header names the session: replays of a parent come later
    cols = [F.min_by(F.nullif(F.coalesce(*[_j(p) for p in ps]), F.lit("")), F.when(F.nullif(F.coalesce(*[_j(p) for p in ps]), F.lit("")).isNotNull(), F.col("line_no"))).alias(n) for n, ps in names.items()]
    return lines.groupBy("path").agg(*cols).withColumn("agent_framework", F.lit(framework))


ITEMS: dict[str, Callable[[DataFrame], DataFrame]] = {"pi": pi_items}
#: Formats with a conversion of their own.
WHOLE: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {"claude-code": claude_lifecycle.convert, "codex": codex_sessions.convert, "copilot": copilot.convert}
#: Formats that convert() knows.
FORMATS = (*ITEMS, *WHOLE)


def convert(lines: DataFrame, framework: str) -> dict[str, DataFrame]:
    """sessions, turns, tool_calls and annotations of logs of one format, and what else it tells.  lines: (path, line_no, value)."""
    if framework in WHOLE:
        return WHOLE[framework](lines)
    items = ITEMS[framework](lines)
    turns = turns_of(items)
    calls = calls_of(items, turns)
    head = headers(lines, framework)
    named = head.select("path", F.coalesce("session_id", "path").alias("session_id"))
    span = items.groupBy("path").agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.max("model").alias("model"))
    orphans = calls.where("orphan").join(named, "path").select("session_id", F.concat(F.lit("orphan-"), "tool_call_id").alias("annotation_id"), F.lit("adapter").alias("annotator"), F.lit("tool_call").alias("scope_type"), F.col("tool_call_id").alias("target_id"), F.lit("observation").alias("category"), F.lit("call without a result").alias("title"), F.lit("").alias("detail"))
    return {
        "sessions": conform(head.drop("session_id").join(named, "path").join(span, "path", "left").withColumn("source_path", F.col("path")).withColumn("source_format", F.lit(f"{framework}-jsonl")), "sessions"),
        "turns": conform(turns.join(named, "path"), "turns"),
        "tool_calls": conform(calls.join(named, "path"), "tool_calls"),
        "annotations": conform(orphans, "annotations"),
    }
