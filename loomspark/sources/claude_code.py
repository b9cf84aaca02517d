"""What claude-code logs tell beyond messages and calls: origins, folders without a transcript, sessions of subagents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Operations and origins by tool, and marks of injected text.
OPERATIONS = {
    "READ": ("Read", "Glob", "Grep", "TaskGet", "TaskList", "TaskOutput", "WebFetch", "WebSearch", "ToolSearch"), "MODIFY": ("Edit", "NotebookEdit"), "NEW": ("Write",), "EXECUTE": ("Bash", "TaskStop"), "DELEGATE": ("Agent", "Task", "TaskCreate", "TaskUpdate"),
}
ORIGINS = {
    "local_file": ("Read", "Glob", "Grep", "Edit", "Write", "NotebookEdit"), "local_exec": ("Bash",), "web": ("WebFetch", "WebSearch"), "sub_agent": ("Agent", "Task", "TaskCreate", "TaskUpdate", "TaskGet", "TaskList", "TaskOutput", "TaskStop"), "user_provided": ("AskUserQuestion",),
}
CONTROL = ("<system-reminder>", "<command-name>")
SPAWNING = ("Agent", "Task", "TaskCreate")
SCOPE_CHARS = 200


def _by_tool(tool: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(tool.isin(*names), kind) for kind, names in table.items()])


def operation(tool: Column) -> Column:
    return F.coalesce(_by_tool(tool, OPERATIONS), F.lit("OTHER"))


def content_origin(tool: Column) -> Column:
    return F.when(F.startswith(tool, F.lit("mcp__")), "mcp_server").otherwise(_by_tool(tool, ORIGINS))


def classified(lines: DataFrame) -> DataFrame:
    """(path, line_no, source, input_channel) of records; value is one JSON record."""
    kind, content = F.get_json_object("value", "$.type"), F.coalesce(F.get_json_object("value", "$.message.content"), F.lit(""))
    blocks = F.from_json(F.when(content.startswith("["), content), "array<struct<type:string>>")
    results = F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))
    marked = lambda *marks: F.coalesce(*[F.when(F.contains(content, F.lit(m)), True) for m in marks], F.lit(False))
    source = F.when(kind == "system", "system").when(kind == "assistant", "model").when((kind == "user") & (results | marked(*CONTROL)), "framework").when(kind == "user", "human")
    channel = F.when(kind == "system", "system_prompt").when((kind == "user") & results, "tool_output").when((kind == "user") & marked(*CONTROL, "<available-deferred-tools>"), "framework_control").when(kind == "user", "user_input")
    return lines.select("path", "line_no", source.alias("source"), channel.alias("input_channel"))


def spawned(calls: DataFrame) -> DataFrame:
    """calls with spawned_agent_type and spawned_agent_task_scope of the tools that start agents."""
    at = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("arguments_json", f"$.{n}"), F.lit("")) for n in names])
    starts = F.col("tool_name").isin(*SPAWNING)
    scope = F.substring(F.coalesce(at("prompt", "description"), F.lit("")), 1, SCOPE_CHARS)
    return calls.withColumn("spawned_agent_type", F.when(starts, F.coalesce(at("subagent_type", "type"), F.lit("general")))).withColumn("spawned_agent_task_scope", F.when(starts, scope))


def folder_sessions(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Sessions kept as folders below root, without a transcript: each tool-results/*.txt is a call with its result.

    Quality is B with more than ten results, C with any call, else D; every session needs cleaning.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parts = F.regexp_extract("file", r"^(.*)/([^/]+)/tool-results/([^/]+)\.txt$", 2), F.regexp_extract("file", r"/tool-results/([^/]+)\.txt$", 1)
    found = files.select(parts[0].alias("session_id"), parts[1].alias("tool_call_id"), F.col("value").alias("result")).where("session_id <> ''").dropDuplicates(["session_id", "tool_call_id"])
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("tool_call_id")) - 1
    calls = found.select("session_id", "tool_call_id", order.cast("long").alias("source_ordinal"), F.lit("unknown").alias("tool_name"), F.lit("OTHER").alias("operation_type"), "result", F.lit(1).cast("long").alias("success"), F.lit("succeeded").alias("outcome_status"), F.lit("tool_call").alias("record_kind"))
    n = F.count(F.lit(1))
    sessions = calls.groupBy("session_id").agg(n.alias("tool_call_count"), F.when(n > 10, "B").otherwise("C").alias("quality"))
    return {"tool_calls": calls, "sessions": sessions.select("*", F.lit("claude-code").alias("agent_framework"), F.lit("claude-code-dir-v1").alias("source_format"), F.lit(1).cast("long").alias("needs_cleaning"))}


def subagent_sessions(sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """sessions with those of subagents renamed.  agents: session_id, agent_id, parent_session, slug.

    A subagent's session takes the agent's id, names its parent as predecessor, and its
    title says what it is.
    """
    a = agents.select("session_id", "agent_id", "parent_session", F.nullif("slug", F.lit("")).alias("slug"))
    j = sessions.join(a, "session_id", "left")
    is_sub = F.col("agent_id").isNotNull()
    put = {
        "session_id": F.when(is_sub, F.col("agent_id")).otherwise(F.col("session_id")), "original_session_id": F.when(is_sub, F.col("agent_id")).otherwise(F.col("original_session_id")),
        "source_format": F.when(is_sub, F.concat(F.coalesce("source_format", F.lit("")), F.lit("+subagent"))).otherwise(F.col("source_format")), "predecessor_session": F.when(is_sub, F.coalesce(F.nullif("parent_session", F.lit("")), "predecessor_session")).otherwise(F.col("predecessor_session")),
        "title": F.when(is_sub, F.concat(F.lit("[subagent] "), F.coalesce("slug", F.nullif("title", F.lit("")), "agent_id"))).otherwise(F.col("title")),
    }
    return j.select(*[put.get(c, F.col(c)).alias(c) for c in sessions.columns])


def link_subagents(calls: DataFrame, agents: DataFrame) -> DataFrame:
    """calls with spawned_agent_sub_session_id: a parent's spawning calls get its agents' ids, both in order."""
    which = F.row_number().over(Window.partitionBy("session_id").orderBy("source_ordinal"))
    starts = calls.where("spawned_agent_type is not null").select("session_id", "tool_call_id", which.alias("n"))
    ids = agents.select(F.col("parent_session").alias("session_id"), "agent_id").distinct()
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("agent_id")))
    linked = starts.join(ids, ["session_id", "n"]).select("session_id", "tool_call_id", F.col("agent_id").alias("_sub"))
    return calls.join(linked, ["session_id", "tool_call_id"], "left").withColumn("spawned_agent_sub_session_id", F.coalesce("_sub", "spawned_agent_sub_session_id")).drop("_sub").select(*calls.columns)
