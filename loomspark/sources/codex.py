"""What codex logs tell beyond messages and calls: mirrored messages, output envelopes, executions, file changes, file targets.

Input is (path, line_no, value), one JSON record a line.  Evidence of one thing that
comes in several records is grouped by its native id; what contradicts itself leaves
the outcome unknown and is named in diagnostics.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Message kinds, patch headers, shell words that change what follows, and output prefixes.
MESSAGE_KINDS = {"UserMessage": "user", "AgentMessage": "assistant"}
PATCH_OPERATIONS = (("*** Add File: ", "NEW"), ("*** Update File: ", "MODIFY"), ("*** Delete File: ", "DELETE"), ("*** Move to: ", "MOVE"))
CONTROL_WORDS = ("if", "then", "else", "elif", "fi", "for", "while", "until", "case", "select", "function", "do", "done", "!", "time", "cd", "pushd", "popd", "eval", "source", ".")
EXIT_LINE = r"(?m)^(?:Process exited with code |Exit code: )\s*(-?[0-9]+)\s*$"
WALL_LINE = r"(?m)^Wall time: ([0-9.]+)"
RENDERED = r"(?ms)\A(.*?)^(?:Output|Final output):[ \t]*\n?(.*)\z"
CHANGES = {"add": "NEW", "update": "MODIFY", "delete": "DELETE"}
# A word is literal if it holds no expansion: plain characters, escapes, quotes without variables.
WORD = r"""(?:[^ \t\r\n;><&|(){}$`*?\[\]~\\'"]|\\[\s\S]|'[^']*+'|"(?:[^"\\$`]|\\[\s\S])*+")++"""
TOKEN = rf"[ \t\r]++|(?<![^ \t\r\n;])#[^\n]*+|[;\n]|(?:>>?|<)(?![<>&|(])|{WORD}"


def _j(path: str, c: str = "value") -> Column:
    return F.get_json_object(c, path)


def _blank(c: Column | str) -> Column:
    return F.nullif(c, F.lit(""))


def _turns(lines: DataFrame) -> DataFrame:
    """lines with the native turn that a record belongs to."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens = (_j("$.type") == "turn_context") | ((_j("$.type") == "event_msg") & (_j("$.payload.type") == "task_started"))
    own = _blank(F.coalesce(_j("$.payload.turn_id"), F.lit("")))
    return lines.withColumn("turn_id", F.coalesce(own, F.last(F.when(opens, own), ignorenulls=True).over(w)))


def messages(lines: DataFrame) -> DataFrame:
    """(path, line_no, role, message_id, turn_id, content, representations, conflict): each message once.

    Records of one (role, turn, id) are one message; so are neighbouring records of one
    turn with equal text in different representations, one of them the response item.
    The response item's text, id and time stand.
    """
    kind, inner, item = _j("$.type"), _j("$.payload.type"), _j("$.payload.item.type")
    response, done = (kind == "response_item") & (inner == "message"), (kind == "event_msg") & (inner == "item_completed")
    role = (
        F.when(response, _j("$.payload.role")).when(done, F.coalesce(*[F.when(item == k, v) for k, v in MESSAGE_KINDS.items()]))
        .when((kind == "event_msg") & (inner == "user_message"), "user").when((kind == "event_msg") & (inner == "agent_message"), "assistant")
    )
    body = F.when(done, _j("$.payload.item.content")).otherwise(_j("$.payload.content"))
    blocks = F.filter(F.from_json(F.when(body.startswith("["), body), "array<struct<type:string,text:string>>"), lambda b: b["text"].isNotNull() & F.lower(b["type"]).isin("text", "input_text", "output_text", "summary_text"))
    texts = F.transform(blocks, lambda b: b["text"])
    x = _turns(lines).select(
        "path", "line_no", F.when(role == "developer", "system").otherwise(role).alias("role"), "turn_id", _blank(F.coalesce(F.when(done, _j("$.payload.item.id")).otherwise(_j("$.payload.id")), F.lit(""))).alias("message_id"), _j("$.timestamp").alias("timestamp"),
        F.coalesce(F.array_join(texts, "\n"), body, _j("$.payload.message"), F.lit("")).alias("content"), F.coalesce(F.array_join(texts, ""), body, _j("$.payload.message"), F.lit("")).alias("identity"), F.concat_ws("/", kind, inner, F.when(done, item)).alias("representation"), response.alias("response"),
    ).where(F.col("role").isin("user", "assistant", "system"))
    w = Window.partitionBy("path").orderBy("line_no")
    before = lambda c: F.lag(c).over(w)
    mirror = (before("line_no") == F.col("line_no") - 1) & (before("turn_id") == F.col("turn_id")) & (before("role") == F.col("role")) & (before("identity") == F.col("identity")) & (before("representation") != F.col("representation")) & (before("response") | F.col("response"))
    x = x.withColumn("new", F.when(F.coalesce(mirror, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by_id = Window.partitionBy("path", "role", "turn_id", "message_id")
    # records of one id share a run, and take their mirrors with them
    x = x.withColumn("same", F.when(F.col("message_id").isNotNull(), F.min("run").over(by_id)).otherwise(F.col("run"))).withColumn("run", F.min("same").over(Window.partitionBy("path", "run")))
    best = F.struct((~F.col("response")).cast("int"), "line_no")
    first = lambda c: F.min_by(c, best).alias(c)
    return x.groupBy("path", "run").agg(
        F.min("line_no").alias("line_no"), first("role"), first("message_id"), first("turn_id"), first("timestamp"), first("content"), F.array_sort(F.collect_set("representation")).alias("representations"), (F.count_distinct("identity") > 1).alias("conflict"),
    ).drop("run")


def link_calls(calls: DataFrame, said: DataFrame) -> DataFrame:
    """calls (path, call_id, turn_id, emitting_message_id) with message_line: only an explicit message id links a call to a message."""
    m = said.where((F.col("role") == "assistant") & F.col("message_id").isNotNull()).select("path", "turn_id", F.col("message_id").alias("emitting_message_id"), F.col("line_no").alias("message_line"))
    out = calls.join(m, ["path", "turn_id", "emitting_message_id"], "left")
    known = F.when(F.col("message_line").isNotNull(), "explicit_message_id").otherwise("unknown")
    return out.withColumn("turn_association", known).withColumn("diagnostic", F.when(F.col("emitting_message_id").isNotNull() & F.col("message_line").isNull(), "unresolved_emitting_message_id"))


def output_evidence(text: Column) -> Column:
    """struct(result, exit_code, duration_ms) of one output text.

    Codes count only in a known envelope or in the lines before an output marker;
    anything else is output as it stands.
    """
    at = lambda path: F.get_json_object(text, path)
    inner = F.when(at("$.status") == "fulfilled", at("$.value"))
    source = F.coalesce(F.when(at("$.output").isNotNull(), text), inner)
    of = lambda path: F.get_json_object(source, path)
    code, seconds = F.coalesce(of("$.metadata.exit_code"), of("$.exit_code")), F.coalesce(of("$.metadata.duration_seconds"), of("$.wall_time_seconds"))
    shaped = of("$.output").isNotNull() & (F.coalesce(of("$.metadata.exit_code"), of("$.metadata.duration_seconds")).isNotNull() | (of("$.metadata").isNull() & (F.coalesce(of("$.chunk_id"), F.lit("")) != "")))
    shaped = shaped & (code.isNull() | code.try_cast("int").isNotNull()) & (seconds.isNull() | seconds.try_cast("double").isNotNull())
    head = F.regexp_extract(text, RENDERED, 1)
    codes = F.regexp_extract_all(head, F.lit(EXIT_LINE), F.lit(1))
    wall = _blank(F.regexp_extract(head, WALL_LINE, 1))
    rendered = text.rlike(r"(?m)^(?:Output|Final output):") & ((F.size(codes) > 0) | wall.isNotNull()) & F.get_json_object(text, "$").isNull()
    ms = lambda s: F.when(s.try_cast("double") >= 0, (s.try_cast("double") * 1000).cast("long"))
    return (
        F.when(shaped, F.struct(of("$.output").alias("result"), code.try_cast("int").alias("exit_code"), ms(seconds).alias("duration_ms")))
        .when(rendered, F.struct(F.regexp_extract(text, RENDERED, 2).alias("result"), F.element_at(codes, -1).try_cast("int").alias("exit_code"), ms(wall).alias("duration_ms")))
        .otherwise(F.struct(text.alias("result"), F.lit(None).cast("int").alias("exit_code"), F.lit(None).cast("long").alias("duration_ms")))
    )


def outputs(lines: DataFrame) -> DataFrame:
    """(path, call_id, result, exit_code, duration_ms, outcome_status, diagnostics) of calls by all their output records.

    A call has an outcome if exactly one exit code is told; several, or different ones in
    several records, leave it unknown.  The wrapper tool exec never has one.
    """
    r = lines.where((_j("$.type") == "response_item") & _j("$.payload.type").endswith("_call_output")).select("path", "line_no", _j("$.payload.call_id").alias("call_id"), _j("$.payload.output").alias("output"))
    blocks = F.from_json(F.when(F.col("output").startswith("[{"), F.col("output")), "array<struct<type:string,text:string>>")
    low = lambda b: F.lower(F.coalesce(b["type"], F.lit("")))
    shown = lambda b: F.when(low(b).isin("text", "input_text", "output_text"), F.coalesce(b["text"], F.lit("[invalid text output block]"))).when(low(b).isin("image", "input_image", "output_image"), "[image output]").otherwise("[unsupported output block]")
    parts = F.transform(F.coalesce(F.transform(blocks, shown), F.array(F.col("output"))), output_evidence)
    r = r.withColumn("parts", parts)
    codes = F.filter(F.transform("parts", lambda p: p["exit_code"]), lambda c: c.isNotNull())
    times = F.filter(F.transform("parts", lambda p: p["duration_ms"]), lambda c: c.isNotNull())
    r = r.select("path", "line_no", "call_id", F.array_join(F.transform("parts", lambda p: p["result"]), "\n").alias("result"), F.when(F.size(codes) == 1, F.get(codes, F.lit(0))).alias("code"), (F.size(codes) > 1).alias("many"), F.when(F.size(times) == 1, F.get(times, F.lit(0))).alias("ms"))
    names = lines.where((_j("$.type") == "response_item") & _j("$.payload.type").endswith("_call")).select("path", _j("$.payload.call_id").alias("call_id"), _j("$.payload.name").alias("tool_name")).dropDuplicates(["path", "call_id"])
    g = r.groupBy("path", "call_id").agg(F.max_by("result", "line_no").alias("result"), F.collect_set("code").alias("codes"), F.max("many").alias("many"), F.max_by("ms", "line_no").alias("duration_ms")).join(names, ["path", "call_id"], "left")
    wrapper = F.col("tool_name").eqNullSafe("exec")
    conflict = F.size("codes") > 1
    code = F.when((F.size("codes") == 1) & ~F.col("many") & ~wrapper, F.get("codes", F.lit(0)))
    notes = F.filter(F.array(F.when(conflict, "conflicting_response_output_exit_codes"), F.when(F.col("many"), "multiple_output_envelopes")), lambda x: x.isNotNull())
    return g.select("path", "call_id", "tool_name", "result", code.alias("exit_code"), F.when(~wrapper, F.col("duration_ms")).alias("duration_ms"), F.when(code == 0, "succeeded").when(code.isNotNull(), "failed").otherwise("unknown").alias("outcome_status"), notes.alias("diagnostics"))


def _items(lines: DataFrame, kind: str) -> DataFrame:
    p = _turns(lines).where((_j("$.type") == "event_msg") & _j("$.payload.type").isin("item_started", "item_completed") & (_j("$.payload.item.type") == kind))
    own = _blank(F.coalesce(_j("$.payload.item.id"), F.lit("")))
    return p.withColumn("id", F.coalesce(own, F.concat(F.lit("anonymous-line-"), F.col("line_no").cast("string")))).withColumn("anonymous", own.isNull()).withColumn("done", _j("$.payload.type") == "item_completed")


def executions(lines: DataFrame) -> DataFrame:
    """Native command executions, started and completed records merged by id.

    Any contradiction (thread, turn, command, directory, call, exit code, output, or a
    status against the code) leaves the outcome unknown; else cancelled, then the exit
    code, then a failed status decide.
    """
    i = lambda name: _j(f"$.payload.item.{name}")
    x = _items(lines, "CommandExecution").select(
        "path", "line_no", "id", "anonymous", "done", "turn_id", _j("$.timestamp").alias("timestamp"), _blank(F.coalesce(_j("$.payload.thread_id"), F.lit(""))).alias("thread_id"), i("command").alias("argv"), _blank(F.coalesce(i("cwd"), F.lit(""))).alias("cwd"),
        _blank(F.coalesce(i("call_id"), _j("$.payload.call_id"), F.lit(""))).alias("call_id"), _blank(F.coalesce(i("parent_call_id"), _j("$.payload.parent_call_id"), F.lit(""))).alias("parent_call_id"), i("status").alias("status"), i("exit_code").alias("raw_code"), i("exit_code").try_cast("int").alias("code"),
        F.coalesce(i("aggregated_output"), F.when(F.coalesce(i("stdout"), i("stderr")).isNotNull(), F.concat(F.coalesce(i("stdout"), F.lit("")), F.coalesce(i("stderr"), F.lit(""))))).alias("text"), i("stderr").alias("stderr"), _j("$.payload.started_at_ms").try_cast("long").alias("began"), _j("$.payload.completed_at_ms").try_cast("long").alias("ended"),
    )
    finished = lambda c: F.when(F.col("done"), F.col(c))
    differs = {n: F.count_distinct(n) > 1 for n in ("thread_id", "turn_id", "argv", "cwd", "call_id", "parent_call_id")}
    differs |= {"exit_code": F.count_distinct(finished("code")) > 1, "output": F.count_distinct(finished("text")) > 1, "status": F.count_distinct(F.when(F.col("done"), F.col("status") == "cancelled")) > 1}
    code, status, at = F.max(finished("code")), F.max_by(finished("status"), F.when(F.col("done"), F.col("line_no"))), F.when(F.col("done"), F.col("line_no"))
    g = x.groupBy("path", "id").agg(
        F.min("line_no").alias("line_no"), F.max("anonymous").alias("anonymous"), F.max("done").alias("completed"), F.min_by("timestamp", "line_no").alias("timestamp"), *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in ("turn_id", "thread_id", "argv", "cwd", "call_id", "parent_call_id")],
        code.alias("code"), status.alias("status"), F.max_by("text", F.when(F.col("text").isNotNull(), at)).alias("text"), F.max_by("stderr", F.when(F.col("stderr").isNotNull(), at)).alias("stderr"), (F.max("ended") - F.min("began")).alias("ms"),
        F.array(*[F.when(bad, f"conflicting_execution_{n}") for n, bad in differs.items()], F.when(F.max((F.col("done") & F.col("raw_code").isNotNull() & F.col("code").isNull()).cast("int")) == 1, "invalid_execution_exit_code"), F.when(F.max("anonymous"), "missing_execution_id")).alias("found"),
    )
    against = F.col("code").isNotNull() & (((F.col("status") == "failed") & (F.col("code") == 0)) | (F.col("status") == "cancelled"))
    notes = F.filter(F.concat("found", F.array(F.when(against, "conflicting_execution_outcome"))), lambda n: n.isNotNull())
    conflict = F.exists(notes, lambda n: F.startswith(n, F.lit("conflicting_")) | (n == "invalid_execution_exit_code"))
    outcome = F.when(~F.col("completed"), "pending").when(conflict, "unknown").when(F.col("status") == "cancelled", "cancelled").when(F.col("code") == 0, "succeeded").when(F.col("code").isNotNull() | (F.col("status") == "failed"), "failed").otherwise("unknown")
    words = F.from_json("argv", "array<string>")
    shell = (F.size(words) >= 3) & F.get(words, F.lit(1)).isin("-c", "-lc") & F.regexp_extract(F.get(words, F.lit(0)), "([^/]*)$", 1).isin("sh", "bash", "dash", "zsh", "ksh")
    command = F.when(shell, F.get(words, F.lit(2))).otherwise(F.array_join(F.transform(words, lambda v: F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))), " "))
    return g.select(
        "path", "line_no", F.concat(F.lit("codex-execution:"), "id").alias("tool_call_id"), "timestamp", "turn_id", "thread_id", "cwd", "call_id", "parent_call_id", command.alias("command"), F.when(shell, "shell_script").otherwise("quoted_argv_display").alias("command_rendering"),
        outcome.alias("outcome_status"), F.when(~conflict & (F.col("status").isNull() | (F.col("status") != "cancelled")), F.col("code")).alias("exit_code"), F.col("text").alias("result"), F.when(outcome == "failed", F.coalesce(_blank(F.col("stderr")), _blank(F.col("text")), F.lit("command execution failed"))).alias("error"), F.when(F.col("ms") >= 0, F.col("ms")).alias("duration_ms"), notes.alias("diagnostics"),
    )


def with_executions(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """calls (path, tool_call_id, tool_name, command, outcome_status, exit_code, result, record_kind) with executions.

    An execution that alone names a call exec_command recorded once enriches that call;
    every other one is a row of its own.  Different exit codes leave the call unknown.
    """
    named = runs.where("call_id is not null").withColumn("links", F.count(F.lit(1)).over(Window.partitionBy("path", "call_id"))).where("links = 1")
    once = calls.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path", "tool_call_id"))).where("n = 1 and tool_name = 'exec_command'").select("path", F.col("tool_call_id").alias("call_id"))
    joined = named.join(once, ["path", "call_id"], "left_semi").select("path", "call_id", F.col("tool_call_id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in ("command", "outcome_status", "exit_code", "result")])
    c = calls.join(joined, (calls["path"] == joined["path"]) & (calls["tool_call_id"] == joined["call_id"]), "left").drop(joined["path"])
    hit, clash = F.col("r_id").isNotNull(), F.coalesce(F.col("exit_code") != F.col("r_exit_code"), F.lit(False))
    put = {n: F.when(hit, F.coalesce(f"r_{n}", n) if n == "command" else F.col(f"r_{n}")).otherwise(F.col(n)) for n in ("command", "outcome_status", "exit_code", "result")}
    put["outcome_status"], put["exit_code"] = F.when(hit & clash, "unknown").otherwise(put["outcome_status"]), F.when(hit & clash, F.lit(None)).otherwise(put["exit_code"])
    own = c.select("path", "tool_call_id", "tool_name", "record_kind", *[v.alias(n) for n, v in put.items()])
    rest = runs.join(joined.select("path", F.col("r_id").alias("tool_call_id")), ["path", "tool_call_id"], "left_anti")
    return own.unionByName(rest.select("path", "tool_call_id", F.lit("exec_command").alias("tool_name"), F.lit("execution").alias("record_kind"), "command", "outcome_status", "exit_code", "result"))


def legacy_ends(lines: DataFrame, calls: DataFrame) -> DataFrame:
    """calls (path, tool_call_id, exit_code, outcome_status, ...) reconciled with end records: codes that differ leave it unknown."""
    e = lines.where((_j("$.type") == "event_msg") & (_j("$.payload.type") == "exec_command_end")).select("path", _j("$.payload.call_id").alias("tool_call_id"), _j("$.payload.exit_code").try_cast("int").alias("code")).where("code is not null")
    e = e.groupBy("path", "tool_call_id").agg(F.collect_set("code").alias("ends"))
    c = calls.join(e, ["path", "tool_call_id"], "left")
    every = F.array_distinct(F.concat("ends", F.filter(F.array("exit_code"), lambda x: x.isNotNull())))
    clash = F.size(every) > 1
    code = F.when(F.col("ends").isNull(), F.col("exit_code")).when(~clash, F.get(every, F.lit(0)))
    status = F.when(F.col("ends").isNull(), F.col("outcome_status")).when(clash, "unknown").when(code == 0, "succeeded").otherwise("failed")
    return c.select(*[(code if n == "exit_code" else status if n == "outcome_status" else F.col(n)).alias(n) for n in calls.columns])


def resolved(path: Column, cwd: Column) -> Column:
    """Absolute form of a path against an absolute directory (a file: address of this host counts), without . and .. steps."""
    folder = F.regexp_replace(F.coalesce(cwd, F.lit("")), r"^file:(?://(?:localhost)?)?(?=/)", "")
    joined = F.when(path.startswith("/"), path).when(folder.startswith("/"), F.concat(folder, F.lit("/"), path)).otherwise(path)
    steps = F.filter(F.split(joined, "/"), lambda s: ~s.isin("", "."))
    # each step up takes the last step away
    kept = F.aggregate(steps, F.expr("cast(array() as array<string>)"), lambda a, s: F.when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)).otherwise(F.concat(a, F.array(s))))
    return F.when(joined.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def file_changes(lines: DataFrame) -> DataFrame:
    """(path, line_no, tool_call_id, target, operation_type, evidence_status, outcome_status): native file effects, moves as a deletion and a new file.

    Targets of a completed change are confirmed; failed, cancelled, pending or conflicting ones are attempts.
    """
    x = _items(lines, "FileChange").select("path", "line_no", "id", "done", _j("$.payload.item.status").alias("status"), _j("$.payload.item.cwd").alias("cwd"), _j("$.payload.item.changes").alias("changes"))
    finished = lambda c: F.when(F.col("done"), F.col(c))
    told = Window.partitionBy("path", "id")
    clash = (F.size(F.collect_set(finished("status")).over(told)) > 1) | (F.size(F.collect_set(F.sha2(finished("changes"), 256)).over(told)) > 1)
    status = F.max(finished("status")).over(told)
    outcome = F.when(~F.max("done").over(told), "pending").when(clash, "unknown").when(status == "completed", "succeeded").when(status == "failed", "failed").when(status.isin("cancelled", "canceled"), "cancelled").otherwise("unknown")
    x = x.withColumn("outcome_status", outcome).where("done").withColumn("first", F.min("line_no").over(told))
    each = x.select("path", "first", "id", "cwd", "outcome_status", F.explode(F.map_entries(F.from_json("changes", "map<string,struct<type:string,move_path:string>>"))).alias("c"))
    op = F.coalesce(*[F.when(F.col("c.value.type") == k, v) for k, v in CHANGES.items()])
    move = _blank(F.coalesce("c.value.move_path", F.lit("")))
    targets = F.when(move.isNotNull(), F.array(F.struct(F.col("c.key").alias("t"), F.lit("DELETE").alias("o")), F.struct(move.alias("t"), F.lit("NEW").alias("o")))).otherwise(F.array(F.struct(F.col("c.key").alias("t"), op.alias("o"))))
    out = each.where(op.isNotNull() & (F.col("c.key") != "")).select("path", F.col("first").alias("line_no"), F.concat(F.lit("codex-file-change:"), "id").alias("tool_call_id"), "cwd", "outcome_status", F.explode(targets).alias("x"))
    return out.select("path", "line_no", "tool_call_id", resolved(F.col("x.t"), F.col("cwd")).alias("target"), F.col("x.o").alias("operation_type"), F.when(F.col("outcome_status") == "succeeded", "confirmed").otherwise("attempted").alias("evidence_status"), "outcome_status").distinct()


def patch_targets(patch: Column) -> Column:
    """array<struct<target, operation>> of a patch; null if it is no patch, a move without an update before it, or a header without a path."""
    rows = F.split(F.trim(patch), "\n")
    ok = (F.size(rows) >= 2) & (F.get(rows, F.lit(0)) == "*** Begin Patch") & (F.element_at(rows, -1) == "*** End Patch")
    header = lambda x: F.coalesce(*[F.when(F.startswith(x, F.lit(h)), F.struct(F.substr(x, F.lit(len(h) + 1)).alias("target"), F.lit(o).alias("operation"))) for h, o in PATCH_OPERATIONS])
    heads = F.filter(F.transform(rows, header), lambda h: h.isNotNull())
    after = lambda i: F.get(heads, i + 1)["operation"].eqNullSafe("MOVE")
    bad = F.exists(heads, lambda h: h["target"] == "") | F.exists(F.sequence(F.lit(0), F.greatest(F.size(heads) - 1, F.lit(0))), lambda i: F.get(heads, i)["operation"].eqNullSafe("MOVE") & ((i == 0) | ~F.get(heads, i - 1)["operation"].eqNullSafe("MODIFY")))
    made = F.transform(heads, lambda h, i: F.struct(h["target"].alias("target"), F.when(h["operation"] == "MOVE", "NEW").when(after(i), "DELETE").otherwise(h["operation"]).alias("operation")))
    return F.when(ok & ~bad, made)


def shell_targets(script: Column) -> Column:
    """array<struct<target, operation>> that literal redirects of a script name; null if anything in it is dynamic.

    Expansions, pipes, heredocs, assignments, control words and changes of directory all
    end the inference: what a path means is then unknown.
    """
    literal = script.rlike(rf"\A(?:{TOKEN})*+\z")
    tokens = F.filter(F.regexp_extract_all(script, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: ~t.rlike(r"\A(?:[ \t\r]+|#[^\n]*)\z"))
    plain = lambda t: F.regexp_replace(t, r"""\\([\s\S])|'([^']*)'|"((?:[^"\\]|\\[\s\S])*+)\"""", "$1$2$3")

    def targets(ts: Column) -> Column:
        redirect = lambda t: t.isin(">", ">>", "<")
        operator = lambda t: redirect(t) | t.isin(";", "\n")
        at = F.sequence(F.lit(0), F.greatest(F.size(ts) - 1, F.lit(0)))
        token = lambda i: F.get(ts, i)
        lone = F.exists(at, lambda i: redirect(token(i)) & F.coalesce(operator(token(i + 1)), F.lit(True)))
        starts = lambda i: ~operator(token(i)) & ((i == 0) | token(i - 1).isin(";", "\n"))
        acts = F.exists(at, lambda i: starts(i) & (plain(token(i)).isin(*CONTROL_WORDS) | F.contains(plain(token(i)), F.lit("="))))
        found = F.transform(F.filter(at, lambda i: redirect(token(i))), lambda i: F.struct(plain(token(i + 1)).alias("target"), F.when(token(i) == "<", "READ").otherwise("MODIFY").alias("operation")))
        return F.when(F.size(ts) == 0, F.filter(found, lambda x: F.lit(False))).when(~F.coalesce(lone, F.lit(False)) & ~F.coalesce(acts, F.lit(False)), found)

    return F.when(literal, F.get(F.transform(F.array(tokens), targets), F.lit(0)))


def file_targets(calls: DataFrame) -> DataFrame:
    """(path, tool_call_id, target, operation_type, evidence_kind) of calls (path, tool_call_id, tool_name, operation_type, command, arguments, cwd)."""
    patch = F.coalesce(F.get_json_object("arguments", "$.input"), F.get_json_object("arguments", "$.patch"))
    named = F.coalesce(F.get_json_object("arguments", "$.file_path"), F.get_json_object("arguments", "$.path"))
    one = F.when(named != "", F.array(F.struct(named.alias("target"), F.col("operation_type").alias("operation"))))
    tool = F.col("tool_name")
    found = F.when(tool == "apply_patch", patch_targets(patch)).when(tool == "exec_command", shell_targets(F.col("command"))).when(tool.isin("read_file", "view_image", "write_file", "edit_file", "apply_diff"), one)
    kind = F.when(tool == "apply_patch", "patch_header").when(tool == "exec_command", "shell_redirect").otherwise("tool_path_argument")
    x = calls.select("path", "tool_call_id", "cwd", kind.alias("evidence_kind"), F.posexplode(found).alias("ordinal", "t"))
    return x.select("path", "tool_call_id", "ordinal", resolved(F.col("t.target"), F.col("cwd")).alias("target"), F.col("t.operation").alias("operation_type"), "evidence_kind")


def fidelity(*diagnosed: DataFrame) -> DataFrame:
    """(path, diagnostic, n) over tables with path and diagnostics."""
    every = None
    for df in diagnosed:
        part = df.select("path", F.explode("diagnostics").alias("diagnostic"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("path", "diagnostic").agg(F.count(F.lit(1)).alias("n"))
