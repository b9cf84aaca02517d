"""Analyses of what agents did: file histories, tickets, context windows, episodes, failures, reading habits.

Every function takes the ten tables and gives a DataFrame over all sessions.  Paths,
commands and symbols are pulled out of texts with regular expressions and exploded, so
the work is joins, groups and windows by session.  Each has SQL to hold it against.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators import sequence as S

Tables = Mapping[str, DataFrame]

# How a turn starts that is no instruction of a person.
NOT_SAID = ("<", "[Image", "Base directory for this skill", "This session is being continued", "Caveat:")
# Tools that run shell commands, and keys and headers that name commands and paths in arguments.
SHELL = ("Bash", "bash", "shell", "exec")
COMMAND_KEY = r"""\\?"?(?:cmd|command)\\?"?\s*:\s*\\?"((?:[^"\\]|\\.)*)\\?\""""
PATCH_FILE = r"""\*\*\* (?:Update|Add|Delete) File:\s*([^\\"\n]+)"""
PATH_KEY = r"""\\?"(?:file_path|path)\\?"\s*:\s*\\?"([^"\\]+)"""
REDIRECT = r">>?\s*([^\s&(>][^\s]*)"
HOME = r"^(~/|/home/[^/]+/)"
SKILL_FOLDERS = r"\.claude/skills|\.codex/skills|\.pi/skills|\.pi/agent/skills"
# Rules in order, of what a ticket command or file is.
TICKET_COMMANDS = ((r"\bticket\s+create\b", "ticket-create"), (r"\bticket\s+close\b", "ticket-close"), (r"\btask\b", "task"), (r"\bchangelog\b", "changelog"), (r"\bdoc\s+add\b", "doc-add"), (r"\bdoc\s+relate\b", "doc-relate"))
TICKET_FILES = ((r"/tasks\.md$", "task"), (r"/changelog\.md$", "changelog"), ("diary", "diary"), (r"\.md$", "doc"))
# Directory changes, missing targets, help calls and readers of sources.
CD = r"(?:^|;|&&)\s*cd\s+([^\s;|&]+)\s*(?:$|;|&&)"
MISSING = r"(?i)(?:can't read|cannot stat|no such file[^:]*:?)\s+([^\s:']+)"
HELP = r"(?:^|[;&|(]\s*)([a-zA-Z][\w./-]*)\s+help\s+([\w-]{3,})"
NO_APPS = ("git", "man", "echo", "in", "the", "for", "with", "embedded", "a", "an")
READERS = r"(grep|rg|sed -n|cat |head |tail |ls |find )"
GREPPED = r"""(?:grep|rg)\s+(?:-[\w]+\s+)*["']([^"']{2,120})["']"""
SED_RANGE = r"""sed -n\s+["']?(\d+,\d+p)["']?\s+(\S+)"""
MODULE = r"go/pkg/mod/([^@/]+/[^@/]+/[^@/]+)"


def is_instruction(role: Column, content: Column) -> Column:
    """A person's own instruction: a user turn, not blank, without the prefix of an injected text."""
    text = F.ltrim(F.coalesce(content, F.lit("")))
    ok = (role == "user") & (F.length(text) > 0)
    for prefix in NOT_SAID:
        ok = ok & ~F.startswith(text, F.lit(prefix))
    return ok


def instructions(t: Tables) -> DataFrame:
    return t["turns"].where(is_instruction(F.col("role"), F.col("content")) & ~F.col("content_type").eqNullSafe("tool_result")).select("session_id", "turn_index", "content")


def commands() -> Column:
    """Shell commands of a call: the command, or else those under command keys in its arguments."""
    # the repeated group is possessive here: no text can exhaust the stack
    pattern = COMMAND_KEY.replace(r"""(?:[^"\\]|\\.)*""", r"""(?:[^"\\]++|\\.)*+""")
    found = F.regexp_extract_all(F.coalesce("arguments_json", F.lit("")), F.lit(pattern), F.lit(1))
    plain = F.transform(found, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')))
    return F.when(F.length("command") > 0, F.array("command")).otherwise(plain)


def canonical(path: Column) -> Column:
    return F.regexp_replace(path, HOME, "")


def ladder(text: Column, rules, otherwise: str) -> Column:
    out = None
    for pattern, name in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def _frameworks(t: Tables) -> DataFrame:
    return t["sessions"].select("session_id", F.coalesce("agent_framework", F.lit("")).alias("framework"))


def candidate_paths() -> Column:
    """Paths a call names: its file, patch headers, path keys, redirect targets; the first of each canonical form."""
    all_of = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    arguments = F.coalesce("arguments_json", F.lit(""))
    found = F.concat(
        F.when(F.length("file_path") > 0, F.array("file_path")).otherwise(F.expr("cast(array() as array<string>)")),
        F.transform(all_of(arguments, PATCH_FILE), lambda p: F.rtrim(p)), all_of(arguments, PATH_KEY), F.flatten(F.transform(commands(), lambda c: all_of(c, REDIRECT))),
    )
    forms = F.transform(found, canonical)
    return F.filter(found, lambda p, i: F.array_position(forms, canonical(p)) == i + 1)


def file_timeline(t: Tables, fragment: str = "k1") -> DataFrame:
    """VRB-03, timeline: every touch of a path that holds the fragment (of any case), with the instruction before it."""
    c = t["tool_calls"].join(_frameworks(t), "session_id")
    holds = lambda x: F.contains(F.lower(x), F.lit(fragment.lower()))
    may = holds(F.coalesce("file_path", F.lit(""))) | holds(F.coalesce("command", F.lit(""))) | holds(F.coalesce("arguments_json", F.lit("")))
    keep = ["session_id", "tool_call_id", "framework", F.col("emitting_turn_index").alias("turn_index"), "timestamp", "tool_name"]
    named = c.where((F.col("framework") != "codex") & may).select(*keep, "operation_type", "success", F.col("file_path").alias("own"), F.explode(candidate_paths()).alias("path"))
    named = named.where(holds(F.col("path"))).select("*", F.when(F.col("path") == F.col("own"), "file_path").otherwise("arguments").alias("match_source"), F.lit(None).cast("string").alias("evidence_status")).drop("own")
    told = t["files"].where((F.col("evidence_kind") != "legacy_scalar") & holds(F.col("path"))).select("session_id", "tool_call_id", "path", "operation_type", "success", "evidence_status")
    structural = c.where("framework = 'codex'").select(*keep).join(told, ["session_id", "tool_call_id"]).withColumn("match_source", F.lit("file_target"))
    every = structural.unionByName(named)
    tool = F.lower(F.coalesce("tool_name", F.lit("")))
    op = (
        F.when(F.col("operation_type").isin("NEW", "MODIFY", "READ"), F.col("operation_type")).when(tool == "read", "READ-inferred").when(tool == "write", "NEW-or-MODIFY-inferred")
        .when(tool.isin("edit", "multiedit", "notebookedit"), "MODIFY-inferred").when(tool.isin("exec", "bash", "shell"), "OTHER-exec").otherwise(F.coalesce("operation_type", F.lit("OTHER")))
    )
    every = every.select("session_id", "tool_call_id", "framework", "turn_index", "timestamp", "tool_name", op.alias("op"), "success", F.col("path").alias("file_path"), "match_source", "evidence_status")
    said = instructions(t).select("session_id", "turn_index", F.col("content").alias("preceding_instruction"))
    return S.as_of(every, said, "session_id", "turn_index", "turn_index", ["preceding_instruction"])


def file_history(t: Tables, fragment: str = "k1") -> DataFrame:
    """VRB-03, summary: one row per canonical path, with its first and last touch, operations, sessions and effects."""
    x = file_timeline(t, fragment).drop("preceding_instruction").withColumn("canonical", canonical(F.col("file_path")))
    first = F.struct("timestamp", "session_id", "tool_call_id", "op")
    n = lambda prefix: F.count_if(F.startswith("op", F.lit(prefix)))
    g = x.groupBy(F.col("canonical").alias("file_path")).agg(
        F.min("timestamp").alias("first_seen"), F.min_by("op", first).alias("first_op"), F.min_by("session_id", first).alias("first_session"), F.max("timestamp").alias("last_seen"),
        n("NEW").alias("creates"), n("MODIFY").alias("modifies"), n("READ").alias("reads"), F.count(F.lit(1)).alias("touches"), F.array_join(F.array_sort(F.collect_set("session_id")), ",").alias("sessions"),
        F.count_if(F.col("evidence_status") == "attempted").alias("attempted_targets"), F.count_if((F.col("evidence_status") == "confirmed") & (F.col("success") == 1)).alias("confirmed_effects"), F.count_if(F.col("framework") == "codex").alias("structural"),
    )
    before = F.when(F.col("structural") == 0, (~F.startswith("first_op", F.lit("NEW"))).cast("long"))
    return g.select(*[c for c in g.columns if c not in ("structural", "touches")], (F.col("touches") - F.col("creates") - F.col("modifies") - F.col("reads")).alias("other"), before.alias("created_before_visible_history"))


def ticket_timeline(t: Tables, fragment: str = "TK-1") -> DataFrame:
    """VRB-04: ticket commands and touches of ticket files that hold the fragment."""
    c = t["tool_calls"].join(_frameworks(t), "session_id")
    holds = lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(fragment.lower()))
    codex = F.col("framework") == "codex"
    shell = F.when(codex, F.col("record_kind") == "execution").otherwise(F.col("tool_name").isin(*SHELL, "run_terminal_cmd"))
    manager = F.contains(F.coalesce("command", F.lit("")), F.lit("docmgr")) | F.contains(F.coalesce("arguments_json", F.lit("")), F.lit("docmgr"))
    own = F.when(codex, F.filter(F.array("command"), lambda x: F.length(x) > 0)).otherwise(commands())
    run = c.where(shell & manager & (holds(F.col("command")) | holds(F.col("arguments_json")))).select("session_id", F.col("emitting_turn_index").alias("turn_index"), "timestamp", "tool_call_id", "tool_name", F.explode(own).alias("detail"))
    low = F.lower("detail")
    run = run.where(F.contains(low, F.lit("docmgr"))).select("*", F.lit("command").alias("channel"), ladder(low, TICKET_COMMANDS, "other-docmgr").alias("category"), F.lit(None).cast("string").alias("evidence_status"))
    told = t["files"].where(holds(F.col("path"))).select("session_id", "tool_call_id", "path", "operation_type", "evidence_kind", "evidence_status")
    touched = c.join(told.drop("tool_name"), ["session_id", "tool_call_id"]).where(~codex | (F.col("evidence_kind") != "legacy_scalar"))
    touched = touched.select(
        "session_id", F.col("emitting_turn_index").alias("turn_index"), "timestamp", "tool_call_id", "tool_name", F.concat_ws(" ", F.coalesce(told["operation_type"], F.lit("?")), "path").alias("detail"),
        F.lit("file").alias("channel"), ladder(F.lower("path"), TICKET_FILES, "other-file").alias("category"), "evidence_status",
    )
    return run.unionByName(touched)


def ticket_summary(t: Tables, fragment: str = "TK-1") -> DataFrame:
    """VRB-04, summary: one row; without a create command the first touch of a file stands for the creation."""
    x = ticket_timeline(t, fragment)
    n = lambda name: F.count_if(F.col("category") == name)
    first = lambda cond: F.min(F.when(cond, F.struct("timestamp", "tool_call_id", "detail")))
    out = x.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions"), F.min("timestamp").alias("first_event"), n("ticket-create").alias("ticket_creates"), n("task").alias("task_edits"), n("changelog").alias("changelog_edits"), n("diary").alias("diary_edits"),
        n("doc-add").alias("doc_adds"), n("doc-relate").alias("doc_relates"), n("other-docmgr").alias("other_docmgr"), first(F.col("category") == "ticket-create").alias("made"), first(F.col("channel") == "file").alias("touched"),
    )
    return out.select(*out.columns[:-2], F.coalesce("made", "touched")["timestamp"].alias("created_at"), F.coalesce("made", "touched")["detail"].alias("created_by"))


def api_call_runs(t: Tables, max_gap: int = 3, before: DataFrame | None = None) -> DataFrame:
    """Assistant turns of one call: equal counters, each at most max_gap turns after the one before; before: (session_id, target_turn)."""
    a = t["turns"].where((F.col("role") == "assistant") & F.col("output_tokens").isNotNull())
    if before is not None:
        a = a.join(before, "session_id").where(F.col("turn_index") < F.col("target_turn"))
    runs = S.number_runs(a, "session_id", "turn_index", ["output_tokens", "cache_read_tokens", "cache_creation_tokens"], max_gap)
    return runs.groupBy("session_id", "run").agg(F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn"), F.count(F.lit(1)).alias("turns"), F.max("output_tokens").alias("output_tokens"), F.max("cache_read_tokens").alias("cache_read_tokens"))


def compactions(t: Tables, least: int = 100000, share: float = 0.2, before: DataFrame | None = None) -> DataFrame:
    """Calls whose cache reads fall under a share of a large preceding one."""
    w = Window.partitionBy("session_id").orderBy("first_turn")
    r = api_call_runs(t, before=before).withColumn("before", F.lag("cache_read_tokens").over(w))
    return r.where((F.col("before") > least) & (F.col("cache_read_tokens") < F.col("before") * share))


def context_window(t: Tables, targets: DataFrame | None = None) -> DataFrame:
    """VRB-05: what is in scope at a turn: calls, files and skills since the last summary or cache collapse before it.

    targets: (session_id, target_turn); without it, each session's last turn.
    """
    if targets is None:
        targets = t["turns"].groupBy("session_id").agg(F.max("turn_index").alias("target_turn"))
    # what stands before a boundary is exchanged once more, so that no task holds the sorts and maps of all steps at once
    told = t["turns"].where((F.col("role") == "user") & F.startswith("content", F.lit(NOT_SAID[3]))).select("session_id", "turn_index")
    said = targets.alias("g").join(told.alias("u"), (F.col("g.session_id") == F.col("u.session_id")) & (F.col("u.turn_index") < F.col("g.target_turn")), "left")
    summary = said.groupBy("g.session_id", "target_turn").agg(F.max("turn_index").alias("summary_turn"))
    collapse = compactions(t, before=targets).groupBy("session_id").agg(F.max("first_turn").alias("collapse_turn"))
    b = summary.repartition("session_id").join(collapse.repartition("session_id"), "session_id", "left")
    at = F.greatest("summary_turn", "collapse_turn")
    source = F.when(at.isNull(), "session-start").when(F.col("summary_turn") == F.col("collapse_turn"), "both").when(F.col("summary_turn") == at, "summary").otherwise("cache-collapse")
    b = b.select("session_id", "target_turn", F.coalesce(at, F.lit(0)).cast("long").alias("boundary_turn"), source.alias("boundary_source"), "summary_turn", "collapse_turn")
    reads, loads = F.col("tool_name").isin("Read", "read"), F.col("tool_name") == "Skill"
    sideload = F.col("tool_name").isin(*SHELL) & F.array_join(commands(), " ").rlike(SKILL_FOLDERS)
    counted = {"tool_calls": F.lit(True), "failed": F.col("success") == 0, "skill_loads": loads, "skill_file_reads": reads & F.col("file_path").rlike("/skills/|SKILL[.]md"), "skill_sideloads": sideload}
    ones = lambda tests: [F.when(x, 1).otherwise(0).cast("long").alias(n) for n, x in tests.items()]
    c = t["tool_calls"].join(_frameworks(t), "session_id")
    calls = c.select("session_id", F.col("emitting_turn_index").alias("turn"), F.when(F.col("framework") != "codex", F.col("file_path")).alias("path"), *ones(counted))
    listed = t["files"].where("evidence_kind <> 'legacy_scalar'").select("session_id", "tool_call_id", "path")
    files = c.where("framework = 'codex'").select("session_id", "tool_call_id", F.col("emitting_turn_index").alias("turn")).join(listed, ["session_id", "tool_call_id"])
    rows = calls.unionByName(files.select("session_id", "turn", "path", *ones({n: F.lit(False) for n in counted}))).withColumnRenamed("session_id", "sid")
    inside = b.repartition("session_id").join(rows.repartition("sid"), (F.col("session_id") == F.col("sid")) & F.col("turn").between(F.col("boundary_turn"), F.col("target_turn")), "left")
    by_path = inside.groupBy(*b.columns, "path").agg(*[F.sum(n).alias(n) for n in counted])
    return by_path.groupBy(*b.columns).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counted], F.count("path").alias("files_touched"))


def episodes(t: Tables, idle_minutes: int = 10, tools: int = 4) -> DataFrame:
    """VRB-07: from one real instruction to the next: calls, failures, unknown outcomes, minutes, and the most used tools."""
    at = F.unix_micros(F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ssX"))
    order = Window.partitionBy("session_id").orderBy("turn_index")
    starts = instructions(t).select("session_id", F.col("turn_index").alias("start_turn"), F.col("content").alias("instruction"), F.row_number().over(order).cast("long").alias("episode"), (F.lead("turn_index").over(order) - 1).alias("end_turn"))
    calls = t["tool_calls"].where("emitting_turn_index is not null").select("session_id", "tool_call_id", "emitting_turn_index", "tool_name", "success", "timestamp", at.alias("at"))
    inside = S.as_of(calls, starts, "session_id", "emitting_turn_index", "start_turn", ["episode"]).where("episode is not null")
    w = Window.partitionBy("session_id", "episode").orderBy("timestamp", "tool_call_id")
    minutes = (F.col("at") - F.lag("at").over(w)) / 60000000
    inside = inside.withColumn("gap", minutes)
    g = inside.groupBy("session_id", "episode").agg(
        F.count(F.lit(1)).alias("tool_calls"), F.count_if(F.col("success") == 0).alias("failures"), F.count_if(F.coalesce(~F.col("success").isin(0, 1), F.lit(True))).alias("unknown_outcomes"),
        F.floor((F.max_by("at", F.struct("timestamp", "tool_call_id")) - F.min_by("at", F.struct("timestamp", "tool_call_id"))) / 60000000 + 0.5).cast("long").alias("wall_min"), F.sum(F.when(F.col("gap") > idle_minutes, F.floor(F.col("gap") + 0.5)).otherwise(0)).cast("long").alias("idle_min"),
    )
    by_tool = inside.groupBy("session_id", "episode", "tool_name").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("session_id", "episode").orderBy(F.desc("n"), "tool_name"))
    top = by_tool.withColumn("r", rank).where(F.col("r") <= tools).groupBy("session_id", "episode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "tool_name", F.col("n").cast("string")).alias("x")))), lambda s: s["x"]), " ").alias("top_tools"))
    out = starts.join(g, ["session_id", "episode"], "left").join(top, ["session_id", "episode"], "left")
    return out.na.fill(0, ["tool_calls", "failures", "unknown_outcomes", "wall_min", "idle_min"]).na.fill("", ["top_tools"])


def failure_triage(t: Tables) -> DataFrame:
    """VRB-08: failed calls by the first of ten rules that fits, with the directory entered in an earlier turn."""
    c = t["tool_calls"]
    into = F.when(F.col("tool_name").isin(*SHELL), F.nullif(F.regexp_extract("command", CD, 1), F.lit("")))
    earlier = Window.partitionBy("session_id").orderBy("emitting_turn_index").rangeBetween(Window.unboundedPreceding, -1)
    step = F.when(into.isNotNull(), F.struct("emitting_turn_index", "timestamp", "tool_call_id", into.alias("dir")))
    c = c.select("session_id", "tool_call_id", F.col("emitting_turn_index").alias("turn"), "tool_name", "exit_code", "command", "file_path", "success", F.concat_ws("\n", F.coalesce("error", F.lit("")), F.coalesce("result", F.lit(""))).alias("text"), F.coalesce("result", F.lit("")).alias("result"), F.max(step).over(earlier)["dir"].alias("last_cd")).where("success = 0")
    low, cmd = F.lower("text"), F.coalesce("command", F.lit(""))
    has = lambda x: F.contains(low, F.lit(x))
    target = F.regexp_extract("text", MISSING, 1)
    drift = (target != "") & ~F.startswith(target, F.lit("/")) & F.col("last_cd").isNotNull()
    killed = cmd.rlike("pkill|pgrep") & (F.col("exit_code").isin(143, 144) | has("exit code 144"))
    pattern = F.regexp_extract(cmd, r"""p(?:kill|grep)\s+(?:-[\w]+\s+)*["']?([^"'\s;|&]+)""", 1)
    own = (pattern != "") & (F.instr(F.substring(cmd, F.instr(cmd, pattern) + F.length(pattern), F.length(cmd)), pattern) > 0)
    rules = [
        (killed, "self-kill", F.when(own, F.concat(F.lit("pattern "), pattern, F.lit(" is in its own command"))).otherwise("kill chain")),
        (F.col("text").rlike(r"\(eval\).*not found|(?m)^==+ not found"), "zsh-expansion", F.lit("unquoted =word")),
        (has("has not been read yet"), "read-before-edit", F.lit("")),
        (has("illegal character nul") | has("\\x00"), "nul-byte", F.lit("")),
        (has("no such file") & drift, "cwd-drift", F.concat(target, F.lit(" after cd to "), F.col("last_cd"))),
        (has("no such file"), "missing-file", F.when(target == "", "path not found").otherwise(target)),
        (has("timed out"), "timeout", F.lit("")),
        (low.rlike(r"(?m)^--- fail|\nfail\t"), "go-test", F.lit("")),
        (F.col("text").rlike(r"\.go:\d+:\d+:") & F.col("text").rlike("undefined:|cannot use|declared and not used|syntax error"), "go-compile", F.lit("")),
        ((F.length("result") > 200) & ~has("error"), "partial-success", F.lit("")),
    ]
    kind, detail = F.lit("nonzero-exit"), F.lit("")
    for cond, name, about in reversed(rules):
        kind, detail = F.when(cond, name).otherwise(kind), F.when(cond, about).otherwise(detail)
    return c.select("session_id", "tool_call_id", "turn", F.col("tool_name").alias("tool"), kind.alias("category"), detail.alias("detail"), F.coalesce(F.nullif("command", F.lit("")), "file_path", F.lit("")).alias("command"))


def doc_consumption(t: Tables) -> DataFrame:
    """VRB-09: which documentation each session used: skills, skill files, help topics, embedded documents, Markdown."""
    c = t["tool_calls"]
    text = lambda n: F.coalesce(n, F.lit(""))
    shell, reads, any_ = F.col("tool_name").isin(*SHELL), F.col("tool_name").isin("Read", "read"), F.coalesce("command", "arguments_json", F.lit(""))
    file = text("file_path")
    helped = F.flatten(F.transform(commands(), lambda x: F.transform(F.regexp_extract_all(x, F.lit(HELP), F.lit(1)), lambda app: F.element_at(F.split(app, "/"), -1))))
    helped = F.size(F.filter(helped, lambda app: ~app.isin(*NO_APPS)))
    asks = shell & (F.contains(text("command"), F.lit(" help ")) | F.contains(text("arguments_json"), F.lit(" help ")))
    embedded = (F.contains(file, F.lit("pkg/doc/")) & F.endswith(file, F.lit(".md"))) | F.contains(file, F.lit("doc/topics/")) | (shell & any_.rlike("pkg/doc/|doc/topics/") & any_.rlike("cat |head |sed -n|ls "))
    skill = F.when(F.col("tool_name") == "Skill", F.coalesce(F.get_json_object("arguments_json", "$.skill"), F.get_json_object("arguments_json", "$.name")))
    markdown = reads & F.endswith(file, F.lit(".md"))
    old = F.concat_ws(" ", text("command"), text("arguments_json")).rlike(r"\.claude/skills|\.codex/skills|\.pi/skills")
    args = text("arguments_json")
    g = c.groupBy("session_id").agg(
        F.count_if(F.col("tool_name") == "Skill").alias("skill_loads"), F.array_join(F.array_sort(F.collect_list(skill)), ",").alias("skill_names"), F.count_if(shell & old).alias("skill_sideloads"),
        F.count_if(reads & file.rlike("/skills/|SKILL[.]md")).alias("skill_file_reads"), F.count_if((F.col("tool_name") == "exec") & (text("command") == "") & F.contains(args, F.lit(".md")) & args.rlike("sed -n|cat |head ")).alias("exec_md_read_cmds"),
        F.sum(F.when(asks, helped).otherwise(0)).cast("long").alias("embedded_help_calls"), F.count_if(asks & (helped == 0)).alias("help_flag_or_other"), F.count_if(embedded).alias("embedded_doc_reads"),
        F.count_if(markdown & F.contains(file, F.lit("/ttmp/"))).alias("md_reads_ticket"), F.count_if(markdown & ~F.contains(file, F.lit("/ttmp/"))).alias("md_reads_other"),
    )
    out = t["sessions"].select("session_id", "title", "working_directory", "started_at", "tool_call_count").join(g, "session_id", "left")
    return out.na.fill(0, [x for x in g.columns if x not in ("session_id", "skill_names")]).na.fill("", ["skill_names"])


def probes(t: Tables) -> DataFrame:
    """Shell calls that read foreign sources: (session_id, turn, timestamp, tool_call_id, repos, symbols)."""
    c = t["tool_calls"].where(F.col("tool_name").isin(*SHELL) & F.coalesce("command", "arguments_json", F.lit("")).rlike(r"\.\./|go/pkg/mod/"))
    c = c.select("session_id", F.col("emitting_turn_index").alias("turn"), "timestamp", "tool_call_id", F.array_join(commands(), "\n").alias("cmd")).where(F.col("cmd").rlike(READERS))
    words = F.transform(F.split("cmd", r"\s+"), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    up, module = F.regexp_extract, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, MODULE, 1), F.lit("")), F.lit("go-mod-cache"))
    repo = lambda x: F.when(F.contains(x, F.lit("go/pkg/mod/")), module(x)).when(F.startswith(x, F.lit("../")), F.concat(F.lit("../"), up(x, r"^\.\./([\w.-]+)", 1)))
    repos = F.array_distinct(F.filter(F.transform(words, repo), lambda x: x.isNotNull()))
    grepped = F.flatten(F.transform(F.regexp_extract_all("cmd", F.lit(GREPPED), F.lit(1)), lambda x: F.split(x, r"\\\|")))
    grepped = F.filter(F.transform(grepped, lambda x: F.regexp_replace(F.replace(F.trim(x), F.lit("\\b"), F.lit("")), r"^\^", "")), lambda x: (x != "") & ~F.startswith(x, F.lit("-")))
    read = F.concat(F.lit("[read "), F.regexp_extract("cmd", SED_RANGE, 1), F.lit(" of "), F.element_at(F.split(F.regexp_extract("cmd", SED_RANGE, 2), "/"), -1), F.lit("]"))
    symbols = F.concat(grepped, F.when(F.col("cmd").rlike(SED_RANGE), F.array(read)).otherwise(F.expr("cast(array() as array<string>)")))
    return c.select("session_id", "turn", "timestamp", "tool_call_id", repos.alias("repos"), symbols.alias("symbols")).where(F.size("repos") > 0)


def _waves(t: Tables, max_gap: int) -> DataFrame:
    """Probes with the number of their wave: in order of time, each at most max_gap turns after the one before."""
    p = probes(t)
    w = Window.partitionBy("session_id").orderBy("timestamp", "tool_call_id")
    new = F.coalesce(F.col("turn") - F.lag("turn").over(w) > max_gap, F.lit(True))
    return p.withColumn("new", new.cast("long")).withColumn("wave", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def source_probes(t: Tables, max_gap: int = 25) -> DataFrame:
    """VRB-10: waves of probes of foreign sources, with repositories and symbols."""
    x = _waves(t, max_gap)
    order = F.struct("timestamp", "tool_call_id", "turn")
    sets = lambda n: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))), ",")
    return x.groupBy("session_id", "wave").agg(F.min_by("turn", order).alias("first_turn"), F.max_by("turn", order).alias("last_turn"), F.count(F.lit(1)).alias("probes"), sets("repos").alias("repos"), sets("symbols").alias("symbols"))


def repeated_probes(t: Tables, max_gap: int = 25) -> DataFrame:
    """VRB-10, repeats: symbols sought in two waves of a session or more."""
    x = _waves(t, max_gap).select("session_id", "wave", F.explode("symbols").alias("symbol")).where(~F.startswith("symbol", F.lit("[read")))
    return x.groupBy("session_id", "symbol").agg(F.count_distinct("wave").alias("waves"), F.count(F.lit(1)).alias("probes")).where("waves >= 2")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_ladder(column: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_q(p)}) THEN '{n}'" for p, n in rules) + f" ELSE '{otherwise}' END"


_IN = "(" + ", ".join(map(_q, SHELL)) + ")"
_SAID = " AND ".join(["role = 'user'", "content_type IS DISTINCT FROM 'tool_result'", "length(ltrim(coalesce(content, ''), ' ')) > 0", *[f"NOT starts_with(ltrim(coalesce(content, ''), ' '), '{p}')" for p in NOT_SAID]])
_CMDS = f"CASE WHEN length(command) > 0 THEN [command] ELSE list_transform(regexp_extract_all(coalesce(arguments_json, ''), {_q(COMMAND_KEY)}, 1), lambda x: replace(replace(x, chr(92) || 'n', chr(10)), chr(92) || '\"', '\"')) END"
_CANON = lambda x: f"regexp_replace({x}, {_q(HOME)}, '')"
_TIMELINE = f"""tl0 AS (SELECT c.*, coalesce(s.agent_framework, '') AS framework FROM tool_calls c JOIN sessions s USING (session_id)),
 tl1 AS (SELECT session_id, tool_call_id, framework, emitting_turn_index AS turn_index, "timestamp", tool_name, operation_type, success, file_path AS own,
   list_concat(CASE WHEN length(file_path) > 0 THEN [file_path] ELSE [] END, list_transform(regexp_extract_all(coalesce(arguments_json, ''), {_q(PATCH_FILE)}, 1), lambda x: rtrim(x)), regexp_extract_all(coalesce(arguments_json, ''), {_q(PATH_KEY)}, 1),
   flatten(list_transform({_CMDS}, lambda x: regexp_extract_all(x, {_q(REDIRECT)}, 1)))) AS found FROM tl0 WHERE framework <> 'codex'),
 tl2 AS (SELECT *, unnest(found) AS path, unnest(range(1, len(found) + 1)) AS i FROM tl1),
 tl3 AS (SELECT session_id, tool_call_id, framework, turn_index, "timestamp", tool_name, operation_type, success, path, CASE WHEN path = own THEN 'file_path' ELSE 'arguments' END AS match_source, NULL AS evidence_status FROM tl2
   WHERE contains(lower(path), 'k1') AND list_position(list_transform(found, lambda x: {_CANON('x')}), {_CANON('path')}) = i
   UNION ALL SELECT c.session_id, c.tool_call_id, framework, emitting_turn_index, c."timestamp", c.tool_name, f.operation_type, f.success, f.path, 'file_target', f.evidence_status FROM tl0 c JOIN files f ON f.session_id = c.session_id AND f.tool_call_id = c.tool_call_id WHERE framework = 'codex' AND evidence_kind <> 'legacy_scalar' AND contains(lower(path), 'k1')),
 tl AS (SELECT session_id, tool_call_id, framework, turn_index, "timestamp", tool_name, CASE WHEN operation_type IN ('NEW', 'MODIFY', 'READ') THEN operation_type WHEN lower(tool_name) = 'read' THEN 'READ-inferred' WHEN lower(tool_name) = 'write' THEN 'NEW-or-MODIFY-inferred'
   WHEN lower(tool_name) IN ('edit', 'multiedit', 'notebookedit') THEN 'MODIFY-inferred' WHEN lower(tool_name) IN ('exec', 'bash', 'shell') THEN 'OTHER-exec' ELSE coalesce(operation_type, 'OTHER') END AS op, success, path AS file_path, match_source, evidence_status FROM tl3)"""
_TICKET = f"""tk0 AS (SELECT c.*, coalesce(s.agent_framework, '') AS framework FROM tool_calls c JOIN sessions s USING (session_id)),
 tk1 AS (SELECT session_id, emitting_turn_index AS turn_index, "timestamp", tool_call_id, tool_name, unnest(CASE WHEN framework = 'codex' THEN (CASE WHEN length(command) > 0 THEN [command] ELSE [] END) ELSE {_CMDS} END) AS detail FROM tk0
   WHERE CASE WHEN framework = 'codex' THEN record_kind = 'execution' ELSE tool_name IN ('Bash', 'bash', 'shell', 'exec', 'run_terminal_cmd') END AND (contains(coalesce(command, ''), 'docmgr') OR contains(coalesce(arguments_json, ''), 'docmgr')) AND (contains(lower(coalesce(command, '')), 'tk-1') OR contains(lower(coalesce(arguments_json, '')), 'tk-1'))),
 tk AS (SELECT *, 'command' AS channel, {_sql_ladder('lower(detail)', TICKET_COMMANDS, 'other-docmgr')} AS category, NULL AS evidence_status FROM tk1 WHERE contains(lower(detail), 'docmgr')
   UNION ALL SELECT c.session_id, emitting_turn_index, c."timestamp", c.tool_call_id, c.tool_name, coalesce(f.operation_type, '?') || ' ' || path, 'file', {_sql_ladder('lower(path)', TICKET_FILES, 'other-file')}, f.evidence_status FROM tk0 c JOIN files f ON f.session_id = c.session_id AND f.tool_call_id = c.tool_call_id WHERE contains(lower(path), 'tk-1') AND (framework <> 'codex' OR evidence_kind <> 'legacy_scalar'))"""
_FIRST = lambda cond: f"min(row(\"timestamp\", tool_call_id, detail)) FILTER (WHERE {cond})"
_CALLS = """a AS (SELECT t.session_id, turn_index, output_tokens AS o, cache_read_tokens AS r, cache_creation_tokens AS c FROM turns t JOIN targets g ON g.session_id = t.session_id WHERE role = 'assistant' AND output_tokens IS NOT NULL AND turn_index < target_turn),
 b AS (SELECT *, CASE WHEN lag(o) OVER w = o AND lag(r) OVER w IS NOT DISTINCT FROM r AND lag(c) OVER w IS NOT DISTINCT FROM c AND turn_index - lag(turn_index) OVER w <= 3 THEN 0 ELSE 1 END AS f FROM a WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)),
 i AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY turn_index) AS run FROM b),
 calls AS (SELECT session_id, run, min(turn_index) AS first_turn, max(o) AS o, max(r) AS r FROM i GROUP BY session_id, run),
 comp AS (SELECT * FROM (SELECT *, lag(r) OVER (PARTITION BY session_id ORDER BY first_turn) AS p FROM calls) x WHERE p > 100000 AND r < p * 0.2)"""
_MOMENT = "epoch_us(strptime(\"timestamp\", '%Y-%m-%dT%H:%M:%SZ'))"
_TEXT = "coalesce(error, '') || chr(10) || coalesce(result, '')"
_KILL = r"""p(?:kill|grep)\s+(?:-[\w]+\s+)*["']?([^"'\s;|&]+)"""
_HAS = lambda x: f"contains(lower(x), '{x}')"
_DRIFT = "(target <> '' AND NOT starts_with(target, '/') AND last_cd IS NOT NULL)"
_RULES = [
    ("(regexp_matches(cmd, 'pkill|pgrep') AND (exit_code IN (143, 144) OR " + _HAS("exit code 144") + "))", "self-kill", "CASE WHEN pat <> '' AND instr(substr(cmd, instr(cmd, pat) + length(pat)), pat) > 0 THEN 'pattern ' || pat || ' is in its own command' ELSE 'kill chain' END"),
    (r"regexp_matches(x, '\(eval\).*not found|(?m)^==+ not found')", "zsh-expansion", "'unquoted =word'"), (_HAS("has not been read yet"), "read-before-edit", "''"), ("(" + _HAS("illegal character nul") + " OR contains(lower(x), chr(92) || 'x00'))", "nul-byte", "''"),
    (f"({_HAS('no such file')} AND {_DRIFT})", "cwd-drift", "target || ' after cd to ' || last_cd"), (_HAS("no such file"), "missing-file", "CASE WHEN target = '' THEN 'path not found' ELSE target END"), (_HAS("timed out"), "timeout", "''"),
    (r"regexp_matches(lower(x), '(?m)^--- fail|\nfail\t')", "go-test", "''"), (r"(regexp_matches(x, '\.go:\d+:\d+:') AND regexp_matches(x, 'undefined:|cannot use|declared and not used|syntax error'))", "go-compile", "''"), (f"(length(coalesce(result, '')) > 200 AND NOT {_HAS('error')})", "partial-success", "''"),
]
_case = lambda i, otherwise: "CASE " + " ".join(f"WHEN {r[0]} THEN {_q(r[1]) if i == 1 else r[2]}" for r in _RULES) + f" ELSE {otherwise} END"
_ANY = "coalesce(command, arguments_json, '')"
_PROBES = f"""pr0 AS (SELECT session_id, emitting_turn_index AS turn, "timestamp", tool_call_id, array_to_string({_CMDS}, chr(10)) AS cmd FROM tool_calls WHERE tool_name IN {_IN} AND regexp_matches({_ANY}, '\\.\\./|go/pkg/mod/')),
 pr1 AS (SELECT *, list_distinct(list_filter(list_transform(list_transform(regexp_split_to_array(cmd, '\\s+'), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')), lambda x: CASE WHEN contains(x, 'go/pkg/mod/') THEN coalesce(nullif(regexp_extract(x, '{MODULE}', 1), ''), 'go-mod-cache') WHEN starts_with(x, '../') THEN '../' || regexp_extract(x, '^\\.\\./([\\w.-]+)', 1) END), lambda x: x IS NOT NULL)) AS repos,
   list_concat(list_filter(list_transform(flatten(list_transform(regexp_extract_all(cmd, {_q(GREPPED)}, 1), lambda x: string_split(x, chr(92) || '|'))), lambda x: regexp_replace(replace(trim(x), chr(92) || 'b', ''), '^\\^', '')), lambda x: x <> '' AND NOT starts_with(x, '-')),
   CASE WHEN regexp_matches(cmd, {_q(SED_RANGE)}) THEN ['[read ' || regexp_extract(cmd, {_q(SED_RANGE)}, 1) || ' of ' || string_split(regexp_extract(cmd, {_q(SED_RANGE)}, 2), '/')[-1] || ']'] ELSE [] END) AS symbols FROM pr0 WHERE regexp_matches(cmd, '{READERS}')),
 pr2 AS (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY session_id ORDER BY "timestamp", tool_call_id) <= 25 THEN 0 ELSE 1 END AS f FROM pr1 WHERE len(repos) > 0),
 pr AS (SELECT *, CAST(sum(f) OVER (PARTITION BY session_id ORDER BY "timestamp", tool_call_id) AS BIGINT) AS wave FROM pr2)"""

SQL = {
    "vrb_03": f"""WITH {_TIMELINE} SELECT {_CANON('file_path')} AS file_path, min("timestamp") AS first_seen, arg_min(op, row("timestamp", session_id, tool_call_id, op)) AS first_op, arg_min(session_id, row("timestamp", session_id, tool_call_id, op)) AS first_session, max("timestamp") AS last_seen,
      count(*) FILTER (WHERE starts_with(op, 'NEW')) AS creates, count(*) FILTER (WHERE starts_with(op, 'MODIFY')) AS modifies, count(*) FILTER (WHERE starts_with(op, 'READ')) AS reads, count(*) FILTER (WHERE NOT starts_with(op, 'NEW') AND NOT starts_with(op, 'MODIFY') AND NOT starts_with(op, 'READ')) AS other,
      string_agg(DISTINCT session_id, ',' ORDER BY session_id) AS sessions, count(*) FILTER (WHERE evidence_status = 'attempted') AS attempted_targets, count(*) FILTER (WHERE evidence_status = 'confirmed' AND success = 1) AS confirmed_effects,
      CASE WHEN count(*) FILTER (WHERE framework = 'codex') = 0 THEN CAST(NOT starts_with(arg_min(op, row("timestamp", session_id, tool_call_id, op)), 'NEW') AS BIGINT) END AS created_before_visible_history FROM tl GROUP BY 1""",
    "vrb_03_timeline": f"""WITH {_TIMELINE} SELECT tl.*, (SELECT arg_max(content, turn_index) FROM turns t WHERE t.session_id = tl.session_id AND t.turn_index <= tl.turn_index AND {_SAID}) AS preceding_instruction FROM tl""",
    "vrb_04": f"WITH {_TICKET} SELECT * FROM tk",
    "vrb_04_summary": f"""WITH {_TICKET}, s AS (SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, min("timestamp") AS first_event, count(*) FILTER (WHERE category = 'ticket-create') AS ticket_creates, count(*) FILTER (WHERE category = 'task') AS task_edits, count(*) FILTER (WHERE category = 'changelog') AS changelog_edits,
      count(*) FILTER (WHERE category = 'diary') AS diary_edits, count(*) FILTER (WHERE category = 'doc-add') AS doc_adds, count(*) FILTER (WHERE category = 'doc-relate') AS doc_relates, count(*) FILTER (WHERE category = 'other-docmgr') AS other_docmgr, coalesce({_FIRST("category = 'ticket-create'")}, {_FIRST("channel = 'file'")}) AS made FROM tk)
      SELECT * EXCLUDE (made), made[1] AS created_at, made[3] AS created_by FROM s""",
    "vrb_05": f"""WITH targets AS (SELECT session_id, max(turn_index) AS target_turn FROM turns GROUP BY 1), {_CALLS},
      bounds AS (SELECT g.session_id, target_turn, (SELECT max(turn_index) FROM turns t WHERE t.session_id = g.session_id AND role = 'user' AND starts_with(content, '{NOT_SAID[3]}') AND turn_index < target_turn) AS summary_turn, (SELECT max(first_turn) FROM comp k WHERE k.session_id = g.session_id) AS collapse_turn FROM targets g),
      d AS (SELECT *, coalesce(greatest(summary_turn, collapse_turn), 0) AS boundary_turn, CASE WHEN summary_turn IS NULL AND collapse_turn IS NULL THEN 'session-start' WHEN summary_turn = collapse_turn THEN 'both' WHEN summary_turn = greatest(summary_turn, collapse_turn) THEN 'summary' ELSE 'cache-collapse' END AS boundary_source FROM bounds),
      c AS (SELECT c.*, coalesce(s.agent_framework, '') AS framework, {_CMDS} AS cmds FROM tool_calls c JOIN d USING (session_id) JOIN sessions s USING (session_id) WHERE emitting_turn_index BETWEEN boundary_turn AND target_turn),
      g AS (SELECT session_id, count(*) AS tool_calls, count(*) FILTER (WHERE success = 0) AS failed, count(*) FILTER (WHERE tool_name = 'Skill') AS skill_loads, count(*) FILTER (WHERE tool_name IN ('Read', 'read') AND regexp_matches(file_path, '/skills/|SKILL[.]md')) AS skill_file_reads,
        count(*) FILTER (WHERE tool_name IN {_IN} AND regexp_matches(array_to_string(cmds, ' '), '{SKILL_FOLDERS}')) AS skill_sideloads FROM c GROUP BY 1),
      f AS (SELECT session_id, count(DISTINCT path) AS files_touched FROM (SELECT session_id, file_path AS path FROM c WHERE framework <> 'codex' AND file_path IS NOT NULL UNION ALL SELECT c.session_id, f.path FROM c JOIN files f ON f.session_id = c.session_id AND f.tool_call_id = c.tool_call_id WHERE framework = 'codex' AND evidence_kind <> 'legacy_scalar') x GROUP BY 1)
      SELECT d.*, coalesce(tool_calls, 0) AS tool_calls, coalesce(failed, 0) AS failed, coalesce(skill_loads, 0) AS skill_loads, coalesce(skill_file_reads, 0) AS skill_file_reads, coalesce(skill_sideloads, 0) AS skill_sideloads, coalesce(files_touched, 0) AS files_touched FROM d LEFT JOIN g USING (session_id) LEFT JOIN f USING (session_id)""",
    "vrb_07": f"""WITH s AS (SELECT session_id, turn_index AS start_turn, content AS instruction, row_number() OVER w AS episode, lead(turn_index) OVER w - 1 AS end_turn FROM turns WHERE {_SAID} WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)),
      c AS (SELECT s.session_id, s.episode, c.tool_call_id, c.tool_name, c.success, c."timestamp", {_MOMENT.replace('"timestamp"', 'c."timestamp"')} AS moment FROM tool_calls c JOIN s ON s.session_id = c.session_id AND c.emitting_turn_index >= start_turn AND (end_turn IS NULL OR c.emitting_turn_index <= end_turn)),
      d AS (SELECT *, (moment - lag(moment) OVER (PARTITION BY session_id, episode ORDER BY "timestamp", tool_call_id)) / 60000000.0::DOUBLE AS gap FROM c),
      g AS (SELECT session_id, episode, count(*) AS tool_calls, count(*) FILTER (WHERE success = 0) AS failures, count(*) FILTER (WHERE success IS NULL OR success NOT IN (0, 1)) AS unknown_outcomes, CAST(floor((arg_max(moment, row("timestamp", tool_call_id)) - arg_min(moment, row("timestamp", tool_call_id))) / 60000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS wall_min,
        CAST(coalesce(sum(floor(gap + 0.5::DOUBLE)) FILTER (WHERE gap > 10), 0) AS BIGINT) AS idle_min FROM d GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY session_id, episode ORDER BY n DESC, tool_name) AS r FROM (SELECT session_id, episode, tool_name, count(*) AS n FROM c GROUP BY 1, 2, 3) x),
      m AS (SELECT session_id, episode, string_agg(tool_name || ':' || n, ' ' ORDER BY r) AS top_tools FROM k WHERE r <= 4 GROUP BY 1, 2)
      SELECT s.*, coalesce(tool_calls, 0) AS tool_calls, coalesce(failures, 0) AS failures, coalesce(unknown_outcomes, 0) AS unknown_outcomes, coalesce(wall_min, 0) AS wall_min, coalesce(idle_min, 0) AS idle_min, coalesce(top_tools, '') AS top_tools FROM s LEFT JOIN g USING (session_id, episode) LEFT JOIN m USING (session_id, episode)""",
    "vrb_08": f"""WITH w AS (SELECT *, CASE WHEN tool_name IN {_IN} THEN nullif(regexp_extract(command, '{CD}', 1), '') END AS into_dir FROM tool_calls),
      v AS (SELECT *, arg_max(into_dir, row(emitting_turn_index, "timestamp", tool_call_id)) FILTER (WHERE into_dir IS NOT NULL) OVER (PARTITION BY session_id ORDER BY emitting_turn_index RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_cd FROM w),
      u AS (SELECT *, {_TEXT} AS x, coalesce(command, '') AS cmd, regexp_extract({_TEXT}, {_q(MISSING)}, 1) AS target, regexp_extract(coalesce(command, ''), {_q(_KILL)}, 1) AS pat FROM v WHERE success = 0)
      SELECT session_id, tool_call_id, emitting_turn_index AS turn, tool_name AS tool, {_case(1, "'nonzero-exit'")} AS category, {_case(2, "''")} AS detail, coalesce(nullif(command, ''), file_path, '') AS command FROM u""",
    "vrb_09": f"""WITH c AS (SELECT *, {_CMDS} AS cmds, tool_name IN {_IN} AS shell, tool_name IN ('Read', 'read') AS rd, coalesce(file_path, '') AS f, {_ANY} AS anytext, coalesce(arguments_json, '') AS args FROM tool_calls),
      d AS (SELECT *, shell AND (contains(coalesce(command, ''), ' help ') OR contains(args, ' help ')) AS asks, len(list_filter(list_transform(flatten(list_transform(cmds, lambda x: regexp_extract_all(x, '{HELP}', 1))), lambda x: string_split(x, '/')[-1]), lambda x: x NOT IN ({", ".join(map(_q, NO_APPS))}))) AS helped FROM c),
      g AS (SELECT session_id, count(*) FILTER (WHERE tool_name = 'Skill') AS skill_loads, coalesce(string_agg(coalesce(json_extract_string(arguments_json, '$.skill'), json_extract_string(arguments_json, '$.name')), ',' ORDER BY coalesce(json_extract_string(arguments_json, '$.skill'), json_extract_string(arguments_json, '$.name'))) FILTER (WHERE tool_name = 'Skill'), '') AS skill_names,
        count(*) FILTER (WHERE shell AND regexp_matches(coalesce(command, '') || ' ' || args, '\\.claude/skills|\\.codex/skills|\\.pi/skills')) AS skill_sideloads, count(*) FILTER (WHERE rd AND regexp_matches(f, '/skills/|SKILL[.]md')) AS skill_file_reads,
        count(*) FILTER (WHERE tool_name = 'exec' AND coalesce(command, '') = '' AND contains(args, '.md') AND regexp_matches(args, 'sed -n|cat |head ')) AS exec_md_read_cmds, CAST(sum(CASE WHEN asks THEN helped ELSE 0 END) AS BIGINT) AS embedded_help_calls, count(*) FILTER (WHERE asks AND helped = 0) AS help_flag_or_other,
        count(*) FILTER (WHERE (contains(f, 'pkg/doc/') AND f LIKE '%.md') OR contains(f, 'doc/topics/') OR (shell AND regexp_matches(anytext, 'pkg/doc/|doc/topics/') AND regexp_matches(anytext, 'cat |head |sed -n|ls '))) AS embedded_doc_reads,
        count(*) FILTER (WHERE rd AND f LIKE '%.md' AND contains(f, '/ttmp/')) AS md_reads_ticket, count(*) FILTER (WHERE rd AND f LIKE '%.md' AND NOT contains(f, '/ttmp/')) AS md_reads_other FROM d GROUP BY 1)
      SELECT s.session_id, title, working_directory, started_at, tool_call_count, coalesce(skill_loads, 0) AS skill_loads, coalesce(skill_names, '') AS skill_names, coalesce(skill_sideloads, 0) AS skill_sideloads, coalesce(skill_file_reads, 0) AS skill_file_reads, coalesce(exec_md_read_cmds, 0) AS exec_md_read_cmds,
        coalesce(embedded_help_calls, 0) AS embedded_help_calls, coalesce(help_flag_or_other, 0) AS help_flag_or_other, coalesce(embedded_doc_reads, 0) AS embedded_doc_reads, coalesce(md_reads_ticket, 0) AS md_reads_ticket, coalesce(md_reads_other, 0) AS md_reads_other FROM sessions s LEFT JOIN g USING (session_id)""",
    "vrb_10": f"""WITH {_PROBES} SELECT session_id, wave, arg_min(turn, row("timestamp", tool_call_id, turn)) AS first_turn, arg_max(turn, row("timestamp", tool_call_id, turn)) AS last_turn, count(*) AS probes, array_to_string(list_sort(list_distinct(flatten(list(repos)))), ',') AS repos, coalesce(array_to_string(list_sort(list_distinct(flatten(list(symbols)))), ','), '') AS symbols FROM pr GROUP BY 1, 2""",
    "vrb_10_repeats": f"""WITH {_PROBES}, e AS (SELECT session_id, wave, unnest(symbols) AS symbol FROM pr) SELECT session_id, symbol, count(DISTINCT wave) AS waves, count(*) AS probes FROM e WHERE NOT starts_with(symbol, '[read') GROUP BY 1, 2 HAVING count(DISTINCT wave) >= 2""",
}

HISTORY = {
    "vrb_03": file_history, "vrb_03_timeline": file_timeline, "vrb_04": ticket_timeline, "vrb_04_summary": ticket_summary, "vrb_05": context_window, "vrb_07": episodes,
    "vrb_08": failure_triage, "vrb_09": doc_consumption, "vrb_10": source_probes, "vrb_10_repeats": repeated_probes,
}
