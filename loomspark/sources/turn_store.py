"""Stores of turn snapshots (turns, turn_block_membership, blocks) to the session tables.

A store keeps a turn several times, each time with all blocks so far.  One snapshot of
each turn counts; a block counts where a conversation first shows it.  The best snapshot
is a grouped minimum; everything after it is windows over a conversation in the order of
its snapshots and blocks, so conversations are independent of each other and none is
folded in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.metrics import call_metrics, cut_bytes, idle_ratio, quality, timing, turn_metrics
from loomspark.operators.sequence import truncated_ratio
from loomspark.schema import conform
from loomspark.sources.cache import stored
from loomspark.sources.claude_lifecycle import cut_result

# Fixed values of the stores.
PHASES = ("final", "post_tools", "post_inference", "pre_inference")
SYSTEM_PROMPT = "You are an assistant"
PENDING = "no tool result received"
PROVIDERS = {"gpt-": "openai", "cerebras-": "cerebras", "together-": "together"}
TOOLS_BEFORE, TITLE_BYTES = 5, 80

STORE = {
    "turns": "conv_id string, session_id string, turn_id string, turn_created_at_ms long, runtime_key string, inference_id string, turn_metadata_json string, turn_data_json string",
    "turn_block_membership": "conv_id string, session_id string, turn_id string, phase string, snapshot_created_at_ms long, ordinal long, block_id string, content_hash string",
    "blocks": "block_id string, content_hash string, kind string, role string, payload_json string, block_metadata_json string",
}
CONV, TURN = ["path", "conv_id"], ["path", "conv_id", "session_id", "turn_id"]


def read_store(spark, paths) -> dict[str, DataFrame]:
    """The three tables of SQLite stores, with the path of each store."""
    from loomspark.sources.native import sqlite_rows

    out = {}
    for table, ddl in STORE.items():
        names = ", ".join(c.split()[0] for c in ddl.split(", "))
        parts = [sqlite_rows(spark, [p], f"SELECT {names} FROM {table}", ddl).withColumn("path", F.lit(p)) for p in paths]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        out[table] = df
    return out


def canonical(turns: DataFrame, membership: DataFrame) -> DataFrame:
    """turns with phase, snapshot_created_at_ms and snapshot_no: of each turn the best known phase, else any; then the latest.

    Snapshots of a conversation are numbered by time, session and turn.  Turns without
    a snapshot are left out; of unknown phases at one time the first by name counts.
    """
    known = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    rank = F.when(known > 0, known).otherwise(len(PHASES) + 1)
    best = membership.groupBy(*TURN).agg(F.min(F.struct(rank.alias("r"), (-F.col("snapshot_created_at_ms")).alias("t"), F.col("phase"))).alias("b"))
    own = turns.groupBy(*TURN).agg(F.min(F.struct("turn_created_at_ms", F.coalesce("runtime_key", F.lit("")).alias("runtime_key"))).alias("own"))
    out = own.join(best, TURN).select(*TURN, "own.*", F.col("b.phase").alias("phase"), (-F.col("b.t")).alias("snapshot_created_at_ms"))
    number = F.row_number().over(Window.partitionBy(*CONV).orderBy("turn_created_at_ms", "session_id", "turn_id"))
    return out.withColumn("snapshot_no", number.cast("long"))


def identified(snapshots: DataFrame, membership: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of the chosen snapshots with what makes two of them one block; null where the block lacks it."""
    at = [*TURN, "phase", "snapshot_created_at_ms"]
    b = membership.join(snapshots.select(*at, "snapshot_no", "turn_created_at_ms", "runtime_key"), at).join(blocks, ["path", "block_id", "content_hash"])
    key = F.get_json_object("payload_json", "$.id")
    kind = F.coalesce("kind", F.lit(""))
    by = lambda c: F.when(F.trim(c) != "", F.trim(c))
    of_role = lambda c: F.concat_ws("|", kind, F.coalesce("role", F.lit("")), by(c))
    identity = F.when(kind.isin("tool_call", "tool_use"), F.when(by(key).isNotNull(), F.concat_ws("|", kind, by(key)))).when(kind == "system", F.when(by(F.col("content_hash")).isNotNull(), of_role(F.col("content_hash")))).otherwise(F.when(by(F.col("block_id")).isNotNull(), of_role(F.col("block_id"))))
    return b.select(*CONV, F.col("session_id").alias("run_id"), "turn_id", "phase", "snapshot_no", "ordinal", "turn_created_at_ms", "runtime_key", kind.alias("kind"), "role", F.coalesce("payload_json", F.lit("{}")).alias("payload"), key.alias("call_id"), identity.alias("identity"))


def first_seen(blocks: DataFrame) -> DataFrame:
    """Each block of a conversation where it first shows up."""
    w = Window.partitionBy(*CONV, "identity").orderBy("snapshot_no", "ordinal")
    return blocks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _stamp(ms: str) -> Column:
    # beyond 1e12 the number is milliseconds, else seconds
    micros = F.when(F.col(ms) > 10**12, F.col(ms) * 1000).otherwise(F.col(ms) * 1000000)
    return F.date_format(F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _described(blocks: DataFrame, framework: str) -> DataFrame:
    """Blocks with their text, their role and source as a turn (null: none), and the assistant turns around them in their snapshot."""
    has_text = F.coalesce(F.array_contains(F.json_object_keys("payload"), "text"), F.lit(False))
    text = F.when(has_text, F.coalesce(F.get_json_object("payload", "$.text"), F.lit(""))).otherwise(F.col("payload"))
    b = blocks.withColumn("text", text).withColumn("timestamp", _stamp("turn_created_at_ms"))
    control = F.startswith(F.trim("text"), F.lit("<currentMode>")) | F.contains("text", F.lit("<modeSwitchGuidelines>")) | F.contains("text", F.lit(f"<{framework}:agent_mode_switch:v1>"))
    kind = F.col("kind")
    b = b.withColumns({
        "as_role": F.when(kind == "llm_text", "assistant").when(kind == "system", "system").when(kind == "user", F.when(control, "system").otherwise("user")),
        "as_source": F.when(kind == "llm_text", "model").when(kind == "system", F.when(F.col("text") == SYSTEM_PROMPT, "system").otherwise("framework")).when(kind == "user", F.when(control, "framework").otherwise("human")),
        "channel": F.when(kind == "system", F.when(F.col("text") == SYSTEM_PROMPT, "system_prompt").otherwise("framework_control")).when(kind == "user", F.when(control, "framework_control").otherwise("user_input")),
    })
    so_far = Window.partitionBy(*CONV).orderBy("snapshot_no", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("turn_index", F.when(F.col("as_role").isNotNull(), F.count("as_role").over(so_far) - 1))
    inside = Window.partitionBy(*CONV, "snapshot_no")
    own = F.when(F.col("as_role") == "assistant", F.col("turn_index"))
    # both looks run over rows before, in one order and in the other
    before = F.last(own, ignorenulls=True).over(inside.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(own, ignorenulls=True).over(inside.orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, -1))
    return b.withColumn("assistant_before", before).withColumn("assistant_after", after)


def _calls(b: DataFrame, framework: str) -> DataFrame:
    """Calls with the result that their own snapshot shows after them."""
    on = [*CONV, "snapshot_no", "call_id"]
    uses = b.where("kind = 'tool_use'").select(*on, F.col("ordinal").alias("use_ordinal"), F.coalesce(F.get_json_object("payload", "$.result"), F.lit("")).alias("text_result"), F.coalesce(F.get_json_object("payload", "$.error"), F.lit("")).alias("error_text"))
    c = b.where("kind = 'tool_call'").join(uses, on, "left")
    answered = F.coalesce(F.col("use_ordinal") > F.col("ordinal"), F.lit(False))
    success = answered & (F.trim("error_text") == "")
    order = Window.partitionBy(*CONV).orderBy("snapshot_no", "ordinal")
    name = F.coalesce(F.nullif(F.trim(F.get_json_object("payload", "$.name")), F.lit("")), F.lit("unknown"))
    c = c.withColumns({"answered": answered, "tool_name": name, "source_ordinal": (F.row_number().over(order) - 1).cast("long"), "n_calls": F.count(F.lit(1)).over(Window.partitionBy(*CONV)), "text_result": F.when(answered, F.col("text_result"))})
    cut = cut_result(F.col("text_result"))
    return c.withColumns({
        **cut, "tool_call_id": F.col("call_id"), "emitting_turn_index": F.coalesce("assistant_before", "assistant_after"), "operation_type": F.lit("EXECUTE"), "record_kind": F.lit("tool_call"), "arguments_json": F.get_json_object("payload", "$.args"), "success": success.cast("long"), "outcome_status": F.when(success, "succeeded").otherwise("failed"),
        "error": F.when(~answered, PENDING).when(~success, F.col("error_text")), "content_origin": F.lit("local_exec"), "position_in_session": F.col("source_ordinal") / F.col("n_calls"),
        "tools_before_json": F.to_json(F.collect_list("tool_name").over(order.rowsBetween(-TOOLS_BEFORE, -1))), "framework_metadata_json": F.to_json(F.create_map(F.lit(f"{framework}_kind"), F.col("kind"))), "raw_json": F.col("payload"),
    })


def _notes(snapshots: DataFrame, new: DataFrame, calls: DataFrame, uses: DataFrame, framework: str) -> DataFrame:
    """What the conversion notes, numbered in its order: resumed runs, results without a call, calls without a result, the snapshots taken."""
    note = lambda df, step, name, title, detail, tags, scope="session", target=F.lit("session"): df.select(
        *CONV, "snapshot_no", F.lit(step).alias("step"), F.coalesce(F.col("ordinal"), F.lit(0)).alias("at") if "ordinal" in df.columns else F.lit(0).cast("long").alias("at"),
        F.lit(name).alias("name"), F.lit(title).alias("title"), detail.alias("detail"), F.to_json(F.array(F.lit(framework), *tags)).alias("tags_json"), F.lit(scope).alias("scope_type"), target.alias("target_id"),
    )
    seen = Window.partitionBy(*CONV, "session_id").orderBy("snapshot_no")
    resumed = snapshots.withColumn("_r", F.row_number().over(seen)).where("_r = 1 and snapshot_no > 1")
    orphans = uses.join(calls.where("answered").select(*CONV, "snapshot_no", "call_id"), [*CONV, "snapshot_no", "call_id"], "left_anti")
    sizes = snapshots.join(new.groupBy(*CONV, "snapshot_no").agg(F.count(F.lit(1)).alias("n")), [*CONV, "snapshot_no"], "left").withColumn("new_block_count", F.coalesce("n", F.lit(0)))
    every = note(resumed, 0, "session-change", "Conversation resumed in new runtime session", F.to_json(F.struct("conv_id", "session_id", "turn_id")), [F.lit("session_id")])
    every = every.unionByName(note(orphans, 1, "tool-use-orphan", "Orphan tool_use block", F.col("payload"), [F.lit("tool_use"), F.lit("orphan")]))
    every = every.unionByName(note(calls.where("not answered"), 2, "tool-call-pending", "Tool call never received result", F.col("call_id"), [F.lit("tool_call"), F.lit("orphan")], "tool_call", F.col("call_id")))
    every = every.unionByName(note(sizes, 3, "snapshot", "Canonical snapshot selected", F.to_json(F.struct("conv_id", "new_block_count", "phase", "session_id", "snapshot_created_at_ms", "turn_id")), [F.lit("snapshot"), F.col("phase")]))
    number = F.row_number().over(Window.partitionBy(*CONV).orderBy("snapshot_no", "step", "at", "target_id")) - 1
    return every.withColumns({"annotation_id": F.concat_ws("-", F.lit("ann"), "name", number), "annotator": F.lit("adapter"), "category": F.lit("observation")})


def convert(store: dict[str, DataFrame], framework: str = "turn-store") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, diagnostics) of a store's three tables, each with its path; a conversation is a session.

    framework names the agent that kept the store, in sessions, tags and marks of its
    control texts.  A conversation with a block that has nothing to be known by (no
    block id, no content hash of a system text, no id of a call) is left out and told
    in the diagnostics (path, conv_id, message).  A result counts for a call of its own
    snapshot only; one that shows up later is noted as an orphan, and the call failed.
    Empty stores give empty tables.
    """
    snapshots = stored(canonical(store["turns"], store["turn_block_membership"]), "snapshots")
    every = identified(snapshots, store["turn_block_membership"], store["blocks"])
    blocks = stored(every, "blocks")
    bad = blocks.where("identity is null").groupBy(*CONV).agg(F.min(F.struct("snapshot_no", "ordinal", "kind")).alias("b"))
    bad = stored(bad.select(*CONV, F.concat("b.kind", F.lit(" block without an identity")).alias("message")), "bad")
    snapshots, blocks = snapshots.join(bad, CONV, "left_anti"), blocks.join(bad, CONV, "left_anti")
    new = stored(_described(first_seen(blocks), framework), "new")
    calls = stored(_calls(new, framework), "calls")
    thoughts = new.where("kind = 'reasoning' and trim(text) <> '' and assistant_after is not null").groupBy(*CONV, F.col("assistant_after").alias("turn_index"))
    thoughts = thoughts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n\n").alias("thinking"))
    kind = F.create_map(F.lit(f"{framework}_kind"), F.col("kind"), F.lit("original_role"), F.coalesce("role", F.lit("")), F.lit("turn_id"), F.col("turn_id"), F.lit("phase"), F.col("phase"), F.lit("session_id"), F.col("run_id"))
    turns = new.where("as_role is not null").join(thoughts, [*CONV, "turn_index"], "left")
    turns = turns.withColumns({"role": F.col("as_role"), "source": F.col("as_source"), "input_channel": F.col("channel"), "content": F.col("text"), "model": F.nullif("runtime_key", F.lit("")), "framework_metadata_json": F.to_json(kind)})
    as_session = lambda df: df.withColumn("session_id", F.col("conv_id"))
    t, c = stored(conform(as_session(turns), "turns"), "turns"), stored(conform(as_session(calls), "tool_calls"), "calls")
    heads = snapshots.groupBy(*CONV).agg(F.max_by("runtime_key", F.when(F.col("runtime_key") != "", F.col("snapshot_no"))).alias("model"), F.min("turn_created_at_ms").alias("first_ms"), F.max("turn_created_at_ms").alias("last_ms")).withColumn("session_id", F.col("conv_id"))
    to_ts = F.try_to_timestamp(_stamp("turn_created_at_ms"))
    m = heads.select("session_id").join(turn_metrics(t), "session_id", "left").join(call_metrics(c), "session_id", "left").join(timing(snapshots.select(F.col("conv_id").alias("session_id"), to_ts.alias("ts"))).drop("started", "ended"), "session_id", "left")
    m = m.fillna(0, ["turn_count", "tool_call_count", "read_count", "modify_count", "create_count", "execute_count", "delegate_count", "subagent_count"])
    m = stored(m.withColumns({"idle_ratio": idle_ratio(F.col("active_duration_seconds"), F.col("duration_seconds")), "read_ratio": truncated_ratio(F.col("read_count"), F.col("tool_call_count"))}), "metrics")
    flat = F.trim(F.replace("content", F.lit("\n"), F.lit(" ")))
    titles = t.where((F.col("role") == "user") & (F.col("source") == "human") & (flat != "")).groupBy("session_id").agg(F.min_by(flat, "turn_index").alias("said")).select("session_id", cut_bytes(F.col("said"), TITLE_BYTES).alias("title"))
    tools = c.groupBy("session_id").agg(F.to_json(F.array_sort(F.collect_set("tool_name"))).alias("tools_enabled_json"))
    s = heads.join(m, "session_id").join(titles, "session_id", "left").join(tools, "session_id", "left")
    low = F.lower(F.trim(F.coalesce("model", F.lit(""))))
    provider = F.coalesce(*[F.when(F.startswith(low, F.lit(k)), v) for k, v in PROVIDERS.items()], F.lit("unknown"))
    s = s.withColumns({
        "agent_framework": F.lit(framework), "source_format": F.lit(f"{framework}-turns-sqlite-v1"), "source_path": F.col("path"), "provider_hint": provider, "platform_type": F.lit("agent"), "started_at": _stamp("first_ms"), "ended_at": _stamp("last_ms"),
        "quality": quality(F.col("turn_count"), F.col("tool_call_count"), F.coalesce("any_result", F.lit(False))), "classification": F.lit("internal"), "for_research": F.lit(0), "needs_cleaning": F.lit(1), "contains_pii": F.lit(0),
    })
    listed = F.row_number().over(Window.partitionBy("session_id", "emitting_turn_index").orderBy("source_ordinal")) - 1
    uses = new.where("kind = 'tool_use'")
    return {
        "sessions": conform(s, "sessions"), "turns": t, "tool_calls": c, "annotations": conform(as_session(_notes(snapshots, new, calls, uses, framework)), "annotations"), "metrics": conform(m, "metrics"),
        "turn_tool_calls": conform(c.where("emitting_turn_index is not null").select("session_id", F.col("emitting_turn_index").alias("turn_index"), "tool_call_id", listed.alias("ordinal")), "turn_tool_calls"),
    }, bad
