"""Exchange steps of chat transcripts: islands of assistant and tool nodes between user turns, and calls from code nodes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "path string, line_no long, role string, author string, recipient string, content_type string, exchange_id string, text string, model string, created double, failed boolean"


def _nodes(path: str, text: str, prefix: str) -> Iterator[tuple]:
    doc = json.loads(text)
    name = doc.get("conversation_id") or doc.get("id") or path
    if not name.startswith(prefix):
        return
    tree, at, chain, seen = doc.get("mapping") or {}, doc.get("current_node"), [], set()
    while at in tree and at not in seen:
        seen.add(at)
        chain.append(tree[at].get("message") or {})
        at = tree[at].get("parent")
    for i, m in enumerate(reversed(chain)):
        author, meta, content = m.get("author") or {}, m.get("metadata") or {}, m.get("content") or {}
        if not author.get("role") or meta.get("is_visually_hidden_from_conversation") or (author["role"] == "system" and m.get("weight") == 0):
            continue
        parts = [p if isinstance(p, str) else p.get("text", "") for p in content.get("parts") or []]
        thoughts = [t.get("content", "") for t in content.get("thoughts") or []]
        said = "\n".join(p for p in parts + thoughts if p) or content.get("text") or content.get("content") or ""
        if not said.strip() and content.get("content_type") in ("code", "thoughts"):
            continue
        yield name, i, author["role"], author.get("name"), m.get("recipient"), content.get("content_type"), meta.get("turn_exchange_id"), said, meta.get("model_slug"), m.get("create_time"), content.get("content_type") == "system_error"


def transcript_nodes(spark: SparkSession, folder: str, id_prefix: str = "") -> DataFrame:
    """Nodes of the JSON transcripts of a folder, from the root to the current one; path is the conversation's id."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, value in zip(pdf["file"], pdf["value"]):
                yield pd.DataFrame(list(_nodes(file, value, id_prefix)), columns=[c.split()[0] for c in NODES.split(", ")])

    return files.mapInPandas(run, NODES)


def steps(nodes: DataFrame) -> DataFrame:
    """nodes with step and step_kind: user turns and system notes stand alone, assistant and tool nodes of one exchange belong together."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    kind = F.when(F.col("role") == "user", "user").when(F.col("role").isin("assistant", "tool") | ((F.col("role") == "system") & (blank("exchange_id") != "")), "assistant").otherwise("system")
    w = Window.partitionBy("path").orderBy("line_no")
    x = nodes.withColumn("step_kind", kind)
    before, other = F.lag("step_kind").over(w), F.lag(blank("exchange_id")).over(w)
    same = (F.col("step_kind") == "assistant") & (before == "assistant") & ((other == blank("exchange_id")) | (other == "") | (blank("exchange_id") == ""))
    return x.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("step", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("new")


def transcript_turns(stepped: DataFrame) -> DataFrame:
    """One turn per step: texts and thoughts joined in order, the last model, the time of the first node."""
    talk = ~F.col("content_type").eqNullSafe("code") & (F.col("role") != "tool")
    thought = F.col("content_type").isin("thoughts", "reasoning_recap")
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond & (F.col("text") != ""), F.struct("line_no", "text")))), lambda s: s["text"]), "\n\n")
    return stepped.groupBy("path", F.col("step").alias("turn_index")).agg(
        F.min("step_kind").alias("role"), joined(talk & ~F.coalesce(thought, F.lit(False))).alias("content"), F.nullif(joined(F.coalesce(thought, F.lit(False))), F.lit("")).alias("thinking"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("line_no"))).alias("model"),
        F.min_by("created", "line_no").alias("created"), F.max(F.nullif("exchange_id", F.lit(""))).alias("exchange_id"),
    )


def transcript_calls(stepped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, orphans) of steps.

    Each code node is a call and takes all tool nodes of its step with its tool's name
    that no earlier code node took (any, if it names none).  Tool nodes that none takes
    are orphans.
    """
    code = stepped.where((F.col("content_type") == "code") & (F.col("role") == "assistant"))
    name = F.coalesce(F.nullif(F.nullif("recipient", F.lit("all")), F.lit("")), F.nullif("author", F.lit("")))
    i = F.row_number().over(Window.partitionBy("path", "step").orderBy("line_no")) - 1
    code = code.select("path", "step", F.col("line_no").alias("code_line"), name.alias("tool"), F.col("text").alias("arguments"), "exchange_id", i.alias("n"))
    tools = stepped.where("role = 'tool'").select("path", "step", "line_no", F.coalesce("author", F.lit("")).alias("author"), "text", "failed")
    owner = tools.join(code.select("path", "step", "code_line", "tool"), ["path", "step"]).where(F.col("tool").isNull() | (F.col("tool") == F.col("author"))).groupBy("path", "step", "line_no").agg(F.min("code_line").alias("code_line"))
    taken = tools.join(owner, ["path", "step", "line_no"])
    got = taken.groupBy("path", "step", "code_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("result"), F.min_by("author", "line_no").alias("answered_by"), F.max("failed").alias("failed"), F.count(F.lit(1)).alias("tool_nodes"))
    c = code.join(got, ["path", "step", "code_line"], "left")
    ident = F.concat_ws("-", F.lit("chatgpt-tool"), F.nullif("exchange_id", F.lit("")), F.col("n").cast("string"))
    calls = c.select("path", F.col("step").alias("turn_index"), ident.alias("tool_call_id"), F.coalesce("tool", F.nullif("answered_by", F.lit("")), F.concat(F.lit("unknown-"), F.col("n").cast("string"))).alias("tool_name"), "arguments", "result", (~F.coalesce("failed", F.lit(False))).cast("long").alias("success"), F.coalesce("tool_nodes", F.lit(0)).alias("tool_nodes"))
    return calls, tools.join(owner.select("path", "step", "line_no"), ["path", "step", "line_no"], "left_anti")
