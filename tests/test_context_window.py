from loomspark import schema
from loomspark.plans.history import NOT_SAID, context_window


def test_context_window(spark):
    turns = [(s, i, "user", "go on") for s in ("s1", "s2", "s3") for i in range(5)]
    turns[2] = ("s1", 2, "user", NOT_SAID[3] + " before")
    calls = [("s1", "c1", 1, "Read", 1, "/old"), ("s1", "c2", 2, "Read", 0, "/k/SKILL.md"), ("s1", "c3", 4, "Read", 1, "/k/SKILL.md"), ("s1", "c4", 3, "Skill", None, None), ("s2", "c5", 0, "Edit", 1, "/own"), ("s2", "c6", 9, "Edit", 1, "/late")]
    files = [("s2", "c5", "/a", "structured"), ("s2", "c5", "/b", "structured"), ("s2", "c5", "/c", "legacy_scalar"), ("s2", "c6", "/d", "structured")]
    rows = {
        "sessions": ("session_id string, agent_framework string", [("s1", "pi"), ("s2", "codex"), ("s3", None)]),
        "turns": ("session_id string, turn_index long, role string, content string", turns),
        "tool_calls": ("session_id string, tool_call_id string, emitting_turn_index long, tool_name string, success long, file_path string", calls),
        "files": ("session_id string, tool_call_id string, path string, evidence_kind string", files),
    }
    t = schema.empty(spark) | {name: schema.conform(spark.createDataFrame(data, ddl), name) for name, (ddl, data) in rows.items()}
    out = context_window(t)
    got = {r.session_id: (r.boundary_turn, r.boundary_source, r.tool_calls, r.failed, r.skill_loads, r.skill_file_reads, r.files_touched) for r in out.collect()}
    assert got == {"s1": (2, "summary", 3, 1, 1, 2, 1), "s2": (0, "session-start", 1, 0, 0, 0, 2), "s3": (0, "session-start", 0, 0, 0, 0, 0)}
    # boundaries are made once and exchanged: a task holds the sorts of a few joins, not of all
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    counts = plan.count("Join "), plan.count("RepartitionByExpression")
    assert counts[0] <= 9 and counts[1] >= 3, counts
