"""Lookups and state changes on a small store."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.operators import repository as repo
from quern.schemas import TABLES


@pytest.fixture(scope="module")
def store(spark):
    rows = {
        "catalogs": [dict(id="c1", name="A"), dict(id="c2", name="B", parent_id="c1"), dict(id="c3", name="C", parent_id="c1", deleted_at="2024-01-01")],
        "files": [dict(id="f1", sha256="x", ingest_status="done"), dict(id="f2", sha256="x", ingest_status="pending"), dict(id="f3", sha256="y", ingest_status="pending", deleted_at="2024-01-01")],
        "file_entries": [
            dict(id="e1", file_id="f1", catalog_id="c1", folder_id=None, display_name="b", lifecycle="active", updated_at="2024-01-02"),
            dict(id="e2", file_id="f2", catalog_id="c1", folder_id="d", display_name="a", lifecycle="demoted", updated_at="2024-01-03"),
            dict(id="e3", file_id="f3", catalog_id="c2", folder_id="d", display_name="z", lifecycle="active", updated_at="2024-01-04"),
            dict(id="e4", file_id="f1", catalog_id="c2", folder_id="d", display_name="y", lifecycle="active", deleted_at="2024-01-05"),
        ],
        "tags": [dict(id="t1", name="one", facet="topic", doc_count=3), dict(id="t2", name="two", facet="topic", doc_count=5), dict(id="t3", name="uno", facet="topic", alias_of="t1")],
        "entry_tags": [dict(entry_id="e1", tag_id="t1", source="user"), dict(entry_id="e2", tag_id="t2", source="user"), dict(entry_id="e4", tag_id="t2", source="user")],
        "entry_relations": [dict(id="r1", entry_a_id="e1", entry_b_id="e2", observation_count=4), dict(id="r2", entry_a_id="e1", entry_b_id="e4", observation_count=9), dict(id="r3", entry_a_id="e2", entry_b_id="e3", observation_count=1, vetted=True)],
        "journal": [dict(id="j1", source_kind="insight", entry_ids=["e1"], created_at="2024-01-01"), dict(id="j2", source_kind="note", entry_ids=["e2", "e1"], created_at="2024-01-02"), dict(id="j3", source_kind="note", entry_ids=["e1"], created_at="2024-01-03", superseded_by_id="j2")],
        "conversations": [
            dict(id="v1", session_id="s1", turn_index=0, ended_at="2024-01-01", llm_calls=[dict(mode="fast", input_tokens=3, output_tokens=1)]),
            dict(id="v2", session_id="s1", turn_index=1, llm_calls=[dict(mode="deep", input_tokens=4, output_tokens=2), dict(mode=None, input_tokens=None, output_tokens=1)]),
        ],
        "sessions": [dict(id="s1"), dict(id="s2")],
        "task_outcomes": [dict(task_kind="k", object_kind="e", object_id="e1", outcome="noop", completed_at="2024-01-01"), dict(task_kind="k", object_kind="e", object_id="e1", outcome="applied", completed_at="2024-01-02")],
        "audit_events": [dict(kind="ingest_status", payload='{"file_id": "f2", "status": "failed", "reason": "bad"}', occurred_at="2024-01-01"), dict(kind="ingest_status", payload='{"file_id": "f2", "status": "failed", "reason": "worse"}', occurred_at="2024-01-02")],
    }
    import json

    return {n: spark.read.schema(TABLES[n]).json(spark.sparkContext.parallelize([json.dumps(r) for r in found])) for n, found in rows.items()}


def ids(df) -> list:
    return [r.id for r in df.collect()]


def some(spark, *values):
    return spark.createDataFrame([Row(id=v) for v in values], "id string")


def test_trees(spark, store):
    c = store["catalogs"]
    assert ids(repo.children(c, "c1")) == ["c2"] and ids(repo.children(c, None)) == ["c1"]
    assert repo.count_children(c, "c1").first().n == 1 and ids(repo.child_named(c, "c1", "B")) == ["c2"] and not ids(repo.child_named(c, "c1", "B", "c2"))
    assert {r.id: r.name for r in repo.names(c, some(spark, "c3", "c9")).collect()} == {"c3": "C"}
    assert ids(repo.entries_in(store["file_entries"], store["files"], "catalog_id", "c1")) == ["e2", "e1"]
    assert ids(repo.newest_in_catalog(store["file_entries"], "c1", 1)) == ["e2"]
    moved = repo.reassign(store["file_entries"], "c1", None, "2024-02-01")
    assert moved.filter("catalog_id IS NULL").count() == 2 and moved.schema == store["file_entries"].schema


def test_entries_and_files(spark, store):
    e, f = store["file_entries"], store["files"]
    assert sorted(ids(repo.with_file(e, f))) == ["e1", "e2"] and repo.with_file(e, f, any_state=True).count() == 4
    assert ids(repo.active_with_file(e, f)) == ["e1"] and ids(repo.recently_updated(e, 5)) == ["e3", "e1"]
    assert {r.id: r.in_use for r in repo.file_in_use(f, e).collect()} == {"f1": True, "f2": True, "f3": True}
    assert ids(repo.oldest_by_content(f, "x")) == ["f1"] and ids(repo.file_ids(f, "pending")) == ["f2"]
    assert ids(repo.file_ids_of(f, e, "folder_id", some(spark, "d"))) == ["f2"]
    failed = repo.fail_ingest(f, some(spark, "f1", "f2", "f3"), "2024-02-01")
    assert {r.id: r.ingest_status for r in failed.collect()} == {"f1": "done", "f2": "failed", "f3": "pending"}
    assert sorted(ids(repo.without_ids(e, some(spark, "e1", "e2")))) == ["e3", "e4"]


def test_tags_and_relations(spark, store):
    et, t, e, r = (store[n] for n in ("entry_tags", "tags", "file_entries", "entry_relations"))
    assert [(x.entry_id, x.name) for x in repo.tags_of(et, t, some(spark, "e1")).collect()] == [("e1", "one")]
    assert repo.live_pairs(et, e).count() == 2 and repo.live_pairs(et, e, active_only=True).count() == 1
    assert ids(repo.canonical(t, "topic", 5)) == ["t2", "t1"]
    assert sorted(ids(repo.relations_touching(r, some(spark, "e2")))) == ["r1", "r3"] and ids(repo.relations_touching(r, some(spark, "e2"), keep=False)) == ["r2"]
    assert repo.vetted_pairs(r).count() == 1 and ids(repo.vet_candidates(r, e, 2, 10)) == ["r1"]
    judged = repo.record_verdicts(r, spark.createDataFrame([("r1", False)], "id string, vetted boolean"), "2024-02-01")
    got = {x.id: (x.vetted, x.vetted_observation_count) for x in judged.collect()}
    assert got == {"r1": (False, 4), "r2": (None, None), "r3": (True, None)}


def test_notes_sessions_outcomes(spark, store):
    j, v = store["journal"], store["conversations"]
    assert ids(repo.active_notes(j)) == ["j2", "j1"] and ids(repo.active_notes(j, "insight")) == ["j1"]
    assert ids(repo.notes_about(j, ["e1"], "2024-01-02", 5)) == ["j1"]
    assert ids(repo.active_notes(repo.supersede(j, "j1", "j2"))) == ["j2"] and ids(repo.active_notes(repo.invalidate(j, some(spark, "j2"), "2024-02-01"))) == ["j1"]
    assert ids(repo.last_turns(v)) == ["v2"] and ids(repo.last_turns(v, unfinished=True)) == ["v2"]
    assert [tuple(x) for x in repo.session_modes(v).collect()] == [("s1", "deep")]
    assert {x.id: (x.turn_count, x.total_input_tokens, x.total_output_tokens) for x in repo.rolled_up(store["sessions"], v).collect()} == {"s1": (2, 7, 4), "s2": (0, 0, 0)}
    o = store["task_outcomes"]
    assert repo.outcomes_since(o, "k", "e").count() == 1 and repo.outcomes_since(o, "k", "e", "2024-03-01").count() == 0
    assert [x.outcome for x in repo.latest_outcomes(o).collect()] == ["applied"]
    assert [tuple(x) for x in repo.latest_failures(store["audit_events"], some(spark, "f2")).collect()] == [("f2", "worse")]
    assert repo.oldest(j, "created_at").first().oldest.day == 1
    assert repo.change(j, F.lit(None).cast("boolean"), note="x").filter("note = 'x'").count() == 0
