"""Schemas of the store's tables, as Spark takes them in text (closed value sets are in the comments)."""

from __future__ import annotations


def _struct(**columns: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in columns.items())


_TIMES = {"created_at": "timestamp", "updated_at": "timestamp"}
SECTION = "struct<id: string, title: string, summary: string, key_terms: array<string>, anchor: struct<unit: string, value: string>>"

TABLES: dict[str, str] = {
    "folders": _struct(id="string", parent_id="string", name="string", **_TIMES, deleted_at="timestamp"),
    # ingest_status: pending, processing, done, failed
    "files": _struct(
        id="string", storage_key="string", sha256="string", size_bytes="bigint", mime_type="string", original_ext="string", kind="string", summary="string",
        description=f"struct<text: string, sections: array<{SECTION}>, coverage: map<string, string>>", extra="string", ingest_status="string", ingested_at="timestamp", deleted_at="timestamp", **_TIMES,
    ),
    # lifecycle: active, demoted, archived, manual_active, manual_archived
    "file_entries": _struct(id="string", folder_id="string", file_id="string", display_name="string", lifecycle="string", catalog_id="string", extra="string", deleted_at="timestamp", purge_after="timestamp", **_TIMES),
    "catalogs": _struct(id="string", parent_id="string", name="string", tags="array<string>", description="string", **_TIMES, deleted_at="timestamp"),
    "views": _struct(id="string", name="string", filter_spec="string", **_TIMES),
    # facet: topic, form, time, source, language, extra
    "tags": _struct(id="string", name="string", facet="string", doc_count="int", alias_of="string", last_used_at="timestamp", reaffirm_count="int"),
    "tag_aliases": _struct(from_name="string", tag_id="string", created_at="timestamp"),
    "entry_tags": _struct(entry_id="string", tag_id="string", source="string", created_at="timestamp"),
    # entry_a_id < entry_b_id; vetted null: not judged
    "entry_relations": _struct(
        id="string", entry_a_id="string", entry_b_id="string", note="string", source_kind="string", observation_count="int", vetted="boolean", vetted_at="timestamp",
        vetted_observation_count="int", last_observed_at="timestamp", created_at="timestamp",
    ),
    "journal": _struct(id="string", conversation_id="string", note="string", entry_ids="array<string>", tags="array<string>", source_kind="string", superseded_by_id="string", invalidated_at="timestamp", created_at="timestamp"),
    "audit_events": _struct(id="string", occurred_at="timestamp", kind="string", session_id="string", conversation_id="string", task_id="string", payload="string"),
    "sessions": _struct(id="string", started_at="timestamp", ended_at="timestamp", turn_count="int", total_input_tokens="bigint", total_output_tokens="bigint", total_cost_estimate="decimal(12,6)", deleted_at="timestamp"),
    "conversations": _struct(
        id="string", session_id="string", turn_index="int", started_at="timestamp", ended_at="timestamp", user_message="string", agent_response="string",
        tool_calls="array<struct<name: string, arguments: string, duration_ms: bigint>>", llm_calls="array<struct<phase: string, model: string, mode: string, input_tokens: bigint, output_tokens: bigint>>",
    ),
    # status: pending, running, done, dead
    "tasks": _struct(id="string", kind="string", status="string", priority="int", dedup_key="string", payload="string", attempts="int", max_attempts="int", scheduled_at="timestamp", lease_until="timestamp", finished_at="timestamp", created_at="timestamp"),
    # outcome: applied, noop, rejected, deferred, error
    "task_outcomes": _struct(task_kind="string", object_kind="string", object_id="string", outcome="string", detail="string", completed_at="timestamp"),
}
