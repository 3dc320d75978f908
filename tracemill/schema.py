"""Trace model: vocabularies, target fields and the measures that stay unknown when missing."""

from __future__ import annotations

# Vocabularies of the trace model.
OUTCOMES = ("completed", "error", "aborted", "unknown")
STATUSES = ("ok", "error", "unknown")
SEVERITIES = ("warning", "rejected", "duplicate")
FORMATS = ("jsonl", "csv", "parquet")

# Fields a mapping may fill, by entity, with their type.
TARGET_FIELDS: dict[str, dict[str, str]] = {
    "session": {
        "external_id": "string",
        "agent_name": "string",
        "started_at": "timestamp",
        "ended_at": "timestamp",
        "duration_ms": "long",
        "outcome": "string",
    },
    "model_call": {
        "sequence_index": "long",
        "model_name": "string",
        "provider_name": "string",
        "input_tokens": "long",
        "output_tokens": "long",
        "cache_read_tokens": "long",
        "cache_creation_tokens": "long",
        "duration_ms": "long",
        "started_at": "timestamp",
        "stop_reason": "string",
        "status": "string",
        "error_code": "string",
    },
    "tool_call": {
        "sequence_index": "long",
        "tool_name": "string",
        "status": "string",
        "duration_ms": "long",
        "started_at": "timestamp",
        "error_message": "string",
    },
}

#: Nullable without default: an unknown measure is never 0.
MEASURES = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "duration_ms", "result_size")
