"""Schemas of the stored tables. Hot metadata is promoted to columns; the rest stays in a map."""

from __future__ import annotations

DOCUMENT = "doc_id string, text string, source string, metadata map<string,string>"
CHUNK = "chunk_id string, doc_id string, seq long, text string, source string, context string, metadata map<string,string>"
RANKED = "query_id long, chunk_id long, score double, rank long, origin string"
MEMORY = (
    "record_id long, kind string, text string, subject string, tags array<string>, source string, authority double, status string,"
    " supersedes long, created_at timestamp, updated_at timestamp, metadata map<string,string>"
)
EVIDENCE = "query_id long, record_id long, similarity double, rank long, in_dense boolean, in_bm25 boolean"
CACHE = "entry_id long, query_norm string, scope string, embedding binary, created_at timestamp, payload string, version long, seq long"
PASSAGE = "chunk_id long, doc_id string, pos long, text string, heading string, source string, version long, seq long"
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
