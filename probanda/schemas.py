"""Table schemas as DDL, one per entity table plus the derived tables that flow between
operators; REFERENCES lists every foreign key for the integrity report.  Readers take
the text as it is; ``struct_of`` gives the StructType once a session exists."""

from __future__ import annotations

from pyspark.sql.types import StructType


def struct_of(table: str) -> StructType:
    return StructType.fromDDL(ENTITIES[table])


ENTITIES: dict[str, str] = {
    "users": "id string not null, username string not null, email string, created_at timestamp not null",
    "sessions": (
        "id string not null, user_id string, started_at timestamp not null, "
        "ended_at timestamp, status string not null"
    ),
    "projects": (
        "id string not null, user_id string, name string not null, description string, "
        "created_at timestamp not null, updated_at timestamp not null"
    ),
    "conversations": (
        "id string not null, session_id string, project_id string, "
        "started_at timestamp not null, ended_at timestamp"
    ),
    "concepts": (
        "id string not null, name string not null, description string, "
        "created_at timestamp not null, updated_at timestamp not null"
    ),
    "definitions": (
        "id string not null, concept_id string, text string not null, source_id string, "
        "created_at timestamp not null"
    ),
    "sources": (
        "id string not null, title string not null, author string, url string, "
        "source_type string, created_at timestamp not null"
    ),
    "documents": (
        "id string not null, project_id string, source_id string, title string not null, "
        "file_path string, content_hash string, is_immutable boolean not null, "
        "created_at timestamp not null"
    ),
    "sections": (
        "id string not null, document_id string, heading string, order_index int not null, content string"
    ),
    "claims": (
        "id string not null, concept_id string, text string not null, confidence double, "
        "created_at timestamp not null"
    ),
    "evidence": (
        "id string not null, claim_id string, document_id string, section_id string, "
        "excerpt string, created_at timestamp not null"
    ),
    "arguments": (
        "id string not null, claim_id string, structure_json string, created_at timestamp not null"
    ),
    "questions": (
        "id string not null, session_id string, conversation_id string, text string not null, "
        "created_at timestamp not null"
    ),
    "answers": (
        "id string not null, question_id string, text string not null, confidence double, "
        "sources array<struct<document_id:string,title:string,source_type:string,url:string,concept_id:string>>, "
        "created_at timestamp not null"
    ),
    "examples": "id string not null, concept_id string, text string not null",
    "counterexamples": "id string not null, concept_id string, text string not null",
    "relationships": (
        "id string not null, source_type string not null, source_id string not null, "
        "target_type string not null, target_id string not null, "
        "relationship_type string not null, created_at timestamp not null"
    ),
    "annotations": (
        "id string not null, project_id string, target_type string not null, "
        "target_id string not null, text string not null, created_at timestamp not null"
    ),
    "references": (
        "id string not null, document_id string, citation_text string, url string, "
        "created_at timestamp not null"
    ),
    "summaries": (
        "id string not null, target_type string not null, target_id string not null, "
        "text string not null, created_at timestamp not null"
    ),
    "tasks": (
        "id string not null, project_id string, description string not null, "
        "status string not null, created_at timestamp not null"
    ),
    "settings": "key string not null, value string not null, updated_at timestamp not null",
    "memory_records": (
        "id string not null, tier string not null, scope_id string, content string not null, "
        "metadata string, created_at timestamp not null"
    ),
    "chunk_embeddings": (
        "id string not null, document_id string, chunk_text string not null, "
        "embedding array<double> not null, metadata string, created_at timestamp not null"
    ),
}

# (child table, child column, parent table); every parent key is ``id``.
REFERENCES: list[tuple[str, str, str]] = [
    ("sessions", "user_id", "users"),
    ("projects", "user_id", "users"),
    ("conversations", "session_id", "sessions"),
    ("conversations", "project_id", "projects"),
    ("definitions", "concept_id", "concepts"),
    ("documents", "project_id", "projects"),
    ("documents", "source_id", "sources"),
    ("sections", "document_id", "documents"),
    ("claims", "concept_id", "concepts"),
    ("evidence", "claim_id", "claims"),
    ("evidence", "document_id", "documents"),
    ("evidence", "section_id", "sections"),
    ("arguments", "claim_id", "claims"),
    ("questions", "session_id", "sessions"),
    ("questions", "conversation_id", "conversations"),
    ("answers", "question_id", "questions"),
    ("examples", "concept_id", "concepts"),
    ("counterexamples", "concept_id", "concepts"),
    ("annotations", "project_id", "projects"),
    ("references", "document_id", "documents"),
    ("tasks", "project_id", "projects"),
]

DEFAULTS = {
    "sessions": {"status": "active"},
    "documents": {"is_immutable": True},
    "tasks": {"status": "open"},
}

CHUNK_METADATA = "chunk_index int, char_start int, char_end int, concept_id string, url string, source_type string"
SOURCE_LIST = "array<struct<document_id:string,title:string,source_type:string,url:string,concept_id:string>>"

# Working tables between operators.
CHUNKS = (
    "chunk_id string, document_id string, ingest_order long, chunk_index int, char_start int, "
    "char_end int, concept_id string, chunk_text string, tokens array<string>, "
    "embedding array<double>"
)
RETRIEVED = (
    "query_id string, rank int, chunk_id string, document_id string, document_title string, "
    "chunk_text string, score double, semantic_score double, keyword_score double, "
    "concept_id string, url string, source_type string"
)
TRACE_EVENTS = (
    "trace_id string, seq long, stage string, event_type string, timestamp timestamp, "
    "duration_ms double, metadata string"
)
