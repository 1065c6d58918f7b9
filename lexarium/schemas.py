"""Schemas of the entities."""

from __future__ import annotations

RAW_TICKET = (
    "link string, last_updated string, subject string, status string, department string, messages array<struct<role:string,content:string>>"
)
DATASET = (
    "chunk_id string, chunk_id_original string, conversation_id string, conversation_id_original string, ticket_id bigint, source string, "
    "source_type string, department string, subject string, status string, last_updated string, text string, text_raw string, char_len bigint, "
    "n_turns bigint, doc_id string, page_title string, page_number int, chunk_in_page int, ingest_label string, ingest_job_id string, ingested_at string"
)
PAGE = "source string, extracted_at string, extraction_status string, text string, page int, total_pages int, title string"
EVAL = (
    "query string, expected_ticket_ids array<bigint>, expected_conversation_ids array<string>, "
    "relevance_judgments array<struct<ticket_id:bigint,conversation_id:string,relevance:double>>, case_group string"
)
