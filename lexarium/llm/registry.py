"""The queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lexarium.llm import (
    byte_bpe,
    clustered_layout,
    decontaminate,
    filter_audit,
    html_extract,
    jaccard_join,
    language_id,
    license_scan,
    media,
    suffix_dedup,
    toxicity,
    url_filter,
    warc_zip,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_media": media.op5_media,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_clustered_layout": clustered_layout.op11_clustered_layout,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_warc": warc_zip.op13_warc,
    "pipeline": corpus_pipeline.run,
    # Parts of two queries' columns that SQL can tell.
    "license_places": license_scan.license_places,
    "media_payloads": media.media_payloads,
}

ORACLE_SQL: dict[str, str] = {
    "op7_jaccard_join": jaccard_join.ORACLE_SQL,
    "op10_url_filter": url_filter.oracle(),
    "op11_clustered_layout": clustered_layout.oracle(),
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_warc": warc_zip.ORACLE_SQL,
    "license_places": license_scan.places_sql(),
    "media_payloads": media.PAYLOADS,
}
