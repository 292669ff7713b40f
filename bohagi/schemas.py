"""Schemas of the data model as DDL; sources never infer one."""

from __future__ import annotations

BOX = "x0: double, y0: double, x1: double, y1: double"
LINE = f"id: string, bbox: struct<{BOX}>, polygon: array<array<double>>, text: string, confidence: double, order: int"
REGION = f"id: string, label: string, bbox: struct<{BOX}>, confidence: double, order: int, lines: array<struct<{LINE}>>"
PAGE = f"number: int, width: double, height: double, regions: array<struct<{REGION}>>"
DOCUMENT = f"schema_version string, language string, source string, pages array<struct<{PAGE}>>, metadata map<string,string>"
CORPUS_LINE = "id string, text string, split string, source_language string, source_title string, license string"
WORD_CROP = "id string, image binary, text string, valid boolean, validation_reason string, image_sha256 string, image_width int, image_height int, ctc_required_steps int, source_language string, source_config string, split string"
SILVER_LINE = "id string, image binary, text string, prediction string, alignment_score float, bootstrap_confidence float, source string, source_language string, source_document string, source_page string, source_revision long, source_image_sha256 string, source_license string, transcription_license string, split string"
SYNTHETIC_LINE = "id string, image binary, text string, source_language string, source_config string, font string"

#: Layout classes by detector id; an id outside them is unknown.
LAYOUT_LABELS = (
    "caption", "footnote", "formula", "list_item", "page_footer", "page_header", "picture", "section_header", "table", "text", "title",
    "document_index", "code", "checkbox_selected", "checkbox_unselected", "form", "key_value_region",
)
