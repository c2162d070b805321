"""Record layouts and vocabularies of documents, workbooks, metrics and logs."""

from __future__ import annotations

from pyspark.sql import types as T

# The names that the contract allows.
BLOCK_TYPES = ("section_header", "subsection_header", "question_label", "checkbox_option", "radio_option", "text_input", "text_area", "date_input", "display", "signature_field", "table_header", "table_cell", "page_header", "page_footer", "unknown")
RELATIONS = ("option_of", "input_of", "row_of", "child_of_section")
SOURCES = ("rule", "llm", "merge")
ORIGINS = ("top_left", "bottom_left")
VERDICTS = ("yes", "no", "unknown")
LEAST_CONFIDENCE, MOST_CONFIDENCE = 0.05, 0.99

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BBOX = record(x0=D, y0=D, x1=D, y1=D, coord_origin=S)
LINK = record(parent_block_id=S, relation=S)
BLOCK = record(block_id=S, page=I, reading_order=I, bbox=BBOX, text=S, block_type=S, confidence=D, parent_link=LINK, branching_logic=S, sequence=I, question_type=S, provenance=record(source=S))
DOCUMENT = record(schema_version=S, source=record(sha256=S, page_count=I), blocks=T.ArrayType(BLOCK), _placeholder=B)
#: A cell's value: its kind (s, n, d, b; null if blank), its text, and the typed value.
VALUE = record(kind=S, s=S, n=D, d=T.DateType(), b=B)
CELL = record(workbook=S, sheet=S, row=I, col=I, value=VALUE, formula=S, is_merged_origin=B, merged_from=record(row=I, col=I))
_LIST = T.ArrayType(S)
SHEET = record(workbook=S, sheet=S, position=I, header_row=I, headers=_LIST, data_start_row=I, data_end_row=I, merged_ranges=_LIST, frozen_panes=S, data_validations=_LIST, named_ranges=_LIST, sheet_names=_LIST)
FIXTURE = record(id=S, pdf_path=S, golden_xlsx_path=S, reference_xlsx_path=S, question_sheet=S, header_row=I, template_version=S, schema_version=S, notes=S)
METRIC = record(name=S, value_double=D, value_bool=B, value_long=L, value_string=S, details=T.MapType(S, S), passed=B)
LOG = record(cost_usd=D, cache_hit=B, llm_call=B, routed=B, block=B)


def json_schema() -> dict:
    """The contract of an enriched document as JSON Schema."""
    number, text = {"type": "number"}, {"type": "string"}

    def closed(properties: dict, required: list[str]) -> dict:
        return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}

    def maybe(kind: dict) -> dict:
        return {"anyOf": [kind, {"type": "null"}], "default": None}

    block = closed(
        {
            "block_id": text,
            "page": {"type": "integer", "minimum": 1},
            "reading_order": {"type": "integer"},
            "bbox": closed({k: number for k in ("x0", "y0", "x1", "y1")} | {"coord_origin": {"enum": list(ORIGINS), "default": ORIGINS[0]}}, ["x0", "y0", "x1", "y1"]),
            "text": text,
            "block_type": {"enum": list(BLOCK_TYPES)},
            "confidence": {"type": "number", "minimum": LEAST_CONFIDENCE, "maximum": MOST_CONFIDENCE},
            "parent_link": maybe(closed({"parent_block_id": text, "relation": {"enum": list(RELATIONS)}}, ["parent_block_id", "relation"])),
            "branching_logic": maybe(text),
            "sequence": maybe({"type": "integer"}),
            "question_type": maybe(text),
            "provenance": closed({"source": {"enum": list(SOURCES)}}, ["source"]),
        },
        ["block_id", "page", "reading_order", "bbox", "text", "block_type", "confidence", "provenance"],
    )
    source = closed({"sha256": text, "page_count": {"type": "integer"}}, ["sha256", "page_count"])
    return closed({"schema_version": text, "source": source, "blocks": {"type": "array", "items": block}}, ["schema_version", "source", "blocks"])
