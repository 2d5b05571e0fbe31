"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from landq.operators.tables import POLYGON


def _fields(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


TEXT, LONG, INT, REAL, FLAG, TIME = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(),
                                     T.TimestampType())
BOX = _fields(("x", INT), ("y", INT), ("w", INT), ("h", INT))

LAND_RECORD = _fields(
    ("id", LONG), ("registration_number", TEXT), ("registration_date", TEXT), ("owner_name", TEXT),
    ("father_husband_name", TEXT), ("previous_owner", TEXT), ("current_owner", TEXT), ("ownership_type", TEXT),
    ("survey_number", TEXT), ("khasra_number", TEXT), ("khata_number", TEXT), ("plot_number", TEXT), ("village", TEXT),
    ("tehsil", TEXT), ("district", TEXT), ("state", TEXT), ("land_area", REAL), ("area_unit", TEXT),
    ("land_classification", TEXT), ("mutation_number", TEXT), ("document_type", TEXT), ("status", TEXT),
    ("verification_status", TEXT), ("publication_status", TEXT), ("document_status", TEXT), ("is_public", FLAG),
    ("confidence_score", REAL), ("source_type", TEXT), ("last_verification_date", TEXT),
    ("coordinates_geojson", POLYGON), ("created_at", TIME), ("updated_at", TIME))
CADASTRAL_RECORD = _fields(
    ("id", LONG), ("survey_number", TEXT), ("village", TEXT), ("district", TEXT), ("cadastral_area", REAL),
    ("survey_year", INT), ("geometry_type", TEXT), ("coordinates_geojson", POLYGON))
REGISTRATION = _fields(
    ("id", LONG), ("registration_number", TEXT), ("source", TEXT), ("owner_name", TEXT), ("father_husband_name", TEXT),
    ("survey_number", TEXT), ("khasra_number", TEXT), ("khata_number", TEXT), ("village", TEXT), ("tehsil", TEXT),
    ("district", TEXT), ("state", TEXT), ("land_area", REAL), ("land_classification", TEXT),
    ("registration_date", TEXT), ("expected_public_date", TEXT), ("status", TEXT), ("confidence_score", REAL),
    ("has_mismatch", FLAG), ("land_record_id", LONG), ("received_at", TIME))
EXTRACTED_FIELD = _fields(
    ("id", LONG), ("land_record_id", LONG), ("field_name", TEXT), ("field_label", TEXT), ("extracted_value", TEXT),
    ("corrected_value", TEXT), ("confidence", REAL), ("confidence_tier", TEXT), ("requires_review", FLAG),
    ("is_verified", FLAG), ("source_text", TEXT), ("ocr_confidence", REAL), ("page_number", INT), ("bounding_box", BOX))
OCR_LINE = _fields(
    ("doc_id", LONG), ("line_no", INT), ("text", TEXT), ("confidence", REAL), ("x1", INT), ("y1", INT), ("x2", INT),
    ("y2", INT))
ACTION = _fields(("event_id", LONG), ("record_id", LONG), ("action", TEXT), ("officer_name", TEXT), ("ts", TIME))
VERIFICATION = _fields(("event_id", LONG), ("ts", TIME), ("language_code", TEXT), ("corrections", LONG))
STATE_SOURCE = _fields(
    ("name", TEXT), ("code", TEXT), ("capital", TEXT), ("region", TEXT), ("survey_label", TEXT),
    ("admin_unit_label", TEXT), ("default_area_unit", TEXT), ("language_code", TEXT))
DISTRICT_SOURCE = _fields(("state_code", TEXT), ("district_name", TEXT), ("admin_units", T.ArrayType(TEXT)))
