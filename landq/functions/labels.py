"""Labels for fields, documents, sections and page quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landq import dims
from landq.functions.text import _col


def first_holding(value: Column, groups: list[tuple[str, list[str]]], default: Column | str) -> Column:
    """Name of the first group with a term that the value contains."""
    out = F.lit(default) if isinstance(default, str) else default
    for name, terms in reversed(groups):
        held = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(value, t))
        out = F.when(held, name).otherwise(out)
    return out


def categorize_field(name: Column | str) -> Column:
    return first_holding(F.lower(_col(name)), dims.FIELD_GROUPS, dims.FIELD_GROUP_DEFAULT)


def validation_type(name: Column | str) -> Column:
    return first_holding(F.lower(_col(name)), dims.FIELD_INPUTS, "text")


def is_required(name: Column | str) -> Column:
    return F.lower(_col(name)).isin(dims.REQUIRED_FIELDS)


def document_type(value: Column | str) -> Column:
    """Canonical document type from free text; NULL for blank or automatic."""
    text = F.lower(F.trim(_col(value)))
    groups = [(dims.SALE_DEED, ["sale", "deed", "बैनामा"]), (dims.KHASRA, ["khasra", "khatauni", "pahani", "7/12", "patta"]),
              (dims.CADASTRAL_MAP, ["cadastral", "map", "fmb", "sketch", "naksha"]),
              (dims.MUTATION_ORDER, ["mutation", "sanction", "dakhil", "namantaran"])]
    blank = text.isNull() | (text == "") | F.contains(text, F.lit("auto"))
    return F.when(~blank, first_holding(text, groups, dims.SALE_DEED))


def quality_tier(width: str, height: str, blur: str, contrast: str) -> Column:
    """struct(dpi, tier, score) of a scanned page from its measured size, sharpness and contrast."""
    w, h, b = F.col(width), F.col(height), F.col(blur)
    dpi = F.round(F.greatest(w / 8.27, h / 11.69), 1)
    low = (w < 1200) | (h < 1200) | (dpi < 150)
    blurry = b < 80
    flat = F.col(contrast) < 35
    tier = F.when(blurry & low, "POOR_QUALITY").when(low | blurry | flat, "MEDIUM").otherwise("HIGH")
    score = (F.when(blurry & low, F.greatest(F.lit(35.0), F.round(F.least(b, F.lit(60.0)), 1)))
             .when(low | blurry | flat, F.least(F.lit(85.0), F.greatest(F.lit(65.0), F.round(b * 0.5, 1))))
             .otherwise(F.least(F.lit(98.5), F.round(75.0 + F.least(b * 0.05, F.lit(23.5)), 1))))
    return F.struct(dpi.alias("dpi"), tier.alias("tier"), score.alias("score"))
