"""Text rules as column expressions; patterns go through the DataFrame API, never through SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, FIXTURE_CALLOUT, FIXTURE_ROOMS, PLAUSIBLE_SHEET, SHORT_TAG, WALL_TAG, Config
from .geometry import col


def strip(text) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)^\s+|\s+$", "")


def normalize(text) -> Column:
    """White space collapsed, upper case."""
    return F.upper(F.regexp_replace(strip(text), r"(?U)\s+", " "))


def letters(text) -> Column:
    """Upper case, letters alone."""
    return F.regexp_replace(F.upper(F.coalesce(col(text), F.lit(""))), r"[^\p{L}]", "")


def callouts(text, config: Config = DEFAULT) -> Column:
    """The tokens that look like sheet callouts, in order, repeats included."""
    return F.filter(F.split(strip(text), r"[\s,;/]+"), lambda t: t.rlike(config.text_sheet_callout_pattern))


def room_match(text, config: Config = DEFAULT) -> Column:
    """(room_type, substring) of the first pattern, in the order of the list, that the text holds."""
    listed = [(room, word) for room, words in config.room_type_label_patterns for word in words]
    patterns = F.array(*[F.struct(F.lit(r).alias("room_type"), F.lit(w).alias("substring")) for r, w in listed])
    norm = normalize(text)
    return F.get(F.filter(patterns, lambda p: F.contains(norm, p["substring"])), F.lit(0))


def fixture_room(kind) -> Column:
    k = F.lower(F.coalesce(col(kind), F.lit("")))
    out = None
    for room, words in FIXTURE_ROOMS:
        has = k.contains(words[0])
        for w in words[1:]:
            has = has | k.contains(w)
        out = F.when(has, F.lit(room)) if out is None else out.when(has, F.lit(room))
    return out


def classify(text, config: Config = DEFAULT) -> Column:
    """(classification, rule): the first rule that holds."""
    t = strip(text)
    blocked = F.upper(t).isin(*[str(x).upper() for x in config.text_grid_label_blocklist]) if config.text_grid_label_blocklist else F.lit(False)
    pair = lambda a, b: F.struct(F.lit(a).alias("classification"), F.lit(b).alias("rule"))
    return (
        F.when(t == "", pair("unknown", "empty_text"))
        .when(t.rlike(config.text_room_number_pattern), pair("room_number", "room_number_pattern"))
        .when(t.rlike(config.text_sheet_callout_pattern), pair("sheet_callout", "sheet_callout_pattern"))
        .when(t.rlike(config.text_grid_label_pattern) & ~blocked, pair("grid_label", "grid_label_pattern"))
        .when(t.rlike(config.text_dimension_pattern), pair("dimension", "dimension_pattern"))
        .when(t.rlike(WALL_TAG), pair("wall_schedule_tag", "wall_schedule_tag_pattern"))
        .when(room_match(t, config).isNotNull(), pair("room_label", "room_label_pattern"))
        .when(F.size(F.split(t, r"(?U)\s+")) >= 2, pair("note", "multiword_note_heuristic"))
        .otherwise(pair("unknown", "no_pattern_match"))
    )


def detail_number(text, sheet) -> Column:
    """Digits after the sheet's first mention that has any (null if none)."""
    found = F.call_function("regexp_extract", strip(text), F.concat(F.lit("\\Q"), col(sheet), F.lit("\\E\\s*[/,]?\\s*([0-9]{1,3})")), F.lit(1))
    return F.nullif(found, F.lit(""))


def needs_other_document(references, classification) -> Column:
    return (F.size(col(references)) > 0) | (col(classification) == "sheet_callout")


def target_category(sheet) -> Column:
    s = F.coalesce(col(sheet), F.lit(""))
    return (
        F.when(s.rlike(FIXTURE_CALLOUT), F.lit("fixture_callout_misclassified"))
        .when(s.rlike(PLAUSIBLE_SHEET), F.lit("plausible_sheet_id"))
        .when(s.rlike(SHORT_TAG), F.lit("grid_or_short_tag"))
        .otherwise(F.lit("other"))
    )


def number_or_group(text, pattern: str) -> Column:
    """The pattern's first group, or the whole match where it has none; null without a match."""
    import re

    group = 1 if re.compile(pattern).groups else 0
    t = strip(text)
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))


def version_number(name) -> Column:
    """Digits of a last part ``_vN`` of a file name's stem, else 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.element_at(F.split(col(name), "_"), -1), r"^v(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))


def short_name(name, most: int = 55) -> Column:
    return F.when(F.length(col(name)) > most, F.concat(F.substring(col(name), 1, most - 3), F.lit("…"))).otherwise(col(name))


def safe_stem(name) -> Column:
    return F.regexp_replace(col(name), "[^A-Za-z0-9_-]+", "_")


def status_bucket(status) -> Column:
    s = F.coalesce(col(status), F.lit(""))
    return F.when(s == "", F.lit("unknown")).otherwise(F.split_part(s, F.lit(":"), F.lit(1)))


def safe_ratio(top, bottom) -> Column:
    return F.when(col(bottom) > 0, col(top) / col(bottom)).otherwise(F.lit(0.0))


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))
