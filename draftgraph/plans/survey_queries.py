"""One query for each operator, over drawings derived from the test tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ROLES, ROOM_TYPES, Config
from ..functions import geometry as G
from ..functions import text as X
from ..operators import assemble, classify, evaluate, graph, grid, labels, openings, polygons, roles, rooms, texts, topology, validate, walls
from ..sources import bench_tables as B
from ..sources import drawings as D
from ..sources import pdf, sinks
from ..tables import grows
from . import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


P, T = B.paths_sql(), B.texts_sql()
WIDE_CONFIG = Config(wall_candidate_min_count=1000, wall_fallback_min_paths=500)


# --- inputs that several queries share -------------------------------------------------------------


def wall_table(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as walls with a thickness, roles and junction types by number."""
    p = B.paths(spark, sf).filter("kind = 'line'").withColumn("n", F.col("path_id").cast("long"))
    pick = lambda names, bq: F.get(F.array(*[F.lit(x) for x in names]), F.expr(bq).cast("int"))
    kinds = ("corner", "t-junction", "x-junction", "endpoint")
    return p.select(
        "plan_id", "ord", F.concat(F.lit("s"), "path_id").alias("segment_id"), "x0", "y0", "x1", "y1", (F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))).alias("length"),
        (2 + (F.col("n") % 37) / 4).alias("thickness"), pick(ROLES, "n % 6").alias("role"), pick(ROLES, "(n div 5) % 6").alias("role2"),
        pick(kinds, "n % 4").alias("start_junction_type"), pick(kinds, "(n div 3) % 4").alias("end_junction_type"), "stroke_width", "stroke_rgb", "is_dashed", "n",
    )


def _listed(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


W = (
    P
    + f""", walls AS (
  SELECT plan_id, ord, 's' || path_id AS segment_id, x0, y0, x1, y1, abs(x1 - x0) + abs(y1 - y0) AS length,
         2 + (path_id::BIGINT % 37) / 4.0::DOUBLE AS thickness, ({_listed(ROLES)})[(path_id::BIGINT % 6 + 1)::INT] AS role,
         ({_listed(ROLES)})[((path_id::BIGINT // 5) % 6 + 1)::INT] AS role2,
         (['corner','t-junction','x-junction','endpoint'])[(path_id::BIGINT % 4 + 1)::INT] AS start_junction_type,
         (['corner','t-junction','x-junction','endpoint'])[((path_id::BIGINT // 3) % 4 + 1)::INT] AS end_junction_type,
         stroke_width, gray, is_dashed, path_id::BIGINT AS n
  FROM paths WHERE kind = 'line'
)"""
)


def room_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles from suppliers as rooms."""
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    s = s.selectExpr("k div 4 AS plan_id", "cast(k % 4 AS int) AS room", "k", "cast((k * 97) % 600 AS double) AS a", "cast((k * 61) % 600 AS double) AS b", "cast(100 + (k % 5) * 50 AS double) AS w", "cast(80 + (k % 7) * 40 AS double) AS h")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, c, d = F.col("a"), F.col("b"), F.col("a") + F.col("w"), F.col("b") + F.col("h")
    kind = F.get(F.array(*[F.lit(x) for x in ROOM_TYPES]), (F.col("k") % 16).cast("int"))
    return s.select("plan_id", "room", F.concat(F.lit("r"), F.col("k").cast("string")).alias("room_id"), F.array(p(a, b), p(c, b), p(c, d), p(a, d), p(a, b)).alias("ring"), F.array().cast("array<array<struct<x: double, y: double>>>").alias("holes"), a.alias("rx0"), b.alias("ry0"), c.alias("rx1"), d.alias("ry1"), (F.col("w") * F.col("h")).alias("area"), kind.alias("room_type"), "k")


R = f"""
rooms AS (
  SELECT s_suppkey // 4 AS plan_id, (s_suppkey % 4)::INT AS room, 'r' || s_suppkey AS room_id, ((s_suppkey * 97) % 600)::DOUBLE AS rx0, ((s_suppkey * 61) % 600)::DOUBLE AS ry0,
         ((s_suppkey * 97) % 600 + 100 + (s_suppkey % 5) * 50)::DOUBLE AS rx1, ((s_suppkey * 61) % 600 + 80 + (s_suppkey % 7) * 40)::DOUBLE AS ry1,
         ((100 + (s_suppkey % 5) * 50) * (80 + (s_suppkey % 7) * 40))::DOUBLE AS area, ({_listed(ROOM_TYPES)})[(s_suppkey % 16 + 1)::INT] AS room_type, s_suppkey AS k FROM supplier
)"""


def drawing_table(spark: SparkSession, sf: str) -> DataFrame:
    """Drawing commands: a line, a rectangle, a curve, a quadrilateral or an unknown item for each path."""
    p = B.paths(spark, sf).withColumn("n", F.col("path_id").cast("long"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, c, d = (F.col(x) for x in ("x0", "y0", "x1", "y1"))
    c, d = c + 10, d + 4
    kind = F.get(F.array(*[F.lit(x) for x in ("l", "re", "c", "qu", "sh")]), (F.col("n") % 5).cast("int"))
    dashes = F.get(F.array(F.lit("[] 0"), F.lit("[2 2] 0"), F.lit("[a] 0"), F.lit(""), F.lit("[3] 1"), F.lit(None).cast("string")), (F.col("n") % 6).cast("int"))
    color = F.when(F.col("n") % 3 == 0, F.array(F.lit(0.9), F.lit(0.1), F.lit(0.0))).when(F.col("n") % 3 == 1, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    pts = F.when(kind.isin("l", "re"), F.array(pt(a, b), pt(c, d))).otherwise(F.array(pt(a, b), pt(c, b), pt(c, d), pt(a, d)))
    return p.select("plan_id", "ord", F.array(F.struct(kind.alias("kind"), pts.alias("pts"))).alias("items"), color.alias("color"), F.lit(None).cast("array<double>").alias("fill"), F.when(F.col("n") % 7 != 0, F.col("stroke_width")).alias("width"), dashes.alias("dashes"), F.lit(800.0).alias("page_height"), F.lit(0).alias("page_num"), "n")


DR = (
    P
    + """, draws AS (
  SELECT plan_id, ord, path_id::BIGINT AS n, (['l','re','c','qu','sh'])[(path_id::BIGINT % 5 + 1)::INT] AS kind, x0 AS a, y0 AS b, x1 + 10 AS c, y1 + 4 AS d,
         (['[] 0','[2 2] 0','[a] 0','','[3] 1',NULL])[(path_id::BIGINT % 6 + 1)::INT] AS dashes, CASE WHEN path_id::BIGINT % 7 <> 0 THEN stroke_width END AS width, path_id::BIGINT % 3 = 0 AS red FROM paths
)"""
)


def label_table(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the rooms: mostly right, some wrong detections, some rooms without."""
    r = room_table(spark, sf).filter("k % 9 <> 0")
    kind = F.when(F.col("k") % 6 == 0, "wrong_detection").when(F.col("k") % 5 == 0, "office").otherwise(F.col("room_type"))
    return r.select("plan_id", "room_id", kind.alias("correct_type"), "k")


L = R + """, labelled AS (
  SELECT plan_id, room_id, CASE WHEN k % 6 = 0 THEN 'wrong_detection' WHEN k % 5 = 0 THEN 'office' ELSE room_type END AS correct_type, k FROM rooms WHERE k % 9 <> 0
)"""


# --- text: the first slice -------------------------------------------------------------------------

_ROOM_WORDS = [(room, w) for room, words in Config().room_type_label_patterns for w in words]
_CASES = "\n".join(f"WHEN contains(upper(t), '{w}') THEN '{room}:{w}'" for room, w in _ROOM_WORDS)
_BLOCK = ", ".join(f"'{x}'" for x in Config().text_grid_label_blocklist)
_DIM = Config().text_dimension_pattern.replace("'", "''")
REGIONS = (
    T
    + f""", stripped AS (SELECT *, trim(text) AS t FROM texts
), matched AS (SELECT *, CASE {_CASES} END AS room_match, list_filter(regexp_split_to_array(t, '[\\s,;/]+'), lambda x: regexp_matches(x, '^[A-Z][0-9]+[.]?[0-9]*[a-z]?$')) AS refs FROM stripped
), regions AS (
  SELECT plan_id, ord, 't-' || lpad(ord::VARCHAR, 6, '0') AS text_region_id, t, refs, room_match, bx0, by0, bx1, by1,
    CASE WHEN t = '' THEN 'unknown:empty_text' WHEN regexp_matches(t, '^[0-9]{{2,4}}[a-zA-Z]?$') THEN 'room_number:room_number_pattern'
         WHEN regexp_matches(t, '^[A-Z][0-9]+[.]?[0-9]*[a-z]?$') THEN 'sheet_callout:sheet_callout_pattern'
         WHEN regexp_matches(t, '^[A-Z]{{1,2}}$|^[0-9]{{1,2}}$|^[A-Z][.][0-9]+$') AND upper(t) NOT IN ({_BLOCK}) THEN 'grid_label:grid_label_pattern'
         WHEN regexp_matches(t, '{_DIM}') THEN 'dimension:dimension_pattern'
         WHEN regexp_matches(t, '^[WCSwcs][-]?[0-9]{{1,3}}[a-z]?$') THEN 'wall_schedule_tag:wall_schedule_tag_pattern'
         WHEN room_match IS NOT NULL THEN 'room_label:room_label_pattern'
         WHEN len(regexp_split_to_array(t, '\\s+')) >= 2 THEN 'note:multiword_note_heuristic' ELSE 'unknown:no_pattern_match' END AS c
  FROM matched
)"""
)
_CATEGORY = "CASE WHEN regexp_matches(target_sheet, '^[A-Z]\\d+\\.$') THEN 'fixture_callout_misclassified' WHEN regexp_matches(target_sheet, '^[A-Z][A-Z\\-]?\\d+(\\.\\d+[a-z]?)?$') THEN 'plausible_sheet_id' WHEN regexp_matches(target_sheet, '^[A-Z]\\d$') THEN 'grid_or_short_tag' ELSE 'other' END"
XREFS = (
    REGIONS
    + f""", xrefs AS (
  SELECT plan_id, ord, text_region_id, t, split_part(c, ':', 1) AS context, u.target_sheet, u.k, {_CATEGORY} AS category,
         nullif(regexp_extract(t, replace(u.target_sheet, '.', '\\.') || '\\s*[/,]?\\s*([0-9]{{1,3}})', 1), '') AS target_detail
  FROM regions, (SELECT unnest(refs) AS target_sheet, (generate_subscripts(refs, 1) - 1)::INT AS k) u
)"""
)


def region_table(spark, sf):
    return texts.text_regions(B.text_blocks(spark, sf))


def reference_table(spark, sf):
    regions = region_table(spark, sf)
    return evaluate.enriched_references(texts.cross_references(regions), regions)


def _classified(spark, sf):
    return region_table(spark, sf).select("plan_id", "ord", "classification", "rule_triggered", F.concat_ws(",", "references").alias("refs"), "requires_cross_document_validation")


_STR01 = f"WITH {REGIONS} SELECT plan_id, ord, split_part(c, ':', 1) AS classification, split_part(c, ':', 2) AS rule_triggered, array_to_string(refs, ',') AS refs, (len(refs) > 0 OR split_part(c, ':', 1) = 'sheet_callout') AS requires_cross_document_validation FROM regions"
for _name in ("str01", "str08", "det05"):
    query(_name, _STR01)(_classified)


@query("str02", f"WITH {REGIONS} SELECT plan_id, ord, len(refs)::INT AS n_refs, array_to_string(refs, ',') AS refs FROM regions")
def _str02(spark, sf):
    return B.text_blocks(spark, sf).select("plan_id", "ord", F.size(X.callouts("text")).alias("n_refs"), F.concat_ws(",", X.callouts("text")).alias("refs"))


_XREF = f"WITH {XREFS} SELECT plan_id, ord, k, text_region_id AS source_text_region_id, target_sheet, target_detail, context FROM xrefs"


def _xrefs(spark, sf):
    return texts.cross_references(region_table(spark, sf)).select("plan_id", "ord", "k", "source_text_region_id", "target_sheet", "target_detail", "context")


for _name in ("str03", "str04"):
    query(_name, _XREF)(_xrefs)


@query("str05", f"WITH {REGIONS} SELECT plan_id, ord, split_part(room_match, ':', 1) AS room_type, split_part(room_match, ':', 2) AS substring FROM regions WHERE room_match IS NOT NULL")
def _str05(spark, sf):
    m = X.room_match("text")
    return B.text_blocks(spark, sf).select("plan_id", "ord", m["room_type"].alias("room_type"), m["substring"].alias("substring")).filter("room_type IS NOT NULL")


@query("str06", f"WITH {T} SELECT plan_id, ord, regexp_replace(upper(text), '[^A-Z]', '', 'g') AS norm, starts_with(regexp_replace(upper(text), '[^A-Z]', '', 'g'), 'BATH') AS bath FROM texts")
def _str06(spark, sf):
    return B.text_blocks(spark, sf).select("plan_id", "ord", X.letters("text").alias("norm"), X.letters("text").startswith("BATH").alias("bath"))


_FIX = ["Toilet 1", "kitchen sink", "RANGE", "cooktop", "Dryer", "furnace", "table", "HVAC unit", "boiler", "stove"]


@query("str07", f"SELECT p_partkey AS k, CASE WHEN contains(f, 'toilet') OR contains(f, 'sink') THEN 'bathroom' WHEN contains(f, 'stove') OR contains(f, 'range') OR contains(f, 'cooktop') THEN 'kitchen' WHEN contains(f, 'washer') OR contains(f, 'dryer') OR contains(f, 'laundry') THEN 'laundry' WHEN contains(f, 'hvac') OR contains(f, 'furnace') OR contains(f, 'boiler') THEN 'mechanical' END AS room_type FROM (SELECT p_partkey, lower(({_FIX})[(p_partkey % 10 + 1)::INT]) AS f FROM part)")
def _str07(spark, sf):
    kind = F.get(F.array(*[F.lit(x) for x in _FIX]), (F.col("p_partkey") % 10).cast("int"))
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), X.fixture_room(kind).alias("room_type"))


@query("str09", f"WITH {T} SELECT plan_id, ord, CASE WHEN regexp_matches(trim(text), '^[0-9]{{2,4}}[a-zA-Z]?$') THEN trim(text) END AS number, regexp_extract(trim(text), '^([0-9]+)[a-z]$', 1) AS digits FROM texts WHERE regexp_matches(trim(text), '^[0-9]')")
def _str09(spark, sf):
    return B.text_blocks(spark, sf).select("plan_id", "ord", X.number_or_group("text", Config().text_room_number_pattern).alias("number"), F.coalesce(X.number_or_group("text", "^([0-9]+)[a-z]$"), F.lit("")).alias("digits")).filter(F.regexp_like(F.trim("text"), F.lit("^[0-9]")))


@query("str10", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 12 END AS version FROM part")
def _str10(spark, sf):
    name = F.concat(F.lit("plan_a_"), F.when(F.col("p_partkey") % 3 == 0, F.lit("final")).otherwise(F.concat(F.lit("v"), (F.col("p_partkey") % 12).cast("string"))))
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), X.version_number(name).alias("version"))


@query("str11", "SELECT o_orderkey AS k, CASE WHEN length(n) > 55 THEN substr(n, 1, 52) || '…' ELSE n END AS name FROM (SELECT o_orderkey, repeat('plan ', (o_orderkey % 15)::INT) || o_orderkey AS n FROM orders)")
def _str11(spark, sf):
    n = F.concat(F.repeat(F.lit("plan "), (F.col("o_orderkey") % 15).cast("int")), F.col("o_orderkey").cast("string"))
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), X.short_name(n).alias("name"))


@query("str12", f"WITH {T} SELECT plan_id, ord, regexp_replace(text, '[^A-Za-z0-9_-]+', '_', 'g') AS stem FROM texts")
def _str12(spark, sf):
    return B.text_blocks(spark, sf).select("plan_id", "ord", X.safe_stem("text").alias("stem"))


@query("num01", "SELECT o_orderkey AS k, round_even((o_orderkey % 41) / 8.0::DOUBLE, 1) AS half_even, least(1.0::DOUBLE, greatest(0.25::DOUBLE, (o_orderkey % 9) / 8.0::DOUBLE)) AS clamped, o_orderkey // 7 AS floored, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 9)::DOUBLE / (o_orderkey % 5) ELSE 0.0::DOUBLE END AS ratio FROM orders")
def _num01(spark, sf):
    k = F.col("o_orderkey")
    return B.table(spark, sf, "orders").select(k.alias("k"), F.bround((k % 41) / 8, 1).alias("half_even"), X.clamp((k % 9) / 8, 0.25, 1.0).alias("clamped"), F.expr("o_orderkey div 7").alias("floored"), X.safe_ratio(k % 9, k % 5).alias("ratio"))


@query("dat01", "SELECT n_nationkey AS k, strftime(current_date, '%Y-%m-%d') AS today FROM nation")
def _dat01(spark, sf):
    return B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("today"))


@query("flt13", f"WITH {XREFS} SELECT target_sheet, category, count(*) AS n FROM xrefs GROUP BY ALL")
def _flt13(spark, sf):
    return reference_table(spark, sf).groupBy("target_sheet", "category").agg(F.count(F.lit(1)).alias("n"))


@query("jm05", f"WITH {XREFS} SELECT plan_id, ord, k, target_sheet, t AS source_text, context AS source_classification, category FROM xrefs")
def _jm05(spark, sf):
    return reference_table(spark, sf).select("plan_id", "ord", "k", "target_sheet", "source_text", "source_classification", "category")


_KINDS = ("plausible_sheet_id", "fixture_callout_misclassified", "grid_or_short_tag", "other")


@query("ag20", f"WITH {XREFS} SELECT plan_id, count(*) AS total_xrefs, count(DISTINCT target_sheet) AS unique_targets, {', '.join(f'''count(DISTINCT target_sheet) FILTER (WHERE category = '{k}') AS {k}''' for k in _KINDS)} FROM xrefs GROUP BY plan_id")
def _ag20(spark, sf):
    return evaluate.plan_references(reference_table(spark, sf))


@query("ag21", f"WITH {XREFS} SELECT target_sheet, category, count(*) AS n_xrefs, count(DISTINCT plan_id) AS n_plans FROM xrefs GROUP BY ALL HAVING count(DISTINCT plan_id) > 1")
def _ag21(spark, sf):
    return evaluate.target_counts(reference_table(spark, sf)).filter("n_plans > 1")


@query("win06", f"WITH {XREFS} SELECT target_sheet, category, count(*) AS n_xrefs, count(DISTINCT plan_id) AS n_plans FROM xrefs GROUP BY ALL HAVING count(DISTINCT plan_id) > 1 ORDER BY n_plans DESC, target_sheet LIMIT 20")
def _win06(spark, sf):
    return evaluate.shared_targets(reference_table(spark, sf))


@query("evl04", f"WITH {XREFS} SELECT count(DISTINCT plan_id) AS n_plans, count(*) AS total_xrefs, count(DISTINCT target_sheet) AS unique_targets, round_even(count(*) FILTER (WHERE category = 'plausible_sheet_id') / count(*)::DOUBLE, 3) AS plausible_sheet_precision FROM xrefs")
def _evl04(spark, sf):
    return evaluate.corpus_references(reference_table(spark, sf))


@query("set04", f"WITH {XREFS} SELECT plan_id, array_to_string(list_sort(list(DISTINCT target_sheet)), ',') AS targets FROM xrefs GROUP BY plan_id")
def _set04(spark, sf):
    return labels.template_targets(texts.cross_references(region_table(spark, sf))).select("plan_id", F.concat_ws(",", "detected_targets").alias("targets"))


query("lbl02", f"WITH {XREFS} SELECT plan_id, array_to_string(list_sort(list(DISTINCT target_sheet)), ',') AS targets FROM xrefs GROUP BY plan_id")(lambda spark, sf: labels.template_targets(texts.cross_references(region_table(spark, sf))).select("plan_id", F.concat_ws(",", "valid_targets").alias("targets")))


# --- scans -----------------------------------------------------------------------------------------


@query("src01", f"WITH {P} SELECT plan_id, count(*) AS n_drawings, sum(x0) AS sx, sum(y0) AS sy, sum(stroke_width) AS w, sum(gray) AS g FROM paths GROUP BY plan_id")
def _src01(spark, sf):
    p = B.paths(spark, sf)
    op = F.format_string("%s w %s G %s %s m %s %s l S", *[F.col(c).cast("string") for c in ("stroke_width",)], F.col("stroke_rgb")[0].cast("string"), *[F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")])
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Page /MediaBox [0 0 2000 1000] /Contents 2 0 R >>\nendobj\n2 0 obj\n<< >>\nstream\n"), F.array_join(F.collect_list(op), "\n"), F.lit("\nendstream\nendobj\n%%EOF"))
    files = p.groupBy("plan_id").agg(body.alias("content")).select(F.col("plan_id").cast("string").alias("plan"), F.encode("content", "utf-8").alias("content"))
    d = pdf.read_pages(files).filter("error IS NULL").select(F.col("plan").cast("long").alias("plan_id"), "height", F.explode("drawings").alias("d"))
    a = F.get(F.get(F.col("d.items"), F.lit(0))["pts"], F.lit(0))
    return d.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_drawings"), F.sum(a["x"]).alias("sx"), F.sum(F.col("height") - a["y"]).alias("sy"), F.sum("d.width").alias("w"), F.sum(F.col("d.color")[0]).alias("g"))


@query("src02", f"WITH {DR} SELECT plan_id, ord, CASE n % 6 WHEN 1 THEN '2.0,2.0' WHEN 4 THEN '3.0' ELSE '' END AS pattern, n % 6 IN (1, 2, 4) AS is_dashed FROM draws")
def _src02(spark, sf):
    d = D.dash_pattern(F.col("dashes"))
    return drawing_table(spark, sf).select("plan_id", "ord", F.concat_ws(",", F.coalesce(d["pattern"], F.array().cast("array<double>")).cast("array<string>")).alias("pattern"), d["is_dashed"].alias("is_dashed"))


@query("src03", f"WITH {T} SELECT plan_id, ord, bx0, 800 - by1 AS fy0, bx1, 800 - by0 AS fy1, 800 - by0 AS point_y FROM texts")
def _src03(spark, sf):
    box = D.flip_box(F.struct(*[F.col(f"b{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]), F.lit(800.0))
    return B.text_blocks(spark, sf).select("plan_id", "ord", "bx0", box["y0"].alias("fy0"), "bx1", box["y1"].alias("fy1"), D.flip_y(F.col("by0"), F.lit(800.0)).alias("point_y"))


@query("src04", f"WITH {T} SELECT plan_id, (row_number() OVER (PARTITION BY plan_id ORDER BY ord) - 1)::INT AS ord, trim(text) AS text, bx0, 800 - by1 AS by0, bx1, 800 - by0 AS by1 FROM texts WHERE trim(text) <> '' AND ord % 7 <> 3 AND ord % 5 <> 4")
def _src04(spark, sf):
    t = B.text_blocks(spark, sf)
    box = F.when(F.col("ord") % 5 == 4, F.array(F.lit(0.0))).otherwise(F.array("bx0", "by0", "bx1", "by1"))
    block = F.struct(F.when(F.col("ord") % 7 == 3, F.lit(1)).otherwise(F.lit(0)).alias("type"), F.array(F.struct(F.array(F.struct(F.concat(F.lit(" "), "text").alias("text"), box.alias("bbox"))).alias("spans"))).alias("lines"))
    pages = t.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda s: s["b"]).alias("blocks")).withColumns({"page_height": F.lit(800.0), "page_num": F.lit(0)})
    return D.text_blocks_of(pages).select("plan_id", "ord", "text", "bx0", "by0", "bx1", "by1")


_PIECES = f"""WITH {DR}, pieces AS (
  SELECT plan_id, ord, 0 AS m, 'line' AS kind, a AS x0, b AS y0, c AS x1, d AS y1, width FROM draws WHERE kind = 'l'
  UNION ALL SELECT plan_id, ord, u.m, 'line', u.x0, u.y0, u.x1, u.y1, width FROM draws, (SELECT unnest([0,1,2,3]) AS m, unnest([a, c, c, a]) AS x0, unnest([b, b, d, d]) AS y0, unnest([c, c, a, a]) AS x1, unnest([b, d, d, b]) AS y1) u WHERE kind IN ('re', 'qu')
  UNION ALL SELECT plan_id, ord, 0, 'arc', a, b, a, d, width FROM draws WHERE kind = 'c'
) SELECT plan_id, (row_number() OVER (PARTITION BY plan_id ORDER BY ord, m) - 1)::INT AS ord, kind, x0, 800 - y0 AS y0, x1, 800 - y1 AS y1, coalesce(width, 0.0) AS stroke_width FROM pieces"""


def _pieces(spark, sf):
    return D.paths_of(drawing_table(spark, sf)).select("plan_id", "ord", "kind", "x0", "y0", "x1", "y1", "stroke_width")


for _name in ("src05", "src06", "src07", "src08", "src09", "src10"):
    query(_name, _PIECES)(_pieces)


_MARKS = f"""WITH {DR}, m AS (
  SELECT plan_id, ord, 0 AS m, a AS x0, b AS y0, c AS x1, d AS y1 FROM draws WHERE red AND kind = 'l'
  UNION ALL SELECT plan_id, ord, u.m, CASE WHEN c - a >= d - b THEN a WHEN u.m = 0 THEN a ELSE c END, CASE WHEN c - a < d - b THEN b WHEN u.m = 0 THEN b ELSE d END,
    CASE WHEN c - a >= d - b THEN c WHEN u.m = 0 THEN a ELSE c END, CASE WHEN c - a < d - b THEN d WHEN u.m = 0 THEN b ELSE d END FROM draws, (SELECT unnest([0, 1]) AS m) u WHERE red AND kind = 're'
) SELECT plan_id, (row_number() OVER (PARTITION BY plan_id ORDER BY ord, m) - 1)::INT AS g_ord, x0 AS gx0, 800 - y0 AS gy0, x1 AS gx1, 800 - y1 AS gy1, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS g_len FROM m"""


def _marks(spark, sf):
    return evaluate.marked_segments(drawing_table(spark, sf)).withColumn("g_len", r6(F.col("g_len")))


for _name in ("src16", "src20"):
    query(_name, _MARKS)(_marks)


# --- scalar geometry -------------------------------------------------------------------------------

#: pairs of a drawing's paths that follow each other, as points a, b and c, d
_NEXT = f"""WITH {P}, pairs AS (
  SELECT plan_id, ord, path_id::BIGINT AS n, x0 AS ax, y0 AS ay, x1 AS bx, y1 + (ord % 3) * 20 AS bq, lead(x0) OVER w AS cx, lead(y0) OVER w AS cy, lead(x1) OVER w AS dx, lead(y1) OVER w AS dy, gray FROM paths WINDOW w AS (PARTITION BY plan_id ORDER BY ord)
), p AS (SELECT * FROM pairs WHERE cx IS NOT NULL)"""


def pair_table(spark, sf, step: int = 1):
    from pyspark.sql import Window

    w = Window.partitionBy("plan_id").orderBy("ord")
    p = B.paths(spark, sf)
    nxt = lambda c: F.lead(c, step).over(w)
    return p.select("plan_id", "ord", F.col("path_id").cast("long").alias("n"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), (F.col("y1") + (F.col("ord") % 3) * 20).alias("bq"), nxt("x0").alias("cx"), nxt("y0").alias("cy"), nxt("x1").alias("dx"), nxt("y1").alias("dy"), "stroke_rgb").filter("cx IS NOT NULL")


def scalar(name: str, sql: str, value) -> None:
    """A query of one value for each pair."""
    query(name, f"{_NEXT} SELECT plan_id, ord, {sql} AS value FROM p")(lambda spark, sf: pair_table(spark, sf).select("plan_id", "ord", value().alias("value")))


_LEN = "sqrt((bx - ax) * (bx - ax) + (bq - ay) * (bq - ay))"
_ANG = "(degrees(atan2(bq - ay, bx - ax)) + 360) % 180"
_ANG2 = "(degrees(atan2(dy - cy, dx - cx)) + 360) % 180"
_FOOT = "(((cx - ax) * (bx - ax) + (cy - ay) * (bq - ay)) / ((bx - ax) ** 2 + (bq - ay) ** 2))"


def _d(x, y):
    return F.col(x) - F.col(y)


scalar("geo01", "round((0.299 * gray + 0.587 * gray + 0.114 * gray)::DOUBLE, 6)", lambda: r6(G.lightness("stroke_rgb")))
scalar("geo02", f"round({_ANG}, 6)", lambda: r6(G.angle(_d("bx", "ax"), _d("bq", "ay"))))
scalar("geo03", f"round(least(abs({_ANG} - {_ANG2}), 180 - abs({_ANG} - {_ANG2})), 6)", lambda: r6(G.angle_difference(G.angle(_d("bx", "ax"), _d("bq", "ay")), G.angle(_d("dx", "cx"), _d("dy", "cy")))))
scalar("geo04", f"round(abs((cx - ax) * (ay - bq) + (cy - ay) * (bx - ax)) / {_LEN}, 6)", lambda: r6(G.line_distance("ax", "ay", "bx", "bq", "cx", "cy")))
scalar("geo05", f"round(((cx - ax) * (bx - ax) + (cy - ay) * (bq - ay)) / {_LEN}, 6)", lambda: r6(G.projection("cx", "cy", "ax", "ay", _d("bx", "ax") / G.length("ax", "ay", "bx", "bq"), _d("bq", "ay") / G.length("ax", "ay", "bx", "bq"))))
scalar("geo07", f"(least({_ANG}, 180 - {_ANG}) <= 5 OR abs({_ANG} - 90) <= 5)", lambda: G.is_orthogonal(G.angle(_d("bx", "ax"), _d("bq", "ay")), 5.0))
scalar("geo08", f"round({_FOOT}, 6)", lambda: r6(G.foot_parameter("cx", "cy", "ax", "ay", "bx", "bq")))
scalar("geo09", f"round(sqrt((cx - ax - greatest(0, least(1, {_FOOT})) * (bx - ax)) ** 2 + (cy - ay - greatest(0, least(1, {_FOOT})) * (bq - ay)) ** 2), 6)", lambda: r6(G.segment_distance("cx", "cy", "ax", "ay", "bx", "bq")))
scalar("geo12", "(ax + bx) / 2", lambda: G.midpoint("ax", "bx"))
scalar("geo13", f"round({_LEN}, 6)", lambda: r6(G.length("ax", "ay", "bx", "bq")))
scalar("geo14", f"CASE WHEN {_ANG} <= 5 OR {_ANG} >= 175 THEN 'horizontal' WHEN abs({_ANG} - 90) <= 5 THEN 'vertical' END", lambda: G.axis(_d("bx", "ax"), _d("bq", "ay"), 5.0))
scalar("geo16", "round(sqrt(greatest(least(cx, dx) - ax, 0, ax - greatest(cx, dx)) ** 2 + greatest(least(cy, dy) - ay, 0, ay - greatest(cy, dy)) ** 2), 6)", lambda: r6(G.box_distance("ax", "ay", F.least("cx", "dx"), F.least("cy", "dy"), F.greatest("cx", "dx"), F.greatest("cy", "dy"))))
scalar("geo23", f"({_FOOT} >= -0.05 AND {_FOOT} <= 1.05 AND abs((cx - ax) * (ay - bq) + (cy - ay) * (bx - ax)) / {_LEN} <= 60)", lambda: G.on_strip("cx", "cy", "ax", "ay", "bx", "bq", 60.0))

_ROT = "(n % 4) * 90"
_PX = "CASE n % 4 WHEN 0 THEN ax WHEN 1 THEN 1200 - (900 - ay) WHEN 2 THEN 1000 - ax ELSE 900 - ay END"
_PY = "CASE n % 4 WHEN 0 THEN 900 - ay WHEN 1 THEN ax WHEN 2 THEN 1200 - (900 - ay) ELSE 1000 - ax END"


def _page():
    return F.lit(1000.0), F.lit(1200.0), F.lit(900.0), (F.col("n") % 4) * 90, F.lit(2.0), F.lit(2.0)


def _pixel(spark, sf):
    p = G.to_pixel("ax", "ay", *_page())
    return pair_table(spark, sf).select("plan_id", "ord", p["x"].alias("px"), p["y"].alias("py"))


for _name in ("geo10", "lbl10"):
    query(_name, f"{_NEXT} SELECT plan_id, ord, ({_PX}) * 2.0::DOUBLE AS px, ({_PY}) * 2.0::DOUBLE AS py FROM p")(_pixel)


@query("geo11", f"{_NEXT} SELECT plan_id, ord, ax AS x, ay AS y FROM p")
def _geo11(spark, sf):
    p = G.to_pixel("ax", "ay", *_page())
    back = G.from_pixel(p["x"], p["y"], *_page())
    return pair_table(spark, sf).select("plan_id", "ord", back["x"].alias("x"), back["y"].alias("y"))


_NEXT2 = _NEXT.replace(") OVER w", ", 2) OVER w")


@query("geo06", f"""{_NEXT2}, q AS (SELECT plan_id, ord, ax, ay, bx, y1 AS bq, cx, cy, dx, dy, ax <> bx AS h FROM (SELECT *, ay + CASE WHEN ax <> bx THEN 0 ELSE bq - ay END AS y1 FROM p)
), r AS (SELECT *, CASE WHEN h THEN greatest(least(ax, bx), least(cx, dx)) ELSE greatest(least(ay, bq), least(cy, dy)) END AS lo, CASE WHEN h THEN least(greatest(ax, bx), greatest(cx, dx)) ELSE least(greatest(ay, bq), greatest(cy, dy)) END AS hi,
  least(abs(bx - ax) + abs(bq - ay), abs(dx - cx) + abs(dy - cy)) AS shorter FROM q WHERE (ax <> bx) = (cx <> dx)
) SELECT plan_id, ord, hi - lo AS overlap FROM r WHERE hi - lo > 0 AND hi - lo >= 0.3 * shorter""")
def _geo06(spark, sf):
    p = pair_table(spark, sf, 2).withColumn("bq", F.when(F.col("ax") != F.col("bx"), F.col("ay")).otherwise(F.col("bq"))).filter((F.col("ax") != F.col("bx")) == (F.col("cx") != F.col("dx")))
    n = G.length("ax", "ay", "bx", "bq")
    ux, uy = _d("bx", "ax") / n, _d("bq", "ay") / n
    ta, tb = G.projection("cx", "cy", "ax", "ay", ux, uy), G.projection("dx", "dy", "ax", "ay", ux, uy)
    over = F.least(n, F.greatest(ta, tb)) - F.greatest(F.lit(0.0), F.least(ta, tb))
    return p.select("plan_id", "ord", over.alias("overlap")).filter((F.col("overlap") > 0) & (F.col("overlap") >= 0.3 * F.least(n, G.length("cx", "cy", "dx", "dy"))))


@query("geo15", f"WITH {W} SELECT n AS k, CASE n % 6 WHEN 0 THEN 'x-junction' WHEN 1 THEN 'endpoint' WHEN 2 THEN CASE WHEN n % 4 = 0 THEN 'endpoint' ELSE 'corner' END WHEN 3 THEN 't-junction' ELSE 'x-junction' END AS junction_type FROM walls")
def _geo15(spark, sf):
    v = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    second = F.when(F.col("n") % 4 == 0, v(-1.0, 0.0)).otherwise(v(0.0, 1.0))
    dirs = F.slice(F.array(v(1.0, 0.0), second, v(0.0, -1.0), v(0.6, 0.8), v(0.8, 0.6)), F.lit(1), (F.col("n") % 6).cast("int"))
    return wall_table(spark, sf).select(F.col("n").alias("k"), G.junction_type(dirs).alias("junction_type"))


_PTS = f"WITH {R}, {T}, pts AS (SELECT plan_id % 8 AS plan_id, plan_id AS page, ord, text, (bx0 + bx1) / 2 AS px, (by0 + by1) / 2 AS py FROM texts), joined AS (SELECT pts.page, pts.ord, pts.text, px, py, r.* FROM pts JOIN rooms r ON r.plan_id = pts.plan_id)"


def _points(spark, sf):
    t = B.text_blocks(spark, sf)
    return t.select((F.col("plan_id") % 8).alias("plan_id"), F.col("plan_id").alias("page"), "ord", "text", G.midpoint("bx0", "bx1").alias("px"), G.midpoint("by0", "by1").alias("py"))


_INSIDE = "px > rx0 AND px < rx1 AND py > ry0 AND py < ry1"


def _inside(spark, sf):
    return rooms.points_in_rooms(_points(spark, sf), room_table(spark, sf).select("plan_id", "room", "ring", "holes")).select("page", "ord", "plan_id", "room")


for _name in ("geo17", "jn05"):
    query(_name, f"{_PTS} SELECT page, ord, plan_id, room FROM joined WHERE {_INSIDE}")(_inside)


@query("geo18", f"{_PTS} SELECT page, ord, room, round(CASE WHEN {_INSIDE} THEN least(px - rx0, rx1 - px, py - ry0, ry1 - py) ELSE sqrt(greatest(rx0 - px, 0, px - rx1) ** 2 + greatest(ry0 - py, 0, py - ry1) ** 2) END, 6) AS d FROM joined")
def _geo18(spark, sf):
    j = _points(spark, sf).join(room_table(spark, sf), "plan_id")
    return j.select("page", "ord", "room", r6(G.ring_distance("ring", "px", "py")).alias("d"))


@query("geo19", f"WITH {R} SELECT room_id, area, (rx0 + rx1) / 2 AS cx, (ry0 + ry1) / 2 AS cy FROM rooms")
def _geo19(spark, sf):
    c = G.ring_centroid("ring")
    return room_table(spark, sf).select("room_id", r6(G.ring_area("ring")).alias("area"), r6(c["x"]).alias("cx"), r6(c["y"]).alias("cy"))


@query("geo20", f"WITH {R} SELECT plan_id, room, least(rx1 - rx0, ry1 - ry0) AS short, greatest(rx1 - rx0, ry1 - ry0) AS long, area FROM rooms")
def _geo20(spark, sf):
    """Each rectangle turned by 30 degrees in a drawing of its own; its sides stay."""
    turn = lambda p: F.struct((p["x"] * 3**0.5 / 2 - p["y"] / 2).alias("x"), (p["x"] / 2 + p["y"] * 3**0.5 / 2).alias("y"))
    r = room_table(spark, sf).select("plan_id", "room", "k", F.explode(G.ring_edges(F.transform("ring", turn))).alias("e"))
    faces = rooms.polygonize(r.select(F.col("k").alias("plan_id"), "e.*"))
    return faces.join(room_table(spark, sf).select(F.col("plan_id").alias("p"), "room", F.col("k").alias("plan_id")), "plan_id").select(F.col("p").alias("plan_id"), "room", F.round("short", 4).alias("short"), F.round("long", 4).alias("long"), F.round("area", 2).alias("area"))


@query("geo21", f"WITH {R}, b AS (SELECT plan_id, min(rx0) AS x0, min(ry0) AS y0, max(rx1) AS x1, max(ry1) AS y1, count(*) AS n FROM rooms GROUP BY plan_id) SELECT plan_id, x0, y0, x1, y1 FROM b")
def _geo21(spark, sf):
    edges = room_table(spark, sf).select("plan_id", F.explode(G.ring_edges("ring")).alias("e")).select("plan_id", "e.*")
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return roles.hulls(edges).select("plan_id", side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


@query("geo22", f"""WITH {P}, {R}, j AS (SELECT p.plan_id, p.ord, r.room, least(x0, x1) AS a, greatest(x0, x1) AS c, least(y0, y1) AS b, greatest(y0, y1) AS d, rx0, ry0, rx1, ry1 FROM paths p JOIN rooms r ON r.plan_id = p.plan_id WHERE ord < 60)
SELECT plan_id, ord, room FROM j WHERE a <= rx1 AND c >= rx0 AND b <= ry1 AND d >= ry0 AND NOT (a > rx0 AND c < rx1 AND b > ry0 AND d < ry1)""")
def _geo22(spark, sf):
    j = B.paths(spark, sf).filter("ord < 60").join(room_table(spark, sf), "plan_id")
    return j.filter(G.ring_meets("ring", "x0", "y0", "x1", "y1")).select("plan_id", "ord", "room")


# --- classification and walls ----------------------------------------------------------------------

_CLASS = f"""{P}, {T}, near AS (
  SELECT p.plan_id, p.ord, min(sqrt(greatest(bx0 - (x0 + x1) / 2, 0, (x0 + x1) / 2 - bx1) ** 2 + greatest(by0 - (y0 + y1) / 2, 0, (y0 + y1) / 2 - by1) ** 2)) AS near
  FROM paths p JOIN texts t ON t.plan_id = p.plan_id WHERE stroke_width <= 0.3 GROUP BY ALL
), classified AS (
  SELECT p.*, n.near, CASE WHEN stroke_width >= 0.5 AND NOT is_dashed AND gray < 0.3 THEN 'wall_candidate' WHEN stroke_width <= 0.3 AND near <= 15 THEN 'dimension' WHEN stroke_width <= 0.3 THEN 'annotation' ELSE 'unknown' END AS candidate_type
  FROM paths p LEFT JOIN near n ON n.plan_id = p.plan_id AND n.ord = p.ord
), segs AS (SELECT plan_id, ord, path_id, x0, y0, x1, y1, abs(x1 - x0) + abs(y1 - y0) AS length, x0 = x1 AS vertical, stroke_width, gray, is_dashed FROM classified WHERE candidate_type = 'wall_candidate' AND kind = 'line')"""


def classified(spark, sf):
    return classify.classify_primary(B.paths(spark, sf), B.text_blocks(spark, sf))


def segment_table(spark, sf):
    return classify.segments(classified(spark, sf))


@query("flt01", f"""WITH {_CLASS} SELECT plan_id, ord, candidate_type, round(CASE candidate_type WHEN 'wall_candidate' THEN greatest(0.5, least(1.0, 0.5 * least(1.0, (stroke_width - 0.5) / 0.5 + 0.5) + 0.5 * (1 - gray / 0.3))) WHEN 'dimension' THEN greatest(0.4, least(0.9, 1 - near / 15)) WHEN 'annotation' THEN 0.7 ELSE 0.3 END::DOUBLE, 6) AS confidence FROM classified""")
def _flt01(spark, sf):
    return classified(spark, sf).select("plan_id", "ord", "candidate_type", r6("classification_confidence").alias("confidence"))


_WIDE = f"""WITH {B.paths_sql(2500)}, c AS (
  SELECT *, stroke_width >= 0.5 AND NOT is_dashed AND gray < 0.3 AS wall, abs(x1 - x0) + abs(y1 - y0) AS length FROM paths
), f AS (SELECT *, count(*) FILTER (WHERE wall) OVER (PARTITION BY plan_id) AS walls, count(*) OVER (PARTITION BY plan_id) AS n,
  row_number() OVER (PARTITION BY plan_id, (NOT wall AND kind = 'line' AND NOT is_dashed AND gray < 0.3 AND length >= 20) ORDER BY length DESC, ord) AS r FROM c)
SELECT plan_id, ord FROM f WHERE NOT wall AND kind = 'line' AND NOT is_dashed AND gray < 0.3 AND length >= 20 AND walls < 1000 AND n > 500 AND r <= 1500"""


def _rescued(spark, sf):
    p = B.paths(spark, sf, 2500)
    return classify.classify_paths(p, B.text_blocks(spark, sf), WIDE_CONFIG).filter("rule_triggered = 'length_fallback_rescue'").select("plan_id", "ord")


for _name in ("flt02", "win04"):
    query(_name, _WIDE)(_rescued)


@query("flt03", f"WITH {_CLASS} SELECT plan_id, ord, length, CASE WHEN vertical THEN 90.0 ELSE 0.0 END::DOUBLE AS angle FROM segs")
def _flt03(spark, sf):
    return segment_table(spark, sf).select("plan_id", "ord", "length", r6("angle").alias("angle"))


@query("ag01", f"WITH {_CLASS} SELECT plan_id, count(*) FILTER (WHERE candidate_type = 'wall_candidate') AS n FROM classified GROUP BY plan_id")
def _ag01(spark, sf):
    return classified(spark, sf).groupBy("plan_id").agg(F.count(F.when(F.col("candidate_type") == "wall_candidate", 1)).alias("n"))


@query("j-nn02", f"WITH {_CLASS} SELECT plan_id, ord, round(near, 6) AS near FROM near WHERE near <= 15")
def _jnn02(spark, sf):
    return classify.text_distance(B.paths(spark, sf).filter("stroke_width <= 0.3"), B.text_blocks(spark, sf), 15.0).withColumn("near", r6("near"))


_PAIRS = f"""{_CLASS}, cand AS (
  SELECT i.plan_id, i.ord AS i_ord, j.ord AS j_ord, i.vertical, i.length AS li, j.length AS lj,
    CASE WHEN i.vertical THEN abs(j.x0 - i.x0) ELSE abs(j.y0 - i.y0) END AS thickness,
    CASE WHEN i.vertical THEN greatest(least(i.y0, i.y1), least(j.y0, j.y1)) ELSE greatest(least(i.x0, i.x1), least(j.x0, j.x1)) END AS lo,
    CASE WHEN i.vertical THEN least(greatest(i.y0, i.y1), greatest(j.y0, j.y1)) ELSE least(greatest(i.x0, i.x1), greatest(j.x0, j.x1)) END AS hi,
    CASE WHEN i.vertical THEN (i.x0 + j.x0) / 2 ELSE (i.y0 + j.y0) / 2 END AS mid
  FROM segs i JOIN segs j ON i.plan_id = j.plan_id AND i.ord < j.ord AND i.vertical = j.vertical
), pairs AS (SELECT plan_id, i_ord, j_ord, vertical, thickness, lo, hi, mid, hi - lo AS length FROM cand WHERE thickness BETWEEN 2 AND 40 AND hi - lo > 0 AND hi - lo >= 0.3 * least(li, lj))"""


def pair_walls(spark, sf):
    return walls.parallel_pairs(segment_table(spark, sf))


@query("jn01", f"WITH {_PAIRS} SELECT plan_id, i_ord, j_ord, thickness, length, CASE WHEN vertical THEN mid ELSE lo END AS x0, CASE WHEN vertical THEN lo ELSE mid END AS y0, CASE WHEN vertical THEN mid ELSE hi END AS x1, CASE WHEN vertical THEN hi ELSE mid END AS y1 FROM pairs")
def _jn01(spark, sf):
    return pair_walls(spark, sf).select("plan_id", "i_ord", "j_ord", *[r6(c).alias(c) for c in ("thickness", "length", "x0", "y0", "x1", "y1")])


def _numbered(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("ord", (F.row_number().over(Window.partitionBy("plan_id").orderBy("i_ord", "j_ord")) - 1).cast("int"))


_HIST = f"""{_PAIRS}, stat AS (SELECT plan_id, min(thickness) AS t0, max(thickness) AS t1, sum(thickness * length) / sum(length) AS mean, 3 * greatest(median(length), 1) AS support, count(*) AS n FROM pairs GROUP BY plan_id HAVING count(*) >= 10
), bins AS (SELECT p.plan_id, floor((thickness - t0) / 0.3)::INT AS bin, sum(length) AS weight FROM pairs p JOIN stat s ON s.plan_id = p.plan_id GROUP BY ALL)"""


@query("ag02", f"WITH {_HIST} SELECT plan_id, bin, round(weight, 6) AS weight FROM bins")
def _ag02(spark, sf):
    return walls.thickness_bins(pair_walls(spark, sf)).select("plan_id", "bin", r6("weight").alias("weight"))


@query("ag03", f"WITH {_HIST} SELECT plan_id, round(mean, 6) AS mean FROM stat")
def _ag03(spark, sf):
    return walls.thickness_bins(pair_walls(spark, sf)).groupBy("plan_id").agg(r6(F.first("mean")).alias("mean"))


@query("ag04", f"WITH {_HIST} SELECT plan_id, round(support, 6) AS support FROM stat")
def _ag04(spark, sf):
    return walls.thickness_bins(pair_walls(spark, sf)).groupBy("plan_id").agg(r6(F.first("support")).alias("support"))


_MODES = f"""{_HIST}, peak AS (
  SELECT b.plan_id, bin, weight, max(weight) OVER (PARTITION BY b.plan_id ORDER BY bin RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, max(weight) OVER (PARTITION BY b.plan_id ORDER BY bin RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r, t0, t1, mean, support
  FROM bins b JOIN stat s ON s.plan_id = b.plan_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY weight DESC, bin) AS k FROM peak WHERE t1 - t0 < 0.3 OR (weight >= support AND coalesce(l, -1) < weight AND coalesce(r, 0) <= weight)
), modes AS (SELECT plan_id, CASE WHEN t1 - t0 < 0.3 THEN mean ELSE t0 + (bin + 0.5) * 0.3 END AS mode FROM ranked WHERE k <= CASE WHEN t1 - t0 < 0.3 THEN 1 ELSE 3 END)"""


@query("win01", f"WITH {_MODES} SELECT plan_id, round(mode, 6) AS mode FROM modes WHERE mode <= 18")
def _win01(spark, sf):
    return walls.thickness_modes(pair_walls(spark, sf)).select("plan_id", r6("mode").alias("mode"))


@query("flt10", f"WITH {_MODES} SELECT p.plan_id, i_ord, j_ord FROM pairs p WHERE p.plan_id NOT IN (SELECT plan_id FROM modes WHERE mode <= 18) OR EXISTS (SELECT 1 FROM modes m WHERE m.plan_id = p.plan_id AND mode <= 18 AND abs(thickness - mode) <= 0.25 * mode)")
def _flt10(spark, sf):
    kept, _ = walls.split_by_thickness(pair_walls(spark, sf))
    return kept.select("plan_id", "i_ord", "j_ord")


@query("flt11", f"WITH {_PAIRS}, s AS (SELECT *, avg(thickness) OVER (PARTITION BY plan_id) AS m, stddev_pop(thickness) OVER (PARTITION BY plan_id) AS sd FROM pairs) SELECT plan_id, i_ord, j_ord, sd > 0 AND abs(thickness - m) > 2 * sd AS outlier FROM s")
def _flt11(spark, sf):
    return walls.tag_outliers(pair_walls(spark, sf)).select("plan_id", "i_ord", "j_ord", F.array_contains("rules_failed", "thickness_outlier").alias("outlier"))


@query("win02", "SELECT s_suppkey AS plan_id, u.segment_id, u.length FROM supplier, (SELECT unnest(['s0', 's2', 's3', 's4']) AS segment_id, unnest([100.0, 80.0, 70.0, 70.0]::DOUBLE[]) AS length) u")
def _win02(spark, sf):
    """The second wall is like the first, the third like the second alone: it stays, as the second is gone;
    the fourth is apart, the fifth crosses the first, the sixth repeats the fourth."""
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("plan_id"))
    middle = [(50.0, 0.0, 100.0, 0.0), (50.0, 2.0, 90.0, 0.0), (50.0, 4.0, 80.0, 0.0), (50.0, 40.0, 70.0, 0.0), (50.0, 1.0, 70.0, 90.0), (51.0, 41.0, 60.0, 1.0)]
    one = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(m, ("mx", "my", "length", "angle"))]) for m in middle])
    w = s.select("plan_id", F.posexplode(one).alias("k", "m")).select("plan_id", F.lit(0).alias("i_ord"), F.col("k").alias("j_ord"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("segment_id"), "m.*")
    ux, uy = F.cos(F.radians("angle")) * F.col("length") / 2, F.sin(F.radians("angle")) * F.col("length") / 2
    none = F.array().cast("array<string>")
    w = w.select("plan_id", "i_ord", "j_ord", "segment_id", (F.col("mx") - ux).alias("x0"), (F.col("my") - uy).alias("y0"), (F.col("mx") + ux).alias("x1"), (F.col("my") + uy).alias("y1"), "length", F.col("angle").alias("angle_degrees"), F.lit(4.0).alias("thickness"), F.lit(1.0).alias("stroke_width"), F.lit(None).cast("array<double>").alias("color_rgb"), F.lit(False).alias("is_dashed"), F.lit(None).cast("string").alias("layer_name"), none.alias("source_path_ids"), none.alias("rules_passed"), none.alias("rules_failed"), F.col("length").alias("overlap_length"))
    return walls.drop_duplicates(w, 3.0).select("plan_id", "segment_id", "length")


@query("srt01", f"WITH {_PAIRS} SELECT plan_id, i_ord, j_ord, row_number() OVER (PARTITION BY plan_id ORDER BY length DESC, i_ord, j_ord) AS place FROM pairs")
def _srt01(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.col("length").desc(), "i_ord", "j_ord"))
    return pair_walls(spark, sf).select("plan_id", "i_ord", "j_ord", place.cast("long").alias("place"))


# --- points and components -------------------------------------------------------------------------

_ENDS = f"""{_CLASS}, ends AS (SELECT plan_id, ord * 2 AS e, x0 AS x, y0 AS y FROM segs UNION ALL SELECT plan_id, ord * 2 + 1, x1, y1 FROM segs
), near_ends AS (SELECT a.plan_id, a.e AS a, b.e AS b FROM ends a JOIN ends b ON a.plan_id = b.plan_id AND a.e < b.e AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9)"""
_COMP = f"""WITH RECURSIVE {_ENDS}, both_ends AS (SELECT plan_id, a, b FROM near_ends UNION ALL SELECT plan_id, b, a FROM near_ends
), reach(plan_id, e, seen) AS (SELECT plan_id, e, e FROM ends UNION SELECT r.plan_id, r.e, n.b FROM reach r JOIN both_ends n ON n.plan_id = r.plan_id AND n.a = r.seen
), comp AS (SELECT plan_id, e, min(seen) AS label FROM reach GROUP BY ALL), sized AS (SELECT c.plan_id, label, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM comp c JOIN ends ON ends.plan_id = c.plan_id AND ends.e = c.e GROUP BY ALL)"""


def end_table(spark, sf):
    s = segment_table(spark, sf)
    return s.select("plan_id", (F.col("ord") * 2).alias("e"), F.col("x0").alias("x"), F.col("y0").alias("y")).union(s.select("plan_id", F.col("ord") * 2 + 1, "x1", "y1"))


@query("jn03", f"WITH {_ENDS} SELECT plan_id, a, b FROM near_ends")
def _jn03(spark, sf):
    return graph.near_points(end_table(spark, sf), "e", 3.0)


@query("gr01", f"{_COMP} SELECT plan_id, e, label FROM comp")
def _gr01(spark, sf):
    ends = end_table(spark, sf)
    return graph.components(graph.near_points(ends, "e", 3.0), ends.select("plan_id", F.col("e").alias("node"))).select("plan_id", F.col("node").alias("e"), "label")


def _clusters(spark, sf):
    return graph.cluster_points(end_table(spark, sf), "e", 3.0).groupBy("plan_id", "cluster").agg(F.min("e").alias("label"), F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("cx"), r6(F.avg("y")).alias("cy")).drop("cluster")


query("ag05", f"{_COMP} SELECT plan_id, label, n, round(cx, 6) AS cx, round(cy, 6) AS cy FROM sized")(_clusters)
query("ag06", f"{_COMP} SELECT plan_id, label, n, round(cx, 6) AS cx, round(cy, 6) AS cy FROM sized WHERE n >= 3")(lambda spark, sf: _clusters(spark, sf).filter("n >= 3"))


@query("j-nn05", f"""{_COMP}, many AS (SELECT plan_id FROM segs GROUP BY plan_id HAVING count(*) >= 20), js AS (SELECT s.plan_id, label, cx, cy FROM sized s JOIN many m ON m.plan_id = s.plan_id WHERE n >= 3
), best AS (SELECT e.plan_id, e.e, min((x - cx) ** 2 + (y - cy) ** 2) AS d FROM ends e JOIN js ON js.plan_id = e.plan_id WHERE (x - cx) ** 2 + (y - cy) ** 2 <= 225 GROUP BY ALL) SELECT plan_id, e AS pord, round(d, 6) AS d FROM best""")
def _jnn05(spark, sf):
    segs = segment_table(spark, sf)
    points = end_table(spark, sf).select("plan_id", F.col("e").alias("pord"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = walls.nearest_junction(points, walls.structural_junctions(segs), 15.0).join(points, ["plan_id", "pord"])
    return near.select("plan_id", "pord", r6((F.col("px") - F.col("jx")) ** 2 + (F.col("py") - F.col("jy")) ** 2).alias("d"))


@query("flt12", f"""{_COMP}, many AS (SELECT plan_id FROM segs GROUP BY plan_id HAVING count(*) >= 20), js AS (SELECT s.plan_id, label, cx, cy FROM sized s JOIN many m ON m.plan_id = s.plan_id WHERE n >= 3
), anchored AS (SELECT DISTINCT e.plan_id, e.e // 2 AS ord, e.e % 2 AS side FROM ends e JOIN js ON js.plan_id = e.plan_id WHERE (x - cx) ** 2 + (y - cy) ** 2 <= 225
), c AS (SELECT s.plan_id, s.ord, count(a.side) AS n FROM segs s LEFT JOIN anchored a ON a.plan_id = s.plan_id AND a.ord = s.ord WHERE s.plan_id IN (SELECT plan_id FROM js) GROUP BY ALL)
SELECT plan_id, ord, CASE n WHEN 0 THEN 'no_junction_anchor' WHEN 1 THEN 'junction_anchored_one' ELSE 'junction_anchored_both' END AS tag FROM c""")
def _flt12(spark, sf):
    segs = segment_table(spark, sf)
    w = segs.select("*", F.array().cast("array<string>").alias("rules_passed"), F.array().cast("array<string>").alias("rules_failed"))
    tagged, _ = walls.anchor(w, segs)
    return tagged.select("plan_id", "ord", F.concat_ws(",", "rules_passed", "rules_failed").alias("tag")).filter("tag <> ''")


# --- topology --------------------------------------------------------------------------------------

_SPLIT_IN = f"""{_CLASS}, hosts AS (SELECT * FROM segs WHERE length >= 6), touch AS (
  SELECT h.plan_id, h.ord, CASE WHEN h.vertical THEN (e.y - h.y0) / (h.y1 - h.y0) ELSE (e.x - h.x0) / (h.x1 - h.x0) END AS t, h.length
  FROM hosts h JOIN (SELECT plan_id, ord, x0 AS x, y0 AS y FROM segs UNION ALL SELECT plan_id, ord, x1, y1 FROM segs) e ON e.plan_id = h.plan_id AND e.ord <> h.ord AND CASE WHEN h.vertical THEN abs(e.x - h.x0) ELSE abs(e.y - h.y0) END <= 3
), cuts AS (SELECT * FROM touch WHERE t >= 3 / length AND t <= 1 - 3 / length)"""


@query("jn02", f"WITH {_SPLIT_IN} SELECT plan_id, ord, round(t, 9) AS t FROM cuts")
def _jn02(spark, sf):
    return topology.body_touches(segment_table(spark, sf), 3.0).withColumn("t", F.round("t", 9))


@query("win03", f"""WITH {_SPLIT_IN}, bounds AS (SELECT plan_id, ord, length, list_sort(list_distinct(list(t) || [0.0::DOUBLE, 1.0::DOUBLE])) AS ts FROM cuts GROUP BY ALL
), folded AS (SELECT plan_id, ord, list_reduce(list_transform(ts, lambda t: [t]), lambda acc, t: CASE WHEN t[1] - acc[-1] >= 3 / length THEN acc || t ELSE acc[:-2] || t END) AS b FROM bounds) SELECT plan_id, ord, len(b)::INT AS n_bounds FROM folded""")
def _win03(spark, sf):
    segs = segment_table(spark, sf)
    cuts = topology.body_touches(segs, 3.0).groupBy("plan_id", "ord").agg(F.collect_set("t").alias("cuts")).join(segs.select("plan_id", "ord", "length"), ["plan_id", "ord"])
    return cuts.select("plan_id", "ord", F.size(topology.merged_bounds(F.col("cuts"), F.col("length"), 3.0)).alias("n_bounds"))


def segment_walls(spark, sf):
    """Segments as walls for the topology steps."""
    s = segment_table(spark, sf)
    return s.select("plan_id", "ord", F.concat(F.lit("s"), "path_id").alias("segment_id"), "x0", "y0", "x1", "y1", "length", F.col("angle").alias("angle_degrees"), F.lit(4.0).alias("thickness"), "stroke_width", F.col("rgb").alias("color_rgb"), "is_dashed", "layer_name")


#: walls whose ends fall on a grid of 50 are edges between numbered places
_EDGES = f"""{P}, edges AS (SELECT plan_id, ord, 's' || path_id AS segment_id, (round(x0 / 100) * 1000 + round(y0 / 100))::INT AS sc, (round(x1 / 100) * 1000 + round(y1 / 100))::INT AS ec, x0, y0, x1, y1 FROM paths WHERE kind = 'line')"""


def edge_table(spark, sf):
    p = B.paths(spark, sf).filter("kind = 'line'")
    at = lambda x, y: (F.round(F.col(x) / 100) * 1000 + F.round(F.col(y) / 100)).cast("int")
    return p.select("plan_id", "ord", F.concat(F.lit("s"), "path_id").alias("segment_id"), at("x0", "y0").alias("sc"), at("x1", "y1").alias("ec"), "x0", "y0", "x1", "y1")


_CONN = f"""WITH {_EDGES}, spots AS (SELECT DISTINCT plan_id, segment_id, unnest([sc, ec]) AS c FROM edges) SELECT a.plan_id, a.segment_id, coalesce(array_to_string(list_sort(list(DISTINCT b.segment_id) FILTER (WHERE b.segment_id <> a.segment_id)), ','), '') AS ids FROM spots a JOIN spots b ON b.plan_id = a.plan_id AND b.c = a.c GROUP BY ALL"""
for _name in ("jn04", "set05"):
    query(_name, _CONN)(lambda spark, sf: topology.connected(edge_table(spark, sf)).select("plan_id", "segment_id", F.concat_ws(",", "connected_segment_ids").alias("ids")))


@query("gr03", f"WITH {_EDGES} SELECT plan_id, cluster, count(*) AS degree FROM (SELECT plan_id, unnest([sc, ec]) AS cluster FROM edges) GROUP BY ALL")
def _gr03(spark, sf):
    return topology.degrees(edge_table(spark, sf))


_LOOSE = f"""{_EDGES}, deg AS (SELECT plan_id, c, count(*) AS d FROM (SELECT plan_id, unnest([sc, ec]) AS c FROM edges) GROUP BY ALL
), arm AS (SELECT plan_id, sc AS c, x0 AS x, y0 AS y, x1 AS ox, y1 AS oy FROM edges UNION ALL SELECT plan_id, ec, x1, y1, x0, y0 FROM edges
), loose AS (SELECT a.plan_id, a.c AS cluster, x, y, (ox - x) / sqrt((ox - x) ** 2 + (oy - y) ** 2) AS ux, (oy - y) / sqrt((ox - x) ** 2 + (oy - y) ** 2) AS uy FROM arm a JOIN deg ON deg.plan_id = a.plan_id AND deg.c = a.c WHERE d = 1)"""


def loose_ends(spark, sf):
    e = edge_table(spark, sf)
    place = e.select("plan_id", F.col("sc").alias("cluster"), F.col("x0").alias("x"), F.col("y0").alias("y")).union(e.select("plan_id", "ec", "x1", "y1"))
    junctions = place.groupBy("plan_id", "cluster").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return topology.outward(e, junctions)


@query("gr04", f"WITH {_LOOSE} SELECT plan_id, cluster, round(ux, 6) AS ux, round(uy, 6) AS uy FROM loose")
def _gr04(spark, sf):
    return loose_ends(spark, sf).select("plan_id", "cluster", r6("ux").alias("ux"), r6("uy").alias("uy"))


@query("j-nn04", f"""WITH {_LOOSE}, g AS (SELECT a.plan_id, a.cluster AS a, b.cluster AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bq, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS gap, a.ux AS aux, a.uy AS auy, b.ux AS bux, b.uy AS buy FROM loose a JOIN loose b ON a.plan_id = b.plan_id AND a.cluster <> b.cluster
), ok AS (SELECT * FROM g WHERE gap >= 1e-9 AND gap <= 200 AND -(aux * (bx - ax) + auy * (bq - ay)) / gap >= cos(radians(20)) AND (bux * (bx - ax) + buy * (bq - ay)) / gap >= cos(radians(20))
), best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY plan_id, a ORDER BY gap, b) = 1) SELECT p.plan_id, p.ax AS x0, p.ay AS y0, p.bx AS x1, p.bq AS y1 FROM best p JOIN best q ON q.plan_id = p.plan_id AND q.a = p.b AND q.b = p.a WHERE p.a < p.b""")
def _jnn04(spark, sf):
    return rooms.mutual_bridges(rooms.bridge_pairs(loose_ends(spark, sf), 200.0, 20.0))


@query("set01", f"WITH {P} SELECT plan_id, count(*) AS n FROM (SELECT plan_id FROM paths WHERE kind = 'line' UNION ALL SELECT plan_id FROM paths WHERE kind = 'arc') GROUP BY plan_id")
def _set01(spark, sf):
    p = B.paths(spark, sf)
    return p.filter("kind = 'line'").select("plan_id").unionByName(p.filter("kind = 'arc'").select("plan_id")).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))


@query("flt04", f"WITH {_EDGES} SELECT plan_id, ord FROM edges WHERE abs(x0 - x1) >= 1e-9 OR abs(y0 - y1) >= 1e-9")
def _flt04(spark, sf):
    return rooms.valid_edges(edge_table(spark, sf)).select("plan_id", "ord")


# --- grid and openings -----------------------------------------------------------------------------


def page_paths(spark, sf):
    """Paths on the pages of the text blocks (32 blocks a page)."""
    return B.paths(spark, sf)


_LABELS = f"""{P}, {REGIONS}, long_lines AS (SELECT plan_id, ord, x0, y0, x1, y1, abs(x1 - x0) + abs(y1 - y0) AS length, CASE WHEN y0 = y1 THEN 'horizontal' ELSE 'vertical' END AS axis FROM paths WHERE kind = 'line' AND abs(x1 - x0) + abs(y1 - y0) >= 300
), lab AS (SELECT plan_id, ord AS l_ord, t AS l_text, (bx0 + bx1) / 2 AS lx, (by0 + by1) / 2 AS ly FROM regions WHERE split_part(c, ':', 1) = 'grid_label'
), tips AS (SELECT plan_id, ord * 2 AS pord, x0 AS px, y0 AS py FROM long_lines UNION ALL SELECT plan_id, ord * 2 + 1, x1, y1 FROM long_lines
), near_label AS (SELECT t.plan_id, pord, l_ord, l_text FROM tips t JOIN lab l ON l.plan_id = t.plan_id WHERE sqrt((px - lx) ** 2 + (py - ly) ** 2) < 40 QUALIFY row_number() OVER (PARTITION BY t.plan_id, pord ORDER BY sqrt((px - lx) ** 2 + (py - ly) ** 2), l_ord) = 1
), cand AS (SELECT l.*, n.l_ord, n.l_text AS label FROM long_lines l JOIN near_label n ON n.plan_id = l.plan_id AND n.pord // 2 = l.ord QUALIFY row_number() OVER (PARTITION BY l.plan_id, l.ord ORDER BY n.pord) = 1
), glines AS (SELECT plan_id, axis, label, round_even(CASE WHEN axis = 'horizontal' THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END, 0) AS position, min(ord) AS ord, max(length) AS length, count(*) AS n FROM cand GROUP BY ALL)"""


def _grid_candidates(spark, sf):
    return grid.grid_candidates(B.paths(spark, sf), region_table(spark, sf))


query("flt07", f"WITH {_LABELS} SELECT plan_id, ord, axis, label, l_ord FROM cand")(lambda spark, sf: _grid_candidates(spark, sf).select("plan_id", "ord", "axis", "label", "l_ord"))


@query("j-nn03", f"WITH {_LABELS} SELECT plan_id, pord, l_ord, l_text FROM near_label")
def _jnn03(spark, sf):
    p = B.paths(spark, sf).filter((F.col("kind") == "line") & (G.length("x0", "y0", "x1", "y1") >= 300))
    tips = p.select("plan_id", (F.col("ord") * 2).alias("pord"), F.col("x0").alias("px"), F.col("y0").alias("py")).union(p.select("plan_id", F.col("ord") * 2 + 1, "x1", "y1"))
    lab = region_table(spark, sf).filter("classification = 'grid_label'").select("plan_id", F.col("ord").alias("l_ord"), F.col("text").alias("l_text"), G.midpoint("bx0", "bx1").alias("lx"), G.midpoint("by0", "by1").alias("ly"))
    return grid.nearest_label(tips, lab, 40.0)


def _grid_lines(spark, sf):
    lines, _ = grid.grid_lines(_grid_candidates(spark, sf))
    return lines.select("plan_id", "ord", "axis", "label", r6(G.length("x0", "y0", "x1", "y1")).alias("length"))


for _name in ("win05", "det06"):
    query(_name, f"WITH {_LABELS} SELECT plan_id, ord, axis, label, length FROM glines")(_grid_lines)


@query("flt06", f"WITH {P} SELECT plan_id, ord, abs(x1 - x0) + abs(y1 - y0) AS chord FROM paths WHERE kind = 'arc' AND abs(x1 - x0) + abs(y1 - y0) BETWEEN 10 AND 200")
def _flt06(spark, sf):
    return openings.door_arcs(B.paths(spark, sf)).select("plan_id", F.col("a_ord").alias("ord"), "chord")


_DOORS = f"""{W}, arcs AS (SELECT plan_id, ord, abs(x1 - x0) + abs(y1 - y0) AS chord, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM paths WHERE kind = 'arc' AND abs(x1 - x0) + abs(y1 - y0) BETWEEN 10 AND 200
), doors AS (SELECT a.plan_id, a.ord, a.chord, w.segment_id, sqrt(greatest(least(w.x0, w.x1) - mx, 0, mx - greatest(w.x0, w.x1)) ** 2 + greatest(least(w.y0, w.y1) - my, 0, my - greatest(w.y0, w.y1)) ** 2) AS d
  FROM arcs a JOIN walls w ON w.plan_id = a.plan_id AND sqrt(greatest(least(w.x0, w.x1) - mx, 0, mx - greatest(w.x0, w.x1)) ** 2 + greatest(least(w.y0, w.y1) - my, 0, my - greatest(w.y0, w.y1)) ** 2) < 15 QUALIFY row_number() OVER (PARTITION BY a.plan_id, a.ord ORDER BY d, w.ord) = 1)"""


@query("j-nn01", f"WITH {_DOORS} SELECT plan_id, ord, segment_id, round(d, 6) AS d FROM doors")
def _jnn01(spark, sf):
    w = wall_table(spark, sf).select("plan_id", F.col("ord").alias("w_ord"), F.col("segment_id").alias("w_id"), *[F.col(c).alias("w" + c) for c in ("x0", "y0", "x1", "y1")])
    near = openings.nearest_wall(openings.door_arcs(B.paths(spark, sf)).select("plan_id", "a_ord", "mx", "my"), w, 15.0)
    return near.select("plan_id", F.col("a_ord").alias("ord"), F.col("w_id").alias("segment_id"), r6("d").alias("d"))


_BESIDE = f"""{R}, beside AS (SELECT w.plan_id, w.segment_id, r.room, r.room_id, r.room_type FROM walls w JOIN rooms r ON r.plan_id = w.plan_id,
  (SELECT 1) o WHERE (CASE WHEN (w.x0 + w.x1) / 2 > rx0 AND (w.x0 + w.x1) / 2 < rx1 AND (w.y0 + w.y1) / 2 > ry0 AND (w.y0 + w.y1) / 2 < ry1
    THEN least((w.x0 + w.x1) / 2 - rx0, rx1 - (w.x0 + w.x1) / 2, (w.y0 + w.y1) / 2 - ry0, ry1 - (w.y0 + w.y1) / 2)
    ELSE sqrt(greatest(rx0 - (w.x0 + w.x1) / 2, 0, (w.x0 + w.x1) / 2 - rx1) ** 2 + greatest(ry0 - (w.y0 + w.y1) / 2, 0, (w.y0 + w.y1) / 2 - ry1) ** 2) END) <= 9)"""


def _beside(spark, sf):
    return rooms.bounding_walls(wall_table(spark, sf), room_table(spark, sf).select("plan_id", "room", "ring", "room_id", "room_type"), 9.0)


query("jn06", f"WITH {W}, {_BESIDE} SELECT plan_id, room, segment_id FROM beside")(_beside)


def adjacency_table(spark, sf):
    near = _beside(spark, sf).join(room_table(spark, sf).select("plan_id", "room", "room_id"), ["plan_id", "room"])
    return near.groupBy("plan_id", "segment_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("room", "room_id"))), lambda s: s["room_id"]).alias("adjacent_room_ids"))


_ADJ = "adj AS (SELECT plan_id, segment_id, list(room_id ORDER BY room) AS ids FROM beside GROUP BY ALL)"


def _openings(spark, sf):
    o = openings.detect_openings(B.paths(spark, sf), wall_table(spark, sf), adjacency_table(spark, sf))
    return o.select("plan_id", "ord", "wall_segment_id", "width", F.concat_ws(",", F.coalesce("connects_room_ids", F.array().cast("array<string>"))).alias("rooms"), F.col("connects_room_ids").isNull().alias("none"))


for _name in ("det04", "win08"):
    query(_name, f"WITH {_DOORS}, {_BESIDE}, {_ADJ} SELECT d.plan_id, d.ord, d.segment_id AS wall_segment_id, d.chord AS width, coalesce(array_to_string(a.ids[1:2], ','), '') AS rooms, a.ids IS NULL AS none FROM doors d LEFT JOIN adj a ON a.plan_id = d.plan_id AND a.segment_id = d.segment_id")(_openings)


# --- rooms and roles -------------------------------------------------------------------------------


@query("jn07", f"WITH {_PTS[5:]}, f AS (SELECT page, ord, plan_id, room, ({_FIX})[((page * 7 + ord) % 10 + 1)::INT] AS kind FROM joined WHERE {_INSIDE}), g AS (SELECT *, CASE WHEN regexp_matches(lower(kind), 'toilet|sink') THEN 'bathroom' WHEN regexp_matches(lower(kind), 'stove|range|cooktop') THEN 'kitchen' WHEN regexp_matches(lower(kind), 'washer|dryer|laundry') THEN 'laundry' WHEN regexp_matches(lower(kind), 'hvac|furnace|boiler') THEN 'mechanical' END AS f_type FROM f) SELECT plan_id, room, f_type, lower(kind) AS f_kind FROM g WHERE f_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY plan_id, room ORDER BY page * 32 + ord) = 1")
def _jn07(spark, sf):
    kind = F.get(F.array(*[F.lit(x) for x in _FIX]), ((F.col("page") * 7 + F.col("ord")) % 10).cast("int"))
    f = _points(spark, sf).select("plan_id", (F.col("page") * 32 + F.col("ord")).cast("int").alias("ord"), kind.alias("type"), F.col("px").alias("x"), F.col("py").alias("y"))
    return rooms.fixture_types(f, room_table(spark, sf).select("plan_id", "room", "ring", "holes"))


@query("flt05", f"WITH {R} SELECT room_id FROM rooms WHERE area >= 20000 AND least(rx1 - rx0, ry1 - ry0) >= 120 AND greatest(rx1 - rx0, ry1 - ry0) / least(rx1 - rx0, ry1 - ry0) <= 1.5")
def _flt05(spark, sf):
    r = room_table(spark, sf).withColumns({"short": F.least(F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")), "long": F.greatest(F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0"))})
    return rooms.plausible(r, Config(room_min_area=20000.0, room_min_short_dimension=120.0, room_max_aspect_ratio=1.5)).select("room_id")


@query("win07", f"WITH {REGIONS}, n AS (SELECT plan_id, min(struct_pack(o := ord, t := t)) FILTER (WHERE regexp_matches(t, '^[0-9]{{2,4}}[a-zA-Z]?$')) AS number, min(struct_pack(o := ord, t := t)) FILTER (WHERE t <> '' AND NOT regexp_matches(t, '^[0-9]{{2,4}}[a-zA-Z]?$')) AS name FROM regions GROUP BY plan_id) SELECT plan_id, number.t AS number, name.t AS name FROM n")
def _win07(spark, sf):
    listed = B.text_blocks(spark, sf).groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]).alias("labels"))
    n = rooms.name_and_number(F.col("labels"), Config().text_room_number_pattern)
    return listed.select("plan_id", n["number"].alias("number"), n["name"].alias("name"))


@query("srt02", f"WITH {R} SELECT plan_id, room_id, row_number() OVER (PARTITION BY plan_id ORDER BY area DESC, room) AS place FROM rooms")
def _srt02(spark, sf):
    from pyspark.sql import Window

    return room_table(spark, sf).select("plan_id", "room_id", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.col("area").desc(), "room")).cast("long").alias("place"))


def grid_rooms(spark, sf):
    """Lines that enclose cells: for each supplier a drawing of columns and rows of 120 by 90."""
    s = B.table(spark, sf, "supplier").selectExpr("s_suppkey AS plan_id", "cast(1 + s_suppkey % 4 AS int) AS nx", "cast(1 + s_suppkey % 3 AS int) AS ny")
    v = s.select("plan_id", F.explode(F.sequence(F.lit(0), F.col("nx"))).alias("i"), "ny").select("plan_id", (F.col("i") * 120.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("i") * 120.0).alias("x1"), (F.col("ny") * 90.0).alias("y1"))
    h = s.select("plan_id", F.explode(F.sequence(F.lit(0), F.col("ny"))).alias("i"), "nx").select("plan_id", F.lit(0.0).alias("x0"), (F.col("i") * 90.0).alias("y0"), (F.col("nx") * 120.0).alias("x1"), (F.col("i") * 90.0).alias("y1"))
    return v.union(h)


_CELLS = "WITH s AS (SELECT s_suppkey AS plan_id, 1 + s_suppkey % 4 AS nx, 1 + s_suppkey % 3 AS ny FROM supplier) SELECT plan_id, (u.i * 120 + 60)::DOUBLE AS cx, (v.j * 90 + 45)::DOUBLE AS cy, 10800.0::DOUBLE AS area FROM s, (SELECT unnest(range(0, 4)) AS i) u, (SELECT unnest(range(0, 3)) AS j) v WHERE u.i < nx AND v.j < ny"
query("gr09", _CELLS)(lambda spark, sf: rooms.polygonize(grid_rooms(spark, sf)).select("plan_id", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("area").alias("area")))


def _wall_grid(spark, sf):
    """The same cells as walls with junctions at the crossings."""
    from pyspark.sql import Window

    lines = grid_rooms(spark, sf).withColumn("ord", (F.row_number().over(Window.partitionBy("plan_id").orderBy("x0", "y0", "x1", "y1")) - 1).cast("int"))
    lines = lines.select("plan_id", "ord", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("segment_id"), "x0", "y0", "x1", "y1", G.length("x0", "y0", "x1", "y1").alias("length"), F.lit(0.0).alias("angle_degrees"), F.lit(4.0).alias("thickness"), F.lit(1.0).alias("stroke_width"), F.lit(None).cast("array<double>").alias("color_rgb"), F.lit(False).alias("is_dashed"), F.lit(None).cast("string").alias("layer_name"))
    return topology.build_topology(lines)


def grid_texts(spark, sf):
    """A label in the first cell of each drawing."""
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("plan_id"))
    text = F.get(F.array(*[F.lit(x) for x in ("BATHROOM", "KITCHEN", "204", "OFFICE")]), (F.col("plan_id") % 4).cast("int"))
    return s.select("plan_id", F.lit(0).alias("ord"), text.alias("text"), F.lit(50.0).alias("bx0"), F.lit(40.0).alias("by0"), F.lit(70.0).alias("bx1"), F.lit(50.0).alias("by1"), F.lit(0).alias("page_num"))


def _rooms_of(spark, sf):
    w, j, _ = _wall_grid(spark, sf)
    return (w, j, *rooms.detect_rooms(w, j, grid_texts(spark, sf)))


_DET03 = _CELLS.replace("10800.0::DOUBLE AS area", "10800.0::DOUBLE AS area, CASE WHEN u.i = 0 AND v.j = 0 THEN (['bathroom','kitchen','unknown','office'])[(plan_id % 4 + 1)::INT] ELSE 'unknown' END AS room_type, CASE WHEN u.i = 0 AND v.j = 0 AND plan_id % 4 = 2 THEN '204' END AS room_number")
query("det03", _DET03)(lambda spark, sf: _rooms_of(spark, sf)[2].select("plan_id", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("area").alias("area"), "room_type", "room_number"))

_PER_CELL = "WITH s AS (SELECT s_suppkey AS plan_id, 1 + s_suppkey % 4 AS nx, 1 + s_suppkey % 3 AS ny FROM supplier)"
query("sem02", f"{_PER_CELL} SELECT plan_id, 2 * nx + 2 * ny AS n FROM s")(lambda spark, sf: roles.exterior(_wall_grid(spark, sf)[0]).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")))


@query("jn09", f"WITH {W}, {_BESIDE} SELECT DISTINCT plan_id, segment_id FROM beside WHERE room_type IN ('bathroom', 'kitchen', 'laundry')")
def _jn09(spark, sf):
    return roles.wet_by_room(wall_table(spark, sf), adjacency_table(spark, sf), room_table(spark, sf))


@query("jn08", f"WITH {W}, {T}, z AS (SELECT plan_id, bx0 - 50 AS x0, by0 - 50 AS y0, bx1 + 50 AS x1, by1 + 50 AS y1 FROM texts WHERE regexp_matches(regexp_replace(upper(text), '[^A-Z]', '', 'g'), '^(BATH|KITCHEN|WC|RESTROOM|POWDER)')) SELECT DISTINCT w.plan_id, w.segment_id FROM walls w JOIN z ON z.plan_id = w.plan_id AND (w.x0 + w.x1) / 2 BETWEEN z.x0 AND z.x1 AND (w.y0 + w.y1) / 2 BETWEEN z.y0 AND z.y1")
def _jn08(spark, sf):
    return roles.wet_by_label(wall_table(spark, sf), B.text_blocks(spark, sf))


@query("sem01", f"WITH {W} SELECT segment_id, CASE WHEN n % 10 / 10.0 < 0.4 AND role <> 'exterior' THEN 'unknown' ELSE role END AS functional_role, CASE WHEN n % 10 / 10.0 < 0.4 AND role <> 'exterior' THEN 'rule_low_confidence' ELSE 'rule' END AS rule_triggered, role IN ('bearing_wall', 'wet_wall') AS flag FROM walls")
def _sem01(spark, sf):
    w = wall_table(spark, sf).select("segment_id", F.col("role").alias("asked"), ((F.col("n") % 10) / 10).alias("confidence"), F.lit("rule").alias("rule"))
    return roles.with_role(w).select("segment_id", "functional_role", "rule_triggered", F.col("requires_cross_document_validation").alias("flag"))


@query("sem03", f"WITH {W} SELECT plan_id, segment_id FROM walls WHERE length > 200 AND start_junction_type IN ('t-junction', 'x-junction') AND end_junction_type IN ('t-junction', 'x-junction')")
def _sem03(spark, sf):
    return wall_table(spark, sf).filter(roles.is_demising()).select("plan_id", "segment_id")


def chain_table(spark, sf):
    """For each supplier a chain of 150, 120 and 100, one of 100 and 100, and a lone wall of 400."""
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("plan_id"))
    edges = [("s0", 150.0, 0, 1, "endpoint", "corner"), ("s1", 120.0, 1, 2, "corner", "t-junction"), ("s2", 100.0, 2, 3, "t-junction", "endpoint"), ("s3", 100.0, 10, 11, "endpoint", "corner"), ("s4", 100.0, 11, 12, "corner", "endpoint"), ("s5", 400.0, 20, 21, "corner", "corner")]
    names = ("segment_id", "length", "sc", "ec", "start_junction_type", "end_junction_type")
    one = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(e, names)]) for e in edges])
    return s.select("plan_id", F.posexplode(one).alias("ord", "e")).select("plan_id", "ord", "e.*")


for _name in ("gr08", "sem05"):
    query(_name, "SELECT s_suppkey AS plan_id, unnest(['s0', 's1', 's2']) AS segment_id FROM supplier")(lambda spark, sf: roles.bearing_chains(chain_table(spark, sf)))


def broken_walls(spark, sf):
    """For each supplier a wall with a gap of 10."""
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("plan_id"))
    w = s.select("plan_id", F.posexplode(F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1")) for a, b in ((0.0, 100.0), (110.0, 200.0))])).alias("ord", "w"))
    w = w.select("plan_id", "ord", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("segment_id"), "w.x0", F.lit(0.0).alias("y0"), "w.x1", F.lit(0.0).alias("y1"), (F.col("w.x1") - F.col("w.x0")).alias("length"), F.lit(0.0).alias("angle_degrees"), F.lit(4.0).alias("thickness"), F.lit(1.0).alias("stroke_width"), F.lit(None).cast("array<double>").alias("color_rgb"), F.lit(False).alias("is_dashed"), F.lit(None).cast("string").alias("layer_name"))
    return topology.build_topology(w)


query("gr07", "SELECT s_suppkey AS plan_id, unnest(['j-000000', 'j-000001', 'j-000003']) AS junction_id, unnest([0.0, 105.0, 200.0]::DOUBLE[]) AS x FROM supplier")(lambda spark, sf: topology.merge_gaps(*broken_walls(spark, sf)[:2], Config(gap_close_distance=20.0))[1].select("plan_id", "junction_id", "x"))
query("j-nn06", "SELECT s_suppkey AS plan_id, unnest([1, 2]) AS a, unnest([2, 1]) AS b, 10.0::DOUBLE AS gap FROM supplier")(lambda spark, sf: topology.gap_candidates(*broken_walls(spark, sf)[:2], Config(gap_close_distance=20.0)).select("plan_id", "a", "b", "gap"))


def _roles(spark, sf):
    w, _, found, adjacency = _rooms_of(spark, sf)
    return roles.assign_roles(w, grid_texts(spark, sf), found, adjacency).groupBy("plan_id", "functional_role", "rule_triggered").agg(F.count(F.lit(1)).alias("n"))


#: of the grid's walls, the boundary's pieces are exterior; an inner line is whole: long ones between
#: T-junctions are demising, those beside the first cell wet where it is a bathroom or a kitchen
_INNER = f"""{_PER_CELL}, inner_walls AS (
  SELECT plan_id, ny * 90 AS length, i = 1 AND (ny = 1 OR ny = 2) AS beside, i * 120 <= 120 AND ny * 45 <= 100 AS labelled FROM s, (SELECT unnest(range(1, 4)) AS i) u WHERE i < nx
  UNION ALL SELECT plan_id, nx * 120, j = 1 AND (nx = 1 OR nx = 2), nx * 60 <= 120 AND j * 90 <= 100 FROM s, (SELECT unnest(range(1, 3)) AS j) u WHERE j < ny
), ruled AS (SELECT plan_id, CASE WHEN length > 200 THEN 'demising' WHEN beside AND plan_id % 4 < 2 THEN 'wet_wall' WHEN labelled AND plan_id % 4 < 2 THEN 'wet_wall' ELSE 'interior_partition' END AS functional_role,
  CASE WHEN length > 200 THEN 'demising_long_through' WHEN beside AND plan_id % 4 < 2 THEN 'wet_wall_bounds_wet_room' WHEN labelled AND plan_id % 4 < 2 THEN 'wet_wall_text_label_proximity' ELSE 'default_interior' END AS rule_triggered FROM inner_walls
) SELECT plan_id, 'exterior' AS functional_role, 'exterior_convex_hull' AS rule_triggered, (2 * nx + 2 * ny)::BIGINT AS n FROM s UNION ALL SELECT plan_id, functional_role, rule_triggered, count(*) FROM ruled GROUP BY ALL"""
for _name in ("sem04", "sem06", "sem07"):
    query(_name, _INNER)(_roles)

_KINDS_OF = f"{_PER_CELL} SELECT plan_id, 'corner' AS junction_type, 4::BIGINT AS n, 8::BIGINT AS ends FROM s UNION ALL SELECT plan_id, 't-junction', (2 * (nx - 1) + 2 * (ny - 1))::BIGINT, (6 * (nx - 1) + 6 * (ny - 1))::BIGINT FROM s WHERE nx + ny > 2"
for _name in ("det02", "gr02", "gr05", "gr06"):
    query(_name, _KINDS_OF)(lambda spark, sf: _wall_grid(spark, sf)[1].groupBy("plan_id", "junction_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("connected_segment_ids")).alias("ends")))


def short_walls(spark, sf):
    """For each supplier a wall shorter than the snap, one of 20 and one of 100, far apart."""
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("plan_id"))
    w = s.select("plan_id", F.posexplode(F.array(F.lit(2.0), F.lit(20.0), F.lit(100.0))).alias("ord", "length"))
    y = F.col("ord") * 50.0
    return w.select("plan_id", "ord", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("segment_id"), F.lit(0.0).alias("x0"), y.alias("y0"), F.col("length").alias("x1"), y.alias("y1"), "length", F.lit(0.0).alias("angle_degrees"), F.lit(4.0).alias("thickness"), F.lit(1.0).alias("stroke_width"), F.lit(None).cast("array<double>").alias("color_rgb"), F.lit(False).alias("is_dashed"), F.lit(None).cast("string").alias("layer_name"))


query("flt08", "SELECT s_suppkey AS plan_id, 's2' AS segment_id, 100.0::DOUBLE AS length FROM supplier UNION ALL SELECT s_suppkey, 's1', 20.0 FROM supplier")(lambda spark, sf: (lambda t: t[0].select("plan_id", "segment_id", "length").union(t[2].select("plan_id", "segment_id", "length")))(topology.build_topology(short_walls(spark, sf))))
query("flt09", "SELECT s_suppkey AS plan_id, 's1' AS segment_id, 20.0::DOUBLE AS length FROM supplier")(lambda spark, sf: topology.build_topology(short_walls(spark, sf))[2].select("plan_id", "segment_id", "length"))


# --- documents and checks --------------------------------------------------------------------------


def documents(spark, sf):
    p, t = B.paths(spark, sf), B.text_blocks(spark, sf)
    plans = p.select("plan_id").distinct().select("plan_id", F.concat(F.lit("plan"), F.col("plan_id").cast("string"), F.lit(".pdf")).alias("source_pdf"), F.lit(1300.0).alias("width"), F.lit(1300.0).alias("height"))
    return extract.extract(p, t).documents(plans)


def building_tables(spark, sf):
    """For each supplier a drawing of one room of double lines, a door, a label and a callout, by number:
    paths, texts and plans."""
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("plan_id"))
    w, h = (200 + (F.col("plan_id") % 7) * 40).cast("double"), (150 + (F.col("plan_id") % 5) * 30).cast("double")
    line = lambda kind, *xy: F.struct(F.lit(kind).alias("kind"), *[x.alias(n) if isinstance(x, F.Column) else F.lit(float(x)).alias(n) for x, n in zip(xy, ("x0", "y0", "x1", "y1"))])
    across = [line("line", 0, y, w, y) for y in (F.lit(0.0), F.lit(4.0), h - 4, h)]
    up = [line("line", x, 0, x, h) for x in (F.lit(0.0), F.lit(4.0), w - 4, w)]
    rows = s.select("plan_id", F.posexplode(F.array(*across, *up, line("arc", 60, 2, 90, 2))).alias("ord", "l")).select("plan_id", "ord", "l.*")
    none = F.lit(None).cast("array<double>")
    paths = rows.select("plan_id", "ord", F.concat(F.lit("p"), F.col("ord").cast("string")).alias("path_id"), "kind", "x0", "y0", "x1", "y1", F.when(F.col("kind") == "line", 1.0).otherwise(0.1).alias("stroke_width"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("stroke_rgb"), none.alias("fill_rgb"), none.alias("dash_pattern"), F.lit(False).alias("is_dashed"), F.lit(None).cast("string").alias("layer_name"), F.lit(0).alias("page_num"))
    label = F.get(F.array(*[F.lit(x) for x in ("BATHROOM", "OFFICE", "204", "UNIT")]), (F.col("plan_id") % 4).cast("int"))
    texts_in = s.select("plan_id", F.posexplode(F.array(label, F.lit("see A302/7"))).alias("ord", "text")).select("plan_id", "ord", "text", F.lit(100.0).alias("bx0"), (F.lit(60.0) + 20 * F.col("ord")).alias("by0"), F.lit(120.0).alias("bx1"), (F.lit(70.0) + 20 * F.col("ord")).alias("by1"), F.lit(0).alias("page_num"))
    plans = s.select("plan_id", F.concat(F.lit("plan"), F.col("plan_id").cast("string"), F.lit(".pdf")).alias("source_pdf"), w.alias("width"), h.alias("height"))
    return paths, texts_in, plans


def buildings(spark, sf):
    """Documents and errors of the whole extraction over ``building_tables``."""
    return extract.run(*building_tables(spark, sf))


def drawn_walls(spark, sf):
    """Walls and dropped ones of the buildings, each with more double lines outside, by number: a thick
    pair (not of the drawing's mode), a pair as wide as the walls' that touches none, and one that stands
    on the upper wall."""
    paths, blocks, _ = building_tables(spark, sf)
    n = F.col("plan_id")
    w, h = (200 + (n % 7) * 40).cast("double"), (150 + (n % 5) * 30).cast("double")
    stem = (80 + (n % 3) * 20).cast("double")
    more = [(n % 2 == 0, w + 200, 0.0, 18.0), (n % 3 == 0, w + 400, 0.0, 4.0), (n % 5 < 3, w / 2, h, 4.0)]
    lines = [F.when(on, F.array(*[F.struct((x + d).cast("double").alias("x"), F.lit(y).alias("y") if isinstance(y, float) else y.alias("y")) for d in (0.0, t)])) for on, x, y, t in more]
    extra = paths.filter("ord = 0").select("*", F.posexplode(F.flatten(F.filter(F.array(*lines), lambda a: a.isNotNull()))).alias("k", "at"))
    extra = extra.withColumns({"ord": F.col("k") + 20, "path_id": F.concat(F.lit("q"), F.col("k").cast("string")), "x0": F.col("at.x"), "y0": F.col("at.y"), "x1": F.col("at.x"), "y1": F.col("at.y") + stem}).select(*paths.columns)
    return walls.detect_walls(classify.classify_paths(paths.union(extra), blocks))


@query("det01", """WITH s AS (SELECT s_suppkey AS plan_id, (200 + (s_suppkey % 7) * 40)::DOUBLE AS w, (150 + (s_suppkey % 5) * 30)::DOUBLE AS h, (80 + (s_suppkey % 3) * 20)::DOUBLE AS stem FROM supplier
), drawn AS (SELECT plan_id, 0.0::DOUBLE AS x0, 2.0::DOUBLE AS y0, w AS x1, 2.0::DOUBLE AS y1, 4.0::DOUBLE AS thickness FROM s
  UNION ALL SELECT plan_id, 0, h - 2, w, h - 2, 4 FROM s UNION ALL SELECT plan_id, 2, 0, 2, h, 4 FROM s UNION ALL SELECT plan_id, w - 2, 0, w - 2, h, 4 FROM s
  UNION ALL SELECT plan_id, w + 209, 0, w + 209, stem, 18 FROM s WHERE plan_id % 2 = 0
  UNION ALL SELECT plan_id, w + 402, 0, w + 402, stem, 4 FROM s WHERE plan_id % 3 = 0
  UNION ALL SELECT plan_id, w / 2 + 2, h, w / 2 + 2, h + stem, 4 FROM s WHERE plan_id % 5 < 3
) SELECT *, thickness = 18 AND count(*) OVER (PARTITION BY plan_id) > 5 AS outlier, false AS dropped FROM drawn""")
def _det01(spark, sf):
    """One thick wall among n is over two standard deviations from the mean if n - 1 > 4, not at 4."""
    kept, dropped = drawn_walls(spark, sf)
    xy = [r6(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1", "thickness")]
    row = lambda df, gone: df.select("plan_id", *xy, F.array_contains("rules_failed", "thickness_outlier").alias("outlier"), F.lit(gone).alias("dropped"))
    return row(kept, False).union(row(dropped, True))


_BUILT = "SELECT s_suppkey AS plan_id, 'plan' || s_suppkey || '.pdf' AS source_pdf, 1::BIGINT AS rooms, 4::BIGINT AS walls, 1::BIGINT AS openings, 2::BIGINT AS text_regions, 0::BIGINT AS grid_lines, 4::BIGINT AS junctions, 1::BIGINT AS cross_references, ((198 + (s_suppkey % 7) * 40) * (148 + (s_suppkey % 5) * 30))::DOUBLE AS area, (['bathroom','office','unknown','mechanical'])[(s_suppkey % 4 + 1)::INT] AS room_type, 0::BIGINT AS errors FROM supplier"


def _built(spark, sf):
    docs, errors = buildings(spark, sf)
    n = errors.groupBy("plan_id").agg(F.count(F.lit(1)).alias("errors"))
    room = F.get(F.col("rooms"), F.lit(0))
    rows = docs.join(grows(n), "plan_id", "left")
    return rows.select("plan_id", "metadata.source_pdf", *[F.col(f"metadata.entity_counts.{k}").alias(k) for k in assemble.ENTITIES], r6(room["area"]).alias("area"), room["room_type"].alias("room_type"), F.coalesce("errors", F.lit(0)).alias("errors"))


for _name in ("snk01", "exe02"):
    query(_name, _BUILT)(_built)


@query("srt03", "SELECT s_suppkey AS plan_id, true AS walls_sorted, true AS junctions_sorted FROM supplier")
def _srt03(spark, sf):
    ids = lambda c, k: F.transform(c, lambda e: e[k])
    rising = lambda a: F.array_sort(a) == a
    return buildings(spark, sf)[0].select("plan_id", rising(ids(F.col("walls"), "segment_id")).alias("walls_sorted"), rising(ids(F.col("junctions"), "junction_id")).alias("junctions_sorted"))


@query("ag07", f"WITH {P}, {XREFS} SELECT d.plan_id, (SELECT count(*) FROM regions r WHERE r.plan_id = d.plan_id) AS text_regions, (SELECT count(*) FROM xrefs x WHERE x.plan_id = d.plan_id) AS cross_references FROM (SELECT DISTINCT plan_id FROM paths) d")
def _ag07(spark, sf):
    return documents(spark, sf).select("plan_id", F.col("metadata.entity_counts.text_regions").alias("text_regions"), F.col("metadata.entity_counts.cross_references").alias("cross_references"))


query("ag08", "SELECT s_suppkey AS plan_id, 'exterior' AS role, 4::BIGINT AS n, 4.0::DOUBLE AS thickness FROM supplier")(lambda spark, sf: evaluate.document_summary(buildings(spark, sf)[0]).select("plan_id", F.explode("role_counts").alias("role", "n"), r6("thickness_median").alias("thickness")))


@query("ag09", f"WITH {W} SELECT plan_id, min(thickness) AS lo, median(thickness) AS mid, max(thickness) AS hi FROM walls GROUP BY plan_id")
def _ag09(spark, sf):
    return wall_table(spark, sf).groupBy("plan_id").agg(F.min("thickness").alias("lo"), evaluate.median(F.array_sort(F.collect_list("thickness"))).alias("mid"), F.max("thickness").alias("hi"))


def _dropped(spark, sf):
    w = wall_table(spark, sf)
    return sinks.dropped_counts(sinks.dropped_table(dropped_by_thickness=w.filter("thickness > 9"), dropped_by_isolation=w.filter("thickness <= 9 AND length < 100")))


for _name in ("ag10", "snk06"):
    query(_name, f"WITH {W} SELECT plan_id, CASE WHEN thickness > 9 THEN 'dropped_by_thickness' ELSE 'dropped_by_isolation' END AS reason, count(*) AS n FROM walls WHERE thickness > 9 OR length < 100 GROUP BY ALL")(_dropped)


@query("snk02", f"WITH {W} SELECT segment_id, length AS centerline_length, CASE WHEN x0 = x1 THEN 90.0 ELSE 0.0 END::DOUBLE AS angle_degrees, thickness, coalesce(stroke_width, 0.0) AS line_weight, role AS functional_role FROM walls")
def _snk02(spark, sf):
    none = F.lit(None).cast("string")
    w = wall_table(spark, sf).select("*", F.col("stroke_rgb").alias("color_rgb"), none.alias("layer_name"), none.alias("start_junction_id"), none.alias("end_junction_id"), F.lit(None).cast("array<string>").alias("connected_segment_ids"), F.lit(None).cast("array<string>").alias("adjacent_room_ids"), F.col("role").alias("functional_role"), F.lit(0.5).alias("confidence"), F.lit("rule").alias("rule_triggered"), F.lit(None).cast("boolean").alias("requires_cross_document_validation"))
    r = w.select(assemble.wall_record().alias("r")).select("r.*")
    return r.select("segment_id", r6("geometry.centerline_length").alias("centerline_length"), r6("geometry.angle_degrees").alias("angle_degrees"), "geometry.thickness", "visual_properties.line_weight", "semantic.functional_role")


@query("snk03", f"WITH {W} SELECT segment_id, length FROM walls")
def _snk03(spark, sf):
    return assemble.public(wall_table(spark, sf).select("segment_id", "length", F.col("ord").alias("_ord"), F.col("n").alias("_n")))


for _name in ("snk10",):
    query(_name, f"WITH {W}, {R} SELECT * FROM (SELECT plan_id, 'rooms' AS layer, 0 AS z, 'polygon' AS kind, room_type AS style FROM rooms UNION ALL SELECT plan_id, 'walls', 1, 'line', role FROM walls)")(lambda spark, sf: sinks.overlay_primitives(room_table(spark, sf), wall_table(spark, sf).withColumnRenamed("role", "functional_role"), None, None, None, {"rooms", "walls"}).select("plan_id", "layer", "z", "kind", "style"))


def damaged(spark, sf):
    """Documents with planted faults, by number: a wrong room type, a wrong count, a missing reference, a
    repeated id, a flag that is not set."""
    d = room_table(spark, sf).select("plan_id", "room", "room_id", "ring", "area", "room_type", "k")
    bad = lambda c, v, other: F.when(F.col("k") % c == 0, F.lit(v)).otherwise(other)
    none = F.array().cast("array<string>")
    rooms_in = d.select("plan_id", "room", F.when((F.col("k") % 16).isin(1, 2), F.lit("twice")).otherwise(F.col("room_id")).alias("room_id"), "ring", "area", F.lit(1.0).alias("cx"), F.lit(1.0).alias("cy"), F.when(F.col("k") % 5 == 0, F.array(F.lit("s-lost"))).otherwise(none).alias("bounding_walls"), F.lit(None).cast("string").alias("room_name"), F.lit(None).cast("string").alias("room_number"), bad(6, "ballroom", F.col("room_type")).alias("room_type"), F.lit("polygon_closure").alias("rule_triggered"), F.lit(False).alias("requires_cross_document_validation"))
    regions = region_table(spark, sf).withColumns({"enclosing_room_id": F.lit(None).cast("string"), "linked_entity_ids": none, "requires_cross_document_validation": F.col("requires_cross_document_validation") & (F.col("ord") % 3 != 0)})
    plans = d.select("plan_id").distinct().select("plan_id", F.lit("x.pdf").alias("source_pdf"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    regions = regions.join(plans.select("plan_id"), "plan_id", "left_semi")
    nothing = lambda schema: spark.createDataFrame([], schema)
    no_walls = nothing("plan_id long, segment_id string, x0 double, y0 double, x1 double, y1 double, thickness double, stroke_width double, color_rgb array<double>, is_dashed boolean, layer_name string, start_junction_id string, end_junction_id string, start_junction_type string, end_junction_type string, connected_segment_ids array<string>, adjacent_room_ids array<string>, functional_role string, confidence double, rule_triggered string, requires_cross_document_validation boolean")
    no_doors = nothing("plan_id long, ord int, opening_id string, type string, x double, y double, width double, swing_arc array<array<double>>, wall_segment_id string, connects_room_ids array<string>, confidence double, rule_triggered string")
    no_grid = nothing("plan_id long, ord int, grid_id string, axis string, label string, x0 double, y0 double, x1 double, y1 double, rule_triggered string")
    no_junctions = nothing("plan_id long, junction_id string, x double, y double, junction_type string, connected_segment_ids array<string>")
    docs = assemble.assemble(plans, rooms_in, no_walls, no_doors, regions, no_grid, no_junctions, texts.cross_references(regions.limit(0)))
    wrong = F.col("metadata.entity_counts").withField("walls", (F.col("plan_id") % 2).cast("long"))
    return docs.withColumn("metadata", F.col("metadata").withField("entity_counts", wrong))


_BAD = f"{R}, {REGIONS}"
query("val01", f"WITH {R} SELECT plan_id, CASE WHEN k % 16 IN (1, 2) THEN 'twice' ELSE room_id END AS entity_id, 'room_type: not allowed: ballroom' AS error FROM rooms WHERE k % 6 = 0")(lambda spark, sf: validate.check_fields(damaged(spark, sf), "rooms").select("plan_id", "entity_id", "error"))
query("val02", f"WITH {R} SELECT plan_id, 'twice' AS entity_id FROM rooms WHERE k % 16 IN (1, 2) GROUP BY plan_id HAVING count(*) > 1")(lambda spark, sf: validate.check_unique(damaged(spark, sf), "rooms").select("plan_id", "entity_id"))
query("val03", f"WITH {R} SELECT DISTINCT plan_id, CASE WHEN k % 16 IN (1, 2) THEN 'twice' ELSE room_id END AS entity_id, 'bounding_walls: unknown id s-lost' AS error FROM rooms WHERE k % 5 = 0")(lambda spark, sf: validate.check_references(damaged(spark, sf)).select("plan_id", "entity_id", "error"))
query("val04", f"WITH {_BAD} SELECT plan_id, text_region_id AS entity_id FROM regions WHERE plan_id IN (SELECT plan_id FROM rooms) AND ord % 3 = 0 AND (len(refs) > 0 OR split_part(c, ':', 1) = 'sheet_callout')")(lambda spark, sf: validate.check_fields(damaged(spark, sf), "text_regions").filter("error like 'references need%'").select("plan_id", "entity_id"))
query("val05", f"WITH {R} SELECT DISTINCT plan_id, 'entity_counts.walls: 1, there are 0' AS error FROM rooms WHERE plan_id % 2 = 1")(lambda spark, sf: validate.check_counts(damaged(spark, sf)).select("plan_id", "error"))


@query("snk05", f"WITH {R} SELECT plan_id, count(*) AS n_errors FROM (SELECT plan_id FROM rooms WHERE k % 6 = 0 UNION ALL SELECT DISTINCT plan_id FROM rooms WHERE plan_id % 2 = 1) GROUP BY plan_id")
def _snk05(spark, sf):
    docs = damaged(spark, sf)
    errors = validate.check_fields(docs, "rooms").unionByName(validate.check_counts(docs))
    _, bad = validate.split_valid(docs, errors)
    return bad.select("plan_id", "n_errors")


query("lim02", f"WITH {R} SELECT plan_id, least(2, count(*)) AS shown FROM rooms WHERE k % 6 = 0 GROUP BY plan_id")(lambda spark, sf: validate.split_valid(damaged(spark, sf), validate.check_fields(damaged(spark, sf), "rooms"), 2)[1].select("plan_id", F.size("errors").cast("long").alias("shown")))


@query("val06", f"WITH {W} SELECT segment_id AS entity_id, CASE WHEN n % 4 = 1 THEN 'provenance.rule_triggered: must be true or false' WHEN n % 4 = 2 THEN 'provenance.text_provenance: unknown id' ELSE 'provenance.geometry_provenance: must be a list' END AS error FROM walls WHERE n % 4 <> 0")
def _val06(spark, sf):
    doc = F.get(F.array(F.lit('{"rule_triggered": true, "text_provenance": ["t1"]}'), F.lit('{"rule_triggered": "yes"}'), F.lit('{"text_provenance": ["t1", "t9"]}'), F.lit('{"geometry_provenance": "w"}')), (F.col("n") % 4).cast("int"))
    rows = wall_table(spark, sf).select("plan_id", F.lit("walls").alias("entity"), F.col("segment_id").alias("entity_id"), doc.alias("provenance"), F.array(F.lit("t1")).alias("text_ids"), F.array(F.lit("w1")).alias("wall_ids"))
    return validate.check_provenance(rows).select("entity_id", "error")


@query("val08", f"WITH {R} SELECT room_id AS entity_id, CASE k % 4 WHEN 1 THEN 'centroid: must be two finite numbers' WHEN 2 THEN 'area: must be finite and not negative' ELSE 'polygon: needs three points' END AS error FROM rooms WHERE k % 4 <> 0")
def _val08(spark, sf):
    k = F.col("k") % 4
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    r = room_table(spark, sf).select("plan_id", "room_id", F.when(k == 1, F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.array("rx0", "ry0")).alias("centroid"), F.when(k == 2, -F.col("area")).otherwise(F.col("area")).alias("area"), F.when(k == 3, F.slice(ring, 1, 2)).otherwise(ring).alias("polygon"))
    return validate.check_geometry(r).select("entity_id", "error")


# --- evaluation ------------------------------------------------------------------------------------


def role_pairs(spark, sf):
    w = wall_table(spark, sf)
    return evaluate.match_by_id(w.filter("n % 11 <> 0"), w.filter("n % 13 <> 0").withColumn("role", F.col("role2")))


_ROLES = f"{W}, rp AS (SELECT plan_id, segment_id, CASE WHEN n % 11 <> 0 THEN role END AS pred_role, CASE WHEN n % 13 <> 0 THEN role2 END AS truth_role FROM walls WHERE n % 11 <> 0 OR n % 13 <> 0)"
query("jm01", f"WITH {_ROLES} SELECT * FROM rp")(role_pairs)
query("set02", f"WITH {_ROLES} SELECT plan_id, segment_id FROM rp WHERE pred_role IS NOT NULL AND truth_role IS NOT NULL")(lambda spark, sf: wall_table(spark, sf).filter("n % 11 <> 0").select("plan_id", "segment_id").intersect(wall_table(spark, sf).filter("n % 13 <> 0").select("plan_id", "segment_id")))
query("set03", f"WITH {_ROLES} SELECT plan_id, segment_id FROM rp WHERE truth_role IS NULL")(lambda spark, sf: wall_table(spark, sf).filter("n % 11 <> 0").select("plan_id", "segment_id").exceptAll(wall_table(spark, sf).filter("n % 13 <> 0").select("plan_id", "segment_id")))

_ALL = [*ROLES, evaluate.UNMATCHED]
_MATRIX = f"WITH {_ROLES}, m AS (SELECT coalesce(truth_role, 'UNMATCHED') AS t, coalesce(pred_role, 'UNMATCHED') AS p FROM rp) SELECT c.t AS truth_role, {', '.join(f'''count(*) FILTER (WHERE m.p = '{r}') AS "{r}"''' for r in _ALL)} FROM (SELECT unnest({_listed(_ALL)}) AS t) c LEFT JOIN m ON m.t = c.t GROUP BY c.t"
for _name in ("ag15", "snk07"):
    query(_name, _MATRIX)(lambda spark, sf: evaluate.confusion(role_pairs(spark, sf)))

query("ag16", f"""WITH {_ROLES}, m AS (SELECT coalesce(truth_role, 'UNMATCHED') AS t, coalesce(pred_role, 'UNMATCHED') AS p FROM rp), s AS (SELECT r AS role, (SELECT count(*) FROM m WHERE t = r AND p = r) AS tp, (SELECT count(*) FROM m WHERE t <> r AND p = r) AS fp, (SELECT count(*) FROM m WHERE t = r AND p <> r) AS fn FROM (SELECT unnest({_listed(ROLES)}) AS r))
SELECT role, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE, 6) AS f1 FROM s""")(lambda spark, sf: evaluate.class_scores(role_pairs(spark, sf)))
query("evl03", f"WITH {_ROLES} SELECT round(count(*) FILTER (WHERE pred_role = truth_role) / count(*) FILTER (WHERE pred_role IS NOT NULL AND truth_role IS NOT NULL), 6) AS accuracy, count(*) FILTER (WHERE pred_role IS NOT NULL AND truth_role IS NOT NULL) AS matched_total, count(*) FILTER (WHERE truth_role IS NULL) AS unmatched_predictions, count(*) FILTER (WHERE pred_role IS NULL) AS unmatched_truth FROM rp")(lambda spark, sf: evaluate.overall_scores(role_pairs(spark, sf)))
for _name in ("ag17", "srt04"):
    query(_name, f"WITH {_ROLES} SELECT truth_role, pred_role, count(*) AS count FROM rp WHERE truth_role <> pred_role GROUP BY ALL")(lambda spark, sf: evaluate.failures(role_pairs(spark, sf)).select("truth_role", "pred_role", "count"))


def line_table(spark, sf):
    """The lines of the grids of cells, far apart, numbered."""
    from pyspark.sql import Window

    lines = grid_rooms(spark, sf)
    number = F.row_number().over(Window.partitionBy("plan_id").orderBy("x0", "y0", "x1", "y1")) - 1
    return lines.select("plan_id", number.cast("int").alias("ord"), "x0", "y0", "x1", "y1", F.lit(6.0).alias("thickness"))


_LINES = f"""{_PER_CELL}, l AS (SELECT plan_id, i * 120.0 AS x0, 0.0 AS y0, i * 120.0 AS x1, ny * 90.0 AS y1 FROM s, (SELECT unnest(range(0, 5)) AS i) u WHERE i <= nx
  UNION ALL SELECT plan_id, 0.0, j * 90.0, nx * 120.0, j * 90.0 FROM s, (SELECT unnest(range(0, 4)) AS j) u WHERE j <= ny
), lines AS (SELECT *, (row_number() OVER (PARTITION BY plan_id ORDER BY x0, y0, x1, y1) - 1)::INT AS ord FROM l)"""


@query("jm02", f"{_LINES} SELECT plan_id, CASE WHEN ord % 3 <> 0 THEN ord ELSE -1 END AS p_ord, CASE WHEN ord % 4 <> 0 THEN ord ELSE -1 END AS t_ord FROM lines WHERE ord % 3 <> 0 OR ord % 4 <> 0")
def _jm02(spark, sf):
    w = line_table(spark, sf)
    moved = w.filter("ord % 3 <> 0").select("plan_id", "ord", *[(F.col(c) + 1).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return evaluate.match_nearest(moved, w.filter("ord % 4 <> 0"), 3.0).na.fill(-1)


def line_marks(spark, sf):
    """Both sides of two thirds of the lines as marks."""
    from pyspark.sql import Window

    w = line_table(spark, sf).filter("ord % 3 <> 0")
    up = F.col("x0") == F.col("x1")
    off = lambda s: (F.when(up, 3.0 * s).otherwise(0.0), F.when(up, 0.0).otherwise(3.0 * s))
    side = lambda s: w.select("plan_id", (F.col("ord") * 2 + int(s > 0)).alias("o"), (F.col("x0") + off(s)[0]).alias("gx0"), (F.col("y0") + off(s)[1]).alias("gy0"), (F.col("x1") + off(s)[0]).alias("gx1"), (F.col("y1") + off(s)[1]).alias("gy1"), G.length("x0", "y0", "x1", "y1").alias("g_len"))
    m = side(-1.0).union(side(1.0))
    return m.select("plan_id", (F.row_number().over(Window.partitionBy("plan_id").orderBy("o")) - 1).cast("int").alias("g_ord"), "gx0", "gy0", "gx1", "gy1", "g_len")


def _claims(spark, sf):
    return evaluate.claim(evaluate.claim_candidates(line_table(spark, sf), line_marks(spark, sf)))


for _name in ("jm03", "jm04"):
    query(_name, f"{_LINES} SELECT plan_id, count(*)::INT AS tp, (2 * count(*))::INT AS matched, count(*)::INT AS soft_tp FROM lines WHERE ord % 3 <> 0 GROUP BY plan_id")(_claims)


def _wall_scores(spark, sf):
    return evaluate.wall_scores(_claims(spark, sf), line_table(spark, sf), line_marks(spark, sf))


_SCORES = f"""{_LINES}, c AS (SELECT plan_id, count(*) AS n, count(*) FILTER (WHERE ord % 3 <> 0) AS m FROM lines GROUP BY plan_id), scores AS (
  SELECT plan_id, n AS n_pred, 2 * m AS n_marks, m AS n_true, m AS tp, n - m AS fp, 0::BIGINT AS fn, round_even(m / n, 3) AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS coverage, round_even(2 * (m / n) / (m / n + 1), 3) AS f1, m AS soft_tp, round_even(m / n, 3) AS soft_precision, 1.0::DOUBLE AS soft_recall_walls, 1.0::DOUBLE AS soft_recall_segments, round_even(2 * (m / n) / (m / n + 1), 3) AS soft_f1 FROM c)"""
for _name in ("ag18", "evl02"):
    query(_name, f"{_SCORES} SELECT * FROM scores")(_wall_scores)
for _name in ("ag19", "evl06"):
    query(_name, f"{_SCORES} SELECT count(*) AS n_plans, {', '.join(f'round_even(avg({c}), 3) AS mean_{c}' for c in ('precision', 'recall', 'f1', 'soft_precision', 'soft_recall_walls', 'soft_f1'))} FROM scores")(lambda spark, sf: evaluate.macro_average(_wall_scores(spark, sf)))


def _missed(spark, sf):
    return room_table(spark, sf).filter("k % 4 = 3").select("plan_id")


_DET = f"WITH {L}, h AS (SELECT plan_id, count(*) FILTER (WHERE correct_type <> 'wrong_detection') AS tp, count(*) FILTER (WHERE correct_type = 'wrong_detection') AS fp FROM labelled GROUP BY plan_id), m AS (SELECT plan_id, count(*) AS fn FROM rooms WHERE k % 4 = 3 GROUP BY plan_id), j AS (SELECT coalesce(h.plan_id, m.plan_id) AS plan_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM h FULL JOIN m ON m.plan_id = h.plan_id) SELECT plan_id, tp, fp, fn, round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE, 3) AS precision, round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE, 3) AS recall FROM j"
for _name in ("ag22", "evl01"):
    query(_name, _DET)(lambda spark, sf: evaluate.room_detection(room_table(spark, sf), label_table(spark, sf), _missed(spark, sf)))

query("ag23", f"WITH {L}, j AS (SELECT l.plan_id, l.correct_type, r.room_type FROM labelled l JOIN rooms r ON r.room_id = l.room_id WHERE correct_type <> 'wrong_detection') SELECT plan_id, count(*) FILTER (WHERE correct_type = room_type) AS correct, count(*) AS total, round_even(count(*) FILTER (WHERE correct_type = room_type) / count(*), 3) AS accuracy FROM j GROUP BY plan_id")(lambda spark, sf: evaluate.room_type_accuracy(room_table(spark, sf), label_table(spark, sf)).drop("mismatches"))
query("jm06", f"WITH {L} SELECT r.plan_id, r.room_id, r.room_type, l.correct_type FROM rooms r LEFT JOIN labelled l ON l.room_id = r.room_id")(lambda spark, sf: room_table(spark, sf).select("plan_id", "room_id", "room_type").join(label_table(spark, sf).select("plan_id", "room_id", "correct_type"), ["plan_id", "room_id"], "left"))

_SHEETS = f"""WITH {XREFS}, d AS (SELECT DISTINCT plan_id, target_sheet FROM xrefs), v AS (SELECT plan_id, target_sheet FROM d WHERE length(target_sheet) > 2), m AS (SELECT plan_id, count(DISTINCT t) AS fn FROM regions WHERE t LIKE 'UNIT%' GROUP BY plan_id
), h AS (SELECT d.plan_id, count(v.target_sheet) AS tp, count(*) - count(v.target_sheet) AS fp FROM d LEFT JOIN v ON v.plan_id = d.plan_id AND v.target_sheet = d.target_sheet GROUP BY d.plan_id), j AS (SELECT coalesce(h.plan_id, m.plan_id) AS plan_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM h FULL JOIN m ON m.plan_id = h.plan_id)
SELECT plan_id, tp, fp, fn, round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE, 3) AS precision, round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE, 3) AS recall FROM j"""


@query("ag24", _SHEETS)
def _ag24(spark, sf):
    regions = region_table(spark, sf)
    x = texts.cross_references(regions)
    valid = x.filter(F.length("target_sheet") > 2).select("plan_id", "target_sheet").unionByName(x.limit(1).select("plan_id", F.lit("Z999").alias("target_sheet")))
    missed = regions.filter(F.col("text").startswith("UNIT")).select("plan_id", F.col("text").alias("target_sheet"))
    return evaluate.sheet_scores(x, valid, missed).drop("noise")


def plan_runs(spark, sf):
    """A run of each customer's plan with a status."""
    c = B.table(spark, sf, "customer")
    status = F.get(F.array(F.lit("ok"), F.lit("timeout: exceeded 300s cap"), F.lit("error: no drawings"), F.lit(""), F.lit("ok")), (F.col("c_custkey") % 5).cast("int"))
    return c.select(F.col("c_custkey").alias("plan_id"), status.alias("status"))


for _name in ("ag11", "exe01"):
    query(_name, "SELECT CASE c_custkey % 5 WHEN 1 THEN 'timeout' WHEN 2 THEN 'error' WHEN 3 THEN 'unknown' ELSE 'ok' END AS bucket, count(*) AS n FROM customer GROUP BY ALL")(lambda spark, sf: evaluate.status_counts(plan_runs(spark, sf)))


@query("ag12", f"WITH {P}, {XREFS}, s AS (SELECT d.plan_id, (SELECT count(*) FROM regions r WHERE r.plan_id = d.plan_id AND r.t LIKE 'K%') AS a, (SELECT count(*) FROM xrefs x WHERE x.plan_id = d.plan_id) AS b FROM (SELECT DISTINCT plan_id FROM texts) d) SELECT round(avg((a > 0)::INT), 6) AS share_labels, round(avg((b > 0)::INT), 6) AS share_references FROM s")
def _ag12(spark, sf):
    regions = region_table(spark, sf)
    x = texts.cross_references(regions).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_references"))
    s = regions.groupBy("plan_id").agg(F.count(F.when(F.col("text").startswith("K"), 1)).alias("n_labels")).join(x, "plan_id", "left").na.fill(0)
    return evaluate.coverage(s)


def version_files(spark, sf):
    p = B.table(spark, sf, "part")
    k = F.col("p_partkey")
    stem = F.concat(F.lit("plan"), F.expr("p_partkey div 5").cast("string"))
    name = F.concat(stem, F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("_v"), ((k * 7) % 11).cast("string"))), F.lit(".csv"))
    return p.select(stem.alias("stem"), name.alias("file"))


_FILES = "f AS (SELECT p_partkey // 5 AS g, 'plan' || p_partkey // 5 AS stem, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE (p_partkey * 7) % 11 END AS v, 'plan' || p_partkey // 5 || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '_v' || (p_partkey * 7) % 11 END || '.csv' AS file FROM part)"
query("ag13", f"WITH {_FILES} SELECT stem, file FROM f QUALIFY row_number() OVER (PARTITION BY stem ORDER BY v DESC, file) = 1")(lambda spark, sf: evaluate.latest_version(version_files(spark, sf)))


@query("jm07", f"WITH {_FILES}, b AS (SELECT stem, file FROM f QUALIFY row_number() OVER (PARTITION BY stem ORDER BY v DESC, file) = 1) SELECT 'plan' || s_suppkey || '.pdf' AS plan, b.file FROM supplier LEFT JOIN b ON b.stem = 'plan' || s_suppkey")
def _jm07(spark, sf):
    plans = B.table(spark, sf, "supplier").select(F.concat(F.lit("plan"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("plan"))
    return evaluate.plan_marks(plans, version_files(spark, sf))


@query("ag14", f"WITH {W}, m AS (SELECT plan_id, count(*) AS n_rows, count(*) FILTER (WHERE n % 2 = 1) AS w FROM walls GROUP BY plan_id), c AS (SELECT plan_id, count(*) AS n_walls FROM walls WHERE n % 3 = 0 GROUP BY plan_id) SELECT c.plan_id, n_walls, w // 2 AS estimated_walls, round_even(n_walls / greatest(w // 2, 1)::DOUBLE, 3) AS detection_rate FROM c JOIN m ON m.plan_id = c.plan_id")
def _ag14(spark, sf):
    w = wall_table(spark, sf)
    marks = evaluate.mark_statistics(w.select("plan_id", (F.col("n") % 2).alias("is_wall")))
    found = w.filter("n % 3 = 0").groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_walls"))
    return evaluate.detection_rate(found, marks)


@query("lim01", "SELECT c_custkey AS plan_id FROM customer ORDER BY c_custkey LIMIT 10")
def _lim01(spark, sf):
    return plan_runs(spark, sf).select("plan_id").orderBy("plan_id").limit(10)


# --- labels ----------------------------------------------------------------------------------------


def _template(spark, sf):
    r = room_table(spark, sf).select("plan_id", F.when(F.col("k") % 8 != 0, F.col("room_id")).alias("room_id"), (F.col("rx0") + F.col("k") / 8).alias("cx"), F.col("ry0").alias("cy"), (F.col("area") + F.col("k") / 16).alias("area"), "room_type", F.lit(None).cast("string").alias("room_name"), F.lit(None).cast("string").alias("room_number"))
    return labels.template_rooms(r)[0].select("plan_id", "room_id", "cx", "cy", "area", "correct_type")


for _name in ("lbl01", "snk09"):
    query(_name, f"WITH {R} SELECT plan_id, room_id, round_even(rx0 + k / 8.0, 2)::DOUBLE AS cx, ry0 AS cy, round_even(area + k / 16.0, 1)::DOUBLE AS area, 'TODO' AS correct_type FROM rooms WHERE k % 8 <> 0")(_template)

query("val07", f"""WITH {L}, bad AS (SELECT plan_id, room_id, CASE WHEN k % 4 = 0 THEN 'TODO' WHEN k % 7 = 0 THEN 'ballroom' ELSE correct_type END AS t FROM labelled)
SELECT plan_id, room_id, CASE WHEN t = 'TODO' THEN 'correct_type: still to do' ELSE 'correct_type: not allowed: ballroom' END AS error FROM bad WHERE t IN ('TODO', 'ballroom') UNION ALL SELECT plan_id, room_id, 'room_id: no label' FROM rooms WHERE k % 9 = 0""")(
    lambda spark, sf: labels.label_errors(room_table(spark, sf), label_table(spark, sf).withColumn("correct_type", F.when(F.col("k") % 4 == 0, "TODO").when(F.col("k") % 7 == 0, "ballroom").otherwise(F.col("correct_type")))).select("plan_id", "room_id", "error")
)


@query("lbl05", f"WITH {R} SELECT room_id, printf('%.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f', rx0 * 1.5, (900 - ry0) * 1.5, rx1 * 1.5, (900 - ry0) * 1.5, rx1 * 1.5, (900 - ry1) * 1.5, rx0 * 1.5, (900 - ry1) * 1.5, rx0 * 1.5, (900 - ry0) * 1.5) AS points FROM rooms")
def _lbl05(spark, sf):
    page = (F.lit(1200.0), F.lit(900.0), F.lit(900.0), F.lit(0), F.lit(1.5), F.lit(1.5))
    return room_table(spark, sf).select("room_id", labels.overlay_polygon(F.col("ring"), *page).alias("points"))


@query("lbl06", f"WITH {R} SELECT room_id, (2 * rx0 + 2 * rx1) / 4 AS cx, (2 * ry0 + 2 * ry1) / 4 AS cy FROM rooms WHERE k % 3 <> 0")
def _lbl06(spark, sf):
    points = F.when(F.col("k") % 3 == 0, F.slice("ring", 1, 2)).otherwise(F.slice("ring", 1, 4))
    d = labels.drawn_room(points)
    return room_table(spark, sf).select("room_id", d["cx"].alias("cx"), d["cy"].alias("cy")).filter("cx IS NOT NULL")


@query("lbl07", f"WITH {L} SELECT r.plan_id, r.room_id, coalesce(l.correct_type, 'TODO') AS correct_type FROM rooms r LEFT JOIN labelled l ON l.room_id = r.room_id")
def _lbl07(spark, sf):
    current = room_table(spark, sf).select("plan_id", "room_id", F.lit("TODO").alias("correct_type"))
    stray = spark.createDataFrame([(0, "nowhere", "unit")], "plan_id long, room_id string, correct_type string")
    return labels.merge_labels(current, label_table(spark, sf).select("plan_id", "room_id", "correct_type").unionByName(stray))


@query("lbl08", f"WITH {R} SELECT plan_id, count(*) FILTER (WHERE k % 9 <> 0) AS labelled, count(*) FILTER (WHERE k % 9 = 0) AS todo FROM rooms GROUP BY plan_id")
def _lbl08(spark, sf):
    return labels.progress(_lbl07(spark, sf))


@query("lbl09", f"WITH {T} SELECT plan_id, ord, '\"' || replace(replace(text, '\\', '\\\\'), '\"', '\\\"') || '\"' AS quoted FROM texts")
def _lbl09(spark, sf):
    return B.text_blocks(spark, sf).select("plan_id", "ord", labels.quoted(F.col("text")).alias("quoted"))


# --- files -----------------------------------------------------------------------------------------


def small_documents(spark, sf):
    """Documents of the rooms and text regions alone, as planted for the checks."""
    return damaged(spark, sf)


@query("snk04", f"WITH {R} SELECT plan_id, count(*) AS n_rooms, sum(area) AS area FROM rooms GROUP BY plan_id")
def _snk04(spark, sf):
    """Documents written as JSON, a folder for each drawing, and read back whole."""
    from ..schemas import DOCUMENT
    from ..tables import new_path

    path = new_path(spark, "json")
    sinks.write_documents(small_documents(spark, sf), path)
    back = spark.read.schema(DOCUMENT).json(path)
    return back.select("plan_id", F.size("rooms").cast("long").alias("n_rooms"), F.aggregate(F.transform("rooms", lambda r: r["area"]), F.lit(0.0), lambda a, x: a + x).alias("area"))


@query("src12", f"WITH {R} SELECT plan_id, room_id FROM (SELECT plan_id, CASE WHEN k % 16 IN (1, 2) THEN 'twice' ELSE room_id END AS room_id FROM rooms)")
def _src12(spark, sf):
    from ..sources import readers
    from ..tables import new_path

    path = new_path(spark, "documents")
    sinks.write_documents(small_documents(spark, sf), path)
    return readers.documents(spark, path).select("plan_id", F.explode("rooms").alias("r")).select("plan_id", "r.room_id")


@query("src15", f"WITH {R} SELECT DISTINCT plan_id FROM rooms")
def _src15(spark, sf):
    """Sidecars lie beside the documents and are not read."""
    from ..sources import readers
    from ..tables import new_path

    path = new_path(spark, "folder")
    sinks.write_documents(small_documents(spark, sf), path)
    docs = readers.documents(spark, path)
    return docs.filter(~F.col("file").contains("_dropped")).select("plan_id").distinct()


@query("src13", f"WITH {W} SELECT plan_id, count(*) AS n_rows, count(*) FILTER (WHERE n % 2 = 1) AS n_wall_rows, count(*) FILTER (WHERE n % 2 = 1) // 2 AS estimated_walls FROM walls GROUP BY plan_id")
def _src13(spark, sf):
    from ..sources import readers
    from ..tables import new_path

    path = new_path(spark, "marks")
    wall_table(spark, sf).select("plan_id", "segment_id", (F.col("n") % 2).alias("is_wall")).write.option("header", True).csv(path)
    rows = readers.marks_csv(spark, path).withColumn("plan_id", F.col("plan_id").cast("long"))
    return evaluate.mark_statistics(rows)


@query("evl05", "SELECT bucket, count(*) AS n, sum(n_rooms)::BIGINT AS n_rooms FROM (SELECT CASE s_suppkey % 5 WHEN 1 THEN 'timeout' WHEN 2 THEN 'error' WHEN 3 THEN 'unknown' ELSE 'ok' END AS bucket, CASE WHEN s_suppkey % 5 IN (0, 4) THEN (1 + s_suppkey % 4) * (1 + s_suppkey % 3) ELSE 0 END AS n_rooms FROM supplier) GROUP BY bucket")
def _evl05(spark, sf):
    """A batch of drawings: each run's status, and the rooms of those that ended well."""
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("plan_id"))
    status = F.get(F.array(F.lit("ok"), F.lit("timeout: exceeded 300s cap"), F.lit("error: no drawings"), F.lit(""), F.lit("ok")), (F.col("plan_id") % 5).cast("int"))
    runs = s.select("plan_id", X.status_bucket(status).alias("bucket"))
    found = _rooms_of(spark, sf)[2].groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    ok = runs.filter("bucket = 'ok'").join(found, "plan_id", "left").select("plan_id", F.col("n").alias("rooms"))
    return runs.join(ok, "plan_id", "left").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("rooms", F.lit(0))).alias("n_rooms"))
