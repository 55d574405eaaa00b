"""Cases of single operators with hand-made drawings."""

import math

import pytest
from pyspark.sql import functions as F

from draftgraph import schemas
from draftgraph.config import DEFAULT, Config, ConfigError
from draftgraph.functions import geometry as G
from draftgraph.functions import text as X
from draftgraph.operators import classify, evaluate, polygons, roles, rooms, topology, validate, walls
from draftgraph.plans import extract


def path(ord, x0, y0, x1, y1, width=1.0, rgb=(0.0, 0.0, 0.0), dashed=False, kind="line", plan=1):
    return (plan, ord, f"p{ord}", kind, float(x0), float(y0), float(x1), float(y1), float(width), list(map(float, rgb)), None, None, dashed, None, 0)


def paths(spark, rows):
    return spark.createDataFrame(rows, schemas.PATHS)


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, t, *map(float, box), 0) for i, (t, box) in enumerate(rows)], schemas.TEXT_BLOCKS)


def wall(ord, x0, y0, x1, y1, thickness=4.0, plan=1):
    n = math.hypot(x1 - x0, y1 - y0)
    return (plan, ord, f"w{ord}", float(x0), float(y0), float(x1), float(y1), n, math.degrees(math.atan2(y1 - y0, x1 - x0)) % 180, float(thickness), 1.0, [0.0, 0.0, 0.0], False, None, ["a", "b"], ["parallel_pairing"], [], n)


def wall_rows(spark, rows):
    return spark.createDataFrame(rows, schemas.WALLS_RAW)


def rectangle(w, h, x=0, y=0, start=0):
    return [wall(start, x, y, x + w, y), wall(start + 1, x + w, y, x + w, y + h), wall(start + 2, x + w, y + h, x, y + h), wall(start + 3, x, y + h, x, y)]


def pair(ord, x, y, n, t):
    return [path(ord, x, y, x + n, y), path(ord + 1, x, y + t, x + n, y + t)]


@pytest.mark.parametrize(
    "row, texts, kind",
    [
        (path(0, 0, 0, 100, 0), [], "wall_candidate"),
        (path(0, 0, 0, 100, 0, width=0.2), [], "annotation"),
        (path(0, 0, 0, 100, 0, width=0.2), [("28'", (10, -5, 40, 5))], "dimension"),
        (path(0, 0, 0, 100, 0, dashed=True), [], "unknown"),
        (path(0, 0, 0, 100, 0, rgb=(0.9, 0.9, 0.9)), [], "unknown"),
        (path(0, 0, 0, 100, 0, width=0.4), [], "unknown"),
    ],
)
def test_path_classes(spark, row, texts, kind):
    out = classify.classify_paths(paths(spark, [row]), blocks(spark, texts)).collect()
    assert [r.candidate_type for r in out] == [kind] and 0 <= out[0].classification_confidence <= 1


def detect(spark, rows):
    p = paths(spark, rows)
    return walls.detect_walls(classify.classify_paths(p, blocks(spark, [])))


def test_wall_of_two_lines(spark):
    kept, _ = detect(spark, pair(0, 10, 100, 100, 6))
    (w,) = kept.collect()
    assert (w.length, w.thickness, w.y0, w.y1) == (100.0, 6.0, 103.0, 103.0)
    assert {w.x0, w.x1} == {10.0, 110.0} and "orthogonality" in w.rules_passed


@pytest.mark.parametrize("second", [(0, 6, 100, 40), (0, 200, 100, 200), (95, 6, 195, 6)])
def test_no_wall(spark, second):
    kept, dropped = detect(spark, [path(0, 0, 0, 100, 0), path(1, *second)])
    assert kept.count() == 0 and dropped.count() == 0


def test_slanted_wall_is_not_orthogonal(spark):
    d = 6 / math.sqrt(2)
    kept, _ = detect(spark, [path(0, 0, 0, 100, 100), path(1, -d, d, 100 - d, 100 + d)])
    (w,) = kept.collect()
    assert "orthogonality" in w.rules_failed and abs(w.thickness - 6) < 1e-6


@pytest.mark.parametrize("groups, kept, dropped", [([(80, 6.0, 0.02), (20, 22.0, 0.9)], 80, 20), ([(50, 10.0, 0.0), (40, 6.0, 0.0), (10, 22.0, 0.0)], 90, 10), ([(3, 6.0, 5.0)], 3, 0)])
def test_thickness_modes(spark, groups, kept, dropped):
    rows, k = [], 0
    for n, at, step in groups:
        for i in range(n):
            w = list(wall(k, 0, 10 * k, 0, 10 * k, at + (i % 10) * step))
            w[7] = 0.0
            rows.append(tuple(w))
            k += 1
    a, b = walls.split_by_thickness(wall_rows(spark, rows))
    assert (a.count(), b.count()) == (kept, dropped)


def test_topology_of_a_rectangle(spark):
    w, j, d = topology.build_topology(wall_rows(spark, rectangle(100, 100)))
    assert w.count() == 4 and [r.junction_type for r in j.collect()] == ["corner"] * 4 and d.count() == 0


def test_t_junction_splits(spark):
    w, j, _ = topology.build_topology(wall_rows(spark, [wall(0, 0, 0, 100, 0), wall(1, 50, 0, 50, 50)]))
    assert w.count() == 3 and sorted(r.junction_type for r in j.collect()) == ["endpoint"] * 3 + ["t-junction"]


@pytest.mark.parametrize("n, kept", [(50, 1), (20, 0), (100, 1)])
def test_isolated_walls(spark, n, kept):
    w, _, d = topology.build_topology(wall_rows(spark, [wall(0, 0, 0, n, 0)]))
    assert (w.count(), d.count()) == (kept, 1 - kept)


def test_peninsula_stays(spark):
    w, _, d = topology.build_topology(wall_rows(spark, [*rectangle(100, 100), wall(4, 50, 0, 50, 15)]))
    assert w.count() == 6 and d.count() == 0


def test_split_bounds_drift(spark):
    df = spark.createDataFrame([([0.5, 0.51, 0.52, 0.99],)], "t array<double>")
    out = df.select(topology.merged_bounds(F.col("t"), F.lit(100.0), 3.0).alias("b")).first().b
    assert out == [0.0, 0.51, 1.0] or out == [0.0, 0.52, 1.0]


def rooms_of(spark, rows, texts=(), config=DEFAULT, fixtures=None):
    w, j, _ = topology.build_topology(wall_rows(spark, rows), config)
    found, adjacency = rooms.detect_rooms(w, j, blocks(spark, list(texts)), config, fixtures)
    return found.collect(), w, adjacency


def gap_room(gap):
    return [wall(0, 0, 0, 400, 0), wall(1, 400, 0, 400, 300), wall(2, 400, 300, 200 + gap / 2, 300), wall(3, 200 - gap / 2, 300, 0, 300), wall(4, 0, 300, 0, 0)]


def test_gap_is_bridged(spark):
    (r,), _, _ = rooms_of(spark, gap_room(40))
    assert r.rule_triggered == "polygon_closure_via_virtual_gap" and len(r.bounding_walls) == 5 and r.area == pytest.approx(120_000)
    assert rooms_of(spark, gap_room(40), config=Config(room_gap_close_enabled=False))[0] == []
    assert rooms_of(spark, gap_room(220))[0] == []


def test_slivers_are_no_rooms(spark):
    assert rooms_of(spark, rectangle(80, 8))[0] == []
    c = math.sqrt(0.5)
    turn = [wall(i, *(v for x, y in ((w[3], w[4]), (w[5], w[6])) for v in ((x - y) * c, (x + y) * c))) for i, w in enumerate(rectangle(80, 8))]
    assert rooms_of(spark, turn)[0] == []


def test_room_type_by_label_and_fixture(spark):
    (r,), _, _ = rooms_of(spark, rectangle(200, 200), [("BATHROOM", (90, 90, 110, 110)), ("204", (50, 50, 60, 60))])
    assert (r.room_type, r.rule_triggered, r.room_name, r.room_number) == ("bathroom", "label_match:BATH", "BATHROOM", "204")
    fixtures = spark.createDataFrame([(1, 0, "Toilet", 100.0, 100.0)], schemas.FIXTURES)
    (r,), _, _ = rooms_of(spark, rectangle(200, 200), fixtures=fixtures)
    assert (r.room_type, r.rule_triggered) == ("bathroom", "fixture_match:toilet")


def roles_of(spark, rows, texts=()):
    t = blocks(spark, list(texts))
    w, j, _ = topology.build_topology(wall_rows(spark, rows))
    found, adjacency = rooms.detect_rooms(w, j, t)
    return roles.assign_roles(w, t, found, adjacency).collect()


def test_roles(spark):
    assert [r.functional_role for r in roles_of(spark, rectangle(300, 300))] == ["exterior"] * 4
    middle = roles_of(spark, [*rectangle(500, 300), wall(4, 250, 0, 250, 300)])
    assert "demising" in {r.functional_role for r in middle}
    wet = roles_of(spark, [*rectangle(100, 100), wall(4, 50, 0, 50, 100)], [("BATHROOM", (60, 40, 95, 60))])
    flagged = [r for r in wet if r.functional_role == "wet_wall"]
    assert flagged and all(r.requires_cross_document_validation for r in flagged)
    ell = [(0, 0, 200, 0), (200, 0, 200, 100), (200, 100, 100, 100), (100, 100, 100, 200), (100, 200, 0, 200), (0, 200, 0, 0)]
    assert sum(r.functional_role == "exterior" for r in roles_of(spark, [wall(i, *e) for i, e in enumerate(ell)])) >= 4


def test_faces_with_a_hole():
    outer = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0)]
    inner = [(3, 3, 6, 3), (6, 3, 6, 6), (6, 6, 3, 6), (3, 6, 3, 3)]
    found = polygons.polygonize([*outer, *inner, (10, 5, 15, 5)])
    areas = sorted(polygons.area_and_center(r, h)[0] for r, h in found)
    assert areas == pytest.approx([9, 91])
    assert sorted(len(h) for _, h in found) == [0, 1]
    cross = polygons.polygonize([*outer, (0, 5, 10, 5), (5, 0, 5, 10)])
    assert sorted(polygons.area_and_center(r, h)[0] for r, h in cross) == pytest.approx([25] * 4)


@pytest.mark.parametrize("text, kind", [("204", "room_number"), ("A302", "sheet_callout"), ("F10.", "sheet_callout"), ("W1", "sheet_callout"), ("W-3", "wall_schedule_tag"), ("K", "grid_label"), ("DW", "unknown"), ("4", "grid_label"), ("28'-6\"", "dimension"), ("UNIT", "room_label"), ("see the note", "note"), ("", "unknown"), (None, "unknown")])
def test_text_classes(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.classify("t")["classification"]).first()[0] == kind


def test_first_pattern_wins(spark):
    words = {"UNIT": "mechanical", "SHALL": "hallway", "STORY": "storage", "CAPTION": "unit", "WASHINGTON": "laundry"}
    df = spark.createDataFrame([(w,) for w in words], "t string").select("t", X.room_match("t")["room_type"].alias("r"))
    assert {r.t: r.r for r in df.collect()} == words


def test_pixels(spark):
    df = spark.createDataFrame([(946.0, 1076.0)], "x double, y double")
    p = df.select(G.to_pixel("x", "y", F.lit(1728.0), F.lit(2592.0), F.lit(1728.0), F.lit(270), F.lit(1.0), F.lit(1.0)).alias("p")).first().p
    assert (p.x, p.y) == (652.0, 782.0)


def test_configuration(tmp_path):
    with pytest.raises(ConfigError):
        Config.from_mapping([])
    with pytest.raises(ConfigError):
        Config.from_mapping({"room_min_area": 1}, require_all=True)
    with pytest.raises(ConfigError):
        Config.from_yaml(str(tmp_path / "none.yaml"))
    f = tmp_path / "c.yaml"
    f.write_text("room_min_area: 7\nwet_zone_labels: [BATH]\n")
    c = Config.from_yaml(str(f), require_all=False)
    assert (c.room_min_area, c.wet_zone_labels) == (7, ("BATH",))


def test_documents_are_valid(spark):
    rows = [p for k, (x, y, n) in enumerate([(0, 0, 300), (0, 200, 300)]) for p in pair(2 * k, x, y, n, 6)]
    rows += [path(10 + k, x, y0, x, y1) for k, (x, y0, y1) in enumerate([(0, 0, 206), (6, 0, 206), (300, 0, 206), (306, 0, 206)])]
    plans = spark.createDataFrame([(1, "a.pdf", 400.0, 300.0)], "plan_id long, source_pdf string, width double, height double")
    docs, errors = extract.run(paths(spark, rows), blocks(spark, [("see A302/1", (100, 100, 150, 110))]), plans)
    d = docs.first()
    assert errors.collect() == [] and d.metadata.entity_counts.cross_references == 1
    assert d.cross_references[0].target_sheet == "A302" and d.cross_references[0].target_detail == "1"
    broken = docs.withColumn("rooms", F.expr("array()").cast(docs.schema["rooms"].dataType))
    assert d.metadata.entity_counts.rooms == 0 or validate.validate(broken).count() > 0
    with pytest.raises(validate.InvalidDocument):
        validate.require_valid(validate.check_counts(docs.withColumn("walls", F.slice("walls", 1, 0))))


def test_claims_are_exclusive(spark):
    w = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0, 6.0), (1, 1, 0.0, 0.0, 90.0, 0.0, 6.0)], "plan_id long, ord int, x0 double, y0 double, x1 double, y1 double, thickness double")
    m = spark.createDataFrame([(1, 0, 0.0, 3.0, 100.0, 3.0, 100.0), (1, 1, 0.0, -3.0, 100.0, -3.0, 100.0)], "plan_id long, g_ord int, gx0 double, gy0 double, gx1 double, gy1 double, g_len double")
    c = evaluate.claim(evaluate.claim_candidates(w, m, 2.0, 5.0)).first()
    assert (c.tp, c.matched) == (1, 2)


def test_streaming_arrivals(spark, tmp_path):
    from draftgraph.streaming.arrivals import watch

    paths(spark, pair(0, 10, 100, 100, 6)).write.parquet(str(tmp_path / "in"))
    plans = spark.createDataFrame([(1, "a.pdf", 400.0, 300.0)], "plan_id long, source_pdf string, width double, height double")
    q = watch(spark, str(tmp_path / "in"), blocks(spark, []), plans, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_walls_at_two_standard_deviations_are_no_outliers(spark):
    """One wall among five is at two standard deviations whatever its thickness, one among six further."""
    rows = [(n * 1000 + k, float(i), 2.0 + k * 0.37 + (i == 0) * (1 + k * 0.11)) for n in (5, 6) for k in range(200) for i in range(n)]
    none = F.array().cast("array<string>")
    w = spark.createDataFrame(rows, "plan_id long, ord double, thickness double").select("*", none.alias("rules_passed"), none.alias("rules_failed"))
    found = walls.tag_outliers(w).filter(F.array_contains("rules_failed", "thickness_outlier")).select("plan_id", "ord").collect()
    assert sorted(tuple(r) for r in found) == [(6000 + k, 0.0) for k in range(200)]
