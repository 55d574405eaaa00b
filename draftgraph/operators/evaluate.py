"""Scores of extracted entities against labels and marked drawings, and corpus statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ROLES, Config
from ..functions import geometry as G
from ..functions import text as X
from .labels import TODO, WRONG
from .spatial import near_join

UNMATCHED = "UNMATCHED"


def marked_segments(drawings: DataFrame, flip: bool = True) -> DataFrame:
    """plan_id, g_ord, gx0, gy0, gx1, gy1, g_len: red strokes of marked drawings; a rectangle gives its two
    long sides."""
    c = F.col("color")
    red = drawings.filter((c[0] > 0.8) & (c[1] < 0.3) & (c[2] < 0.3))
    item = red.select("plan_id", "ord", "page_height", F.posexplode("items").alias("k", "it"))
    p = lambda i: F.get(F.col("it.pts"), F.lit(i))
    side = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    x0, y0, x1, y1 = p(0)["x"], p(0)["y"], p(1)["x"], p(1)["y"]
    wide = F.abs(x1 - x0) >= F.abs(y1 - y0)
    rect = F.when(wide, F.array(side(x0, y0, x1, y0), side(x0, y1, x1, y1))).otherwise(F.array(side(x0, y0, x0, y1), side(x1, y0, x1, y1)))
    sides = F.when(F.col("it.kind") == "l", F.array(side(x0, y0, x1, y1))).when(F.col("it.kind") == "re", rect)
    rows = item.select("plan_id", "ord", "k", "page_height", F.posexplode(sides).alias("m", "s")).select("plan_id", "ord", "k", "m", "page_height", "s.*")
    if flip:
        rows = rows.withColumns({"y0": F.col("page_height") - F.col("y0"), "y1": F.col("page_height") - F.col("y1")})
    rows = rows.withColumn("g_len", G.length("x0", "y0", "x1", "y1")).filter("g_len > 1e-6")
    number = F.row_number().over(Window.partitionBy("plan_id").orderBy("ord", "k", "m")) - 1
    return rows.select("plan_id", number.cast("int").alias("g_ord"), F.col("x0").alias("gx0"), F.col("y0").alias("gy0"), F.col("x1").alias("gx1"), F.col("y1").alias("gy1"), "g_len")


def claim_candidates(walls: DataFrame, marks: DataFrame, perp: float = 6.0, parallel: float = 5.0) -> DataFrame:
    """plan_id, ord, length, g_ord, above, below, soft: which marks each wall (plan_id, ord, x0, y0, x1, y1,
    thickness) could claim as either side, or by its middle."""
    n = G.length("x0", "y0", "x1", "y1")
    w = walls.select("plan_id", "ord", "x0", "y0", "x1", "y1", n.alias("length"), F.greatest(F.col("thickness") / 2.0, F.lit(0.5)).alias("off"), G.angle(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("w_ang"))
    m = marks.withColumn("g_ang", G.angle(F.col("gx1") - F.col("gx0"), F.col("gy1") - F.col("gy0")))
    reach = F.col("off") + perp
    # ends may run past a mark's by a part of its length, so its box is widened; a wall that claims a mark
    # as either side, or by its middle, has its middle within the offset and the tolerance of the mark's line
    near = G.line_distance("gx0", "gy0", "gx1", "gy1", G.midpoint("x0", "x1"), G.midpoint("y0", "y1")) <= reach + 1e-9
    m = m.withColumns({"bx0": F.least("gx0", "gx1") - 0.06 * F.col("g_len"), "by0": F.least("gy0", "gy1") - 0.06 * F.col("g_len"), "bx1": F.greatest("gx0", "gx1") + 0.06 * F.col("g_len"), "by1": F.greatest("gy0", "gy1") + 0.06 * F.col("g_len")})
    pairs = near_join(w, m, tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(c) for c in ("bx0", "by0", "bx1", "by1")), 0.0, 256.0, (G.angle_difference("w_ang", "g_ang") <= parallel) & near, left_reach=reach)
    px, py = -(F.col("y1") - F.col("y0")) / F.col("length"), (F.col("x1") - F.col("x0")) / F.col("length")
    on = lambda x, y: G.on_strip(x, y, "gx0", "gy0", "gx1", "gy1", perp)

    def beside(sign: float):
        dx, dy = px * F.col("off") * sign, py * F.col("off") * sign
        return F.coalesce((F.col("length") >= 1e-9) & on(F.col("x0") + dx, F.col("y0") + dy) & on(F.col("x1") + dx, F.col("y1") + dy), F.lit(False))

    out = pairs.select("plan_id", "ord", "length", "g_ord", beside(1.0).alias("above"), beside(-1.0).alias("below"), on(G.midpoint("x0", "x1"), G.midpoint("y0", "y1")).alias("soft"))
    return out.filter("above OR below OR soft")


CLAIMS = "plan_id long, tp int, matched int, soft_tp int"


def claim(candidates: DataFrame) -> DataFrame:
    """plan_id, tp, matched, soft_tp: walls claim marks longest first; a pair needs two different free
    marks, the first that fit. What is free depends on the walls before, so a drawing is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        soft: set[int] = set()
        tp = soft_tp = 0
        pdf = pdf.sort_values(["length", "ord", "g_ord"], ascending=[False, True, True], kind="stable")
        for _, rows in pdf.groupby(["length", "ord"], sort=False):
            above = below = None
            for g, a, b in zip(rows.g_ord, rows.above, rows.below):
                if g in taken:
                    continue
                if a and above is None and g != below:
                    above = g
                if b and below is None and g != above:
                    below = g
            if above is not None and below is not None:
                tp += 1
                taken |= {above, below}
            free = next((g for g, s in zip(rows.g_ord, rows.soft) if s and g not in soft), None)
            if free is not None:
                soft_tp += 1
                soft.add(free)
        return pd.DataFrame([(pdf.plan_id.iloc[0], tp, len(taken), soft_tp)], columns=["plan_id", "tp", "matched", "soft_tp"])

    return candidates.groupBy("plan_id").applyInPandas(run, CLAIMS)


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def wall_scores(claims: DataFrame, walls: DataFrame, marks: DataFrame) -> DataFrame:
    """Per drawing: strict and soft precision, recall and F1, rounded; a marked wall is two lines."""
    n = walls.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_pred"))
    g = marks.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_marks"))
    rows = n.join(g, "plan_id", "full").join(claims, "plan_id", "left").na.fill(0)
    rows = rows.withColumn("n_true", F.floor(F.col("n_marks") / 2))
    rows = rows.withColumns({"p": X.safe_ratio("tp", "n_pred"), "r": X.safe_ratio("tp", "n_true"), "cov": X.safe_ratio("matched", "n_marks"), "sp": X.safe_ratio("soft_tp", "n_pred"), "sr": X.safe_ratio("soft_tp", "n_true")})
    three = lambda c: F.bround(c, 3)
    return rows.select(
        "plan_id", "n_pred", "n_marks", "n_true", F.col("tp").cast("long").alias("tp"), (F.col("n_pred") - F.col("tp")).cast("long").alias("fp"), F.greatest(F.lit(0), F.col("n_true") - F.col("tp")).cast("long").alias("fn"),
        three(F.col("p")).alias("precision"), three(F.col("r")).alias("recall"), three(F.col("cov")).alias("coverage"), three(_f1(F.col("p"), F.col("r"))).alias("f1"),
        F.col("soft_tp").cast("long").alias("soft_tp"), three(F.col("sp")).alias("soft_precision"), three(F.col("sr")).alias("soft_recall_walls"), three(F.col("sr")).alias("soft_recall_segments"), three(_f1(F.col("sp"), F.col("sr"))).alias("soft_f1"),
    )


def macro_average(scores: DataFrame, columns=("precision", "recall", "f1", "soft_precision", "soft_recall_walls", "soft_f1")) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n_plans"), *[F.bround(F.avg(c), 3).alias(f"mean_{c}") for c in columns])


def match_by_id(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of segments by id where half of the smaller side is shared: plan_id, segment_id, pred_role,
    truth_role (null where unmatched). Drawings that share fewer ids give no rows."""
    p, t = pred.select("plan_id", "segment_id", F.col("role").alias("pred_role")), truth.select("plan_id", "segment_id", F.col("role").alias("truth_role"))
    both = p.join(t, ["plan_id", "segment_id"], "full")
    plan = Window.partitionBy("plan_id")
    n = lambda c: F.count(F.when(c, 1)).over(plan)
    has_p, has_t = F.col("pred_role").isNotNull(), F.col("truth_role").isNotNull()
    enough = n(has_p & has_t) >= F.greatest(F.lit(1), F.floor(F.least(n(has_p), n(has_t)) / 2))
    return both.withColumn("__ok", enough).filter("__ok").drop("__ok")


def match_nearest(pred: DataFrame, truth: DataFrame, reach: float) -> DataFrame:
    """plan_id, p_ord, t_ord: predictions in order each take the nearest free truth, closer than ``reach``;
    (plan_id, ord, x0, y0, x1, y1). Nulls where one side stays alone."""
    mid = lambda df, o, a, b: df.select("plan_id", F.col("ord").alias(o), G.midpoint("x0", "x1").alias(a), G.midpoint("y0", "y1").alias(b))
    p, t = mid(pred, "p_ord", "px", "py"), mid(truth, "t_ord", "tx", "ty")
    d = G.length("px", "py", "tx", "ty")
    pairs = near_join(p, t, tuple(F.col(c) for c in ("px", "py", "px", "py")), tuple(F.col(c) for c in ("tx", "ty", "tx", "ty")), reach, 4 * max(reach, 1.0), d < reach).select("plan_id", "p_ord", "t_ord", d.alias("d"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        for p_ord, rows in pdf.sort_values(["p_ord", "d", "t_ord"], kind="stable").groupby("p_ord", sort=True):
            t_ord = next((t for t in rows.t_ord if t not in used), None)
            if t_ord is not None:
                used.add(t_ord)
                out.append((pdf.plan_id.iloc[0], p_ord, t_ord))
        return pd.DataFrame(out, columns=["plan_id", "p_ord", "t_ord"])

    made = pairs.groupBy("plan_id").applyInPandas(run, "plan_id long, p_ord int, t_ord int")
    out = p.select("plan_id", "p_ord").join(made, ["plan_id", "p_ord"], "left")
    alone = t.select("plan_id", "t_ord").join(made, ["plan_id", "t_ord"], "left_anti").select("plan_id", F.lit(None).cast("int").alias("p_ord"), "t_ord")
    return out.unionByName(alone)


def confusion(pairs: DataFrame) -> DataFrame:
    """truth_role, and a count for each predicted role: all classes and the unmatched, in both directions."""
    names = [*ROLES, UNMATCHED]
    rows = pairs.select(F.coalesce("truth_role", F.lit(UNMATCHED)).alias("truth_role"), F.coalesce("pred_role", F.lit(UNMATCHED)).alias("pred_role"))
    made = rows.groupBy("truth_role").pivot("pred_role", names).count()
    every = rows.sparkSession.createDataFrame([(n,) for n in names], "truth_role string")
    return every.join(F.broadcast(made), "truth_role", "left").na.fill(0)  # made has a row for each class


def class_scores(pairs: DataFrame) -> DataFrame:
    """role, tp, fp, fn, precision, recall, f1; unmatched predictions are false positives, unmatched truths
    false negatives."""
    r = pairs.select(F.coalesce("truth_role", F.lit(UNMATCHED)).alias("t"), F.coalesce("pred_role", F.lit(UNMATCHED)).alias("p"))
    both = r.select(F.col("t").alias("role"), F.when(F.col("t") == F.col("p"), 1).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("t") != F.col("p"), 1).otherwise(0).alias("fn"))
    both = both.union(r.filter("t <> p").select("p", F.lit(0), F.lit(1), F.lit(0)))
    s = both.groupBy("role").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).filter(F.col("role") != UNMATCHED)
    p, q = X.safe_ratio("tp", F.col("tp") + F.col("fp")), X.safe_ratio("tp", F.col("tp") + F.col("fn"))
    return s.select("role", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(_f1(p, q), 6).alias("f1"))


def overall_scores(pairs: DataFrame) -> DataFrame:
    both = F.col("pred_role").isNotNull() & F.col("truth_role").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    return pairs.agg(F.round(X.safe_ratio(n(both & (F.col("pred_role") == F.col("truth_role"))), n(both)), 6).alias("accuracy"), n(both).alias("matched_total"), n(F.col("truth_role").isNull()).alias("unmatched_predictions"), n(F.col("pred_role").isNull()).alias("unmatched_truth"))


def failures(pairs: DataFrame, examples: int = 5) -> DataFrame:
    """truth_role, pred_role, count, examples: misclassified matched pairs, most frequent first."""
    rows = pairs.filter("truth_role <> pred_role").groupBy("truth_role", "pred_role").agg(F.count(F.lit(1)).alias("count"), F.slice(F.array_sort(F.collect_list(F.struct("plan_id", "segment_id"))), 1, examples).alias("examples"))
    return rows.orderBy(F.desc("count"), "truth_role", "pred_role")


def room_detection(rooms: DataFrame, labels: DataFrame, missed: DataFrame) -> DataFrame:
    """Per drawing: tp, fp, fn, precision, recall of detected rooms."""
    known = labels.filter("room_id IS NOT NULL AND correct_type IS NOT NULL").select("plan_id", "room_id", "correct_type")
    hit = rooms.select("plan_id", "room_id").join(known, ["plan_id", "room_id"]).groupBy("plan_id").agg(F.count(F.when(F.col("correct_type") != WRONG, 1)).alias("tp"), F.count(F.when(F.col("correct_type") == WRONG, 1)).alias("fp"))
    fn = missed.groupBy("plan_id").agg(F.count(F.lit(1)).alias("fn"))
    rows = hit.join(fn, "plan_id", "full").na.fill(0)
    return rows.select("plan_id", "tp", "fp", "fn", F.bround(X.safe_ratio("tp", F.col("tp") + F.col("fp")), 3).alias("precision"), F.bround(X.safe_ratio("tp", F.col("tp") + F.col("fn")), 3).alias("recall"))


def room_type_accuracy(rooms: DataFrame, labels: DataFrame) -> DataFrame:
    """Per drawing: correct, total, accuracy, mismatches over labelled real rooms; no type is unknown."""
    real = labels.filter(F.col("room_id").isNotNull() & ~F.col("correct_type").isin(WRONG, TODO)).select("plan_id", "room_id", "correct_type")
    got = rooms.select("plan_id", "room_id", F.col("room_type").alias("detected"))
    rows = real.join(got, ["plan_id", "room_id"], "left").withColumn("detected", F.coalesce(F.nullif("detected", F.lit("")), F.lit("unknown")))
    ok = F.col("detected") == F.col("correct_type")
    out = rows.groupBy("plan_id").agg(F.count(F.when(ok, 1)).alias("correct"), F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.when(~ok, F.struct("room_id", "detected", "correct_type")))).alias("mismatches"))
    return out.select("plan_id", "correct", "total", F.bround(X.safe_ratio("correct", "total"), 3).alias("accuracy"), "mismatches")


def sheet_scores(xrefs: DataFrame, valid: DataFrame, missed: DataFrame) -> DataFrame:
    """Per drawing, on sets: detected targets (of the cross-references), valid and missed ones (plan_id,
    target_sheet); valid targets that were not detected do not count."""
    d = xrefs.filter(F.coalesce("target_sheet", F.lit("")) != "").select("plan_id", "target_sheet").distinct()
    v = valid.select("plan_id", "target_sheet").distinct().withColumn("ok", F.lit(True))
    hit = d.join(v, ["plan_id", "target_sheet"], "left").groupBy("plan_id").agg(F.count("ok").alias("tp"), F.count(F.when(F.col("ok").isNull(), 1)).alias("fp"), F.slice(F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.col("target_sheet")))), 1, 10).alias("noise"))
    m = missed.select("plan_id", "target_sheet").distinct().groupBy("plan_id").agg(F.count(F.lit(1)).alias("fn"))
    rows = hit.join(m, "plan_id", "full").na.fill(0)
    return rows.select("plan_id", "tp", "fp", "fn", F.bround(X.safe_ratio("tp", F.col("tp") + F.col("fp")), 3).alias("precision"), F.bround(X.safe_ratio("tp", F.col("tp") + F.col("fn")), 3).alias("recall"), "noise")


def enriched_references(xrefs: DataFrame, regions: DataFrame) -> DataFrame:
    r = regions.select("plan_id", F.col("text_region_id").alias("source_text_region_id"), F.col("text").alias("source_text"), F.col("classification").alias("source_classification"))
    return xrefs.join(r, ["plan_id", "source_text_region_id"], "left").select("plan_id", "ord", "k", "target_sheet", "target_detail", "source_text", "source_classification", X.target_category("target_sheet").alias("category"))


def plan_references(enriched: DataFrame) -> DataFrame:
    """plan_id, total_xrefs, unique_targets, and distinct targets by category."""
    kinds = ("plausible_sheet_id", "fixture_callout_misclassified", "grid_or_short_tag", "other")
    return enriched.groupBy("plan_id").agg(F.count(F.lit(1)).alias("total_xrefs"), F.count_distinct("target_sheet").alias("unique_targets"), *[F.count_distinct(F.when(F.col("category") == k, F.col("target_sheet"))).alias(k) for k in kinds])


def target_counts(enriched: DataFrame) -> DataFrame:
    """target_sheet, category, n_xrefs, n_plans over the corpus."""
    return enriched.filter(F.coalesce("target_sheet", F.lit("")) != "").groupBy("target_sheet", "category").agg(F.count(F.lit(1)).alias("n_xrefs"), F.count_distinct("plan_id").alias("n_plans"))


def shared_targets(enriched: DataFrame, most: int = 20) -> DataFrame:
    return target_counts(enriched).filter("n_plans > 1").orderBy(F.desc("n_plans"), "target_sheet").limit(most)


def corpus_references(enriched: DataFrame) -> DataFrame:
    """One row: plans with references, references, different targets, share of plausible sheet names."""
    total = F.count(F.lit(1))
    plausible = F.count(F.when(F.col("category") == "plausible_sheet_id", 1))
    return enriched.agg(F.count_distinct("plan_id").alias("n_plans"), total.alias("total_xrefs"), F.count_distinct("target_sheet").alias("unique_targets"), F.bround(X.safe_ratio(plausible, total), 3).alias("plausible_sheet_precision"))


def document_summary(docs: DataFrame) -> DataFrame:
    """Per drawing: numbers of entities, counts by role, room type and text class, thickness and length
    statistics (exact medians; null where there are no walls)."""
    counts = lambda name, key: F.map_from_entries(F.array_sort(F.transform(F.array_distinct(F.transform(name, key)), lambda k: F.struct(k.alias("k"), F.size(F.filter(name, lambda e: key(e) == k)).cast("long").alias("n")))))
    role = lambda e: F.coalesce(e["semantic"]["functional_role"], F.lit("unknown"))
    room = lambda e: F.coalesce(e["room_type"], F.lit("unknown"))
    cls = lambda e: F.coalesce(e["classification"], F.lit("unknown"))
    thick = F.array_sort(F.transform("walls", lambda w: w["geometry"]["thickness"]))
    size = F.array_sort(F.transform("walls", lambda w: w["geometry"]["centerline_length"]))
    return docs.select(
        "plan_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("walls", "junctions", "rooms", "openings", "text_regions", "grid_lines", "cross_references")],
        counts("walls", role).alias("role_counts"), counts("rooms", room).alias("room_type_counts"), counts("text_regions", cls).alias("text_class_counts"),
        F.array_min(thick).alias("thickness_min"), median(thick).alias("thickness_median"), F.array_max(thick).alias("thickness_max"), median(size).alias("length_median"),
    )


def median(ordered):
    """Of a sorted array: the middle, or the mean of the two middle ones; null if it is empty."""
    n = F.size(ordered)
    at = lambda k: F.get(ordered, k.cast("int"))
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, at(F.floor(n / 2))).otherwise(0.5 * (at(F.floor(n / 2) - 1) + at(F.floor(n / 2))))


def coverage(summary: DataFrame) -> DataFrame:
    """One row: the share of drawings with at least one entity of each kind."""
    names = [c for c in summary.columns if c.startswith("n_")]
    return summary.agg(*[F.round(F.avg((F.col(c) > 0).cast("double")), 6).alias(f"share_{c[2:]}") for c in names])


def latest_version(files: DataFrame) -> DataFrame:
    """stem, file: of files (stem, file) of a stem the one with the highest ``_vN``; ties go to the first
    name."""
    name = F.regexp_replace("file", r"\.[^.]*$", "")
    return files.groupBy("stem").agg(F.min_by("file", F.struct((-X.version_number(name)).alias("v"), F.col("file").alias("f"))).alias("file"))


def plan_marks(plans: DataFrame, files: DataFrame) -> DataFrame:
    """plan, file: the latest marks file whose name begins with the plan's stem."""
    p = plans.select("plan", F.regexp_replace("plan", r"\.[^.]*$", "").alias("stem"))
    f = files.select("file", F.regexp_replace("file", r"(_v\d+)?\.[^.]*$", "").alias("stem"))
    found = latest_version(f)
    return p.join(found, "stem", "left").select("plan", "file")


def mark_statistics(rows: DataFrame) -> DataFrame:
    """Per drawing, from rows (plan_id, is_wall 0/1): rows, wall rows, estimated walls."""
    return rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("is_wall") == 1, 1)).alias("n_wall_rows")).withColumn("estimated_walls", F.floor(F.col("n_wall_rows") / 2))


def detection_rate(summary: DataFrame, marks: DataFrame) -> DataFrame:
    rows = summary.join(marks, "plan_id")
    return rows.select("plan_id", "n_walls", "estimated_walls", F.bround(F.col("n_walls") / F.greatest("estimated_walls", F.lit(1)), 3).alias("detection_rate"))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy(X.status_bucket("status").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def isclose(a: float, b: float) -> bool:
    return math.isclose(a, b, abs_tol=1e-6)
