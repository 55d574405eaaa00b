"""The corpus pipeline, stage by stage, on planted cases."""

import random

import corpus_pipeline as P
from draftgraph.llm import quality

from .test_operators import make, none, prose  # noqa: F401


def test_stages(spark, tmp_path, none):  # noqa: F811
    rng = random.Random(12)
    passage = prose(rng, 120)
    clean = [(i, prose(rng, 300), f"s{i % 2}") for i in range(60)]
    exact = [(100 + k, clean[k][1], "s0") for k in range(5)]
    near = []
    for k in range(5, 10):
        w = clean[k][1].split()
        w[20] = "edited"
        near.append((100 + k, " ".join(w), "s1"))
    repeats = [(200 + k, prose(rng, 100) + " " + passage + " " + prose(rng, 100), "s0") for k in range(4)]
    poor = [(300, "too short", "s0"), (301, None, None), (302, "same words go round " * 60, "s1")]
    docs = make(spark, clean + exact + near + repeats + poor)  # with columns whose names clash
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        if name != "best-fit packing":
            assert out.columns == columns
            path = str(tmp_path / name.replace(" ", "-"))
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    packed = out
    ids = lambda rows: {i for i, _, _ in rows}
    assert set(kept["quality rules"]) == ids(clean + exact + near + repeats)
    assert set(kept["exact dedup"]) == ids(clean + near + repeats)
    assert set(kept["SimHash near-dedup"]) == ids(clean + repeats)
    cut = kept["suffix-array dedup"]
    assert set(cut) == ids(clean + repeats)
    assert all(cut[i] == t for i, t, _ in clean) and all(passage not in cut[i] and len(cut[i]) > 300 for i, _, _ in repeats)
    assert {r.doc_id for r in packed.collect()} == set(cut)
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_suffix_stage_reaches_short_passages(spark):
    rng = random.Random(31)
    rows = []
    for k in range(10):
        passage = prose(rng, 51 + k)
        assert len(passage) < 400
        rows += [(2 * k + j, prose(rng, 100) + " " + passage + " " + prose(rng, 100), "s") for j in range(2)]
    docs = make(spark, rows).drop("sha", "hash", "kept", "id")
    out = {r.doc_id: r.text for r in P.suffix_stage(spark, docs, "").collect()}
    assert all(190 < len(out[i].split()) <= 200 for i, _, _ in rows)


def test_frequent_lines_stay_frequent_in_a_large_host(spark):
    rng = random.Random(41)
    line = "all rights reserved by the host"
    rows = [(i, prose(rng, 40) + ("\n" + line if i < 30 else ""), "large") for i in range(400)]
    rows += [(1000 + i, prose(rng, 40) + ("\n" + line if i < 30 else ""), "small") for i in range(60)]
    rows += [(2000 + i, prose(rng, 40) + "\nheld by nine", "large") for i in range(9)]
    docs = make(spark, rows).drop("sha", "hash", "kept", "id")
    out = {r.doc_id: r.text for r in P.quality_stage(spark, docs, "").collect()}
    assert len(out) == len(rows) and not any(line in t for t in out.values())
    assert sum("held by nine" in t for t in out.values()) == 9
    hits = {r.host: (r.lines, r.documents, r.depleted) for r in quality.limit_hits(quality.quality_rules(docs)).collect()}
    assert hits == {"large": (1, 30, 0), "small": (1, 30, 0)}
