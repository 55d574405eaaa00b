"""Native operators stay in the engine."""

from draftgraph.llm import exact_dedup, quality

from .test_operators import make


def text(df):
    return df._jdf.queryExecution().toString()


def test_native(spark):
    docs = make(spark, [(1, "a b c", "s"), (2, None, None)])
    for df in (exact_dedup.exact_groups(docs), quality.quality_rules(docs), quality.apply_quality(docs)):
        assert not any(w in text(df) for w in ("Python", "Pandas", "MapInArrow"))
