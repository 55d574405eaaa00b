"""Tables of a block are removed at its end, but for those that what leaves it reads."""

import os

from draftgraph.tables import materialize, scratch, shared_dir


def paths(df):
    return {os.path.dirname(f).removeprefix("file://") for f in df.inputFiles()}


def test_scratch(spark):
    with scratch() as outer:
        with scratch() as inner:
            a, b, c = (materialize(spark.range(k), f"t{k}") for k in (3, 4, 5))
            gone = paths(c)
            both = inner(a.join(b, "id"))
        assert not any(map(os.path.exists, gone)) and both.count() == 3
        kept, dropped = paths(a), paths(b)
        one = outer(a.filter("id > 0"))
    assert one.count() == 2 and all(map(os.path.exists, kept)) and not any(map(os.path.exists, dropped))
    assert shared_dir(spark).startswith("file:")
    with scratch() as keep:
        empty = keep(materialize(spark.range(0), "none"))
    assert empty.count() == 0
