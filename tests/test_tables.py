"""Written tables and when they go."""

import os

from repograph.operators.tables import discard, scratch, written


def test_scratch_deletes_all_but_what_is_kept(spark):
    with scratch(spark) as keep:
        a = written(spark.range(3), "a")
        b = keep(written(a.selectExpr("id * 2 AS id"), "b"))
        with scratch(spark) as inner:
            c = inner(written(b, "c"))
            d = written(b, "d")
        assert not os.path.exists(d._table) and os.path.exists(c._table)
    assert not os.path.exists(a._table) and not os.path.exists(c._table)
    assert sorted(r.id for r in b.collect()) == [0, 2, 4]
    discard(b)
    assert not os.path.exists(b._table)
