"""Tables that grow with the corpus do not pass through the driver."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidefuse.llm import components, jaccard  # noqa: E402


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_the_jaccard_operator_send_nothing_through_the_driver(spark):
    """Small tables too: a written table below the limit for broadcasts can be many times that in the driver's memory."""
    pairs = spark.createDataFrame([(1, 2, 4, 4), (2, 3, 4, 4), (3, 4, 4, 4)], "a long, b long, size_a int, size_b int").coalesce(1)
    parts = spark.createDataFrame([(n, f, [10 * f + n // 4]) for n in (1, 2, 3, 4) for f in range(4)],
                                  "node long, fragment int, shingles array<long>")
    found = jaccard.linked(pairs, parts)
    assert sorted(map(tuple, found.collect())) == [(1, 2), (2, 3)] and "Broadcast" not in plan_text(found)
    roots = components.connected(found)
    assert len({r.root for r in roots.collect()}) == 1 and roots.count() == 3 and "Broadcast" not in plan_text(roots)
    nodes = jaccard.component_of(pairs.selectExpr("b AS node"), roots)
    assert "Broadcast" not in plan_text(nodes)
    assert {r.node: r.root == r.node for r in nodes.collect()}[4]
    text = "the quick brown fox jumps over the lazy dog and goes on its way"
    rows = [(1, text), (2, text + " home"), (3, text), (4, "other words here"), (5, None), (None, "")]
    whole = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Broadcast" not in plan_text(whole)
    got = {(r.doc_id, r.component_id) for r in whole.collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, None)}
