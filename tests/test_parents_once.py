"""Parents are made once, though they are counted and joined."""

from __future__ import annotations

from tidewell.operators import chunking


def test_parents_are_made_once(spark):
    docs = spark.createDataFrame([(i, "A plan has a price. " * 400) for i in range(3)], "doc_id long, text string")
    parents, children = chunking.parent_child(docs)
    plan = children.join(parents.select("parent_id"), "parent_id", "left")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {x.parent_id for x in children.collect()} == {x.parent_id for x in parents.collect()}
