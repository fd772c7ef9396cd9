"""Benchmark items without an id."""

from lectern.llm import decontam


def test_items_without_an_id_are_searched(spark):
    held, other = "seven grey herons stood along the frozen canal at dawn", "a second passage whose item has a number of its own"
    docs = spark.createDataFrame([(1, f"Before. {held}! After."), (2, "nothing of that kind"), (3, other), (4, f"{held} {other}")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, held), (None, None), (7, other)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(docs, bench).collect()} == {(1, None, 0), (3, 7, 0), (4, None, 0), (4, 7, 0)}
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [2]
