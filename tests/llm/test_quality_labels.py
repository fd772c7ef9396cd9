"""The quality filter without rows to learn from."""

import pytest

from lectern.llm import quality
from lectern.llm.common import fold


@pytest.mark.parametrize("kind", ["none", "null", "held out"])
def test_filter_keeps_all_without_usable_labels(spark, kind):
    docs = spark.createDataFrame([(i, f"a plain sentence number {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    labels = {"none": labels.limit(0), "null": labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality"), "held out": labels.filter(fold(labels["doc_id"], 4) == 2)}[kind]
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(40))
