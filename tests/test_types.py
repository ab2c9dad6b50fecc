from pyspark.sql import functions as F

from vectorloom.functions.metadata import MetadataFilter, any_value_contains, preview
from vectorloom.types import DOCUMENT, documents, empty_metadata, put


def test_constructors(spark):
    texts = spark.createDataFrame([("a", 1, [1.0])], "content string, n int, v array<float>")
    fresh = documents(texts).head()
    assert len(fresh["id"]) == 36 and fresh["metadata"] == {} and fresh["embedding"] is None
    made = documents(texts, id_col="n", metadata=put(put(empty_metadata(), "k", "1"), "k", "2"), embedding="v")
    assert tuple(made.head()) == ("1", "a", {"k": "2"}, [1.0])
    assert [f.dataType for f in made.schema] == [f.dataType for f in DOCUMENT]


def test_metadata_predicates(spark):
    rows = spark.createDataFrame([({"a": "x"},), ({},), ({"a": "x", "b": "yz"},)], "m map<string,string>")
    met = lambda c: [r[0] for r in rows.select(c).collect()]
    assert met(MetadataFilter().matches(F.col("m"))) == [True, True, True]
    assert met(MetadataFilter().add("a", "x").add("b", "yz").matches(F.col("m"))) == [False, False, True]
    assert met(MetadataFilter().add("a", "x").add("a", "y").matches(F.col("m"))) == [False] * 3
    assert met(any_value_contains(F.col("m"), "")) == [True, False, True]
    assert met(any_value_contains(F.col("m"), "z")) == [False, False, True]


def test_preview_counts_characters(spark):
    rows = spark.createDataFrame([("é" * 300,), ("short",)], "t string")
    assert [r[0] for r in rows.select(preview(F.col("t"))).collect()] == ["é" * 200 + "...", "short..."]
