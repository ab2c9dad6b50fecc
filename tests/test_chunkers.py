import pytest
from pyspark.sql import functions as F

from vectorloom.errors import InvalidConfig
from vectorloom.functions.chunkers import FixedSizeChunker, ParagraphChunker, SentenceChunker


def chunks(spark, chunker, text):
    return spark.createDataFrame([(text,)], "t string").select(chunker.chunks(F.col("t"))).head()[0]


@pytest.mark.parametrize(
    ("chunker", "text", "found"),
    [
        (FixedSizeChunker(3, 0), "one two three four five six seven", ["one two three", "four five six", "seven"]),
        (FixedSizeChunker(4, 2), "a b c d e f g h", ["a b c d", "c d e f", "e f g h", "g h"]),
        (FixedSizeChunker(5, 1), "", []),
        (FixedSizeChunker(5, 0), "hello", ["hello"]),
        (FixedSizeChunker(2, 0), "a b c　d\u0085e\x1cf", ["a b", "c d", "e\x1cf"]),
        (ParagraphChunker(), "One.\n\nTwo.\n\n\n\nThree.", ["One.", "Two.", "Three."]),
        (ParagraphChunker(), "", []),
        (ParagraphChunker(), " \n\n\t", []),
        (ParagraphChunker(), "a\r\n\r\nb", ["a\r\n\r\nb"]),
        (SentenceChunker(2), "First sentence. Second sentence. Third sentence. Fourth.", ["First sentence. Second sentence.", "Third sentence. Fourth."]),
        (SentenceChunker(2), "Hello! How are you? I am fine.", ["Hello! How are you?", "I am fine."]),
        (SentenceChunker(2), "Line one\nLine two\nLine three\nLine four", ["Line one Line two", "Line three Line four"]),
        (SentenceChunker(1), "3.14 ...", ["3.", "14 .", ".", "."]),
        (SentenceChunker(), "A. B. C. D. E. F. G. H. I. J.", ["A. B. C. D. E.", "F. G. H. I. J."]),
    ],
)
def test_chunks(spark, chunker, text, found):
    assert chunks(spark, chunker, text) == found


def test_default_size(spark):
    assert len(chunks(spark, FixedSizeChunker(), " ".join(["word"] * 1000))) == 3


def test_bad_sizes():
    for bad in (FixedSizeChunker(5, 10), FixedSizeChunker(0, 0)):
        with pytest.raises(InvalidConfig):
            bad.chunks(F.lit(""))
    with pytest.raises(InvalidConfig):
        SentenceChunker(0).chunks(F.lit(""))


def test_explode_keeps_columns(spark):
    rows = FixedSizeChunker(1, 0).explode(spark.createDataFrame([(1, "a b")], "id int, text string"))
    assert [tuple(r) for r in rows.select("id", "pos", "chunk").collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_texts_are_split_once(spark):
    """Time grows with a text's length, not with its square: the split stands outside of what is done for each chunk."""
    df = spark.createDataFrame([("a. " * 20_000,)], "t string")
    for chunker in (SentenceChunker(1), FixedSizeChunker(1, 0)):
        assert len(df.select(chunker.chunks(F.col("t"))).head()[0]) == 20_000
        plan = df.select(chunker.chunks(F.col("t")).alias("c"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("split(") == 1
