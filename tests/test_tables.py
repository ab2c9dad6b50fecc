import pytest

from vectorloom.functions import tables
from vectorloom.functions.chunkers import FixedSizeChunker, ParagraphChunker, SentenceChunker

TEXTS = ["one two three four five", "", None, "  a b\xa0c\x1fd \n\n e. f! g?\nh\n\n\n\n i ", "no end", "x" * 50, "A. B. C. D. E. F.\n\nG"]


@pytest.mark.parametrize(("call", "chunker"), [("chunk_words(text, 2, 1)", FixedSizeChunker(2, 1)), ("chunk_words(text)", FixedSizeChunker()), ("chunk_paragraphs(text)", ParagraphChunker()), ("chunk_sentences(text, 2)", SentenceChunker(2))])
def test_functions_of_a_text_give_the_chunkers_rows(spark, call, chunker):
    tables.register(spark)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    texts.createOrReplaceTempView("some_texts")
    got = spark.sql(f"SELECT id, pos, chunk FROM some_texts, LATERAL {call}").collect()
    told = chunker.explode(texts).select("id", "pos", "chunk").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, told))


def test_rows_of_a_table_by_partition(spark):
    tables.register(spark)
    rows = [("a", 1, "one two three"), ("a", 2, "four"), ("b", 3, "five six"), ("b", 4, None)]
    spark.createDataFrame(rows, "who string, n int, text string").createOrReplaceTempView("rows_of_two")
    got = spark.sql("SELECT * FROM chunk_rows(TABLE(rows_of_two) PARTITION BY (who) ORDER BY (n), 'words', 2, 0)")
    assert got.columns == ["who", "n", "pos", "chunk"]
    assert sorted(map(tuple, got.collect())) == [("a", 1, 0, "one two"), ("a", 1, 1, "three"), ("a", 2, 2, "four"), ("b", 3, 0, "five six")]
    for wrong in ("TABLE(SELECT who FROM rows_of_two), 'words'", "TABLE(rows_of_two), 'pages'"):
        with pytest.raises(Exception, match="chunk"):
            spark.sql(f"SELECT * FROM chunk_rows({wrong})")
