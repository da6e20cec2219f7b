"""Rows without a doc_id are selected by the budget of their leaf."""

from keystrata.llm import mixing


def test_null_ids_are_selected(spark):
    rows = [(None, "a b c", "en", "s1"), (None, "d e", "de", None), (1, "f g", "en", "s1"), (2, "h", None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.select_documents(docs, share=1.0, max_epochs=1)
    assert got.columns == docs.columns
    assert sorted(got.collect(), key=str) == sorted(docs.collect(), key=str)
    assert mixing.select_documents(docs, share=0.0, max_epochs=1).count() == 0
