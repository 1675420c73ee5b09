import pytest

DOC = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents-like table, with columns whose names an operator might want, from (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, f"x{k}", 7, "a", "b", 1, "c", 2.0) for k, (i, t) in enumerate(rows)], DOC + ", fp string, ids long, _id string, _own string, quality int, _stay string, batch double")

    return make


#: Nulls in both columns, empty and blank texts, a repeated row, ties, a long text, control and wide characters.
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (4, "one two three"), (None, "no id here at all"), (None, None), (5, "the quick brown fox " * 3000), (6, "日本語 and 😀 \x00 \x85 é"), (7, "one two three"), (8, "<|endoftext|> </s> don't")]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)
