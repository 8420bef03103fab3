import pytest

#: Texts that every operator must take: null, empty, blank, short, long, repeated, other scripts, odd characters.
EDGES = [None, "", "   \n\t", "word", "ein Satz mit einigen Wörtern darin", "x" * 3000, "the same text twice over here", "the same text twice over here", "日本語 テキスト", "a\x1cb\x85c\u2028d", "# 1 2 3 !!!", "long text of words " * 4000]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge texts as documents, the ids 5 and 6 repeated, with columns whose names operators use themselves."""
    rows = [(i, t, None if i % 4 == 0 else "en", "s", 1, "x", 0.5) for i, t in enumerate(EDGES)]
    rows += [rows[5], rows[6]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score double")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
