import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns that clash with results."""
    words = [f"word{i}" for i in range(30)]
    body = " ".join(words)
    texts = [
        (1, body), (2, body), (2, body), (3, body.replace("word29", "other")), (4, None), (5, ""), (6, " \t\n"), (None, body), (None, None),
        (7, "one two"), (8, "ONE  two"), (9, "x" * 30_000), (10, "\n".join(["same line"] * 5)), (11, " ".join(words * 400)), (12, "Ünïcode 日本 <|endoftext|> </s>"),
    ]
    rows = [(i, t, None if n % 3 else "en", "src0", n, "clash", "clash") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
