import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, blanks, ties, repeated rows, a long text and columns that clash with the operators' own."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [None, "", "  \t\n ", "one", "One two", "a b c d e f g", "a b c d e f g", "été Straße ǅ", long, long + " end", "x" * 5000]
    rows = [(i, t, "en", "src", 1, "h", "k") for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", None, None, None, None, None), (3, "one", "en", "src", 1, "h", "k"), (3, "another text", "en", "s", 1, "h", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, term string, bucket string")
