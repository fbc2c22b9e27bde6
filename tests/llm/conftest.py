import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """A checkpoint folder for written tables; set once, as a cluster does."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows that are odd in every way: null ids and texts, empty and blank texts, one long text, repeated rows,
    repeated ids with other texts, and columns whose names operators use inside."""
    long_text = "alpha beta gamma delta " * 60_000 + "the end"
    rows = [
        (1, "one two three four five six", "en", "a", 5), (2, "one two three four five six", "en", "a", 5), (3, None, "en", "a", 0),
        (4, "", None, None, 0), (5, " \n\t ", "en", "b", 4), (6, long_text, "en", "b", len(long_text)), (7, "x", "en", None, 1),
        (7, "x", "en", None, 1), (7, "another text under the same id", "en", "b", None), (None, "no id here", "fr", "c", 10),
        (None, None, None, None, None), (9, "naïve café 漢字 🙂 password=hunter2hunter2", "fr", "c", 40),
    ]
    rows = [(*r, "k", 1, 2.0, "f", 0, None) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, "
                                       "n int, score double, fingerprint string, nth int, __id string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
