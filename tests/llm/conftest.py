import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank string, score string, block string, position string, key string, path string, rep string, length string, toxic string"
LONG = "lorem ipsum dolor sit amet " * 4000
NASTY = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (4, "one", "en", None, 3),
    (5, "one two three four five six seven eight nine ten", "en", "a", 48),
    (5, "one two three four five six seven eight nine ten", "en", "a", 48),
    (6, "one two three four five six seven eight nine ten", None, "b", 48),
    (None, "one two three four five six seven eight nine ten", "en", "b", 48),
    (None, None, None, None, None),
    (7, LONG, "fr", "b", len(LONG)),
    (8, "mail me at ann@example.org or call +1 (202) 555-0143, ip 10.0.0.256 or 10.0.0.25", "en", "c", 80),
    (9, "12345 !!! ???", "xx", "c", 13),
    (10, "élève naïve 日本語 🎉 ünïcödé", "fr", "c", 27),
]


@pytest.fixture
def nasty(spark):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in NASTY], DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")


@pytest.fixture(scope="session", autouse=True)
def written_tables(spark):
    """The tests' intermediate tables go when all are done."""
    from tracewell.llm.store import delete_all_written

    yield
    delete_all_written(spark)
