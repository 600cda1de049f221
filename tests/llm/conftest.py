import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    rows = [(i, t, la, s, len(t or ""), "k", "l") for i, (t, la, s) in enumerate([("", "en", "a"), (None, "en", "a"), ("   \n\t ", None, "b"), ("one", "en", None), ("one two three four", "en", "a"), (long, "en", "a"), ("é ß 日本 \U0001f600 a\x0bb", "de", "b")])]
    rows += [rows[4], rows[4], rows[0], (None, "no id here at all", None, None, None, None, None), (4, "another text of the same id", "en", "a", 3, "k", "l")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
