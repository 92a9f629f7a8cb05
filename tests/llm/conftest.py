import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing names."""
    long = "word another third " * 20_000
    rows = [(1, None, "x"), (2, "", None), (3, "one", "y"), (4, "one two", "y"), (5, long, None), (6, long, None), (6, long, None), (None, "lost row here now", "z"), (7, "  \n\t ", ""), (8, "Ünï 漢字 𝔘 a@b.co", "w")]
    return spark.createDataFrame([(i, t, x, x) for i, t, x in rows], "doc_id long, text string, fp string, score string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, fp string, score string")


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}
