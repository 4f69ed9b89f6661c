import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder for intermediate tables, if the session names none."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text[, source[, lang]]) with clashing extra columns."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", r[3] if len(r) > 3 else None, 1, "x", 0.5)
                for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, source string, lang string, size int, node string, score double")
    return make
