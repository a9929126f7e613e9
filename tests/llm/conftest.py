import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with an extra column whose name the operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", None, 5) for i, t in rows],
                                     "doc_id long, text string, part string, n_words int, id int")
    return make
