import pytest

from sugarmill.llm import registry
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, registry.queries()[name], registry.oracle_sql()[name], SF_DIR, con) is None


def test_sql_of_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.95, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [0.0, 2.0]), (9, [0.0, 1.0]), (10, [2.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect("/nowhere")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert difference(spark, registry.queries()["op5_embedding_near_dedup"], registry.oracle_sql()["op5_embedding_near_dedup"], str(tmp_path), con) is None


def test_sql_of_odd_texts(spark, tmp_path):
    texts = ["A b c d", "a B C D", "a b", "a b ", None, "", " \n", "é É x y z", "É É x y z", "one", "one two three four five six", "one two three four five six"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = connect("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(spark, registry.queries()["op9_ngram_jaccard_join"], registry.oracle_sql()["op9_ngram_jaccard_join"], str(tmp_path), con) is None
