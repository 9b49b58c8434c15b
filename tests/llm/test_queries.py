import pytest

from tests.oracle import compare, duck
from turnloom.llm import queries
from turnloom.llm.shared import cleanup, stored

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    compare(spark, SF, queries.queries()[name], queries.oracle_sql()[name], duck(SF))


def test_cleanup(spark):
    df = stored(spark.range(5), "x")
    path = df.inputFiles()[0]
    cleanup(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
