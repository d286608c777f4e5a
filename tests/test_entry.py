import pytest


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_registry(entry):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60 or not any(x.startswith("p1_") for x in q)


def test_flagship(spark, entry):
    assert entry.entry(spark).count() > 0


NAMES = ["dedup_first", "interval_merge", "enclosing_function", "trace_first_match", "evaluation_by_class"]


@pytest.mark.parametrize("name", NAMES)
def test_results_do_not_depend_on_partitions(spark, entry, name):
    d = "/root/testdata/sf0.001"
    q = entry.queries()[name]
    a = sorted(map(str, q(spark, d).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(str, q(spark, d).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
