"""Output figures are rounded as the SQL rounds them, also where six digits end in a tie."""

import duckdb

from affect_engine.plans.q_evaluation import r6


def test_ties_as_in_sql(spark):
    sizes = (128, 640, 3200, 16000)
    values = [sign * k / n for n in sizes for k in range(1, n) for sign in (1, -1)]
    got = r6(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), "v").orderBy("i").collect()
    want = duckdb.connect().execute("SELECT list_transform(?::DOUBLE[], lambda v : round(v, 6))", [values]).fetchone()[0]
    assert [r.v for r in got] == want
    assert 0.520312 in want  # 333/640, 0.520313 by its decimal digits


def test_other_types_and_nulls_stay(spark):
    rows = r6(spark.createDataFrame([(None, 3, 0.1234567)], "a double, n int, kept double"), "a", "n")
    assert rows.dtypes == [("a", "double"), ("n", "int"), ("kept", "double")]
    assert rows.collect() == [(None, 3, 0.1234567)]
