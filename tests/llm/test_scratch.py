"""Tables written to the shared folder."""

import os

from qissaflow.llm.scratch import forget, written


def test_written_keeps_rows_schema_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "")], "id bigint, text string")
    back = written(df, "test")
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert back.inputFiles()


def test_written_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert written(df, "test").schema == df.schema and written(df, "test").count() == 0


def test_two_tables_of_one_name_stay_apart(spark):
    one, two = written(spark.range(3), "same"), written(spark.range(5), "same")
    assert (one.count(), two.count()) == (3, 5)


def test_forgotten_tables_are_gone(spark):
    one, two = written(spark.range(3), "one"), written(spark.range(4), "two")
    path = one.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    forget(one, spark.range(2))
    assert not os.path.exists(path) and two.count() == 4
