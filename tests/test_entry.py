import __spark_entry__


def test_entry_gives_rows(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"frac_num", "time_chunk", "n", "sum_value", "min_value"}


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
