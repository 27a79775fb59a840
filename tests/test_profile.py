"""Descriptions of tables: what their tasks hold, and tables without text."""

from inkwell.operators import profile


def test_description_deals_rows_before_it_counts(spark):
    df = spark.createDataFrame([(i, f"n{i}", "ab"[i % 2], float(i)) for i in range(1, 41)], "k long, name string, kind string, price double").coalesce(1)
    made = profile.describe_text(df, "t", ["k"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # one file's rows are not one task's keys
    assert "min(struct" not in plan and "SortAggregate" not in plan
    assert made.first()[0] == (
        "Table t: 40 rows\n- k (integer): range 1.00 to 40.00, mean 20.50\n- name (text): 40 distinct\n"
        "- kind (text): 2 distinct, values b,a\n- price (decimal): range 1.00 to 40.00, mean 20.50"
    )


def test_description_without_text(spark):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "k long, price double")
    assert profile.describe_text(df, "t", ["k"]).first()[0] == "Table t: 2 rows\n- k (integer): range 1.00 to 2.00, mean 1.50\n- price (decimal): range 2.50 to 2.50, mean 2.50, 1 missing"
