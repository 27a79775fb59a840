"""Profiles of tables: one aggregation over all columns, then one row for each column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


def label(kind: Ty.DataType) -> str:
    """integer, decimal, boolean, datetime or text."""
    if isinstance(kind, Ty.BooleanType):
        return "boolean"
    if isinstance(kind, Ty.IntegralType):
        return "integer"
    if isinstance(kind, Ty.NumericType):
        return "decimal"
    return "datetime" if isinstance(kind, Ty.TimestampType | Ty.TimestampNTZType | Ty.DateType) else "text"


def _stacked(row: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}|{f}`").cast(t).alias(f) for f, t in fields.items()]) for c in names]))
    return row.select(one.alias("x")).select("x.*")


def numeric(df: DataFrame) -> DataFrame:
    """column_name, min_value, max_value, mean_value, sum_value of each numeric column, in one pass."""
    names = [f.name for f in df.schema if isinstance(f.dataType, Ty.NumericType)]
    made = [fn(F.col(f"`{c}`").cast("double")).alias(f"{c}|{k}") for c in names for k, fn in (("min_value", F.min), ("max_value", F.max), ("mean_value", F.avg), ("sum_value", F.sum))]
    return _stacked(df.agg(*made), names, dict.fromkeys(("min_value", "max_value", "mean_value", "sum_value"), "double"))


def cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, type_label, n_distinct, n_null, n_rows of each column.

    Distinct counts go over one (column, value) table, aggregated before the shuffle, not over one Expand a column.
    """
    names = columns or df.columns
    kinds = {f.name: label(f.dataType) for f in df.schema}
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in names]))
    counts = df.select(cell.alias("x")).groupBy("x.c", "x.v").agg(F.count("*").alias("n"))
    out = counts.groupBy("c").agg(F.count("v").alias("n_distinct"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.sum("n").alias("n_rows"))
    types = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(kinds[c]))])
    return out.select(F.col("c").alias("column_name"), F.element_at(types, F.col("c")).alias("type_label"), "n_distinct", "n_null", "n_rows")


def first_values(df: DataFrame, order: list[str], columns: list[str], most: int = 5) -> DataFrame:
    """column_name, sample_values: the first distinct values in row order, comma-joined."""
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])  # the least of a plain column is found by hashing
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))
    first = df.select(key.alias("k"), cell.alias("x")).where("x.v IS NOT NULL").groupBy("x.c", "x.v").agg(F.min("k").alias("k"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("c").orderBy("k", "v")
    few = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return few.groupBy(F.col("c").alias("column_name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]), ",").alias("sample_values"))


def text_kinds(df: DataFrame, order: list[str], columns: list[str], sample: int = 10) -> DataFrame:
    """column_name, looks_like (date_string, currency or text) by the first non-null values of each column."""
    parts = []
    for c in columns:
        s = df.where(F.col(c).isNotNull()).orderBy(*order).limit(sample).select(F.col(c).cast("string").alias("v"))
        date = F.bool_and(F.coalesce(F.try_to_timestamp("v"), F.try_to_timestamp("v", F.lit("M/d/yyyy"))).isNotNull())
        kind = F.when(F.count("*") == 0, "text").when(date, "date_string").when(F.bool_or(F.col("v").rlike("[$€£¥₹]")), "currency").otherwise("text")
        parts.append(s.agg(kind.alias("looks_like")).select(F.lit(c).alias("column_name"), "looks_like"))
    return reduce(DataFrame.unionByName, parts)


def describe_text(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One row: a table described in words, a line for each column.

    Rows are dealt over all shuffle partitions first, so that what a task holds of columns that are nearly unique (each row
    gives it a key for each column) is its share of the table, whatever files the table lies in. Values are looked for only
    in columns of text, where they are shown.
    """
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    shown = [f.name for f in df.schema if label(f.dataType) == "text"]
    numbers = numeric(df).select("column_name", F.format_string("range %,.2f to %,.2f, mean %,.2f", "min_value", "max_value", "mean_value").alias("d"))
    lines = cardinality(df).join(numbers, "column_name", "left")
    lines = lines.join(first_values(df, order, shown), "column_name", "left") if shown else lines.withColumn("sample_values", F.lit(None).cast("string"))
    few = F.when((F.col("n_distinct") <= 10) & (F.col("type_label") == "text"), F.concat(F.lit(", values "), "sample_values")).otherwise("")
    line = F.concat(F.lit("- "), "column_name", F.lit(" ("), "type_label", F.lit("): "), F.coalesce("d", F.concat(F.col("n_distinct").cast("string"), F.lit(" distinct"))), few, F.when(F.col("n_null") > 0, F.concat(F.lit(", "), F.col("n_null").cast("string"), F.lit(" missing"))).otherwise(""))
    places = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at(places, F.col("column_name")).alias("i"), line.alias("l")))), lambda x: x["l"]), "\n")
    return lines.groupBy().agg(F.concat(F.lit(f"Table {name}: "), F.max("n_rows").cast("string"), F.lit(" rows\n"), body).alias("description"))
