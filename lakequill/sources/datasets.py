"""Evaluation datasets as tables, and snapshots of an index with its conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ITEM = "id string, question string, gold_docs array<string>, gold_keywords array<string>, note string"


def items(raw: DataFrame) -> DataFrame:
    """row, the item's fields, and `broken`, from (row, raw): a JSON object each."""
    parsed = raw.select("row", "raw", F.from_json("raw", ITEM, {"mode": "PERMISSIVE"}).alias("item"), F.from_json("raw", "map<string,string>").alias("fields"))
    is_object = F.coalesce(F.trim("raw").startswith("{") & F.col("fields").isNotNull(), F.lit(False))
    return parsed.select("row", (~is_object).alias("broken"), "item.*")


def violations(checked: DataFrame) -> DataFrame:
    """(row, rule) for each rule that an item of items() breaks; a valid dataset gives no rows."""
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    ok = ~F.col("broken")
    rules: dict[str, Column] = {
        "not an object": F.col("broken"),
        "missing field": ok & (F.col("id").isNull() | F.col("question").isNull() | F.col("gold_docs").isNull()),
        "no gold documents": ok & F.coalesce(F.size("gold_docs") == 0, F.lit(False)),
        "blank gold document": ok & F.coalesce(F.exists("gold_docs", blank), F.lit(False)),
    }
    found = checked.select("row", F.explode(F.filter(F.array(*[F.when(c, name) for name, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    first = checked.where(F.col("id").isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("row")))
    return found.union(first.where("n > 1").select("row", F.lit("repeated id").alias("rule")))


def gold(checked: DataFrame) -> DataFrame:
    """(id, doc): gold documents by their last path component, once each."""
    return checked.select("id", F.explode("gold_docs").alias("path")).select("id", F.element_at(F.split("path", "/"), -1).alias("doc")).distinct()


def export(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table as Parquet under folder, then a table `meta` (name, n) of their counts, which it returns."""
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    counts = [spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in tables]
    reduce(DataFrame.union, counts).coalesce(1).write.json(f"{folder}/meta")
    return spark.read.schema("name string, n long").json(f"{folder}/meta")


def read_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an export by name, as import_snapshot takes them. A table with other rows than `meta` counts, as after
    an export that broke off, is an error."""
    meta = spark.read.schema("name string, n long").json(f"{folder}/meta").collect()  # a row for each table
    tables = {r["name"]: spark.read.parquet(f"{folder}/{r['name']}") for r in meta}
    for r in meta:
        if (n := tables[r["name"]].count()) != r["n"]:
            raise ValueError(f"{r['name']} has {n} rows, the export says {r['n']}")
    return tables
