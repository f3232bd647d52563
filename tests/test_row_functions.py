"""Functions of a row: a default for each failing cell, order, types, clashing names."""

import math

import pytest
from pyspark.sql import functions as F

from tracetide.plans import runs


def test_each_failing_cell_takes_its_own_default(spark):
    index = spark.createDataFrame([("a", 2), ("b", 0), ("c", None), (None, 4)], "path string, n long")
    table = (runs.RunTable(index)
             .add_function("inverse", runs.FLOAT, lambda i, row: 1 / i["n"])
             .add_function("name", runs.STRING, lambda i, row: i["path"].upper())
             .add_function("later", runs.STRING, lambda i, row: str(row["last"]) + row["name"])
             .add_function("text", runs.FLOAT, lambda i, row: i["path"], default=-1.0)
             .add_function("last", runs.FLOAT, lambda i, row: i["n"]))
    rows = {r["name"]: r for r in table.build(errors="why").collect()}
    assert rows["A"]["inverse"] == 0.5 and math.isnan(rows["B"]["inverse"]) and math.isnan(rows["C"]["inverse"])
    assert rows["(NULL)"]["inverse"] == 0.25 and rows["(NULL)"]["later"] == "nan(NULL)"
    assert [rows[k]["text"] for k in rows] == [-1.0] * 4
    assert rows["A"]["last"] == 2.0 and math.isnan(rows["C"]["last"])
    assert [m.split(":")[:2] for m in rows["B"]["why"]] == [["inverse", " ZeroDivisionError"], ["text", " ValueError"]]
    assert table.build().columns == ["inverse", "name", "later", "text", "last"]


def test_functions_and_builders_read_each_other(spark):
    index = spark.range(1000).select(F.concat(F.lit("p"), F.col("id")).alias("path"), (F.col("id") % 10).alias("k"))
    table = (runs.RunTable(index)
             .add_column("k", runs.FLOAT, lambda d: F.col("k") * 2)
             .add_function("path", runs.STRING, lambda i, row: f"{i['path']}/{i['k']}/{row['k']}")
             .add_column("size", runs.FLOAT, lambda d: F.length("path"))
             .add_column("bad", runs.FLOAT, lambda d: F.lit("x"), default=7.0)
             .add_function("sum", runs.FLOAT, lambda i, row: row["size"] + row["bad"] + i["k"]))
    rows = table.build().collect()
    assert len(rows) == 1000
    for r in rows:
        path, k, k2 = r["path"].split("/")
        assert float(k2) == 2 * int(k) == r["k"] and int(path[1:]) % 10 == int(k)
        assert r["size"] == len(r["path"]) and r["sum"] == r["size"] + 7.0 + int(k)


def test_neighbouring_functions_are_one_pass(spark):
    table = runs.RunTable(spark.range(10))
    for n in range(5):
        table.add_function(f"f{n}", runs.FLOAT, lambda i, row: i["id"])
    text = table.build()._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "Exchange" not in text


def test_empty_table_types_and_names(spark):
    index = spark.createDataFrame([], "path string, at timestamp, more struct<a:int,b:array<double>>")
    table = runs.RunTable(index).add_function("a", runs.FLOAT, lambda i, row: 1).add_function("b", runs.STRING, lambda i, row: 1)
    assert [f.dataType.simpleString() for f in table.build().schema] == ["double", "string"]
    assert table.build().count() == 0
    with pytest.raises(ValueError, match="another column"):
        table.build(errors="path")
    with pytest.raises(ValueError, match="unsupported"):
        table.add_function("c", "int", lambda i, row: 1)
    full = spark.createDataFrame([("p", None, (1, [2.0]))], index.schema)
    table = runs.RunTable(full).add_function("a", runs.FLOAT, lambda i, row: i["more"]["a"] + i["more"]["b"][0])
    assert table.build().collect()[0]["a"] == 3.0
