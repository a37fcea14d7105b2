"""Sinks: failed and repeated tasks leave no partial file and nothing behind."""

import json

import pytest
from pyspark.sql import functions as F

from kgloom.sources import files, sinks


def test_array_and_records(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("é"), "id").alias("x")).repartition(7)
    files.write_json_array(df, files.url(str(tmp_path / "a" / "out.json")), ["id"])
    assert json.loads((tmp_path / "a" / "out.json").read_text()) == [{"id": i, "x": f"é{i}"} for i in range(1000)] and len(list((tmp_path / "a").iterdir())) <= 2
    files.write_json_array(df.where("false"), files.url(str(tmp_path / "a" / "out.json")), ["id"])  # replaces
    assert json.loads((tmp_path / "a" / "out.json").read_text()) == []
    records = df.select(F.concat(F.lit("f"), F.col("id") % 3).alias("folder"), F.concat("id", F.lit(".txt")).alias("name"), F.col("x").cast("binary").alias("body"))
    sinks.write_records(records, files.url(str(tmp_path / "r")))
    found = {p.name: p.read_text() for p in (tmp_path / "r").glob("f*/*.txt")}
    assert found == {f"{i}.txt": f"é{i}" for i in range(1000)} and (tmp_path / "r" / "_SUCCESS").read_text() == "1000\n" and not (tmp_path / "r" / sinks.ATTEMPTS).exists()
    sinks.write_records(records, files.url(str(tmp_path / "r")))  # again: the same files
    assert {p.name: p.read_text() for p in (tmp_path / "r").glob("f*/*.txt")} == found


def test_a_task_that_fails_halfway(spark, tmp_path):
    broken = F.when(F.col("id") == 700, F.raise_error(F.lit("halfway")).cast("string")).otherwise(F.concat(F.lit("x"), "id"))
    rows = spark.range(0, 1000, 1, 1).select(F.lit("f").alias("folder"), F.concat("id", F.lit(".txt")).alias("name"), broken.alias("body"))
    with pytest.raises(Exception, match="halfway"):
        sinks.write_records(rows, files.url(str(tmp_path / "r")))
    with pytest.raises(Exception, match="halfway"):
        sinks.write_json_array(rows.select("body"), files.url(str(tmp_path / "a.json")))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_a_repeated_task(tmp_path):
    """Two attempts of one task, the first without its end: the committed one counts."""
    path = files.url(str(tmp_path / "a.json"))
    writer = sinks._ArrayWriter(path)
    writer.write(iter([("1",)]))
    second = writer.write(iter([("1",), ("2",)]))
    writer.commit([second, None])
    assert json.loads((tmp_path / "a.json").read_text()) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["a.json"]
    with pytest.raises(ValueError, match="one partition"):
        writer.commit([writer.write(iter([("1",)])), writer.write(iter([("2",)]))])
    writer = sinks._RecordWriter(files.url(str(tmp_path / "r")))

    def rows(stop):
        yield from (("f", f"{i}", "whole") for i in range(3))
        if stop:
            raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(rows(True))
    assert not list((tmp_path / "r").glob("f/*"))
    messages = [writer.write(rows(False)), writer.write(rows(False))]
    writer.commit(messages[1:])
    assert [p.read_text() for p in sorted((tmp_path / "r" / "f").iterdir())] == ["whole"] * 3 and not (tmp_path / "r" / sinks.ATTEMPTS).exists()
