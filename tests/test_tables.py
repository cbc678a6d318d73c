"""Table functions in SQL."""

import time

import pytest

from haplomill.functions import tables
from haplomill.sources import text


def test_parse_mapping_equals_the_reader(spark):
    tables.register(spark)
    rows = [("'1:1:A:C'", 100, 0, "-1,0.5000,2.0000"), ("x;y", 200, 1, "3.7.11,10.0000,20.5000;4,0.0000,inf"), ("none", 300, 0, "NaN")]
    frame = spark.createDataFrame(rows, "variant string, pos int, flipped int, mapping string")
    frame.createOrReplaceTempView("some_mappings")
    got = spark.sql("SELECT * FROM parse_mapping(TABLE(some_mappings))").select("variant", "pos", "flipped", "hap", "lower", "upper", "is_unique")
    want = text.parse_mapping(frame)
    assert got.schema.names == want.schema.names
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5


def test_tables_are_looked_at_before_they_run(spark):
    tables.register(spark)
    spark.range(3).createOrReplaceTempView("numbers")
    with pytest.raises(Exception, match="no mapping"):
        spark.sql("SELECT * FROM parse_mapping(TABLE(numbers))")
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM parse_mapping('x')")


def test_regions(spark):
    tables.register(spark)
    rows = spark.sql("SELECT * FROM regions('chr2:10-25', 10)").collect()
    assert [tuple(r) for r in rows] == [("2", 10, 19), ("2", 20, 25)]
    joined = spark.sql("SELECT r.start FROM VALUES ('1:1-3'), ('1:7-8') t(x), LATERAL regions(x, 2) r")
    assert sorted(r["start"] for r in joined.collect()) == [1, 3, 7]


def test_runs(spark):
    tables.register(spark)
    spark.createDataFrame([(h, s, "aab"[s % 3] if h else "z") for h in range(2) for s in range(7)], "hap int, site int, target string").createOrReplaceTempView("copied")
    rows = spark.sql("SELECT hap, site, target, first, length FROM runs(TABLE(copied) PARTITION BY hap ORDER BY (site), 'target')").collect()
    assert sorted(map(tuple, rows)) == [(0, 0, "z", 0, 7), (1, 0, "a", 0, 2), (1, 2, "b", 2, 1), (1, 3, "a", 3, 2), (1, 5, "b", 5, 1), (1, 6, "a", 6, 1)]


def test_parse_mapping_grows_with_the_string(spark):
    """Many branches, and many haplotypes of one branch, are each cut out once."""
    many = ";".join(f"{2 * k}.{2 * k + 1},1.0000,2.5000" for k in range(20_000))
    wide = ".".join(str(k) for k in range(40_000)) + ",1.0000,inf"
    frame = spark.createDataFrame([("a", 1, 0, many), ("b", 2, 1, wide), ("c", 3, 0, "NaN")], "variant string, pos int, flipped int, mapping string")
    began = time.perf_counter()
    got = text.parse_mapping(frame).toPandas().sort_values(["variant", "hap"])
    assert time.perf_counter() - began < 12
    for variant, upper, alone in (("a", 2.5, False), ("b", float("inf"), True)):
        mine = got[got["variant"] == variant]
        assert mine["hap"].tolist() == list(range(40_000))
        assert set(mine["upper"]) == {upper} and set(mine["is_unique"]) == {alone}
    assert len(got) == 80_000
