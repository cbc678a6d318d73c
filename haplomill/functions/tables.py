"""Table functions for SQL: mapping strings, regions, and the breaks of a sequence.

`register(spark)` names them; then, for example,
`SELECT * FROM parse_mapping(TABLE(mapped))`,
`SELECT * FROM regions('1:20000-60000', 5000)` or
`SELECT * FROM runs(TABLE(rows) PARTITION BY hap ORDER BY (site), 'target')`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .regions import parse_region


def _columns(table: AnalyzeArgument, name: str, needed: tuple[str, ...]) -> StructType:
    """The schema of a table argument, which must have these columns."""
    if not table.isTable:
        raise ValueError(f"{name} takes a table: {name}(TABLE(...))")
    lacking = [c for c in needed if c not in table.dataType.fieldNames()]
    if lacking:
        raise ValueError(f"the table has no {', '.join(lacking)}")
    return table.dataType


class ParseMapping:
    """A row a haplotype and branch of a table with mapping strings; its other columns come along."""

    def __init__(self, planned: AnalyzeResult | None = None) -> None:
        self.names = planned.schema.fieldNames()[:-4] if planned else []

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        given = _columns(table, "parse_mapping", ("mapping",))
        out = StructType([f for f in given.fields if f.name != "mapping"])
        return AnalyzeResult(out.add("hap", IntegerType()).add("lower", DoubleType()).add("upper", DoubleType()).add("is_unique", BooleanType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["mapping"] is None or row["mapping"] == "NaN":
            return
        kept, branches = [row[c] for c in self.names], row["mapping"].split(";")
        for branch in branches:
            ids, lower, upper = branch.split(",")
            for hap in ids.split("."):
                yield (*kept, int(hap), float(lower), float(upper), len(branches) == 1)


class Regions:
    """Stretches of a region, each of a width but the last: chromosome, start, end, both ends included."""

    def eval(self, text: str, width: int) -> Iterator[tuple]:
        if width < 1:
            raise ValueError("a stretch has one position at least")
        chromosome, start, end = parse_region(text)
        for low in range(start, end + 1, width):
            yield chromosome, low, min(low + width - 1, end)


class Runs:
    """Runs of equal values of a column in each partition of a table, in its order: the partition's
    columns as they are in the first row, the row's number in the partition, and the run's length."""

    def __init__(self, planned: AnalyzeResult | None = None) -> None:
        self.names = planned.schema.fieldNames()[:-2] if planned else []
        self.value, self.at, self.first, self.begin = None, 0, None, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        given = _columns(table, "runs", (column.value,))
        return AnalyzeResult(StructType(list(given.fields)).add("first", LongType()).add("length", LongType()))

    def eval(self, row: Row, column: str) -> Iterator[tuple]:
        if self.first is None or row[column] != self.value:
            yield from self.terminate()
            self.first, self.value, self.begin = row, row[column], self.at
        self.at += 1

    def terminate(self) -> Iterator[tuple]:
        if self.first is not None:
            yield (*[self.first[c] for c in self.names], self.begin, self.at - self.begin)


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_mapping", udtf(ParseMapping))
    spark.udtf.register("regions", udtf(Regions, returnType="chromosome string, start int, end int"))
    spark.udtf.register("runs", udtf(Runs))
