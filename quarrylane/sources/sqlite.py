"""Tables of SQLite files, such as the database of a parameter study, as a Spark data source.

A table is read in ranges of row numbers, one per partition; comparisons of columns with constants
go into the file's own query.  The path must be one that all executors can open.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

BATCH = 8192
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: What a declared type holds, by the words that SQLite itself goes by.
AFFINITIES = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


@dataclass
class RowRange(InputPartition):
    first: int
    last: int


class TableReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "8"))
        self.schema = schema
        self.where: list[str] = []
        self.values: list[object] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of numbers and texts with their own kind; Spark does the others."""
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            kind = kinds.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            name = quoted(f.attribute[0]) if kind else ""
            if kind and isinstance(f, IsNotNull):
                self.where.append(f"{name} IS NOT NULL")
            elif kind and type(f) in _SIGNS and (isinstance(f.value, str) if isinstance(kind, T.StringType) else isinstance(kind, (T.LongType, T.DoubleType)) and isinstance(f.value, (int, float))):
                self.where.append(f"{name} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            else:
                yield f

    def partitions(self) -> list[RowRange]:
        with opened(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema]
        kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
        casts = {T.DoubleType(): float, T.LongType(): int, T.StringType(): str}
        conditions = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        with opened(self.path) as con:
            rows = con.execute(f"SELECT {', '.join(map(quoted, names))} FROM {quoted(self.table)} WHERE {conditions}", [partition.first, partition.last, *self.values])
            while block := rows.fetchmany(BATCH):
                columns = []
                for f, column in zip(self.schema, zip(*block)):
                    cast = casts.get(f.dataType, bytes)
                    columns.append(pa.array([None if v is None else cast(v) for v in column], kinds[f.dataType]))
                yield pa.RecordBatch.from_arrays(columns, names=names)


class SqliteTable(DataSource):
    """format("sqlite_table") with the options path, table and partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with opened(self.options["path"]) as con:
            columns = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        kind = lambda declared: next((t for word, t in AFFINITIES if word in declared.upper()), T.StringType() if declared else T.BinaryType())
        return T.StructType([T.StructField(c[1], kind(c[2])) for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TableReader(schema, dict(self.options))


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions).load()


def study_tables(spark: SparkSession, path: str, partitions: int = 8) -> dict[str, DataFrame]:
    """trials, values, params and attributes of a study's database; without a table of attributes, an empty one."""
    names = {"trials": "trials", "values": "trial_values", "params": "trial_params", "attributes": "trial_user_attributes"}
    with opened(path) as con:
        there = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    none = spark.createDataFrame([], "trial_id long, key string, value_json string")
    return {k: none if k == "attributes" and n not in there else sqlite_table(spark, path, n, partitions) for k, n in names.items()}
