"""Tables in a database, through Spark's JDBC source.

The driver jar and the connection come from the caller. ``partition_column``
with its bounds splits the read; without it a table is read by one task, which
suits the attribute tables but not the samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Named queries over the stored tables.
QUERIES: dict[str, str] = {
    "qualitative": "SELECT * FROM qualitative",
    "plays": "SELECT playkey, position, stadiumtype, fieldtype, temperature, weather, playtype FROM plays",
    "play_positions": "SELECT playkey, position FROM plays",
    "injuries": "SELECT playkey, bodypart, DM_M1, DM_M7, DM_M28, DM_M42 FROM injuries",
    "concussion": "SELECT * FROM descriptive_data",
    "clean_quals": "SELECT * FROM clean_data",
    "ngs_data": "SELECT gamekey, playid, gsisid, time, x, y, dis, o, dir FROM ngs_data WHERE gsisid IS NOT NULL",
    "positions": "SELECT gsisid, position FROM punt_data",
}


# Datasets with all samples, which are only read in parts.
LARGE = ("ngs_data",)


@dataclass(frozen=True)
class Database:
    url: str
    options: dict[str, str] = field(default_factory=dict)

    def _reader(self, spark: SparkSession):
        return spark.read.format("jdbc").option("url", self.url).options(**self.options)

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return self._reader(spark).option("query", sql).load()

    def named(self, spark: SparkSession, name: str, **bounds) -> DataFrame:
        """A known dataset; one that holds all samples needs the bounds that ``table`` takes."""
        if name not in QUERIES:
            raise ValueError(f"unknown dataset {name!r}, expected one of {sorted(QUERIES)}")
        if name in LARGE and not {"partition_column", "lower", "upper", "partitions"} <= set(bounds):
            raise ValueError(f"{name!r} is too large for one task: give partition bounds")
        return self.table(spark, f"({QUERIES[name]}) AS named", **bounds)

    def table(
        self,
        spark: SparkSession,
        name: str,
        partition_column: str | None = None,
        lower: int | None = None,
        upper: int | None = None,
        partitions: int | None = None,
    ) -> DataFrame:
        reader = self._reader(spark).option("dbtable", name)
        if partition_column:
            reader = (
                reader.option("partitionColumn", partition_column)
                .option("lowerBound", str(lower))
                .option("upperBound", str(upper))
                .option("numPartitions", str(partitions))
            )
        return reader.load()

    def replace(self, df: DataFrame, name: str) -> None:
        self._write(df, name, "overwrite")

    def append(self, df: DataFrame, name: str) -> None:
        self._write(df, name, "append")

    def _write(self, df: DataFrame, name: str, mode: str) -> None:
        writer = df.write.format("jdbc").option("url", self.url).options(**self.options)
        writer.option("dbtable", name).mode(mode).save()
