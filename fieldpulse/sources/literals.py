"""Small fixed tables that live in the code."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """Rows as a local relation, so that Spark knows the size and needs no Python worker."""
    columns = [list(values) for values in zip(*rows)] or [[] for _ in schema.fields]
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(v, type=f.type) for v, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema))
