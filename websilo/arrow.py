"""Arrow schemas of Spark schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def arrow_schema(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)
