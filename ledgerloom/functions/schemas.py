"""Schemas written as DDL."""

from pyspark.sql.types import StructType


def extended(schema: StructType, ddl: str) -> StructType:
    """A copy of ``schema`` with the fields of a DDL text at its end."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
