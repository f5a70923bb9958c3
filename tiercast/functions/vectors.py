"""Feature vectors as columns: dense arrays, or the cells that are not 0."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


def sparse(indices: Column, values: Column, size: int) -> Column:
    """Ascending indices and their values as a vector of ``size``; all other cells are 0."""
    return F.struct(F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))


def is_dense(rows: DataFrame, name: str = "x") -> bool:
    return isinstance(rows.schema[name].dataType, ArrayType)


def value_at(rows: DataFrame, idx: Column, name: str = "x") -> Column:
    """The vector's value at ``idx``, for either form."""
    if is_dense(rows, name):
        return F.get(name, idx)
    at = F.array_position(F.col(name)["indices"], idx).cast("int")
    return F.coalesce(F.get(F.col(name)["values"], at - 1), F.lit(0.0))


def ml_vector(rows: DataFrame, name: str = "x") -> Column:
    """The vector as Spark ML takes it; the sparse form stays sparse.

    No cast leads from a struct to Spark ML's vector type, but the JSON reader knows it. Doubles
    come through JSON unchanged.
    """
    if is_dense(rows, name):
        return array_to_vector(name)
    x = F.col(name)
    # The fields of Spark ML's stored vectors, type 0 being the sparse one.
    stored = F.struct(F.lit(0).alias("type"), x["size"].alias("size"), x["indices"].alias("indices"), x["values"].alias("values"))
    held = F.to_json(F.struct(stored.alias("v")))
    return F.from_json(held, StructType([StructField("v", VectorUDT())]))["v"]
