"""Nested arrays of any depth as column expressions: shapes, checks and padding, built by recursion over the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType


def depth_of(kind: DataType) -> int:
    """How many dimensions an array column has."""
    n = 0
    while isinstance(kind, ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def _fail(message: str, *parts: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *[p.cast("string") for p in parts]))


def shape(values: Column, depth: int) -> Column:
    """The sizes of all dimensions of a rectangular array; an error where inner arrays are null or differ in size. Without elements the further sizes are 0."""
    own = F.array(F.size(values))
    if depth == 1:
        return F.when(values.isNull(), _fail("a null array has no shape").cast("array<int>")).otherwise(own)
    inner = F.transform(values, lambda x: shape(x, depth - 1))
    same = F.size(F.array_distinct(inner)) <= 1
    none = F.array(*[F.lit(0)] * (depth - 1))
    found = F.when(F.size(values) == 0, none).when(same, F.get(inner, F.lit(0))).otherwise(_fail("a ragged array has no shape: ", F.to_json(F.struct(inner.alias("sizes")))).cast("array<int>"))
    return F.when(values.isNull(), _fail("a null array has no shape").cast("array<int>")).otherwise(F.concat(own, found))


def filled(sizes: list[Column], value: Column) -> Column:
    """An array of these sizes that holds one value."""
    out = value
    for n in reversed(sizes):
        out = F.array_repeat(out, n.cast("int"))
    return out


def padded(values: Column, sizes: list[Column], value: Column, left: bool = False) -> Column:
    """A rectangular array filled up to `sizes` in every dimension, at the end or, with left, at the start."""
    inner = values if len(sizes) == 1 else F.transform(values, lambda x: padded(x, sizes[1:], value, left))
    fill = F.array_repeat(filled(sizes[1:], value), F.greatest(sizes[0] - F.size(values), F.lit(0)).cast("int"))
    return F.concat(fill, inner) if left else F.concat(inner, fill)


def pad_batches(rows: DataFrame, batch: list[str], column: str, value=0, left: bool = False) -> DataFrame:
    """rows whose arrays are padded to the largest size that any array of their batch has in each dimension; ragged and null arrays are errors."""
    kind = rows.schema[column].dataType
    depth = depth_of(kind)
    if not depth:
        raise ValueError(f"{column} holds no arrays")
    element = kind
    while isinstance(element, ArrayType):
        element = element.elementType
    names = [f"__size_{k}" for k in range(depth)]
    sized = rows.withColumn("__shape", shape(F.col(column), depth))
    widest = sized.groupBy(*batch).agg(*[F.max(F.get("__shape", F.lit(k))).alias(n) for k, n in enumerate(names)])
    on = [rows[b].eqNullSafe(widest[b]) for b in batch]
    met = rows.join(widest.withColumnsRenamed({b: f"__of_{b}" for b in batch}), [F.col(b).eqNullSafe(F.col(f"__of_{b}")) for b in batch]) if on else rows
    return met.withColumn(column, padded(F.col(column), [F.col(n) for n in names], F.lit(value).cast(element), left)).drop(*names, *[f"__of_{b}" for b in batch])


def stacked(batches: DataFrame, rows: DataFrame, batch: list[str], order: list[str], column: str, value=0, left: bool = False) -> DataFrame:
    """(batch, column, shape): one array of a dimension more for each of `batches`, its rows padded and in order. A batch without rows is an error."""
    depth = depth_of(rows.schema[column].dataType)
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("__value"))))
    whole = pad_batches(rows, batch, column, value, left).groupBy(*batch).agg(F.transform(held, lambda s: s["__value"]).alias(column))
    met = batches.select(*batch).distinct().join(whole, batch, "left")
    kind = whole.schema[column].dataType.simpleString()
    checked = F.when(F.col(column).isNull(), _fail("a batch without arrays").cast(kind)).otherwise(F.col(column))
    return met.select(*batch, checked.alias(column)).withColumn("shape", shape(F.col(column), depth + 1))


def parsed(text: Column, depth: int, element: str = "long") -> Column:
    """JSON arrays of one depth; a text of another depth is an error, so arrays of mixed ranks don't pass."""
    lead = F.regexp_replace(F.regexp_extract(text, r"^\s*([\[\s]*)", 1), r"\s", "")
    kind = element
    for _ in range(depth):
        kind = f"array<{kind}>"
    right = F.length(lead) == depth
    return F.when(right, F.from_json(text, kind)).otherwise(F.when(text.isNotNull(), _fail(f"not an array of {depth} dimensions: ", text).cast(kind)))
