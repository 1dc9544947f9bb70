"""Compact codes for attributes, coordinates, vectors and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.facets import row_numbers

ALPHABET = "".join(chr(c) for c in range(48, 48 + 74))


def pack_attributes(values: DataFrame, vocabulary: list[str], rungs: int = 10) -> DataFrame:
    """(entity, packed): one character for the attribute and one for the rung of its strength, in vocabulary order; as many attributes and rungs as the alphabet has characters."""
    if max(len(vocabulary), rungs) > len(ALPHABET):
        raise ValueError(f"{len(vocabulary)} attributes and {rungs} rungs: one character tells {len(ALPHABET)} apart")
    place = F.create_map(*(F.lit(x) for i, a in enumerate(vocabulary) for x in (a, i)))
    char = lambda i: F.substring(F.lit(ALPHABET), i + 1, F.lit(1))
    code = F.struct(place[F.col("attr")].alias("i"), F.concat(char(place[F.col("attr")]), char(F.floor(F.col("value") * (rungs - 1) + 0.5).cast("int"))).alias("c"))
    return values.where(F.col("attr").isin(vocabulary)).groupBy("entity").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(code)), lambda x: x["c"])).alias("packed"))


def unpack_attributes(packed: DataFrame, vocabulary: list[str], rungs: int = 10) -> DataFrame:
    """(entity, attr, value) from packed strings; attributes that aren't there stay unknown."""
    pairs = F.explode(F.transform(F.sequence(F.lit(0), (F.length("packed") / 2 - 1).cast("int")), lambda i: F.substring(F.col("packed"), i * 2 + 1, F.lit(2))))
    index = F.expr(f"locate(substring(c, 1, 1), '{ALPHABET}')").cast("int")
    rung = F.expr(f"locate(substring(c, 2, 1), '{ALPHABET}')") - 1
    return packed.where("length(packed) > 0").select("entity", pairs.alias("c")).select("entity", F.element_at(F.lit(vocabulary), index).alias("attr"), (rung / float(rungs - 1)).alias("value"))


def quantise16(x: Column) -> Column:
    """A coordinate in [0, 1] as 16 bits."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 65535 + 0.5).cast("int")


def dequantise16(q: Column) -> Column:
    return q / 65535.0


def quantise_int8(vector: Column) -> tuple[Column, Column]:
    """(codes in [-127, 127], scale): symmetric, by the row's largest magnitude."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x).cast("double")))
    scale = F.when(top > 0, top / 127.0).otherwise(1.0)
    return F.transform(vector, lambda x: F.floor(x.cast("double") / scale + 0.5).cast("int")), scale


def dequantise_int8(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda q: q * scale)


def dictionary_encode(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The table with the column as a code, and the legend (code, value)."""
    legend = row_numbers(df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct(), "value").withColumnRenamed("row", "code")
    out = df.join(legend.withColumnRenamed("value", column), column, "left").drop(column).withColumnRenamed("code", column)
    return out, legend.select("code", "value")
