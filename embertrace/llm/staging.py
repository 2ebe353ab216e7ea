"""Results written once into the shared folder, so that a lost executor repeats no work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.session import scratch_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that ``spark.checkpoint.dir`` names, read back from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``columns`` computed once per row: later filters on them are not unfolded into their expressions."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns))))


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


WHITE = " \t\n\x0b\f\r"


def split_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")
