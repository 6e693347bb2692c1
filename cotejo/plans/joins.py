"""Joins for keys that many rows share, and for tables whose files are far smaller than their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts of a key whose rows are spread.
SALTS = 32


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of joins by shuffle, however small its files are.

    Spark takes a table that is read to be as large as its files, and sends one of up to 10 MB whole through the driver.  Columns that
    repeat leave files of a byte for hundreds of bytes of rows, so that bound holds no table that grows with the input.
    """
    return df.hint("merge")


def salted(left: DataFrame, right: DataFrame, key: list[str], by: str, salts: Column, how: str = "inner") -> DataFrame:
    """left joined to right on key, where many rows of left may have one key: by the column ``by`` they are
    spread over so many salts, and right's rows are copied to the salts that their key has."""
    salt = "_salt"
    while salt in left.columns or salt in right.columns:
        salt += "_"
    left = left.withColumn(salt, F.pmod(F.xxhash64(by), salts))
    spread = left.select(*key, salt).distinct().join(right, key)
    return left.join(spread, [*key, salt], how).drop(salt)
