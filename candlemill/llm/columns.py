"""Column expressions shared by the operators: words, hashes, byte sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def pack(df: DataFrame, **named: Column) -> DataFrame:
    """The caller's row as one struct ``_row`` beside named helper columns, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in named.items()])


def unpack(df: DataFrame, columns: list[str], **named: Column) -> DataFrame:
    """The caller's columns again, with ``named`` added; a named one replaces a column of that name."""
    new = {k.lower() for k in named}
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns if c.lower() not in new], *[v.alias(k) for k, v in named.items()])
