"""Source identifiers that carry their partition and position, and printed designations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFF


def encode(partition: Column, ra: Column, dec: Column, truncate: bool = False) -> Column:
    """16 bits of partition, 24 of right ascension, 24 of distance from the pole, both in 1e-4 degrees.

    ``truncate`` cuts the scaled values as older catalogs did, which loses a unit for some positions.
    """
    whole = (lambda v: F.floor(F.round(v, 4) * 10000)) if truncate else (lambda v: F.round(v * 10000))
    a, d = whole(ra).cast("long"), whole(90 - dec).cast("long")
    return F.shiftleft(partition.cast("long"), 48).bitwiseOR(F.shiftleft(a, 24)).bitwiseOR(d)


def partition_of(source: Column) -> Column:
    return F.shiftright(source, 48).cast("int")


def position_of(source: Column) -> tuple[Column, Column]:
    low = F.lit(_LOW).cast("long")
    return F.shiftright(source, 24).bitwiseAND(low) / 10000, 90 - source.bitwiseAND(low) / 10000


def designation(ra: Column, dec: Column, prefix: str = "J") -> Column:
    """``Jhhmmss.ss+ddmmss.s`` with seconds of right ascension rounded, of declination cut, carried past 60."""
    ticks = F.round(ra / 15 * 360000).cast("long")
    tenth = F.floor(F.abs(dec) * 36000 + 1e-6).cast("long")
    part = lambda v, unit, wrap: F.lpad(F.pmod(F.floor(v / unit), F.lit(wrap)).cast("string"), 2, "0")
    return F.concat(
        F.lit(prefix), part(ticks, 360000, 24), part(ticks, 6000, 60), part(ticks, 100, 60), F.lit("."), part(ticks, 1, 100),
        F.when(dec < 0, "-").otherwise("+"), part(tenth, 36000, 100), part(tenth, 600, 60), part(tenth, 10, 60), F.lit("."), F.pmod(tenth, F.lit(10)).cast("string"),
    )
