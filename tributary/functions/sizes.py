"""Sizes in bytes, for people."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the units by power, of 1000 and of 1024.
SI, IEC = ("B", "kB", "MB", "GB", "TB", "PB", "EB"), ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def _units() -> dict[str, int]:
    """Unit names in lower case and their bytes: b and none for one, then k, m, g, t, p, e with kb and kib and the like."""
    out = {"": 1, "b": 1}
    for power, letter in enumerate("kmgtpe", 1):
        out |= {letter: 1000**power, f"{letter}b": 1000**power, f"{letter}i": 1024**power, f"{letter}ib": 1024**power}
    return out


def _human(n: Column, base: int, names: tuple[str, ...]) -> Column:
    size = n.cast("double")
    power = F.floor(F.log(size) / F.log(F.lit(float(base))))
    value = F.floor(size / F.pow(F.lit(float(base)), power) * 10 + 0.5) / 10
    unit = F.element_at(F.array(*[F.lit(x) for x in names]), (power + 1).cast("int"))
    # Ties round to even.
    shown = F.when(value < 10, F.format_string("%.1f", value)).otherwise(F.bround(value, 0).cast("long").cast("string"))
    return F.when(n < 10, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(shown, F.lit(" "), unit))


def human_bytes(n: Column) -> Column:
    """A size with units of 1000: 7350000 is 7.4 MB. Null for null."""
    return _human(n, 1000, SI)


def human_bytes_iec(n: Column) -> Column:
    """A size with units of 1024: 7350000 is 7.0 MiB."""
    return _human(n, 1024, IEC)


def parse_bytes(text: Column) -> Column:
    """The bytes that a size says, as decimal(20, 0): 3 kB is 3000, 3 kib 3072. Commas in the number don't
    count. Null where the number or the unit is wrong or the size doesn't fit 64 bits."""
    number = F.regexp_extract(text, r"^([0-9.,]*)", 1)
    value = F.replace(number, F.lit(","), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_replace(F.substr(text, F.length(number) + 1), r"^\s+|\s+$", ""))
    factor = F.create_map(*[F.lit(x) for x in chain.from_iterable((k, float(v)) for k, v in _units().items())])
    size = value * F.try_element_at(factor, unit)
    return F.when(size < 2.0**64, F.floor(size.cast("decimal(38,6)")).cast("decimal(20,0)"))
