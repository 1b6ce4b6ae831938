"""Timestamp columns from strptime-style formats: each format becomes one regex and one guarded constructor."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, functions as F

# What each directive matches, alternatives in the order strptime tries them.
DIRECTIVES = {
    "Y": r"(?!0000)\d\d\d\d",
    "y": r"\d\d",
    "m": r"1[0-2]|0[1-9]|[1-9]",
    "d": r"3[0-1]|[1-2]\d|0[1-9]|[1-9]",
    "H": r"2[0-3]|[0-1]\d|\d",
    "I": r"1[0-2]|0[1-9]|[1-9]",
    "M": r"[0-5]\d|\d",
    "S": r"6[0-1]|[0-5]\d|\d",
    "f": r"[0-9]{1,6}",
    "p": r"AM|PM",
    "b": r"Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec",
    "B": r"January|February|March|April|May|June|July|August|September|October|November|December",
}
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


@dataclass
class _Layout:
    """A format as a regex plus the group number of each directive."""

    pattern: str = "(?i)^"
    groups: dict[str, int] = field(default_factory=dict)


def _layout(fmt: str) -> _Layout:
    layout = _Layout()
    for token in re.findall(r"%.|\s+|[^%\s]+|%$", fmt, re.DOTALL):
        if token.isspace():
            layout.pattern += r"\s+"
        elif token == "%%":
            layout.pattern += "%"
        elif token.startswith("%"):
            name = token[1:]
            if name not in DIRECTIVES or name in layout.groups:
                raise ValueError(f"unsupported directive {token!r} in timestamp format {fmt!r}")
            layout.groups[name] = len(layout.groups) + 1
            layout.pattern += f"({DIRECTIVES[name]})"
        else:
            layout.pattern += re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", token)
    return layout


def parse_stamp(text: Column, fmt: str, default_year: int) -> Column:
    """TIMESTAMP_NTZ for text that matches ``fmt`` from end to end, else null.

    One regex pass decides whether the text fits and a second rewrites it as an ISO stamp for a guarded cast.
    """
    layout = _layout(fmt)
    # Atomic, as strptime takes the first way to match and then looks whether anything is left over.
    fits = text.rlike(f"(?i)^(?>{layout.pattern.removeprefix('(?i)^')})\\z")

    def piece(name: str) -> Column:
        return F.regexp_extract(text, layout.pattern, layout.groups[name])

    def slot(name: str, otherwise: str) -> str:
        return f"${layout.groups[name]}" if name in layout.groups else otherwise

    hour = slot("H", slot("I", "0"))
    clock = f"{hour}:{slot('M', '0')}:{slot('S', '0')}" + (f".{slot('f', '')}" if "f" in layout.groups else "")
    month_name = next((name for name in ("b", "B") if name in layout.groups), None)
    template = f"{slot('d', '1')} {clock}"
    if month_name is None:
        template = f"{slot('m', '1')}-{template}"

    def build(year: Column | None) -> Column:
        if year is None and month_name is None:
            stamp = F.regexp_replace(text, layout.pattern, f"{slot('Y', '')}-{template}")
        else:
            head = [piece("Y") if year is None else year, F.lit("-")]
            if month_name is not None:
                short = F.initcap(F.substring(piece(month_name), 1, 3))
                head += [((F.instr(F.lit(MONTHS), short) + 2) / 3).cast("int").cast("string"), F.lit("-")]
            stamp = F.concat(*head, F.regexp_replace(text, layout.pattern, template))
        value = stamp.try_cast("timestamp_ntz")
        if "I" in layout.groups and "H" not in layout.groups:
            late = F.upper(piece("p")) == "PM" if "p" in layout.groups else F.lit(False)
            twelve = F.expr("interval 12 hours")
            noon_hour = piece("I").try_cast("int") == 12
            value = F.when(noon_hour & ~late, value - twelve).when(~noon_hour & late, value + twelve).otherwise(value)
        return value

    if "Y" in layout.groups:
        value = build(None)
    elif "y" in layout.groups:
        century = F.when(piece("y") >= "69", "19").otherwise("20")
        value = build(F.concat(century, piece("y")))
    else:
        # Checked in 1900 first, as the stamp itself has no year: 29 February never passes.
        value = F.when(build(F.lit("1900")).isNotNull(), build(F.lit(f"{default_year:04d}")))
    return F.when(fits, value)


def first_stamp(text: Column, formats, default_year: int | None = None) -> Column:
    """The first format that fits wins."""
    year = default_year or date.today().year
    if not formats:
        return F.lit(None).cast("timestamp_ntz")
    return F.coalesce(*[parse_stamp(text, fmt, year) for fmt in formats])


# ISO-8601 with an optional offset. The offset is checked for form and then ignored.
ISO_OFFSET = r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?"
ISO_USUAL = r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z?\z"
ISO_DATE = r"^(?!0000)(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
ISO_CLOCK = r"(?:.(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?" + ISO_OFFSET + r")?\z"


def iso_stamp(text: Column) -> Column:
    """TIMESTAMP_NTZ of an ISO-8601 text with its zone dropped, not converted; null when it is not one."""
    usual = text.try_cast("timestamp_ntz")
    pattern = ISO_DATE + ISO_CLOCK

    def group(*numbers: int) -> Column:
        return F.concat(*[F.regexp_extract(text, pattern, n) for n in numbers])

    def padded(column: Column) -> Column:
        return F.rpad(F.substring(column, 1, 6), 6, "0")

    def two(column: Column) -> Column:
        return F.when(column == "", "00").otherwise(column)

    rare = F.concat(
        group(1), F.lit("-"), group(2, 4), F.lit("-"), group(3, 5), F.lit(" "),
        two(group(6)), F.lit(":"), two(group(7, 10)), F.lit(":"), two(group(8, 11)), F.lit("."), padded(group(9, 12)),
    ).try_cast("timestamp_ntz")
    return F.when(text.rlike(ISO_USUAL), usual).when(text.rlike(pattern), rare)
