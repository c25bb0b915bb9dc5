"""Times with their offset: instants in microseconds of UTC beside the offset they were written with, in any session's zone."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000

#: strftime's directives as patterns, and what each gives.
DIRECTIVES = {
    "Y": r"(\d{4})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "H": r"(\d{1,2})", "I": r"(\d{1,2})", "M": r"(\d{1,2})", "S": r"(\d{1,2})", "p": r"([AaPp][Mm])", "b": r"([A-Za-z]{3})", "B": r"([A-Za-z]+)",
    "z": r"([+-]\d{2}:?\d{2})", ":z": r"([+-]\d{2}:?\d{2})", "#z": r"(Z|[+-]\d{2}(?::?\d{2})?)", ".f": r"((?:\.\d{1,9})?)", "f": r"(\d{1,9})", "%": "%",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


_PART = "\x01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """What the ``n`` groups of a pattern hold, empty where one takes no part; null where the text isn't of that form."""
    parted = F.split(F.regexp_replace(text, pattern, _PART.join(f"${k + 1}" for k in range(n))), _PART)
    return F.when(text.rlike(pattern), parted)


def _micros(date: Column, time: Column, fraction: Column) -> Column:
    """Microseconds since 1970 of texts yyyy-MM-dd, HH:mm:ss and a fraction's digits, null where they are no time; a 60th second is the minute's last."""
    day = date.try_cast("date")
    part = lambda k: F.substring(time, k, 2).try_cast("int")
    hour, minute, second = part(1), part(4), part(7)
    legal = day.isNotNull() & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    digits = F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("long")
    clock = ((hour * 60 + minute) * 60 + second).cast("long") * 1_000_000
    return F.when(legal, F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY + clock + F.coalesce(digits, F.lit(0)))


def _offset(text: Column) -> tuple[Column, Column]:
    """An offset's spelling as +hh:mm and its microseconds; ``Z`` is +00:00, none beyond a day."""
    zero = F.upper(text) == "Z"
    digits = F.regexp_replace(text, "[^0-9]", "")
    spelled = F.when(zero, "+00:00").otherwise(F.concat(F.substring(text, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.rpad(F.substring(digits, 3, 2), 2, "0")))
    hours, minutes = F.substring(spelled, 2, 2).try_cast("int"), F.substring(spelled, 5, 2).try_cast("int")
    size = (hours * 60 + minutes).cast("long") * 60_000_000
    return F.when((hours < 24) & (minutes < 60), spelled), F.when(spelled.startswith("-"), -size).otherwise(size)


def _instant(local: Column, offset_text: Column) -> Column:
    def use(x: Column) -> Column:
        spelled, size = _offset(x["offset"])
        return F.when(x["local"].isNotNull() & spelled.isNotNull(), F.struct((x["local"] - size).alias("micros"), spelled.alias("offset")))

    return _let(F.struct(local.alias("local"), offset_text.alias("offset")), use)


_STRICT = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?([Zz]|[+-]\d{2}:\d{2})$"
_BASIC = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:\.(\d+))?([Zz]|[+-]\d{2}:?\d{2})$"
_NAIVE = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d+))?$"


def parse_strict(text: Column) -> Column:
    """``(micros, offset)`` of a date and time with an offset (RFC 3339); null otherwise."""
    return _let(_groups(text, _STRICT, 4), lambda g: _instant(_micros(F.get(g, 0), F.get(g, 1), F.get(g, 2)), F.get(g, 3)))


def parse_assumed_utc(text: Column) -> Column:
    """As ``parse_strict``, and times without an offset as UTC."""
    return F.coalesce(parse_strict(text), _let(_groups(text, _NAIVE, 3), lambda g: _instant(_micros(F.get(g, 0), F.get(g, 1), F.get(g, 2)), F.lit("Z"))))


def iso_utc(micros: Column, digits: int = 6, zone: str = "Z") -> Column:
    """``yyyy-MM-ddTHH:mm:ss[.ffffff]`` of microseconds since 1970; texts of one width, so that they sort as the instants do."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")

    def written(day: Column, rest: Column) -> Column:
        seconds = F.floor(rest / 1_000_000)
        clock = F.concat(two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60))
        fraction = F.concat(F.lit("."), F.lpad(F.floor((rest % 1_000_000) / 10 ** (6 - digits)).cast("string"), digits, "0")) if digits else F.lit("")
        return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"), clock, fraction, F.lit(zone))

    return _let(micros, lambda m: _let(F.struct(F.floor(m / DAY).alias("day"), F.pmod(m, F.lit(DAY)).alias("rest")), lambda x: written(x["day"], x["rest"])))


def split_when(text: Column) -> Column:
    """``(utc, offset)`` of a stored time: the instant in UTC to the microsecond, and the offset it was written with."""
    return _let(parse_strict(text), lambda x: F.when(x.isNotNull(), F.struct(iso_utc(x["micros"]).alias("utc"), x["offset"].alias("offset"))))


def coerce_when(text: Column) -> Column:
    """A time as it may be stored: as it is where it has an offset, the form without separators spelled out to the second, else null."""
    plain = F.trim(text)

    def spelled(g: Column) -> Column:
        date, clock = F.concat_ws("-", *[F.get(g, k) for k in (0, 1, 2)]), F.concat_ws(":", *[F.get(g, k) for k in (3, 4, 5)])
        return _let(_instant(_micros(date, clock, F.get(g, 6)), F.get(g, 7)), lambda x: F.when(x.isNotNull(), F.concat(date, F.lit("T"), clock, x["offset"])))

    return F.when(parse_strict(plain).isNotNull(), plain).otherwise(_let(_groups(plain, _BASIC, 8), lambda g: F.when(g.isNotNull(), spelled(g))))


def bump_micros(text: Column, by: Column) -> Column:
    """A time moved by microseconds, in its own offset, to the microsecond."""
    return _let(parse_strict(text), lambda x: F.when(x.isNotNull(), F.concat(iso_utc(x["micros"] + _offset(x["offset"])[1] + by, 6, ""), x["offset"])))


def strptime(text: Column, form: str) -> Column:
    """``(micros, offset)`` by a strftime format, compiled to one pattern and an expression of its groups; the format must state an offset."""
    names: list[str] = []
    pattern = ""
    for directive, other in re.findall(r"%(:z|#z|\.f|[A-Za-z%])|([^%]+|%)", form):
        if directive and directive not in DIRECTIVES:
            raise ValueError(f"format %{directive} is not known")
        pattern += DIRECTIVES[directive] if directive else re.escape(other)
        if directive and directive != "%":
            names.append(directive)
    if not {"z", ":z", "#z"} & set(names):
        raise ValueError(f"format {form!r} states no offset")
    pattern = f"^{pattern}$"
    two = lambda x: F.lpad(x, 2, "0")

    def read(g: Column) -> Column:
        def group(*wanted: str, default: str = "") -> Column:
            return next((F.get(g, names.index(name)) for name in wanted if name in names), F.lit(default))

        if {"b", "B"} & set(names):
            at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(group("b", "B"), 1, 3)))
            month = F.when(at > 0, at.cast("string")).otherwise("0")
        else:
            month = group("m", default="1")
        hour = group("H", "I", default="0")
        if "I" in names:
            twelve = hour.try_cast("int")
            half = F.when(F.lower(group("p", default="AM")) == "pm", 12).otherwise(0)
            hour = F.when(twelve.between(1, 12), (twelve % 12 + half).cast("string")).otherwise("99")
        date = F.concat_ws("-", group("Y", default="1970"), two(month), two(group("d", default="1")))
        clock = F.concat_ws(":", two(hour), two(group("M", default="0")), two(group("S", default="0")))
        fraction = F.regexp_replace(group(".f", "f"), r"^\.", "")
        texts = F.struct(date.alias("date"), clock.alias("clock"), fraction.alias("fraction"))
        return _instant(_let(texts, lambda x: _micros(x["date"], x["clock"], x["fraction"])), group("z", ":z", "#z"))

    return _let(_groups(text, pattern, len(names)), read)
