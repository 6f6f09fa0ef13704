"""Numbers, shares, versions and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenths(part: Column, total: Column, scale: int = 100) -> Column:
    """scale * part / total to one digit, from integers; ties go up. 0.0 where total is 0."""
    p, t = part.cast("long"), total.cast("long")
    return F.when(t == 0, F.lit(0.0)).otherwise(F.call_function("div", F.lit(20 * scale) * p + t, F.lit(2) * t).cast("double") / 10)


def to_number(c: Column) -> Column:
    """1,234 and 1.234 are thousands; one or two digits after the last separator are decimals."""
    bare = F.regexp_replace(c, "[.,]", "")
    decimals = r"^(\d{1,3}(?:[.,]\d{3})*|\d+)[.,](\d{1,2})$"
    whole = F.regexp_replace(F.regexp_extract(c, decimals, 1), "[.,]", "")
    return (
        F.when(c.rlike(r"^\d{1,3}(?:[.,]\d{3})+$"), bare)
        .when(c.rlike(decimals), F.concat(whole, F.lit("."), F.regexp_extract(c, decimals, 2)))
        .otherwise(bare)
        .try_cast("double")
    )


_VERSION = r"(\d+)(?:\.(\d+))?(?:\.(\d+))?"


def version(c: Column) -> Column:
    """The first numeric triple as a struct that sorts; missing parts are 0, null without a number."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, _VERSION, i), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    return F.when(c.rlike(r"\d"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def behind(resolved: Column, latest: Column) -> Column:
    """How far resolved is behind latest: major, minor, patch, current, ahead or unknown."""
    have, want = version(resolved), version(latest)
    return (
        F.when(have.isNull() | want.isNull(), "unknown")
        .when(have > want, "ahead")
        .when(have["major"] < want["major"], "major")
        .when(have["minor"] < want["minor"], "minor")
        .when(have["patch"] < want["patch"], "patch")
        .otherwise("current")
    )


def is_exact(v: Column) -> Column:
    return v.rlike(r"^[\w.\-]+$") & ~v.endswith("+") & ~F.lower(v).contains("latest")


def python_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[-_.]+", "-"))


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)
