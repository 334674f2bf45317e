"""Identity: identifiers, slugs and content addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def db_ident(name: Column) -> Column:
    """Trimmed; in double quotes its case counts, else it is upper case."""
    t = F.trim(name)
    return F.when(t.rlike('^".*"$') & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.upper(t))


def slug(name: Column) -> Column:
    """Lower case, with every run of other characters than letters and digits as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean(name: Column) -> Column:
    """White space runs as one space."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))


def object_id(owner: Column, name: Column) -> Column:
    return F.concat(F.lit("db:"), db_ident(owner), F.lit("."), db_ident(name))


def unit_id(owner: Column, package: Column, name: Column, ordinal: Column) -> Column:
    """A program unit's id; the second and later ones of a name carry their number."""
    path = F.concat_ws(".", db_ident(owner), F.when(package.isNotNull() & (package != ""), db_ident(package)), db_ident(name))
    return F.concat(F.lit("db:"), path, F.when(ordinal > 1, F.concat(F.lit("#"), ordinal.cast("string"))).otherwise(F.lit("")))


def content_id(kind: str, normalised: Column) -> Column:
    """kind: and the first 16 hex digits of the SHA-1 of normalised text."""
    return F.concat(F.lit(kind + ":"), F.substring(F.sha1(normalised), 1, 16))


def split_words(name: Column) -> Column:
    """Lower-case words of an identifier: cut at other characters than letters and digits, and where the case changes."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), lambda w: w != "")


def title(name: Column) -> Column:
    """A capital at the start and behind every other character than a letter, all else lower case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([a-z]+|[^a-z]+)"), 1)
    return F.array_join(F.transform(parts, F.initcap), "")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def tier(score: Column, bounds: list[tuple[str, float]], reach: bool = True) -> Column:
    """The first name whose bound the score reaches (or, without reach, exceeds); bounds descend, the last name is for the rest."""
    out = None
    for name, bound in bounds[:-1]:
        ok = score >= bound if reach else score > bound
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out.otherwise(bounds[-1][0])


def masked(name: Column, value: Column) -> Column:
    """The value, unless the name says that it is a secret."""
    return F.when(F.lower(name).rlike("password|secret|credential|key") & (value != ""), F.lit("***MASKED***")).otherwise(value)
