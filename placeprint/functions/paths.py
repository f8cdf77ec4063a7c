"""Column functions over file paths. Backslashes count as slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(path: Column) -> Column:
    """Slashes only, without scheme, doubled slashes and ./ steps."""
    path = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[a-zA-Z]+:/+(?=/)", "")
    return F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "(?<!^)/{2,}", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(normal(path), "/"), -1)


def parent(path: Column, level: int = 1) -> Column:
    """Name of the folder so many levels above the file; null if there is none."""
    return F.try_element_at(F.split(normal(path), "/"), F.lit(-1 - level))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def session_prefix(path: Column) -> Column:
    """The name without its trailing digits and underscores: what the clips of one session share."""
    return F.regexp_replace(stem(path), "[0-9_]+$", "")


def clip_name(location: Column, index: Column) -> Column:
    return F.format_string("%s_%04d.wav", location, index)


def clip_index(name: Column) -> Column:
    """The number that ends a clip's name; null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(stem(name), r"_([0-9]+)$", 1), F.lit("")), F.lit("999999999")).cast("long")


def next_index(name: Column) -> Column:
    """Aggregate: the first free number after the clips seen; 0 where there are none."""
    return F.coalesce(F.max(clip_index(name)), F.lit(-1)) + 1


def joined(sources: Column) -> Column:
    return F.array_join(sources, "+")


def sources(text: Column) -> Column:
    return F.split(text, r"\+")
