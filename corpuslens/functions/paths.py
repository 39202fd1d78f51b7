"""Column functions over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The part after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """From the last dot on, dot included; ``''`` where there is none or the name ends in it."""
    return F.regexp_extract(name, r"(\.[^.]+)$", 1)


def document_id(path: Column) -> Column:
    """A stable id for a path; ``build_index`` refuses two paths with one id."""
    return F.xxhash64(path)
