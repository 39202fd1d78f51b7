"""Admission tests of the scan and of the indexer, one expression each.

They read the columns ``name, extension, size, content`` (``content`` only where said), so the
cheap tests stay on metadata and the optimizer may push them below the read of a file.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.schema import DEFAULT_EXTENSIONS, MAX_FILE_BYTES, SearchOptions

# Fixed value: how many leading bytes the binary test reads.
BINARY_PROBE = 512


def size_in_range(size: Column, low: int, high: int) -> Column:
    """Both ends count as inside."""
    return size.between(low, high)


def extension_in(extension: Column, wanted: Iterable[str]) -> Column:
    """Equality without case, dot included; false for an empty list."""
    names = sorted({w.lower() for w in wanted})
    return F.lower(extension).isin(names) if names else F.lit(False)


def is_binary(content: Column) -> Column:
    """A NUL among the first 512 bytes, or a file that could not be read."""
    return F.coalesce(
        F.contains(F.substring(content, 1, BINARY_PROBE), F.lit(b"\x00")), F.lit(True)
    )


def skip_reason(options: SearchOptions, binary: Column) -> Column:
    """The first test a file fails, in the order size, excluded, not included, binary; else null."""
    out = F.when(~size_in_range(F.col("size"), options.min_size, options.max_size), "size")
    if options.exclude_extensions:
        out = out.when(extension_in(F.col("extension"), options.exclude_extensions), "excluded")
    if options.include_extensions:
        out = out.when(~extension_in(F.col("extension"), options.include_extensions),
                       "not included")
    return out.when(binary, "binary")


def indexable_metadata(allowed: Iterable[str] = DEFAULT_EXTENSIONS,
                       max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The part of the indexer's admission test that needs no content."""
    return extension_in(F.col("extension"), allowed) & (F.col("size") <= max_bytes)


def indexable(allowed: Iterable[str] = DEFAULT_EXTENSIONS, max_bytes: int = MAX_FILE_BYTES,
              binary: Column | None = None) -> Column:
    """Known extension, not too long, not binary."""
    test = is_binary(F.col("content")) if binary is None else binary
    return indexable_metadata(allowed, max_bytes) & ~test
