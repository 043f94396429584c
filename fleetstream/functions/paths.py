"""Path and URI helpers (P9, P10, P11) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URI_SCHEME = "file:"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decoded(path) -> Column:
    """Plain path of a URL-encoded one (``_metadata.file_path`` encodes blanks
    and the like; file listings don't).  A literal ``+`` stays a plus."""
    return F.url_decode(F.replace(_col(path), F.lit("+"), F.lit("%2B")))


def scanned_path() -> Column:
    """Plain path of the file that a row was scanned from."""
    return decoded(F.col("_metadata.file_path"))


def uri_to_path(uri) -> Column:
    """Drop the five characters ``file:`` (the prefix is not checked)."""
    return F.substring(_col(uri), len(URI_SCHEME) + 1, 1 << 30)


def file_uri(path) -> Column:
    """P10: ``file:`` + path, no escaping."""
    return F.concat(F.lit(URI_SCHEME), _col(path))


def base_name(path) -> Column:
    """Last path element."""
    return F.element_at(F.split(_col(path), "/"), -1)


def dir_value(path, depth: int = 1) -> Column:
    """Name of the ``depth``-th directory above the file, with a ``key=``
    prefix (from partitioned writers) removed."""
    part = F.element_at(F.split(_col(path), "/"), -(depth + 1))
    return F.regexp_replace(part, r"^[A-Za-z_][A-Za-z0-9_]*=", "")


def is_hidden(path) -> Column:
    """base name starts with '.'."""
    return base_name(path).startswith(".")
