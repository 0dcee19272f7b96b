"""Names of files that follow from others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derived(path: Column | str, tail: str) -> Column:
    """path with tail between its stem and its suffix."""
    path, suffix = F.col(path) if isinstance(path, str) else path, r"(?<=[^/])\.[^./]+$"
    return F.concat(F.regexp_replace(path, suffix, ""), F.lit(tail), F.regexp_extract(path, suffix, 0))
