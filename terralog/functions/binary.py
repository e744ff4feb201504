"""Bytes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_text(data: Column) -> Column:
    """Base64 in one line; the built-in function may break lines after 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")
