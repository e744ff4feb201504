"""Topic and message-type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replace_root(name: Column, old: str, new: str) -> Column:
    return (
        F.when(name == old, F.lit(new))
        .when(F.startswith(name, F.lit(old + "/")), F.concat(F.lit(new), F.substring(name, len(old) + 1, 1 << 30)))
        .otherwise(name)
    )


def rewrite_topic(name: Column, legacy_root: str, root: str) -> Column:
    """Move a topic from the legacy root to the current one; only whole path segments match."""
    return _replace_root(name, legacy_root, root)


def rewrite_type(name: Column, legacy_package: str, package: str) -> Column:
    """Two-part types get their ``msg`` part, then the legacy package becomes the current one."""
    parts = F.split(name, "/")
    full = F.when(F.size(parts) == 2, F.concat_ws("/", parts[0], F.lit("msg"), parts[1])).otherwise(name)
    return _replace_root(full, legacy_package, package)


def split_config(text: Column) -> Column:
    """Configured list: split on comma, semicolon or newline, trim, drop empty, keep first of equals."""
    parts = F.transform(F.split(text, r"[,;\n\r\x0B\f\x85\u2028\u2029]"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def topic_summary(topics: Column) -> Column:
    """First two names, then how many more."""
    shown = F.concat_ws(", ", F.slice(topics, 1, 2))
    return (
        F.when(F.size(topics) <= 0, F.lit("No topics"))
        .when(F.size(topics) <= 2, shown)
        .otherwise(F.concat(shown, F.lit(" +"), (F.size(topics) - 2).cast("string")))
    )


def valid_recorder_url(text: Column) -> Column:
    """True for ws or wss addresses that name a host."""
    host = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]+\]|[^/?#:@]+)", 1)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.coalesce(scheme.isin("ws", "wss") & (host != ""), F.lit(False))
