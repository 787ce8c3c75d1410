"""File names and categories from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(uri: Column) -> Column:
    """``file:/a%20b`` as ``/a b``; other schemes keep their prefix."""
    local = F.regexp_replace(uri, r"\Afile:/+", "/")
    return F.url_decode(F.replace(local, F.lit("+"), F.lit("%2B")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def folder_category(path: Column, root: str | Column) -> Column:
    """Bulk rule: the parent folder, or ``uncategorized`` directly under the root."""
    root = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    parent = F.regexp_replace(path, r"/[^/]*+\z", "")
    return F.when(parent == root, F.lit("uncategorized")).otherwise(parent_name(path))


def path_category(path: Column) -> Column:
    """Single-file rule: what follows the first ``raw`` component, else the parent folder."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "raw").cast("int")
    after = F.when(at > 0, F.try_element_at(parts, at + 1))
    return F.coalesce(after, parent_name(path))
