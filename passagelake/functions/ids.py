"""Identifier, path and preview expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from passagelake.functions.text import strip


def shard_name(centroid_idx: Column, prefix: str = "shard_") -> Column:
    return F.format_string("%s%03d", F.lit(prefix), centroid_idx)


def object_path(prefix: Column, *parts: Column) -> Column:
    """Join path parts with single slashes; empty parts are left out."""
    root = F.regexp_replace(prefix, "/+$", "")
    trimmed = [
        F.when(part != "", F.regexp_replace(part, "^/+|/+$", "")) for part in parts
    ]
    return F.concat_ws("/", root, *trimmed)


def normalize_doc_id(doc_id: Column) -> Column:
    """Write ids that read as integers in integer form ("007" becomes "7")."""
    digits = F.regexp_replace(strip(doc_id), r"(?<=[0-9])_(?=[0-9])", "")
    plain = F.when(digits.rlike(r"^[+-]?[0-9]+$"), digits)
    unsigned = F.regexp_replace(plain, r"^[+-]?0*(?=[0-9])", "")
    negative = plain.startswith("-") & (unsigned != "0")
    return F.coalesce(F.concat(F.when(negative, "-").otherwise(""), unsigned), doc_id)


def preview(text: Column, length: int = 150, suffix: str = "...") -> Column:
    cut = F.concat(F.substring(text, 1, length), F.lit(suffix))
    return F.when(F.length(text) > length, cut).otherwise(text)
