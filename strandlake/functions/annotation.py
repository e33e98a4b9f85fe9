"""Attribute, location and qualifier expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandlake.functions.dna import col

NAME_KEYS = ("Name", "gene", "locus_tag", "ID")
BIG = 2147483647


def _one_attribute(attrs: Column, key: str) -> Column:
    present = attrs.rlike(f"(^|;)\\s*{key}=")
    value = F.trim(F.regexp_extract(attrs, f"(?:^|;)\\s*{key}=([^;]*)", 1))
    return F.when(present, F.regexp_replace(value, '^"(.*)"$', "$1"))


def gff_attribute(attrs: Column | str, *keys: str) -> Column:
    """Value of the first listed key present, '' when none is."""
    a = col(attrs)
    return F.coalesce(*[_one_attribute(a, k) for k in keys], F.lit(""))


def feature_name(attrs: Column | str, type_: Column | str) -> Column:
    """C14: Name, gene, locus_tag, ID, then the type."""
    a = col(attrs)
    found = [F.nullif(_one_attribute(a, k), F.lit("")) for k in NAME_KEYS]
    return F.coalesce(*found, col(type_))


def parse_location(location: Column | str) -> tuple[Column, Column]:
    """0-based half-open hull of all numbers in a flat-file location, (0, 0) without any.

    Accession prefixes such as ``J00194.1:`` are removed first.
    """
    text = F.regexp_replace(col(location), r"[A-Za-z_][A-Za-z0-9_.]*:", "")
    nums = F.transform(
        F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int")
    )
    low, high = F.array_min(nums), F.array_max(nums)
    return (
        F.coalesce(F.greatest(low - 1, F.lit(0)), F.lit(0)),
        F.coalesce(high, F.lit(0)),
    )


def parse_qualifier(text: Column | str) -> Column:
    """``/key="v"`` as ``key=v``; a bare key stays; NULL when there is no slash."""
    body = F.regexp_extract(F.trim(F.regexp_replace(col(text), "^FT", "")), "^/(.*)$", 1)
    key = F.trim(F.regexp_extract(body, "^([^=]*)=", 1))
    value = F.trim(F.regexp_extract(body, "^[^=]*=(.*)$", 1))
    value = F.regexp_replace(F.regexp_replace(value, '^"', ""), '"$', "")
    out = F.when(body.contains("="), F.concat(key, F.lit("="), value)).otherwise(body)
    return F.when(F.trim(F.regexp_replace(col(text), "^FT", "")).startswith("/"), out)
