"""Column builders for host, user and entity names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_node(name: Column) -> Column:
    """Name without a trailing ``@DOM<digits>`` (any case) and then without one trailing ``$``; null gives ''."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)@DOM[0-9]+\z", "")
    return F.when(bare.endswith("$"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def entity(name: Column) -> Column:
    """Normalised name, or null where the name is null or empty and so stands for no entity."""
    return F.nullif(normalize_node(name), F.lit(""))


def account_part(src_node: Column) -> Column:
    """Account of ``account@domain|machine``: left of the first pipe, up to its last ``@``; '' without a pipe."""
    s = F.coalesce(src_node, F.lit(""))
    left = F.regexp_extract(s, r"(?s)\A([^|]*)\|", 1)
    account = F.when(left.contains("@"), F.regexp_extract(left, r"(?s)\A(.*)@[^@]*\z", 1)).otherwise(left)
    return F.when(s.contains("|"), account).otherwise(F.lit(""))


def domain_part(src_node: Column) -> Column:
    """Domain of ``account@domain|machine``; '' where there is none."""
    left = F.regexp_extract(F.coalesce(src_node, F.lit("")), r"(?s)\A([^|]*)\|", 1)
    return F.regexp_extract(left, r"(?s)@([^@]*)\z", 1)


def machine_part(src_node: Column) -> Column:
    """Normalised machine right of the first pipe, or the whole normalised name without a pipe."""
    s = F.coalesce(src_node, F.lit(""))
    right = F.regexp_replace(s, r"(?s)\A[^|]*\|", "")
    return normalize_node(right)
