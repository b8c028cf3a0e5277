"""Column expressions with SQL-null semantics chosen to pass nulls on (built-in least/greatest/concat_ws skip them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snp_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """chrom:pos:ref:alt; a null part reads NA."""
    return F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("NA")) for c in (chrom, pos, ref, alt)))


def smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def expression(ref: Column, alt: Column) -> Column:
    """Depth-weighted allelic expression: (ref - alt) / (ref + alt + 1) * ln(1 + ref + alt)."""
    total = ref + alt
    return (ref - alt) / (total + 1) * F.log1p(total.cast("double"))


def without_suffix(barcode: Column) -> Column:
    """A barcode without its trailing -<number>."""
    return F.regexp_replace(barcode, r"-[0-9]+$", "")


def in_list(names: Column, name: str) -> Column:
    """Whether a comma-separated list holds the name."""
    return F.array_contains(F.split(names, ","), name)


def title(name: str) -> str:
    """A column's name as the beginning of a message."""
    return name.replace("_", " ").title()


def percent(part: float, whole: float) -> str:
    return f"{100 * part / whole:.1f}%" if whole else "0.0%"
