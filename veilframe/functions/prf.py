"""Keyed pseudo-random columns.

`rand(seed)` depends on how rows are laid out in partitions, so a recomputed
task could draw other numbers. Here every draw is a function of a secret key, a
label and the row's identifier: retries, re-plans and other engines agree on it.
Whoever holds the key can subtract the noise, so a release needs its own key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits of the digest are 52 bits, all of which a double holds exactly.
_HEX_DIGITS = 13
_RANGE = float(2**52)
# Draws that fit into the digest's 64 hex digits.
PARTS = 4
# Smallest argument given to a logarithm.
_LOG_FLOOR = 1e-15


def digest(key: str, label: str, ident: Column) -> Column:
    """SHA-256 hex of `key|label|ident`; a null identifier counts as empty text."""
    text = F.coalesce(ident.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.lit(f"{key}|{label}|"), text), 256)


def uniform(key: str, label: str, ident: Column, part: int = 0) -> Column:
    """Uniform double in [0, 1).

    One digest gives PARTS independent draws; Spark computes a digest that several
    parts share only once.
    """
    if not 0 <= part < PARTS:
        raise ValueError(f"a digest has {PARTS} parts")
    digits = F.substring(digest(key, label, ident), 1 + part * _HEX_DIGITS, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(_RANGE)


def normal(key: str, label: str, ident: Column) -> Column:
    """Standard normal from two uniforms (Box-Muller)."""
    radius = F.greatest(uniform(key, label, ident, 0), F.lit(_LOG_FLOOR))
    angle = uniform(key, label, ident, 1)
    return F.sqrt(F.lit(-2.0) * F.log(radius)) * F.cos(F.lit(2.0) * F.pi() * angle)


def laplace(key: str, label: str, ident: Column, scale: Column | float) -> Column:
    """Laplace(0, scale) by inverting its distribution function."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    centred = uniform(key, label, ident) - F.lit(0.5)
    tail = F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(centred), F.lit(_LOG_FLOOR))
    return scale * F.signum(centred) * F.log(tail)


def index_below(draw: Column, size: int | Column) -> Column:
    """Integer in 1..size from a uniform draw."""
    bound = size if isinstance(size, Column) else F.lit(size)
    return F.least(F.floor(draw * bound) + F.lit(1), bound).cast("int")


def pick(values: Sequence[str], draw: Column) -> Column:
    """One of `values`, each with the same chance."""
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, index_below(draw, len(values)))
