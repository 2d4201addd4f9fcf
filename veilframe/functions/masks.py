"""Row-local masks: each takes a Column and gives a Column, without Python at run time."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import fakes, prf

# Fixed values of the keyed pseudonyms.
HMAC_KEY = "secret_key_123"
FPE_KEY = "fpe-key"
FPE_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SHA_BLOCK = 64
_SHA_BYTES = 32
# Every byte as a character, and the character of the alphabet it stands for.
_FPE_BYTES = bytes(range(256)).decode("latin-1")
_FPE_CODES = "".join(FPE_ALPHABET[b % len(FPE_ALPHABET)] for b in range(256))


# --- generalization ---------------------------------------------------------


def bucket(value: Column, width: int) -> Column:
    """Lower bound of the bucket, truncating toward zero as integer division does."""
    return value - value % F.lit(width)


def floor_bucket(value: Column, width: int) -> Column:
    """Lower bound of the bucket, rounding down (differs from `bucket` below zero)."""
    return value - F.pmod(value, F.lit(width))


def bucket_between(value: Column, width: int, low: int, high: int) -> Column:
    """`bucket(value, width) BETWEEN low AND high` as a range on the raw column.

    A predicate on the masked expression cannot reach the Parquet statistics;
    this one can. Bucket bounds are multiples of `width`; below zero a bucket
    reaches down from its multiple, at zero it spans both sides.
    """
    first = -(-low // width) * width
    last = high // width * width
    floor_raw = first - (width - 1) if first <= 0 else first
    ceil_raw = last + (width - 1) if last >= 0 else last
    return value.between(floor_raw, ceil_raw)


def round_to_step(value: Column, step: int) -> Column:
    """Nearest multiple of `step`, halves away from zero, for decimals."""
    return F.round(value / F.lit(step)) * F.lit(step)


def truncate_to_step(value: Column, step: int) -> Column:
    """Multiple of `step` toward zero: rounding an integer quotient changes nothing."""
    return bucket(value, step)


# --- suppression and partial display ------------------------------------------


def suppress(data_type: T.DataType | str) -> Column:
    """NULL of the column's own type."""
    return F.lit(None).cast(data_type)


def partial(value: Column, prefix: int, keep: Sequence[str] = ()) -> Column:
    """First `prefix` characters and `***`; NULL and the values in `keep` stay."""
    masked = F.concat(F.substring(value, 1, prefix), F.lit("***"))
    if not keep:
        return masked
    return F.when(value.isin(*keep), value).otherwise(masked)


# --- pseudonyms -----------------------------------------------------------------


def sha256_hex(value: Column) -> Column:
    """SHA-256 of the text form, as hex."""
    return F.sha2(value.cast("string"), 256)


def hmac_sha256_hex(value: Column, key: str = HMAC_KEY) -> Column:
    """HMAC-SHA-256 of the text form, as hex.

    Both pads depend on the key alone and enter the plan as literals, so only
    two digests per row remain. They also show in `explain` output: keep plans
    as secret as the key.
    """
    secret = key.encode()
    if len(secret) > _SHA_BLOCK:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(_SHA_BLOCK, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in secret))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in secret))
    message = F.encode(value.cast("string"), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def length_preserving(value: Column, key: str = FPE_KEY) -> Column:
    """Pseudonym over 0-9A-Z with as many characters as the value.

    Character i comes from byte i of the keyed digest. A digest has 32 bytes;
    longer values go on with digests of the value and a block number.
    """
    length = F.length(value)
    head = hmac_sha256_hex(value, key)
    blocks = F.sequence(F.lit(1), F.floor((length - 1) / F.lit(_SHA_BYTES)).cast("int"))
    tail = F.array_join(
        F.transform(
            blocks,
            lambda b: hmac_sha256_hex(F.concat(value, F.lit("|"), b.cast("string")), key),
        ),
        "",
    )
    hexes = F.concat(head, F.when(length > _SHA_BYTES, tail).otherwise(F.lit("")))
    # All bytes are translated at once. A lambda over the characters would compute the
    # digests anew for each of them.
    codes = F.decode(F.unhex(hexes), "ISO-8859-1")
    return F.substring(F.translate(codes, _FPE_BYTES, _FPE_CODES), F.lit(1), length)


# --- noise ------------------------------------------------------------------------


def proportional_noise(value: Column, draw: Column, span: float, floor: int = 0) -> Column:
    """`value + (draw - 0.5) * value * span`, not below `floor`, rounded half to even."""
    moved = value + (draw - F.lit(0.5)) * value * F.lit(float(span))
    return F.rint(F.greatest(F.lit(float(floor)), moved)).cast("int")


def additive_noise(value: Column, draw: Column, width: float, floor: int = 1) -> Column:
    """`value + (draw - 0.5) * width`, not below `floor`, rounded half to even."""
    moved = value + (draw - F.lit(0.5)) * F.lit(float(width))
    return F.rint(F.greatest(F.lit(float(floor)), moved)).cast("int")


def ratio_noise(value: Column, draw: Column, ratio: float, data_type: T.DataType) -> Column:
    """Uniform in `value ± ratio * value`, in the column's own type."""
    factor = F.lit(1.0) + (F.lit(2.0) * draw - F.lit(1.0)) * F.lit(float(ratio))
    moved = value.cast("double") * factor
    if isinstance(data_type, T.IntegralType):
        moved = F.rint(moved)
    return moved.cast(data_type)


def laplace_noise(
    value: Column,
    key: str,
    label: str,
    ident: Column,
    epsilon: float = 1.0,
    sensitivity: float = 1.0,
) -> Column:
    """Value plus Laplace noise of scale sensitivity / epsilon."""
    return value + prf.laplace(key, label, ident, sensitivity / epsilon)


# --- replacement values ---------------------------------------------------------------


def random_int(draw: Column, low: int, high: int) -> Column:
    """Integer in low..high, both included."""
    return (F.lit(low - 1) + prf.index_below(draw, high - low + 1)).cast("int")


def fake_from(values: Sequence[str], draw: Column) -> Column:
    """One value of a fixed list."""
    return prf.pick(values, draw)


def fake_full_name(first: Column, second: Column) -> Column:
    """First and last name from two draws."""
    return F.concat(
        prf.pick(fakes.FIRST_NAMES, first), F.lit(" "), prf.pick(fakes.LAST_NAMES, second)
    )


def fake_company(first: Column, second: Column) -> Column:
    """One of about a thousand company names from two draws."""
    return F.concat(
        prf.pick(fakes.COMPANY_WORDS, first), F.lit(" "), prf.pick(fakes.COMPANY_FORMS, second)
    )


def fake_country(draw: Column) -> Column:
    """One country name."""
    return prf.pick(fakes.COUNTRIES, draw)
