"""Bit fields, sign handling and integer logarithms as column expressions.

Bytes are kept in INT, 32-bit words in BIGINT; nothing is cast to a type that it could overflow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(word: Column, above: int, width: int) -> Column:
    """`width` bits of a word that has `above` bits below them."""
    return F.shiftright(word, above).bitwiseAND((1 << width) - 1)


def unpack_msb(word: Column, widths: list[int]) -> list[Column]:
    """The fields of a word, most significant first."""
    left = sum(widths)
    out = []
    for w in widths:
        left -= w
        out.append(field(word, left, w))
    return out


def pack_msb(values: list[Column], widths: list[int]) -> Column:
    """One word of the fields, the first in the most significant bits."""
    return reduce(lambda acc, vw: F.shiftleft(acc, vw[1]).bitwiseOR(vw[0]), zip(values[1:], widths[1:]), values[0])


def pack_lsb(values: list[Column], widths: list[int]) -> Column:
    """One word of the fields, the first in the least significant bits."""
    at, out = 0, F.lit(0).cast("long")
    for v, w in zip(values, widths):
        out = out.bitwiseOR(F.shiftleft(v.cast("long"), at))
        at += w
    return out


def sign_extend(x: Column, width: int) -> Column:
    return F.when(x >= (1 << (width - 1)), x - (1 << width)).otherwise(x)


def to_unsigned(x: Column, width: int) -> Column:
    """Bias by the least value of the signed type, so that it becomes 0."""
    return x + (1 << (width - 1))


def narrow(x: Column, low: int, high: int, kind: str = "int") -> Column:
    """A cast that fails outside its range in place of wrapping."""
    return F.when(F.assert_true((x >= low) & (x <= high), F.lit(f"value outside {low}..{high}")).isNull(), x.cast(kind))


def int_log2(x: Column) -> Column:
    """Floor of the logarithm; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x.cast("long"))) - 1).otherwise(0).cast("int")


def morton_even(x: Column) -> Column:
    """The bits at even places of a 32-bit word, together."""
    x = x.cast("long").bitwiseAND(0x55555555)
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(mask)
    return x.cast("int")


def morton_decode(x: Column) -> tuple[Column, Column]:
    return morton_even(x), morton_even(F.shiftright(x.cast("long"), 1))


def little_endian(data: Column, at: Column | int, size: int) -> Column:
    """An unsigned integer of `size` bytes at a 0-based offset of a binary column."""
    byte = lambda k: F.conv(F.hex(F.substring(data, F.lit(at) + 1 + k, F.lit(1))), 16, 10).cast("long")
    return reduce(lambda acc, k: acc + F.shiftleft(byte(k), 8 * k), range(1, size), byte(0))


def to_little_endian(x: Column, size: int) -> Column:
    """`size` bytes of an unsigned integer, as binary."""
    return F.concat(*(F.unhex(F.lpad(F.hex(field(x.cast("long"), 8 * k, 8)), 2, "0")) for k in range(size)))


def write_bits(steps: Column) -> Column:
    """Binary of an array of (val, nbits): each value's low bits, the least first, fill bytes from their lowest bit.

    The last byte's free bits are zero; no steps give empty binary, a null in a step null.
    """
    text = F.aggregate(steps, F.lit(""), lambda acc, s: F.concat(F.right(F.lpad(F.bin(s["val"].cast("long")), 64, "0"), s["nbits"].cast("int")), acc))
    whole = F.length(text) + F.pmod(-F.length(text), F.lit(8))
    padded = F.lpad(text, whole.cast("int"), "0")
    byte = lambda i: F.lpad(F.conv(F.substring(padded, (whole - 7 - 8 * i).cast("int"), F.lit(8)), 2, 16), 2, "0")
    places = F.sequence(F.lit(0), F.call_function("div", whole, F.lit(8)).cast("int") - 1)
    return F.when(whole > 0, F.unhex(F.array_join(F.transform(places, byte), ""))).when(whole == 0, F.unhex(F.lit("")))
