"""Places in images, tiles and blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import quotient


def reflect(i: Column, n: Column) -> Column:
    """An index one step beyond either end of n >= 2 places, mirrored back."""
    return (n - 1) - F.abs((n - 1) - F.abs(i))


def tile_position(x: Column, y: Column, width: int, tile: int) -> Column:
    """Place in square-tile-major order of a pixel in an image of `width`."""
    return quotient(y, tile) * (width * tile) + quotient(x, tile) * (tile * tile) + (y % tile) * tile + x % tile


def block_number(x: Column, y: Column, width: int, size: int = 4) -> Column:
    return quotient(y, size) * (width // size) + quotient(x, size)


def place_in_block(x: Column, y: Column, size: int = 4) -> Column:
    return (y % size) * size + x % size


def padded(n: Column, multiple: int) -> Column:
    """The least multiple that is not below n."""
    return quotient(n + (multiple - 1), multiple) * multiple


def chunks(width: Column, height: Column, chunk_width: int, chunk_height: int) -> Column:
    """Array of (n, x, y): the upper left corners of the chunks that cover an image, in rows, with their numbers."""
    across, down = quotient(width + (chunk_width - 1), chunk_width), quotient(height + (chunk_height - 1), chunk_height)
    place = lambda n: F.struct(n.alias("n"), (n % across * chunk_width).alias("x"), (quotient(n, across) * chunk_height).alias("y"))
    return F.when((across > 0) & (down > 0), F.transform(F.sequence(F.lit(0), across * down - 1), place)).otherwise(F.array().cast("array<struct<n:int,x:int,y:int>>"))
