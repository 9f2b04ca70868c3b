"""Column functions: hashes, space-filling order, gap and code lengths, block numbers, registers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: fixed masks that spread the bits of a 31-bit id to every other place, widest step first
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def hash32(value: Column | str) -> Column:
    """The first 32 bits of the MD5 of a value as text: the same number in other SQL engines."""
    column = F.col(value) if isinstance(value, str) else value
    return F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def hash01(*values: Column) -> Column:
    """A number in [0, 1) that is a function of the values alone."""
    return hash32(F.concat_ws(":", *[v.cast("string") for v in values])) / F.lit(4294967296.0)


def _steps(steps: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("n"), F.lit(mask).cast("long").alias("mask")) for n, mask in steps])


def _spread(x: Column) -> Column:
    """A fold over the steps: written out, each would hold the one before it twice."""
    return F.aggregate(_steps(_SPREAD), x.cast("long"), lambda c, s: F.call_function("shiftleft", c, s["n"]).bitwiseOR(c).bitwiseAND(s["mask"]))


def _gather(x: Column) -> Column:
    steps = list(zip([n for n, _ in _SPREAD[::-1]], [*[mask for _, mask in _SPREAD[-2::-1]], 0xFFFFFFFF], strict=True))
    first = x.bitwiseAND(F.lit(_SPREAD[-1][1]))
    return F.aggregate(_steps(steps), first, lambda c, s: F.call_function("shiftright", c, s["n"]).bitwiseOR(c).bitwiseAND(s["mask"]))


def morton_encode(x: Column, y: Column) -> Column:
    """Interleave two ids below 2**31; x takes the higher bit of each pair."""
    return F.shiftleft(_spread(x), 1).bitwiseOR(_spread(y))


def morton_decode(z: Column) -> tuple[Column, Column]:
    """The (x, y) of a code."""
    return _gather(F.shiftright(z, 1)), _gather(z)


def bit_width(x: Column) -> Column:
    """Bits of a positive integer without leading zeros."""
    return F.length(F.bin(x.cast("long"))).cast("long")


def gamma_bits(x: Column) -> Column:
    """Length of the Elias gamma code of x >= 1."""
    return 2 * bit_width(x) - 1


def block_of(x: Column, y: Column, per_block: int, side: int) -> Column:
    """Number, by rows, of the square block an edge (x, y) is stored in.

    The edge's place within its block decides: above the diagonal the block is (x's, y's), else the
    one mirrored.
    """
    bx, by = F.floor(x / per_block), F.floor(y / per_block)
    return F.when(x % per_block < y % per_block, bx * side + by).otherwise(by * side + bx).cast("long")


def node_blocks(node: Column, per_block: int, side: int) -> Column:
    """All blocks that can hold an edge of a node: its column of blocks, then its row."""
    at = F.floor(node / per_block)
    steps = F.sequence(F.lit(0), F.lit(side - 1))
    return F.concat(F.transform(steps, lambda i: (i * side + at).cast("long")), F.transform(steps, lambda i: (at * side + i).cast("long")))


def register_index(h: Column, p: int) -> Column:
    """The register of a hash: its low p bits."""
    return h.bitwiseAND(F.lit((1 << p) - 1))


def rho(x: Column) -> Column:
    """Place of the lowest set bit, from 1; zero for x = 0."""
    return F.when(x == 0, F.lit(0)).otherwise(bit_width(x.bitwiseAND(-x))).cast("long")
