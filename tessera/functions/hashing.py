"""Text numbers, linear hash families and seeded randomness, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Moduli and the multipliers and offsets of the Bloom filter's hashes.
BLOOM_MODULUS = 111317
BLOOM_BITS = 69997
BLOOM_HASHES = ((1999, 2023), (2000, 2001), (2022, 2024))
SKETCH_MODULUS = 7202218937
SKETCH_RANGE = 69997

_DRAW_MODULUS, _DRAW_ROUNDS = 2147483647, 6


def text_number(text: Column, modulus: int) -> Column:
    """The UTF-8 bytes of ``text``, read as one big-endian number, modulo ``modulus`` (below 2**54).

    An empty text is 0, null stays null.
    """
    digits, n = F.hex(F.encode(text, "UTF-8")), F.octet_length(text)
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"), lambda acc, i: (acc * 256 + byte(i)) % modulus)
    return F.when(n > 0, folded).when(n == 0, F.lit(0).cast("bigint"))


def linear_hash(x: Column, a: Column, b: Column, modulus: int, size: int | Column) -> Column:
    """``((a x + b) % modulus) % size`` without overflow, for numbers below 2**34.

    ``a`` is split at 16 bits, so that every product stays below 2**63.
    """
    high, low = F.shiftright(a, 16), F.pmod(a, F.lit(1 << 16))
    product = ((high * x) % modulus * (1 << 16) + low * x) % modulus
    return (product + b) % modulus % size


def hash_family(n: int, seed: int, below: int) -> list[tuple[int, int]]:
    """``n`` pairs (a, b) with ``0 < a < below`` and ``0 <= b < below``, by a rule from ``seed``."""
    state, pairs = seed * 2 + 1, []
    for _ in range(n):
        drawn = []
        for _ in range(2):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            drawn.append(state >> 20)
        pairs.append((drawn[0] % (below - 1) + 1, drawn[1] % below))
    return pairs


def family_column(pairs: list[tuple[int, int]]) -> Column:
    """The pairs as an array of ``number, a, b``, to be exploded beside each row."""
    entry = lambda i, a, b: F.struct(F.lit(i).alias("number"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
    return F.array(*(entry(i, a, b) for i, (a, b) in enumerate(pairs)))


def _round_keys(seed: int) -> list[int]:
    """The added constants of the rounds of ``draw``."""
    return [a for a, _ in hash_family(_DRAW_ROUNDS, 1000 + seed, _DRAW_MODULUS)]


def draw(position: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on ``position`` and ``seed`` only.

    Each round adds a constant of the seed and takes the fifth power, which
    permutes the numbers below the prime, so that the draws of different seeds
    aren't related by any linear rule.
    """

    def fifth(x: Column) -> Column:
        square = x * x % _DRAW_MODULUS
        return square * square % _DRAW_MODULUS * x % _DRAW_MODULUS

    keys = F.array(*(F.lit(k).cast("bigint") for k in _round_keys(seed)))
    mixed = F.aggregate(keys, position.cast("bigint") % _DRAW_MODULUS, lambda x, k: fifth((x + k) % _DRAW_MODULUS))
    return mixed / F.lit(float(_DRAW_MODULUS))


def draw_sql(position: str, seed: int) -> str:
    """``draw`` as SQL, the fifth power by five single steps of 128 bits."""
    p = _DRAW_MODULUS
    shifted = f"((x + k) % {p})"
    power = shifted
    for _ in range(4):
        power = f"({power} * {shifted} % {p})"
    keys = ", ".join(f"{k}::HUGEINT" for k in _round_keys(seed))
    return f"(list_reduce(list_prepend({position}::HUGEINT % {p}, [{keys}]), lambda x, k: {power})::DOUBLE / {float(p)})"
