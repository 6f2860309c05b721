"""Counter-based randomness as Spark columns: a value depends on stream, row and draw only, never on partitions."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = "layerloom-streams-1"
ROUNDS = 4
#: Steps that a permutation takes to come back into its domain, at most; each is needed with a chance of 1 / sqrt(size).
WALK = 12


def stream(scenario_id: str, seed: int, name: str) -> int:
    """The 63-bit key of a named stream; streams of other names, seeds or scenarios are independent."""
    payload = json.dumps([_SCHEME, scenario_id, seed, name], separators=(",", ":")).encode()
    return int.from_bytes(hashlib.sha256(payload).digest()[:8], "big") >> 1


def bits(key: int, *counters: Column) -> Column:
    """64 random bits for each combination of counters."""
    return F.xxhash64(F.lit(key).cast("bigint"), *counters)


def below(n: int | Column, key: int, *counters: Column) -> Column:
    """A uniform integer in [0, n)."""
    return F.pmod(bits(key, *counters), F.lit(n).cast("bigint") if isinstance(n, int) else n)


def uniform(key: int, *counters: Column) -> Column:
    """A uniform double in [0, 1)."""
    return F.shiftrightunsigned(bits(key, *counters), 11) / F.lit(float(1 << 53))


def _sides(n: int) -> tuple[int, int]:
    """a * b >= n, both near the root, with as little to spare as a short search finds: a side of 1 would only shift."""
    root = math.isqrt(max(0, n - 1)) + 1
    return min(((a, -(-n // a)) for a in range(max(root - 200, root - root // 4, 1), root + 1)), key=lambda s: (s[0] * s[1] - n, -s[0]))


def permuted(i: Column, n: int, key: int) -> Column:
    """The place of i < n in a random permutation of [0, n), without storing it.

    A Feistel network over pairs (x, y) with x < a and y < b permutes [0, a * b); walking on from values that are no
    less than n stays a permutation of [0, n). At most a * b - n values are outside, so few steps are ever needed.
    """
    if n <= 1:
        return F.lit(0).cast("bigint")
    a, b = _sides(n)
    x_size, y_size = F.lit(a).cast("bigint"), F.lit(b).cast("bigint")

    def once(v: Column) -> Column:
        y = F.pmod(v, y_size)
        start = F.struct(F.call_function("div", v - y, y_size).alias("x"), y.alias("y"))

        def round_(p: Column, r: Column) -> Column:
            first = F.struct(F.pmod(p["x"] + below(a, key, p["y"], r), x_size).alias("x"), p["y"].alias("y"))
            second = F.struct(p["x"].alias("x"), F.pmod(p["y"] + below(b, key, p["x"], r), y_size).alias("y"))
            return F.when(r % 2 == 0, first).otherwise(second)

        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, round_, lambda p: p["x"] * y_size + p["y"])

    steps = F.sequence(F.lit(0), F.lit(min(a * b - n, WALK)))
    return F.aggregate(steps, i.cast("bigint"), lambda v, k: F.when((k > 0) & (v < n), v).otherwise(once(v)))


def permuted_product(i: Column, sizes: list[int], key: int) -> Column:
    """The places of row i in a random permutation of a product of domains, as an array of one place for each domain.

    The product may have any size. The row's digits in these bases are each permuted, and then every digit in turn is
    moved by a hash of the others: each step can be undone, so tuples stay distinct, and every place of a domain is drawn.
    """
    digits, step = [], 1
    for k, size in enumerate(sizes):
        digit = F.pmod(F.call_function("div", i, F.lit(step).cast("bigint")), F.lit(size).cast("bigint")) if step < 1 << 62 else F.lit(0).cast("bigint")
        digits.append(permuted(digit, size, stream("", key, f"digit/{k}")))
        step *= size

    def round_(p: Column, r: Column) -> Column:
        turn = F.pmod(r, F.lit(len(sizes)))
        moved = [F.pmod(p[k] + below(size, key, r, *[p[j] for j in range(len(sizes)) if j != k]), F.lit(size).cast("bigint")) for k, size in enumerate(sizes)]
        return F.array(*[F.when(turn == k, moved[k]).otherwise(p[k]) for k in range(len(sizes))])

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * len(sizes) - 1)), F.array(*digits), round_)
