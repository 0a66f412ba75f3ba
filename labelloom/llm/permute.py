"""A keyed permutation of row numbers, as Column expressions and as SQL text.

A generalised Feistel network over Z_a x Z_b, with a = ceil(sqrt(n)) and
b = ceil(n / a), permutes [0, a*b). Cycle walking takes it to [0, n): a number
that leaves [0, n) is permuted again until it is back. Fewer than a numbers lie
outside, so a walk has at most that many steps; WALKS bounds the expression, and
a walk that is longer than WALKS has a chance below (1 / WALKS) ** WALKS and
would raise an error, never a wrong slot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.llm.common import seeded

PRIME = 2**31 - 1
ROUNDS = 6
WALKS = 64


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1) if n > 0 else 1
    return a, max(1, -(-n // a))


def round_keys(key: str) -> list[tuple[int, int, int]]:
    k = seeded(key, 3 * ROUNDS, PRIME)
    return [(k[3 * i], k[3 * i + 1], k[3 * i + 2]) for i in range(ROUNDS)]


def _mix(v: Column, k: Column) -> Column:
    u = (v * k["m"] + k["c"]) % PRIME
    return (u * u + k["d"]) % PRIME


def permuted(number: Column, n: int, key: str) -> Column:
    """The slot of a row number below n; n below 2 ** 53."""
    a, b = sides(n)
    rounds = F.array(*(F.struct(F.lit(i % 2 == 0).alias("left"), *(F.lit(x).cast("long").alias(c) for c, x in zip("mcd", k, strict=True))) for i, k in enumerate(round_keys(key))))

    def once(x: Column) -> Column:
        return F.aggregate(
            rounds,
            F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r")),
            lambda s, k: F.struct(
                F.when(k["left"], (s["l"] + _mix(s["r"], k)) % a).otherwise(s["l"]).alias("l"),
                F.when(k["left"], s["r"]).otherwise((s["r"] + _mix(s["l"], k)) % b).alias("r"),
            ),
            lambda s: s["l"] * b + s["r"],
        )

    walks = min(WALKS, a * b - n + 1)
    out = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), number.cast("long"), lambda p, i: F.when((i == 1) | (p >= n), once(p)).otherwise(p))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("the walk left the domain")).cast("long"))


def permuted_sql(number: str, n: str, key: str, source: str, walks: int = 12) -> str:
    """Common table expressions w0..w{walks} over ``source``; the last has column p, the slot. For oracles on small tables."""

    def mix(v: str, k: tuple[int, int, int]) -> str:
        u = f"(({v} * {k[0]} + {k[1]}) % {PRIME})"
        return f"(({u} * {u} + {k[2]}) % {PRIME})"

    parts = [f"w0 AS (SELECT *, {number} AS p, CAST(ceil(sqrt({n})) AS BIGINT) AS fa, CAST(ceil({n} / ceil(sqrt({n}))) AS BIGINT) AS fb FROM {source})"]
    for w in range(walks):
        parts.append(f"w{w}r0 AS (SELECT *, p // fb AS fl, p % fb AS fr FROM w{w})")
        for i, k in enumerate(round_keys(key)):
            new = f"(fl + {mix('fr', k)}) % fa AS fl" if i % 2 == 0 else f"(fr + {mix('fl', k)}) % fb AS fr"
            parts.append(f"w{w}r{i + 1} AS (SELECT * REPLACE ({new}) FROM w{w}r{i})")
        again = "true" if w == 0 else f"p >= {n}"
        parts.append(f"w{w + 1} AS (SELECT * EXCLUDE (fl, fr) REPLACE (CASE WHEN {again} THEN fl * fb + fr ELSE p END AS p) FROM w{w}r{ROUNDS})")
    return ",\n".join(parts)
