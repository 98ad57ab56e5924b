"""Deterministic draws: a pure function of (seed, key, index), so any partitioning gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1) from the first 52 bits of sha256 over the parts joined by ``:``."""
    return drawn(joined(*parts))


def joined(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def drawn(text: Column) -> Column:
    """The uniform of a text that is joined already; many draws with the same first parts join those once."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def white(*parts: Column | str | int) -> Column:
    """Uniform in [-1, 1)."""
    return uniform(*parts) * 2.0 - 1.0


def gaussian(*parts: Column | str | int) -> Column:
    """Standard normal by the polar angle of two uniforms."""
    return polar(uniform(*parts, "r"), uniform(*parts, "a"))


def polar(u1: Column, u2: Column) -> Column:
    return F.sqrt(F.log(1.0 - u1) * -2.0) * F.cos(u2 * (2.0 * math.pi))


def poisson_thresholds(lam: float) -> list[float]:
    """Cumulative probabilities up to the point where they no longer differ from 1."""
    out, p, c, k = [], math.exp(-lam), 0.0, 0
    while k <= lam or p > 1e-18:
        c += p
        out.append(c)
        k += 1
        p *= lam / k
    return out


def poisson(lam: float, u: Column) -> Column:
    """Inverse-CDF count for a constant rate; keep ``lam`` small by splitting time into cells."""
    if lam > 200:
        raise ValueError("split the span into cells: the rate is too high for direct inversion")
    # Bound as one array element, so that the draw is made once and not for every threshold.
    cuts = F.array(*[F.lit(t) for t in poisson_thresholds(lam)])
    return F.transform(F.array(u), lambda given: F.size(F.filter(cuts, lambda t: t <= given)))[0]


UNROLLED = 5


def poisson_varying(lam: Column, u: Column, most: int) -> Column:
    """Inverse-CDF count for a per-row rate, at most ``most``. Give columns that are made already: both are read for every step.

    Counts up to ``UNROLLED`` are compared in one expression; only rows with more go step by step.
    """

    def count(given: Column) -> Column:
        p0 = F.exp(-given["lam"])
        start = F.struct(p0.alias("p"), p0.alias("c"), F.lit(0).alias("n"))

        def step(a: Column, k: Column) -> Column:
            p = a["p"] * given["lam"] / k
            return F.struct(
                p.alias("p"), (a["c"] + p).alias("c"), (a["n"] + F.when(given["u"] >= a["c"], 1).otherwise(0)).alias("n")
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["n"]

    p = F.exp(-lam)
    c, out = p, F.when(u < p, 0)
    for k in range(1, min(UNROLLED, most - 1) + 1):
        p = p * lam / F.lit(k)
        c = c + p
        out = out.when(u < c, k)
    return out.otherwise(count(F.struct(lam.alias("lam"), u.alias("u"))))
