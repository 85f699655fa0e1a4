"""Column expressions with the arithmetic that the telemetry queries share."""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The memory sizes (GB) that devices are sold with.
RAM_SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 48, 64, 128, 256)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double, null where b is 0; safe under ANSI."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def wavg(weight: str | Column, value: str | Column) -> Column:
    """Weighted mean; rows with a null value don't weigh. The weight is cast first, so long products can't overflow."""
    w = F.when(col(value).isNotNull(), col(weight).cast("double"))
    return ratio(F.sum(w * col(value)), F.sum(w))


def sum_if(condition: Column, value: str | Column) -> Column:
    return F.sum(F.when(condition, col(value)).otherwise(F.lit(0.0)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(100.0 * ratio(part, whole), digits)


def unless_negative(c: str | Column) -> Column:
    """Drops a sentinel: negative values are missing ones."""
    return F.when(col(c) >= 0, col(c))


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Limits that leave nulls null (greatest and least alone would skip them)."""
    x = col(c)
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def number_or(c: str | Column, default: float) -> Column:
    """The text as a number, a default where it isn't one."""
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def snap(c: str | Column, allowed=RAM_SIZES) -> Column:
    """The nearest allowed value, the smaller of two equally near."""
    x = col(c)
    nearest = F.array_min(F.transform(F.array(*(F.lit(float(a)) for a in allowed)), lambda a: F.struct(F.abs(a - x).alias("d"), a.alias("v"))))
    return F.when(x.isNotNull(), nearest["v"])


def lookup(c: str | Column, names: dict, default) -> Column:
    """What a fixed mapping has for the value, else the default."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(default)) if pairs else F.lit(default)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def nonzero_count(columns: list[str]) -> Column:
    """How many of the columns are neither null nor zero."""
    return total(F.when(F.coalesce(F.col(c), F.lit(0)) != 0, 1).otherwise(0) for c in columns)


def any_nonzero(columns: list[str]) -> Column:
    return total(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in columns) > 0


def power_state(c: str | Column) -> Column:
    """First two letters, upper case: AC, DC or UN."""
    return F.upper(F.substring(col(c), 1, 2))


def fresh_seed() -> str:
    """A seed that nobody can guess, for noise that is to protect."""
    return secrets.token_hex(16)


def uniform(key: str | Column, seed: str | None = None) -> Column:
    """A number in (0, 1) from the key and a seed; without a seed, from a fresh secret one.

    With a seed given it is the same in every run and engine: that makes noise
    testable, and protects nobody unless the seed is secret and used once.
    """
    seed = fresh_seed() if seed is None else seed
    digest = F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


def laplace(key: str | Column, seed: str | None, scale: float | Column) -> Column:
    u = uniform(key, seed) - 0.5
    return -(scale if isinstance(scale, Column) else F.lit(scale)) * F.signum(u) * F.log(1 - 2 * F.abs(u))


def gaussian(key: str | Column, seed: str | None, sigma: float | Column) -> Column:
    """Box-Muller on two hash uniforms."""
    seed = fresh_seed() if seed is None else seed
    s = sigma if isinstance(sigma, Column) else F.lit(sigma)
    return s * F.sqrt(-2 * F.log(uniform(key, seed + "a"))) * F.cos(2 * F.pi() * uniform(key, seed + "b"))
