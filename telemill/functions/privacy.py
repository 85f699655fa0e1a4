"""Privacy accounting: Gaussian calibration and zero-concentrated budgets, in plain Python on the driver."""

from __future__ import annotations

import math


def _log_cdf(x: float) -> float:
    """Log of the normal distribution function, also far out in the lower tail."""
    if x > -37:
        return math.log(0.5 * math.erfc(-x / math.sqrt(2)))
    t = 1 / (x * x)
    series = 1 - t * (1 - 3 * t * (1 - 5 * t))
    return -x * x / 2 - math.log(-x) - 0.5 * math.log(2 * math.pi) + math.log(series)


def gaussian_delta(sigma: float, epsilon: float, sensitivity: float = 1.0) -> float:
    """The delta that Gaussian noise gives at an epsilon."""
    mu = sensitivity / sigma
    second = epsilon + _log_cdf(-mu / 2 - epsilon / mu)
    if second > 700:
        return math.inf
    return math.exp(_log_cdf(mu / 2 - epsilon / mu)) - math.exp(second)


def _bisect(f, low: float, high: float, tolerance: float = 1e-10) -> float:
    rising = f(high) > 0
    while high - low > tolerance * max(1.0, abs(low)):
        middle = (low + high) / 2
        if (f(middle) > 0) == rising:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def calibrate_sigma(epsilon: float, delta: float, rounds: int = 1, sensitivity: float = 1.0) -> float:
    """Noise for so many adaptive releases under (epsilon, delta)."""
    whole = sensitivity * math.sqrt(rounds)
    return _bisect(lambda s: gaussian_delta(s, epsilon, whole) - delta, 0.01, 1e4)


def compute_epsilon(sigma: float, delta: float, rounds: int = 1) -> float:
    """The epsilon that so many releases cost; infinite where none up to 1000 will do."""
    whole = math.sqrt(rounds)
    f = lambda e: gaussian_delta(sigma, e, whole) - delta
    if f(0.0) <= 0:
        return 0.0
    return math.inf if f(1000.0) > 0 else _bisect(f, 0.0, 1000.0)


def zcdp_rho(epsilon: float, delta: float) -> float:
    b = 2 * math.sqrt(math.log(1 / delta))
    return ((math.sqrt(b * b + 4 * epsilon) - b) / 2) ** 2


def zcdp_sigma(queries: int, rho: float) -> float:
    """Noise of each of so many unit-sensitivity queries that share rho."""
    return math.sqrt(queries / (2 * rho)) if rho > 0 else 1e6


def allocate(count: int, shares: dict[str, float]) -> dict[str, int]:
    """A whole number split by shares; the smallest share takes what rounding leaves."""
    whole = sum(shares.values())
    out = {k: round(count * v / whole) for k, v in shares.items()}
    out[min(shares, key=shares.get)] += count - sum(out.values())
    return out


def scale_counts(counts: list[float], target: int) -> list[int]:
    """Counts in proportion to the given ones, at least 1 each, that add up to target if that is possible; the largest take up the difference."""
    if not counts:
        return []
    whole = sum(max(c, 0) for c in counts) or 1.0
    out = [max(1, round(max(c, 0) / whole * target)) for c in counts]
    order = sorted(range(len(out)), key=lambda i: (-out[i], i))
    k, left = 0, target - sum(out)
    while left and (left > 0 or any(x > 1 for x in out)):
        i = order[k % len(order)]
        if left > 0 or out[i] > 1:
            out[i] += 1 if left > 0 else -1
            left += -1 if left > 0 else 1
        k += 1
    return out


def query_count(rows_by_group: dict[str, int], numeric_by_group: dict[str, int]) -> dict[str, int]:
    """Noisy numbers that a plan releases by group: each row's count and its numeric means, at least one."""
    return {g: max(1, n * (1 + numeric_by_group.get(g, 0))) for g, n in rows_by_group.items()}


def zcdp_epsilon(rho: float, delta: float) -> float:
    """The epsilon that a zero-concentrated budget means at a delta."""
    return rho + 2 * math.sqrt(rho * math.log(1 / delta)) if rho > 0 else 0.0


class Ledger:
    """A privacy budget: what is released is charged to it first, and what it cannot pay is refused.

    Charges compose by adding up rho, so epsilon of the sum is less than the sum of epsilons.
    """

    def __init__(self, epsilon: float, delta: float):
        self.epsilon, self.delta, self.rho = epsilon, delta, zcdp_rho(epsilon, delta)
        self.charges: list[tuple[str, float]] = []

    @property
    def spent(self) -> float:
        return math.fsum(rho for _, rho in self.charges)

    @property
    def left(self) -> float:
        return max(0.0, self.rho - self.spent)

    def charge(self, *what: tuple[str, float]) -> None:
        """(name, rho) each; all of them, or none where they are more than what is left."""
        if any(not rho > 0 for _, rho in what):
            raise ValueError("a charge must be positive")
        wanted = math.fsum(rho for _, rho in what)
        if self.spent + wanted > self.rho * (1 + 1e-9):
            raise ValueError(f"{', '.join(n for n, _ in what)}: rho {wanted:.6g} of {self.left:.6g} left")
        self.charges += what

    def epsilon_spent(self) -> float:
        return zcdp_epsilon(self.spent, self.delta)
