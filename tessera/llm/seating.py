"""Table counts of Pitman-Yor restaurants: draws from P(t) ~ S(c, t) * exp(t * log_new) for c customers of a dish.

S are the generalised Stirling numbers of the restaurant's discount d.  Up to EXACT customers a table of S gives the whole
distribution.  Beyond, S comes from a contour integral: with Sibuya(d) variables X, S(c, t) = c! / (t! d**t) * P(X_1 + .. + X_t = c),
whose generating function is (1 - (1 - x)**d)**t.  Metropolis steps on these weights leave the same distribution unchanged
at every size, and cost the same whatever c is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT, NODES, STEPS = 512, 40, 4
#: Widths of the matrices in which counts up to EXACT are drawn together.
_WIDTHS = [2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512]


@lru_cache(6)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t), the summed weights of seatings of c customers at t tables."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            table[c + 1, 1:] = np.logaddexp(table[c, :-1], np.log(np.maximum(c - discount * t, 0)) + table[c, 1:])
    return table


_LOG_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """By a table, and beyond it by Stirling's series (below 1e-12 off there)."""
    x = np.maximum(n, 4095).astype(np.float64) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 4096, _LOG_FACTORIALS[np.minimum(n, 4095)], series)


def _saddle(log_scale: np.ndarray, discount: float, whole: bool, rounds: int = 8) -> np.ndarray:
    """log v with exp(log_scale) (1 - v) v**(d - 1) / (1 - v**d if whole else 1) = 1, by Newton steps from its value for small v."""
    d = discount
    y = np.clip(log_scale / (1 - d), -600.0, -1e-6)
    for _ in range(rounds):
        v, q = np.exp(y), np.exp(d * y)
        value = log_scale + np.log1p(-v) + (d - 1) * y
        slope = -v / (1 - v) + (d - 1)
        if whole:
            value -= np.log1p(-q)
            slope += d * q / (1 - q)
        y = np.clip(y - value / np.minimum(slope, -1e-3), -600.0, -1e-6)
    return y


def log_sum_chance(t: np.ndarray, c: np.ndarray, discount: float) -> np.ndarray:
    """log P(t Sibuya variables sum to c), for c > EXACT and t < c.

    The coefficient of x**c is an integral over p, x = exp(-p), along the parabola p0 * (1 + iu)**2 around the branch cut; p0 is
    the saddle point, or 2 / c where the saddle is too near the branch point (there the 1 of the function, whose
    integral vanishes, is taken off first).
    """
    d, c, t = discount, c.astype(np.float64), t.astype(np.float64)

    saddle = -np.log1p(-np.exp(_saddle(np.log(t * d / c), d, True)))
    wide = saddle * c >= 2
    p0 = np.where(wide, saddle, 2 / c)
    reach = np.where(wide, np.minimum(8.0, np.sqrt(40 / (2 * c * p0 * (1 - d)))), 6.0)
    reach = np.minimum(reach, 0.98 * np.pi / (2 * p0))
    step = reach / NODES
    u = step[:, None] * np.arange(NODES + 1)
    turn = 1 + 1j * u
    p = p0[:, None] * turn**2
    inside = t[:, None] * np.log1p(-((-np.expm1(-p)) ** d))
    real = t * np.log1p(-((-np.expm1(-p0)) ** d))
    top = np.where(wide, real, 0.0)
    value = np.where(wide[:, None], np.exp(inside - top[:, None]), np.expm1(inside)) * np.exp(c[:, None] * (p - p0[:, None])) * turn
    total = value.real.sum(axis=1) - value[:, 0].real / 2
    return np.log(np.maximum(total * step * 2 * p0 / np.pi, 1e-300)) + top + c * p0


def log_weight(t: np.ndarray, c: np.ndarray, log_new: np.ndarray, discount: float) -> np.ndarray:
    """log of S(c, t) exp(t log_new) / c!, -inf outside 1..c."""
    inside = (t >= 1) & (t < c)
    own = np.clip(t, 1, np.maximum(c - 1, 1))
    value = own * (log_new - np.log(discount)) - log_factorial(own) + log_sum_chance(own, c, discount)
    return np.where(inside, value, -np.inf)


def centre(c: np.ndarray, log_new: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(mode, spread) of the table count, by the joint saddle point of count and integral."""
    log_v = _saddle(log_new - np.log(c), discount, False)
    q = np.exp(discount * log_v)
    mode = np.exp(log_new) / discount * (1 - q)
    spread = np.sqrt((mode + 1) / (1 + discount * q / (1 - discount)))
    return np.clip(np.rint(mode + 0.5), 1, c - 1).astype(np.int64), spread


def draw_few(customers: np.ndarray, log_new: np.ndarray, stirling: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Draws of counts of 2 to EXACT customers from the whole distribution."""
    tables = np.empty(len(customers), np.int64)
    order = np.argsort(customers, kind="stable")
    edges = np.searchsorted(customers[order], _WIDTHS, "right")
    begin = 0
    for width, end in zip(_WIDTHS, edges.tolist()):
        count = np.arange(1, width + 1)
        size = max(1, (1 << 20) // width)
        for i in range(begin, end, size):
            own = order[i : min(end, i + size)]
            weight = stirling[customers[own], 1 : width + 1] + log_new[own, None] * count
            weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
            level = draw.random(len(own)) * weight[:, -1]
            tables[own] = np.minimum((weight <= level[:, None]).sum(axis=1) + 1, customers[own])
        begin = end
    return tables


def step_many(customers: np.ndarray, tables: np.ndarray, log_new: np.ndarray, discount: float, draw: np.random.Generator, steps: int = STEPS, most: int = 4096) -> np.ndarray:
    """`steps` Metropolis steps of counts beyond EXACT customers; a count of one table starts at the mode."""
    out = np.empty(len(customers), np.int64)
    for i in range(0, len(customers), most):
        c, w = customers[i : i + most], log_new[i : i + most]
        mode, spread = centre(c, w, discount)
        now = np.where(tables[i : i + most] <= 1, mode, tables[i : i + most])
        reach = np.ceil(2.2 * spread).astype(np.int64) + 1
        weight = log_weight(now, c, w, discount)
        for _ in range(steps):
            new = now + draw.integers(-reach, reach + 1)
            other = log_weight(new, c, w, discount)
            goes = np.log(draw.random(len(c)) + 1e-300) < other - weight
            now, weight = np.where(goes, new, now), np.where(goes, other, weight)
        out[i : i + most] = now
    return out


def draw_tables(customers: np.ndarray, tables: np.ndarray, log_new: np.ndarray, discount: float, stirling: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """New table counts given customers, the present counts, and the log weight of a new table; one customer has one table."""
    out = np.minimum(customers, 1)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    if len(few):
        out[few] = draw_few(customers[few], log_new[few], stirling, draw)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        out[many] = step_many(customers[many], tables[many], log_new[many], discount, draw)
    return out
