"""The dispatch linear program, solved exactly.

Maximise the sum over half-hours of price * (discharged - charged) - wear * discharged, with
the state of charge kept in a band, charging at an efficiency and both flows at most m. The
state is one number, so the value of what is left to come is a concave, piecewise linear
function of it. It is kept as its slopes, steepest first. A half-hour adds two segments (undoing
charge at price / efficiency, discharging at price - wear), merged by slope, and the ends are
cut to the band: no solver is needed and the optimum is exact.
"""

from __future__ import annotations

from bisect import bisect_left

EPS = 1e-12


class Value:
    """Concave value of the state of charge on [low, high]: at its left end, then segments."""

    def __init__(self, low: float, high: float) -> None:
        self.low, self.high, self.at_low = low, high, 0.0
        self.keys = [0.0]  # falling slopes, negated
        self.sizes = [high - low]

    def add(self, price: float, m: float, wear: float, efficiency: float) -> None:
        """Puts one half-hour before what is there."""
        if m <= 0:
            return
        self.at_low -= price * m
        for slope, size in ((price - wear, m), (price / efficiency, efficiency * m)):
            i = bisect_left(self.keys, -slope)
            self.keys.insert(i, -slope)
            self.sizes.insert(i, size)
        self._cut(efficiency * m, self.high - self.low)

    def _cut(self, before: float, width: float) -> None:
        while before > EPS and self.sizes:
            take = min(before, self.sizes[0])
            self.at_low -= self.keys[0] * take
            before -= take
            if take >= self.sizes[0] - EPS:
                self.keys.pop(0)
                self.sizes.pop(0)
            else:
                self.sizes[0] -= take
        total = 0.0
        for i, size in enumerate(self.sizes):
            if total + size >= width - EPS:
                self.sizes[i] = width - total
                del self.keys[i + 1 :], self.sizes[i + 1 :]
                break
            total += size

    def __call__(self, soc: float) -> float:
        out, left = self.at_low, soc - self.low
        for key, size in zip(self.keys, self.sizes):
            take = min(left, size)
            out -= key * take
            left -= take
            if left <= EPS:
                break
        return out


def solve(soc: float, prices: list[float], power_mw: list[float], low: float, high: float, efficiency: float, wear: float) -> tuple[float, float, float]:
    """Discharged and charged MWh of the first half-hour, and the whole optimum. Of equal
    optima the one of least throughput now. The state is first put into the band."""
    soc = min(max(soc, low), high)
    if not prices:
        return 0.0, 0.0, 0.0
    rest = Value(low, high)
    for price, mw in zip(prices[:0:-1], power_mw[:0:-1]):
        rest.add(price, mw * 0.5, wear, efficiency)
    m = power_mw[0] * 0.5
    if m <= 0:
        return 0.0, 0.0, rest(soc)
    price = prices[0]
    # Walk from full charge to the state: own segments and the rest's by falling slope. Of equal
    # slopes undoing charge comes first and discharging last.
    walk = sorted([(-(price / efficiency), 0, efficiency * m), (-(price - wear), 2, m), *((k, 1, s) for k, s in zip(rest.keys, rest.sizes))])
    left, taken = soc - (low - efficiency * m), [0.0, 0.0, 0.0]
    gain = rest.at_low - price * m
    for key, kind, size in walk:
        take = min(left, size)
        taken[kind] += take
        gain -= key * take
        left -= take
        if left <= EPS:
            break
    out, into = taken[2], m - taken[0] / efficiency
    return (out if out > 1e-9 else 0.0), (into if into > 1e-9 else 0.0), gain
