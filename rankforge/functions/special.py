"""Special functions as column expressions: log gamma and the incomplete beta function."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def bind(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over named values, each evaluated once however often the body uses it."""
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.transform(F.array(row), body)[0]


def log_gamma(z: Column) -> Column:
    """ln gamma of a positive number: the Stirling series at z + 8, and back by the recurrence."""
    far = z + 8
    inverse = 1 / (far * far)
    # Bernoulli numbers B2k / (2k (2k - 1))
    series = F.lit(0.0)
    for c in (1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12):
        series = series * inverse + c
    product = z
    for i in range(1, 8):
        product = product * (z + i)
    return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + series / far - F.log(product)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by the modified Lentz recurrence.

    A fold over step numbers; a row takes no more part once its value stands. Beyond the
    turning point, on the side that ``incomplete_beta`` picks, the number of steps needed grows
    with the root of the larger parameter, and so does the list of steps.
    """

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(acc: Column, k: Column) -> Column:
        m = F.floor((k + 1) / 2).cast("double")
        two = a + 2 * m
        num = F.when(k % 2 == 1, m * (b - m) * x / ((two - 1) * two)).otherwise(
            -(a + m) * (a + b + m) * x / (two * (two + 1))
        )
        d, c = 1 / safe(1 + num * acc["d"]), safe(1 + num / acc["c"])
        moved = F.struct(
            c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"),
            ((k % 2 == 0) & (F.abs(d * c - 1) < 1e-15)).alias("done"),
        )
        return F.when(acc["done"], acc).otherwise(moved)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"), F.lit(False).alias("done"))
    steps = F.sequence(F.lit(1), (200 + 10 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int"))
    return F.aggregate(steps, start, step, lambda acc: acc["h"])


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b); ``rest`` is 1 - x, given apart to keep its digits."""

    def inside(v: Column) -> Column:
        turned = v["x"] >= (v["a"] + 1) / (v["a"] + v["b"] + 2)
        sides = {
            "p": F.when(turned, v["b"]).otherwise(v["a"]), "q": F.when(turned, v["a"]).otherwise(v["b"]),
            "u": F.when(turned, v["y"]).otherwise(v["x"]), "w": F.when(turned, v["x"]).otherwise(v["y"]),
            "turned": turned,
        }

        def value(s: Column) -> Column:
            logs = log_gamma(s["p"] + s["q"]) - log_gamma(s["p"]) - log_gamma(s["q"])
            logs = logs + s["p"] * F.log(s["u"]) + s["q"] * F.log(s["w"])
            part = F.exp(logs) * _fraction(s["p"], s["q"], s["u"]) / s["p"]
            return F.when(s["turned"], 1 - part).otherwise(part)

        return bind(sides, value)

    out = bind({"a": a, "b": b, "x": x, "y": rest}, inside)
    out = F.when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0)).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def pearson_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson r over n points (Student t with n - 2 degrees).

    With two points, or r = 0, it is 1; without r or with fewer points NaN.
    """
    square = r * r
    tail = incomplete_beta((n - 2) / F.lit(2.0), F.lit(0.5), 1 - square, square)
    lacking = r.isNull() | F.isnan(r) | n.isNull() | (n < 2)
    return (
        F.when(lacking, F.lit(float("nan"))).when((n == 2) | (r == 0), F.lit(1.0))
        .when(F.abs(r) >= 1, F.lit(0.0)).otherwise(tail)
    )
