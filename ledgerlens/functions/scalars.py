"""Column expressions: ratios, time, amounts, bands, moments."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, WEEK = 24, 168


@dataclass(frozen=True)
class FrozenParams:
    """What is fitted on the training period and then held: see ``features.fit_params``."""

    large_amount: float
    types: tuple[str, ...]
    tolerance: float = 0.01
    windows: tuple[int, ...] = (1, DAY, WEEK)


def safe_divide(num: Column, den: Column) -> Column:
    """NULL unless the denominator is above zero."""
    return F.when(den > 0, num / den)


def temporal(step: str = "step") -> dict[str, Column]:
    hour = F.pmod(F.col(step) - 1, F.lit(DAY))
    angle = hour * (2 * 3.141592653589793 / DAY)
    return {
        "hour": hour,
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "day_part": F.floor(hour / 6),
        "day": F.floor((F.col(step) - 1) / DAY),
    }


def amounts(p: FrozenParams) -> dict[str, Column]:
    amount, old = F.col("amount"), F.col("sender_old")
    return {
        "log_amount": F.log1p(F.greatest(amount, F.lit(0.0))),
        "amount_zero": (amount == 0).cast("int"),
        "amount_large": (amount >= p.large_amount).cast("int"),
        "amount_to_sender": safe_divide(amount, old),
        "amount_to_dest": safe_divide(amount, F.col("dest_old")),
        "empties_sender": ((amount >= old - p.tolerance) & (old > 0)).cast("int"),
        "sender_remaining": old - amount,
    }


def balances() -> dict[str, Column]:
    return {
        "sender_zero": (F.col("sender_old") == 0).cast("int"),
        "dest_zero": (F.col("dest_old") == 0).cast("int"),
        "log_sender": F.log1p(F.greatest("sender_old", F.lit(0.0))),
        "log_dest": F.log1p(F.greatest("dest_old", F.lit(0.0))),
    }


def post_balances(p: FrozenParams) -> dict[str, Column]:
    """After the event: for audits only, never for models."""
    sender, dest = F.col("sender_new") - F.col("sender_old"), F.col("dest_new") - F.col("dest_old")
    return {
        "sender_change": sender,
        "dest_change": dest,
        "sender_change_ratio": safe_divide(sender, F.col("sender_old")),
        "dest_change_ratio": safe_divide(dest, F.col("dest_old")),
        "sender_zero_after": (F.abs("sender_new") <= p.tolerance).cast("int"),
        "sender_consistent": (F.abs(F.col("sender_old") - F.col("amount") - F.col("sender_new")) <= p.tolerance).cast("int"),
        "dest_consistent": (F.abs(F.col("dest_old") + F.col("amount") - F.col("dest_new")) <= p.tolerance).cast("int"),
    }


def one_hot(column: str, values: tuple[str, ...]) -> dict[str, Column]:
    """Frozen categories; an unseen value is all zeros."""
    return {f"{column}_{v}": (F.coalesce(F.col(column), F.lit("")) == v).cast("int") for v in values}


def risk_score(p: Column) -> Column:
    return F.round(100 * p, 4)


#: Lower bounds of the bands, applied to the rounded score.
BANDS = (("LOW", 0.0), ("MEDIUM", 30.0), ("HIGH", 70.0))


def risk_level(score: Column, bands=BANDS) -> Column:
    return reduce(lambda out, b: F.when(score >= b[1], b[0]).otherwise(out), bands, F.lit(None))


def suffix_number(ident: Column) -> Column:
    """Number after the last dash of an identifier, 0 if there is none."""
    return F.coalesce(F.regexp_extract(ident, r"-(\d+)$", 1).try_cast("long"), F.lit(0))


def digest_number(*columns: str | Column, seed: int | None = None) -> Column:
    """The first 60 bits of the MD5 of the columns' texts, NULL as ``\\N`` and doubles with six decimals: a hash
    that any other engine can reproduce, for samples and fingerprints that must be."""
    text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *text, *([F.lit(str(seed))] if seed is not None else []))), 1, 15), 16, 10).cast("long")


def skewness(x: str) -> Column:
    """Bias-corrected, as data-frame libraries report it."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: str) -> Column:
    """Bias-corrected excess."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def normal_two_sided(z: Column) -> Column:
    """P(|N(0,1)| > |z|) by a rational approximation of erfc with relative error below 1.2e-7."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + x / 2)
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = reduce(lambda out, k: out * t + k, reversed(c[:-1]), F.lit(c[-1]))
    return t * F.exp(-x * x + poly)


def kolmogorov(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value of the two-sample statistic ``d``: 2 * sum of (-1)^(k-1) exp(-2 k^2 x^2)."""
    x = d * F.sqrt(F.try_divide(n1 * n2, n1 + n2))
    series = reduce(lambda a, b: a + b, [F.exp(-2 * k * k * x * x) * (1 if k % 2 else -1) for k in range(1, 41)])
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))
