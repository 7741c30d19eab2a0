"""Scalar functions on numbers, hashes and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the data's publisher: bucket edges of games played, and their labels.
N_GAMES_LABELS = {1: "<10", 5: "<10", 10: "10-49", 50: "50-99", 100: "100-499", 500: "500+", 1000: "500+"}
# Upper edges (exclusive) of win-rate bands, and their labels.
WIN_RATE_BANDS = ((0.45, "<45%"), (0.50, "45-50%"), (0.55, "50-55%"), (0.60, "55-60%"))
# Verdict bands on the keep probability (strictly above), and on the difference of two arms.
VERDICTS = ((0.85, "clear_keep"), (0.65, "marginal_keep"), (0.45, "borderline"), (0.25, "marginal_mulligan"))
LOWEST_VERDICT = "clear_mulligan"


def clean(x: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), x)


def win_rate_label(x: Column) -> Column:
    """Label of a win rate; ``unknown`` for null and NaN."""
    known = clean(x)
    label = F.when(known.isNull(), "unknown")
    for edge, name in WIN_RATE_BANDS:
        label = label.when(known < edge, name)
    return label.otherwise(">=60%")


def n_games_label(x: Column) -> Column:
    """Label of an edge of the games-played buckets; ``unknown`` for any other value."""
    table = F.create_map(*[F.lit(v) for pair in N_GAMES_LABELS.items() for v in pair])
    return F.coalesce(F.element_at(table, x.cast("int")), F.lit("unknown"))


def keeps_player(n_games: Column, win_rate: Column, min_games: int = 50, min_rate: float = 0.50) -> Column:
    """False only if both are known, enough games were played and the rate is too low."""
    return F.coalesce(~((n_games >= min_games) & (clean(win_rate) < min_rate)), F.lit(True))


def banded(x: Column, bands=VERDICTS, lowest: str = LOWEST_VERDICT) -> Column:
    """Label of the first band that ``x`` is strictly above; null for null."""
    label = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, name in bands:
        label = label.when(x > edge, name)
    return label.otherwise(lowest)


def delta_verdict(keep: Column, mull: Column, bias: float = 0.04, margin: float = 0.03) -> Column:
    """Four bands on keep - mull + bias; differences of exactly 0 keep."""
    d = keep - (mull - F.lit(bias))
    return F.when(d >= margin, "keep").when(d >= 0, "lean_keep").when(d > -margin, "lean_mulligan").otherwise("mulligan")


def hash_unit(text: Column) -> Column:
    """First 8 bytes of the SHA-256 as a number from 0 to 1."""
    return unit_of(F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def unit_of(bits: Column) -> Column:
    """Sixteen hexadecimal digits as a number from 0 to 1."""
    return F.conv(bits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def row_seed(*keys: Column) -> Column:
    """First 4 bytes of the SHA-256 over the keys, joined by NUL."""
    joined = F.concat_ws("\x00", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(joined.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def whole(x: Column) -> Column:
    """Null and NaN become 0."""
    return F.coalesce(clean(x.cast("double")), F.lit(0.0)).cast("long")


def any_of(probabilities: Column) -> Column:
    """Probability of at least one of independent events: an array's 1 - product(1 - p); 0 for none."""
    return 1 - F.aggregate(F.coalesce(probabilities, F.array().cast("array<double>")), F.lit(1.0), lambda acc, p: acc * (1 - F.coalesce(p, F.lit(0.0))))
