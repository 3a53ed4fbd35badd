"""Column expressions for cleaning, parsing and describing records and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALPHABET

# What counts as true; hydropathy (Kyte and Doolittle); charge at pH 7; aromatics.
TRUTHY = ("t", "true", "1", "1.0", "yes", "y")
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "V": 4.2, "Y": -1.3}
CHARGE = {"D": -1.0, "E": -1.0, "K": 1.0, "R": 1.0, "H": 0.1}
AROMATIC = "FWY"
LENGTH_SCALE = 100.0
CARDS = ("nehvi", "parego", "random", "uncertainty")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def folded(x: Column | str) -> Column:
    """Case- and space-folded text; null becomes 'none'."""
    return F.lower(F.trim(F.coalesce(_c(x).cast("string"), F.lit("none"))))


def to_bool(x: Column | str) -> Column:
    return folded(x).isin(*TRUTHY)


def clean_sequence(x: Column | str) -> Column:
    """Without gap marks and white space, upper-case; null becomes empty."""
    return F.upper(F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), r"[.\-\s]", ""))


def is_standard(x: Column | str) -> Column:
    return _c(x).rlike(f"^[{ALPHABET}]+$")


def offending_residues(x: Column | str) -> Column:
    left = F.regexp_replace(_c(x), f"[{ALPHABET}]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(left, ""), lambda c: c != "")))


def first_rejection(rules: dict[str, tuple[str, ...]]) -> Column:
    """The first column, in the rules' order, whose folded value is not among the allowed; null if all pass."""
    return F.coalesce(*(F.when(~folded(c).isin(*allowed), F.lit(c)) for c, allowed in rules.items()))


def percent(x: Column | str) -> Column:
    """'77.1%' or '77.1' to 77.1. Anything else raises, as ANSI casts do."""
    return F.rtrim(F.trim(_c(x).cast("string")), F.lit("%")).cast("double")


def slug(x: Column | str, default: str = "team") -> Column:
    """Lower-case letters and digits joined by single underscores."""
    joined = F.regexp_replace(F.trim(_c(x)), "[^0-9a-zA-Z]+", "_")
    return F.coalesce(F.nullif(F.lower(F.btrim(joined, F.lit("_"))), F.lit("")), F.lit(default))


def first_filled(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(_c(c), F.lit("")) for c in columns), F.lit(""))


def scalarized_weights(name: Column | str) -> Column:
    """'scalarized_0.8_0.2' to [0.8, 0.2]; null where a part is no number or there is none."""
    parts = F.slice(F.split(_c(name), "_"), 2, 100)
    values = F.transform(parts, lambda x: x.try_cast("double"))
    ok = _c(name).startswith("scalarized_") & (F.size(parts) > 0) & ~F.exists(values, lambda v: v.isNull())
    return F.when(ok, values)


def is_known_card(name: Column | str) -> Column:
    return _c(name).isin(*CARDS) | scalarized_weights(name).isNotNull()


def fraction(x: Column | str, letter: str) -> Column:
    """Share of ``letter``; every character counts in the denominator, which is 1 for an empty text."""
    s = _c(x)
    return (F.length(s) - F.length(F.replace(s, F.lit(letter)))).cast("double") / F.greatest(F.length(s), F.lit(1)).cast("double")


def composition(x: Column | str) -> list[Column]:
    """20 shares and the length."""
    return [*(fraction(x, a).alias(f"f_{a.lower()}") for a in ALPHABET), F.length(_c(x)).cast("double").alias("f_len")]


def descriptors(x: Column | str) -> list[Column]:
    """20 shares, mean hydropathy, charge, aromatic share, and length over 100."""
    weigh = lambda scale: reduce(lambda a, b: a + b, (fraction(x, a) * F.lit(float(w)) for a, w in scale.items()))
    return [
        *(fraction(x, a).alias(f"f_{a.lower()}") for a in ALPHABET),
        weigh(HYDROPATHY).alias("hydropathy"),
        weigh(CHARGE).alias("charge"),
        weigh(dict.fromkeys(AROMATIC, 1.0)).alias("aromatic"),
        (F.length(_c(x)).cast("double") / LENGTH_SCALE).alias("scaled_length"),
    ]
