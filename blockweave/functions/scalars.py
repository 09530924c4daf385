"""Column functions of the genetics tables; all stay in the JVM but the normal tail."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from blockweave.functions.kernels import log_normal_tail


def chromosome(c: Column) -> Column:
    """Chromosome number of '7' or 'chr7'; anything else raises under ANSI mode."""
    return F.regexp_replace(c.cast("string"), "(?i)^chr", "").cast("double")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def allele_phase(anc: Column, deriv: Column, ref: Column, alt: Column) -> Column:
    """+1 same alleles, -1 swapped, 0 different, null when both of ref and alt are missing; case is ignored."""
    a, d, r, t = (F.lower(c) for c in (anc, deriv, ref, alt))
    same, swapped = (a == r) & (d == t), (a == t) & (d == r)
    return F.when(ref.isNull() & alt.isNull(), F.lit(None).cast("int")).when(same, 1).when(swapped, -1).otherwise(0)


def softplus(x: Column) -> Column:
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def link(eta: Column, denominator: float = 6e6) -> Column:
    """Variance per variant from the linear predictor."""
    return softplus(eta) / F.lit(float(denominator))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def heterozygosity(p: Column) -> Column:
    return 2 * p * (1 - p)


def phased_frequency(phase: Column, af: Column) -> Column:
    return (1 - phase) / 2 + phase * af


def soft_threshold(x: Column, gamma: Column) -> Column:
    return F.signum(x) * F.greatest(F.lit(0.0), F.abs(x) - gamma) + F.lit(0.0)  # no negative zero


def odds(p: Column) -> Column:
    return p / (1 - p)


def rule_one(a: Column, b: Column) -> Column:
    """Weight between a brick and its parent or child."""
    return F.abs(F.log(odds(a) / odds(b)))


def rule_two(a: Column, b: Column) -> Column:
    """Weight between sibling bricks."""
    return F.abs(F.log(odds(a) * odds(b)))


@F.pandas_udf(DoubleType())
def log10_two_sided_p(z: pd.Series) -> pd.Series:
    """log10 of the two-sided normal p value of z; null stays null."""
    out = pd.Series(np.nan, index=z.index)
    ok = z.notna()
    out[ok] = (math.log(2) + log_normal_tail(z[ok].abs().to_numpy())) / math.log(10)
    return out.astype("float64").where(ok, None)


@F.pandas_udf(DoubleType())
def log10_chi2_tail(t: pd.Series) -> pd.Series:
    """log10 of the upper tail of the chi-square distribution with one degree of freedom; null stays null."""
    out = pd.Series(np.nan, index=t.index)
    ok = t.notna()
    out[ok] = (math.log(2) + log_normal_tail(np.sqrt(t[ok].clip(lower=0).to_numpy()))) / math.log(10)
    return out.astype("float64").where(ok, None)


def per_allele(weight: Column, af: Column) -> Column:
    """Weight per standard deviation as one per allele."""
    return F.try_divide(weight, F.sqrt(heterozygosity(af)))


def per_deviation(weight: Column, af: Column) -> Column:
    """Weight per allele as one per standard deviation."""
    return weight * F.sqrt(heterozygosity(af))


def similarity(distance: Column) -> Column:
    return 1 / (distance + 1)


def metadata_text(json: Column, key: str) -> Column:
    """A text value of JSON metadata; other kinds of values count as missing."""
    return F.when(json.rlike(f'"{key}"\\s*:\\s*"'), F.get_json_object(json, f"$.{key}"))


def id_list(text: Column) -> Column:
    """Numbers of a list joined by semicolons; an empty or missing text is an empty list."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
