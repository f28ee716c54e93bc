"""String similarity for catalog matching, in Arrow batches.

ratio() is 100 * 2 * LCS / (len a + len b), the normalised insert-and-delete similarity; the token variants
and weighted_ratio() follow their public definitions. Comparisons are made for already blocked pairs only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .numbers import parse_number
from .text import normalize_description, tokens


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel: one addition per character of b."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for ch in b:
        hit = state & where.get(ch, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_set(a: str, b: str) -> float:
    """Best ratio among the shared tokens and each side's shared-plus-own tokens."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = sorted(left & right), sorted(left - right), sorted(right - left)
    if both and not (only_a and only_b):
        return 100.0
    shared, rest_a, rest_b = " ".join(both), " ".join(only_a), " ".join(only_b)
    full_a, full_b = f"{shared} {rest_a}".strip(), f"{shared} {rest_b}".strip()
    best = indel_ratio(full_a, full_b)
    return max(best, indel_ratio(shared, full_a), indel_ratio(shared, full_b)) if both else best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of its length in the longer one, cut ones at the ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 100.0
    n = len(short)
    return max(indel_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def weighted(a: str, b: str) -> float:
    """ratio(), or the token ratios at 0.95, or partial ratios where one text is much longer."""
    if not a or not b:
        return 0.0
    size = max(len(a), len(b)) / min(len(a), len(b))
    best = indel_ratio(a, b)
    sort_a, sort_b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if size < 1.5:
        return max(best, 0.95 * max(indel_ratio(sort_a, sort_b), token_set(a, b)))
    scale = 0.9 if size <= 8 else 0.6
    shared = set(a.split()) & set(b.split())
    return max(best, scale * partial(a, b), 0.95 * scale * (100.0 if shared else partial(sort_a, sort_b)))


def _pairwise(score):
    @pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def _sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda t: t != "")), " ")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    return _pairwise(indel_ratio)(_col(a), _col(b))


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    return ratio(_sorted_tokens(_col(a)), _sorted_tokens(_col(b)))


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    return _pairwise(token_set)(_col(a), _col(b))


def weighted_ratio(a: Column | str, b: Column | str) -> Column:
    return _pairwise(weighted)(_col(a), _col(b))


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of the shares of distinct tokens in common; a and b are token arrays."""
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(sa, sb))
    cover, precise = common / F.greatest(F.lit(1), F.size(sa)), common / F.greatest(F.lit(1), F.size(sb))
    return 2 * cover * precise / F.greatest(F.lit(0.001), cover + precise)


def numbers_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), 0))


def description_score(a: Column | str, b: Column | str) -> Column:
    """0 to 100: token F1, sorted-token and plain ratio, containment, and numbers in common."""
    na, nb = normalize_description(F.coalesce(_col(a), F.lit(""))), normalize_description(F.coalesce(_col(b), F.lit("")))
    ta, tb = tokens(na), tokens(nb)
    f1 = token_f1(ta, tb)
    score = f1 * 48 + token_sort_ratio(na, nb) * 0.28 + ratio(na, nb) * 0.24
    inside = (F.size(ta) >= 3) & (F.size(tb) >= 3) & (F.contains(na, nb) | F.contains(nb, na))
    score = F.when(inside, F.greatest(score, F.least(F.lit(97.0), 72 + f1 * 25))).otherwise(score)
    qa, qb = numbers_in(na), numbers_in(nb)
    extra = F.when((F.size(qa) > 0) & (F.size(qb) > 0), F.size(F.array_intersect(qa, qb)) / F.greatest(F.size(qa), F.lit(1)) * 12).otherwise(0.0)
    return F.when((na == "") | (nb == ""), 0.0).when(na == nb, 100.0).otherwise(F.round(F.least(F.lit(100.0), score + extra), 1))


def matched_share(left, right) -> float:
    """Share of the left numbers that find a right number within 0.2 percent, each used once, nearest first."""
    free, hits = list(right), 0
    for q in left:
        if free:
            near = min(range(len(free)), key=lambda j: (abs(q - free[j]), j))
            if abs(q - free[near]) <= max(0.0001, abs(q) * 0.002):
                hits += 1
                del free[near]
    return hits / max(1, len(left))


@pandas_udf(DoubleType())
def _numbers_matched(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([matched_share(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def budget_score(a: Column | str, b: Column | str) -> Column:
    """0 to 100 for budget lines, where measures weigh most.

    The token F1 counts 0.48 at most, so only equal texts come near 100."""
    na, nb = normalize_description(F.coalesce(_col(a), F.lit(""))), normalize_description(F.coalesce(_col(b), F.lit("")))

    def values(c: Column) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), 0), parse_number), lambda x: x.isNotNull())

    qa = values(na)
    covered = _numbers_matched(qa, values(nb))
    loss = F.when((F.size(qa) > 0) & (covered < 0.5), 12.0).when((F.size(qa) > 0) & (covered < 1.0), 5.0).otherwise(0.0)
    score = token_f1(tokens(na), tokens(nb)) * 0.48 + token_sort_ratio(na, nb) * 0.22 + covered * 30 - loss
    return F.when((na == "") | (nb == ""), 0.0).when(na == nb, 100.0).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 1))
