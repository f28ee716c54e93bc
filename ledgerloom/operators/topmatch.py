"""Top-k fuzzy join: for every text the catalog rows that can be among its k best, without a row for each pair.

A word that is in every row pairs everything with everything. Pairs are therefore never written: the asked texts and the
catalog are dealt over a grid of tasks, each with an inverted index of its block of rows, and only the pairs leave a
task that may be among the k best there. Shared words and the characters that two texts have in common bound a pair's
score from above; rows are looked at from the largest bound down, the score that is certain for each of them is
computed, and the search ends where no bound reaches the k-th certain score. Bounds are never below the score, so the
pairs that are left hold each text's k best, ties included; the caller scores and ranks them.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..functions.similarity import indel_ratio, matched_share, numbers_in
from ..functions.text import normalize, normalize_description, tokens

#: Catalog rows of a block, and asked texts of a task.
BLOCK_ROWS, TASK_TEXTS = 20_000, 1_000
#: Characters are counted by their code modulo so many; counts of more than one character are only less strict.
CHARACTERS = 64
#: Scores are rounded to a tenth, twice.
SLACK = 0.2


@dataclass(frozen=True)
class Points:
    """What a score is made of: points for the F1 of words, the sorted-word and the plain ratio, numbers matched by value and
    by digits, for any number in common at most, each shared word and the most for them, the same tax class and another
    one; and whether a text within another has a score of its own."""

    f1: float
    by_word: float
    plain: float
    matched: float
    by_digits: float
    numbers: float
    word: float
    words: float
    tax: float
    other_tax: float
    contained: bool


PRODUCT = Points(48.0, 28.0, 24.0, 0.0, 12.0, 8.0, 3.0, 10.0, 6.0, 0.0, True)
BUDGET = Points(0.48, 22.0, 0.0, 30.0, 0.0, 6.0, 2.5, 10.0, 6.0, 4.0, False)
_DIGITS = re.compile(r"\d+")


def _values(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), 0), parse_number), lambda x: x.isNotNull())


def _blocks(tax: str, *texts: str) -> Column:
    """Words and numbers of the texts, and the tax class: what two sides must share."""
    parts = [f(F.coalesce(F.col(t), F.lit(""))) for f in (tokens, lambda c: numbers_in(normalize(c))) for t in texts]
    return F.array_distinct(F.flatten(F.array(*parts, F.when(F.col(tax) != "", F.array(F.concat(F.lit("ncm:"), F.col(tax)))).otherwise(F.array().cast("array<string>")))))


def _described(rows: DataFrame, tax: str, *texts: str) -> list[Column]:
    """Per text its normal form, distinct words and numbers; and the blocks of the row."""
    out = []
    for i, t in enumerate(texts):
        normal = normalize_description(F.coalesce(F.col(t), F.lit("")))
        out += [normal.alias(f"text{i}"), F.array_distinct(tokens(normal)).alias(f"words{i}"), _values(normal).alias(f"values{i}")]
    return [*out, _blocks(tax, *texts).alias("blocks")]


def _counts(texts: list[str]) -> np.ndarray:
    """How often each text has each character, by code modulo CHARACTERS."""
    out = np.zeros((len(texts), CHARACTERS), np.int16)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64) % CHARACTERS
    np.add.at(out, (np.repeat(np.arange(len(texts)), sizes), codes), 1)
    return out


def _index(lists: list, rows: np.ndarray) -> dict[str, np.ndarray]:
    found: dict[str, list[int]] = {}
    for words, row in zip(lists, rows.tolist(), strict=True):
        for w in words:
            found.setdefault(w, []).append(row)
    return {w: np.array(r, np.int64) for w, r in found.items()}


class Block:
    """The texts of a block of catalog rows, a row having one or two."""

    def __init__(self, rows: pd.DataFrame):
        n = len(rows)
        second = np.flatnonzero(rows["text1"].to_numpy() != "")
        self.row = np.concatenate([np.arange(n), second])
        self.first = np.arange(len(self.row)) < n
        self.texts = [*rows["text0"], *rows["text1"].iloc[second]]
        words = [*rows["words0"], *rows["words1"].iloc[second]]
        self.values = [*rows["values0"], *rows["values1"].iloc[second]]
        self.idx, self.tax = rows["idx"].to_numpy(), rows["row_tax"].to_numpy()[self.row]
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.n_words = np.fromiter(map(len, words), np.int64, len(words))
        self.digits = _index([set(_DIGITS.findall(t)) for t in self.texts], np.arange(len(self.texts)))
        self.chars = _counts(self.texts)
        self.words, self.blocks = _index(words, np.arange(len(words))), _index([rows["blocks"].iloc[i] for i in self.row], np.arange(len(self.row)))
        flat = sorted((float(v), i) for i, vs in enumerate(self.values) for v in vs)
        self.numbers, self.holders = np.array([v for v, _ in flat]), np.array([i for _, i in flat], np.int64)

    def _matched(self, values: list[float]) -> np.ndarray:
        """The share of some numbers that each text may match, each by a number within 0.2 percent."""
        hits = np.zeros(len(self.row))
        for q in values:
            off = max(0.0001, abs(q) * 0.002) + 1e-9
            a, b = np.searchsorted(self.numbers, [q - off, q + off])
            hits[np.unique(self.holders[a:b])] += 1
        return hits / max(1, len(values))

    def best(self, text: str, words: list[str], values: list[float], blocks: list[str], tax: str, p: Points, k: int) -> np.ndarray:
        """Places of the rows that may be among the k best for a text."""
        met = [self.blocks[b] for b in blocks if b in self.blocks]
        if not met:
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(met))
        shared = np.bincount(np.concatenate([np.zeros(0, np.int64), *(self.words[w] for w in words if w in self.words)]), minlength=len(self.row))
        of_row = np.bincount(self.row, shared, len(self.idx))[self.row[at]]
        c, n = shared[at], self.n_words[at]
        f1 = 2.0 * c / np.maximum(1, len(words) + n)
        chars = np.minimum(self.chars[at], _counts([text])[0]).sum(axis=1)
        ratio = 2.0 * chars / np.maximum(1, self.sizes[at] + len(text))
        runs = set(_DIGITS.findall(text))
        hits = np.bincount(np.concatenate([np.zeros(0, np.int64), *(self.digits[d] for d in runs if d in self.digits)]), minlength=len(self.row))[at]
        in_common = p.by_digits * hits / max(1, len(runs))
        covered = self._matched(values)[at]
        over = p.f1 * f1 + (p.by_word + p.plain) * ratio + p.matched * covered
        if p.matched and values:
            over -= np.where(covered < 0.5, 12.0, np.where(covered < 1, 5.0, 0.0))
        if p.contained:  # a text within another shares all its words but those at its ends
            for i in np.flatnonzero(c >= np.minimum(len(words), n) - 2).tolist():
                if text in self.texts[at[i]] or self.texts[at[i]] in text:
                    over[i] = max(over[i], min(97.0, 72 + f1[i] * 25))
        over = np.where((chars == len(text)) & (self.sizes[at] == len(text)), 100.0, np.minimum(100.0, over + in_common))
        over += p.numbers * (hits > 0) + np.minimum(p.words, p.word * of_row) + p.tax * ((tax != "") & (self.tax[at] == tax)) + SLACK
        sorted_text = " ".join(sorted(text.split()))
        certain: dict[int, float] = {}
        order, least = np.argsort(-over, kind="stable"), -1e9
        for seen, i in enumerate(order.tolist()):
            if seen % 4 == 0 and len(certain) >= k:
                least = heapq.nlargest(k, certain.values())[-1]
            if over[i] < least:
                break
            j = at[i]
            other = self.texts[j]
            if other == text:
                low = 100.0
            else:
                by_word, plain = indel_ratio(sorted_text, " ".join(sorted(other.split()))), indel_ratio(text, other) if p.plain else 0.0
                low = p.f1 * f1[i] + (p.by_word * by_word + p.plain * plain) / 100 + in_common[i]
                if p.matched:
                    covered = matched_share(values, self.values[j])
                    low += p.matched * covered - (12.0 if values and covered < 0.5 else 5.0 if values and covered < 1 else 0.0)
            low = min(100.0, max(0.0, low)) + (min(p.words, p.word * c[i]) if self.first[j] else 0.0) - p.other_tax * ((tax != "") & (self.tax[j] != "") & (self.tax[j] != tax))
            certain[self.row[j]] = max(certain.get(self.row[j], -1e9), min(100.0, low) - SLACK)
        if len(certain) >= k:
            least = heapq.nlargest(k, certain.values())[-1]
        return np.unique(self.row[at[over >= least]])


def best_pairs(items: DataFrame, catalog: DataFrame, points: Points, k: int, block_rows: int = BLOCK_ROWS, task_texts: int = TASK_TEXTS) -> DataFrame:
    """(item_id, idx): for each of items(item_id, description, ncm) the catalog rows(idx, d1, d2, row_ncm) that share a word,
    a number or the tax class with it and may be among its k best.

    Equal items are asked once. Null descriptions and tax classes are empty."""
    asked = items.select("item_id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("ncm", F.lit("")).alias("ncm"))
    kinds = asked.select("description", "ncm").distinct()
    blocks, parts = (1 + (df.count() - 1) // size if size else 1 for df, size in ((catalog, block_rows), (kinds, task_texts)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))

    left = kinds.select("description", "ncm", *_described(kinds, "ncm", "description"), F.pmod(F.xxhash64("description", "ncm"), F.lit(max(1, parts))).cast("int").alias("part")).withColumn("block", every(blocks))
    rows = catalog.withColumn("row_tax", F.coalesce("row_ncm", F.lit("")))
    right = rows.select("idx", "row_tax", *_described(rows, "row_tax", "d1", "d2"), F.pmod(F.xxhash64("idx"), F.lit(max(1, blocks))).cast("int").alias("block")).withColumn("part", every(parts))

    def run(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(own) and len(other):
            block = Block(other)
            for r in own.itertuples(index=False):
                for i in block.best(r.text0, list(r.words0), [float(v) for v in r.values0], list(r.blocks), r.ncm, points, k).tolist():
                    found.append((r.description, r.ncm, block.idx[i]))
        return pd.DataFrame(found, columns=["description", "ncm", "idx"])

    pairs = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, f"description string, ncm string, idx {dict(catalog.dtypes)['idx']}")
    return asked.join(pairs, ["description", "ncm"]).select("item_id", "idx")
