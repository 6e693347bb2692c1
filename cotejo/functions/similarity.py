"""Similarity of titles: the Indel ratio of whole batches as an Arrow UDF, and the rules around it."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cotejo import config
from cotejo.functions import catalogue, text


#: Pairs whose match masks are held at once take so many words of 64 bits.
MASKS = 1 << 22


def codes_of(strings: list[str]) -> np.ndarray:
    """A row of code points for each string, padded with 0."""
    width = max(map(len, strings), default=0)
    return np.array(strings, f"U{max(1, width)}").view(np.uint32).reshape(len(strings), -1)[:, :width]


def _common(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """common_lengths of rows of letter numbers, 0 for none; size: letters of a's rows."""
    n, width = a.shape
    n_words = max(1, (width + 63) // 64)
    masks = np.zeros((n, int(max(a.max(initial=0), b.max(initial=0))) + 1, n_words), np.uint64)
    own = np.arange(n)
    for at in range(width):
        masks[own, a[:, at], at // 64] |= np.uint64(1 << at % 64)
    masks[:, 0] = 0
    free = np.full((n, n_words), ~np.uint64(0))
    for at in range(b.shape[1]):
        hit = masks[own, b[:, at]] & free
        carry = np.zeros(n, np.uint64)
        for w in range(n_words):
            total = free[:, w] + hit[:, w]
            over = total < free[:, w]
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            free[:, w] = total | (free[:, w] - hit[:, w])
    inside = np.clip(size[:, None] - 64 * np.arange(n_words), 0, 64)
    kept = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside % 64).astype(np.uint64)) - np.uint64(1))
    return size - np.bitwise_count(free & kept).sum(1).astype(np.int64)


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a[i] and b[i]: bits for each letter of a, all pairs at once, carries word by word."""
    short, long = ([x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)], [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)])
    sizes = np.array([len(x) for x in short], np.int64)
    out = np.zeros(len(a), np.int64)
    order = np.lexsort(([len(x) for x in long], sizes))
    order = order[sizes[order] > 0]
    i = 0
    while i < len(order):
        part = order[i : i + 4096]
        while True:  # fewer where strings are long or have many letters
            x, y = codes_of([short[k] for k in part]), codes_of([long[k] for k in part])
            letters = np.unique(np.concatenate((x.ravel(), y.ravel(), [0])))  # 0 pads, and stands first
            if len(part) == 1 or len(part) * len(letters) * (x.shape[1] // 64 + 1) <= MASKS:
                break
            part = part[: len(part) // 2]
        numbers = np.searchsorted(letters, x), np.searchsorted(letters, y)
        if any("\0" in short[k] or "\0" in long[k] for k in part):  # a letter like others
            numbers = tuple(np.where(np.arange(c.shape[1]) < np.array([len(s[k]) for k in part])[:, None], c + 1, 0) for c, s in zip(numbers, (short, long), strict=True))
        out[part] = _common(*numbers, sizes[part])
        i += len(part)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised Indel similarities, 0 to 100; two empty strings have 100."""
    n = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, (1 - (n - 2 * common_lengths(a, b)) / n) * 100, 100.0)


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    there = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=range(len(a)), dtype="Float64")
    pairs = pd.DataFrame({"a": a[there].to_numpy(), "b": b[there].to_numpy()})
    once = pairs[(pairs["a"] != pairs["b"])].drop_duplicates()  # rows repeat titles, and equal ones have 100
    known = dict(zip(zip(once["a"], once["b"], strict=True), ratios(once["a"].tolist(), once["b"].tolist()), strict=True))
    out[there] = np.array([known.get(pair, 100.0) for pair in zip(pairs["a"], pairs["b"], strict=True)], np.float64)
    return out


def sorted_words(key: Column) -> Column:
    return F.array_join(F.array_sort(text.words(key)), " ")


def title_similarity(a: Column, b: Column) -> Column:
    """Indel ratio of the titles' sorted words; 0 if one is empty."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(indel_ratio(sorted_words(a), sorted_words(b)))


def _category(key: str) -> str | None:
    if key in config.EXCEPTIONS:
        return None
    found = next((k for k in catalogue.KEYS if f"{key} ".startswith(f"{k} ")), None)
    return config.ALIASES.get(found, found)


def _name(key: str) -> str:
    found = next((k for k in catalogue.KEYS if f"{key} ".startswith(f"{k} ")), "") if key not in config.EXCEPTIONS else ""
    return key[len(found) :].strip()


def _suffix(key: str) -> str | None:
    ws = key.split()
    return ws[-1] if len(ws) > 1 and re.fullmatch(r"[a-z]\d{0,2}", ws[-1]) else None


def _modifiers(key: str) -> set[str]:
    return {m for m in config.MODIFIERS if f" {m} " in f" {key} "}


class Judge:
    """Scores of keys, with what is known of a key kept for the batch."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str | None, str, set[str], str | None, str]] = {}

    def of(self, key: str) -> tuple[str | None, str, set[str], str | None, str]:
        """Category, what follows it, modifiers, suffix, sorted words."""
        if key not in self.known:
            self.known[key] = (_category(key), _name(key), _modifiers(key), _suffix(key), " ".join(sorted(key.split())))
        return self.known[key]

    def judge(self, a: list[str], b: list[str]) -> list[tuple[float, str, str]]:
        """Score (one decimal), level and reason of each two keys: the ratio of their sorted words, less for a conflict of categories, modifiers or suffixes, more for one category.

        A conflict leaves no match, so its reason isn't told.
        """
        out = []
        scores = ratios([self.of(x)[4] for x in a], [self.of(y)[4] for y in b])
        for x, y, score in zip(a, b, scores.tolist(), strict=True):
            if x == y and x:
                out.append((100.0, "normalizada", "Coincidencia exacta tras normalización."))
                continue
            reason = "Similitud de texto."
            score = score if x and y else 0.0
            (ka, _, ma, sa, _), (kb, _, mb, sb, _) = self.of(x), self.of(y)
            if (ka and kb and ka != kb) or ma != mb or (sa and sb and sa != sb):
                score = max(0.0, score - config.PENALTY)
            elif score >= config.BONUS_FROM and ka and ka == kb:
                score = min(100.0, score + config.BONUS)
                reason += f" Ambos son de tipo '{ka}' (bono de confianza aplicado)."
            level = "fuzzy_alta" if score >= config.HIGH else "revision" if score >= config.REVIEW else "sin_coincidencia"
            out.append((round(score, 1), level, reason))
        return out

    def judge_parts(self, a: list[str], b: list[str]) -> list[tuple[float, str, str]]:
        """judge of what follows the category for titles of one known category, else of the whole keys."""
        parts = []
        for x, y in zip(a, b, strict=True):
            (kind, name, *_), (other, also, *_) = self.of(x), self.of(y)
            parts.append((kind, name, also) if kind and kind == other else (None, x, y))
        out = []
        for (kind, x, y), told in zip(parts, self.judge([p[1] for p in parts], [p[2] for p in parts]), strict=True):
            if kind and not x and not y:
                told = 100.0, "normalizada", "Mismo tipo de puesto, sin nombre específico adicional."
            elif kind:
                told = told[0], told[1], f"Mismo tipo de puesto ('{kind}'); comparación por nombre específico ('{x}' vs '{y}'). {told[2]}"
            out.append(told)
        return out


def judge(a: str, b: str) -> tuple[float, str, str]:
    return Judge().judge([a], [b])[0]


def judge_parts(a: str, b: str) -> tuple[float, str, str]:
    return Judge().judge_parts([a], [b])[0]


_RESULT = StructType([StructField("score", DoubleType()), StructField("level", StringType()), StructField("reason", StringType())])


@F.pandas_udf(_RESULT)
def judged(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(Judge().judge_parts(a.fillna("").tolist(), b.fillna("").tolist()), columns=["score", "level", "reason"])


def compare(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with score, level and reason by judge_parts, scored once."""
    result = judged.asNondeterministic()(F.col(a), F.col(b))
    return pairs.withColumn("_result", result).withColumns({"score": F.col("_result.score"), "level": F.col("_result.level"), "reason": F.col("_result.reason")}).drop("_result")


def level_comparison(a: Column, b: Column) -> Column:
    """How two normalised levels compare."""
    no_a, no_b = F.coalesce(a, F.lit("")) == "", F.coalesce(b, F.lit("")) == ""
    return F.when(no_a & no_b, "ambos_faltan").when(no_a, "falta_a").when(no_b, "falta_b").when(a == b, "igual").otherwise("distinto")
