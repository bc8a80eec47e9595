"""Repetition inside a single document.

A logistic regression on the repetition of hashed word and character n-grams scores every document, with calibrated probabilities.
Documents from a fixed probability on are counted exactly, as the share of words said before is defined by an exact count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import hashed_sample
from .logistic import Logistic

#: Words of the stretches that count as said again.
STRETCH = 5
#: Share of words in such stretches from which a document is repetitive.
LIMIT = 0.3
#: Probability from which a document is counted exactly; far below any decision, so that none is lost.
PROPOSE = 0.002
#: Most documents the regression is fitted on, those of the smallest hashes.
FIT_ROWS = 4000
#: Words and characters in the hashed n-grams whose repetition is the regression's input.
WORD_ORDERS = (1, 2, 3, 5, 8)
CHAR_ORDERS = (32,)
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Words without letter case, punctuation and spacing."""
    return _WORD.findall(text.casefold())


def repeated_share(words: list[str], n: int = STRETCH) -> float:
    """Share of words standing in a stretch of n or more words that was said earlier in the same list; 0 when there are fewer than n."""
    total = len(words)
    seen: set[tuple[str, ...]] = set()
    covered, upto = 0, 0
    for i in range(total - n + 1):
        gram = tuple(words[i : i + n])
        if gram in seen:
            covered += i + n - max(i, upto)
            upto = i + n
        else:
            seen.add(gram)
    return covered / total if total else 0.0


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _again(codes: np.ndarray, orders: tuple[int, ...]) -> list[float]:
    """For each order, the shares of the hashed n-grams of a code sequence that occurred before, and that occurred twice before.

    Grams of 2n come from pairs of n.
    """
    by: dict[int, np.ndarray] = {1: codes}

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a[: len(b)] * _MIX + b) * _MIX
        return h ^ (h >> np.uint64(29))

    def of(n: int) -> np.ndarray:
        if n not in by:
            k = 1 << ((n - 1).bit_length() - 1)  # the largest power of two below n
            by[n] = pair(of(k), of(n - k)[k:]) if len(codes) >= n else codes[:0]
        return by[n]

    out = []
    for n in orders:
        h = np.sort(of(n))
        same = h[1:] == h[:-1]
        out += [np.count_nonzero(same) / len(h), np.count_nonzero(same[1:] & same[:-1]) / len(h)] if len(h) > 1 else [0.0, 0.0]
    return out


def features(text: str, words: list[str]) -> list[float]:
    """Shares of repeated hashed n-grams, of words by order and of characters by order, and the text's size."""
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    chars = np.frombuffer(text.casefold().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    return [*_again(codes, WORD_ORDERS), *_again(chars, CHAR_ORDERS), float(np.log1p(len(words)))]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(words_of(t or ""), t or "") for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([repeated_share(w) for w, _ in rows], type=pa.float64()), pa.array([features(t, w) for w, t in rows], type=pa.list_(pa.float64()))], names=["share", "x"])


def fit(documents: DataFrame, rows: int = FIT_ROWS) -> Logistic | None:
    """The regression, fitted on at most ``rows`` documents whose labels are their exact shares; None where one class is missing."""
    sample = documents.where("text is not null").select("doc_id", "text")
    sample = hashed_sample(sample, rows, "doc_id").select("text")
    found = sample.mapInArrow(_measure, "share double, x array<double>").collect()
    if not found:
        return None
    return Logistic.fit(np.array([r["x"] for r in found]), np.array([float(r["share"] >= LIMIT) for r in found]))


_OUT = "doc_id bigint, n_words bigint, probability double, repeated_share double"


def _scorer(model: Logistic | None, everything: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            words = [words_of(t) for t in texts]
            if model is None or not texts:
                p = np.ones(len(texts))
            else:
                p = model.probability(np.array([features(t, w) for t, w in zip(texts, words, strict=True)]))
            share = [repeated_share(w) if everything or q >= PROPOSE else None for w, q in zip(words, p, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in words], type=pa.int64()), pa.array(p, type=pa.float64()), pa.array(share, type=pa.float64())], names=["doc_id", "n_words", "probability", "repeated_share"]
            )

    return run


def measure(documents: DataFrame, everything: bool = True, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, n_words, probability, repeated_share)`` of every document.

    ``probability`` is the calibrated score of the regression; ``repeated_share`` is exact, and with ``everything`` off
    it is counted only for proposed documents and null for the rest. Null, empty and blank texts have no words and a share
    of 0. Repeated rows are measured as often as they come; whole texts are read, whatever their length. No shuffle.
    """
    model = fit(documents, fit_rows)
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_scorer(model, everything), _OUT)


def repetitive(documents: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``(doc_id)`` of the documents of which at least ``limit`` of the words were said before."""
    return measure(documents, everything=False).where(F.col("repeated_share") >= limit).select("doc_id").distinct()
