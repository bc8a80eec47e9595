"""Abusive, hateful or sexual content: disguised words are restored, then the restored text is scored per category."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, hashed_sample
from .logistic import _newton
from .restore import Restorer, word_counts

CATEGORIES = ("abusive", "hateful", "sexual")
_CLASSES = ("none", *CATEGORIES)
#: Calibrated probability from which a category applies: above one half, as some labels are wrong and no model can be surer than they are.
LIMIT = 0.55
#: Most labelled messages the scorer is fitted on, those of the smallest hashes.
FIT_LABELS = 30_000
#: Share of all words from which a word is in the dictionary. Shares add up to 1, so it has at most 1 / LEAST_SHARE words.
LEAST_SHARE = 1e-6
#: Most rows a term or group list may have: both are sent to every executor.
MOST_TERMS = 100_000

_SPLIT = re.compile(r"(?<=[.!?…])\s+|\n+|\s+-\s+|;\s+|!!+|\.\.\.+")
_TOKEN = re.compile(r"@\w[\w.\-]*|user_?\d+|\d[\d.,:]*|[^\W\d_]+(?:['’][^\W\d_]+)?|[\"'‘’“”«»]|\?")


#: A message whose likeliest stretch for its category stays under the first has a wrong label and stands for nothing; so does one
#: labelled none with a whole segment above the second.
DOUBT, BELIEF = 0.2, 0.95
#: Share of the labelled messages that must hold a feature to be learned from, and their least number.
LEAST, FEWEST = 1 / 1500, 3
#: Words of a segment up to which it is one sentence, and so of one category.
SENTENCE = 14
#: Words in the windows that are scored beside whole segments, as sentences may follow each other without a mark.
WINDOWS = (5, 8, 12)


class Scorer:
    """Softmax regression on word n-grams of segments and their windows, fitted from labelled messages whose labels may be wrong."""

    def __init__(self, restorer: Restorer, terms: list[tuple[str, str, int]], groups: list[str]):
        self.restorer = restorer
        self.terms = {t.lower(): f"#{c}{w}" for t, c, w in terms if t}
        stems = sorted({g.lower().rstrip("s") for g in groups if g}, key=len, reverse=True)
        self.groups = re.compile(r"\b(?:" + "|".join(map(re.escape, stems)) + r")\w{0,2}\b") if stems else None
        self.number: dict[str, int] = {}  # of the features the labelled messages have; 0 is any other
        self.weights = np.zeros((1, len(_CLASSES)))
        self.bias = np.zeros(len(_CLASSES))
        self.fitted = False
        self.calibration = np.array([[1.0, 0.0]] * len(CATEGORIES))
        self.seen: dict[str, np.ndarray] = {}

    def segments(self, text: str) -> list[str]:
        """The text's sentences, restored; repeats once."""
        return list(dict.fromkeys(s for s in (x.strip() for x in _SPLIT.split(self.restorer.restore(text))) if s))

    def words(self, segment: str) -> list[str]:
        """Words with group names, handles and numbers in one form each."""
        if self.groups:
            segment = self.groups.sub("ggroup", segment)
        return ["0" if w[0].isdigit() else "@" if w[0] == "@" or w.startswith("user_") else w for w in _TOKEN.findall(segment)]

    def grams(self, segment: str, learn: bool = False) -> np.ndarray:
        """Feature numbers by place: word, listed term, pair and triple that begin there. Learning gives new features a number."""
        words = self.words(segment)
        n = len(words)
        out = np.zeros((n, 4), dtype=np.int64)
        of = (lambda f: self.number.setdefault(f, len(self.number) + 1)) if learn else (lambda f: self.number.get(f, 0))
        for i, w in enumerate(words):
            out[i, 0] = of(w)
            if w in self.terms:
                out[i, 1] = of(self.terms[w])
            if i + 1 < n:
                out[i, 2] = of(f"{w} {words[i + 1]}")
                if i + 2 < n:
                    out[i, 3] = of(f"{w} {words[i + 1]} {words[i + 2]}")
        return out

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def spans(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(segment, from, to, probabilities)`` of all segments and of their windows, by running sums of the weights."""
        sizes = np.array([len(g) for g in grams], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(grams) if len(grams) and first[-1] else np.zeros((0, 4), dtype=np.int64)
        run = [np.vstack([np.zeros((1, len(_CLASSES))), np.cumsum(self.weights[c], axis=0)]) for c in ([flat[:, 0]], [flat[:, 2]], [flat[:, 3]]) for c in c]
        run[0][1:] += np.cumsum(self.weights[flat[:, 1]], axis=0)
        of = np.repeat(np.arange(len(grams)), sizes)
        a, b, seg = [first[:-1]], [first[1:]], [np.arange(len(grams))]
        for n in WINDOWS:
            at = np.arange(len(of))
            ok = at + n <= first[of + 1] if len(of) else np.zeros(0, dtype=bool)
            ok &= (sizes[of] > n) if len(of) else ok
            a.append(at[ok])
            b.append(at[ok] + n)
            seg.append(of[ok])
        a, b, seg = np.concatenate(a), np.concatenate(b), np.concatenate(seg)
        z = run[0][b] - run[0][a] + self.bias
        for k in (1, 2):
            z += run[k][np.maximum(b - k, a)] - run[k][a]
        return seg, a - first[seg], b - first[seg], self._soft(z)

    def probabilities(self, segments: list[str]) -> np.ndarray:
        """Per segment the highest probability of each category over itself and its windows, categories in stretches apart."""
        return self._best([self.grams(s) for s in segments])

    def _best(self, grams: list[np.ndarray]) -> np.ndarray:
        n, best = len(grams), np.zeros((len(grams), len(CATEGORIES)))
        if not n:
            return best
        seg, a, b, p = self.spans(grams)
        p = p[:, 1:]
        free = np.ones(len(seg), dtype=bool)
        left = np.ones((n, len(CATEGORIES)), dtype=bool)
        for _ in CATEGORIES:  # the likeliest category takes its shortest stretch; the next must be found outside it
            top = np.zeros((n, len(CATEGORIES)))
            np.maximum.at(top, seg[free], p[free])
            top = np.where(left, top, -1)
            c = top.argmax(axis=1)
            high = top[np.arange(n), c]
            best[np.arange(n), c] = np.maximum(best[np.arange(n), c], np.maximum(high, 0))
            left[np.arange(n), c] = False
            fits = free & (p[np.arange(len(seg)), c[seg]] >= 0.9 * high[seg])
            order = np.flatnonzero(fits)
            order = order[np.lexsort((-p[order, c[seg[order]]], b[order] - a[order], seg[order]))]
            _, one = np.unique(seg[order], return_index=True)
            lo, hi = np.full(n, 0), np.full(n, 1 << 40)
            lo[seg[order[one]]], hi[seg[order[one]]] = a[order[one]], b[order[one]]
            free &= (b <= lo[seg]) | (a >= hi[seg])
        return best

    def score_batch(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each category for every text, that of its likeliest stretch; zeros for null, empty and blank text."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        if not self.fitted:
            return out
        if len(self.seen) > 200_000:
            self.seen.clear()
        parts = [self.segments(t) if t else [] for t in texts]
        new = list(dict.fromkeys(s for segs in parts for s in segs if s not in self.seen))
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]
            self.seen.update(zip(some, self.probabilities(some), strict=True))
        for i, segs in enumerate(parts):
            for s in segs:
                np.maximum(out[i], self.seen[s], out=out[i])
        return self._calibrated(out)

    def _calibrated(self, p: np.ndarray) -> np.ndarray:
        """Of messages' highest probabilities, what they are worth by messages the model has not seen; 0 stays 0."""
        z = np.clip(_logit(p) * self.calibration[:, 0] + self.calibration[:, 1], -30, 30)
        return np.where(p > 0, 1 / (1 + np.exp(-z)), 0.0)

    def _train(self, bags: list[np.ndarray], y: np.ndarray, ridge: float, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weights and bias, from zero or carried on from those of the round before."""
        full = [i for i, bag in enumerate(bags) if len(bag)]
        bags, y = [bags[i] for i in full], y[full]
        k = len(_CLASSES)
        if not bags:
            return np.zeros((len(self.number) + 1, k)), np.zeros(k)
        sizes = np.array([len(i) for i in bags])
        rows, first = np.repeat(np.arange(len(bags)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        used, cols, often = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
        by_col = rows[np.argsort(cols, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(often)[:-1]])
        aim = np.eye(k, dtype=np.float32)[y]
        w, b = (start[0][used].astype(np.float32), start[1].astype(np.float32)) if start else (np.zeros((len(used), k), dtype=np.float32), np.log(aim.mean(axis=0) + 1e-3))
        gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        for _ in range(60 if start else 120):  # Adagrad over all rows at once
            d = self._soft(np.add.reduceat(w.take(cols, axis=0), first, axis=0) + b) - aim
            g = np.add.reduceat(d.take(by_col, axis=0), begin, axis=0) + ridge * w
            gw += g * g
            gb += d.sum(axis=0) ** 2
            w -= 0.5 * g / np.sqrt(gw)
            b -= 0.5 * d.sum(axis=0) / np.sqrt(gb)
        weights = np.zeros((len(self.number) + 1, k))
        weights[used] = w
        weights[0] = 0
        return weights, b

    @staticmethod
    def _bag(g: np.ndarray, a: int, b: int) -> np.ndarray:
        """Feature numbers of the stretch from word a to b."""
        f = np.concatenate([g[a:b, 0], g[a:b, 1], g[a : max(a, b - 1), 2], g[a : max(a, b - 2), 3]])
        return f[f > 0]

    def _chosen(self, grams: list[np.ndarray], whole: list[np.ndarray], label: np.ndarray, own: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """What stands for some messages under the present weights: bags of features and their classes."""
        seg, a, b, p = self.spans(grams)
        likeliest = np.zeros(own.max() + 1 if len(own) else 0)
        np.maximum.at(likeliest, own, p[: len(grams), 1:].max(axis=1))  # of whole segments, which come first
        calm = np.flatnonzero((label == 0) & (likeliest[own] < BELIEF))
        bags, ys = [whole[i] for i in calm], [0] * len(calm)
        kept, size = np.zeros(len(grams), dtype=bool), np.array([len(g) for g in grams])
        kept[calm] = True

        def top(of: np.ndarray, c: int) -> np.ndarray:
            order = of[np.lexsort((a[of] - b[of], -p[of, c], own[seg[of]]))]
            return order[np.unique(own[seg[order]], return_index=True)[1]]

        earned = {c: top(np.flatnonzero(label[seg] == c), c) for c in range(1, len(_CLASSES))}
        earned = {c: i[p[i, c] >= DOUBT] for c, i in earned.items()}
        for c in range(1, len(_CLASSES)):
            for i in earned[c]:
                bags.append(self._bag(grams[seg[i]], a[i], b[i]))
                ys.append(c)
            for y in (k for k in range(len(_CLASSES)) if k != c):  # what is most wrongly taken for c
                of = np.flatnonzero(kept[seg] if y == 0 else np.isin(seg, seg[earned[y]]))
                wrong = of[(p[of, c] > 0.1) & ((y == 0) | (size[seg[of]] <= SENTENCE))]
                for i in np.union1d(top(of, c), wrong):
                    if p[i, c] > 0.02 and b[i] - a[i] < len(grams[seg[i]]):
                        bags.append(self._bag(grams[seg[i]], a[i], b[i]))
                        ys.append(y)
        return bags, ys

    def fit(self, rows: list[tuple[str | None, str | None]], rounds: int = 5, ridge: float = 0.5) -> Scorer:
        """Fits on ``(text, category)``; of a message with a category only the stretch that fits it best stands for it.

        First every segment carries its message's label. Then, round by round, a labelled message is represented by its likeliest
        segment or window; messages labelled none count with all their segments and with the windows most wrongly taken for each
        category, and the segment that earned another label with the window most wrongly taken for a third. What stands for a
        message, and whether its label is believed at all (``DOUBT``, ``BELIEF``), is judged by a model that has not seen it:
        each half of the messages by the model of the other. The scorer is the mean of the two, so that what one half has by wrong
        labels counts half; its probabilities are calibrated on the messages each has not seen. Rows without a known category are
        left out.
        """
        number = {c: i for i, c in enumerate(_CLASSES)}
        texts = [(self.segments(t), number[c]) for t, c in rows if t and c in number]
        texts = [(s, y) for s, y in texts if s]
        if len({y for _, y in texts}) < 2:
            return self
        own = np.array([k for k, (segs, _) in enumerate(texts) for _ in segs])
        grams = [self.grams(s, learn=True) for segs, _ in texts for s in segs]
        count = np.bincount(np.concatenate([np.unique(g) for g in grams]), minlength=len(self.number) + 1)
        common = np.where(count >= max(FEWEST, LEAST * len(texts)), np.arange(len(count)), 0)  # what stands in a few segments only is not learned from
        grams = [common[g] for g in grams]
        label = np.array([texts[k][1] for k in own])
        whole = [self._bag(g, 0, len(g)) for g in grams]
        halves = [np.flatnonzero(own % 2 == k) for k in (0, 1)]
        pick = lambda xs, at: [xs[i] for i in at]
        bags = [(pick(whole, h), label[h].tolist()) for h in halves]
        models: list = [None, None]
        for n in range(rounds):
            models = [self._train(b, np.array(y, dtype=np.int64), ridge, m) for (b, y), m in zip(bags, models, strict=True)]
            for k, h in enumerate(halves if n < rounds - 1 else ()):
                self.weights, self.bias = models[1 - k]
                bags[k] = self._chosen(pick(grams, h), pick(whole, h), label[h], own[h]) if len(h) else ([], [])
        high = np.zeros((len(texts), len(CATEGORIES)))
        for k in (0, 1):
            self.weights, self.bias = models[1 - k]
            np.maximum.at(high, own[halves[k]], self._best(pick(grams, halves[k])))
        self.weights, self.bias = (models[0][0] + models[1][0]) / 2, (models[0][1] + models[1][1]) / 2
        labels = np.array([y for _, y in texts])
        for c in range(len(CATEGORIES)):
            of = (labels == c + 1) | (labels == 0)  # a message of another label may be of this category as well
            if len(set(labels[of])) == 2:
                self.calibration[c] = _platt(_logit(high[of, c]), labels[of] == c + 1)
        self.fitted, self.seen = True, {}
        return self


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make probabilities of logits; the slope is at most 1, as it is to take back certainty, not to add any."""
    slope, shift = _newton(z[:, None], y.astype(float), np.ones(len(z)), 1e-3)
    if slope > 1:
        low, high = -30.0, 30.0
        for _ in range(50):
            shift = (low + high) / 2
            low, high = (shift, high) if (1 / (1 + np.exp(-np.clip(z + shift, -30, 30)))).mean() < y.mean() else (low, shift)
    return float(np.clip(slope, 1e-3, 1.0)), float(shift)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _bounded(df: DataFrame, most: int, what: str) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = word_counts(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])


def dictionary(texts: DataFrame, share: float = LEAST_SHARE) -> dict[str, int]:
    """Counts of the words of all messages: those said more than once that make at least ``share`` of all words."""
    counted = cut(texts.where("text is not null and text <> ''").select("text").mapInArrow(_word_batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: r["n"] for r in counted.where((F.col("n") > 1) & (F.col("n") >= share * total)).collect()}


def lexicon(rows: Iterable[tuple[str, str]]) -> list[str]:
    """Words of at least three messages that are labelled with a category: those whose misspellings are looked for."""
    return [w for w, n in Counter(w for t, c in rows if c in CATEGORIES for w in set(word_counts([t]))).items() if n >= FEWEST]


def fit(texts: DataFrame, labels: DataFrame, terms: DataFrame, groups: DataFrame, label_rows: int = FIT_LABELS) -> Scorer:
    """The scorer, fitted on the driver from at most ``label_rows`` labelled messages, by hash of id, and the words of all messages."""
    known = [(r["term"], r["category"], r["weight"]) for r in _bounded(terms.where("term is not null"), MOST_TERMS, "terms")]
    names = [r["group_name"] for r in _bounded(groups.where("group_name is not null"), MOST_TERMS, "groups")]
    some = labels.where("id is not null and category is not null").select("id", "category")
    some = hashed_sample(some, label_rows, "id", "category")
    one = texts.where("text is not null and text <> ''").select("id", "text")
    # the labels are at most label_rows ids, so they are broadcast and no message is shuffled for them
    labelled = one.join(F.broadcast(some), "id").groupBy("id", "category").agg(F.min("text").alias("text")).orderBy("id", "category").collect()
    restorer = Restorer([], [t for t, _, _ in known] + names, dictionary(one), lexicon((r["text"], r["category"]) for r in labelled))
    return Scorer(restorer, known, names).fit([(r["text"], r["category"]) for r in labelled])


def scores(texts: DataFrame, labels: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``(id, abusive, hateful, sexual)``: the probability of each category for every row of ``texts(id, text)``.

    Null, empty and blank texts score 0; without labels of two categories all score 0. Repeated rows are scored as often as
    they come; extra columns are ignored; whole texts are read. No shuffle but for the fit's bounded sample and the counts of words: the fitted
    scorer (bounded by its parameters) is broadcast and texts are scored in the Arrow batches they are read in.
    """
    shared = texts.sparkSession.sparkContext.broadcast(fit(texts, labels, terms, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = shared.value
        for b in batches:
            got = scorer.score_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, i], pa.float64()) for i in range(len(CATEGORIES)))], names=["id", *CATEGORIES])

    return texts.select(F.col("id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "id bigint, " + ", ".join(f"{c} double" for c in CATEGORIES))


def found(scored: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``(id, category)``, one row per message and category that applies."""
    pairs = F.array(*[F.when(F.col(c) >= limit, F.lit(c)) for c in CATEGORIES])
    return scored.select("id", F.explode(F.array_compact(pairs)).alias("category")).distinct()


def rates(scored: DataFrame, sources: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``(client_source, n_messages, abusive_rate, hateful_rate, sexual_rate)``, each message once; null is a source of its own.

    ``sources(id, client_source)``; a message counts for its least source should copies differ.
    """
    flags = scored.groupBy("id").agg(*[F.max((F.col(c) >= limit).cast("int")).alias(c) for c in CATEGORIES])
    own = sources.where("id is not null").groupBy("id").agg(F.min("client_source").alias("client_source"))
    return own.join(flags, "id").groupBy("client_source").agg(F.count("*").alias("n_messages"), *[F.avg(c).alias(f"{c}_rate") for c in CATEGORIES])
