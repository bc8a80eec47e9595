"""Mixing sources to target weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .tokens import token_counts

#: Documents in one stratum of the draw, at most about.
STRATUM = 2000
#: Cells (source and further marginals) the fit takes; more is an error, not a cut.
MOST_CELLS = 100_000


def rake(have: np.ndarray, source: np.ndarray, others: list[np.ndarray], aim: np.ndarray, caps: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Uses per document of each cell, by iterative proportional fitting.

    ``have`` are the cells' tokens, ``source`` and ``others`` their group numbers by marginal, ``aim`` the tokens wanted of
    each source, ``caps`` the most uses by source. The other marginals keep the shares the corpus has. No weight exceeds its
    cap; what a capped cell cannot give, the rest of its source gives; the source marginal is fitted last.
    """
    cap = caps[source]
    w = np.where(have > 0, 1.0, 0.0)

    def to(group: np.ndarray, wanted: np.ndarray, w: np.ndarray) -> np.ndarray:
        for _ in range(50):
            now = np.bincount(group, w * have, len(wanted))
            stuck = w >= cap - 1e-12
            fixed = np.bincount(group, np.where(stuck, w * have, 0), len(wanted))
            loose = now - fixed
            f = np.where(loose > 0, np.maximum(wanted - fixed, 0) / np.maximum(loose, 1e-300), 1.0)
            shrink = np.where(now > 0, wanted / np.maximum(now, 1e-300), 1.0)
            new = np.where(shrink[group] < 1, w * shrink[group], np.where(stuck, w, np.minimum(w * f[group], cap)))
            if np.allclose(new, w, rtol=1e-10, atol=1e-12):
                break
            w = new
        return w

    total = aim.sum()
    usual = [np.bincount(g, have * (aim > 0)[source]) for g in others]
    usual = [u / max(u.sum(), 1e-300) * total for u in usual]
    for _ in range(rounds):
        before = w
        for g, u in zip(others, usual, strict=True):
            w = to(g, u, w)
        w = to(source, aim, w)
        if np.allclose(before, w, rtol=1e-8):
            break
    return w


#: Topics of a document with the words they are known by. Documents carry none of their own, so the topic is lexical.
TOPICS = {
    "reports": ("report", "complaint", "incident"),
    "appeals": ("appeal", "restore", "unban"),
    "policies": ("policy", "guideline", "allowed"),
    "rules": ("rule", "label", "when_all"),
    "operations": ("server", "queue", "deploy", "latency"),
    "accounts": ("account", "login", "password", "user_"),
    "messages": ("message", "chat", "channel", "thread"),
}
MARGINALS = ("lang", "topic")


def topic(text: str | None) -> str:
    """The topic whose words stand in the text most often, in the order of ``TOPICS`` where several do; ``other`` without any."""
    low = (text or "").lower()
    often = {t: sum(map(low.count, words)) for t, words in TOPICS.items()}
    best = max(often, key=often.get)
    return best if often[best] else "other"


def sized(documents: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, source, lang, topic)``, written once to the checkpoint folder, as the fit and the draw both read it."""
    return cut(token_counts(documents, vocab_path, ("source", "lang"), {"topic": topic}))


def plan(sizes: DataFrame, targets: DataFrame, marginals: tuple[str, ...] = MARGINALS, budget: int | None = None) -> tuple[list[tuple], list[tuple]]:
    """Cells with their weights, and per source ``(source, target_share, max_repeats, available, wanted)``.

    Both are of the size of the target table times the values of the marginals, which is checked. The budget is the number
    of tokens to draw, by default those of the whole corpus. A source of the targets without documents gives nothing;
    documents of other or null sources are not drawn. Null marginals are a value of their own.
    """
    goals = targets.where("source is not null").select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).orderBy("source").limit(MOST_CELLS + 1).collect()
    cells = sizes.groupBy("source", *marginals).agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n")).limit(MOST_CELLS + 1).collect()
    if max(len(goals), len(cells)) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: choose coarser marginals")
    budget = sum(c["have"] or 0 for c in cells) if budget is None else budget
    number = {g["source"]: i for i, g in enumerate(goals)}
    own = sorted((c for c in cells if c["source"] in number), key=lambda c: tuple(str(x) for x in c[: 1 + len(marginals)]))
    have = np.array([float(c["have"] or 0) for c in own])
    source = np.array([number[c["source"]] for c in own], dtype=np.int64)
    others = [np.unique([str(c[m]) for c in own], return_inverse=True)[1] for m in marginals] if own else []
    aim = np.array([(g["target_share"] or 0.0) * budget for g in goals])
    caps = np.array([float(max(0, g["max_repeats"] or 0)) for g in goals])
    w = rake(have, source, others, aim, caps) if own else np.empty(0)
    there = np.bincount(source, have, len(goals)) if own else np.zeros(len(goals))
    return (
        [(c["source"], *[c[m] for m in marginals], float(x), max(1, -(-c["n"] // STRATUM))) for c, x in zip(own, w, strict=True)],
        [(g["source"], g["target_share"], g["max_repeats"], int(t), float(a)) for g, t, a in zip(goals, there, aim, strict=True)],
    )


def draw(sizes: DataFrame, cells: list[tuple], marginals: tuple[str, ...] = MARGINALS, seed: int = 7) -> DataFrame:
    """``(doc_id, source, n_tokens, uses)`` of the drawn documents.

    The raked weight of a cell is how often each of its documents is to be used on average: its whole part for certain, the rest
    a probability. The draw that has just these probabilities is systematic: strata of about 2,000 documents (chosen by hash, so a
    source with a third of all documents is spread) are walked in order of size, and a use falls wherever the running
    weight passes a whole number. The drawn tokens thus come close to the wanted ones, no document passes its cap, and the
    draw is the same each time for a seed.
    """
    spark = sizes.sparkSession
    keys = ["source", *marginals]
    kinds = ", ".join(f"`c_{k}` string" for k in keys)
    weights = F.broadcast(spark.createDataFrame(cells, f"{kinds}, weight double, strata bigint"))  # at most MOST_CELLS rows
    on = [F.col(k).cast("string").eqNullSafe(F.col(f"c_{k}")) for k in keys]
    rows = sizes.join(weights, on).withColumn("stratum", F.pmod(F.xxhash64("doc_id"), F.col("strata")))
    order = Window.partitionBy(*keys, "stratum").orderBy(F.desc("n_tokens"), F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    start = (F.pmod(F.xxhash64(*[F.coalesce(F.col(k), F.lit("")) for k in keys], F.col("stratum"), F.lit(seed)), F.lit(1_000_003)) + F.lit(0.5)) / F.lit(1_000_003.0)
    upto = lambda n: F.floor(F.round(F.col("weight") * n + start, 9))
    placed = rows.withColumn("rn", F.row_number().over(order))
    return placed.withColumn("uses", (upto(F.col("rn")) - upto(F.col("rn") - 1)).cast("int")).where("uses > 0").select("doc_id", "source", "n_tokens", "uses")


def mix(documents: DataFrame, targets: DataFrame, vocab_path: str | None = None, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn documents, and per source ``(source, target_share, actual_share, drawn_tokens, available_tokens, falls_short)``.

    ``falls_short`` says that all documents of the source, each used as often as allowed, hold fewer tokens than wanted.
    Empty tables give no drawn documents and a report of zeros.
    """
    sizes = sized(documents, vocab_path)
    cells, sources = plan(sizes, targets, budget=budget)
    drawn = draw(sizes, cells)
    goals = documents.sparkSession.createDataFrame(sources, "source string, target_share double, max_repeats int, available_tokens bigint, wanted double")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("drawn"))
    report = goals.join(got, "source", "left").withColumn("drawn_tokens", F.coalesce("drawn", F.lit(0)).cast("bigint"))
    everything = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))  # over the rows of the target table
    return drawn, report.select(
        "source", "target_share", F.when(everything > 0, F.col("drawn_tokens") / everything).otherwise(0.0).alias("actual_share"), "drawn_tokens", "available_tokens",
        (F.col("available_tokens") * F.coalesce("max_repeats", F.lit(0)) < F.col("wanted")).alias("falls_short"),
    )
