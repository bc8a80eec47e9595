"""Queries of the text problems over the project's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import abuse, mixing, pii, repetition, tokens


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, text, client_source)`` of user_actions."""
    return table(spark, sf_dir, "user_actions").select("id", F.col("data.message").alias("text"), "client_source")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.mentions(messages(spark, sf_dir), table(spark, sf_dir, "known_names"))
    return found.select("id", "pii_type", "span_start").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(messages(spark, sf_dir), table(spark, sf_dir, "known_names"))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(messages(spark, sf_dir), *(table(spark, sf_dir, t) for t in ("message_labels", "abuse_terms", "group_names")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(p7_scores(spark, sf_dir))


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(p7_scores(spark, sf_dir), messages(spark, sf_dir).select("id", "client_source"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf_dir, "documents"))


def p10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact measure alone, of every document: the yardstick of the regression."""
    return p10_shares(spark, sf_dir).select("doc_id", "n_words", F.round("repeated_share", 9).alias("repeated_share"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted, "p7_found": p7_found, "p7_scores": p7_scores, "p7_rates": p7_rates, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_shares": p10_shares, "p10_exact": p10_exact}
# stretches of five words that were said before in the document, and the words that stand in one
_SAID = """with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as words from documents),
  g as (select doc_id, i, array_to_string(words[i:i + 4], ' ') as gram from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5) x),
  again as (select doc_id, i from g qualify row_number() over (partition by doc_id, gram order by i) > 1),
  covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from again) y group by doc_id),
  shares as (select w.doc_id, coalesce(len(words), 0) as n_words, case when len(words) > 0 then coalesce(n, 0) / len(words) else 0.0 end::double as share from w left join covered c on w.doc_id = c.doc_id) """
ORACLES: dict[str, str] = {"p10_found": _SAID + "select doc_id from shares where share >= 0.3", "p10_exact": _SAID + "select doc_id, n_words::bigint as n_words, round(share, 9) as repeated_share from shares"}
