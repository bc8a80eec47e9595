"""Encoding a corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import Vocabulary

#: Characters encoded at once; a longer text is a batch by itself.
BATCH_CHARS = 4_000_000


def _encoder(shared, counts_only: bool, derived: dict[str, Callable] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        kind = pa.int64() if counts_only else pa.list_(pa.int32())
        for batch in batches:
            texts, out, held, size = batch.column(1).to_pylist(), [], [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if size > BATCH_CHARS:
                    out += vocab.encode_batch(held)
                    held, size = [], 0
            out += vocab.encode_batch(held)
            done = pa.array([len(x) for x in out] if counts_only else out, type=kind)
            rest = range(2, batch.num_columns)
            made = [pa.array([f(t) for t in texts], pa.string()) for f in (derived or {}).values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), done, *(batch.column(i) for i in rest), *made], names=["doc_id", "n_tokens" if counts_only else "ids", *(batch.schema.names[i] for i in rest), *(derived or {})])

    return run


def encode(documents: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every text, without special tokens; null and empty texts give an empty list.

    Text that looks like a special token is plain text. Repeated rows are encoded as often as they come; extra columns are
    ignored. No shuffle: each Arrow batch is encoded where it is read. The vocabulary (a fixed file of about 50,000
    entries) is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_encoder(shared, False), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, vocab_path: str | None = None, keep: tuple[str, ...] = (), derived: dict[str, Callable] | None = None) -> DataFrame:
    """``(doc_id, n_tokens, …)`` of every text, 0 for null and empty; the text columns ``keep``, and what is ``derived`` from the texts, go along, so that nothing need be joined to them."""
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *[F.col(n).cast("string") for n in keep])
    return rows.mapInArrow(_encoder(shared, True, derived), "doc_id bigint, n_tokens bigint" + "".join(f", {n} string" for n in [*keep, *(derived or {})]))
