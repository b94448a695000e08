"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fhirlake.llm.encode import BATCH_BYTES, Encoder
from fhirlake.llm.spans import groups, process_cache, releasing, text_bytes


def _lengths(path: str):
    """Counts per text of an Arrow column."""
    if not path.endswith(".model"):
        encoder = Encoder(path)
        return lambda column: encoder.batch(column, with_ids=False)[0]
    import sentencepiece

    cache = process_cache()
    if path not in cache:
        cache[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    model = cache[path]
    return lambda column: np.asarray([len(ids) for ids in model.encode(column.to_pylist(), num_threads=1)], np.int64)


def token_counts(
    docs: DataFrame, vocabulary: str, *, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of `docs`: the key, `n_bytes`, `n_tokens` and `over_limit` (`n_tokens > limit`).

    `vocabulary` is the path of a .json file (tokenizers) or a .model file (sentencepiece), present
    on every executor. Counts are the library's own, without added begin or end tokens, truncation or
    padding. Only lengths leave the task. A task encodes batches of
    about two megabytes; a long text of a byte-level vocabulary is cut where no token can reach across
    (see `encode`), others are encoded whole.

    A null or empty text has no bytes and no tokens. Rows are neither dropped nor merged: repeated rows
    and null keys give a row each. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(vocabulary)
        for batch in batches:
            column = batch.column(1)
            _, starts = text_bytes(column)
            for first, after in groups(starts, BATCH_BYTES):
                part = column.slice(first, after - first)
                tokens = lengths(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, after - first),
                        pa.array(np.diff(starts[first : after + 1])),
                        pa.array(tokens),
                        pa.array(tokens > limit),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
