"""Token counts by rank-synchronous array merging.

Pre-tokens of a slice of texts are held as ragged numpy arrays of symbols; in each step every sequence's lowest-rank
pair is merged, all sequences at once, and what survives is counted. A distinct pre-token is merged once per worker for
as long as its count is remembered. Rows are independent, so there is no shuffle.

Defined results: a null text counts as empty, with 0 tokens; repeated rows each give a row; a null doc_id stays null; an
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._pieces import encoder
from ._shared import text_slices, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8, n_tokens, and whether these are more than limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, "rank_merge")
        for batch in batches:
            tokens, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, raw, offsets in text_slices(batch.column("text")):
                tokens.append(own.counts(raw, offsets))
                size.append(np.diff(offsets))
            n = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(size)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(count, SCHEMA)
