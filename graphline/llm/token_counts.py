"""Token counts by batch encoding in Arrow functions that return lengths only.

The rows of an Arrow batch are dealt into batches of about equal bytes, so one long
text does not make a batch large; texts are split where no piece can cross, also
within runs without blanks, and the lengths of the parts are added up. No id leaves
the encoder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.llm.common import documents
from graphline.llm.encode import encoder


def token_counts(docs: DataFrame, model: str, kind: str = "cut", limit: int = 4096, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty: no bytes, no tokens. Very long texts are counted whole,
    in parts that no piece crosses. Repeated rows are counted one by one; an empty table gives an empty result; other columns are ignored.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(kind, model).lengths
        for batch in parts:
            text = batch.column(1)
            size = np.asarray(pc.binary_length(text), dtype=np.int64)
            tokens = np.empty(len(size), np.int64)
            # batches of equal bytes: cut where the running sum passes a multiple
            which = np.cumsum(size) // batch_bytes
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(size)]]) if len(size) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                tokens[a:b] = lengths(text.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = documents(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
