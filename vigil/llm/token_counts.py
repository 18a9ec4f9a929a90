"""Token counts: Arrow batches re-cut by bytes, texts cut at safe boundaries, lengths only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, byte_lengths, ship_code
from .encoding import encoder

#: Text bytes encoded at once.
BATCH_BYTES = 4 << 20


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row. `tokenizer` is a file that every executor can read.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are counted each; an empty
    table gives an empty result; other columns are not read. One narrow stage without a shuffle: memory is bounded
    by an Arrow batch, and a lost task only encodes its own rows again."""
    ship_code(docs.sparkSession)

    def run(batches):
        memory = encoder(tokenizer, keep_ids=False)
        for batch in batches:
            n_bytes = byte_lengths(batch.column(1))
            for a, b in by_bytes(n_bytes, batch_bytes):
                n = memory.counts(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_bytes[a:b]), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
