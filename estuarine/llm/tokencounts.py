"""Token counts of whole texts without their ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.llm.common import slices, strings
from estuarine.llm.wordbpe import WordPieces


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of `docs`.

    Each task counts the pieces of a distinct pre-token once, and joins these counts to the
    frequencies of pre-tokens in its documents: frequency times pieces, summed per document.
    No row is shuffled; a join of all (document, pre-token) pairs over the network would move
    more than the texts themselves.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results, a null
    id stays null, an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        pieces = WordPieces(path)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = strings(part, "__text")
                size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts))
                n = pieces.sizes(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
