"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sediment.llm.textbytes import pieces_of
from sediment.llm.tokenizing import encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its UTF-8 bytes, its tokens, and whether these are over ``limit``.

    Whole texts, as the tokenizer's library counts them without added tokens: texts are cut only where the tokenizer
    cuts by itself, and each batch that goes to the library has about as many bytes as the next, however long single
    texts are. Only lengths leave the Python worker. A null text is empty and has no tokens; repeated rows are counted
    each; a null id stays null; other columns are not read. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in pieces_of(batches):
            texts = pc.fill_null(batch.column("text"), "")
            sizes = pc.binary_length(texts).cast(pa.int64())
            tokens = np.fromiter((len(x) >> 2 for x in ids_of(texts.to_pylist())), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"cast(`{text_column}` as string) text").mapInArrow(count, SCHEMA)
