"""Token counts by a tokenizer file, beside the estimates of functions.text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of the texts that are encoded at once. What a tokenizer returns takes some 80 times the text's room.
RUN_BYTES = 1 << 18

_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def token_counts(tok, texts: pa.Array, special: bool = True) -> np.ndarray:
    """Tokens of each text, null texts having none. Texts are encoded in runs of about RUN_BYTES, a longer one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    n, lo = np.zeros(len(texts), np.int64), 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + RUN_BYTES, "right")))
        run = texts[lo:hi].to_pylist()
        found = tok.encode_batch_fast([t for t in run if t is not None], add_special_tokens=special)
        n[lo:hi][[t is not None for t in run]] = [len(x) for x in found]
        del found
        lo = hi
    return n


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "id", text_col: str = "text", special: bool = True) -> DataFrame:
    """(id, tokens) of each row's whole text by the tokenizer file; with `special`, its special tokens count too.

    Null texts have none. Texts go through in Arrow batches, without a shuffle; the file is read once a worker. A worker
    holds a batch and the tokens of one run of it (see token_counts), whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(token_counts(tok, b.column(1), special))], ["id", "tokens"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, tokens long")
