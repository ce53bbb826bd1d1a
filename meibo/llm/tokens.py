"""Lengths of texts in tokens of a public tokenizer, and cuts at token boundaries."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: where the vocabulary files are; MEIBO_TOKENIZERS or a parameter says otherwise
TOKENIZER_DIR = os.environ.get("MEIBO_TOKENIZERS", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.json"
BATCH_CHARS = 2_000_000
_LOADED: dict[str, object] = {}


def _tokenizer(path: str) -> object:
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


def _batches(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokenizer: str | None = None) -> DataFrame:
    """``key``, the columns of ``keep`` and ``n_tokens`` of every row; null and empty texts have 0.

    Whole texts are tokenized, Arrow batch by Arrow batch, without a shuffle.
    """
    path = tokenizer or f"{TOKENIZER_DIR}/{TOKENIZER_FILE}"
    cols = list(dict.fromkeys([key, *keep]))
    src = docs.select(*cols, F.col(text).alias("_text"))
    schema = src.drop("_text").schema.add("n_tokens", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            n = [len(e.ids) for part in _batches(texts) for e in tok.encode_batch(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*cols, "n_tokens"])

    return src.mapInArrow(run, schema)
