"""Problem 8: every text as the ids of a public tokenizer."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.llm.bpe import PartEncoder
from bohagi.llm.words import map_batches, pieces

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("BOHAGI_TOKENIZERS", "/opt/tokenizers")
_encoders: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """A worker's encoder for a rank file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def rank_file(name: str, folder: str | None = None) -> str:
    return f"{folder or TOKENIZERS}/{name}.tiktoken"


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens; their strings are ordinary text.
    Null and empty texts give an empty list, repeated rows one list each; the key may be null or
    repeated. Texts of any length are encoded whole. Other columns are not read. One narrow stage:
    no shuffle."""
    path = rank_file(tokenizer, folder)

    def run(b: pa.RecordBatch):
        for p in pieces(b, 64):
            offs, ids = encoder(path).encode_texts(p.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([p.column(0), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, ids array<int>")


def count_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, n_ids long): how many ids encode_corpus gives each row, without making the lists."""
    path = rank_file(tokenizer, folder)

    def run(b: pa.RecordBatch):
        for p in pieces(b, 256):
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(encoder(path).count_texts(p.column(1).to_pylist()))], [key, "n_ids"])

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, n_ids long")
