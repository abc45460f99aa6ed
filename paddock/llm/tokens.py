"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Iterator
from types import ModuleType

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies and the file used; both are parameters of every operator.
TOKENIZERS = os.environ.get("PADDOCK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: How byte-level BPE splits a text before merging: contractions, letters, digits, signs, space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    """The tokenizer of a vocabulary file, loaded once a worker process."""
    import tiktoken

    held = sys.modules.setdefault("_paddock_tokenizers", ModuleType("_paddock_tokenizers")).__dict__
    if path not in held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        held[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[path]


def counted(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, text_id, tokens)`` of each document, over its whole text.

    Null and empty texts have 0 tokens and no ``text_id``; equal texts have equal ``text_id``.
    Strings of special tokens are ordinary text. Rows with a null ``doc_id`` are kept.
    """
    documents.sparkSession.sparkContext.addFile(f"{folder}/{vocabulary}")  # executors get the driver's file

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(vocabulary))
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "text_id": b.text_id, "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b.text]})

    text_id = F.when(F.length("text") > 0, F.md5(F.col("text").cast("binary")))
    asked = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), text_id.alias("text_id"), F.col("text").cast("string"))
    return asked.mapInPandas(count, "doc_id bigint, source string, text_id string, tokens bigint")
