"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where no path is given: the setting of this name, else this file.
SETTING = "spark.folioscope.tokenizer"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenizer pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_made: dict[int, object] = {}


def _encoding(data: bytes):
    import tiktoken

    key = hash(data)
    if key not in _made:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _made[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[key]


def token_sizes(texts: DataFrame, id_col: str, text_col: str, tokenizer: str | None = None) -> DataFrame:
    """``texts`` with ``tokens`` in place of the text: its length in tokens, 0 for null and empty texts.

    The vocabulary file (under 1 MB) is read on the driver and broadcast, so no executor needs it.
    """
    tokenizer = tokenizer or texts.sparkSession.conf.get(SETTING, TOKENIZER)
    shared = texts.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kept = [f for f in texts.schema.fields if f.name != text_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(shared.value)
        for pdf in batches:
            yield pdf.drop(columns=text_col).assign(tokens=[len(encoding.encode_ordinary(t)) if t else 0 for t in pdf[text_col]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens long"
    return texts.where(F.col(id_col).isNotNull()).mapInPandas(run, schema)
