"""Token counts of texts by a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import spread

#: Rank file of the byte-level BPE; any file of the same form can be named instead.
TOKENIZER = os.environ.get("QUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the tokenizer cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once for each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(df: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Replace the column ``text`` by ``tokens``, its length in tokens; null and empty texts have 0.

    Strings that look like special tokens are ordinary text.  A column that was named ``tokens``
    before is replaced; all others are kept.
    """
    df = df.drop("tokens") if text != "tokens" else df
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(path)
        for batch in batches:
            counts = [len(coder.encode_ordinary(t)) if t else 0 for t in batch[text]]
            yield batch.drop(columns=[text]).assign(tokens=counts)

    schema = ",".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), "tokens long"])
    return spread(df).mapInPandas(run, schema)
