"""Token counts by a public tokenizer whose vocabulary file stays outside the repository."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

#: Folder of vocabulary files, and the file used unless another is asked for.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.json"


@cache
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def with_token_counts(texts: DataFrame, keys: list[str], column: str = "text", path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(keys, tokens): the number of tokens of each whole text; an empty text has 0, a null one is left out."""
    schema = ", ".join([f"{c} {t}" for c, t in texts.select(*keys).dtypes] + ["tokens long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            out = b[keys].copy()
            out["tokens"] = [len(e.ids) for e in t.encode_batch(b[column].tolist(), add_special_tokens=False)]
            yield out

    return texts.where(texts[column].isNotNull()).select(*keys, column).mapInPandas(run, schema)
