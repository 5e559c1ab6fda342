"""Token counts by a tokenizer's file, for budgets in tokens of a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def of_file(path: str) -> Callable[[Column], Column]:
    """A counter for :class:`siltwork.config.ReduceConfig`: the ids that the tokenizer in ``path`` (JSON, on every executor) gives a text.

    A file that is none raises here; without the ``tokenizers`` package, ImportError.
    """
    from tokenizers import Tokenizer

    try:
        Tokenizer.from_file(path)
    except Exception as e:  # the package raises Exception itself
        raise ValueError(f"no tokenizer in {path}: {e}") from e
    made: dict[str, Tokenizer] = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if path not in made:
            made[path] = Tokenizer.from_file(path)
        return pd.Series([len(x.ids) for x in made[path].encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count
