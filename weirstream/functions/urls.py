"""URL resolution (RFC 3986), for which Spark has no function."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, reference: pd.Series) -> pd.Series:
    """``reference`` as seen from ``base``; an empty reference is the base itself, null stays null."""
    return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(base, reference, strict=True)], dtype=object)
