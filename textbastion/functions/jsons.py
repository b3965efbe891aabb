"""Arrow functions on JSON texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _strings(v) -> list[str]:
    """String values in document order, without recursion."""
    out, stack = [], [v]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            stack.extend(reversed(x.values()))
        elif isinstance(x, list):
            stack.extend(reversed(x))
    return out


@F.pandas_udf(ArrayType(StringType()))
def string_values(s: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else _strings(json.loads(t))
        except (ValueError, RecursionError):
            return None

    return s.map(one)
