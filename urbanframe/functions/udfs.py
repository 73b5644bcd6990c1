"""Python-side variant of the day-period bucket, kept for parity and benchmarking.

The native ``time_of_day`` expression is the default; this Arrow-batched pandas UDF
computes the same buckets one vectorised batch at a time (never row by row).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanframe.functions.scalars import (
    AFTERNOON,
    EVENING,
    MORNING,
    NIGHT_FROM,
    NIGHT_UNTIL,
    PERIOD_NAMES,
)


TRIMMED = "".join(map(chr, [*range(0x21), 0x7F]))


def classify_periods(hhmm: pd.Series) -> pd.Series:
    """Vectorised bucket of HHMM text or numbers; malformed values -> None."""
    # integer text only ("12.5" is malformed), surrounded by what try_cast(... as int) trims:
    # blanks and control characters, but no other white space
    as_text = hhmm.astype("string").str.strip(TRIMMED)
    integral = as_text.str.fullmatch(r"[+-]?[0-9]+").fillna(False).to_numpy(dtype=bool)
    t = pd.Series(
        pd.to_numeric(as_text, errors="coerce").to_numpy(dtype="float64", na_value=np.nan), index=hhmm.index
    ).where(integral)
    t = t.where(t.between(-(2**31), 2**31 - 1))  # as a cast to int: longer numbers are malformed
    conditions = [
        t.between(*MORNING),
        t.between(*AFTERNOON),
        t.between(*EVENING),
        (t >= NIGHT_FROM) | (t <= NIGHT_UNTIL),
    ]
    out = np.select(conditions, list(PERIOD_NAMES), default=None)
    return pd.Series(out, index=hhmm.index, dtype=object).where(t.notna(), None)


time_of_day_udf = F.pandas_udf(classify_periods, T.StringType())
