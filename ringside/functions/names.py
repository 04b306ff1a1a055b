"""Name keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of descent, which are left out of a name's key.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]


def name_key(name: str) -> str:
    """NFKD, ASCII only, lower case, single spaces, no tokens of descent."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().casefold()
    return " ".join(t for t in plain.split() if t.strip(".") not in SUFFIXES)


@F.pandas_udf(T.StringType())
def _keys(names: pd.Series) -> pd.Series:
    return names.map(name_key, na_action="ignore")


def normalize_name(name: Column) -> Column:
    """The key of a name.  No SQL function drops what NFKD can't decompose to ASCII, so this is a vectorised Python one."""
    return _keys(name)
