"""A filter of fixed size before a join: rows whose key can't be on the other side are not shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.storage import ship


def sieve(df: DataFrame, on: str, keys: DataFrame, bits: int = 26) -> DataFrame:
    """Rows of ``df`` whose ``on`` may be in ``keys``; none that is there is lost, the join that follows drops the rest.

    The keys set bits of a map of 2^bits places, 8 MB at 26, however many keys there are: with very many the map
    fills up and filters less. Nulls are in no key.
    """
    ship(df.sparkSession)
    place = F.pmod(F.xxhash64(on), F.lit(1 << bits))
    p = keys.where(F.col(on).isNotNull()).select(place.alias("p"))
    word = F.shiftright("p", 6).alias("w")
    mask = F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("m")
    rows = p.groupBy(word).agg(mask).toArrow()  # 2^(bits - 6) rows of 16 bytes at most
    flags = np.zeros(1 << (bits - 6), dtype=np.int64)
    flags[rows["w"].to_numpy()] = rows["m"].to_numpy()
    del rows
    shared = df.sparkSession.sparkContext.broadcast(flags)

    @F.pandas_udf("boolean")
    def may_be(p: pd.Series) -> pd.Series:
        at = p.to_numpy(dtype=np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return df.where(F.col(on).isNotNull()).where(may_be(place))
