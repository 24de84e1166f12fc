"""Which rows of a large table may be among some keys, without moving the rows.

The keys set bits of a table of fixed size, which is broadcast: 2 ** WORD_BITS words of 64
bits, whatever the number of keys. A row whose bit is not set is not among the keys and
stays where it is; the others still need an exact join. With very many keys most bits are
set and the join gets most rows, so nothing is lost but the saving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.session import cut

WORD_BITS = 18


def _place(key: Column) -> Column:
    """A bit's number; null keys share the one of an odd constant."""
    return F.shiftrightunsigned(F.coalesce(F.xxhash64(key), F.lit(-1)), 64 - WORD_BITS - 6)


def screened(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose column ``key`` may be in the column of that name of keys, and all others."""
    place = _place(F.col(key))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = cut(keys.groupBy(F.shiftright(place, 6).alias("__word")).agg(F.bit_or(bit).alias("__bits")))
    marked = rows.join(F.broadcast(words), F.shiftright(place, 6) == F.col("__word"), "left")
    hit = F.coalesce(F.col("__bits"), F.lit(0)).bitwiseAND(bit) != 0
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)
