"""Ids for new rows that sort by time: 48 bits of milliseconds, then 80 bits that tell rows of one millisecond apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits of a sortable id in base 32, without I, L, O and U.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _base32(hexadecimal: Column, length: int) -> Column:
    return F.translate(F.lpad(F.conv(hexadecimal, 16, 32), length, "0"), _PLAIN, ALPHABET)


def sortable_id(millis: Column, *seed: Column) -> Column:
    """26 characters: 10 of the time, 16 of a hash of seed; equal time and seed give equal ids, so a retried task gives the same."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(s.cast("string"), F.lit("")) for s in seed]))
    time = _base32(F.hex(millis.cast("bigint")), 10)
    return F.concat(time, _base32(F.substring(digest, 1, 10), 8), _base32(F.substring(digest, 11, 10), 8))
