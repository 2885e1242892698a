"""64-bit SimHash fingerprints and the distance between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_halves(token: Column) -> tuple[Column, Column]:
    """Low and high 32 bits of the token hash, the first 16 hex digits of its MD5."""
    digest = F.md5(token)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return half(9), half(1)


def lane_sum(low: Column, high: Column, weight: Column, bit: int) -> Column:
    """Weighted count of bit ``bit`` of both halves, packed into one long."""
    one = lambda half: F.shiftright(half, bit).bitwiseAND(F.lit(1).cast("bigint"))
    return F.sum(one(low) * weight + F.shiftleft(one(high) * weight, 32))


def fingerprint(lanes: list[Column], votes: Column) -> Column:
    """Set each bit that more than half of the votes have set."""
    result = F.lit(0).cast("bigint")
    mask = F.lit((1 << 32) - 1).cast("bigint")
    for bit, lane in enumerate(lanes):
        for shift, ones in ((bit, lane.bitwiseAND(mask)), (bit + 32, F.shiftright(lane, 32))):
            value = (1 << shift) - (1 << 64 if shift == 63 else 0)
            result = result.bitwiseOR(F.when(ones * 2 > votes, F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return result


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
