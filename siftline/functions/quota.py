"""Quota errors and retry waits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftline import constants as K
from siftline.functions.text import contains_any


def is_quota_error(code: Column, message: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    return (F.coalesce(code, F.lit(0)) == K.QUOTA_CODE) | contains_any(text, K.QUOTA_PHRASES)


def retry_wait_us(attempt: Column, message: Column) -> Column:
    """Microseconds to wait: the hint if positive, else a doubling wait, plus the margin."""
    hint = F.regexp_extract(F.coalesce(message, F.lit("")), K.RETRY_HINT, 1).try_cast("double")
    nanos = F.when(hint > 0, hint * F.lit(1e9)).try_cast("bigint")
    hinted = F.floor(nanos / F.lit(1000))
    backoff = F.pow(F.lit(2), attempt).cast("bigint") * F.lit(K.BACKOFF_BASE_S * 1_000_000)
    return F.coalesce(F.when(nanos > 0, hinted), backoff) + F.lit(K.RETRY_MARGIN_S * 1_000_000)
