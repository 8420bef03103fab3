"""Reproducible hash samples and buckets: the first 32 bits of an MD5, which any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bucket(key: Column, seed: int, n: int) -> Column:
    """0 to n - 1 for a key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % n


def bucket_sql(key: str, seed: int, n: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % {n})"
