"""Equi-joins of a large table with a dimension whose size is checked first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftline.session import store

#: What a row of a broadcast table needs beside its values: its header, its key's place in the hash table.
ROW_BYTES = 64
#: Bits a key sets in its word of a filter, and bits of the filter per key.
FILTER_BITS = 4
BITS_PER_KEY = 16


@dataclass(frozen=True)
class BroadcastBound:
    bytes: int = 64 << 20


def _width(field: T.StructField) -> Column:
    """Bytes of a value, close enough for a bound."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(column)))
    return F.lit(8)


def fits_broadcast(dim: DataFrame, bound: BroadcastBound = BroadcastBound()) -> bool:
    """Sum up the bytes of ``dim`` and its rows; it should be stored, as this reads all of it."""
    width = sum(map(_width, dim.schema.fields), F.lit(ROW_BYTES))
    return (dim.agg(F.sum(width)).first()[0] or 0) <= bound.bytes


def one_per_key(dim: DataFrame, key: str = "channel_id") -> DataFrame:
    """One row per key that is not null; of several the greatest, so that reruns agree."""
    others = [c for c in dim.columns if c != key]
    known = dim.where(F.col(key).isNotNull())
    if not others:
        return known.distinct()
    return known.groupBy(key).agg(F.max(F.struct(*others)).alias("_v")).select(key, "_v.*")


def heavy_hitters(facts: DataFrame, key: str, share: float) -> list[int]:
    """Hashes of keys that may hold ``share`` of all rows: every such key, and at most 1 / share.

    A frequency sketch (Misra-Gries counters, merged over the tasks) in one pass over the key alone.
    """
    hashes = facts.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    return list(hashes.freqItems(["h"], share).first()[0] or [])


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    how: str = "inner",
    key: str = "channel_id",
    spread: str = "msg_id",
    salts: int = 32,
    bound: BroadcastBound = BroadcastBound(),
    stored: bool = True,
) -> DataFrame:
    """Join on ``key``; ``dim`` holds each key once. Its plan runs once: if it is not ``stored``, it is first.

    Within the bound the dimension is broadcast and ``facts`` do not move.
    Beyond it both sides shuffle on the key. Keys that hold a large share of
    the facts, which a sketch finds, meet ``salts`` tasks each, and only their
    rows of the dimension are repeated.
    """
    dim = dim if stored else store(dim, "lookup")
    if fits_broadcast(dim, bound):
        return facts.join(F.broadcast(dim), key, how)
    return _split_join(facts, dim, how, key, spread, salts)


def _split_join(facts: DataFrame, dim: DataFrame, how: str, key: str, spread: str, salts: int) -> DataFrame:
    heavy = heavy_hitters(facts, key, 1 / (4 * salts))
    is_heavy = F.xxhash64(key).isin(heavy) if heavy else F.lit(False)
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    repeated = dim.withColumn("_salt", F.explode(F.when(is_heavy, every).otherwise(F.array(F.lit(0)))))
    # Rows without a key match nothing; they are spread as well.
    some = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    salted = facts.withColumn("_salt", F.when(is_heavy | F.col(key).isNull(), some).otherwise(0))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def _filter_word(keys: list[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(words))


def _filter_mask(keys: list[str]) -> Column:
    """``FILTER_BITS`` bits of a word, from hashes that the choice of the word does not use."""
    mask = F.lit(0).cast("bigint")
    for i in range(FILTER_BITS):
        place = F.pmod(F.hash(F.lit(i), *keys), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def bloom_words(rows: DataFrame, keys: list[str], words: int) -> DataFrame:
    """A Bloom filter of the keys as a table: ``_word``, and the 64 ``_bits`` of it that are set.

    All bits of a key lie in one word, so a test is one lookup. Bits are merged before the shuffle.
    """
    return rows.groupBy(_filter_word(keys, words).alias("_word")).agg(F.bit_or(_filter_mask(keys)).alias("_bits"))


def may_hold(rows: DataFrame, bits: DataFrame, keys: list[str], words: int) -> DataFrame:
    """Rows whose key the filter may hold: all that it does, and few others. Nothing moves."""
    tested = rows.withColumns({"_word": _filter_word(keys, words), "_mask": _filter_mask(keys)})
    met = F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")
    return tested.join(F.broadcast(bits), "_word").where(met).drop("_word", "_mask", "_bits")


def wide_join(
    wide: DataFrame, few: DataFrame, keys: list[str], bound: BroadcastBound = BroadcastBound()
) -> DataFrame:
    """Inner join of a table of wide rows with the few that are wanted; rows that find none do not move.

    ``few`` is stored. Within the bound it is broadcast. Beyond it a Bloom
    filter of its keys, which never exceeds the bound, is, and what passes it
    is shuffled.
    """
    few = store(few, "wanted")
    if fits_broadcast(few, bound):
        return wide.join(F.broadcast(few), keys)
    most = max(1, bound.bytes // (16 + ROW_BYTES))
    words = min(most, max(1, few.count() * BITS_PER_KEY // 64))
    bits = store(bloom_words(few, keys, words), "filter")
    return may_hold(wide, bits, keys, words).join(few, keys)
