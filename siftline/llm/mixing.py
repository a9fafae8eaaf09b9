"""Mix sources to target weights, with a bound on how often a document repeats.

Targets: every source gets its weight's share of the mix, but at most
``most_epochs`` times what it has; what that leaves over is shared again by
weight among the rest, until no source is above its bound (water-filling).

Sampling: a source whose target is 1.3 times its size gives every document
once, and 0.3 of its words again: documents in a seeded order until the words
are reached, the last of them in part. The order is a hash's, so a rerun agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.common import WORD, numbered, packed, store, unpacked
from siftline.operators.lookup import lookup_join

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the order's hash that make a bucket; only one bucket a source is sorted.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, share: float = SHARE, most_epochs: float = MOST_EPOCHS
) -> DataFrame:
    """``source_key, source_size, weight`` (stored) with ``target``.

    The water level is found by rounds of one small aggregate each: sources
    whose bound lies below the level give up the rest of their share.
    """
    bound = F.col("source_size") * F.lit(float(most_epochs))
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = share * (total or 0) / weights if weights else 0.0
    while True:
        full = bound <= F.lit(level) * F.col("weight")
        held, free = sources.agg(
            F.coalesce(F.sum(F.when(full, bound)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        higher = (share * (total or 0) - held) / free if free else level
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(bound, F.lit(level) * F.col("weight")))


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with the source as a key that is never null, its words and its place in the order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.withColumns(
        {
            "source_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
            "size": word_count(F.col("text")),
            "_order": F.md5(name),
        }
    )


def _plan(
    sizes: DataFrame, weights: tuple[int, ...], share: float, most_epochs: float
) -> DataFrame:
    """Per source: its size and target, whole rounds, and where the last, partial round ends."""
    by_source = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    turn = F.get(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int"))
    ranked = numbered(by_source, "source", "sources").withColumn("weight", turn).drop("rank", "source")
    targets = source_targets(store(ranked, "weights"), share, most_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("_whole", whole.cast("long")).withColumn(
        "_rest", (F.floor("target") - F.col("_whole") * F.col("source_size")).cast("long")
    )
    buckets = sizes.groupBy("source_key", F.left("_order", F.lit(BUCKET_DIGITS)).alias("_last")).agg(
        F.sum("size").alias("_words")
    )
    so_far = Window.partitionBy("source_key").orderBy("_last")
    last = (
        buckets.withColumn("_to", F.sum("_words").over(so_far))
        .join(targets.select("source_key", "_rest"), "source_key")
        .where("_rest < _to AND _rest >= _to - _words")
        .select("source_key", "_last", (F.col("_rest") - F.col("_to") + F.col("_words")).alias("_room"))
    )
    return store(targets.join(last, "source_key", "left").drop("weight"), "targets")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (keyed) with the plan's columns and ``taken``; only the last buckets are sorted."""
    marked = lookup_join(rows, plan, "inner", key="source_key", spread="_order").withColumn(
        "_bucket", F.left("_order", F.lit(BUCKET_DIGITS))
    )
    # No last bucket: the source has no words.
    ahead = F.coalesce(F.col("_bucket") < F.col("_last"), F.lit(False))
    sure = marked.where("_last IS NULL OR _bucket <> _last").withColumn(
        "_more", F.when(ahead, F.col("size")).otherwise(F.lit(0))
    )
    before = (
        Window.partitionBy("source_key", "_bucket")
        .orderBy("_order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.coalesce(F.sum("size").over(before), F.lit(0))
    split = marked.where("_bucket = _last").withColumn(
        "_more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_room") - used))
    )
    return sure.unionByName(split).withColumn(
        "taken", F.col("_whole") * F.col("size") + F.col("_more")
    )


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken``.

    Sources are weighed by ``weights`` in turn, in code point order, null last.
    Null text counts no words. ``taken`` sums up to the whole words of the
    target in every source. Repeated rows are documents of their own; an empty
    table gives no rows; other columns are ignored.
    """
    keyed = _keyed(docs.select("doc_id", "source", "text"), seed)
    sizes = store(keyed.drop("text"), "sizes")
    return _taken(sizes, _plan(sizes, weights, share, most_epochs)).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def mix_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, columns unchanged.

    A row taken in part comes with its first words, joined by blanks (and
    ``n_chars``, if there is one, to match). Documents without words give none.
    Texts stay where they are, but for those of the last buckets.
    """
    keyed = _keyed(docs.select("doc_id", "source", "text"), seed)
    plan = _plan(store(keyed.drop("text"), "sizes"), weights, share, most_epochs)
    own = ("doc_id", "source", "text", "n_chars")
    rounds = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    copies = _taken(_keyed(packed(docs, *own), seed), plan).where("taken > 0").withColumn("_round", F.explode(rounds))
    words = (F.col("taken") - (F.col("_round") - 1) * F.col("size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), 1, words), " ")
    cut = words < F.col("size")
    copies = copies.withColumn("_text", F.when(cut, part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        size = F.when(cut, F.char_length("_text").cast(kind)).otherwise(F.col("n_chars"))
        copies = copies.withColumn("n_chars", size)
    return copies.withColumn("text", F.col("_text")).select(unpacked(docs.columns, own))
