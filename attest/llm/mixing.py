"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Each record has an exponential key -ln(u) / w, with u from a hash of the record and w its quality weight. A source with a
target of several times its size gives whole epochs first; the rest of the target is taken in key order until the running
sum of sizes is nearest to it. Rows are sorted by source and key into range partitions cut at sampled quantiles of the real
keys, so that no source, however large and whatever its weights, is sorted in one task; sums are carried from part to part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.frames import ranked, running
from attest.llm.common import row_key, row_of, stored, unfolded

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column) -> Column:
    """A quality weight from 0.25 to 1 that falls with the share of symbols that prose does not need."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.75) * F.least(F.lit(1.0), F.lit(4.0) * symbols / F.greatest(F.length(text), F.lit(1))),
                      F.lit(1.0))


def targets(sizes: DataFrame, weights: list[float], factor: float, most: float) -> DataFrame:
    """(source, group, source_size, target) of `sizes` (source, group, source_size).

    Sources in the order of code points, null last, take `weights` in turn and share `factor` times all sizes. A target
    stops at `most` times the size of its source and what is above is shared again by weight until none is above. Each
    round is one sum over the sources; two numbers reach the driver.
    """
    placed = ranked(sizes, "__rank", F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stored(placed.select("source", "group", "source_size", F.lit(float(most)).alias("most"),
                                   F.get(turns, ((F.col("__rank") - 1) % len(weights)).cast("int")).alias("weight")), "sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.col("most")
    level = 0.0
    while True:
        capped = limit <= F.col("weight") * F.lit(level)
        held, free = weighed.agg(F.sum(F.when(capped, limit).otherwise(0.0)),
                                 F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        after = (factor * total - held) / free
        if after <= level * (1 + 1e-12):
            break
        level = after
    return weighed.select("source", "group", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[float, ...] = (5, 2, 1), factor: float = 1.5, most: float = 2.0,
             quality: Column | None = None) -> DataFrame:
    """One row per distinct input row: key, key2 (hashes of the whole row), doc_id, source, size, n (rows), source_size,
    target, epochs (times every one of the n rows is taken), extra (how many of the n rows are taken once more) and rank, the
    exponential key.

    Size is the number of words; a null text has none. Rows are ordered by key, then id and hash, so ties are the same in
    every run, and equal rows are counted with their number. A source without words has target 0. An empty table gives no
    rows. Texts of any length are read once for their words and hashes and not carried on. `quality` is a positive weight; null or other values count as 1.
    """
    body = F.col(f"`{text}`").cast("string")
    key, key2 = row_key(docs)
    weight = quality if quality is not None else plain_share(body)
    rows = docs.select(
        key.alias("key"), key2.alias("key2"), F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"), word_count(body).alias("size"), weight.cast("double").alias("w"),
        F.xxhash64(F.col(f"`{doc_id}`"), body, F.lit("draw")).alias("draw"))
    rows = rows.withColumn("group", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")))
    u = (F.col("draw").bitwiseAND(F.lit((1 << 53) - 1)) + 1) / F.lit(float((1 << 53) + 1))
    rows = rows.withColumn("rank", -F.log(u) / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    grouped = stored(rows.groupBy("key", "key2", "doc_id", "source", "group", "size", "rank").agg(
        F.count(F.lit(1)).alias("n")).withColumn("words", F.col("size") * F.col("n")), "mix-rows")
    sizes = grouped.groupBy("group", "source").agg(F.sum("words").alias("source_size"))
    aims = targets(sizes.select("source", "group", "source_size"), list(weights), factor, most)
    placed = running(grouped, "group", ["rank", "doc_id", "key", "key2"], sums={"before": "words"}).join(
        aims.select("group", "source_size", "target"), "group")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size") - F.col("before")
    extra = F.when(F.col("size") > 0, F.floor(rest / F.col("size") + F.lit(0.5))).otherwise(0)
    return placed.withColumn("epochs", epochs.cast("long")).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("n"), extra)).cast("long")).select(
        "key", "key2", "doc_id", "source", "size", "n", "source_size", "target", "epochs", "extra", "rank")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them; its columns are unchanged. Options as in `mix_plan`.

    Rows are told apart by all their columns, nulls included; columns may have any names and types.
    """
    key, key2 = row_key(docs)
    plan = mix_plan(docs, **options).select("key", "key2", (F.col("epochs") * F.col("n") + F.col("extra")).cast("int").alias("times"))
    keyed = docs.select(row_of(docs).alias("row"), key.alias("key"), key2.alias("key2")).dropDuplicates(["key", "key2"])
    taken = keyed.join(plan.where("times > 0"), ["key", "key2"]).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return unfolded(taken, docs.columns)
