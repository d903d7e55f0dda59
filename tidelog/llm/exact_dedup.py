"""Exact deduplication through a log-structured merge index of text digests (DataFrame functions only).

Documents enter in memtables; each memtable flushes one run: its distinct digests, sorted, with the smallest identifier
and the number of rows of each, and a bitmap filter over digest bits. Compaction sends only digests that another run's filter may hold
through the merge; the others are final as they are. Every hit (a row that shares a digest with another row) is
then verified byte by byte against the row that stays; rows that fail the verification are grouped by their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ascii_lower

#: Digests that share one filter bitmap, and bits of it (the size of Spark's bitmap aggregates).
FILTER_ENTRIES, FILTER_BITS = 2048, 32768


def _digest_bits(digest: Column, start_hex: int, n_hex: int) -> Column:
    return F.coalesce(F.conv(F.substring(F.hex(digest), start_hex + 1, n_hex), 16, 10).cast("long"), F.lit(0))


def _has_bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def flush(entries: DataFrame, n_runs: int, buckets: int) -> DataFrame:
    """Runs (run, digest, id, n), sorted by digest, with the bucket and bit of each digest in its run's filter."""
    return (
        entries.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(n_runs)).cast("int"))
        .groupBy("run", "digest").agg(F.min("rank_id").alias("id"), F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.pmod(_digest_bits("digest", 0, 8), F.lit(buckets)).cast("int"))
        .withColumn("bit", (_digest_bits("digest", 8, 8) % FILTER_BITS).cast("int"))
        .sortWithinPartitions("run", "digest")
    )


def filters_of(runs: DataFrame) -> DataFrame:
    one = runs.groupBy("bucket", "run").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
    return one.groupBy("bucket").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))  # a struct for each run


def compact(runs: DataFrame, filters: DataFrame) -> DataFrame:
    """One entry per digest with the smallest id. Only digests that another run's filter may hold are merged."""
    probed = runs.join(filters, "bucket").select(
        "digest", "id", "n",
        F.exists("filters", lambda f: (f["run"] != F.col("run")) & _has_bit(f["bits"], F.col("bit"))).alias("hit"),
    )
    merged = probed.where("hit").groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    return merged.unionByName(probed.where(~F.col("hit")).select("digest", "id", "n"))


def exact_dedup(
    docs: DataFrame, *, keep: str = "max", n_runs: int = 4, normalise=ascii_lower, digest=None
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when their normalised forms are; of equal ones the largest (keep="max") or smallest doc_id stays.
    A null text counts as empty, so all null and empty texts form one group. Every row is returned, repeated ones too:
    rows that repeat both the id that stays and its text are all marked kept. A null doc_id stays only where the group has no other.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    digest = digest or (lambda norm: F.unhex(F.sha2(norm, 256)))
    sign = -1 if keep == "max" else 1
    last = 2**62  # stands for a null doc_id: any other is preferred to it
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = rows.select("doc_id", normalise(F.col("text")).alias("norm"))
    entries = scratch.write(
        base.select(
            "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), digest(F.col("norm")).alias("digest"),
            F.coalesce(F.col("doc_id") * sign, F.lit(last)).alias("rank_id")),
        "entries",
    )
    buckets = 2 ** max(0, math.ceil(math.log2(max(1, entries.count()) / FILTER_ENTRIES)))
    runs = scratch.write(flush(entries, n_runs, buckets), "runs")
    index = scratch.write(compact(runs, filters_of(runs)), "index")
    scratch.drop("runs")
    found = entries.join(index, "digest").withColumnRenamed("n", "group_size")
    hits = found.where("group_size > 1").select("doc_id", "rank_id", "id", F.col("digest").alias("hit_digest")).distinct()
    members = scratch.write(  # normalised after the join, so that only rows with hits are
        rows.join(hits, "doc_id").withColumn("norm", normalise(F.col("text")))
        .where(digest(F.col("norm")) == F.col("hit_digest")).drop("text"),
        "members",
    )
    stays = members.where("rank_id = id").groupBy("id").agg(F.first("norm").alias("kept_norm"))
    differs = members.join(stays, "id").where("norm <> kept_norm").select("hit_digest").distinct()
    if not differs.isEmpty():  # digests that more than one text shares: their rows are grouped by the text itself
        texts = members.join(scratch.write(differs, "differs"), "hit_digest")
        groups = texts.groupBy("hit_digest", "norm").agg(
            F.min("rank_id").alias("own_id"), F.count(F.lit(1)).alias("own_size"))
        own = texts.join(groups, ["hit_digest", "norm"]).select(
            "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "own_id", "own_size").distinct()
        found = found.join(scratch.write(own, "own"), ["doc_id", "sha"], "left").withColumns({
            "id": F.coalesce("own_id", "id"), "group_size": F.coalesce("own_size", "group_size")})
    keep_id = F.when(F.col("id") != last, F.col("id") * sign)
    return found.select(
        "doc_id", keep_id.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
