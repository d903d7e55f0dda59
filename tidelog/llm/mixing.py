"""Mixing sources to target weights: temperature, budget and block permutations (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidelog.llm.common import Scratch, join_groups

WORD = r"[^\x20\x09-\x0D]+"
#: Production parameters: entropy aimed at (share of the largest possible one), most epochs of any source, words in a block.
TARGET_ENTROPY, MAX_REPEAT, BLOCK_TOKENS, SEED, STEPS = 0.95, 2.0, 65536, 17, 60


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _weights(shares: Column, alpha: Column) -> Column:
    """shares^alpha, normalised."""
    total = _sum(F.transform(shares, lambda p: F.pow(p, alpha)))
    return F.transform(shares, lambda p: F.pow(p, alpha) / total)


def plan_mixture(
    totals: DataFrame, *, target_entropy: float = TARGET_ENTROPY, max_repeat: float = MAX_REPEAT,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per source of totals (source, tokens): weight, alpha, repeats (epochs, 1 or more), whole, rest, n_blocks.

    The exponent is bisected in [0, 1]: the flattest mixture whose entropy is at most target_entropy * ln(sources) and in which no
    source is repeated more than max_repeat times. The budget is the smallest that shows every source in whole at least once, so
    nothing is left out. Exponent 1 (every source once) is taken where even it is over the entropy. A source without tokens has weight 0 and is shown once.
    """
    listed = totals.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("all"))  # a struct per source
    listed = listed.where(F.size("all") > 0).withColumn("total", F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    listed = listed.withColumn("p", F.transform("all", lambda x: x["tokens"] / F.col("total")))

    def repeats(alpha: Column) -> Column:  # of the most repeated source, the least repeated one being shown once
        ratio = F.transform(F.arrays_zip(_weights(F.col("p"), alpha).alias("w"), F.col("p").alias("p")), lambda x: x["w"] / x["p"])
        return F.array_max(ratio) / F.array_min(ratio)

    def entropy(alpha: Column) -> Column:
        return -_sum(F.transform(_weights(F.col("p"), alpha), lambda w: w * F.ln(w)))

    def step(span: Column, _: Column) -> Column:
        mid = (span["lo"] + span["hi"]) / 2
        flat = (repeats(mid) > max_repeat) | (entropy(mid) > target_entropy * F.ln(F.size("p").cast("double")))
        return F.struct(F.when(flat, mid).otherwise(span["lo"]).alias("lo"), F.when(flat, span["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    solved = listed.withColumn("alpha", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: F.round(s["hi"], 9)))
    solved = solved.withColumn("w", _weights(F.col("p"), F.col("alpha")))
    solved = solved.withColumn("least", F.array_min(F.transform(F.arrays_zip("w", "p"), lambda x: x["w"] / x["p"])))
    each = solved.select("alpha", "least", F.explode(F.arrays_zip("all", "w", "p")).alias("x")).select(
        F.col("x.all.source").alias("source"), F.col("x.w").alias("weight"), "alpha",
        F.round(F.col("x.w") / F.col("x.p") / F.col("least"), 6).alias("repeats"))
    return totals.join(each, "source", "left").select(
        "source", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), "alpha",
        F.coalesce("repeats", F.lit(1.0)).alias("repeats"),
    ).withColumns({
        "whole": F.floor("repeats").cast("int"),
        "n_blocks": F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long"),
    }).withColumn("rest", F.floor((F.col("repeats") - F.col("whole")) * F.col("tokens")).cast("long"))


def _block_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), "source", epoch.cast("string"), F.col("block").cast("string")))


def mix_sources(docs: DataFrame, *, seed: int = SEED, tokens: Column | None = None, split: bool = False, **plan) -> DataFrame:
    """One row for each time a document is shown: doc_id, source, n_tokens, epoch, block, block_key.

    A source's documents are dealt into blocks by a hash of doc_id. Every epoch shows the blocks in an order of its own, that of
    block_key; the last, partial epoch shows blocks in this order as long as they fit into what is left of the budget. With `split`, the first
    block that does not fit shows its documents, in an order of their own, as long as they do: every source then has its budget but for less than one
    document. Without, up to a block of it is lost, for a source of one block the whole partial epoch. A null source is
    the source '<null>', a null text has no tokens, repeated rows are shown as often as they occur; other columns are ignored.
    """
    n = tokens if tokens is not None else F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    scratch = Scratch(docs.sparkSession)
    # texts are read once; what follows needs only their counts
    rows = scratch.write(docs.select("doc_id", F.coalesce("source", F.lit("<null>")).alias("source"), n.alias("n_tokens")), "counts")
    totals = scratch.write(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "totals")
    sources = plan_mixture(totals, **plan)
    dealt = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = join_groups(rows, sources.drop("tokens", "weight", "alpha", "repeats"), ["source"], totals.count()).withColumn("block", dealt % F.col("n_blocks"))
    blocks = rows.groupBy("source", "block", "whole", "rest").agg(F.sum("n_tokens").alias("tokens"))
    blocks = blocks.withColumn("key", _block_key(F.col("whole") + 1, seed)).withColumn("part", F.substring("key", 1, 2))
    # running sums in two steps, so that no task needs all blocks of a source: within a 256th of the keys, and over the 256 sums
    parts = blocks.groupBy("source", "part").agg(F.sum("tokens").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("tokens").over(W.partitionBy("source", "part").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    marks = (
        blocks.withColumn("within", within).join(parts.select("source", "part", before.alias("before")), ["source", "part"])
        .select("source", "block", (F.col("rest") - F.col("before") - F.col("within") + F.col("tokens")).alias("room"), (F.col("before") + F.col("within") <= F.col("rest")).alias("fits"))
        .where((F.col("fits") | (F.col("room") > 0)) if split else F.col("fits"))
    )
    marked = rows.join(marks, ["source", "block"], "left").withColumn("more", F.coalesce(F.col("fits").cast("int"), F.lit(0)))
    if split:  # one block of a source at most
        own = F.md5(F.concat_ws(":", F.lit(str(seed)), "source", (F.col("whole") + 1).cast("string"), F.col("doc_id").cast("string")))
        upto = F.sum("n_tokens").over(W.partitionBy("source").orderBy(own, "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0))
        cut = marked.where("not fits").withColumn("more", (upto <= F.col("room")).cast("int"))
        marked = marked.where("coalesce(fits, true)").unionByName(cut)
    shown = marked.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("whole") + F.col("more"))))
    return shown.select("doc_id", "source", "n_tokens", "epoch", "block", _block_key(F.col("epoch"), seed).alias("block_key"))
