"""Quality rules: base rules, and robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Text statistics come from one pass in Arrow batches. The estimates come from concentration steps, each of which Spark runs over all rows:
distances to the current centre, the row count that the subset needs, and the subset's sums, grouped by language and source. Only
sums, one row per group, meet in a task; no group's rows do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import bytetext as bt
from tidelog.llm.common import Scratch, join_groups

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Statistics that the distance is taken over, and the least standard deviation of each: groups in which nearly
#: all texts agree have variances near 0, under which trifles would look like outliers. Each statistic's range is several cutoffs wide.
DIMS = (("chars_per_word", 0.6), ("symbols_per_word", 0.08), ("dup_lines", 0.08), ("repeated_words", 0.08))
#: Squared distance beyond which a text is rejected: the 0.999 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 18.467
#: Share of a group's rows that its estimate rests on, fall of the log determinant under which it is settled, and rows that a group needs for an estimate of its own.
SUBSET, SETTLED, LEAST = 0.75, 1e-4, 100


def text_stats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang", "source"), within: str | None = None) -> DataFrame:
    """The columns `carry` and counts of every whole text; see STATS. A null or empty text has none of anything. within: the struct of `carry` whose field text it is."""
    rows = docs.select(*carry, *([] if within else ["text"]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(carry)]), STATS])

    def run(batches):
        if within:
            batches = (pa.RecordBatch.from_arrays([*b.columns, pc.struct_field(b.column(within), "text")], names=[*carry, "text"]) for b in batches)
        for batch in bt.slices(batches):
            column = batch.column("text")
            data, offsets, text, h, chars = bt.words(column)
            n = len(column)
            count = lambda at, w=None: np.bincount(at, w, n).astype(np.int64)
            # lines with a word: equal ones of the same text are neighbours once sorted; all but the first count
            starts, ends, of = bt.pieces(data, offsets, data != 10)
            word_at = np.concatenate(([0], np.cumsum(~bt.SPACE[data])))
            full = word_at[ends] > word_at[starts]
            starts, ends, of = starts[full], ends[full], of[full]
            lines = bt.piece_hashes(data, starts, ends)
            order = np.lexsort((lines, of))
            same = (lines[order][1:] == lines[order][:-1]) & (of[order][1:] == of[order][:-1])
            dup = count(of[order][1:][same])
            # windows of three words that a text has twice or more; each word in one of them counts once
            inside = np.flatnonzero(text[2:] == text[:-2]) if text.size > 2 else np.zeros(0, np.int64)
            w = bt.pair(bt.pair(h[inside], h[inside + 1]), h[inside + 2])
            order = np.lexsort((w, text[inside]))
            ws, ts = w[order], text[inside][order]
            same = np.zeros(ws.size + 1, bool)
            same[1:-1] = (ws[1:] == ws[:-1]) & (ts[1:] == ts[:-1])
            again = inside[order][same[:-1] | same[1:]]
            covered = np.zeros(text.size, bool)
            for k in range(3):
                covered[again + k] = True
            places = np.searchsorted(offsets, np.flatnonzero(SYMBOLS[data]), side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, (count(text), count(text, chars), count(places), dup, count(text[covered]), count(of)))],
                names=[*carry, *(x.split()[0] for x in STATS.split(", "))])

    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, in the order of DIMS: ratios, their square roots where they have long tails."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.least(F.col("word_chars") / words, F.lit(60.0)),
        F.sqrt(F.least(F.col("n_symbols") / words, F.lit(4.0))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _consistency(subset: float) -> float:
    """What the covariance of the nearest `subset` of normal vectors in 4 dimensions falls short by: subset / P(chi-square of 6 <= the subset's quantile of 4)."""
    low, high = 0.0, 100.0  # half the quantile
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - np.exp(-mid) * (1 + mid) < subset else (low, mid)
    return float(subset / (1 - np.exp(-low) * (1 + low + low**2 / 2)))


def _estimate(pdf: pd.DataFrame, scale: float) -> pd.DataFrame:
    """Mean, inverse covariance and its log determinant of each row of sums. The floor on deviations also keeps the matrix invertible."""
    d, floor = len(DIMS), np.diag([s**2 for _, s in DIMS])
    out = []
    for row in pdf.itertuples(index=False):
        n, sums, squares = row.n, np.array(row.sums, float), np.array(row.squares, float).reshape(d, d)
        mean = sums / n
        cov = np.maximum(scale, 1.0) * (squares / n - np.outer(mean, mean)) + floor
        out.append((row.level, row.lang, row.source, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
    return pd.DataFrame(out, columns=["level", "lang", "source", "mean", "inverse", "logdet"])


def _distance() -> Column:
    """Squared Mahalanobis distance of v from (mean, inverse)."""
    d = len(DIMS)
    dev = [F.col("v")[i] - F.col("mean")[i] for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            total = total + dev[i] * F.col("inverse")[i * d + j] * dev[j]
    return total


def robust_estimates(rows: DataFrame, scratch: Scratch, *, subset: float = SUBSET, least: int = LEAST) -> DataFrame:
    """level, lang, source, mean, inverse: estimates of `rows` (doc_id, lang, source, v): level 0 of each language and source with at least
    `least` rows, level 1 of each such language (source ''), level 2 of all rows (lang and source '').

    Starts from each group's medians and the floors' scale; each concentration step keeps the `subset` share of rows nearest to the
    centre and estimates anew, which never raises the covariance determinant. A group is settled when its determinant falls no more; steps go on
    until all groups are, over the rows of the others.
    """
    d, group = len(DIMS), ["level", "lang", "source"]
    levels = rows.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "level", F.when(F.col("level") < 2, F.col("lang")).otherwise("").alias("lang"),
        F.when(F.col("level") < 1, F.col("source")).otherwise("").alias("source"), "doc_id", "v")
    medians = levels.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_all"), F.array(*[F.percentile_approx(F.col("v")[i], 0.5, 2000) for i in range(d)]).alias("mean"))
    unit = F.array(*[F.lit(1.0 / DIMS[i // d][1] ** 2 if i % (d + 1) == 0 else 0.0) for i in range(d * d)])
    now = scratch.write(
        medians.where((F.col("n_all") >= least) | (F.col("level") == 2)).withColumns({"inverse": unit, "logdet": F.lit(np.inf), "moved": F.lit(True)}).drop("n_all"), "mcd0")
    scale, k = _consistency(subset), 0
    while n_groups := now.where("moved").count():
        k += 1
        far = join_groups(levels, now.where("moved").select(*group, "mean", "inverse"), group, n_groups).select(*group, "doc_id", "v", _distance().alias("far"))
        edge = far.groupBy(group).agg(F.percentile_approx("far", subset, 5000).alias("edge"))
        sums = join_groups(far, edge, group, n_groups).where("far <= edge").groupBy(group).agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(d)]).alias("sums"),
            F.array(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(d) for j in range(d)]).alias("squares"))
        new = sums.mapInPandas(lambda pdfs: (_estimate(p, scale) for p in pdfs), now.drop("moved").schema)
        new = new.select(*group, F.struct("mean", "inverse", "logdet").alias("new"))
        falls = F.coalesce(F.col("new.logdet") < F.col("logdet") - SETTLED, F.lit(False))
        now = scratch.write(now.join(new, group, "left").select(
            *group, *(F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "inverse", "logdet")), falls.alias("moved")), f"mcd{k}")
    return now


def judge_quality(docs: DataFrame, *, cutoff: float = CUTOFF, **estimates) -> DataFrame:
    """doc_id, the counts of STATS, base_failed, distance (squared, null where base_failed), kept.

    The estimates rest on all texts that pass the base rules. A group smaller than LEAST takes the estimate of its language, or that of
    all texts. Null languages and sources form the group '<null>'. A null or empty text fails the base rules. Rows stay as
    they are, repeated ones too; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    stats = _measured(scratch.write(text_stats(docs.select("doc_id", *_group(), "text")), "stats"))
    return _judged(stats, _estimated(stats, scratch, **estimates), cutoff).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, *, cutoff: float = CUTOFF, **estimates) -> DataFrame:
    """The rows of docs, with all their columns, that judge_quality keeps. Each row is judged by itself: ids may be null or repeated. Texts are read twice and not shuffled."""
    scratch = Scratch(docs.sparkSession)
    stats = _measured(scratch.write(text_stats(docs.select("doc_id", *_group(), "text")), "stats"))
    found = _estimated(stats, scratch, **estimates)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_group(), F.xxhash64("text").alias("doc_id"))  # the id only spreads large groups
    return _judged(_measured(text_stats(rows, ("row", "lang", "source", "doc_id"), "row")), found, cutoff).where("kept").select("row.*")


def _group() -> list[Column]:
    return [F.coalesce(c, F.lit("<null>")).alias(c) for c in ("lang", "source")]


def _measured(stats: DataFrame) -> DataFrame:
    return stats.withColumn("base_failed", base_failed()).withColumn("v", F.array(*vector()))


def _estimated(stats: DataFrame, scratch: Scratch, **estimates) -> DataFrame:
    return robust_estimates(stats.where(~F.col("base_failed")).select("doc_id", "lang", "source", "v"), scratch, **estimates)


def _judged(stats: DataFrame, found: DataFrame, cutoff: float) -> DataFrame:
    """stats with distance and kept."""
    n_groups = found.count()
    own = found.where("level = 0").select("lang", "source", F.struct("mean", "inverse").alias("own"))
    by_lang = found.where("level = 1").select("lang", F.struct("mean", "inverse").alias("by_lang"))
    whole = found.where("level = 2").select("mean", "inverse").first()  # one row of 20 numbers
    of_all = F.struct(*(F.array(*map(F.lit, whole[c])).alias(c) for c in ("mean", "inverse"))) if whole else F.lit(None)
    rows = join_groups(stats, own, ["lang", "source"], n_groups, how="left")
    rows = join_groups(rows, by_lang, ["lang"], n_groups, how="left")
    chosen = F.coalesce("own", "by_lang", of_all)
    rows = rows.withColumns({"mean": chosen["mean"], "inverse": chosen["inverse"]})
    far = F.when(~F.col("base_failed"), _distance())
    return rows.withColumn("distance", far).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))
