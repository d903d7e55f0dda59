"""MinHash near-deduplication by an inverted join over signature coordinates.

A document's signature has one value per coordinate. Documents are posted under coordinate-value pairs; two whose signatures agree in
`matches` of K coordinates share a pair among the K - matches + 1 rarest of either one (the prefix), so only these are posted, and pairs that one
document has are skipped. Each list compares its members with a few pivots, among them the member whose values are the most common ones: collisions are counted,
pairs above the match threshold confirmed on full sets. Lists whose members are linked by then are skipped. Documents of the others, those that hang together by common
values alone, are posted anew under the rarest shingles of their full sets (an exact prefix filter with positions), and these lists are compared with growing
numbers of pivots until each is skipped or all its pairs are tested. Every link has been confirmed; none is made from all pairs of a list.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import bytetext as bt
from tidelog.llm.common import Scratch

#: Coordinates, and collisions that a pair needs before its sets are compared. At a similarity of 0.8 the count is
#: binomial with mean 51.2; a pair has fewer than 38 four times in 100,000.
COORDINATES, MATCHES = 64, 38
SHINGLE, PERCENT = 5, 80
#: Ids up to which a table of them is broadcast (16 bytes each); pivots of a list by signatures and in the first round over full sets, and their growth in later rounds.
BROADCAST_IDS, PIVOTS, MORE_PIVOTS = 1_000_000, 4, 4
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(1, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 128, dtype=np.uint64)


def _shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles and where each text's begin, sorted within a text."""
    _, _, text, h, _ = bt.words(column, fold=True)
    n = len(column)
    counts = np.bincount(text, minlength=n)
    first = np.cumsum(counts) - counts
    full = np.flatnonzero(text[size - 1 :] == text[: text.size - size + 1]) if text.size >= size else np.zeros(0, np.int64)
    value, of = h[full], text[full]
    for k in range(1, size):
        value = bt.pair(value, h[full + k])
    short = np.flatnonzero((counts > 0) & (counts < size))  # their whole sequence is one shingle
    whole = h[first[short]] if short.size else np.zeros(0, np.uint64)
    for k in range(1, size - 1):
        more = counts[short] > k
        whole[more] = bt.pair(whole[more], h[first[short[more]] + k])
    value, of = np.concatenate((value, bt.mix(whole + np.uint64(1)))), np.concatenate((of, short))
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(value.size, bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(n + 1))


def signatures(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), signature (null without shingles)."""

    def run(batches):
        for batch in bt.slices(batches):
            value, at = _shingle_sets(batch.column("text"), size)
            n, full = np.diff(at), np.flatnonzero(np.diff(at) > 0)
            keys = np.zeros((len(n), 2), np.uint64)
            signs = np.zeros((len(n), coordinates), np.int32)
            if full.size:
                start = at[full]
                keys[full, 0] = np.add.reduceat(bt.mix(value), start)
                keys[full, 1] = np.add.reduceat(bt.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
                for k in range(coordinates):
                    signs[full, k] = np.minimum.reduceat((value * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32), start).astype(np.uint32).view(np.int32)
            offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, coordinates, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signs[full].ravel()))
            binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), binary, lists], names=["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature array<int>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, n and the sorted shingle hashes, as bytes, of docs (id, text)."""

    def run(batches):
        for batch in bt.slices(batches):
            value, at = _shingle_sets(batch.column("text"), size)
            raw = value.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), pa.array(np.diff(at).astype(np.int64)), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["id", "n", "hashes"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, hashes binary")


def prefix_postings(reps: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """key, id, n, centre: each document under the rarest of its coordinate-value pairs that others have too. centre is large where many others have its values."""
    posts = reps.select("id", F.posexplode("signature").alias("k", "v")).select(
        "id", (F.col("k").cast("long") * F.lit(2**32) + F.col("v").cast("long")).alias("key"))
    common = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per = posts.join(common, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))  # `coordinates` at most
    room = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("keys"))  # pairs of its own fill the prefix first
    centre = F.aggregate("keys", F.lit(0.0), lambda c, x: c + F.log2(x["df"].cast("double")))
    return per.where(room > 0).select("id", centre.alias("centre"), F.explode(F.slice("keys", F.lit(1), F.greatest(room, F.lit(1)))["key"]).alias("key")).distinct()


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _collisions(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def similar(pairs: DataFrame, reps: DataFrame, matches: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose set sizes allow the similarity and whose signatures agree in enough coordinates."""
    of = lambda side: reps.select(F.col("id").alias(side), F.col("signature").alias(f"s{side}"), F.col("n_shingles").alias(f"n{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(
        _sizes_allow("na", "nb", percent) & (_collisions("sa", "sb") >= matches)).select("a", "b").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the full sets hold for."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column("ha"), batch.column("hb")
            ok = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (x.size + y.size - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """id, label of every id in links (a, b): label is the smallest id reachable.

    Each round an id takes the smallest label of its neighbours and sends it to the id of its old label too (its root is hooked), then labels jump. Rounds go on
    until no label moves, when both ends of every edge have the same one; hooks keep them near the logarithm of the longest chain (22 for 200,000 in random order).
    """
    edges = scratch.write(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"edges{tag}")
    labels = scratch.write(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), f"labels{tag}.0")
    moving, k = True, 0
    while moving:
        k += 1
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        new = F.least("label", "near")
        own = F.struct("id", "label", new.alias("new"))
        root = F.struct(F.col("label").alias("id"), F.lit(None).cast("long").alias("label"), new.alias("new"))
        sent = labels.join(near, labels["id"] == near["a"]).select(F.explode(F.when(F.col("near") < F.col("label"), F.array(own, root)).otherwise(F.array(own))).alias("x"))
        spread = sent.select("x.*").groupBy("id").agg(F.max("label").alias("label"), F.min("new").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("jumped"))
        least = F.least("new", F.coalesce("jumped", "new"))
        after = scratch.write(
            spread.join(jump, "new", "left").select("id", least.alias("label"), (F.col("label") > least).alias("moved")), f"labels{tag}.{k}")
        labels, moving = after.select("id", "label"), not after.where("moved").isEmpty()
        scratch.drop(f"labels{tag}.{k - 1}")
    return labels


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """The labels after links (a, b) more: only the components that they join are labelled anew."""
    ends = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    moved = components(ends, scratch, tag)
    ids = labels.unionByName(moved.select("id", F.col("id").alias("label")).join(labels.select("id"), "id", "left_anti"))
    return ids.join(moved.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _about(n: int, of: str, seed: int) -> Column:
    """Holds for about n of the `of` ids of a list, for all if they are n or fewer; lists of like sizes choose the same ids."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**20)) * F.col(of) < F.lit(n * 2**20)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Sets:
    """Full sets of some documents, in tables whose buckets spare the joins with them a shuffle. close() drops them."""

    def __init__(self, docs: DataFrame, shingle: int):
        self.docs, self.shingle, self.names = docs, shingle, []

    def bucketed(self, df: DataFrame, kind: str) -> DataFrame:
        spark, name = self.docs.sparkSession, f"near_dedup_{kind}_{uuid.uuid4().hex}"
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names.append(name)
        df.repartition(n, "id").write.bucketBy(n, "id").option("compression", "zstd").saveAsTable(name)
        return spark.table(name)

    def of(self, ids: DataFrame) -> DataFrame:
        few = ids.count() <= BROADCAST_IDS
        return self.bucketed(full_sets(self.docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id"), self.shingle), "sets")

    def close(self, spark) -> None:
        for name in self.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def exact_postings(sets: DataFrame, percent: int) -> DataFrame:
    """key, id, n, most: each document under those of its shingles, rarest first, that a similar one of `most` shingles or fewer may have as their first common one.

    If the shingle at place i (from 0) of a set of n is the first common one, then n - i are common at most, and a partner of more than `most` shingles would need more.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column("hashes")[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h.size, batch.column("id")[i].as_py())), pa.array(np.full(h.size, h.size)), pa.array(h)], names=["id", "n", "key"])

    posts = sets.select("id", "hashes").mapInArrow(run, "id long, n long, key long")
    common = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per = posts.join(common, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))  # one document's own set
    placed = per.select("id", "n", F.posexplode("keys").alias("i", "x"), (F.col("n") - F.size("keys")).alias("own"))  # shingles of its own come first
    most = F.floor(F.expr(f"((n - own - i) * {100 + percent} - n * {percent}) / {percent}")).cast("long")
    return placed.select(F.col("x.key").alias("key"), "id", "n", most.alias("most")).where(100 * F.col("most") >= percent * F.col("n"))


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings (key, id, n, most, label) of lists with several components, without members that no other one's size suits; and of each list its
    largest component (big) and how many members the others have (small)."""
    now = _labelled(lists, labels)
    per = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n"), F.max("most").alias("top"))
    live = now.join(per.where("low <> high"), "key").where("most >= least_n and n <= top").select("key", "id", "n", "most", "label")
    sizes = live.groupBy("key", "label").agg(F.count(F.lit(1)).alias("members"))
    most = sizes.groupBy("key").agg(F.max_by("label", F.struct("members", "label")).alias("big"), (F.sum("members") - F.max("members")).alias("small")).where("small > 0")
    return live.join(most, "key")


def near_dedup(
    docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, pivots: int = PIVOTS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A document's set has its distinct `shingle`-word shingles; with fewer
    words, the whole sequence is one. Documents are linked if 100 * intersection >= percent * union. component_id is the smallest doc_id
    reachable; without words a document is linked with nothing. Rows of the same doc_id count as one document; a null doc_id is linked with nothing and not kept.
    Equal sets meet in one representative before any pair is made. A null text is empty, other columns are ignored, an empty table gives an empty result.
    """
    spark, scratch, tables = docs.sparkSession, Scratch(docs.sparkSession), _Sets(docs, shingle)
    try:
        signed = scratch.write(signatures(docs, shingle, coordinates), "signatures")
        used = signed.where("n_shingles > 0 and doc_id is not null")
        grouped = used.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
        reps = tables.bucketed(grouped, "reps")
        # sets this small have no other set within reach: one more shingle already is too much
        lists = scratch.write(prefix_postings(reps.where(100 * F.col("n_shingles") >= percent * (F.col("n_shingles") + 1)), coordinates, matches), "lists")
        same_id = used.join(reps.select("set_key", "id"), "set_key").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
        repeated = reps.select("id").unionByName(same_id.select(F.col("b").alias("id"))).groupBy("id").count().where("count > 1").select("id")
        given = same_id.join(repeated.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")  # a doc_id with several sets joins them
        # each list's members and its pivots: the one of the most common values, and all or about `pivots` of the others
        per = lists.groupBy("key").agg(F.max_by("id", F.struct("centre", "id")).alias("one"), F.count(F.lit(1)).alias("members"))
        roles = scratch.write(lists.join(per, "key").select("key", "id", ((F.col("id") == F.col("one")) | _about(pivots, "members", 0)).alias("pivot")), "roles")
        pairs = roles.select("key", "id").join(roles.where("pivot").select("key", F.col("id").alias("p")), "key").where("id <> p").select(*_ordered("id", "p")).distinct()
        tested = scratch.write(similar(scratch.write(pairs, "pairs"), reps, matches, percent), "similar")
        sets = tables.of(scratch.write(tested.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids"))
        links = scratch.write(confirm(tested, sets, percent), "links")
        labels = components(links.unionByName(given), scratch, "s")
        # documents of lists that several components are left in, by full sets
        pending = _labelled(roles.where("not pivot").select("key", "id"), labels)
        rest = pending.join(pending.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high"), "key").select("id").distinct()
        left = scratch.write(exact_postings(tables.of(scratch.write(rest, "rest")), percent), "left0")
        sets, k = spark.table(tables.names[-1]), 0
        tested = scratch.write(tested, "tested0")
        while True:
            live = scratch.write(_mixed(left, labels), f"live{k}")
            if live.isEmpty():
                break
            # all members outside the largest component, or about `pivots` of them, and one at least
            one = live.where("label <> big").groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(k))).alias("one"))
            chosen = scratch.write(live.where("label <> big").join(one, "key").where((F.col("id") == F.col("one")) | _about(pivots * MORE_PIVOTS**k, "small", k)).select(
                "key", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("most").alias("pmost"), F.col("label").alias("plabel")), f"chosen{k}")
            pairs = live.join(chosen, "key").where("label <> plabel and n <= pmost and pn <= most").where(_sizes_allow("n", "pn", percent)).select(*_ordered("id", "p")).distinct()
            pairs = scratch.write(pairs.join(tested, ["a", "b"], "left_anti"), f"pairs{k}")
            more = scratch.write(confirm(pairs, sets, percent), f"more{k}")
            if not more.isEmpty():
                labels = scratch.write(merged(labels, more, scratch, f"m{k}"), f"merged{k}")
            tested = scratch.write(tested.unionByName(pairs), f"tested{k + 1}")
            left = scratch.write(live.select("key", "id", "n", "most").join(chosen.select("key", F.col("p").alias("id")), ["key", "id"], "left_anti"), f"left{k + 1}")
            scratch.drop(f"live{k}", f"chosen{k}", f"pairs{k}", f"left{k}", f"tested{k}")
            k += 1
        of = used.select("doc_id", "set_key").distinct().join(reps.select("set_key", "id"), "set_key").join(labels, "id", "left")
        of = scratch.write(of.groupBy("doc_id").agg(F.min(F.coalesce("label", "id")).alias("component_id")), "components")
        scratch.drop("lists", "roles", "pairs", "similar", "ids", "links", "rest")
    finally:
        tables.close(spark)
    return signed.join(of, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"))
