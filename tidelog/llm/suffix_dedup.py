"""Removal of repeated byte strings by distributed prefix doubling.

The rank of a place is a fingerprint of the bytes from it on; ranks of double length come from pairs of ranks at growing offsets. Up to half the threshold the
offsets stay within a text, so a task computes them by itself. Then Spark deals places out by rank: first a sample that every long enough
string has a member in (places whose rank is the least of a window), so that places whose rank is unique leave; then, for what is
left, the pairs of ranks half a threshold apart, sorted and ranked anew. A place whose pair comes from an earlier document starts a repeated string. Runs of
ranks travel as compressed columns, one row for each task and rank range, and a range holds a bounded share of the places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import bytetext as bt
from tidelog.llm.common import Scratch

THRESHOLD = 50
#: Bytes of text for each partition of texts, and for each range of ranks.
PART_BYTES, RANGE_BYTES = 4 << 20, 4 << 20
#: Places that a task gathers before it writes them out.
GATHER = 1 << 20
#: Ranks of pairs have 56 bits besides those of their range.
RANK_MASK = np.uint64(2**56 - 1)
_CODEC = pa.Codec("zstd", 1)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte planes apart (high bytes that hardly change compress well), behind their sizes."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(c.size, c.itemsize).T).tobytes() for c in columns)
    return np.array([len(planes)], np.int64).tobytes() + _CODEC.compress(planes, asbytes=True)


def _unpacked(payload: bytes, *kinds: str) -> list[np.ndarray]:
    size = int(np.frombuffer(payload[:8], np.int64)[0])
    planes, out, at = np.frombuffer(_CODEC.decompress(payload[8:], size, asbytes=True), np.uint8), [], 0
    n = size // sum(np.dtype(k).itemsize for k in kinds)
    for k in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(planes[at : at + n * k.itemsize].reshape(k.itemsize, n).T).view(k).ravel())
        at += n * k.itemsize
    return out


def _rows(key: np.ndarray, n_keys: int, doc: np.ndarray, *columns: np.ndarray):
    """(key, payload) for each key; doc ids and places (the last column) as differences."""
    order = np.argsort(key.astype(np.uint16) if n_keys < 65536 else key, kind="stable")
    key, cuts = key[order], None
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if key.size else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        yield int(key[a]), _packed(np.diff(doc[own], prepend=0), *(c[own] for c in columns[:-1]), np.diff(columns[-1][own], prepend=np.int32(0)))


def _sliding(h: np.ndarray, size: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over `size` neighbours from each place, by doubling."""
    n = 1
    while n < size:
        step = min(n, size - n)
        h = of(h[: max(0, h.size - step)], h[step:])
        n += step
    return h


def _anchors(data: np.ndarray, offsets: np.ndarray, seed: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks at `seed` bytes, which strings of `threshold` bytes fit into a text, and the sampled places: those
    with the least rank of the places in some such string. Equal strings have their samples at equal places."""
    h = bt.window_hashes(data, seed) | np.uint64(1)
    width = threshold - seed + 1
    fits = np.zeros(max(0, h.size - width + 1), bool)
    change = np.zeros(fits.size + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= threshold)
    np.add.at(change, offsets[long], 1)
    np.add.at(change, offsets[long + 1] - threshold + 1, -1)
    fits = np.cumsum(change)[:-1] > 0
    if not fits.size:
        return h, fits, np.zeros(0, bool)
    least = np.where(fits, _sliding(h, width, np.minimum), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate((edge, least, edge)), width, np.maximum)
    return h, fits, most == h


def _text_of(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, places, side="right") - 1


def _without_null_ids(batch):
    return batch.filter(batch.column("doc_id").is_valid())


def repeated_spans(docs: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """RESULT for every row of docs: what stays of each text after removing each byte that a string of `threshold` bytes covers which also starts in a document with a smaller doc_id.

    A null text is empty. Texts shorter than the threshold stay whole. A doc_id names one text: rows that repeat it with the same text all get
    its result. A null doc_id has no order: its text stays whole and removes nothing. Other columns are ignored.
    """
    seed, scratch = threshold // 2, Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, ranges = max(16, total // PART_BYTES), int(2 ** np.ceil(np.log2(max(16, total // RANGE_BYTES))))
    shift = np.uint64(64 - int(np.log2(ranges)))
    # of equal texts all but the first are repeated from end to end; only the first needs ranks
    same = rows.where(F.octet_length("text") >= threshold).groupBy(F.sha2("text", 256).alias("sha"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    same = scratch.write(same.select(F.unhex("sha").alias("sha"), "doc_id").where("doc_id is not null"), "digests")
    groups = same.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = scratch.write(same.join(groups, "sha").where("doc_id <> first").select("doc_id"), "copies")

    def sample(batches):
        held, n = [], 0

        def written():
            h, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            h = bt.mix(h)  # the least of many ranks is small; mixed, they spread over all ranges
            out = list(_rows((h >> shift).astype(np.int64), ranges, doc, (h >> (shift - np.uint64(24))).astype(np.uint32) & np.uint32(0xFFFFFF), at))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["range", "payload"])

        for batch in bt.slices(map(_without_null_ids, batches)):
            data, offsets = bt.buffers(batch.column("text"))
            h, _, chosen = _anchors(data, offsets, seed, threshold)
            places = np.flatnonzero(chosen)
            of = _text_of(places, offsets)
            held.append((h[places], batch.column("doc_id").to_numpy()[of], (places - offsets[of]).astype(np.int32)))
            n += places.size
            if n >= GATHER:
                yield written()
                held, n = [], 0
        if n:
            yield written()

    def to_parts(doc: np.ndarray, at: np.ndarray) -> pa.Table:
        out = list(_rows(doc % parts, parts, doc, at)) if doc.size else []
        return pa.table({"part": pa.array([k for k, _ in out], pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    def gathered(table: pa.Table, *kinds: str) -> list[np.ndarray]:
        each = [_unpacked(p.as_py(), "i8", *kinds) for p in table.column("payload")]
        sums = lambda i: np.concatenate([np.cumsum(e[i], dtype=e[i].dtype) for e in each])
        return [sums(0), *(np.concatenate([e[i + 1] for e in each]) for i in range(len(kinds) - 1)), sums(len(kinds))]

    def shared(table: pa.Table) -> pa.Table:
        """Sampled places whose rank two documents have."""
        doc, h, at = gathered(table, "u4", "i4")
        order = np.lexsort((doc, h))
        h, doc, at = h[order], doc[order], at[order]
        cuts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        several = doc[cuts[:-1]] != doc[cuts[1:] - 1]
        keep = np.repeat(several, np.diff(cuts))
        doc, at = doc[keep], at[keep]
        order = np.lexsort((at, doc))
        return to_parts(doc[order], at[order])

    def by_doc(table: pa.Table) -> dict[int, np.ndarray]:
        """The places of each document."""
        table = table.filter(table.column("payload").is_valid()) if table.num_rows else table
        if not table.num_rows:
            return {}
        doc, at = gathered(table, "i4")
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order]
        cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
        return {int(doc[a]): at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}

    def pairs(texts: pa.Table, found: pa.Table) -> pa.Table:
        """Pairs of ranks of every place whose string has its least rank at a place that is shared."""
        places_of, out, seen = by_doc(found), [], set()
        wanted = texts.filter(pa.compute.is_in(texts.column("doc_id"), pa.array(list(places_of), pa.int64()))) if places_of else texts.slice(0, 0)
        for batch in bt.slices(wanted.select(["doc_id", "text"]).to_batches()):
            data, offsets = bt.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            h, fits, _ = _anchors(data, offsets, seed, threshold)
            if not fits.size:
                continue
            common = np.full(h.size, np.iinfo(np.uint64).max)
            for i, doc in enumerate(ids.tolist()):
                places = places_of[doc][places_of[doc] <= offsets[i + 1] - offsets[i] - seed] + offsets[i]
                common[places] = h[places]
                if doc in seen:
                    fits[offsets[i] : offsets[i + 1]] = False
                seen.add(doc)
            width = threshold - seed + 1
            least = _sliding(h, width, np.minimum)
            starts = np.flatnonzero(fits & (_sliding(common, width, np.minimum) == least))
            of = _text_of(starts, offsets)
            # dealt out by their least rank: neighbours mostly share it, so their places travel together and cost next to nothing
            rank = bt.pair(h[starts], h[starts + (threshold - seed)]) & RANK_MASK
            out.append(((bt.mix(least[starts]) >> shift).astype(np.int64), ids[of], rank, (starts - offsets[of]).astype(np.int32)))
        key, doc, rank, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, k) for k in ("i8", "i8", "u8", "i4"))
        made = list(_rows(key, ranges, doc, rank, at))
        return pa.table({"range": pa.array([k for k, _ in made], pa.int32()), "payload": pa.array([p for _, p in made], pa.binary())})

    def later(table: pa.Table) -> pa.Table:
        """Places whose pair of ranks an earlier document has."""
        doc, rank, at = gathered(table, "u8", "i4")
        order = np.lexsort((doc, rank))
        rank, doc, at = rank[order], doc[order], at[order]
        cuts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1], [True])))
        keep = doc > np.repeat(doc[cuts[:-1]], np.diff(cuts))
        doc, at = doc[keep], at[keep]
        order = np.lexsort((at, doc))
        return to_parts(doc[order], at[order])

    def result(texts: pa.Table, found: pa.Table) -> pa.Table:
        places_of = by_doc(found)
        copied = set(found.column("copy_id").drop_null().to_pylist()) if found.num_rows else set()
        out = []
        for batch in texts.select(["doc_id", "text"]).to_batches():
            data, offsets = bt.buffers(batch.column("text"))
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                n = own.size
                if doc in copied:
                    out.append((doc, n, n, 1, hashlib.sha256(b"").hexdigest()))
                elif doc in places_of:
                    change = np.zeros(n + 1, np.int32)
                    np.add.at(change, places_of[doc], 1)
                    np.add.at(change, places_of[doc] + threshold, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((doc, n, int(gone.sum()), spans, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
                else:
                    out.append((doc, n, 0, 0, hashlib.sha256(own.tobytes()).hexdigest()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    texts = rows.withColumn("part", F.coalesce(F.pmod("doc_id", F.lit(parts)), F.lit(0)).cast("long"))
    sampled = rows.join(copies, "doc_id", "left_anti").mapInArrow(sample, "range int, payload binary")
    found = sampled.groupBy("range").applyInArrow(shared, "part long, payload binary")
    ranked = texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(pairs, "range int, payload binary")
    removed = ranked.groupBy("range").applyInArrow(later, "part long, payload binary")
    removed = removed.withColumn("copy_id", F.lit(None).cast("long")).unionByName(
        copies.select(F.pmod("doc_id", F.lit(parts)).cast("long").alias("part"), F.lit(None).cast("binary").alias("payload"), F.col("doc_id").alias("copy_id")))
    return texts.groupBy("part").cogroup(removed.groupBy("part")).applyInArrow(result, RESULT)
