"""Token-id files with Re-Pair grammar compression.

Spark deals documents out by ranges of doc_id and sorts each range; a task cuts its documents into shards of some megabytes. A shard's ids, with an end id after
each document, are compressed by a grammar: frequent pairs of neighbouring ids become nonterminals, again and again. A file row holds the rules, each symbol's expansion
length, the compressed ids and where each document begins in them, so that a single document can be decoded without the rest of its shard.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidelog.llm import bytetext as bt
from tidelog.llm.common import Scratch

END_ID = 0
#: Bytes of text of a shard, and of a range of doc_ids that one task writes.
SHARD_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
#: A pair becomes a nonterminal if a shard has it so many times: a rule takes 12 bytes, and each use of it saves 4.
LEAST_PAIRS = 4
#: Pieces whose ids a task's process remembers, and bytes of these; beyond either it keeps half of the pieces, those that most shards had.
REMEMBERED, REMEMBERED_BYTES = 700_000, 32 << 20
FILE = ("part int, shard int, vocabulary int, nulls long, doc_ids binary, starts binary, n_tokens binary, symbols binary, rules binary, lengths binary, total long")
_JOINED = 64
#: Classes of bytes: space, line feed, ASCII letters, digits, apostrophe, other printable ASCII, first bytes of characters none of which is white space. All others are 0.
_SPACE, _FEED, _LETTER, _DIGIT, _QUOTE, _MARK, _LEAD = range(1, 8)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[32, 10, 39]] = _SPACE, _FEED, _QUOTE
_CLASS[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = _LEAD
#: Pairs of classes between which a match of the byte-level pattern always ends, the first no white space: a letter or number run ends before anything else, a run of
#: marks before a letter or digit (an apostrophe may begin "'s", so none ends behind it), every one of them before white space.
_ENDS = np.zeros((8, 8), bool)
_ENDS[_LETTER, [_SPACE, _FEED, _DIGIT, _QUOTE, _MARK]] = True
_ENDS[_DIGIT, [_SPACE, _FEED, _LETTER, _QUOTE, _MARK]] = True
_ENDS[_MARK, [_SPACE, _FEED, _LETTER, _DIGIT]] = True
_ENDS[_QUOTE, [_SPACE, _FEED]] = True
_ENDS = _ENDS[_CLASS[:, None], _CLASS[None, :]].ravel()  # by two bytes
_PLAIN = np.isin(np.arange(8), [_LETTER, _DIGIT, _MARK, _QUOTE])


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if ends.size else 0) + np.repeat(starts - (ends - sizes), sizes)]


class PieceEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, each distinct piece once.

    Texts are cut only where byte-level pre-tokenizing always splits, whatever stands around, so the ids of a text are those of its pieces, one after another.
    Pieces that begin with a space and end with none can be encoded in one string; the ids' byte lengths tell them apart. Texts with an added token in them are
    not cut, nor are any if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads would only contend with other tasks
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        byte_level = set(pre_tokenizers.ByteLevel.alphabet())
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.vocabulary)]
        self.bytes = np.array([len(x) if byte_level.issuperset(x) else len(x.encode()) for x in names], np.int64)  # a byte-level name has a character for each byte
        said = json.loads(self.tokenizer.to_str())
        split = said["pre_tokenizer"] or {}
        self.cuts = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not any(said[k] for k in ("normalizer", "truncation", "padding"))
        self.added = [x["content"] for x in said["added_tokens"]]
        self.cuts = self.cuts and not any(" " in x for x in self.added)
        self.known, self.held = {}, 0  # number of each piece
        self.ids, self.sizes, self.starts, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keeps half as many pieces and bytes as may be remembered: of pieces that came in two shards or more, those of most shards."""
        names, stay = list(self.known), np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
        stay = stay[self.uses[stay] > 1]
        stay = stay[np.cumsum([len(names[k]) for k in stay.tolist()], dtype=np.int64) <= REMEMBERED_BYTES // 2]
        self.known = {names[k]: number for number, k in enumerate(stay.tolist())}
        self.held = sum(map(len, self.known))
        self.ids, self.sizes, self.uses = gather(self.ids, self.starts[stay], self.sizes[stay]), self.sizes[stay], self.uses[stay]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces, behind those known."""
        easy = [self.cuts and p[0] == " " and not p[-1].isspace() for p in new]
        joined, alone = [p for p, e in zip(new, easy, strict=True) if e], [p for p, e in zip(new, easy, strict=True) if not e]
        groups = [joined[k : k + _JOINED] for k in range(0, len(joined), _JOINED)]
        each = [x.ids for x in self.tokenizer.encode_batch_fast(["".join(g) for g in groups] + alone, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(each), np.uint32)
        upto, ends = np.cumsum(self.bytes[ids[: sum(map(len, each[: len(groups)]))]]), np.cumsum(pc.binary_length(pa.array(joined, pa.large_string())).to_numpy())
        at = np.searchsorted(upto, ends)
        if ends.size and (upto[-1] != ends[-1] or (upto[at] != ends).any()):
            raise ValueError("the tokenizer's ids do not end where pieces do; it is not byte-level")
        sizes = (np.diff(at + 1, prepend=0), np.fromiter(map(len, each[len(groups) :]), np.int64, len(alone)))
        self.known.update(zip(joined + alone, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.held += sum(map(len, new))
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, *sizes))
        self.starts, self.uses = np.cumsum(self.sizes) - self.sizes, np.append(self.uses, np.zeros(len(new), np.int32))

    def _cut(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        begins = np.zeros(data.size + 1, bool)
        if self.cuts and data.size > 2:
            begins[1:-1] = _ENDS.take(data[:-1].astype(np.uint16) << np.uint16(8) | data[1:])
            space = np.flatnonzero((data[3:] == 32) & (data[2:-1] >= 0x80)) + 3
            # before a space behind a character of two or three bytes that is no white space (the first of three is then beyond E3, of two beyond C2)
            last, second, third = data[space - 1], data[space - 2], data[space - 3]
            begins[space[(last & 0xC0 == 0x80) & (((second >= 0xC3) & (second < 0xE0)) | ((second & 0xC0 == 0x80) & (third >= 0xE4) & (third < 0xF0)))]] = True
            # behind one line feed between others: two or more of them are split by what follows
            feed = np.flatnonzero(data == 10)
            feed = feed[(feed > 0) & (feed < data.size - 1)]
            behind = _CLASS[data[feed + 1]]
            begins[feed[_PLAIN[_CLASS[data[feed - 1]]] & (_PLAIN[behind] | (behind == _LEAD))] + 1] = True
            for x in self.added:
                for k in np.flatnonzero(pc.match_substring(column, x).to_numpy(zero_copy_only=False)).tolist():
                    begins[offsets[k] : offsets[k + 1]] = False
        begins[offsets] = True
        begins[-1] = False
        return np.flatnonzero(begins)

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all distinct pieces, how many each has, the pieces of the texts (by number), and how many each text has."""
        column = column.cast(pa.large_string()).fill_null("")
        data, offsets = bt.buffers(column)
        begins = self._cut(column, data, offsets)
        ends = np.append(begins, data.size)
        words = pa.LargeStringArray.from_buffers(begins.size, pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._forget()
        numbers = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(numbers < 0)
        new = [names[k] for k in missing.tolist()]
        self._learn(new)
        numbers[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.uses[numbers] += 1
        sizes = self.sizes[numbers]
        return gather(self.ids, self.starts[numbers], sizes), sizes, words.indices.to_numpy(), np.diff(np.searchsorted(begins, offsets))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids, sizes, numbers, counts = self.pieces(column)
        upto = np.concatenate(([0], np.cumsum(sizes[numbers])))[np.concatenate(([0], np.cumsum(counts)))]
        return gather(ids, (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]), np.diff(upto)


def _sorted_pairs(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (of two symbols of so many bits) in order, and the place of each."""
    if 2 * bits + int(keys.size).bit_length() > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    shift = np.uint64(64 - 2 * bits)  # sorting keys with their places below them is faster than sorting places by keys
    both = np.sort(keys << shift | np.arange(keys.size, dtype=np.uint64))
    return both >> shift, (both & np.uint64((1 << int(shift)) - 1)).astype(np.int64)


def repair(ids: np.ndarray, starts: np.ndarray, vocabulary: int, *, least: int = LEAST_PAIRS, rules: np.ndarray | None = None, weights: np.ndarray | None = None):
    """symbols, starts in them, rules (left, right of each nonterminal, which are numbered from `vocabulary` on).

    Every round counts all pairs and replaces those that occur `least` times or more: where two overlap, the more frequent one is taken, and of equally
    frequent ones in a row the first, then every other. Rounds go on until none is so frequent. No nonterminal crosses the start of a document.
    ids may hold nonterminals of earlier `rules`; new ones come behind these. weights: how often each document counts.
    """
    rules = [np.zeros((0, 2), np.uint32) if rules is None else rules]
    symbols, starts, n_rules = ids.astype(np.uint32), starts.astype(np.int64), len(rules[0])
    weight = None if weights is None else np.repeat(weights, np.diff(np.append(starts, symbols.size)))
    ends = np.zeros(symbols.size, bool)  # the last symbol of a document
    ends[starts[starts > 0] - 1] = True
    ends[-1:] = True
    # A pair of old symbols gets no more frequent, so only the places of frequent pairs and those at new symbols are counted after the first round
    hot, bounds = np.flatnonzero(~ends), np.concatenate(([0], np.flatnonzero(ends) + 1))
    while hot.size:
        bits = int(vocabulary + n_rules).bit_length()
        keys = symbols[hot].astype(np.uint64) << np.uint64(bits) | symbols[hot + 1]
        ordered, order = _sorted_pairs(keys, bits)
        cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        times = np.diff(cuts)
        often = times if weight is None else np.add.reduceat(weight[hot][order], cuts[:-1])
        frequent = often >= least
        if not frequent.any():
            break
        rank = np.empty(keys.size, np.int32)
        rank[order] = np.repeat(np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32), times)
        pairs, often = ordered[cuts[:-1][frequent]], often[frequent]
        hot, rank = hot[rank >= 0], rank[rank >= 0]
        # a place gives way to a more frequent pair that it shares a symbol with
        count, beside = often[rank], np.diff(hot) == 1
        stays = np.ones(hot.size, bool)
        stays[:-1] &= ~(beside & (count[1:] > count[:-1]))
        stays[1:] &= ~(beside & (count[:-1] > count[1:]))
        places, rank = hot[stays], rank[stays]
        run_starts = np.concatenate(([True], np.diff(places) != 1))
        run, first = np.cumsum(run_starts) - 1, np.flatnonzero(run_starts)
        taken = (np.arange(places.size) - first[run]) % 2 == 0
        places, rank = places[taken], rank[taken]
        worth = np.bincount(rank, weights=None if weight is None else weight[places], minlength=pairs.size) >= least
        if not worth.any():
            break
        places, rank = places[worth[rank]], (np.cumsum(worth) - 1)[rank[worth[rank]]]
        pairs = pairs[worth]
        symbols[places] = (vocabulary + n_rules + rank).astype(np.uint32)
        rules.append(np.stack((pairs >> np.uint64(bits), pairs & np.uint64((1 << bits) - 1)), 1).astype(np.uint32))
        n_rules += pairs.size
        stays = np.ones(symbols.size, bool)
        stays[places + 1] = False
        ends[places] = ends[places + 1]
        mark = np.zeros(symbols.size, bool)
        mark[hot] = True
        mark[places] = True
        mark = mark[stays]
        places = places - np.arange(places.size)
        mark[places[places > 0] - 1] = True
        symbols, ends = symbols[stays], ends[stays]
        weight = None if weight is None else weight[stays]
        hot = np.flatnonzero(mark & ~ends)
    starts = np.concatenate(([0], np.flatnonzero(ends) + 1))[np.searchsorted(bounds, starts)]
    return symbols, starts, np.concatenate(rules)


def compress(ids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, counts: np.ndarray, vocabulary: int, end_id: int, **options):
    """symbols, starts, rules, and ids of each document, from its pieces (see PieceEncoder.pieces). Pairs within distinct pieces are replaced first, each
    counted as often as its piece occurs, then pairs of all that is left."""
    uses = np.bincount(numbers, minlength=sizes.size)
    within, at, rules = repair(ids, np.cumsum(sizes) - sizes, vocabulary, weights=uses, **options)
    # the end id is one more piece, behind those of each document
    n_tokens = np.diff(np.concatenate(([0], np.cumsum(sizes[numbers])))[np.concatenate(([0], np.cumsum(counts)))]) + 1
    numbers = np.insert(numbers.astype(np.int64), np.cumsum(counts), sizes.size)
    at, within = np.append(at, within.size), np.append(within, np.uint32(end_id))
    lengths = np.diff(np.append(at, within.size))
    begins = np.concatenate(([0], np.cumsum(lengths[numbers])))[np.cumsum(counts + 1) - counts - 1]
    return *repair(gather(within, at[numbers], lengths[numbers]), begins, vocabulary, rules=rules, **options), n_tokens


def lengths_of(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Expansion length of each nonterminal. A rule only uses symbols with smaller numbers, so as many steps as rules are nested settle all."""
    out = np.ones(len(rules), np.int64)
    left, right = rules[:, 0].astype(np.int64) - vocabulary, rules[:, 1].astype(np.int64) - vocabulary
    while True:
        new = np.where(left >= 0, out[np.maximum(left, 0)], 1) + np.where(right >= 0, out[np.maximum(right, 0)], 1)
        if (new == out).all():
            return out
        out = new


def expand(symbols: np.ndarray, rules: np.ndarray, vocabulary: int, lengths: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for; works on any slice of a shard's symbols. lengths: of the rules' expansions."""
    sizes = lambda x: np.where(x >= vocabulary, lengths[np.maximum(x.astype(np.int64) - vocabulary, 0)], 1) if lengths.size else np.ones(x.size, np.int64)
    n = sizes(symbols).astype(np.int64)
    at, out = np.cumsum(n) - n, np.empty(int(n.sum()), np.uint32)
    while symbols.size:
        plain = symbols < vocabulary
        out[at[plain]] = symbols[plain]
        rule, at = rules[symbols[~plain] - vocabulary], at[~plain]
        symbols, at = np.concatenate((rule[:, 0], rule[:, 1])), np.concatenate((at, at + sizes(rule[:, 0])))
    return out


def expand_all(symbols: np.ndarray, rules: np.ndarray, vocabulary: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that a whole shard's symbols stand for, and how many each symbol has. Each rule is expanded once, unless that takes more room than the shard."""
    each = np.concatenate((np.ones(vocabulary, np.int64), lengths))
    sizes = each[symbols]
    if int(lengths.sum()) > int(sizes.sum()):
        return expand(symbols, rules, vocabulary, lengths), sizes
    flat = np.concatenate((np.arange(vocabulary, dtype=np.uint32), expand(np.arange(vocabulary, vocabulary + len(rules), dtype=np.uint32), rules, vocabulary, lengths)))
    return gather(flat, (np.cumsum(each) - each)[symbols], sizes), sizes


def _shards(batches, most: int):
    """Tables of consecutive documents of about `most` bytes of text; a longer text is in a shard by itself."""
    held, size = [], 0
    for batch in bt.slices(batches, most=max(1, most // 4)):
        n = batch.column("text").nbytes
        if held and size + n > most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> None:
    """Writes one file row per shard (see FILE) to path: documents in ascending doc_id order (null first; rows of equal doc_id by a hash of their text, then by text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        for number, table in enumerate(_shards(batches, shard_bytes)):
            nulls = table.column("doc_id").null_count
            doc_ids = table.column("doc_id").fill_null(0).to_numpy()
            vocabulary = encoder.vocabulary
            symbols, starts, rules, n = compress(*encoder.pieces(table.column("text").combine_chunks()), vocabulary, end_id)
            lengths = lengths_of(rules, vocabulary)
            raw = lambda x: pa.array([x.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([vocabulary], pa.int32()), pa.array([nulls], pa.int64()), raw(doc_ids),
                raw(starts.astype(np.int64)), raw(n.astype(np.int64)), raw(symbols), raw(rules), raw(lengths.astype(np.uint32)), pa.array([int(n.sum())], pa.int64())],
                names=[x.split()[0] for x in FILE.split(", ")])

    ranged = rows.repartitionByRange(max(1, -(-size // range_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ranged.select("doc_id", "text").mapInArrow(run, FILE).write.mode("overwrite").option("compression", "zstd").parquet(path)


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def read_document(row: dict, number: int) -> np.ndarray:
    """Random access: the ids of one document of a file row."""
    starts = np.frombuffer(row["starts"], np.int64)
    symbols, rules = np.frombuffer(row["symbols"], np.uint32), np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    end = starts[number + 1] if number + 1 < starts.size else symbols.size
    return expand(symbols[starts[number] : end], rules, row["vocabulary"], np.frombuffer(row["lengths"], np.uint32))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_symbols of every document, decoded from the file rows."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules = np.frombuffer(row["symbols"], np.uint32), np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
                lengths = np.frombuffer(row["lengths"], np.uint32)
                ids, sizes = expand_all(symbols, rules, row["vocabulary"], lengths)
                ids = ids.astype("<u4", copy=False)
                starts, doc_ids = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["doc_ids"], np.int64)
                null = np.arange(doc_ids.size) < row["nulls"]  # they come first
                at = np.concatenate(([0], np.cumsum(sizes)))  # where each symbol's ids begin
                begin = at[starts]
                end = np.append(begin[1:], ids.size)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), pa.array(doc_ids, mask=null), pa.array(begin), pa.array(end - begin), pa.array(crc, pa.int64()),
                    pa.array(np.diff(np.append(starts, symbols.size)))], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32", "n_symbols"])

    each = files.mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long, n_symbols long")
    # ids before each range of doc_ids (a row for each range), and before each shard in its range
    ranges = files.groupBy("part").agg(F.sum("total").alias("total"))
    ranges = ranges.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("total").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = files.select("part", "shard", within.alias("within")).join(ranges, "part").select("part", "shard", (F.col("earlier") + F.col("within")).alias("before"))
    return each.join(before, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_symbols")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes docs' token files to the shared folder and returns what read_token_files gets from them. A null text is empty: its only id is the end id."""
    scratch = Scratch(docs.sparkSession)
    write_token_files(docs, scratch.path("files"), tokenizer, **options)
    return read_token_files(docs.sparkSession.read.schema(FILE).parquet(scratch.path("files")))
