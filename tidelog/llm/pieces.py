"""SentencePiece encoding and decoding: merges by rank for BPE models, streaming Viterbi for unigram models.

The scores of a BPE model are minus the ranks of its merges, so their sum means nothing: within a segment the adjacent pair of the best rank is merged, the
leftmost first, until none is left (`Merges`). A unigram model's id sequence has the largest sum of scores. Only a window as wide as the longest piece is open at any time: once all
paths that can still win run through one boundary, the ids before it are committed and forgotten. Boundaries that no piece can cross end
segments, and a segment seen before takes its ids from a bounded table.
"""

from __future__ import annotations

import re
import zlib
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import bytetext as bt

SPACE = "▁"
#: Segments whose ids a worker remembers; the table is emptied when it is full. Characters of new segments that go through the window side by side.
REMEMBERED, TOGETHER = 1 << 19, 1 << 17
_PRIME = np.uint64(0x100000001B3)


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class StreamingViterbi:
    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = {}
        self.bytes = {}
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                self.bytes[int(m.id_to_piece(i)[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.pieces[m.id_to_piece(i)] = (m.get_score(i), i)
        self.longest = max(map(len, self.pieces), default=1)
        self.begins = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self.unknown = m.unk_id()
        self.worst = min((s for s, _ in self.pieces.values()), default=0.0) - 10.0
        # a space sign after another character is a boundary that no piece crosses, unless some piece has one there; so are
        # both sides of a line break, unless some longer piece has one
        crossing = any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.pieces)
        self.segment = None if crossing else re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self._tables()
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _tables(self) -> None:
        """For each length: sorted hashes of all beginnings of pieces, and score and id of those that are pieces."""
        self.by_length = []
        for n in range(1, self.longest + 1):
            rows = sorted((self._hash(p), *self.pieces.get(p, (-np.inf, -1))) for p in self.begins if len(p) == n)
            h, score, ids = zip(*rows, strict=True)
            self.by_length.append((np.array(h, np.uint64), np.array(score), np.array(ids, np.int32)))

    @staticmethod
    def _hash(p: str) -> int:
        h = 0xCBF29CE484222325
        for c in p:
            h = ((h ^ ord(c)) * int(_PRIME)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def side_by_side(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of segments, and how many each has. All of which go through the window in step. Their ends are boundaries where all paths meet."""
        order = sorted(range(len(segments)), key=lambda k: -len(segments[k]))
        size = np.array([len(segments[k]) for k in order])
        points = np.frombuffer("".join(segments[k] for k in order).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        first = np.cumsum(size) - size
        room = np.repeat(first + size, size) - np.arange(points.size)
        score = np.full((self.longest, points.size), -np.inf)
        piece = np.full((self.longest, points.size), -1, np.int32)
        at, h = np.arange(points.size), np.full(points.size, 0xCBF29CE484222325, np.uint64)
        for n, (known, scores, ids) in enumerate(self.by_length):
            ok = room[at] > n
            at, h = at[ok], (h[ok] ^ points[at[ok] + n]) * _PRIME
            h ^= h >> np.uint64(29)
            found = np.minimum(np.searchsorted(known, h), known.size - 1)
            ok = known[found] == h
            at, h, found = at[ok], h[ok], found[ok]
            score[n, at], piece[n, at] = scores[found], ids[found]
        score[0] = np.where(np.isinf(score[0]), self.worst, score[0])
        best, back = np.full((self.longest + 1, size.size), -np.inf), np.zeros((int(size.max()), size.size), np.int8)
        best[0] = 0.0
        for e in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -e, side="right"))
            top, step = np.full(live, -np.inf), np.zeros(live, np.int8)
            for n in range(min(e, self.longest), 0, -1):
                total = best[(e - n) % (self.longest + 1), :live] + score[n - 1, first[:live] + e - n]
                more = total > top
                top[more], step[more] = total[more], n
            best[e % (self.longest + 1), :live], back[e - 1, :live] = top, step
        who, end, parts = np.arange(size.size), size.copy(), []
        while who.size:
            step = back[end - 1, who].astype(np.int64)
            parts.append((who, end - step, piece[step - 1, first[who] + end - step]))
            end = end - step
            who, end = who[end > 0], end[end > 0]
        who, begin, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        lacking = set(np.unique(who[ids < 0]).tolist())  # segments with characters that no piece has
        line = np.lexsort((begin, np.array(order)[who]))
        ids, sizes = ids[line], np.bincount(np.array(order)[who], minlength=len(segments))
        if lacking:
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            each = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for j in lacking:
                each[order[j]] = np.array([i for part in self.stream(segments[order[j]]) for i in part], np.int32)
            ids, sizes = np.concatenate(each), np.array(list(map(len, each)))
        return ids, sizes

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has."""
        if self.segment is None:
            each = [self.encode(t) for t in texts]
            return np.array([i for x in each for i in x], np.int32), np.array(list(map(len, each)), np.int64)
        if len(self.number) > REMEMBERED:
            self.forget()
        old, flat, counts = len(self.number), [], []
        for t in texts:
            found = self.segment.findall(self.model.normalize(t)) if t else []
            flat.extend(map(self.number.__getitem__, found))
            counts.append(len(found))
        new = list(islice(reversed(self.number), len(self.number) - old))[::-1]
        part, chars, added = [], 0, []
        for x in [*new, None]:
            if part and (x is None or chars > TOGETHER or len(x) > 48):
                added.append(self.side_by_side(part))
                part, chars = [], 0
            if x is not None and len(x) > 48:
                own = [i for ids in self.stream(x) for i in ids]
                added.append((np.array(own, np.int32), np.array([len(own)])))
            elif x is not None:
                part.append(x)
                chars += len(x)
        if added:
            self.flat = np.concatenate((self.flat, *(ids for ids, _ in added)))
            self.sizes = np.concatenate((self.sizes, *(n for _, n in added)))
            self.starts = np.cumsum(self.sizes) - self.sizes
        order = np.array(flat, np.int64)
        n = self.sizes[order]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.arange(int(ends[-1])) - np.repeat(ends[:-1], n) + np.repeat(self.starts[order], n)]
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))])

    def stream(self, text: str):
        """Lists of ids, each as soon as nothing that follows can change it."""
        pieces, begins, longest, worst = self.pieces, self.begins, self.longest, self.worst
        n, done, reach = len(text), 0, 0
        best: dict[int, float] = {0: 0.0}
        back: dict[int, tuple[int, int]] = {}
        for i in range(n):
            score = best.pop(i)
            if i and (reach == i or i - done >= 4 * longest):
                to = i if reach == i else self._meeting(back, range(i, reach + 1), done)
                if to > done:
                    yield self._path(text, back, done, to)
                    for k in [k for k in back if k <= to]:
                        del back[k]
                    done = to
            end, single = i + 1, False
            while end <= n and text[i:end] in begins:
                found = pieces.get(text[i:end])
                if found:
                    single = single or end == i + 1
                    total = score + found[0]
                    if end not in best or total > best[end]:
                        best[end], back[end] = total, (i, found[1])
                        reach = max(reach, end)
                end += 1
            if not single:  # no piece for this character: its bytes, or the unknown id
                total = score + worst
                if i + 1 not in best or total > best[i + 1]:
                    best[i + 1], back[i + 1] = total, (i, -1)
                    reach = max(reach, i + 1)
        if n > done:
            yield self._path(text, back, done, n)

    @staticmethod
    def _meeting(back: dict, ends, done: int) -> int:
        """The last boundary that the paths to all open ends run through."""
        open_ends = {e for e in ends if e in back}
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.discard(last)
            open_ends.add(back[last][0] if last > done else done)
        return next(iter(open_ends), done)

    def _path(self, text: str, back: dict, start: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > start:
            at, piece = back[end]
            if piece >= 0:
                out.append([piece])
            elif self.bytes:
                out.append([self.bytes[b] for b in text[at:end].encode()])
            else:
                out.append([self.unknown])
            end = at
        return [i for ids in reversed(out) for i in ids]

    def encode(self, text: str) -> list[int]:
        """One text, as a stream."""
        return [i for ids in self.stream(self.model.normalize(text)) for i in ids] if text else []

    def decode(self, ids: list[int]) -> str:
        """The normalised text, without the space that normalising puts before it."""
        if not hasattr(self, "_raw"):
            of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
            size = self.model.get_piece_size()
            self._raw = [of_byte.get(i) or self.model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        text = b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def plain(self, text: str) -> str:
        """What decoding the ids of text gives: the text as the model normalises it."""
        text = self.model.normalize(text).replace(SPACE, " ") if text else ""
        return text[1:] if text.startswith(" ") else text


class Merges(StreamingViterbi):
    """The ids of a BPE model. A segment's are complete at its end, where they are committed."""

    def _tables(self) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        if not self.bytes or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces):
            raise ValueError("a BPE model needs byte pieces, and no user-defined or unused ones")
        symbols = sorted({*self.pieces, *(c for p in self.pieces for c in p)})
        self.symbol = number = {s: k for k, s in enumerate(symbols)}
        self.id_of = np.array([self.pieces[s][1] if s in self.pieces else -1 for s in symbols], np.int32)
        self.of_point = np.full(0x110000, -1, np.int64)
        for s, k in number.items():
            if len(s) == 1:
                self.of_point[ord(s)] = k
        rows = sorted((number[p[:n]] << 32 | number[p[n:]], score, number[p]) for p, (score, _) in self.pieces.items()
                      for n in range(1, len(p)) if p[:n] in number and p[n:] in number)
        pairs, scores, merged = zip(*rows, strict=True)
        self.pairs, self.scores, self.merged = np.array(pairs, np.int64), np.array([*scores, -np.inf]), np.array([*merged, -1], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The row of each pair of symbols, the last one for pairs that do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), self.pairs.size - 1)
        return np.where(self.pairs[at] == key, at, self.pairs.size)

    def side_by_side(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of segments, and how many each has. Every round merges one pair in each segment that has any."""
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(len(segments)), np.fromiter(map(len, segments), np.int64, len(segments)))
        symbol = self.of_point[points]
        lacking = np.unique(of[np.where(symbol < 0, -1, self.id_of[symbol]) < 0])  # segments with characters that no piece has
        own = ~np.isin(of, lacking)
        symbol, of, done, none = symbol[own], of[own], [], self.pairs.size
        row = np.full(symbol.size, none)
        inner = np.flatnonzero(of[1:] == of[:-1])
        row[inner] = self._pair(symbol[inner], symbol[inner + 1])
        while symbol.size:
            score = self.scores[row]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            sizes = np.diff(starts, append=of.size)
            best = np.repeat(np.maximum.reduceat(score, starts), sizes)
            live = np.isfinite(best)
            done.append((of[~live], self.id_of[symbol[~live]]))
            at = np.flatnonzero(live & (score == best))
            at = at[np.diff(of[at], prepend=-1) > 0]  # the leftmost of each segment
            symbol[at] = self.merged[row[at]]
            row[at] = row[at + 1]
            live[at + 1] = False
            place = np.cumsum(live) - 1
            at, symbol, row, of = place[at], symbol[live], row[live], of[live]
            for left in (at - 1, at):
                left = left[(left >= 0) & (left + 1 < of.size)]
                left = left[of[left] == of[left + 1]]
                row[left] = self._pair(symbol[left], symbol[left + 1])
        for j in lacking.tolist():
            ids = self._merge(segments[j])
            done.append((np.full(len(ids), j), np.array(ids, np.int32)))
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(of, kind="stable")].astype(np.int32), np.bincount(of, minlength=len(segments))

    def _merge(self, text: str) -> list[int]:
        """The ids of one segment of any length, by a heap of pairs."""
        pieces, part = self.pieces, list(text)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i, j: (-pieces[part[i] + part[j]][0], i, part[i], part[j], j)
        heap = [pair(i, i + 1) for i in range(n - 1) if part[i] + part[i + 1] in pieces]
        heapify(heap)
        while heap:
            _, i, a, b, j = heappop(heap)
            if part[i] != a or part[j] != b or after[i] != j:
                continue  # one of the two has been merged since
            part[i], part[j], after[i] = a + b, "", after[j]
            k, h = after[i], before[i]
            if k < n:
                before[k] = i
                if part[i] + part[k] in pieces:
                    heappush(heap, pair(i, k))
            if h >= 0 and part[h] + part[i] in pieces:
                heappush(heap, pair(h, i))
        out: list[int] = []
        for p in filter(None, part):
            if p in pieces:
                out.append(pieces[p][1])
            else:
                out.extend(self.bytes[b] for b in p.encode())
        return out

    def stream(self, text: str):
        """Lists of ids, one for each segment."""
        for found in self.segment.finditer(text) if self.segment else [re.compile("(?s).+").match(text)]:
            yield self._merge(found.group())


def encoder(path: str) -> StreamingViterbi:
    """The encoder that gives the model's own ids."""
    if path not in _ENCODERS:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(SentencePieceProcessor(model_file=path).serialized_model_proto()).trainer_spec
        _ENCODERS[path] = Merges(path) if spec.model_type == spec.BPE else model(path)
    return _ENCODERS[path]


_MODELS: dict[str, StreamingViterbi] = {}
_ENCODERS: dict[str, StreamingViterbi] = {}


def model(path: str) -> StreamingViterbi:
    if path not in _MODELS:
        _MODELS[path] = StreamingViterbi(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids, ids_crc32 (little-endian 32 bits each), round_trip (decoding gave the normalised text) for every row of docs.

    A null or empty text has no ids. Rows stay as they are, repeated ones too; a null doc_id stays null; other columns are ignored.
    """

    def run(batches):
        m = encoder(path)
        for batch in bt.slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, n = m.encode_many(texts)
            offsets = np.concatenate(([0], np.cumsum(n)))
            raw, listed = ids.astype("<u4").tobytes(), ids.tolist()
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans]
            trip = [m.decode(listed[a:b]) == m.plain(t) for (a, b), t in zip(spans, texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n), lists, pa.array(crc, pa.int64()), pa.array(trip)], names=["doc_id", "n_ids", "ids", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, ids_crc32 long, round_trip boolean")
