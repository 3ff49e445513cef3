"""Byte-level BPE by a rank queue, and the way back.

Each text is split by the vocabulary's pattern.  New pre-tokens of several texts
are merged together: their bytes are nodes of linked lists, and every pair that
the vocabulary can merge stands in the bucket of its rank.  A bitmap of three
levels tells which buckets hold positions, so the least rank is found by three
find-first-set steps however many ranks there are.  A merge relinks three nodes
and queues at most two new pairs; entries whose pair has changed since are
skipped.  The work grows with n log n, whether a text is one pre-token of a
million bytes or many of five.  Of one rank the leftmost position goes first,
and a lower rank that a merge makes possible goes before the rest of a bucket.

Pre-tokens met before come from a bounded memory, which Python workers keep.

Defined cases: a null or empty text has no tokens and is decoded as an empty
one.  Rows are encoded one by one, whatever their ids.  Texts are whole; those
of many megabytes are taken in slices that end between pre-tokens.  Ids are
packed as little-endian unsigned 32-bit integers, or arrays on request.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A public file of ranks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions in buckets by rank; the least rank that holds any is found by find-first-set."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: list[list[int] | None] = [None] * (ranks + 1)

    def put(self, rank: int, positions: list[int]) -> None:
        """Positions of a rank that holds none."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def least(self) -> int:
        top = (self.top & -self.top).bit_length() - 1
        word = self.middle[top]
        word = top << 6 | (word & -word).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """A rank's bucket, which holds nothing after that."""
        bucket, self.buckets[rank] = self.buckets[rank], None
        word, top = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[top] &= ~(1 << (word & 63))
            if not self.middle[top]:
                self.top &= ~(1 << top)
        return bucket


#: Bytes from which a pre-token is merged on its own, and positions from which a bucket is emptied by arrays.
LONG, MANY = 256, 24


class Merger:
    """Token ids of pre-tokens, many at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.most = max(ranks.values(), default=0)
        self.shift = self.most.bit_length()
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = np.full(1 << 16, -1, np.int32)
        self.pairs: dict[int, int] = {}  # left << shift | right: rank of both together
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0] << 8 | token[1]] = rank
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        keys, together = (np.array(list(x), np.int64) for x in (self.pairs, self.pairs.values()))
        left, right = keys >> self.shift, keys & (1 << self.shift) - 1
        self.after, self.before = self._partners(left, right, together), self._partners(right, left, together)

    def _partners(self, own: np.ndarray, other: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each id where its partners start, the partners in order, and what each makes."""
        order = np.lexsort((other, own))
        return np.searchsorted(own[order], np.arange(self.most + 2)), other[order], together[order]

    @staticmethod
    def _made(partners: tuple[np.ndarray, np.ndarray, np.ndarray], rank: int, tokens: np.ndarray) -> np.ndarray:
        """Rank of ``rank`` together with each token, or -1."""
        starts, others, together = partners
        low, high = starts[rank], starts[rank + 1]
        if low == high:
            return np.full(len(tokens), -1)
        at = low + np.minimum(np.searchsorted(others[low:high], tokens), high - low - 1)
        return np.where(others[at] == tokens, together[at], -1)

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """Packed ids of each part.  A part that is in the vocabulary is one token, whatever its merges."""
        made = [rank.to_bytes(4, "little") if (rank := self.ranks.get(p)) is not None else b"" for p in parts]
        left = [k for k, p in enumerate(parts) if not made[k] and p]
        short = [k for k in left if len(parts[k]) < LONG]
        for group, together in (short, True), *(([k], False) for k in left if len(parts[k]) >= LONG):
            for k, ids in zip(group, self._merge([parts[k] for k in group], together) if group else (), strict=True):
                made[k] = ids
        return made

    def _merge(self, parts: list[bytes], together: bool) -> list[bytes]:
        """All parts in one queue.

        Parts don't touch each other, so the least rank of all is that of each
        part which has it.  ``together`` takes the leftmost position of every
        such part in one step over arrays.
        """
        data = np.frombuffer(b"".join(parts), np.uint8)
        n, sizes = len(data), np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        token, want = self.bytes[data], np.full(n, -1, np.int32)
        want[:-1] = self.byte_pairs[data[:-1].astype(np.int32) << 8 | data[1:]]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        want[ends - 1] = nxt[ends - 1] = prv[ends - sizes] = -1  # nothing joins across parts
        part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes) if together else None
        queue = RankQueue(self.most)
        at = np.flatnonzero(want >= 0)
        at = at[np.argsort(want[at], kind="stable")]
        ranks, starts = np.unique(want[at], return_index=True)
        for rank, some in zip(ranks.tolist(), np.split(at, starts[1:]), strict=False):
            queue.put(rank, some.tolist())
        tokens, nexts, prevs, wants = map(memoryview, (token, nxt, prv, want))
        pair, shift, buckets, put = self.pairs.get, self.shift, queue.buckets, queue.put
        push = list.append if together else heappush
        while queue.top:
            rank = queue.least()
            bucket = queue.take(rank)
            if together and len(bucket) >= MANY:
                p = np.array(bucket, np.int32)
                p = np.sort(p[want[p] == rank])  # the others' pairs have changed since
                first = np.append(True, part[p[1:]] != part[p[:-1]])[: len(p)]
                if not first.all():
                    put(rank, p[~first].tolist())
                p = p[first]
                q, o = nxt[p], prv[p]
                a = nxt[q]
                token[p], token[q], want[q], want[p], nxt[p] = rank, -1, -1, -1, a
                has = a >= 0
                prv[a[has]] = p[has]
                for there, partners, seen in ((p[has], self.after, a[has]), (o[o >= 0], self.before, o[o >= 0])):
                    new = self._made(partners, rank, token[seen])
                    want[there] = new
                    fits = new >= 0
                    for r, where in zip(new[fits].tolist(), there[fits].tolist(), strict=True):
                        if (held := buckets[r]) is None:
                            put(r, [where])
                        else:
                            held.append(where)
                continue
            if together:
                heapify(bucket)
            while bucket:
                p = heappop(bucket)
                if wants[p] != rank:
                    continue
                q = nexts[p]
                a, o = nexts[q], prevs[p]
                tokens[p], tokens[q], wants[q], wants[p], nexts[p] = rank, -1, -1, -1, a
                lower = False
                if a >= 0:
                    prevs[a] = p
                    new = pair(rank << shift | tokens[a], -1)
                    if new >= 0:
                        wants[p] = new
                        lower = new < rank
                        if (held := buckets[new]) is None:
                            put(new, [p])
                        else:
                            push(held, p)
                if o >= 0:
                    wants[o] = new = pair(tokens[o] << shift | rank, -1)
                    if new >= 0:
                        lower = lower or new < rank
                        if (held := buckets[new]) is None:
                            put(new, [o])
                        else:
                            push(held, o)
                if lower and bucket:  # the new pair goes first
                    put(rank, bucket)
                    break
        alive = token >= 0
        packed = token[alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]


def late_letters(pattern_of: str = r"[\p{L}\p{N}]") -> str:
    """Letters and numbers of a newer Unicode than the tiktoken library's, to which they are other signs."""
    import tiktoken

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    unsure = [c for c in regex.findall(pattern_of, everything) if unicodedata.category(c) == "Cn"]
    probe = tiktoken.Encoding("probe", pat_str=pattern_of, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return "".join(c for c in unsure if not probe.encode_ordinary(c))


def ranges(letters: str) -> str:
    """A character class's inside: runs of code points."""
    out: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def spans(text: str, size: int) -> Iterator[str]:
    """The text in slices of about ``size`` characters that end before a single blank between two signs, where a pre-token starts."""
    at = 0
    while len(text) - at > size:
        cut = _BLANK.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: What the default pattern is for ASCII alone, where the standard library's engine is faster.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Encoder:
    """Packed ids of texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str, pattern: str, memory: int = 192 << 20):
        self.merger = Merger(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.ascii = pattern == vocabulary_pattern()
        late = late_letters()
        low = "".join(c for c in late if c < "\U00010000")
        self.late = re.compile(f"[{ranges(late)}]") if late else None
        self.maybe_late = re.compile(f"[{ranges(low)}\U00010000-\U0010FFFF]")  # one look-up a sign
        self.known: dict[str, bytes] = {}
        self.held, self.memory = 0, memory

    def pre_tokens(self, text: str) -> list[str]:
        if self.ascii and text.isascii():
            return _ASCII.findall(text)
        if self.late and self.maybe_late.search(text) and self.late.search(text):  # split as if they were a sign, then cut the text itself
            out, at = [], 0
            for part in self.split(self.late.sub("", text)):
                out.append(text[at : at + len(part)])
                at += len(part)
            return out
        return self.split(text)

    def learn(self, parts: set[str]) -> None:
        if self.held > self.memory:
            self.known.clear()
            self.held = 0
        new = [p for p in parts if p not in self.known]
        for p, ids in zip(new, self.merger.merge([p.encode() for p in new]), strict=True):
            self.known[p] = ids
            self.held += len(p) + len(ids) + 200

    def many(self, texts: Iterable[str | None], chunk: int = 4 << 20) -> Iterator[bytes]:
        """Ids of each text; new pre-tokens of about ``chunk`` characters of texts are merged at once."""
        waiting: list[tuple[list[str], bool]] = []  # pre-tokens of a slice, and whether it ends its text
        held, begun = 0, []
        for text in texts:
            slices = list(spans(text or "", chunk)) if text and len(text) > chunk else [text or ""]
            for k, part in enumerate(slices):
                waiting.append((self.pre_tokens(part), k + 1 == len(slices)))
                held += len(part)
                if held >= chunk:
                    yield from self.flush(waiting, begun)
                    held = 0
        yield from self.flush(waiting, begun)

    def flush(self, waiting: list[tuple[list[str], bool]], begun: list[bytes]) -> Iterator[bytes]:
        self.learn(set().union(*(parts for parts, _ in waiting)))
        known = self.known.__getitem__
        for parts, last in waiting:
            begun.append(b"".join(map(known, parts)))
            if last:
                yield begun[0] if len(begun) == 1 else b"".join(begun)
                begun.clear()
        waiting.clear()


@functools.lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, packed: bool = True) -> DataFrame:
    """Per document: id, n_tokens, ids; packed into bytes, or else an array."""
    path, pattern = path or vocabulary_path(), pattern or vocabulary_pattern()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for b in batches(rows):
            ids = list(encoder.many(b.column("text").to_pylist()))
            sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
            column = pa.array(ids, pa.binary()) if packed else pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), sizes, column], names=["id", "n_tokens", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id long, n_tokens long, ids {'binary' if packed else 'array<int>'}").withColumnRenamed("id", id_col)


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> list[bytes]:
    by_rank = {rank: token for token, rank in load_ranks(path).items()}
    return [by_rank.get(k, b"") for k in range(max(by_rank, default=-1) + 1)]


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` and the bytes that its packed ids stand for; an id outside the vocabulary fails the job."""
    path = path or vocabulary_path()
    names = [*df.columns, bytes_col]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(path).__getitem__
        for b in batches(rows):
            made = [b"".join(map(token, array("I", x))) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in df.dtypes) + f", `{bytes_col}` binary")
