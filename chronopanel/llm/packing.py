"""Best-fit packing planned over a histogram of lengths.

Texts become token ids, each document followed by an end id and cut into pieces
of at most ``size`` tokens.  Only the histogram of piece lengths (at most
``size`` rows) goes to the driver.  There best-fit decreasing runs over counts:
a step places many pieces of one length into many sequences of one remaining
room at once, so the plan has a few thousand segments however many pieces there
are.  Pieces then take the planned slots by their rank within their length.
Ranks come from counts of (length, bucket) and positions within a bucket, so
a length that a third of all pieces share is spread over all buckets.

Defined cases: a null or empty text is the end id alone.  Pieces are ranked by
id and piece, so repeated rows get slots of their own in any order.  Null ids
rank first.  Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, hold, trim, utf8

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: What the vocabulary's pre-tokenizer splits a lower-case word without apostrophes into.
_PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words that it may be applied to: printable letters and signs up to Latin Extended-B.
_PLAIN = regex.compile(r"[!-&(-~\u00A1-\u024F]+")

#: Signs that make up one part after a word.
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


def byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: 256 + k for k, b in enumerate(others)}


#: Text that vocabularies of other kinds split otherwise.
PROBE = "Plain Words, 2024 numbers: don't stop (ever)!  Two  spaces,\ttabs\n\nand LINES; naïve Überfälle — 東京 <|x|> a_b"


#: Words, and parts of words, that a task remembers: about 100 MB. Fewer cost time, not results.
WORDS_HELD = 400_000


class WordTokens:
    """Ids of a text, with bounded memories of words and their parts.

    The default vocabulary's pre-tokenizer never joins across ASCII white
    space, so a text's ids are those of its words one after another.  Plain
    words are cut and lower-cased here, so that ``Word`` and ``word,`` share the
    work of ``word``; the tokenizer sees all others as they are.  A vocabulary
    that gives other ids for a probe text is asked for whole texts instead.
    """

    def __init__(self, path: str, most: int = WORDS_HELD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        self.encode, self.merge, self.letters = held.encode_batch_fast, held.model.tokenize, byte_letters()
        self.by_word = True
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.most = most
        probe = PROBE.encode()
        try:
            self.by_word = next(self.many([probe])) == array("I", held.encode(PROBE, add_special_tokens=False).ids).tobytes()
        except Exception:  # the vocabulary can't be asked for parts of words
            self.by_word = False
        self.known.clear()
        self.parts.clear()

    def learn(self, words: set[bytes]) -> None:
        if self.known and len(self.known) + len(words) > self.most:
            self.known.clear()
        if len(self.parts) > self.most:
            self.parts.clear()
        cut: dict[bytes, list[str]] = {}
        other: list[str] = []
        parts, known, letters = self.parts, self.known, self.letters
        for w in words:
            if w in known:
                continue
            core = w.rstrip(_TAIL)
            if core.isalpha():  # ASCII letters, then signs if any
                low = core.lower().decode()
                cut[w] = [low] if len(core) == len(w) else [low, w[len(core) :].decode()]
                continue
            s = w.decode()
            if _PLAIN.fullmatch(s) and "<|" not in s:
                cut[w] = _PARTS.findall(s.lower())
            elif s not in parts:
                other.append(s)
                cut[w] = [s]
            else:
                cut[w] = [s]
        for i in range(0, len(other), 2_000):
            some = other[i : i + 2_000]
            for p, e in zip(some, self.encode(some, add_special_tokens=False), strict=True):
                parts[p] = array("I", e.ids).tobytes()
        for w, ps in cut.items():
            for p in ps:
                if p not in parts:  # as the vocabulary's byte-level step writes it
                    text = p if p.isascii() else p.encode().decode("latin-1").translate(letters)
                    parts[p] = array("I", [t.id for t in self.merge(text)]).tobytes()
            known[w] = parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps])

    def many(self, texts: list[bytes | None], chunk: int = 3 << 20) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit numbers; new words are learned for about ``chunk`` bytes of texts at once."""
        at = 0
        while at < len(texts) and not self.by_word:
            some, held = [], 0
            while at < len(texts) and held < chunk:
                some.append((texts[at] or b"").decode())
                held, at = held + len(some[-1]), at + 1
            for e in self.encode(some, add_special_tokens=False):
                yield array("I", e.ids).tobytes()
        while at < len(texts):
            split: list[list[bytes]] = []
            held = 0
            while at < len(texts) and held < chunk:
                text = texts[at] or b""
                split.append(text.split())
                held, at = held + len(text), at + 1
            self.learn(set().union(*split))
            known = self.known.__getitem__
            for words in split:
                yield b"".join(map(known, words))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False, words_held: int = WORDS_HELD) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): token ids of every document, cut at ``size``."""
    vocabulary = path or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(vocabulary, words_held)
        for b in batches(rows):
            out: list[tuple] = []
            for ident, ids in zip(b.column("id").to_pylist(), tokens.many(utf8(b.column("text"))), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((ident, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names[: len(cols)])
        del tokens
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


@dataclass
class Plan:
    """Segments sorted by (length, first rank): so many pieces of a length go to consecutive sequences at one offset."""

    length: list[int]
    rank: list[int]
    sequence: list[int]
    offset: list[int]
    n_sequences: int


def plan(histogram: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing over counts of lengths."""
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining room: (first sequence, how many)
    open_rooms: list[int] = []  # sorted
    segments: list[tuple[int, int, int, int]] = []
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if not rooms[room]:
                bisect.insort(open_rooms, room)
            rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(open_rooms, length)
            if k == len(open_rooms):  # a new sequence holds as many of this length as fit
                each = size // length
                whole, rest = divmod(left, each)
                for n, held in ((whole, each), (1 if rest else 0, rest)):
                    for j in range(held if n else 0):
                        segments.append((length, rank, used, j * length))
                        rank += n
                    if n:
                        put(size - held * length, used, n)
                        used += n
                left = 0
            else:
                room = open_rooms[k]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    open_rooms.pop(k)
                take = min(n, left)
                segments.append((length, rank, first, size - room))
                rank, left = rank + take, left - take
                if n > take:
                    put(room, first + take, n - take)
                put(room - length, first, take)
    segments.sort()
    cols = [list(c) for c in zip(*segments, strict=True)] or [[], [], [], []]
    return Plan(*cols, used)


def ranked(parts: DataFrame, rows_per_bucket: int = 200_000) -> DataFrame:
    """``parts`` with their rank (from 0) among the pieces of their length."""
    n = parts.count()
    buckets = max(64, -(-n // rows_per_bucket))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").count()
    before = counts.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    before = hold(before)
    own = Window.partitionBy("length", "bucket").orderBy("id", "piece")
    placed = dealt.withColumn("place", F.row_number().over(own) - 1)
    return placed.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place")).drop("bucket", "before", "place")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False, words_held: int = WORDS_HELD) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    parts = hold(pieces(docs, id_col, text_col, size, end_id, path, with_ids, words_held))
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most size rows
    planned = plan(histogram, size)
    lengths, ranks, sequences, offsets = (np.array(x, np.int64) for x in (planned.length, planned.rank, planned.sequence, planned.offset))
    width = max([*histogram.values(), 1])
    keys = lengths * (width + 1) + ranks
    names = [*parts.columns]

    def seat(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * (width + 1) + rank, side="right") - 1
            sequence = sequences[at] + rank - ranks[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"])

    schema = PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked(parts).select(*names, "rank").mapInArrow(seat, schema).withColumnRenamed("id", id_col)
