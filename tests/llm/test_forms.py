"""Fill-in-middle, byte-level BPE and resampling against plain Python, on whole tables and odd rows."""

import hashlib
import math
import random
import re
import zlib
from array import array

import pytest

from chronopanel.llm import byte_bpe, fill_middle, queries, resample

SF = "/root/testdata/sf0.001"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "\n\t ", "one", " one", "one ", "ü  東京\n x y ", "a<P>b c", "<S", "P> <", "é" * 40, "same words", "same words", "x " * 700_000 + "end", "\r\n".join(["line of words"] * 50)]
CLASH = "n long, form string, output string, restored string, ids binary, weight long, score long, rank long, id long, _at long"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def documents(spark, texts=ODD):
    rows = [(i, t) + (None,) * len(CLASH.split(",")) for i, t in enumerate(texts)]
    rows = [*rows, rows[-1], (None, "no id at all") + rows[0][2:]] if rows else rows
    return spark.createDataFrame(rows, "doc_id long, text string, " + CLASH).repartition(3)


def filled(ident, text):
    text, units = text or "", UNITS.findall(text or "")
    digest = sha(f"42:{'' if ident is None else ident}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_fill_middle(spark, size):
    texts = ODD + [f"{t or ''} {k}" for k in range(20) for t in ODD[:14]]
    docs = documents(spark, texts)

    def run(rows):
        fill_middle.SLICE = size  # in the worker
        yield from rows

    got = fill_middle.restore(fill_middle.transform(docs.mapInArrow(run, docs.schema)))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got.collect())
    want = sorted((r["doc_id"] is None, r["doc_id"], *filled(r["doc_id"], r["text"]), r["text"] or "") for r in docs.select("doc_id", "text").collect())
    assert got == want and {r[3] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.where("false")).collect() == []


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_rotations(monkeypatch, size):
    monkeypatch.setattr(fill_middle, "SLICE", size)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("ab <>PSMé\n", k=rng.randint(1, 40))).encode()
        if any(m in text for m in (b"<P>", b"<S>", b"<M>")):
            continue
        a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
        for form, want in (("psm", b"<P>" + text[:a] + b"<S>" + text[b:] + b"<M>" + text[a:b]), ("spm", b"<S>" + text[b:] + b"<P>" + text[:a] + b"<M>" + text[a:b])):
            made = fill_middle.arrange(text, a, b, form == "spm")
            assert made == want and fill_middle.rearrange(bytes(made), form) == text


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.vocabulary_pattern(), mergeable_ranks=byte_bpe.load_ranks(byte_bpe.vocabulary_path()), special_tokens={})


def test_op12(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_byte_bpe(spark, SF).collect()}
    ids = {k: library.encode_ordinary(t) for k, t in texts.items()}
    assert got == {k: (len(ids[k]), sha(array("I", ids[k]).tobytes()), sha(t)) for k, t in texts.items()}


def test_bpe_odd_rows(spark, library):
    docs = documents(spark)
    lists = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, packed=False).collect()}
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    texts = dict(enumerate(ODD)) | {None: "no id at all"}
    assert len(got) == len(ODD) + 2
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert lists[r["doc_id"]] == list(array("I", bytes(r["ids"]))) == ids and bytes(r["decoded"]).decode() == text and r["n_tokens"] == len(ids)
    assert byte_bpe.encode(docs.where("false")).collect() == []


def test_bpe_against_the_library(library):
    """Random texts of awkward parts and of any code points, in chunks that cut texts, and very long pre-tokens."""
    rng = random.Random(5)
    parts = ["a", "b", "ab", " ", "  ", "\n", "\t", "1", "23", "'", "'s", "don't", "é", "ü", "東", "՘", "\U00012479", "!", "..", "-----", "=" * 40, "\x1c", " ", " ", "the", "ing", "tion", "THE", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)]
    spans = [lambda: rng.randrange(0x80), lambda: rng.randrange(0x800), lambda: rng.randrange(0xD800), lambda: rng.randrange(0xE000, 0x110000)]
    texts += ["".join(chr(rng.choice(spans)()) for _ in range(30)) for _ in range(3000)]
    texts += ["a" * 50_000, "".join(rng.choices("abcdefgh", k=50_000)), "=-" * 20_000, "word " * 20_000, "՘x " * 3000]
    encoder = byte_bpe.Encoder(byte_bpe.vocabulary_path(), byte_bpe.vocabulary_pattern(), memory=100_000)
    for text, ids in zip(texts, encoder.many(texts, chunk=3000), strict=True):
        assert library.encode_ordinary(text) == list(array("I", ids))


def test_rank_queue():
    rng, queue, held = random.Random(1), byte_bpe.RankQueue(50_255), {}
    for _ in range(3000):
        rank = rng.choice([rng.randrange(50_256), rng.randrange(70)])
        if rank not in held:
            queue.put(rank, [rank])
            held[rank] = [rank]
        if rng.random() < 0.6:
            least = queue.least()
            assert least == min(held) and queue.take(least) == held.pop(least)
    assert bool(queue.top) == bool(held)


def drawn(docs, target, percent=25, least=20, buckets=10_000):
    def features(text):
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    source, goal = [0] * buckets, [0] * buckets
    seen = [(i, *features(t)) for i, t in docs]
    for counts, fs in [(source, f) for *_, f in seen] + [(goal, features(t)[1]) for t in target]:
        for f in fs:
            counts[f] += 1
    s_all, t_all = sum(source), sum(goal)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source, goal)]
    rows = []
    for i, n, fs in seen:
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    places = [(*r, k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < least]
    return sorted(((r[0], *r[2:]) for r in places), key=str)


def test_op13(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op13_resample(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == drawn(docs, target)


def test_resample_odd_rows(spark):
    docs, target = documents(spark), spark.createDataFrame([("same words",), (None,), ("x x x",)], "text string")
    got = resample.resample(docs, target, percent=70, least_words=2, block_rows=3)
    want = drawn([tuple(r) for r in docs.select("doc_id", "text").collect()], ["same words", None, "x x x"], 70, 2)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert resample.resample(docs.where("false"), target).collect() == []
    assert [r["rank"] for r in resample.resample(docs, target, least_words=10**9).collect()] == [None] * (len(ODD) + 2)


def test_features_of_slices(monkeypatch):
    rng = random.Random(2)
    for longest in (1, 2, 3):
        for _ in range(100):
            text = "".join(rng.choices("aB é.\n1", k=rng.randint(0, 60)))
            words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            want = sorted(zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
            monkeypatch.setattr(resample, "SLICE", rng.choice([1, 2, 5, 1000]))
            parts = list(resample.feature_hashes(text.encode(), longest))
            assert sorted(int(h) for p, _ in parts for h in p) == want and sum(n for _, n in parts) == len(words)


@pytest.mark.parametrize("block_rows,most_bits", [(7, 3), (100, 5), (1 << 18, 12)])
def test_radix_rank(spark, block_rows, most_bits):
    """Ties, negative keys, a digit that most rows share, and a key of one value."""
    rng = random.Random(8)
    rows = [(rng.choice([-5, 0, 0, 0, 10**6]), i * 3 - 500, 4) for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    got = {r["rank"]: (r["a"], r["c"], r["b"]) for r in resample.radix_rank(df, ["a", "c", "b"], block_rows=block_rows, most_bits=most_bits).collect()}
    assert [got[k + 1] for k in range(len(rows))] == sorted((a, c, b) for a, b, c in rows)
