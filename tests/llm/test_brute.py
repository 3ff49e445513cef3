"""Registered queries against plain Python on whole tables."""

import base64
import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from chronopanel.llm import packing, queries

SF = "/root/testdata/sf0.001"
WS = r"[^\x20\x09-\x0D]+"


def rows(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def result(spark, name, key):
    return {r[key]: r.asDict() for r in queries.QUERIES[name](spark, SF).collect()}


def plain_urls(urls):
    """Tokens and log odds of each (host, path), by plain Python: dictionary, splits, multinomial counts."""
    from chronopanel.llm.url_filter import COMPANIONS, SEED_TERMS

    cut = lambda h, p: [x if x[0].isalpha() else "#" for x in regex.findall(r"\p{L}+|\p{N}+", f"{h}/{p}".lower())]
    hosts: dict = {}
    for h, p in urls:
        for x in cut(h, p):
            hosts.setdefault(x, set()).add(h)
    words = Counter({w: len(s) for w, s in hosts.items() if w != "#" and 3 <= len(w) <= 20 and len(s) >= 2})
    words.update({w: 100 for w in {*SEED_TERMS, *COMPANIONS}})

    @functools.cache
    def split(part):
        own = words.get(part, 0)
        inside = {part[i:k]: words[part[i:k]] for i in range(len(part)) for k in range(i + 3, min(len(part), i + 20) + 1) if part[i:k] in words}
        total = math.log(sum(inside.values()) + 1)
        best = {0: (0.0, ())}
        for end in range(3, len(part) + 1):
            found = [(best[i][0] + math.log(inside[part[i:end]]) - total, best[i][1] + (part[i:end],)) for i in range(max(0, end - 20), end - 2) if i in best and part[i:end] in inside and part[i:end] != part and inside[part[i:end]] >= 4 * own]
            if found:
                best[end] = max(found, key=lambda f: f[0])
        return best[len(part)][1] if len(part) in best and len(part) >= 6 else (part,)

    tokens = [[t for x in cut(h, p) for t in (split(x) if x != "#" else (x,))] for h, p in urls]
    bad = [not set(t).isdisjoint(SEED_TERMS) for t in tokens]
    counts: dict = {True: Counter(), False: Counter()}
    for ts, b in zip(tokens, bad):
        for t, f in Counter(ts).items():
            counts[b][t] += math.log2(1 + f)
    size = len(counts[True].keys() | counts[False].keys())
    total = {side: sum(c.values()) + 0.5 * size for side, c in counts.items()}
    start = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    weigh = lambda t: math.log((counts[True][t] + 0.5) / total[True]) - math.log((counts[False][t] + 0.5) / total[False])
    return [(ts, start + sum(math.log2(1 + f) * weigh(t) for t, f in Counter(ts).items())) for ts in tokens]


def test_op1(spark):
    rules = queries.URL_RULES
    got = result(spark, "op1_url_filter", "page_id")
    pages = rows(spark, "pages")
    places = []
    for p in pages:
        _, mark, rest = p["url"].partition("://")
        host = re.match(r"[^/?#]*", rest)[0].lower() if mark else ""
        places.append((host, re.match(r"[^?#]*", rest[len(host) :])[0] if mark else ""))
    for p, (host, path), (tokens, odds) in zip(pages, places, plain_urls(places), strict=True):
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        g = got[p["page_id"]]
        chance = 1 / (1 + math.exp(-max(-500, min(500, odds))))
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule)
        assert g["block_probability"] == pytest.approx(chance, rel=1e-5, abs=1e-9)
        assert g["verdict"] == (rules[rule] if rule else "block" if chance > 0.9 and tokens else "allow")


def test_op1_long_parts(spark):
    """Names of any length are split, also across the slices that they are looked up in."""
    from chronopanel.llm import url_filter

    urls = [f"http://a.example/{'cheappills' * n}" for n in (1, 25, 26, 60, 3000)] + [f"http://b.example/{'x' * k}{'cheappills' * 40}" for k in (0, 255, 256, 257)]
    urls += [f"http://news{i % 9}.example.com/{w}/x{chr(97 + i % 26)}" for i in range(90) for w in ("sport", "world", "local")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, {}).collect()}
    for k, n in enumerate((1, 25, 26, 60, 3000)):
        assert got[k]["verdict"] == "block" and got[k]["tokens"][2:].count("pills") == n
    assert got[5]["verdict"] == "block" and got[5]["tokens"].count("cheap") == 40


def test_op2(spark):
    labels = {r["doc_id"]: r["quality"] for r in rows(spark, "labels")}
    got = result(spark, "op2_quality_classifier", "doc_id")
    assert len(got) == len(rows(spark, "documents"))
    for k, g in got.items():
        assert g["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert g["predicted"] == int(g["score"] >= 0.3) and 0 <= g["score"] <= 1
    held = [(got[k]["predicted"], y) for k, y in labels.items() if got[k]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.8


def test_op3(spark):
    pages = rows(spark, "pages")
    largest: dict = {}
    for p in pages:
        largest[p["html"]] = max(largest.get(p["html"], -1), p["page_id"])
    got = result(spark, "op3_warc", "page_id")
    assert len(got) == len(pages)
    for p in pages:
        body, to = p["html"].encode(), largest[p["html"]]
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to == p["page_id"] else "revisit", None if to == p["page_id"] else to)
        g = got[p["page_id"]]
        assert (g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) == want


def test_op7(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for d in rows(spark, "documents"):
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[d["doc_id"], k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = queries.op7_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(v[1] for v in want.values())
    assert len(bins) <= -(-total // 2048) + 2


@pytest.mark.parametrize("sizes", [{2048: 5, 7: 3}, {1: 10_000}, {1500: 10, 548: 3, 300: 40, 2: 9}, {}])
def test_plan_uses_every_rank_once(sizes):
    p = packing.plan(sizes, 2048)
    ends = {}
    for k in range(len(p.length)):
        last = k + 1 == len(p.length) or p.length[k + 1] != p.length[k]
        if p.rank[k] == 0:
            ends[p.length[k]] = 0
        assert p.rank[k] == ends[p.length[k]]
        ends[p.length[k]] = sizes[p.length[k]] if last else p.rank[k + 1]
    assert ends == sizes


def test_op9(spark):
    got = result(spark, "op9_quality_rules", "doc_id")
    for d in rows(spark, "documents"):
        text = d["text"]
        words = re.findall(WS, text)
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        seen, dups = set(), 0
        for line in text.split("\n"):
            if re.search(WS, line):
                dups += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit))
        g = got[d["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (g["base_failed"] and g["kept"])


def shingles(text, width):
    words = re.findall(WS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def linked_components(sets, num, den):
    """Smallest id reachable by links, by comparing all pairs that share a shingle."""
    root = {k: k for k in sets}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    holders: dict = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    pairs = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :]}
    for a, b in pairs:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {k: top(k) for k in sets}


@pytest.mark.parametrize("width,num,den,cell", [(3, 90, 100, 1024), (5, 8, 10, 3), (2, 1, 2, 5)])
def test_op4(spark, width, num, den, cell):
    from chronopanel.llm import jaccard_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"], width) for r in docs.collect()}
    want = linked_components(sets, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs, width=width, num=num, den=den, cell=cell).collect()}
    assert got == {k: (len(s), want[k]) for k, s in sets.items()}
