"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import sys

import pytest

from chronopanel.llm import chat_format, decontaminate, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, substring_dedup, url_filter, warc

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
LINE = "a shared line of more than twenty letters"
TEXTS = [None, "", "   \n\t ", "one", LONG, f"{LINE}\nfirst", f"{LINE}\nsecond", f"{LINE}\nthird", "same words here again", "same words here again", " ".join(f"p{i}" for i in range(40))]
#: Names that the operators use themselves.
CLASH = "h1 long, id long, n long, d double, key string, n_lines string, n_words string, score string, rank string, start long, length long, component_id string, placed int, hit boolean, items string, kept string"


def documents(spark, texts=TEXTS, with_ids=True):
    rows = [(i if with_ids or i else None, t, ("en", None)[i % 2], "s", len(t or "")) + (None,) * len(CLASH.split(",")) for i, t in enumerate(texts)]
    rows = [*rows, rows[-1], (None, "no id", "en", "s", 5) + rows[0][5:]] if rows else rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, None)], "doc_id long, quality int")


def items(spark):
    return spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(5, 20))), (2, "One"), (3, ""), (4, None), (None, "same words here")], "item_id long, text string")


OPERATORS = {
    "quality": lambda s, d: quality_classifier.classify(d, labels(s), sample=20),
    "jaccard": lambda s, d: jaccard_join.link(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "substrings": lambda s, d: substring_dedup.dedup_substrings(d),
    "packing": lambda s, d: packing.pack(d, size=64),
    "decontaminate": lambda s, d: decontaminate.find(d, items(s)),
    "rules": lambda s, d: quality_rules.judge(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = documents(spark).repartition(3)
    got = OPERATORS[name](spark, docs).collect()
    ids = {r["doc_id"] for r in got}
    assert ids == {None, *range(len(TEXTS))}
    if name in ("quality", "jaccard", "lines", "substrings", "rules"):
        assert len(got) == len(TEXTS) + 2


def test_line_dedup_values(spark):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark)).collect()}
    assert [got[i]["n_dropped"] for i in range(len(TEXTS))] == [0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert got[5]["text"] == "first" and got[0]["text"] == "" and got[0]["n_lines"] == 1 and got[7]["text"].startswith(LINE)


def test_substring_values(spark):
    text = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(2, f"x {text} y"), (1, text), (3, " ".join(["again"] * 25)), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["text"], got[3]["n_removed"], got[4]["n_words"]) == (0, 30, "x y", 24, 0)
    assert [(s["start"], s["end"]) for s in got[2]["repeats"]] == [(1, 31)]


def test_jaccard_values(spark):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.link(documents(spark)).collect()}
    assert got[8, 1] == got[9, 1] == 8 and got[0, 0] == 0 and got[1, 0] == 1 and got[2, 0] == 2 and got[None, 1] is None


def test_decontaminate_values(spark):
    got = {r["doc_id"]: r for r in decontaminate.find(documents(spark), items(spark)).collect()}
    assert (got[10]["n_hit"], got[10]["items"]) == (15, ["1"])
    assert (got[3]["n_hit"], got[3]["items"], got[3]["contaminated"]) == (1, ["2"], True)
    assert (got[8]["n_hit"], got[8]["n_items"]) == (3, 0) and got[0]["n_words"] == 0 and not got[4]["contaminated"]
    none = decontaminate.find(documents(spark), items(spark).where("false")).where("contaminated").count()
    assert none == 0


def test_packing_keeps_all_tokens(spark):
    got = packing.pack(documents(spark), size=64, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] <= 64 for r in got)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_rules_lengths(spark):
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(spark)).collect()}
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and got[4]["n_words"] == 30_000


def test_urls(spark):
    urls = [None, "", "no scheme/x", "HTTP://A.Net/x?y", "http://a.example.net/en/x#z", "https://cheappills.example.org/", "x://://y/", "http://net", "http://net/", "http://b.org/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(9, urls[9])], "page_id long, url string").selectExpr("*", "1 as host", "'x' as tokens")
    rules = {"net/": "block", "example.net/en/": "allow", "org/fr/": "allow"}
    rows = url_filter.filter_urls(df, rules, min_hosts=1).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == 11
    assert [got[i]["host"] for i in (0, 1, 2, 3, 6)] == ["", "", "", "a.net", "://y"[:1]] or got[6]["host"] == ":"
    assert [got[i]["rule"] for i in range(10)] == [None, None, None, "net/", "example.net/en/", None, None, None, "net/", "org/fr/"]
    assert "pills" in got[5]["tokens"] and got[5]["block_probability"] > 0.5 and got[0]["verdict"] == "allow"
    assert url_filter.filter_urls(df.where("false"), rules).collect() == []


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ü x'\r\n", "<p>ü\r\n\r\nWARC/1.1</p>"), (2, None, None), (3, "http://b/", ""), (4, "http://c/%20?q=1", "<p>ü\r\n\r\nWARC/1.1</p>"), (None, "http://d/", "own"), (5, "http://e/", "x" * 3_000_000), (5, "http://e/", "x" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as sha", "3 as refers_to").repartition(3)
    index = warc.write_archives(df)
    got = warc.read_records(index, region=1 << 10).collect()
    assert sorted((str(r["id"]), str(r["url"])) for r in got) == sorted((str(p[0]), str(p[1])) for p in pages)
    by = {r["id"]: r for r in got}
    assert (by[1]["record_type"], by[1]["refers_to"], by[4]["record_type"]) == ("revisit", 4, "response")
    assert (by[2]["refers_to"], by[3]["record_type"], by[3]["payload_bytes"]) == (3, "response", 0)
    assert bytes(by[4]["payload"]).decode() == pages[3][2] and by[1]["payload_bytes"] == len(pages[0][2].encode())
    some = warc.read_records(index.where("id in (3, 4)")).collect()
    assert {r["id"] for r in some} == {3, 4}
    assert warc.read_records(warc.write_archives(df.where("false"))).collect() == []


def test_ranges_coalesce():
    got = list(warc.ranges([0, 10, 100, 5000], [10, 20, 5, 7], gap=70, most=200))
    assert [(a, b, len(m)) for a, b, m in got] == [(0, 105, 3), (5000, 5007, 1)]


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (5, 0, "", ""), (None, 0, "user", "z"), (6, 0, "user", "a"), (6, 1, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as i", "2 as n", "3 as conv")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat_format.format_chats(df).collect()}
    assert got == {1: (2, 2), 4: (1, 1), 5: (1, 1), 6: (2, 1), None: (1, 1)}
    assert chat_format.format_chats(df.where("false")).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.where("false"), sf).collect() == []
        out.collect()


def test_pipeline_keeps_and_removes(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in stages["near_duplicates"](spark, docs, sf).collect()}
    sets = {}
    for r in docs.collect():
        words = r["text"].translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).split()
        sets[r["doc_id"]] = frozenset(hashlib.md5(" ".join(words[i : i + 5]).encode()).digest() for i in range(max(1, len(words) - 4))) if words else frozenset()
    first: dict = {}
    for k in sorted(sets):
        if sets[k]:
            first.setdefault(sets[k], k)
    copies = {k for k, s in sets.items() if s and first[s] != k}
    assert not kept & copies and all(any(10 * len(sets[k] & sets[o]) >= 8 * len(sets[k] | sets[o]) for o in sets if o != k) for k in set(sets) - kept)
    leaks = {r["doc_id"] for r in decontaminate.find(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    left = {r["doc_id"] for r in stages["benchmark"](spark, docs, sf).collect()}
    assert left == set(sets) - leaks
