"""URL filter: location rules first, then naive Bayes over segmented names.

Host and path are split into runs of letters and of digits; any run of digits
is one token, ``#``.  A part of letters that joins words is segmented by a
unigram Viterbi search, so ``cheappills`` reads as ``cheap pills``.

- A word's weight is the number of hosts that use it, plus ``PRIOR`` for the
  seed terms and their usual companions.  Words have 3 to ``MAX_WORD`` letters
  and are on ``min_hosts`` hosts or more.
- A part is split only if all pieces are words, so ``adulthood`` and
  ``alphabets`` stay whole where ``hood`` and ``alpha`` are none.
- A part that is a word itself is split only if each piece is on at least
  ``compound`` times as many hosts: then it is a compound, not a word.
- Parts of any length are split: a long one is looked up in overlapping slices,
  and the search looks back ``MAX_WORD`` letters at most.

A URL trains the block class if one of its tokens is a seed term, the allow
class otherwise, so tokens that keep company with seed terms are learned too.
Counts are multinomial, of a token that stands f times in a URL log2(1 + f), in
training and in scores alike: repeats add up, but one URL that repeats a word
ten thousand times doesn't make up a class.
The dictionary, counts and weights are of all URLs.  They stay tables: parts
meet the words that they contain in a join, tokens their weights in another.
Nothing that grows with the input is sent to the driver or to all tasks.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
which no rule fits and the method allows.  Rows are judged one by one, so
repeated rows and ties get equal verdicts; of rules of equal length on one host
and path only one can fit.  Only the id and the URL are read, so other columns
can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, batches, materialise

#: Terms that mark a host or path as unwanted, to train from.
SEED_TERMS = ("spam", "casino", "adult", "porn", "xxx", "bets", "betting", "pills", "viagra", "ads", "adserver", "escort", "warez", "phish", "malware", "gambling", "loan", "loans")

#: Words that names often join with those terms.
COMPANIONS = ("cheap", "free", "best", "buy", "online", "win", "live", "hot", "play", "top", "real", "fast", "easy", "farm", "track", "server", "club", "shop", "store", "deal", "deals", "bonus", "poker", "slots", "payday", "date", "dating")
#: Hosts that a seed term or companion counts for beyond those of the table.
PRIOR = 100
#: Letters of a word, and of a slice of a part that is looked up at once.
MIN_WORD, MAX_WORD, SLICE = 3, 20, 256

#: Log ratios and counts are summed as whole multiples of these, so that their order doesn't matter.
_UNIT, _COUNT = 10**9, 10**6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule ``host/path`` that fits, and its verdict; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # later ones are longer and win
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(rules[rule])).otherwise(verdict)
    return text, verdict


def parts(host: Column, path: Column) -> Column:
    """Lower-case runs of letters, and of digits, of host and path."""
    return F.regexp_extract_all(F.lower(F.concat_ws("/", host, path)), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))


def tokens_of(column: Column) -> Column:
    """The parts with runs of digits as ``#``."""
    return F.transform(column, lambda p: F.when(p.rlike(r"^\p{N}+$"), "#").otherwise(p))


def best_split(text: str, own: int, words: dict[str, int], compound: int) -> list[str] | None:
    """Viterbi over known words: the likeliest split into two or more, if there is one; ``own`` is the weight of the whole."""
    total = math.log(sum(words.values()) + 1)
    best: list[float] = [0.0] + [-math.inf] * len(text)
    back = [0] * (len(text) + 1)
    for end in range(MIN_WORD, len(text) + 1):
        for start in range(max(0, end - MAX_WORD), end - MIN_WORD + 1):
            weight = words.get(text[start:end], 0) if end - start < len(text) else 0
            if weight >= max(1, compound * own) and best[start] + math.log(weight) - total > best[end]:
                best[end], back[end] = best[start] + math.log(weight) - total, start
    if best[-1] == -math.inf:
        return None
    out, end = [], len(text)
    while end:
        out.append(text[back[end] : end])
        end = back[end]
    return out[::-1]


def split_parts(used: DataFrame, seeds: tuple[str, ...], min_hosts: int, compound: int) -> DataFrame:
    """(part, tokens) of the parts that are split; ``used`` has (part, hosts)."""
    spark = used.sparkSession
    prior = spark.createDataFrame([(w, PRIOR) for w in {*seeds, *COMPANIONS}], "part string, hosts long")
    size = F.length("part")
    named = used.where(F.col("part").rlike(r"^\p{L}+$"))
    known = named.where(size.between(MIN_WORD, MAX_WORD) & (F.col("hosts") >= min_hosts)).unionByName(prior)
    known = materialise(known.groupBy(F.col("part").alias("piece")).agg(F.sum("hosts").alias("weight")), "words", few_files=True)
    whole = named.where(size >= 2 * MIN_WORD).select(F.unhex(F.md5("part")).alias("key"), "part")
    # each slice with the letters that a word which begins in it may need beyond it
    slices = F.transform(F.sequence(F.lit(1), size, F.lit(SLICE)), lambda i: F.substring(F.col("part"), i, F.lit(SLICE + MAX_WORD - 1)))
    cut = whole.select("key", F.explode(slices).alias("slice")).where(F.length("slice") >= MIN_WORD)
    long = F.length("slice")
    starts = F.sequence(F.lit(1), F.least(F.lit(SLICE), long - MIN_WORD + 1))
    ends = lambda i: F.sequence(F.lit(MIN_WORD), F.least(F.lit(MAX_WORD), long - i + 1))
    pieces = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.when(long - i + 1 >= MIN_WORD, ends(i)).otherwise(F.array().cast("array<int>")), lambda k: F.substring(F.col("slice"), i, k)))))
    held = cut.select("key", F.explode(pieces).alias("piece")).join(known, "piece").select("key", "piece", "weight").distinct()
    by_key = held.groupBy("key").agg(F.collect_list("piece").alias("pieces"), F.collect_list("weight").alias("weights"))  # one part's known words
    by_part = by_key.join(whole, "key").select("part", "pieces", "weights")

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            out = []
            for part, pieces, weights in zip(*(b.column(c).to_pylist() for c in ("part", "pieces", "weights")), strict=True):
                words = dict(zip(pieces, weights, strict=True))
                if tokens := best_split(part, words.get(part, 0), words, compound):
                    out.append((part, tokens))
            cols = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.list_(pa.string())), strict=True)], names=["part", "tokens"])

    return by_part.mapInArrow(split, "part string, tokens array<string>")


def filter_urls(
    urls: DataFrame,
    rules: dict[str, str],
    id_col: str = "page_id",
    url_col: str = "url",
    seeds: tuple[str, ...] = SEED_TERMS,
    min_hosts: int = 2,
    compound: int = 4,
    smoothing: float = 0.5,
    block_over: float = 0.9,
) -> DataFrame:
    """Per row: id, host, path, rule, verdict, and tokens and block_probability of the method."""
    read = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    split = read.select("id", host.alias("host"), path.alias("path"))
    named = tokens_of(parts(F.col("host"), F.col("path")))
    line = F.concat_ws(" ", named)  # parts hold no blank
    split = split.withColumns({"line": line, "key": F.unhex(F.md5(line))})
    lists = materialise(split.groupBy("key", "line").agg(F.count("*").alias("n")), "lists", few_files=True)
    used = split.select("host", F.explode(named).alias("part")).distinct().groupBy("part").agg(F.count("*").alias("hosts"))
    cut = materialise(split_parts(used, seeds, min_hosts, compound), "splits", few_files=True)

    exploded = lists.where("line <> ''").select("key", "n", F.posexplode(F.split("line", " ")).alias("at", "part"))
    found = exploded.join(cut, "part", "left").select("key", "n", "at", F.coalesce("tokens", F.array("part")).alias("own"))
    ordered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "own"))), lambda p: p["own"]))
    marked = found.groupBy("key").agg(F.first("n").alias("n"), ordered.alias("tokens")).withColumn("bad", F.arrays_overlap("tokens", F.array(*map(F.lit, seeds))))
    marked = materialise(marked, "marked", few_files=True)

    seen = F.round(F.log2(F.count("*") + 1) * _COUNT).cast("long")
    terms = marked.select("key", "n", "bad", F.explode("tokens").alias("t")).groupBy("key", "n", "bad", "t").agg(seen.alias("seen"))
    terms = materialise(terms, "terms", few_files=True)
    count = lambda of: F.coalesce(F.sum(F.when(of, F.col("n") * F.col("seen"))), F.lit(0)) / _COUNT
    by_token = materialise(terms.groupBy("t").agg(count(F.col("bad")).alias("bad"), count(~F.col("bad")).alias("good")), "tokens", few_files=True)
    total = by_token.agg(F.sum(F.round(F.col("bad") * _COUNT).cast("long")).alias("bad"), F.sum(F.round(F.col("good") * _COUNT).cast("long")).alias("good"), F.count("*").alias("n")).first()
    n_rows, n_bad = lists.agg(F.sum("n")).first()[0] or 0, marked.where("bad").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    prior = math.log((n_bad + 1) / (n_rows - n_bad + 1))
    bad, good = (F.log((F.col(k) + smoothing) / F.lit((total[k] or 0) / _COUNT + smoothing * max(total["n"], 1))) for k in ("bad", "good"))
    ratio = by_token.select("t", (bad - good).alias("ratio"))
    part = F.round(F.col("ratio") * F.col("seen") / _COUNT * _UNIT).cast("long")
    sums = terms.join(ratio, "t").groupBy("key").agg(F.sum(part).alias("ratios"))
    odds = F.lit(prior) + F.coalesce("ratios", F.lit(0)) / F.lit(_UNIT)
    odds = F.least(F.lit(500.0), F.greatest(F.lit(-500.0), odds))
    scored = split.drop("line").join(marked.select("key", "tokens").join(sums, "key"), "key", "left").withColumn("block_probability", 1 / (1 + F.exp(-odds)))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    own = F.when((F.col("block_probability") > block_over) & (F.size(tokens) > 0), "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), tokens.alias("tokens"), "block_probability")
