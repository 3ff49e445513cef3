"""Exact Jaccard join of word-shingle sets in metric space.

Jaccard distance d is a metric, and linked sets lie within the radius
r = 1 - num / den of each other.  Documents are pivots.

1. Equal sets collapse to one, so exact copies cost one row.
2. Most texts lie at distance 1, or close to it, from all others, where no
   pivot can tell them apart.  A set whose shingles are too often its own lies
   beyond r of every other one and needs no region.  That is first decided on
   a part of the shingles that is chosen alike in all sets (the least hashes),
   then on all shingles of the sets that are left.
3. The rest keep their rarest shingles, as many as linked sets must share one
   of.  Of the sets that share such a shingle the most central one is a pivot.
   Each set is measured exactly against every pivot that it shares a rare
   shingle with, which gives the Voronoi regions, boundary sets replicated:
   linked sets share a rare shingle and meet in its pivot's region.  What lies
   within r of the pivot is joined through it, without any pair of members.
4. Only regions that still hold several components go on.  One of over ``cell``
   shingles is cut again: new pivots from outside its largest component, all
   members measured against them, each member to its nearest pivot's region
   and, by the triangle inequality, into those no further than 2 r beyond.
   Regions that the windows don't shrink are compared in blocks of ``cell``
   shingles, blocks of the largest component not among themselves.
5. A block counts all intersections of its sets exactly, by postings.  It
   returns links that join components, at most one a set.

Components come from label propagation with pointer jumping.  All steps are
DataFrame joins on keys; large keys are only aggregated, joined (which Spark
can split), dealt over salts or cut into blocks.  Shingles are compared by
64-bit hashes, sets by 128 bits.

Defined cases: a null or empty text, or one without words, has the empty set
and is linked with nothing.  With fewer words than a shingle, all words make
one.  Rows that share an id share a component, whatever their texts.  A null id
gets a null component unless it copies or links with a row with an id.  Repeated
rows get equal results.  Only the id and the text are read, so other columns
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, batches, materialise, utf8

_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Keys that a task looks at together for repeats among its own rows.
CHUNK = 1 << 18
#: Members of a region that are measured by one task against its pivot.
SALT = 4096
#: New pivots of a region that is cut again.
PIVOTS = 8
#: Bytes of a row of a few hashes and numbers.
ROW = 64


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = h[:n].copy()
    for k in range(1, min(width, len(h))):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + n]
    return np.unique(out ^ (out >> np.uint64(32)))


def set_id(own: np.ndarray, ident: int | None) -> bytes:
    """128-bit hash of a set; an empty one is told apart by its row's id."""
    return xxhash.xxh3_128_digest(own.tobytes() if len(own) else f"empty {ident}".encode())


def number(h: bytes) -> int:
    """Half of a set's hash, which names it while shingles are counted."""
    return int.from_bytes(h[:8], "little", signed=True)


def least_hashes(own: np.ndarray, num: int, den: int, part: int) -> np.ndarray:
    """The keys of a set that decide first: as many as it may have alone, and 1 / part of its size more.

    Linked sets of n and m shingles have at most floor((1 - num / den) * n) that
    the other lacks, so they share at least ``least_shared`` of these keys.
    """
    n = len(own)
    k = min(n, n - -(-num * n // den) - (-n // part))
    mixed = (own ^ (own >> np.uint64(33))) * _MIX2
    mixed ^= mixed >> np.uint64(32)
    return (np.partition(mixed, k - 1)[:k] if k < n else mixed).view(np.int64)


def least_shared(n: Column, num: int, den: int, part: int) -> Column:
    return F.ceil(n * num / (den * part) - 1e-9)


def _sets(width: int):
    def sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            out = []
            for ident, text in zip(b.column("id").to_pylist(), utf8(b.column("text")), strict=True):
                own = shingle_set(text, width)
                h = set_id(own, ident)
                out.append((ident, len(own), h, number(h)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, b.column("content")], names=["id", "n", "h", "v", "content"])

    return sets


def _keys(width: int, num: int, den: int, part: int):
    """Rows (key, v, task, shared): v is a set's number.

    A key that several sets of a chunk hold is certain to be shared: it leaves
    once, with v null, and is counted for its sets in a row of their own.  So no
    key has more rows than there are chunks.
    """

    def flush(keys: list[np.ndarray], owners: list[int], task: int) -> pa.RecordBatch:
        v = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        values, at, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        alone = counts[at] == 1
        repeated = values[counts > 1]
        known, shared = np.unique(v[~alone], return_counts=True)
        key = np.concatenate([values[at[alone]], repeated, known])
        owner = np.concatenate([v[alone], np.zeros(len(repeated), np.int64), known])
        no_owner = np.zeros(len(key), bool)
        no_owner[alone.sum() : alone.sum() + len(repeated)] = True
        count = np.concatenate([np.zeros(len(key) - len(known), np.int32), shared.astype(np.int32)])
        cols = [pa.array(key), pa.array(owner, mask=no_owner), pa.array(np.full(len(key), task, np.int32)), pa.array(count, mask=count == 0)]
        return pa.RecordBatch.from_arrays(cols, names=["key", "v", "task", "shared"])

    def keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), set()
        found: list[np.ndarray] = []
        owners: list[int] = []
        held = 0
        for b in batches(rows):
            for text in utf8(b.column("text")):
                own = shingle_set(text, width)
                if not len(own):
                    continue
                v = number(set_id(own, None))
                if v in seen:
                    continue
                seen.add(v)
                found.append(least_hashes(own, num, den, part))
                owners.append(v)
                held += len(found[-1])
                if held >= CHUNK:
                    yield flush(found, owners, task)
                    found, owners, held = [], [], 0
        if held:
            yield flush(found, owners, task)

    return keys


def _full(width: int):
    def full(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            own = [np.sort(shingle_set(t, width).view(np.int64)) for t in utf8(b.column("text"))]
            ends = np.cumsum([0, *map(len, own)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("n"), pa.LargeListArray.from_arrays(ends, np.concatenate(own)).cast(pa.list_(pa.int64()))], names=["h", "n", "own"])

    return full


def close_sets(texts: DataFrame, owners: DataFrame, width: int, num: int, den: int, part: int, size: int) -> DataFrame:
    """(h, n, own) of the sets that may have a partner: those with enough shared ones among their least hashes."""
    keys = texts.select("text").mapInArrow(_keys(width, num, den, part), "key long, v long, task int, shared int")
    one = Window.partitionBy("key")  # has at most one row for each chunk
    # a set in several tasks sends its keys from each; other sets show by their numbers
    common = (F.min("v").over(one) < F.max("v").over(one)) | (F.count("v").over(one) < F.count("*").over(one))
    keys = keys.select("v", "task", "shared", common.cast("int").alias("common")).where("v is not null")
    counted = keys.where("common > 0 or shared > 0").groupBy("v", "task").agg(F.sum(F.coalesce("shared", "common")).alias("c"))
    near = materialise(counted.groupBy("v").agg(F.min("c").alias("c")), "near", size=size)
    chosen = owners.join(near, "v").where(F.col("c") >= least_shared(F.col("n"), num, den, part)).select("h", "n", F.col("first.id").alias("one"), F.col("first.content").alias("c64"))
    match = F.col("id").eqNullSafe(F.col("one")) & (F.col("content") == F.col("c64"))
    chosen = materialise(chosen, "chosen", size=size)
    _, some = apart(texts, "content", chosen.withColumnRenamed("c64", "content"))
    full = some.join(chosen, match).select("h", "n", "text").mapInArrow(_full(width), "h binary, n long, own array<long>")
    return materialise(full.dropDuplicates(["h"]), "close")


def rare_keys(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(h, score, keys): the rarest shared shingles of each set, one of which linked sets must share."""
    keys = sets.select("h", "n", F.explode("own").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("g")).where("g > 1")
    held = keys.join(shared, "key").groupBy("h").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("g", "key"))).alias("ks"))
    # of n shingles a partner has ceil(num * n / den) or more
    spare = F.size("ks") - F.ceil(F.col("n") * num / den - 1e-9)
    return held.where(spare >= 0).select("h", F.slice("ks", F.lit(1), (spare + 1).cast("int")).alias("ks")).select("h", F.aggregate("ks", F.lit(0).cast("long"), lambda a, k: a + k["g"]).alias("score"), F.col("ks.key").alias("keys"))


def regions_of(rare: DataFrame) -> DataFrame:
    """(p, h): sets and the pivots that they share a rare shingle with."""
    rows = rare.select("h", "score", F.explode("keys").alias("key"))
    tops = rows.groupBy("key").agg(F.count("*").alias("g"), F.max(F.struct("score", "h")).alias("top")).where("g > 1").select("key", F.col("top.h").alias("p"))
    return rows.join(tops, "key").select("p", "h").distinct()


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def _measure(num: int, den: int):
    """Rows of a pivot come together, the pivot's own (h null) first."""

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.empty(0, np.int64)
        for b in batches(rows):
            ps, hs, apart, linked = [], [], [], []
            for p, h, own in zip(b.column("p").to_pylist(), b.column("h").to_pylist(), _lists(b.column("own")), strict=True):
                if h is None:
                    pivot = own.copy()
                    continue
                small, large = (own, pivot) if len(own) < len(pivot) else (pivot, own)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                union = len(own) + len(pivot) - both
                ps.append(p)
                hs.append(h)
                apart.append(1 - both / union)
                linked.append(den * both >= num * union)
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.binary()), pa.array(hs, pa.binary()), pa.array(apart, pa.float64()), pa.array(linked, pa.bool_())], names=["p", "h", "d", "linked"])

    return measure


def measured(pairs: DataFrame, sets: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """(p, h, d, linked) of distinct pairs (p, h); a pivot of many members is dealt over salts."""
    salts = materialise(pairs.groupBy("p").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts")), "salts", size=size)
    salt = F.pmod(F.xxhash64("h"), F.col("salts")).cast("int")
    members = pairs.join(salts, "p").select("p", "h", salt.alias("salt")).join(sets.select("h", "own"), "h").select("p", "salt", "h", "own")
    pivots = salts.join(sets.select(F.col("h").alias("p"), "own"), "p").select("p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("h"), "own")
    dealt = members.unionByName(pivots).repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("h").asc_nulls_first())
    return materialise(dealt.select("p", "h", "own").mapInArrow(_measure(num, den), "p binary, h binary, d double, linked boolean"), "measured", size=size)


def components(edges: DataFrame, size: int) -> DataFrame:
    """(v, root): the least end that each end of an edge (a, b) reaches."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", size=size)
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels", size=size)
    while True:
        low = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("low"))
        near = materialise(labels.join(low, "v").select("v", F.col("root").alias("old"), F.least("root", "low").alias("root")), "labels", size=size)
        up = near.select(F.col("v").alias("root"), F.col("root").alias("above"))
        new = materialise(near.join(up, "root").select("v", "old", F.col("above").alias("root")), "labels", size=size)
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("v", "root")
        if not changed:
            return labels


def open_regions(members: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Members (region, h, n) of regions with several components, and their component; of the largest one and of the rest, the sizes in shingles."""
    rows = members.join(labels.withColumnRenamed("v", "h"), "h", "left").select("region", "h", "n", F.coalesce("root", "h").alias("comp"))
    by_comp = rows.groupBy("region", "comp").agg(F.sum("n").alias("k"))
    main = by_comp.groupBy("region").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all")).where("m.k < all")
    main = main.select("region", F.col("m.comp").alias("main"), F.col("m.k").alias("n_main"), (F.col("all") - F.col("m.k")).alias("n_rest"))
    return materialise(rows.join(main, "region"), "open", size=size)


def _block(num: int, den: int):
    """Links that join components of a block, by counting intersections over postings."""

    def links(ids: list[bytes], comps: list[bytes], sides: np.ndarray, own: list[np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
        label = np.unique(np.array([c.hex() for c in comps]), return_inverse=True)[1]
        sizes = np.array(list(map(len, own)))
        codes = np.unique(np.concatenate(own), return_inverse=True)[1]
        holder = np.repeat(np.arange(len(own)), sizes)
        second = sides[holder] == 1 if (sides == 1).any() else np.ones(len(holder), bool)
        order = np.argsort(codes[second], kind="stable")
        posting, starts = holder[second][order], np.searchsorted(codes[second][order], np.arange(codes.max() + 2))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for i in np.flatnonzero(sides == 0):
            mine = codes[ends[i] : ends[i + 1]]
            low, count = starts[mine], starts[mine + 1] - starts[mine]
            at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            both = np.bincount(posting[at], minlength=len(own))
            near = np.flatnonzero((both > 0) & (label != label[i]) & (den * both >= num * (sizes + sizes[i] - both)))
            for j in near:
                if label[j] != label[i]:
                    yield ids[i], ids[j]
                    label[label == label[j]] = label[i]

    def join(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, comps, sides, own = None, [], [], [], []

        def flush() -> pa.RecordBatch:
            found = list(links(ids, comps, np.array(sides), own)) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for b in batches(rows):
            names = zip(*(b.column(c).to_pylist() for c in ("region", "x", "y", "kind")), strict=True)
            for name, h, comp, side, s in zip(names, b.column("h").to_pylist(), b.column("comp").to_pylist(), b.column("side").to_pylist(), _lists(b.column("own")), strict=True):
                if name != block:
                    yield flush()
                    block, ids, comps, sides, own = name, [], [], [], []
                ids.append(h)
                comps.append(comp)
                sides.append(side)
                own.append(s.copy())
        yield flush()

    return join


def in_blocks(opened: DataFrame, sets: DataFrame, num: int, den: int, cell: int) -> DataFrame:
    """Links (a, b) that join components of open regions.

    A small region is one block.  Of others the rest is dealt over rows and
    columns, the largest component over columns only.
    """
    is_main = F.col("comp") == F.col("main")
    cells = lambda c: F.ceil(F.col(c) / cell).cast("int")
    own = lambda c: F.pmod(F.xxhash64("h"), cells(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), cells(c) - 1)
    at = lambda x, y, kind, side: F.struct(x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    mine = own("n_rest")
    for_main = F.transform(upto("n_rest"), lambda y: at(y, own("n_main"), "main", one))
    for_rest = F.concat(
        F.transform(upto("n_main"), lambda x: at(mine, x, "main", zero)),
        F.transform(upto("n_rest"), lambda y: at(F.least(y, mine), F.greatest(y, mine), "rest", F.when(y >= mine, zero).otherwise(one))),
    )
    small = F.col("n_main") + F.col("n_rest") <= cell
    dealt = F.when(small, F.array(at(zero, zero, "all", zero))).when(is_main, for_main).otherwise(for_rest)
    rows = opened.select("region", "h", "comp", F.inline(dealt)).join(sets.select("h", "own"), "h")
    place = ["region", "x", "y", "kind"]
    return rows.repartition(*place).sortWithinPartitions(*place).select(*place, "h", "comp", "side", "own").mapInArrow(_block(num, den), "a binary, b binary")


def cut(large: DataFrame, sets: DataFrame, num: int, den: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links through new pivots of large regions, members of the regions of these, and members of regions that don't shrink."""
    new = F.struct(F.xxhash64("h").alias("rank"), F.col("h").alias("p"))
    rest = large.where("comp <> main").groupBy("region", F.pmod(F.xxhash64("h"), F.lit(PIVOTS)).alias("bucket")).agg(F.min(new).alias("new"))
    pairs = materialise(large.join(rest.select("region", "new.p"), "region").select("region", "p", "h", "n", (F.col("n_main") + F.col("n_rest")).alias("all")), "pairs", size=PIVOTS * size)
    found = measured(pairs.where("p <> h").select("p", "h").distinct(), sets, num, den, PIVOTS * size)
    apart = pairs.join(found, ["p", "h"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    window = 2 * (1 - num / den) + 1e-9
    own = apart.groupBy("region", "h", "n", "all").agg(F.min("d").alias("near"), F.collect_list(F.struct("p", "d")).alias("to"))  # at most PIVOTS of them
    parts = own.select("region", "h", "n", "all", F.explode(F.filter("to", lambda t: t["d"] <= F.col("near") + window)).alias("t")).select("region", "t.p", "h", "n", "all")
    parts = materialise(parts, "parts", size=PIVOTS * size)
    sizes = parts.groupBy("region", "p").agg(F.sum("n").alias("k"), F.first("all").alias("all"))
    stuck = materialise(sizes.groupBy("region").agg((4 * F.max("k") > 3 * F.first("all")).alias("stuck")).where("stuck").select("region"), "stuck", size=size)
    smaller = parts.join(stuck, "region", "left_anti").select(F.unhex(F.md5(F.concat("region", "p"))).alias("region"), "h", "n")
    return found.where("linked").select(F.col("p").alias("a"), F.col("h").alias("b")), smaller, large.join(stuck, "region", "left_semi").select("region", "h", "n")


def set_links(texts: DataFrame, owners: DataFrame, width: int, num: int, den: int, cell: int, part: int, size: int) -> DataFrame:
    """Links (a, b) between sets that make up the components."""
    sets = close_sets(texts, owners, width, num, den, part, size)
    size = ROW * sets.count()
    rare = materialise(rare_keys(sets, num, den), "rare", size=16 * size)
    regions = materialise(regions_of(rare), "regions", size=2 * size)
    size = ROW * regions.count()
    stars = measured(regions.where("p <> h"), sets, num, den, size).where("linked")
    edges = stars.select(F.col("p").alias("a"), F.col("h").alias("b"))
    todo = regions.select(F.col("p").alias("region"), "h").join(sets.select("h", "n"), "h")
    done = None
    while True:
        labels = components(edges, size)
        opened = open_regions(todo, labels, size)
        large = F.col("n_main") + F.col("n_rest") > cell
        rest = opened.where(~large)
        if done is None and not opened.where(large).limit(1).count():  # as most often: no region to cut
            break
        rest = rest.select("region", "h", "n")
        done = rest if done is None else done.unionByName(rest)
        if not opened.where(large).limit(1).count():
            opened = open_regions(done, labels, size)
            break
        more, todo, stuck = cut(opened.where(large), sets, num, den, size)
        edges, done = edges.unionByName(more), done.unionByName(stuck)
    return edges.unionByName(in_blocks(opened, sets, num, den, cell))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 8, den: int = 10, cell: int = 1 << 20, part: int = 10) -> DataFrame:
    """Per row: id, n_shingles, component_id; documents link when den * |x & y| >= num * |x | y|."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("content"))
    rows = materialise(texts.mapInArrow(_sets(width), "id long, n long, h binary, v long, content long"), "rows", few_files=True)
    size = ROW * rows.count()
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "content")).alias("first")
    owners = materialise(rows.groupBy("h").agg(F.first("n").alias("n"), F.first("v").alias("v"), first), "owners", size=size)
    links = set_links(texts, owners.where("n > 0"), width, num, den, cell, part, size)
    ids = rows.where("id is not null").groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("id", "a")
    same_id = rows.join(ids, "id").where("h <> a").select("a", F.col("h").alias("b")).distinct()
    labels = components(links.unionByName(same_id), size)
    joined = owners.join(labels.withColumnRenamed("v", "h"), "h", "left").select("h", F.coalesce("root", "h").alias("root"), "first.id")
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    owner = materialise(joined.join(least, "root").select("h", "component_id"), "joined", size=size)
    return rows.join(owner, "h").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
