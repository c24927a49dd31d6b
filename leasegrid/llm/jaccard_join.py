"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

``jaccard_components`` finds the classes of documents linked by Jaccard similarity >= num/den over
their distinct word n-grams, exactly and over all documents:

1. A fixed-size count sketch over every document orders n-grams from rare to frequent. It only
   sets the order, never the result.
2. Each document gives its set size, a digest of the whole set, a bitmap signature and its prefix:
   the rarest ``n - ceil(t n) + 1`` n-grams, of which two linked sets always share one.
   Documents with equal sets are one representative from here on.
3. Linked sets lie in one band of sizes or in neighbouring ones, bands being 1/t wide. Of the prefix
   n-grams only those stay that two representatives of neighbouring bands share, one of them early enough
   in its order for the n-gram to be a linked pair's first: later ones would only find the pair again.
4. Every representative meets one leader, the first of most of its n-grams: sizes and bit counts bound
   their overlap from above, and what is left is intersected exactly. Linked ones take the leader's
   label, so that large groups of near-copies need no further comparison among themselves.
5. The entries of an n-gram that still holds several labels form tiles of bounded size, sorted by set
   size so that only a band is compared: first by coarse signatures, then by fine ones, and the
   pairs left are intersected exactly. A tile lists the nearest partners of each entry first; where
   that leaves pairs out, the n-gram is looked at again with the labels that the links have joined, so
   that a group of g near copies costs a multiple of g pairs and not g * g. Tiles list more and more
   partners if nothing joins, until every pair of different labels has been judged.

Null and empty texts have no n-grams (size 0) and link with nothing. A text of fewer words than n
is one n-gram. Rows that share a doc_id count as one document with several texts; rows with a null
doc_id are returned with a null component. An empty table gives an empty result. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .components import components
from .shared import bounded_batches, free, lean, row_blocks, small, stored, text_bytes

SKETCH_BITS = 21
#: entries on each side of a tile compared in one task
TILE = 4096
TILE_KEY = ["token", "i", "j"]
#: entries of an n-gram up to which tiles compare coarse signatures
FEW = 64
#: partners of an entry that a tile lists at first
NEAREST = 16
#: pairs that a task of tiles holds back to name each once
HELD_PAIRS = 1 << 20
#: smallest and largest signature, in bits
MIN_BITS, MAX_BITS = 512, 1 << 17


def _grams(col: pa.Array, n: int, block: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, hashes, first) for blocks of rows."""
    data, off = text_bytes(col)
    for lo, hi in row_blocks(off, block):
        part, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        starts, ends, first = wh.word_ranges(part, o)
        grams, at = wh.gram_hashes(wh.hash_ranges(part, starts, ends), first, n)
        yield lo, hi, grams, at


def _distinct(grams: np.ndarray) -> np.ndarray:
    s = np.sort(grams)
    return s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]


def frequency_sketch(docs: DataFrame, n: int, text_col: str = "text") -> np.ndarray:
    """uint8 log-scale counts of hashed n-grams over all documents; 2**SKETCH_BITS buckets, whatever the input."""
    size = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for _, _, grams, _ in _grams(b.column(0), n):
                total += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        # counts near the mean say nothing about any one n-gram and would only be shuffled
        mean = total.mean()
        keep = np.flatnonzero(total > mean + 3 * np.sqrt(mean) + 2)
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(total[keep])], names=["bucket", "n"])

    rows = (docs.select(text_col).mapInArrow(lean(count), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(size, np.uint8)
    if len(rows):
        out[rows["bucket"].to_numpy()] = np.minimum(255, 4 * np.log2(1 + rows["n"].to_numpy(np.float64))).astype(np.uint8)
    return out


def signature(s: np.ndarray, load: int = 4) -> bytes:
    """Bitmap of a set: ``load`` times its size in bits, rounded up to a power of two."""
    bits = MIN_BITS
    while bits < load * len(s) and bits < MAX_BITS:
        bits *= 2
    bitmap = np.zeros(bits, np.uint8)
    bitmap[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(bitmap, bitorder="little").tobytes()


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """A (k, m) matrix of 64-bit signature words reduced to n words by OR; hashes are taken modulo a power of two."""
    while words.shape[1] > n:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def _profiles(docs: DataFrame, n: int, num: int, den: int, sketch: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    shift = np.uint64(64 - SKETCH_BITS)

    def profile(batches):
        for b in batches:
            sizes, d1, d2, prefixes, maps, coarse = [], [], [], [], [], []
            for lo, hi, grams, at in _grams(b.column(1), n):
                for i in range(hi - lo):
                    s = _distinct(grams[at[i]:at[i + 1]])
                    sizes.append(len(s))
                    d1.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                    d2.append(int(wh.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0)
                    if not len(s):
                        prefixes.append(s)
                        maps.append(b"")
                        coarse.append(b"")
                        continue
                    p, freq = prefix_length(len(s), num, den), sketch[(s >> shift).astype(np.int64)]
                    prefixes.append(s[np.argsort(freq, kind="stable")[:p]] if freq.any() else s[:p])
                    maps.append(signature(s))
                    coarse.append(signature(s, 1))
            ends = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum([len(p) for p in prefixes], out=ends[1:])
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64))),
                pa.array(maps, pa.binary()), pa.array(coarse, pa.binary()),
            ], names=["doc_id", "n", "d1", "d2", "prefix", "bits", "coarse"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(lean(profile), "doc_id long, n long, d1 long, d2 long, prefix array<long>, bits binary, coarse binary"))


def _sets(docs: DataFrame, n: int, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, n, arr): sorted n-gram hashes of the wanted documents, as bytes."""

    def arrays(batches):
        for b in batches:
            sizes, arrs = [], []
            for lo, hi, grams, at in _grams(b.column(1), n):
                for i in range(hi - lo):
                    s = _distinct(grams[at[i]:at[i + 1]])
                    sizes.append(len(s))
                    arrs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(arrs, pa.binary())],
                                             names=["rep", "n", "arr"])

    text = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    return text.join(small(wanted), "rep", "left_semi").select("rep", "text").mapInArrow(lean(arrays), "rep long, n long, arr binary")


def _intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, both): exact intersection sizes of the pairs (a, b)."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("arr").alias("arr_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("arr").alias("arr_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "arr_a", "arr_b")

    def count(batches):
        for b in batches:
            both = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
                    for x, y in zip(b.column(4), b.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(both, pa.int64())],
                                             names=["a", "b", "na", "nb", "both"])

    return joined.mapInArrow(lean(count), "a long, b long, na long, nb long, both long")


def _plausible(pairs: DataFrame, reps: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures leave room for a distance of ``limit``."""
    side = reps.select("rep", "n", "bits")
    joined = (pairs.join(side.toDF("a", "na", "bits_a"), "a").join(side.toDF("b", "nb", "bits_b"), "b")
              .where(F.least("na", "nb") >= (1 - limit) * F.greatest("na", "nb") - 1e-9)
              .select("a", "b", "na", "nb", "bits_a", "bits_b"))

    def bound(batches):
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            total = t.column(2).to_numpy() + t.column(3).to_numpy()
            for k, (x, y) in enumerate(zip(t.column(4), t.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                w = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(x[None, :], w) ^ fold(y[None, :], w)).sum())
                keep[k] = apart <= limit / (2 - limit) * total[k] + 1e-6
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(lean(bound), "a long, b long").distinct()


def _tile_pairs(entries: DataFrame, limit: float, most: int) -> DataFrame:
    """(a, b): representatives of different labels in one tile whose sizes and signatures leave room for a distance
    of ``limit``. A pair that is not among the ``most`` nearest of either side is left out; its token is then a
    row (null, null, token). Entries are (token, count, rep, label, n, room, bits), count the token's. A task
    holds back up to HELD_PAIRS pairs, as its tiles find many of them several times."""
    e = (entries.withColumn("k", F.expr(f"cast(ceil(count / {TILE}) as int)"))
         .withColumn("part", F.expr("cast(pmod(xxhash64(rep), k) as int)"))
         .withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
         .select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "n", "part", "rep", "label", "room", "bits"))

    def tile(batches):
        pairs, size = [], 0
        for a, b, rest in tiles(batches):
            if len(rest):
                none = pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(rest)], names=["a", "b", "token"])
            pairs.append(np.stack([a, b]))
            size += len(a)
            if size > HELD_PAIRS:
                pairs = [np.unique(np.concatenate(pairs, axis=1), axis=1)]
                size = pairs[0].shape[1]
                if size > HELD_PAIRS // 2:
                    yield found(pairs[0])
                    pairs, size = [], 0
        if size:
            yield found(np.unique(np.concatenate(pairs, axis=1), axis=1))

    def found(pair):
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.nulls(pair.shape[1], pa.int64())], names=["a", "b", "token"])

    def tiles(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = np.stack([t.column(c).to_numpy() for c in TILE_KEY])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from _tile_out(t.slice(0, last), limit, most)
            held = t.slice(last)
        if held is not None:
            yield from _tile_out(held, limit, most)

    return (e.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "n")
            .mapInArrow(lean(tile), "a long, b long, token long").distinct())


def _tile_out(t: pa.Table, limit: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, tokens with pairs left out) of whole tiles, sorted by tile and size. All entries meet their next neighbour, then the
    one after it, and so on; an entry stops at its tile's end or where sizes leave the band."""
    if t.num_rows < 2:
        return
    token, i, j, n, part, rep, label, room = (t.column(c).to_numpy() for c in (*TILE_KEY, "n", "part", "rep", "label", "room"))
    group = np.concatenate(([0], np.cumsum((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    data = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("bits").combine_chunks()]
    width = np.array([len(w) for w in data])
    place = np.zeros(len(data), np.int64)  # each entry's row in the table of its width, and in that of half of it
    own, half = {}, {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        own[w] = np.stack([data[k] for k in at])
        half[w] = fold(own[w], w // 2) if w > 1 else own[w]
    top, left, right, apart_ = n / (1 - limit) + 1e-9, [], [], []
    x, step = np.arange(len(n)), 0
    while True:
        step += 1
        x = x[x + step < len(n)]
        y = x + step
        on = (group[x] == group[y]) & (n[y] <= top[x])
        x, y = x[on], y[on]
        if not len(x):
            break
        # a linked pair has room for its overlap after the first n-gram that both hold
        meet = ((label[x] != label[y]) & ((i[x] == j[x]) | (part[x] != part[y]))
                & (np.minimum(room[x], room[y]) * (2 - limit) >= (1 - limit) * (n[x] + n[y]) - 1e-6))
        a, b = x[meet], y[meet]
        for w in np.unique(width[a]):
            for other, table in ((w, own), (2 * w, half)):  # sizes of a band differ by less than two
                at = np.flatnonzero((width[a] == w) & (width[b] == other))
                if len(at):
                    u, v = a[at], b[at]
                    apart = np.bitwise_count(own[w][place[u]] ^ table[other][place[v]]).sum(axis=1)
                    # |A xor B| >= bits that differ; distance <= d needs |A xor B| <= d / (2 - d) * (|A| + |B|)
                    near = apart <= limit / (2 - limit) * (n[u] + n[v]) + 1e-6
                    left.append(u[near])
                    right.append(v[near])
                    apart_.append((apart / (n[u] + n[v]))[near])
    if not left:
        return
    u, v, apart = np.concatenate(left), np.concatenate(right), np.concatenate(apart_)
    keep = _among_nearest(u, v, apart, len(n), most)
    yield np.minimum(rep[u], rep[v])[keep], np.maximum(rep[u], rep[v])[keep], np.unique(token[u[~keep]])


def _among_nearest(u: np.ndarray, v: np.ndarray, apart: np.ndarray, size: int, most: int) -> np.ndarray:
    """Whether each pair (u, v) is among the ``most`` nearest of u or of v."""
    keep = np.zeros(len(u), bool)
    if max(np.bincount(u, minlength=size).max(), np.bincount(v, minlength=size).max()) * 2 <= most:
        return ~keep
    one, pair = np.concatenate((u, v)), np.tile(np.arange(len(u)), 2)
    order = np.lexsort((np.tile(apart, 2), one))
    one, pair = one[order], pair[order]
    first = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1])))
    place = np.arange(len(one)) - np.repeat(first, np.diff(np.append(first, len(one))))
    keep[pair[place < most]] = True
    return keep


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; see the module's text.

    Two documents link when den * |A and B| >= num * |A or B| over their distinct n-word shingles.
    """
    if den > 2 * num:
        raise ValueError("bands assume a similarity of at least one half")
    bounded_batches(docs.sparkSession)
    sketch = frequency_sketch(docs, n, text_col)
    profiles = stored(_profiles(docs, n, num, den, sketch, id_col, text_col), "profiles")
    digests = (profiles.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
               .where("rep is not null"))
    member = stored(profiles.select("doc_id", "n", "d1", "d2").join(digests, ["d1", "d2", "n"], "left")
                    .select("doc_id", "n", "rep"), "member")
    copies = small(member.where("doc_id <> rep").select("doc_id").distinct())
    reps = (profiles.where("n > 0 and doc_id is not null").join(copies, "doc_id", "left_anti")
            .withColumnRenamed("doc_id", "rep"))

    # room: n-grams from this one on, which bound the overlap of two sets that share none before it. A linked pair's
    # first shared one leaves its smaller set the room that a set of equal size needs
    tokens = (reps.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
              .select("rep", "n", "token", (F.col("n") - F.col("pos")).alias("room"))
              .withColumn("early", F.expr(f"room * {num + den} >= {2 * num} * n")))
    # of two holders the sizes tell at once; more are looked at by bands below
    several = (tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("early").alias("early"))
               .where(f"early and (c > 2 or c = 2 and {den} * lo >= {num} * hi)").select("token"))
    several = stored(several, "several")
    shared = stored(tokens.join(small(several, 1_000_000), "token"), "shared")
    free(several)
    step = -math.log(num / den) * (1 + 1e-9)  # sizes exactly 1/t apart stay neighbours whatever the rounding
    banded = (shared.withColumn("level", F.floor(F.log("n") / step).cast("int"))
              .withColumn("own", F.explode(F.array(F.lit(1), F.lit(0))))
              .select("token", (F.col("level") + 1 - F.col("own")).alias("band"), "own", "rep", "room", "early"))
    tiles = (banded.groupBy("token", "band").agg(F.min("rep").alias("lead"), F.max("rep").alias("top"), F.max("own").alias("any"),
                                             F.max("early").alias("first"))
             .where("lead < top and any = 1 and first").drop("top", "any", "first"))
    held = stored(banded.join(tiles, ["token", "band"]).groupBy("token", "rep").agg(F.min("lead").alias("lead"), F.max("room").alias("room")), "held")

    limit = 1 - num / den
    linked = F.expr(f"{den} * both >= {num} * (na + nb - both)")

    def links_of(pairs: DataFrame) -> DataFrame:
        near = stored(_plausible(pairs, reps, limit), "pairs")
        ids = near.select(F.col("a").alias("rep")).unionAll(near.select("b")).distinct()
        sets = stored(_sets(docs, n, ids, id_col, text_col), "sets")
        links = stored(_intersections(near, sets).where(linked).select("a", "b").distinct(), "links")
        free(near, sets)
        return links

    # one leader for each representative
    votes = held.where("rep <> lead").groupBy("rep", "lead").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("rep").agg(F.max_by("lead", F.struct("votes", -F.col("lead"))).alias("lead"))
    balls = links_of(chosen.select(F.col("rep").alias("a"), F.col("lead").alias("b")))

    # n-grams that still hold several labels
    label = balls.select(F.col("a").alias("rep"), F.col("b").alias("label"))
    named = stored(held.drop("lead").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "named")
    free(shared, held)
    links, most = balls, NEAREST
    while True:
        mixed = (named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("count"))
                 .where("x < y").select("token", "count"))
        # coarse signatures leave few pairs where few meet; where many do, fine ones cost less than the pairs
        crowd = F.when(F.col("count") > FEW, F.col("fine")).otherwise(F.col("coarse"))
        sides = reps.select("rep", F.col("n").cast("long").alias("n"), "coarse", F.col("bits").alias("fine"))
        entries = named.join(mixed, "token").join(sides, "rep").select("token", "count", "rep", "label", "n", "room", crowd.alias("bits"))
        tiles = stored(_tile_pairs(entries, limit, most), "tiles")
        found = links_of(tiles.where("token is null").select("a", "b"))
        links = links.unionAll(found)
        again = tiles.where("token is not null").select("token").distinct()
        if again.limit(1).count() == 0:
            free(tiles)
            break
        # only n-grams with pairs left out go on, their labels joined by what was found
        left = named.join(small(stored(again, "again")), "token", "left_semi")
        if found.limit(1).count():
            of = named.select("rep", "label").distinct()
            ends = found.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            joined = stored(components(ends).toDF("label", "new"), "joined")
            left = left.join(small(joined), "label", "left").select("token", "rep", "room", F.coalesce("new", "label").alias("label"))
        else:
            most *= 4
        left = stored(left, "named")
        free(named, tiles)
        named = left
    free(named, profiles)

    settled = components(links).withColumnRenamed("node", "rep")
    return (member.join(settled, "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component", "rep", "doc_id").alias("component_id")))
