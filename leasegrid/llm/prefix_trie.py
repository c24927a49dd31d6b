"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt as the first ``head`` turns of a base conversation and its own turns from
there on, without writing any text: a sequence of turns has the fingerprint F = sum of x_i * B^i in
four prime fields, and fingerprints compose as a monoid, (F, m) o (G, n) = (F + B^m G, m + n). The
prefixes of all given conversations are scanned once; a prefix of a rebuilt one is then base head o
own suffix, an expression of three stored numbers.

Equal fingerprints at a depth are a node. Its members must have the same parent and the same
reference to their last turn (120 bits of the SHA-256 of its role and text), by which, from the root
down, all their turns are equal; if a group ever fails this, everything is fingerprinted anew in
another base. Sums over subtrees use pointer doubling, so that rounds grow with the logarithm of the
depth, and round k only carries nodes of depth 2^k and more.

Nothing gathers a conversation, a node's members or a node's children in one task: turns are scanned
in ranges of (conv_id, turn) with the ranges' totals composed afterwards, members and children are
counted by partial aggregates, and lists of members that stretch over several tasks are hashed from
text chunks of bounded size. Every step is written to the shared folder.

Turns are ordered by turn, null first, ties by role, then by the text's SHA-256; repeated rows are
turns of their own. Null roles and texts are empty; rows without conv_id are no conversation. Empty
tables give no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, lean, stored

#: primes below 2^31; two lanes are packed into one long
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
LANE = 31
MASK = (1 << LANE) - 1
#: characters of joined ids in a chunk
CHUNK = 1 << 18
KEY = ["depth", "k0", "k1"]


# --------------------------------------------------------------------------- fingerprints
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1)."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate((out, out * step % np.uint64(prime)))
    return out[:n]


def _pack(lanes: list[np.ndarray]) -> list[np.ndarray]:
    shift = np.uint64(LANE)
    return [(lanes[0] << shift | lanes[1]).astype(np.int64), (lanes[2] << shift | lanes[3]).astype(np.int64)]


def _lanes(k0: Column, k1: Column) -> list[Column]:
    low = lambda k: k.bitwiseAND(F.lit(MASK))
    return [F.shiftright(k0, LANE), low(k0), F.shiftright(k1, LANE), low(k1)]


def _packed(lanes: list[Column]) -> list[Column]:
    return [F.shiftleft(lanes[0], LANE).bitwiseOR(lanes[1]), F.shiftleft(lanes[2], LANE).bitwiseOR(lanes[3])]


def _scan(turns: DataFrame, bases: list[int]) -> DataFrame:
    """Position, fingerprint (k0, k1) of the prefix up to each turn and of the one before it (p0, p1), within
    its partition's part of the conversation; ``first`` and ``last`` mark the ends of a partition."""

    def run(batches):
        part, conv, pos, lanes = TaskContext.get().partitionId(), None, 0, [0] * 4
        held = None
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            c = b.column(0).to_numpy()
            refs = [b.column(k).to_numpy().astype(np.uint64) for k in (1, 2)]
            low = np.uint64((1 << 30) - 1)
            x = [refs[0] >> np.uint64(30), refs[0] & low, refs[1] >> np.uint64(30), refs[1] & low]
            start = np.concatenate(([conv is None or c[0] != conv], c[1:] != c[:-1]))
            run_no = np.cumsum(start)
            begin = np.concatenate(([0], np.flatnonzero(start))) if not start[0] else np.flatnonzero(start)
            run_no = run_no - run_no[0]
            carried = 0 if start[0] else pos
            at = np.arange(n) - begin[run_no] + 1
            where = at + np.where(run_no == 0, carried, 0)
            now, before = [], []
            for j, (prime, base) in enumerate(zip(PRIMES, bases, strict=True)):
                p = np.uint64(prime)
                power = _powers(base, prime, int(at.max()) + 1)[at]
                if carried:
                    power = np.where(run_no == 0, power * np.uint64(pow(base, carried, prime)) % p, power)
                term = (x[j] + np.uint64(1)) * power % p
                total = np.cumsum(term)
                base_sum = np.concatenate(([np.uint64(0)], total))[begin]
                f = (total - base_sum[run_no]) % p
                if carried:
                    f = np.where(run_no == 0, (f + np.uint64(lanes[j])) % p, f)
                now.append(f)
                before.append((f + p - term) % p)
            conv, pos, lanes = c[-1], int(where[-1]), [int(f[-1]) for f in now]
            first = np.zeros(n, bool)
            first[0] = held is None
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(n, part)), pa.array(where), *map(pa.array, _pack(now)), *map(pa.array, _pack(before)),
                 b.column(1), b.column(2), b.column(3), pa.array(first), pa.array(np.zeros(n, bool))], names=names)
        if held is not None:
            last = np.zeros(held.num_rows, bool)
            last[-1] = True
            yield held.set_column(names.index("last"), "last", pa.array(last))

    names = ["conv_id", "part", "pos", "k0", "k1", "p0", "p1", "r0", "r1", "chars", "first", "last"]
    kinds = ", ".join(f"{c} {'boolean' if c in ('first', 'last') else 'long'}" for c in names)
    return turns.mapInArrow(lean(run), kinds)


def _continued(scan: DataFrame, bases: list[int]) -> DataFrame:
    """The scan with positions and fingerprints of whole conversations: parts that continue one of an earlier
    partition are composed with what lies before them. Reads two rows of each partition on the driver."""
    ends = scan.where("first or last").select("part", "conv_id", "pos", "k0", "k1", "first", "last").collect()
    firsts = {r.part: r.conv_id for r in ends if r["first"]}
    lasts = {r.part: r for r in ends if r["last"]}
    offsets, conv, pos, f = [], None, 0, [0] * 4
    for part in sorted(lasts):
        r = lasts[part]
        own = [r.k0 >> LANE, r.k0 & MASK, r.k1 >> LANE, r.k1 & MASK]
        w = [pow(b, pos, p) for b, p in zip(bases, PRIMES, strict=True)]
        if firsts[part] == conv:
            offsets.append((part, conv, pos, *f, *w))
        if r.conv_id == conv:  # all of this partition
            pos, f = pos + r.pos, [(a + m * x) % p for a, m, x, p in zip(f, w, own, PRIMES, strict=True)]
        else:
            conv, pos, f = r.conv_id, r.pos, own
    plain = ["conv_id", "pos", "k0", "k1", "p0", "p1", "r0", "r1", "chars"]
    if not offsets:
        return scan.select(plain)
    schema = "part long, conv_id long, off long, " + ", ".join(f"{c}{j} long" for c in "fw" for j in range(4))
    table = F.broadcast(scan.sparkSession.createDataFrame(offsets, schema))  # one row per partition at most
    joined = scan.join(table, ["part", "conv_id"], "left")

    def shifted(a: str, b: str) -> list[Column]:
        lanes = [(F.col(f"f{j}") + F.col(f"w{j}") * x) % p for j, (x, p) in enumerate(zip(_lanes(F.col(a), F.col(b)), PRIMES, strict=True))]
        return [F.when(F.col("off").isNull(), F.col(old)).otherwise(new).alias(old) for old, new in zip((a, b), _packed(lanes), strict=True)]

    return joined.select("conv_id", (F.col("pos") + F.coalesce("off", F.lit(0))).alias("pos"), *shifted("k0", "k1"), *shifted("p0", "p1"), "r0", "r1", "chars")


# --------------------------------------------------------------------------- members
def _members(scan: DataFrame, bases: list[int], base_of: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(members, ends): every prefix of every rebuilt conversation, and each conversation's whole sequence."""
    at_head = F.col("pos") == F.col("h")
    own = scan.withColumn("h", head).groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max("h").alias("h"), *(F.max(F.when(at_head, F.col(k))).alias(f"h{k}") for k in ("k0", "k1")),
        *(F.max_by(k, "pos").alias(f"e{k}") for k in ("k0", "k1")))
    turn = F.struct("pos", "k0", "k1", "p0", "p1", "r0", "r1", "chars")
    bases_needed = own.select(base_of.alias("conv_id")).distinct()
    heads = (scan.where(F.col("pos") <= most).join(bases_needed, "conv_id", "left_semi")
             .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("turns")))
    conv = own.withColumn("base", base_of).join(heads, "base", "left")
    conv = conv.withColumn("turns", F.coalesce(F.slice("turns", 1, F.col("h").cast("int")), F.array().cast(heads.schema["turns"].dataType)))
    conv = conv.withColumn("l", F.size("turns").cast("long"))
    zero = F.lit(0).cast("long")
    tail = F.try_element_at("turns", F.greatest("l", F.lit(1)).cast("int"))
    head_lanes = _lanes(F.coalesce(tail["k0"], zero), F.coalesce(tail["k1"], zero))
    own_lanes = _lanes(F.coalesce("hk0", zero), F.coalesce("hk1", zero))
    # base head o own suffix = H + B^(l-h) (F - F_h), l <= h
    scale = [F.element_at(F.array(*(F.lit(pow(b, -i, p)).cast("long") for i in range(most + 1))), (F.col("h") - F.col("l") + 1).cast("int"))
             for b, p in zip(bases, PRIMES, strict=True)]
    conv = conv.select("conv_id", "n", "h", "l", "ek0", "ek1", "turns", *(m.alias(f"m{j}") for j, m in enumerate(scale)),
                       *(F.pmod(a - m * o, F.lit(p)).alias(f"s{j}") for j, (a, m, o, p) in enumerate(zip(head_lanes, scale, own_lanes, PRIMES, strict=True))))
    conv = stored(conv, "rebuilt")

    def rebuilt(k0: Column, k1: Column) -> list[Column]:
        return _packed([(F.col(f"s{j}") + F.col(f"m{j}") * x) % p for j, (x, p) in enumerate(zip(_lanes(k0, k1), PRIMES, strict=True))])

    columns = ["conv_id", "depth", "k0", "k1", "p0", "p1", "r0", "r1", "chars"]
    root = conv.select("conv_id", *(zero.alias(c) for c in columns[1:]))
    from_head = conv.select("conv_id", F.explode("turns").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), *(f"t.{c}" for c in columns[2:]))
    now, before = rebuilt(F.col("k0"), F.col("k1")), rebuilt(F.col("p0"), F.col("p1"))
    numbers = [f"{c}{j}" for c in "ms" for j in range(4)]
    suffix = (scan.join(conv.where("n > h").select("conv_id", "h", "l", *numbers), "conv_id").where("pos > h")
              .select("conv_id", (F.col("pos") + F.col("l") - F.col("h")).alias("depth"), now[0].alias("k0"), now[1].alias("k1"),
                      before[0].alias("p0"), before[1].alias("p1"), "r0", "r1", "chars"))
    whole = rebuilt(F.col("ek0"), F.col("ek1"))
    longer = F.col("n") > F.col("h")
    ends = conv.select("conv_id", F.when(longer, F.col("n") + F.col("l") - F.col("h")).otherwise(F.col("l")).alias("depth"),
                       *(F.when(longer, w).otherwise(F.coalesce(tail[k], zero)).alias(k) for k, w in zip(("k0", "k1"), whole, strict=True)))
    return root.unionAll(from_head).unionAll(suffix), ends


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k0, k1, ends_sha256): hash of the ascending, comma-joined conv_ids of each key. Keys that lie within
    a task are hashed there; those at its ends, and long ones, go on as chunks of joined ids in order."""
    spans = "depth long, k0 long, k1 long, part long, seq long, ids string, ends_sha256 string"
    names = [x.split()[0] for x in spans.split(", ")]

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string() if k > 4 else pa.int64()) for k in range(7)], names=names)

    def local(batches):
        part, seq, key, outer, buffer, size = TaskContext.get().partitionId(), 0, None, True, [], 0
        out = []

        def flush(final):
            nonlocal seq, buffer, size
            text = ",".join(buffer)
            out.append((*key, part, seq, None, hashlib.sha256(text.encode()).hexdigest()) if final else (*key, part, seq, text, None))
            seq, buffer, size = seq + 1, [], 0

        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in (1, 2, 3)], axis=1)
            ids = b.column(0).to_numpy().astype(str).tolist()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if lo == hi:
                    continue
                here = tuple(keys[lo].tolist())
                if here != key:
                    if key is not None:
                        flush(not outer)
                        outer = False
                    key = here
                buffer += ids[lo:hi]
                size += sum(map(len, ids[lo:hi])) + hi - lo
                if size > CHUNK:
                    outer = True
                    flush(False)
            if out:
                yield rows(out)
                out.clear()
        if key is not None and buffer:
            flush(False)
        if out:
            yield rows(out)

    def gather(batches):
        key, state, out = None, None, []
        for b in batches:
            for r in b.to_pylist():
                here = (r["depth"], r["k0"], r["k1"])
                if here != key:
                    if key is not None:
                        out.append((*key, 0, 0, None, state.hexdigest()))
                    key, state = here, hashlib.sha256(r["ids"].encode())
                elif r["ids"]:
                    state.update(b"," + r["ids"].encode())
            if out:
                yield rows(out)
                out = []
        if key is not None:
            yield rows([(*key, 0, 0, None, state.hexdigest())])

    order = [*KEY, "conv_id"]
    found = stored(ends.select("conv_id", *KEY).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(local), spans), "ends")
    pieces = found.where("ends_sha256 is null").repartition(*KEY).sortWithinPartitions(*KEY, "part", "seq").mapInArrow(lean(gather), spans)
    return found.where("ends_sha256 is not null").unionAll(pieces).select(*KEY, "ends_sha256")


# --------------------------------------------------------------------------- subtrees
def _subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(conv_id, depth, sums): what the proper descendants of each node hold, by pointer doubling.
    ``nodes``: conv_id and depth name a node, parent_conv_id its parent one level up."""
    state = nodes.where("depth > 0").select("conv_id", "depth", F.col("parent_conv_id").alias("up"), *sums)
    added, step = [], 1
    while True:
        add = state.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(*(F.sum(c).alias(c) for c in sums))
        add = stored(add, "subtree-add")
        added.append(add)
        deeper = state.where(F.col("depth") >= 2 * step)
        above = state.select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        got = add.select("conv_id", "depth", *(F.col(c).alias(f"more_{c}") for c in sums))
        state = stored(deeper.join(got, ["conv_id", "depth"], "left").join(above, ["up", "depth"]).select(
            "conv_id", "depth", F.col("next").alias("up"),
            *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums)), "subtree-state")
        step *= 2
        if state.limit(1).count() == 0:
            return reduce(DataFrame.unionAll, added).groupBy("conv_id", "depth").agg(*(F.sum(c).alias(c) for c in sums))


def prefix_trie(conversations: DataFrame, base_of: Column, head: Column, most: int, seed: int = 1) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``base_of`` and ``head`` are expressions of conv_id: the conversation whose first ``head`` turns (0 to ``most``)
    replace the own ones. saved_tokens sums (n_convs - 1) * code points of the last text over a subtree.
    """
    bounded_batches(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"), 256)
    ref = lambda k: F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")
    turns = stored(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), ref(0).alias("r0"), ref(1).alias("r1"), F.length(text).cast("long").alias("chars"),
        "turn", role.alias("role")), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "r0", "r1"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "r0", "r1", "chars")
    while True:
        rng = random.Random(seed)
        bases = [rng.randrange(1 << 20, p - 1) for p in PRIMES]
        scan = _continued(stored(_scan(ordered, bases), "prefixes"), bases)
        members, ends = _members(scan, bases, base_of, head, most)
        same = ["p0", "p1", "r0", "r1"]
        nodes = stored(members.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
            F.min("p0").alias("p0"), F.min("p1").alias("p1"),
            F.greatest(*((F.min(c) != F.max(c)).cast("int") for c in same)).alias("mixed")), "nodes")
        if nodes.where("mixed > 0").limit(1).count() == 0:
            break
        seed += 1
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    tree = (nodes.join(children, KEY, "left").join(parents, ["depth", "p0", "p1"], "left").join(_end_hashes(ends), KEY, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                    F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
                    F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("chars")).otherwise(zero).alias("saved"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
    tree = stored(tree, "tree")
    below = _subtree_sums(tree, ["leaf", "saved"]).select("conv_id", "depth", F.col("leaf").alias("more_leaf"), F.col("saved").alias("more_saved"))
    return tree.join(below, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("more_leaf", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), "ends_sha256")
