"""Alignment of two tokenizers' tokens on the same bytes, with an identity map as the fast path.

Both tokenizations of a text are cut where tokens of both end; every A-B pair of tokens whose byte
ranges overlap is a link. ``Aligner.same`` maps each A id to the B id of the same bytes. Links of
that kind come from exact one-to-one groups and are counted, by documents, in a vector as long as
A's vocabulary; only the other, irregular pairs are exploded and shuffled. A pair's count is the
number of documents that hold it linked.

Texts are cut before a space or line feed that follows a letter or mark: no piece of either
vocabulary spans such a place (checked when the vocabularies are read), so the tokens of the chunks are
those of the text, and a worker aligns each distinct chunk once, all new chunks of a block at a time.

Null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: zeros
and the empty string. Whole texts are aligned, however long; a worker holds one block of chunks, a
bounded cache and one document's distinct pairs. Repeated ids give repeated rows, null ids pass
through, each row counts as a document of its own; an empty table gives an empty result, and other
columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain, compress, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, lean, small, stored
from .token_counts import SPACES, byte_alphabet

#: distinct chunks of each of the two generations that a worker keeps, and the longest one kept, in characters
CACHE, KEPT = 150_000, 64
#: characters of text per block, and chunks aligned at once
BLOCK, CHUNKS = 1 << 21, 1 << 18
#: an A and a B id as one int: a * SHIFT + b
SHIFT = 1 << 15

Chunk = tuple[int, int, int, str, bytes]


class Aligner:
    """Both tokenizers, their tokens' bytes, and the aligned chunks a worker keeps."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocab = {i: t for t, i in spec["model"]["vocab"].items()}
        self.a_bytes = [b"" if i in special or i not in vocab else bytes(alphabet[ch] for ch in vocab[i]) for i in range(max([*vocab, *special]) + 1)]
        b = self.b
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if len(pieces) > SHIFT or len(self.a_bytes) * SHIFT >= 1 << 31:
            raise ValueError("vocabularies too large for pairs of 31 bits")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # pieces are preferred to single bytes of the byte fallback
        by_bytes = {x: i for i, x in enumerate(self.b_bytes) if b.is_byte(i)} | {x: i for i, x in enumerate(self.b_bytes) if x and not b.is_byte(i)}
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.dummy = b.piece_to_id("▁")
        texts = [x.decode(errors="ignore") for i, x in enumerate(self.b_bytes) if not b.is_byte(i)]
        if any(re.search(f"[^{SPACES}] ", t) for t in texts):
            raise ValueError("a piece spans the place before a space")
        cuts = " " + ("" if any("\n" in t[1:] or t.startswith("\n") and len(t) > 1 for t in texts) else "\n")
        other = f"(?:(?![{cuts}])[{SPACES}])[{SPACES}]*"
        self.split = re.compile(f"[{SPACES}]*[^{SPACES}]+(?:{other}[^{SPACES}]+)*(?:{other}\\Z)?|[{SPACES}]+")
        self.cache: dict[str, Chunk | None] = {}
        self.older: dict[str, Chunk | None] = {}

    def _tokens(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # B puts a space before each text: a chunk's own first one is taken off, any other's first token
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for k in [k for k, c in enumerate(chunks) if c[0] != " " or c == " "]:
            if chunks[k] == " ":
                b[k] = [self.dummy]
            elif b[k][:1] == [self.dummy]:
                b[k] = b[k][1:]
        return a, b

    def _whole(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether both sides of each chunk give back its bytes."""
        data = [c.encode() for c in chunks]
        ok = np.ones(len(chunks), bool)
        for tokens, table, length in ((a, self.a_bytes, self.a_len), (b, self.b_bytes, self.b_len)):
            flat = list(chain.from_iterable(tokens))
            end = np.concatenate(([0], np.cumsum(length[flat])))[np.concatenate(([0], np.cumsum([len(t) for t in tokens])))]
            if b"".join(map(table.__getitem__, flat)) != b"".join(data) or (np.diff(end) != [len(x) for x in data]).any():
                ok &= [b"".join(map(table.__getitem__, t)) == x for t, x in zip(tokens, data, strict=True)]
        return ok.tolist()

    def align(self, chunks: list[str]) -> list[Chunk | None]:
        """(A tokens, B tokens, groups, groups as text, links as 32-bit pairs) of each chunk; None where
        the tokens of one side do not give back its bytes."""
        tokens_a, tokens_b = self._tokens(chunks)
        good = self._whole(chunks, tokens_a, tokens_b)
        if not any(good):
            return [None] * len(chunks)
        kept_a, kept_b = (list(compress(t, good)) for t in (tokens_a, tokens_b))
        na, nb = (np.fromiter(map(len, t), np.int64, len(t)) for t in (kept_a, kept_b))
        a, b = (np.array(list(chain.from_iterable(t)), np.int64) for t in (kept_a, kept_b))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_start, b_start = a_end - self.a_len[a], b_end - self.b_len[b]
        # B tokens that overlap each A token: those that end after its start and start before its end
        lo = np.searchsorted(b_end, a_start, side="right")
        n = np.searchsorted(b_start, a_end, side="left") - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        links = (np.repeat(a, n) * SHIFT + b[at]).astype("<i4")
        link_end = np.cumsum(n)[np.cumsum(na) - 1]
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_last, b_last = (np.searchsorted(e, cuts, side="right") for e in (a_end, b_end))
        group_end = np.searchsorted(cuts, a_end[np.cumsum(na) - 1], side="right")
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for p, q in zip(a_last.tolist(), b_last.tolist(), strict=True):
            groups.append(f"{text_a[i]}|{text_b[j]}" if p - i == 1 == q - j else f"{','.join(text_a[i:p])}|{','.join(text_b[j:q])}")
            i, j = p, q
        found, g0, l0, data = [], 0, 0, links.tobytes()
        for x, y, g1, l1 in zip(na.tolist(), nb.tolist(), group_end.tolist(), (4 * link_end).tolist(), strict=True):
            found.append((x, y, g1 - g0, ";".join(groups[g0:g1]), data[l0:l1]))
            g0, l0 = g1, l1
        if len(found) == len(chunks):
            return found
        left = iter(found)
        return [next(left) if ok else None for ok in good]

    def lookup(self, chunks: list[str]) -> list[Chunk | None]:
        """Alignments of distinct chunks."""
        if len(self.cache) > CACHE:  # what the last generation did not use is forgotten
            self.cache, self.older = {}, self.cache
        out = list(map(self.cache.get, chunks, repeat(0)))
        at = [k for k, x in enumerate(out) if x == 0]
        for k in at:
            out[k] = self.older.get(chunks[k], 0)
        new = [k for k in at if out[k] == 0]
        for k, x in zip(new, self.align([chunks[k] for k in new]) if new else [], strict=True):
            out[k] = x
        self.cache.update((chunks[k], out[k]) for k in at if len(chunks[k]) <= KEPT)
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class _Doc:
    """What is known of a document: token, group and link counts, the running hash, distinct pairs and their numbers."""

    def __init__(self):
        self.ok, self.n, self.hash, self.first = True, [0, 0, 0, 0], hashlib.sha256(), True
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _add(al: Aligner, docs: list[tuple[_Doc, list[str]]]) -> None:
    """Adds the chunks of each document to it."""
    distinct = list(dict.fromkeys(chain.from_iterable(c for _, c in docs)))
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    parts = al.lookup(distinct)
    bad = np.array([x is None for x in parts], bool)
    parts = [x or (0, 0, 0, "", b"") for x in parts]
    groups = [p[3] for p in parts]
    counts = np.array([(p[0], p[1], p[2], len(p[4]) // 4) for p in parts], np.int64).reshape(-1, 4)
    flat = np.frombuffer(b"".join([p[4] for p in parts]), "<i4").astype(np.int64)
    begin = np.cumsum(counts[:, 3]) - counts[:, 3]
    listed = [list(map(number.__getitem__, chunks)) for _, chunks in docs]
    which = [np.array(x, np.int64) for x in listed]
    index = np.concatenate(which)
    size = counts[index, 3]
    end = np.cumsum(size)
    at = np.repeat(begin[index] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
    owner = np.repeat(np.repeat(np.arange(len(docs)), [len(w) for w in which]), size)
    keys, times = np.unique(owner << 31 | flat[at], return_counts=True)
    edge = np.searchsorted(keys, np.arange(len(docs) + 1) << 31)
    for k, (doc, chunks) in enumerate(docs):
        if not chunks:
            continue
        doc.ok &= not bad[which[k]].any()
        if not doc.ok:
            continue
        doc.n = [x + int(y) for x, y in zip(doc.n, counts[which[k]].sum(axis=0), strict=True)]
        doc.hash.update(("" if doc.first else ";").encode() + ";".join(map(groups.__getitem__, listed[k])).encode())
        doc.first = False
        pairs, n = keys[edge[k]:edge[k + 1]] & ((1 << 31) - 1), times[edge[k]:edge[k + 1]]
        if len(doc.pairs):
            pairs, back = np.unique(np.concatenate((doc.pairs, pairs)), return_inverse=True)
            n = np.bincount(back, np.concatenate((doc.times, n))).astype(np.int64)
        doc.pairs, doc.times = pairs, n


def _documents(al: Aligner, texts: list[str]) -> list[_Doc]:
    docs, waiting, size = [_Doc() for _ in texts], [], 0
    for doc, text in zip(docs, texts, strict=True):
        if not text:
            continue
        if len(text) > BLOCK:
            found = al.split.finditer(" " + text)
            while chunks := [m.group() for m in islice(found, CHUNKS)]:
                _add(al, [(doc, chunks)])
            continue
        waiting.append((doc, al.split.findall(" " + text)))
        size += len(text)
        if size >= BLOCK:
            _add(al, waiting)
            waiting, size = [], 0
    if waiting:
        _add(al, waiting)
    return docs


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's alignment: (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) and its distinct pairs
    with their numbers, the same-bytes ones by A id (``same``, ``same_n``), the others as ``pair``, ``pair_n``."""
    bounded_batches(docs.sparkSession)
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pair", "pair_n"]
    ints = pa.list_(pa.int32())

    def blocks(batches):
        al = aligner(a_path, b_path)
        for batch in batches:
            texts = batch.column(2)
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < BLOCK):
                    size += len(texts[hi].as_buffer() or b"") if texts[hi].is_valid else 0
                    hi += 1
                found = _documents(al, texts.slice(lo, hi - lo).to_pylist())
                lists = [[], [], [], []]
                for d in found:
                    if not d.ok or d.first:
                        d.n, d.pairs, d.times = [0, 0, 0, 0], d.pairs[:0], d.times[:0]
                    a = d.pairs // SHIFT
                    same = al.same[a] == d.pairs % SHIFT
                    for out, x in zip(lists, (a[same], d.times[same], d.pairs[~same], d.times[~same]), strict=True):
                        out.append(x.astype(np.int32))
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)]
                columns += [pa.array([d.n[k] for d in found], pa.int64()) for k in range(4)]
                columns.append(pa.array([d.hash.hexdigest() if d.ok and not d.first else "" for d in found], pa.string()))
                columns += [pa.array(x, ints) for x in lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                lo = hi

    def run(batches):
        gc.disable()  # millions of small tuples without cycles
        try:
            yield from blocks(batches)
        finally:
            gc.enable()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                      "same array<int>, same_n array<int>, pair array<int>, pair_n array<int>")


def same_counts(enc: DataFrame, vocabulary: int) -> DataFrame:
    """(a, n): documents that hold A id ``a`` linked to its same-bytes B id; a vector of ``vocabulary`` counts per task."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["a", "n"])

    return enc.select("same").mapInArrow(lean(run), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id),
    count_sum (counts summed over links), groups_sha256. ``pairs``: a, b, n (documents that hold the pair linked)
    and best, for every linked pair of the corpus.
    """
    spark = docs.sparkSession
    enc = stored(encoded(docs, a_path, b_path, id_col, text_col), "aligned")
    al = aligner(a_path, b_path)
    vocabulary = len(al.a_bytes)
    same = stored(same_counts(enc, vocabulary), "same-counts")
    pair = stored(enc.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a_id: Column = F.floor(F.col("pair") / SHIFT).cast("long")
    most = same.unionAll(pair.select(a_id.alias("a"), "n")).groupBy("a").agg(F.max("n").alias("most"))
    # at most one row for each A id, whatever the corpus
    vector, top = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
    for r in same.collect():
        vector[r.a] = r.n
    for r in most.collect():
        top[r.a] = r.most
    best = vector == top
    limits = spark.createDataFrame([(int(a), int(top[a])) for a in np.flatnonzero(top)], "a long, most long")
    irregular = pair.withColumn("a", a_id).join(F.broadcast(limits), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))
    irregular = stored(irregular, "pair-best")

    names = [*enc.columns[:7], "best", "total"]

    def regular(batches):
        for b in batches:
            ids, n = (b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (7, 8))
            length = np.diff(b.column(7).offsets.to_numpy())
            owner = np.repeat(np.arange(len(length)), length)
            # sums of whole numbers below 2 ** 53 are exact
            sums = [pa.array(np.bincount(owner, x, len(length)).astype(np.int64), pa.int64()) for x in (n * best[ids], n * vector[ids])]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(7)), *sums], names=names)

    kind = enc.schema["doc_id"].dataType.simpleString()
    fast = enc.mapInArrow(lean(regular), f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long")
    links = enc.select("row", F.explode(F.arrays_zip("pair", "pair_n")).alias("x")).select("row", "x.pair", "x.pair_n")
    slow = (links.join(small(irregular.select("pair", "n", "best")), "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("pair_n")).otherwise(0)).alias("more_best"),
                 F.sum(F.col("pair_n") * F.col("n")).alias("more_total")))
    zero = F.lit(0).cast("long")
    documents = fast.join(slow, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("total") + F.coalesce("more_total", zero)).alias("count_sum"), "groups_sha256")
    mapped = spark.createDataFrame([(int(a), int(al.same[a]), int(vector[a]), bool(best[a])) for a in np.flatnonzero(vector)],
                                   "a long, b long, n long, best boolean")
    pairs = irregular.select("a", (F.col("pair") % SHIFT).cast("long").alias("b"), "n", "best").unionAll(mapped)
    return documents, pairs
