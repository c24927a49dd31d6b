"""Token counts of byte-level BPE by rank-synchronous array merging.

Distinct pre-tokens of a block of texts lie as ragged numpy arrays of symbols. Every round finds,
for all of them at once, each sequence's lowest-rank adjacent pair and merges its occurrences from
left to right; a sequence without a known pair is done. The symbols that survive are its tokens.
In long sequences a round also merges every other pair that nothing of lower rank can reach any more
(``_settled``), so that one pre-token of many letters does not take a round for each of its pairs.

Null and empty texts have no bytes and no tokens. Whole texts are counted, however long; a worker
holds one block of texts and a bounded cache of pre-token counts. Rows are independent: repeated
ids give repeated rows, null ids pass through, an empty table gives an empty result, and other
columns are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, lean

# The pre-token pattern of the vocabulary, with its white space spelled out.
SPACES = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACES + r"\p{L}\p{N}]+|["
           + SPACES + r"]+(?![^" + SPACES + r"])|[" + SPACES + r"]+")
#: distinct pre-tokens whose counts a worker keeps
CACHE = 400_000
#: characters of text per block
BLOCK = 1 << 21
#: symbols merged at once
SYMBOLS = 1 << 21
#: symbols to either side of a pair that are looked at to settle it before its turn; more only saves rounds
REACH = 6
#: pre-tokens from this many bytes on are merged with settled pairs; shorter ones need few rounds anyhow
LONG = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, to that byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class RankMerger:
    """Merge table of a byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.start = np.zeros(256, np.int64)
        for ch, byte in byte_alphabet().items():
            self.start[byte] = vocab[ch]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pair = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank, self.made = pair[order], order.astype(np.int64), made[order]
        # pairs may be settled early if every symbol is made by one merge, before it is used
        ranks = np.arange(len(merges))
        left, right = pair // self.size, pair % self.size
        born = np.full(self.size, -1, np.int64)
        np.maximum.at(born, made, ranks)
        self.ordered = bool(len(np.unique(made)) == len(made) and (np.maximum(born[left], born[right]) < ranks).all())
        self.grow_right = self._growth(left, right, born, right) if self.ordered else None
        self.grow_left = self._growth(right, left, born, left) if self.ordered else None
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, int] = {}

    def _growth(self, grown: np.ndarray, taken: np.ndarray, born: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, ranks): for an outer part of a grown symbol and the symbol that it takes next, the lowest such rank.

        ``part`` is each merge's outer part; a symbol's outer parts are found by following it down to bytes.
        The first merges of a growth are left to the pairs' own ranks."""
        keys, ranks = [], []
        rank, outer = np.arange(len(grown)), grown
        while True:
            has = born[outer] >= 0
            if not has.any():
                break
            rank, taken = rank[has], taken[has]
            outer = part[born[outer[has]]]
            keys.append(outer * self.size + taken)
            ranks.append(rank)
        if not keys:
            return np.zeros(1, np.int64) - 1, np.zeros(1, np.int64)
        key, rank = np.concatenate(keys), np.concatenate(ranks)
        order = np.lexsort((rank, key))
        key, rank = key[order], rank[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        return key[first], rank[first]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token, given as UTF-8 bytes."""
        out = np.zeros(len(tokens), np.int64)
        lo, size = 0, np.cumsum([len(t) for t in tokens])
        while lo < len(tokens):
            done = int(size[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, done + SYMBOLS, side="right")))
            out[lo:hi] = self._merge(tokens[lo:hi])
            lo = hi
        return out

    def _settled(self, sym: np.ndarray, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Pairs that are merged in the end whatever happens around them, although lower ranks are still open.

        Before a pair's turn only lower ranks act. If all pairs up to some symbol beside it have no lower rank,
        what can reach it from there is one growing symbol that swallows its neighbours one by one; it stops at
        a symbol that nothing grown so far takes at this rank or a lower one. ``rank`` holds one entry for each symbol's pair
        with the next (none at a sequence's end), ``first`` the sequences' starts.
        """
        n, none = len(sym), len(self.pair)
        start, end = np.zeros(n, bool), np.zeros(n, bool)
        start[first] = True
        end[np.append(first[1:], n) - 1] = True
        safe = rank < none
        taken = []
        for (known, lowest), key in ((self.grow_right, sym[:-1] * self.size + sym[1:]), (self.grow_left, sym[1:] * self.size + sym[:-1])):
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            taken.append(np.append(np.where(known[at] == key, lowest[at], none), none))
        for step, absorb, edge, side in ((-1, taken[0], start, 0), (1, taken[1], end, 1)):
            at = np.flatnonzero(safe)
            own, ok = rank[at], np.zeros(len(at), bool)
            open_ = np.arange(len(at))
            for d in range(REACH):
                here = at[open_] + side + step * d  # the symbol that would have to be swallowed
                beyond = np.clip(here - 1 + side, 0, n - 1)  # its pair with the next symbol outwards
                stop = edge[here] | (absorb[beyond] > own[open_])
                free = edge[here] | (rank[beyond] >= own[open_])
                ok[open_[stop & free]] = True
                open_ = open_[~stop & free]
            safe[at[~ok]] = False
        # a run of equal pairs is settled whole or not at all, as it is merged by twos from its start
        pos = np.flatnonzero((rank[1:] == rank[:-1]) & (rank[1:] < none) & ~start[1:])
        if len(pos):
            member = np.unique(np.concatenate((pos, pos + 1)))
            cut = np.concatenate(([True], (np.diff(member) != 1) | (rank[member[1:]] != rank[member[:-1]])))
            safe[member] = np.logical_and.reduceat(safe[member], np.flatnonzero(cut))[np.cumsum(cut) - 1]
        return safe

    def _merge(self, tokens: list[bytes]) -> np.ndarray:
        length = np.array([len(t) for t in tokens], np.int64)
        result = length.copy()
        sym = self.start[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), length)
        none = len(self.pair)
        while len(sym) > 1:
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.pair, key), none - 1)
            known = (self.pair[at] == key) & (seq[:-1] == seq[1:])
            rank = np.where(known, self.rank[at], none)
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            rank = np.append(rank, none)
            lowest = np.minimum.reduceat(rank, first)
            n = np.diff(np.append(first, len(sym)))
            live = lowest < none
            result[seq[first[~live]]] = n[~live]
            hit = (rank == np.repeat(lowest, n)) & (rank < none)
            if self.ordered and n.max() >= LONG:
                hit |= self._settled(sym, rank, first)
            # occurrences may overlap (a pair of equal symbols): take every second one of a run
            pos = np.flatnonzero(hit)
            if len(pos) > 1:
                new_run = np.concatenate(([True], (np.diff(pos) != 1) | (rank[pos[1:]] != rank[pos[:-1]])))
                run = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            sym[pos] = self.made[at[pos]]
            keep = np.repeat(live, n)
            keep[pos + 1] = False
            sym, seq = sym[keep], seq[keep]
        if len(sym):
            result[seq] = 1
        return result

    def text_counts(self, texts: list[str]) -> list[int]:
        extra = [0] * len(texts)
        parts: list[list[str]] = []
        for k, text in enumerate(texts):
            pieces = [text]
            for s in self.specials:
                if s in text:
                    cut = [p.split(s) for p in pieces]
                    extra[k] += sum(len(c) - 1 for c in cut)
                    pieces = [p for c in cut for p in c]
            parts.append(self.split(text) if len(pieces) == 1 else [t for p in pieces for t in self.split(p)])
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [t for t in set().union(*parts) if t not in self.cache]
        self.cache.update(zip(new, self.counts([t.encode() for t in new]).tolist(), strict=True))
        get = self.cache.__getitem__
        return [sum(map(get, p)) + e for p, e in zip(parts, extra, strict=True)]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``vocabulary`` is the .json file's path on the workers."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        m = merger(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, lo = [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (size == 0 or size + len(texts[hi]) <= BLOCK):
                    size += len(texts[hi])
                    hi += 1
                n += m.text_counts(texts[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return (rows.mapInArrow(lean(count), f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
