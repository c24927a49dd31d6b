"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the lower-cased text. Each
character of a script written without spaces (Han, kana, Thai, Lao, Khmer, Burmese, Tibetan and others) is a
word of its own, and ideographic and full-width punctuation separates words.
A first pass counts in how many documents each n-gram of the test items occurs. Of every ``spread``
consecutive n-grams of an item the rarest is a seed, and so is each that occurs in at most a share
``rare`` or a number ``few`` of the documents; common n-grams seed nothing unless an item has no others.
A second pass finds the seeds in every whole text. Hits of an item on near diagonals open a window
of the text. If enough of the item's words occur in the window at all, both are aligned locally by
Smith-Waterman over words; the best score against the item's score with itself is the similarity,
which edits, insertions and deletions lower but do not break. A second alignment, in which each error
costs two matched words, finds the best part of the item: an item is also found if its matched words less two
for every error are ``part_words`` or more (unspaced characters: halves), whatever share of the item they are, so that long passages are
found by their parts.

Both passes are scans: neither texts nor hits are shuffled. Test items go to the tasks in blocks of
at most ``block_words`` words, each block with passes of its own, so their number is not bounded.

Items shorter than ``min_words`` words (a word of one unspaced character counts as half) are too short to be
told from chance when edited: they are found by exact copies of all their words in order, at any place, also
if they are a single word or a common phrase.

Null and empty texts hold nothing. Items that are null or without words are matched nowhere. Ties between windows go to the first. Repeated documents
and items give repeated rows; null ids pass through; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import wordhash as wh
from .shared import bounded_batches, lean, row_blocks, text_bytes

SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = SEPARATOR[128:] = False
MATCH, MISMATCH, GAP = 2, 1, 1
#: what a mismatch or gap costs in a part of an item: two matched words, so a part holds mostly equal words
PART_ERROR = 4
FILTER_BITS = 22

# Code point ranges of scripts written without spaces, last ones inclusive, and of punctuation
# that separates words besides the ASCII characters.
UNSPACED = [(0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
            (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C), (0x3041, 0x30FA), (0x30FC, 0x312F),
            (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAADF),
            (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]
PUNCTUATION = [(0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0x3036, 0x3037), (0x303D, 0x303F), (0x30FB, 0x30FB),
               (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
#: by code point: 1 a word of its own, 2 a separator
KIND = np.zeros(0x110000, np.uint8)
for _k, _ranges in ((1, UNSPACED), (2, PUNCTUATION)):
    for _lo, _hi in _ranges:
        KIND[_lo:_hi + 1] = _k


@dataclass
class Grams:
    """Sorted distinct n-grams with a bitmap that rules out most others."""

    hashes: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Grams:
        hashes = np.unique(hashes)
        bitmap = np.zeros(1 << FILTER_BITS, bool)
        bitmap[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls(hashes, bitmap)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``grams``, numbers of the n-grams found there)."""
        maybe = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.hashes, grams[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == grams[maybe]
        return maybe[hit], at[hit]


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``wordhash.word_ranges``, with characters of unspaced scripts as words and their punctuation between words."""
    lead = np.flatnonzero(data >= 0xE0)  # all of them have three bytes of UTF-8 or four
    if not len(lead):
        return wh.word_ranges(data, offsets, SEPARATOR)
    low = lambda k, at: data[at + k].astype(np.int64) & 0x3F
    code = ((data[lead].astype(np.int64) & 0xF) << 12) | (low(1, lead) << 6) | low(2, lead)
    four = data[lead] >= 0xF0
    code[four] = ((data[lead[four]].astype(np.int64) & 7) << 18) | (low(1, lead[four]) << 12) | (low(2, lead[four]) << 6) | low(3, lead[four])
    kind, width = KIND[code], 3 + four
    if not kind.any():
        return wh.word_ranges(data, offsets, SEPARATOR)
    gap, gap_width = lead[kind == 2], width[kind == 2]
    plain = data.copy()
    for k in range(4):
        plain[gap[gap_width > k] + k] = 32
    own = lead[kind == 1]
    starts, ends, _ = wh.word_ranges(plain, np.union1d(offsets, np.concatenate((own, own + width[kind == 1]))), SEPARATOR)
    return starts, ends, np.searchsorted(starts, offsets)


def word_weight(data: np.ndarray, starts: np.ndarray) -> float:
    """Number of the words that begin at ``starts``, those of one unspaced character as a half."""
    text = data.tobytes()
    halves = sum(KIND[ord(text[a:a + (4 if text[a] >= 0xF0 else 3)].decode())] == 1 for a in starts.tolist() if text[a] >= 0xE0)
    return len(starts) - halves / 2


def _read(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words, first word of each text, n-grams, first n-gram of each text) for blocks of rows."""
    data, off = text_bytes(col)
    for lo, hi in row_blocks(off, 1 << 20):
        part, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        starts, ends, first = word_ranges(part, o)
        words = wh.hash_ranges(part, starts, ends)
        grams, at = wh.gram_hashes(words, first, n)
        yield lo, words, first, grams, at


@dataclass
class Items:
    """A block of test items: ids, word hashes, how many words count as one, and the n-grams with the items and places they stand at."""

    ids: list
    words: list[np.ndarray]
    per: list[float]
    grams: Grams
    number: np.ndarray
    item: np.ndarray
    place: np.ndarray


def _items(rows: list[tuple], n: int) -> Items:
    ids, words, per, grams, item, place = [], [], [], [], [], []
    for key, text_words, text_per in rows:
        g, _ = wh.gram_hashes(text_words, np.array([0, len(text_words)]), n)
        item.append(np.full(len(g), len(ids)))
        place.append(np.arange(len(g)))
        grams.append(g)
        ids.append(key)
        words.append(text_words)
        per.append(text_per)
    flat = np.concatenate(grams)
    held = Grams.of(flat)
    return Items(ids, words, per, held, np.searchsorted(held.hashes, flat), np.concatenate(item), np.concatenate(place))


@dataclass
class Short:
    """A block of test items that are matched exactly: ids, and by number of words their hashes and the items of each."""

    ids: list
    whole: dict[int, tuple[Grams, list[list[int]]]]


def _short(rows: list[tuple]) -> Short:
    by: dict[int, dict[int, list[int]]] = {}
    for k, (_, words, _) in enumerate(rows):
        (g,), _ = wh.gram_hashes(words, np.array([0, len(words)]), len(words))
        by.setdefault(len(words), {}).setdefault(int(g), []).append(k)
    whole = {}
    for length, held in by.items():
        grams = Grams.of(np.array(list(held), np.uint64))
        whole[length] = grams, [held[int(g)] for g in grams.hashes]
    return Short([key for key, _, _ in rows], whole)


def _item_blocks(benchmark: DataFrame, n: int, min_words: int, block_words: int) -> Iterator[Items | Short]:
    block, size = {True: [], False: []}, {True: 0, False: 0}
    make = {True: _short, False: lambda rows: _items(rows, n)}
    for row in benchmark.toLocalIterator():
        data, off = text_bytes(pa.array([row["text"]], pa.large_string()))
        starts, ends, _ = word_ranges(data, off)
        if not len(starts):
            continue
        words = wh.hash_ranges(data, starts, ends)
        weight = word_weight(data, starts)
        short = len(words) < n or weight < min_words
        if block[short] and size[short] + len(words) > block_words:
            yield make[short](block[short])
            block[short], size[short] = [], 0
        block[short].append((row["item_id"], words, len(words) / weight))
        size[short] += len(words)
    for short, rows in block.items():
        if rows:
            yield make[short](rows)


def document_counts(texts: DataFrame, grams: Grams, n: int) -> tuple[np.ndarray, int]:
    """(documents that hold each n-gram, documents); one row per n-gram and task is shuffled at most."""

    def count(batches):
        total, docs = np.zeros(len(grams.hashes), np.int64), 0
        for b in batches:
            docs += b.num_rows
            for _, _, _, found, at in _read(b.column(0), n):
                place, number = grams.find(found)
                doc = np.searchsorted(at, place, side="right") - 1
                once = np.unique(doc * len(grams.hashes) + number)
                total += np.bincount(once % len(grams.hashes), minlength=len(grams.hashes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], names=["number", "n"])

    rows = texts.select("text").mapInArrow(lean(count), "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(grams.hashes), np.int64)
    real = rows["number"] >= 0
    out[rows["number"][real].to_numpy()] = rows["n"][real].to_numpy()
    return out, int(rows["n"][~real].sum())


def seeds(items: Items, counts: np.ndarray, docs: int, spread: int, rare: float, few: int) -> Items:
    """The items with only their seeds kept as n-grams."""
    own = counts[items.number]
    keep = own <= max(few, rare * docs)
    first = np.flatnonzero(np.concatenate(([True], items.item[1:] != items.item[:-1])))
    for lo, hi in zip(first, np.append(first[1:], len(own)), strict=True):
        part = own[lo:hi]
        width = min(spread, len(part))
        rarest = np.lib.stride_tricks.sliding_window_view(part, width).argmin(axis=1) + np.arange(len(part) - width + 1)
        keep[lo + rarest] = True
    held = Grams.of(items.grams.hashes[np.unique(items.number[keep])])
    number = np.searchsorted(held.hashes, items.grams.hashes[items.number[keep]])
    order = np.argsort(number, kind="stable")
    return Items(items.ids, items.words, items.per, held, number[order], items.item[keep][order], items.place[keep][order])


def _align(item: np.ndarray, text: np.ndarray, mismatch: int, gap: int) -> tuple[int, int, int]:
    """(best local score, places in ``text`` and in ``item`` after its last words), with linear gaps."""
    slope = gap * np.arange(len(text) + 1)
    prev, best, end, last = np.zeros(len(text) + 1, np.int64), 0, 0, 0
    for k, w in enumerate(item):
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = np.maximum(prev[:-1] + np.where(text == w, MATCH, -mismatch), prev[1:] - gap)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + slope) - slope, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, end, last = int(row[top]), top, k + 1
        prev = row
    return best, end, last


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, place in ``text`` after its last word), with linear gaps."""
    return _align(item, text, MISMATCH, GAP)[:2]


def held_part(item: np.ndarray, text: np.ndarray) -> tuple[int, float, int]:
    """(score, share, place in ``text`` after its last word) of the best part of ``item`` by ``PART_ERROR``; the
    share is the score against that of the aligned words of the item with themselves."""
    score, end, last = _align(item, text, PART_ERROR, PART_ERROR)
    if not score:
        return 0, 0.0, 0
    # the same alignment from its end: no alignment as good ends earlier in the item, or there earlier in the text
    _, _, length = _align(item[:last][::-1], text[:end][::-1], PART_ERROR, PART_ERROR)
    return score, score / (MATCH * length), end


def _windows(place: np.ndarray, length: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, hits): word ranges of a text around runs of near places at which the item would begin."""
    place = np.sort(place)
    pad = length // 4 + 2
    cut = np.flatnonzero(np.diff(place) > length)
    for a, b in zip(np.append(0, cut + 1), np.append(cut, len(place) - 1), strict=True):
        yield max(0, int(place[a]) - pad), min(size, int(place[b]) + length + pad), int(b - a + 1)


def find_items(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, spread: int = 4, rare: float = 1e-3, few: int = 100,
               min_words: int = 6, part_words: int = 13, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, score, seeds, first_word, last_word, part_score, part_similarity) of every
    document and test item whose best alignment has a similarity of ``threshold`` or more, or whose best part has
    ``part_words`` matched words or more, less two for every error. ``part_score`` is twice those words, ``part_similarity``
    its share of the score of the part's words with themselves. Seeds and words, from 0, are of the window of the best
    alignment, or of the best part if only the part suffices."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.lower(item_text_col).alias("text"))
    doc_kind = texts.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType
    arrow_type = to_arrow_type(item_type)
    schema = (f"doc_id {doc_kind}, item_id {item_type.simpleString()}, similarity double, score long, seeds long, "
              "first_word long, last_word long, part_score long, part_similarity double")

    def batch(block: Items | Short, keys, found: list[tuple]) -> pa.RecordBatch:
        row, item, sim, score, hits, a, z, part, share = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(row)), pa.array([block.ids[i] for i in item], arrow_type), pa.array(sim, pa.float64()),
             *(pa.array(v, pa.int64()) for v in (score, hits, a, z, part)), pa.array(share, pa.float64())],
            names=["doc_id", "item_id", "similarity", "score", "seeds", "first_word", "last_word", "part_score", "part_similarity"])

    def exact(block: Short):
        def run(batches):
            for b in batches:
                found = []
                for lo, words, first, _, _ in _read(b.column(1), 1):
                    for length, (held, copies) in block.whole.items():
                        grams, at = wh.gram_hashes(words, first, length)
                        place, number = held.find(grams)
                        doc = np.searchsorted(at, place, side="right") - 1
                        pair, begin, hits = np.unique(doc * len(copies) + number, return_index=True, return_counts=True)
                        for p, k, c in zip(pair.tolist(), begin.tolist(), hits.tolist(), strict=True):
                            d, a = int(doc[k]), int(place[k] - at[doc[k]])
                            found += [(lo + d, i, 1.0, MATCH * length, c, a, a + length - 1, MATCH * length, 1.0) for i in copies[p % len(copies)]]
                if found:
                    yield batch(block, b.column(0), found)

        return texts.mapInArrow(lean(run), schema)

    def aligned(block: Items):
        starts = np.searchsorted(block.number, np.arange(len(block.grams.hashes) + 1))

        def matches(words, grams) -> Iterator[tuple]:
            place, number = block.grams.find(grams)
            if not len(place):
                return
            copies = starts[number + 1] - starts[number]
            at = np.repeat(starts[number] - np.concatenate(([0], np.cumsum(copies)[:-1])), copies) + np.arange(copies.sum())
            item, begin = block.item[at], np.repeat(place, copies) - block.place[at]
            order = np.argsort(item, kind="stable")
            item, begin = item[order], begin[order]
            cuts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(item)), strict=True):
                own = block.words[item[lo]]
                need = part_words * block.per[item[lo]]
                best, part = None, (0, 0.0)
                for a, b, hits in _windows(begin[lo:hi], len(own), len(words)):
                    text = words[a:b]
                    if np.isin(own, text).sum() < min(threshold * len(own), need):  # each word that is nowhere costs a match
                        continue
                    score, end = smith_waterman(own, text)
                    if best is None or score > best[0]:
                        best = score, hits, a, a + end - 1
                    own_score, share, end = held_part(own, text)
                    if own_score > part[0]:
                        part = own_score, share, hits, a, a + end - 1
                if best and (best[0] >= threshold * MATCH * len(own) or part[0] >= MATCH * need):
                    where = best[1:] if best[0] >= threshold * MATCH * len(own) else part[2:]
                    yield int(item[lo]), best[0] / (MATCH * len(own)), best[0], *where, *part[:2]

        def run(batches):
            for b in batches:
                keys, found = b.column(0), []
                for lo, words, first, grams, at in _read(b.column(1), n):
                    # only texts with a seed are looked at one by one
                    place, _ = block.grams.find(grams)
                    for d in np.unique(np.searchsorted(at, place, side="right") - 1):
                        own = words[first[d]:first[d + 1]]
                        if len(own) >= n:
                            found += [(lo + int(d), *m) for m in matches(own, grams[at[d]:at[d + 1]])]
                if found:
                    yield batch(block, keys, found)

        return texts.mapInArrow(lean(run), schema)

    parts = []
    for block in _item_blocks(items, n, min_words, block_words):
        if isinstance(block, Short):
            parts.append(exact(block))
            continue
        counts, total = document_counts(texts, block.grams, n)
        parts.append(aligned(seeds(block, counts, total, spread, rare, few)))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)
