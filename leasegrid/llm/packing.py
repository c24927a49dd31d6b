"""Packing token sequences by minimum bin slack.

Texts become token ids (one end id each). Every full window of a text is a sequence of its own; the
remainders wait in a bounded pool. A new sequence takes the pool's longest remainder, and a bitset
subset-sum program over the remaining lengths picks the multiset that fills the rest of the window
closest to capacity; counts are backtracked from the kept bitsets. If some slack stays, one
remainder is cut to fill it. What a task has left at its end goes into sequences whose lengths are
powers of two, which need no padding.

Every task packs its own input, so nothing is shuffled and no task holds more than its pool.
Null and empty texts are a single end id. A long text is tokenised and cut whole. Repeated ids are
packed once per row, null ids pass through, other columns are not read, and an empty table gives no
pieces.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, lean, row_blocks
from .token_counts import byte_alphabet

#: distinct words whose ids a worker keeps
CACHE = 120_000
#: bytes of text tokenised at a time
BLOCK = 1 << 20
#: remainders that wait for partners
POOL = 512
#: separators that Arrow takes for white space and the vocabulary does not
_ODD = "[\x1c-\x1f]"
#: a letter and a mark that starts a piece of its own whatever follows
_BREAK = r"([a-z])([!-&(-/:-@\[-`{-~])"
# Words of these characters are their own normal form and lower-case one by one: the vocabulary's
# pattern then splits them as the simpler one below does.
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and no merge spans it, so a text's ids are those of its
    white-space separated words in order. Arrow splits the texts and numbers their distinct words;
    each is encoded once, plain ones piece by piece with the tokenizer's model, others by the whole
    tokenizer, and the ids are gathered by word number. Texts with a special token or an odd separator
    go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "(?i)" + "|".join([_ODD, *specials])
        self.shown = {b: ch for ch, b in byte_alphabet().items()}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.shown)
        ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word without special tokens and with its ASCII letters in lower case."""
        pieces = self.pieces
        if word.isascii():
            if word.isalpha():
                return pieces.get(word) or self._piece(word)
        elif _PLAIN.fullmatch(word) is None:
            return self._whole(word)
        else:
            word = word.lower()
        return b"".join([pieces.get(p) or self._piece(p) for p in _PIECES.findall(word)])

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """``texts`` holds no null."""
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.ascii_lower(pc.if_else(pa.array(odd), "", texts))
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(plain, _BREAK, r"\1 \2"))
        coded = lists.flatten().dictionary_encode()
        ids = []
        for w in coded.dictionary.to_pylist():
            found = self.words.get(w)
            if found is None:
                found = self.words[w] = self._word(w)
            ids.append(found)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        number = coded.indices.to_numpy().astype(np.int64)
        length = size[number]
        end = np.cumsum(length)
        gathered = flat[np.repeat(begin[number] - (end - length), length) + np.arange(end[-1] if len(end) else 0)]
        first = np.concatenate(([0], end))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        data = gathered.tobytes()
        out = [data[4 * a:4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd):
            out[k] = self._whole(texts[int(k)].as_py())
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def closest_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to ``capacity`` as possible.

    Bit s of ``reach`` says that the sum s can be made of the lengths seen so far. Lengths come in
    descending order; the program stops as soon as the capacity itself is reached.
    """
    full = (1 << (capacity + 1)) - 1
    goal = 1 << capacity
    reach, steps = 1, []
    for length in lengths:
        most = min(counts[length], capacity // length)
        part = 1
        while most and not reach & goal:
            take = min(part, most)
            grown = (reach | reach << (length * take)) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            most -= take
            part *= 2
        if reach & goal:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += take
            at -= length * take
    return taken


class Packer:
    """Packs one task's texts; pieces are (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.waiting = 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id, ids: bytes):
        n, cap = len(ids) // 4, self.capacity
        for start in range(0, n - cap + 1, cap):
            yield doc_id, start, ids[4 * start:4 * (start + cap)], n, self._new(), 0
        if n % cap:
            self._wait((doc_id, n - n % cap, ids[4 * (n - n % cap):], n))
        while self.waiting > POOL:
            yield from self._sequence()

    def _wait(self, item: tuple) -> None:
        self.pool[len(item[2]) // 4].append(item)
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        items = self.pool[length]
        item = items.pop()
        if not items:
            del self.pool[length]
        self.waiting -= 1
        return item

    def _sequence(self):
        longest = max(self.pool)
        chosen = [self._take(longest)]
        room = self.capacity - longest
        lengths = sorted((k for k in self.pool if k <= room), reverse=True)
        for length, n in closest_fill(lengths, {k: len(self.pool[k]) for k in lengths}, room).items():
            chosen += [self._take(length) for _ in range(n)]
            room -= length * n
        if room and self.pool:  # cut the shortest remainder that is longer than the slack
            doc_id, start, ids, n = self._take(min(k for k in self.pool if k > room))
            chosen.append((doc_id, start, ids[:4 * room], n))
            self._wait((doc_id, start + room, ids[4 * room:], n))
        yield from self._place(chosen)

    def _place(self, items: list[tuple]):
        sequence, offset = self._new(), 0
        for doc_id, start, ids, n in items:
            yield doc_id, start, ids, n, sequence, offset
            offset += len(ids) // 4

    def finish(self):
        while sum(k * len(v) for k, v in self.pool.items()) >= self.capacity:
            yield from self._sequence()
        rest = [item for k in sorted(self.pool, reverse=True) for item in self.pool[k]]
        self.pool, self.waiting = defaultdict(list), 0
        total = sum(len(item[2]) // 4 for item in rest)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            items = []
            while size:
                doc_id, start, ids, n = rest.pop(0)
                have = len(ids) // 4
                items.append((doc_id, start, ids[:4 * size], n))
                if have > size:
                    rest.insert(0, (doc_id, start + size, ids[4 * size:], n))
                size -= min(size, have)
            yield from self._place(items)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all texts.

    ``ids`` are little-endian unsigned 32-bit values; pieces of a sequence lie at gapless offsets
    from 0 and sum to at most ``capacity``. A sequence id is the task's number in the high bits and
    the sequence's number within the task in the low ones, so a task that runs again gives the same.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoder(vocabulary)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def out(pieces: list[tuple], id_type) -> pa.RecordBatch:
            doc, start, ids, n, seq, off = zip(*pieces, strict=True)
            length = np.array([len(x) // 4 for x in ids], np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array(length), pa.array(ids, pa.binary()),
                pa.array(n, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=names)

        id_type = pa.int64()
        for b in batches:
            id_type = b.column(0).type
            keys, texts = b.column(0).to_pylist(), b.column(1).fill_null("").cast(pa.large_string())
            offsets = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy())))
            for lo, hi in row_blocks(offsets, BLOCK):
                pieces = []
                for key, ids in zip(keys[lo:hi], encode(texts.slice(lo, hi - lo)), strict=True):
                    pieces += packer.add(key, ids + end)
                if pieces:
                    yield out(pieces, id_type)
        if pieces := list(packer.finish()):
            yield out(pieces, id_type)

    return rows.mapInArrow(
        lean(run), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
