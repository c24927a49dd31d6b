"""Language identification: script ranges, then Viterbi over per-word scores with a switching penalty.

A model holds, for every learned language, smoothed log-probabilities of hashed character trigrams
(with word ends) and the scripts that the language is written in. It is learned from all labelled
rows by counts that are summed in each task before the shuffle.

A text is cut into words (runs of letters and marks of one script). A word's script leaves only the
languages that use it; each of those gets the sum of its trigrams' log-probabilities. The Viterbi
path over the words, with a penalty for each change of language, labels spans of mixed text. The
language with the most letters is the text's; the score is its share of all letters of the text.

Null texts and texts without a letter are ``und`` with score 0, as is every text if no language was
learned. Ties go to the first language in alphabetical order. Words of a script that no learned
language uses say nothing about any: their letters are no language's and lower the score, and a text of
such words alone has score 0 under the first language. Whole texts are read, in blocks; rows are independent, so
repeated and null ids pass through; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, lean

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: a language uses a script that holds at least this share of its letters
SCRIPT_SHARE = 0.01
#: characters per block
BLOCK = 1 << 20

# Code point ranges of scripts, last ones inclusive; 0 is any other script.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x6FF), ("Arabic", 0x750, 0x77F), ("Devanagari", 0x900, 0x97F),
    ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF),
    ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF),
    ("Malayalam", 0xD00, 0xD7F), ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F),
    ("Hiragana", 0x3040, 0x309F), ("Katakana", 0x30A0, 0x30FF), ("Han", 0x3400, 0x4DBF),
    ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = ["Other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 letter, 1 mark, 0 neither; the lower-case code point; the script's number."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        cat = unicodedata.category(chr(c))[0]
        if cat == "L":
            kind[c] = 2
            lower[c] = ord(chr(c).lower()[0])
        elif cat == "M":
            kind[c] = 1
    script = np.zeros(0x110000, np.uint8)
    for name, lo, hi in SCRIPTS:
        script[lo:hi + 1] = SCRIPT_NAMES.index(name)
    return kind, lower, script


@dataclass
class Words:
    """Words of a block of texts: code point ranges, letters, script; ``first``: each text's first word.
    ``gram`` is every word character's trigram bucket and ``at`` each word's first place in it."""

    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    first: np.ndarray
    gram: np.ndarray
    at: np.ndarray


def words_of(texts: list[str]) -> Words:
    kind_of, lower_of, script_of = _tables()
    length = np.array([len(t) for t in texts], np.int64)
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(length + 1, out=offset[1:])  # a line feed ends each text
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    kind = kind_of[code]
    inside = kind > 0
    script = script_of[code]
    # a mark belongs to the script of what it follows; a word starts with a letter
    letter = kind == 2
    begin = letter.copy()
    if len(code) > 1:
        same = inside[:-1] & (~letter[:-1] | (script[1:] == script[:-1]))
        begin[1:] &= ~same
    body = inside.copy()
    if len(code):  # marks before any letter are no word
        group = np.cumsum(begin | ~inside)
        has = np.zeros(int(group[-1]) + 1, bool)
        has[group[begin]] = True
        body &= has[group]
    pos = np.flatnonzero(body)
    word_at = np.flatnonzero(begin[pos])
    start = pos[word_at]
    end = np.append(pos[word_at[1:] - 1], pos[-1:]) + 1 if len(start) else start
    low = lower_of[code[pos]].astype(np.uint64)
    before = np.concatenate((np.zeros(min(1, len(low)), np.uint64), low[:-1]))
    after = np.concatenate((low[1:], np.zeros(min(1, len(low)), np.uint64)))
    before[word_at] = 0
    if len(word_at):
        after[np.append(word_at[1:], len(pos)) - 1] = 0
    gram = (before * np.uint64(0x9E3779B97F4A7C15) + low * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9))
    gram = ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)
    letters = np.add.reduceat(letter[pos].astype(np.int64), word_at) if len(word_at) else np.zeros(0, np.int64)
    return Words(start, end, letters, script[start], np.searchsorted(start, offset), gram.astype(np.int64), word_at)


@dataclass
class Model:
    """``logp`` is (languages, BUCKETS); ``uses`` is (scripts, languages)."""

    langs: list[str]
    logp: np.ndarray
    uses: np.ndarray
    penalty: float

    def word_scores(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.start), len(self.langs)), np.float32)
        if len(w.start):
            for k in range(len(self.langs)):
                out[:, k] = np.add.reduceat(self.logp[k][w.gram], w.at)
            allowed = self.uses[w.script]
            some = allowed.any(axis=1)
            out[~some] = 0
            out[some[:, None] & ~allowed] = -1e6
        return out

    def label(self, w: Words) -> np.ndarray:
        """The language number of each word, by one Viterbi pass over all texts of the block in step."""
        score, count = self.word_scores(w), np.diff(w.first)
        order = np.argsort(-count, kind="stable")
        first, count = w.first[:-1][order], count[order]
        steps = int(count[0]) if len(count) else 0
        active = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")
        left = np.zeros(len(score), np.int16)  # the best language before each word
        switch = np.zeros(score.shape, bool)
        value = np.zeros((len(count), len(self.langs)), np.float64)
        label = np.zeros(len(score), np.int16)
        for t in range(steps):
            k = active[t]
            at, v = first[:k] + t, value[:k]
            if t:
                best = v.argmax(axis=1)
                change = v[np.arange(k), best] - self.penalty
                left[at] = best
                switch[at] = v < change[:, None]
                v = np.maximum(v, change[:, None])
            value[:k] = v + score[at]
        now = value.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            at = first[:k] + t
            cur = now[:k]
            label[at] = cur
            now[:k] = np.where(switch[at, cur], left[at], cur)
        return label

    def predict(self, texts: list[str], spans: bool) -> list[tuple]:
        """(language, score, spans) of each text; spans are (start, end, language) in code points."""
        if not self.langs:
            return [("und", 0.0, [])] * len(texts)
        w = words_of(texts)
        label = self.label(w)
        n, k = len(texts), len(self.langs)
        doc = np.repeat(np.arange(n), np.diff(w.first))
        total = np.bincount(doc, weights=w.letters, minlength=n)
        known = self.uses[w.script].any(axis=1)  # other words are no language's letters
        by = np.bincount(doc * k + label, weights=w.letters * known, minlength=n * k).reshape(n, k)
        top = by.argmax(axis=1)
        out = [(self.langs[top[i]], float(by[i, top[i]] / total[i]), []) if total[i] else ("und", 0.0, []) for i in range(n)]
        if spans and len(label):
            offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
            new = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]))))
            last = np.append(new[1:], len(label)) - 1
            for a, b in zip(new, last, strict=True):
                base = offset[doc[a]]
                out[doc[a]][2].append((int(w.start[a] - base), int(w.end[b] - base), self.langs[label[a]]))
        return out


def _blocks(texts: list[str]):
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (size == 0 or size + len(texts[hi]) <= BLOCK):
            size += len(texts[hi]) + 1
            hi += 1
        yield lo, hi
        lo = hi


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", penalty: float = 12.0) -> Model:
    """A model from all rows with a text and a language. What reaches the driver is at most
    languages x (BUCKETS + scripts) counts, whatever the input."""
    bounded_batches(labelled.sparkSession)

    def count(batches):
        grams: dict[str, np.ndarray] = {}
        width = BUCKETS + len(SCRIPT_NAMES)
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for t, lang in zip(texts, langs, strict=True):
                if t and lang is not None:
                    by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                total = grams.setdefault(lang, np.zeros(width, np.int64))
                for lo, hi in _blocks(own):
                    w = words_of(own[lo:hi])
                    total[:BUCKETS] += np.bincount(w.gram, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(w.script, weights=w.letters, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for lang, total in grams.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                                             names=["lang", "slot", "n"])

    rows = (labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
            .mapInArrow(lean(count), "lang string, slot int, n long")
            .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(rows["lang"].unique())
    number = {lang: k for k, lang in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    counts[rows["lang"].map(number).to_numpy(np.int64), rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    uses = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    return Model(langs, logp, uses, penalty)


def identify(docs: DataFrame, model: Model, spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for b in batches:
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for lo, hi in _blocks(texts):
                out += model.predict(texts[lo:hi], spans)
            cols = [b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                cols.append(pa.array([[{"start": s, "end": e, "lang": g} for s, e, g in x[2]] for x in out], span_type))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, lang_pred string, score double"
    return rows.mapInArrow(lean(run), schema + (", spans array<struct<start:bigint,end:bigint,lang:string>>" if spans else ""))


def accepted(docs: DataFrame, model: Model, share: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one language holds at least ``share`` of the
    letters; texts without letters are rejected. Rows do not move between tasks."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts, keep = [t or "" for t in b.column(text_col).to_pylist()], []
            for lo, hi in _blocks(texts):
                keep += [lang != "und" and score >= share for lang, score, _ in model.predict(texts[lo:hi], False)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
