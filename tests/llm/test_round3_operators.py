"""Tokenizer alignment, prefix trie and licence scans against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leasegrid.llm import cross_tokenizer, licenses, prefix_trie, queries
from leasegrid.llm.shared import table

from .test_operators import SF, empty, odd_docs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SHA_EMPTY = hashlib.sha256().hexdigest()


# --------------------------------------------------------------------------- op11
class Brute:
    """Whole texts encoded at once, bytes by the libraries' own tables, overlaps by comparing offsets."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in shown]
        self.byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}

    def spans(self, text):
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        parts = ([bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a],
                 [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b])
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return None
        out = []
        for ids, p in zip((a, b), parts, strict=True):
            at, spans = 0, []
            for i, x in zip(ids, p, strict=True):
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        return out

    def document(self, text):
        spans = self.spans(text)
        if spans is None:
            return 0, 0, 0, [], ""
        a, b = spans
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        last = {c: k for k, c in enumerate(cuts)}
        sides = []
        for side in (a, b):
            parts, k = [[] for _ in cuts], 0
            for i, _, e in side:
                parts[k].append(str(i))
                k += e in last
            sides.append(parts)
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)]
        over = defaultdict(list)  # B tokens by each of their bytes
        for y, u, v in b:
            for byte in range(u, v):
                over[byte].append((u, y))
        links = [(x, y) for x, s, e in a for _, y in sorted({t for byte in range(s, e) for t in over[byte]})]
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def check_alignment(docs, rows):
    brute = Brute()
    found = [(i, *brute.document(t)) for i, t in rows]
    count = Counter(p for f in found for p in set(f[4]))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    want = Counter((i, na, nb, ng, len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), h) for i, na, nb, ng, ls, h in found)
    documents, pairs = cross_tokenizer.align(docs, A, B)
    assert Counter(tuple(r) for r in documents.collect()) == want
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(count)
    assert {(r.a, r.b) for r in pairs.collect() if r.best} == {p for p, n in count.items() if n == top[p[0]]}


def test_alignment_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    check_alignment(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_of_odd_texts(spark):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "x2", "'s", "!", "};\r\n", "é", "é", "漢字", "　", "\xa0", "\x1c", "\x00", "<|endoftext|>",
            "<s>", "<0x0A>", "▁", "ing", "A", "..", "--", "😀", "​", "﻿", "\x85"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for k in range(400)]
    rows += [(None, None), (None, " "), (3, "the the the"), (3, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("row"), F.lit(2).alias("pair"), F.lit("x").alias("n"))
    check_alignment(docs, rows)


def test_alignment_of_long_and_no_texts(spark, monkeypatch):
    docs, rows = odd_docs(spark)
    got = {(r.doc_id, r.n_a, r.n_b) for r in cross_tokenizer.align(docs, A, B)[0].collect()}
    brute = Brute()
    spans = [(i, brute.spans(t)) for i, t in rows]
    assert got == {(i, len(s[0]), len(s[1])) if s else (i, 0, 0) for i, s in spans}
    assert cross_tokenizer.align(empty(spark), A, B)[0].collect() == []
    # long texts go through in parts
    al = cross_tokenizer.aligner(A, B)
    text = table(spark, SF, "documents").orderBy(F.length("text").desc()).first().text
    whole = cross_tokenizer._documents(al, [text])[0]
    monkeypatch.setattr(cross_tokenizer, "BLOCK", 100)
    monkeypatch.setattr(cross_tokenizer, "CHUNKS", 50)
    parts = cross_tokenizer._documents(al, [text])[0]
    assert (whole.n, whole.hash.hexdigest(), whole.pairs.tolist(), whole.times.tolist()) == (
        parts.n, parts.hash.hexdigest(), parts.pairs.tolist(), parts.times.tolist())


# --------------------------------------------------------------------------- op12
def brute_trie(rows):
    """The contract on python lists: (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v, key=lambda y: y[:3])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        seq = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids[node]
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()}


def trie(df):
    base, head = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return [tuple(r) for r in prefix_trie.prefix_trie(df, base, head, most=5).collect()]


def check_trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *(F.lit(9).alias(c) for c in ("depth", "k0", "part", "pos", "base", "leaf"))).repartition(5)
    got = trie(df)
    assert len(got) == len(set(got))
    assert set(got) == brute_trie(rows)


def test_trie_of_the_given_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations", "conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in queries.op12_monoid_prefix_trie(spark, SF).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_trie(rows)


def test_trie_of_few_texts_shares_deep_prefixes(spark):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 330), *range(-250, -200), 10**12 + 7]:
        if c % 100 == 0 and rng.random() < 0.5 and c > 0:
            continue  # no base
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    check_trie(spark, rows)


def test_trie_of_one_long_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    rows = [(200, t, "user", rng.choice("ab")) for t in range(3000)] + [(201, t, "user", "a") for t in range(4)]
    rows += [(200 + k, t, "user", "ab"[t % 2]) for k in range(2, 9) for t in range(40)]
    check_trie(spark, rows)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, "user", "x"), (1, 0, "user", "x"), (1, 2, None, None), (1, 2, None, None), (None, 1, "user", "x"), (2, 1, "system", "y" * 50_000),
            (100, 1, "user", ""), (103, 5, "b", "t"), (103, 5, "a", "t"), (104, 1, "user", "x")]
    check_trie(spark, rows)
    assert trie(empty(spark, "conv_id long, turn long, role string, text string")) == []


def test_ends_of_large_nodes_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    rows = [(c, 0, "user", "hello" if c % 7 else "other") for c in range(1, 600)] + [(c, 0, "user", f"own {c}") for c in range(1000, 1040)]
    check_trie(spark, rows)


# --------------------------------------------------------------------------- op13
def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases_equal_brute_force(spark):
    got = queries.op13_license_expressions(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert any(r.labels for r in got)


def test_base_phrases_in_odd_texts(spark):
    docs, _ = odd_docs(spark)
    more = ["Under THE mit-License, under the (MIT) license", "CC BY-NC 4.0; cc by nc cc by nc", "unter under the mit licenses", "apache license, version 2.0",
            "cc by nc sa", "é cc\x00by\x1cnc É", "under the mit license " * 5000]
    docs = docs.select("doc_id", "text", "score").unionAll(spark.createDataFrame([(100 + k, t, 1) for k, t in enumerate(more)], "doc_id long, text string, score int"))
    got = [tuple(r)[:6] for r in licenses.scan_licenses(docs).collect()]
    assert Counter(got) == Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
    assert licenses.scan_licenses(empty(spark)).collect() == []


def test_notices_tags_and_expressions(spark):
    texts = {
        "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nx": ("apache-2,bsd-3-clause,mit", "mit apache-2.0 or bsd-3-clause and", True),
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT": (
            "gpl-2 with classpath-exception-2.0,mit", "gpl-2.0-only classpath-exception-2.0 with mit or", True),
        "license: MIT AND GPL-3.0+.": ("gpl-3,mit", "mit gpl-3.0+ and", False),
        "License: MIT and so on": ("mit", "mit", True),
        "License: ((MIT OR ISC": ("isc,mit", "mit isc or", True),
        "License: see the file": ("", "", None),
        "sublicense: mit": ("", "", None),
        "licence: LicenseRef-own OR (MIT AND": ("licenseref-own,mit", "licenseref-own mit or", True),
        "This is licensed under CC BY-SA": ("cc-by-sa", "", None),
        "licensed under CC BY-NC 4.0": ("cc-by-nc", "", None),
        "GNU General Public License, version 3.": ("gpl-3", "", None),
        "nothing here": ("", "", None),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.expressions, r.permissive) for r in licenses.scan_licenses(docs).collect()}
    assert got == dict(enumerate(texts.values()))


def test_deep_expressions_are_read_whole():
    deep = "(" * 5000 + "mit" + " or isc)" * 5000
    postfix, labels, free = licenses.parse(deep, 0)
    assert postfix.split().count("isc") == 5000 and labels == {"mit", "isc"} and free
