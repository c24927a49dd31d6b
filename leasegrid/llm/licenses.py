"""Licence scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser
evaluates the licence expressions that follow the tags.

Phrases are looked for in a text's words (A-Z lower-cased, separators of any kind between them),
tags in the text itself. An expression joins known identifiers by ``and``, ``or`` and ``with`` (in
rising precedence) and parentheses; it ends where nothing can follow or at its line's end, open parentheses are
closed there and a trailing operator is dropped. ``or`` is permissive if one side is, ``and`` if both are;
``with`` puts an exception on one identifier.

Null and empty texts have no words and score 0. Whole texts are scanned, however long. Rows are
independent: repeated rows give repeated results, null ids pass through, an empty table gives an empty
result, and other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, lean

# The base phrases and labels that the query's contract states.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases, in words.
NOTICES = {
    "the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "gnu general public license version 2": "gpl-2",
    "version 2 of the gnu general public license": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "version 3 of the gnu general public license": "gpl-3",
    "gnu lesser general public license version 2": "lgpl-2",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license version 2": "epl-2",
    "boost software license version 1": "bsl-1",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution 4 0": "cc-by",
    "creative commons attribution noncommercial 4 0": "cc-by-nc",
    "creative commons attribution sharealike 4 0": "cc-by-sa",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# Tags that an expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
# Identifiers of expressions, with label and whether they are permissive.
IDENTIFIERS = {
    "mit": ("mit", True), "mit-0": ("mit", True), "isc": ("isc", True), "zlib": ("zlib", True), "0bsd": ("bsd", True),
    "apache-2.0": ("apache-2", True), "bsd-2-clause": ("bsd-2-clause", True), "bsd-3-clause": ("bsd-3-clause", True),
    "bsl-1.0": ("bsl-1", True), "unlicense": ("public-domain", True), "cc0-1.0": ("cc0", True), "cc-by-4.0": ("cc-by", True),
    "cc-by-3.0": ("cc-by", True), "cc-by-sa-4.0": ("cc-by-sa", False), "cc-by-nc-4.0": ("cc-by-nc", False), "cc-by-nd-4.0": ("cc-by-nd", False),
    "cc-by-nc-sa-4.0": ("cc-by-nc-sa", False), "cc-by-nc-nd-4.0": ("cc-by-nc-nd", False),
    "gpl-2.0": ("gpl-2", False), "gpl-2.0-only": ("gpl-2", False), "gpl-2.0-or-later": ("gpl-2", False), "gpl-2.0+": ("gpl-2", False),
    "gpl-3.0": ("gpl-3", False), "gpl-3.0-only": ("gpl-3", False), "gpl-3.0-or-later": ("gpl-3", False), "gpl-3.0+": ("gpl-3", False),
    "lgpl-2.1": ("lgpl-2", False), "lgpl-2.1-only": ("lgpl-2", False), "lgpl-2.1-or-later": ("lgpl-2", False), "lgpl-2.1+": ("lgpl-2", False),
    "lgpl-3.0": ("lgpl-3", False), "lgpl-3.0-only": ("lgpl-3", False), "lgpl-3.0-or-later": ("lgpl-3", False), "lgpl-3.0+": ("lgpl-3", False),
    "agpl-3.0": ("agpl-3", False), "agpl-3.0-only": ("agpl-3", False), "agpl-3.0-or-later": ("agpl-3", False),
    "mpl-2.0": ("mpl-2", False), "epl-2.0": ("epl-2", False),
}
#: how surely one place of each kind shows a licence
SURE = {"base": 0.9, "notice": 0.7, "expression": 0.95}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")


def parse(text: str, at: int) -> tuple[str, set[str], bool] | None:
    """The expression that starts at ``at`` in a lower-cased text: (postfix form, labels, permissive); None if there is none."""
    output: list[str] = []
    operators: list[str] = []
    operand = True  # what may come next
    while m := _TOKEN.match(text, at):
        token = m.group(1)
        if operand and token == "(":
            operators.append(token)
        elif operand:
            name = token.rstrip(".-")  # marks of the sentence around it
            exception = bool(operators) and operators[-1] == "with"
            if not (name.endswith(("-exception", "-note")) or "-exception-" in name) if exception else not (name in IDENTIFIERS or name.startswith("licenseref-")):
                break
            output.append(name)
            operand = False
            if name != token:
                break
        elif token in PRECEDENCE:
            if token == "with" and output[-1] in PRECEDENCE:  # an exception belongs to one identifier
                break
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[token]:
                output.append(operators.pop())
            operators.append(token)
            operand = True
        elif token == ")" and "(" in operators:
            while operators[-1] != "(":
                output.append(operators.pop())
            operators.pop()
        else:
            break
        at = m.end()
    if not output:
        return None
    if operand:  # operators and parentheses without anything after them
        while operators and (operators[-1] == "(" or operand):
            operand &= operators.pop() == "("
    output += [op for op in reversed(operators) if op != "("]
    stack: list[tuple[set[str], bool]] = []
    for token in output:
        if token not in PRECEDENCE:
            label, free = IDENTIFIERS.get(token, (token, False))
            stack.append(({label}, free))
            continue
        (right, q), (left, p) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{min(left)} with {min(right)}"}, p))
        else:
            stack.append((left | right, p or q if token == "or" else p and q))
    labels, free = stack.pop()
    return " ".join(output), labels, free


class Scanner:
    def __init__(self):
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for kind, table in (("notice", NOTICES), ("base", BASE)):
            for phrase, label in table.items():
                self.phrases.add_word(f" {phrase} ", (len(phrase) + 2, kind, label))
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def notices(self, words: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(base, others): (start, end, label) in a text of words with one space before, between and after them;
        others within another phrase are left out."""
        base, rest = [], []
        for end, (size, kind, label) in self.phrases.iter(words):
            (base if kind == "base" else rest).append((end + 1 - size, end + 1, label))
        kept, reach = [], -1
        for s, e, label in sorted(base + rest, key=lambda x: (x[0], -x[1])):
            if e > reach:
                reach = e
                kept.append((s, e, label))
        return base, [x for x in kept if x not in set(base)]

    def expressions(self, lower: str) -> list[tuple[str, set[str], bool]]:
        found, reach = [], -1
        for end, size in self.tags.iter(lower):
            start = end + 1 - size
            if start < reach or start > 0 and (lower[start - 1].isalnum() or lower[start - 1] in "-_"):
                continue  # the end of a longer tag or word
            if (x := parse(lower, end + 1)) is not None:
                found.append(x)
                reach = end + 1
        return found

    def scan(self, words: str, lower: str) -> dict:
        base, rest = self.notices(words)
        found = self.expressions(lower) if ":" in lower else []
        at, count, starts = 0, 0, []
        for s, _, _ in sorted({base[0], base[-1]} if base else ()):
            count += words.count(" ", at, s)
            at = s
            starts.append(count)
        miss = (1 - SURE["base"]) ** len(base) * (1 - SURE["notice"]) ** len(rest) * (1 - SURE["expression"]) ** len(found)
        labels = {x[2] for x in base}
        more = labels | {x[2] for x in rest} | {y for x in found for y in x[1]}
        return {"n_words": words.count(" ") - 1, "n_base": len(base), "first_word": starts[0] if base else None, "last_word": starts[-1] if base else None,
                "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(more)), "score": 1 - miss,
                "expressions": "; ".join(x[0] for x in found), "permissive": all(x[2] for x in found) if found else None}


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                  ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("permissive", pa.bool_())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence statements of every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    expressions (postfix, joined by "; ") and permissive (whether all expressions allow a permissive use; null without any)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        s = scanner()
        for b in batches:
            lower = pc.ascii_lower(pc.fill_null(b.column(1), ""))
            words = pc.utf8_trim(pc.replace_substring_regex(lower, _SEPARATORS, " "), " ")
            rows = [s.scan(f" {w} " if w else " ", x) for w, x in zip(words.to_pylist(), lower.to_pylist(), strict=True)]
            found = pa.RecordBatch.from_pylist(rows, schema=_OUT)
            yield pa.RecordBatch.from_arrays([b.column(0), *found.columns], names=["doc_id", *_OUT.names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                      "score double, expressions string, permissive boolean")
