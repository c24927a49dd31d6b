"""The Jaccard join when tiles list few partners, and with fine or coarse signatures only."""

import random

import pytest

from leasegrid.llm import jaccard_join

from .test_operators import Union, shingles

PIECES = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l m nd st rt sk".split()]


def crowd(rng, size, edits):
    """Copies of one text, each edited in its own places: close to the text and less so to each other."""
    base = [rng.choice(PIECES) + rng.choice(PIECES) for _ in range(120)]
    out = []
    for _ in range(size):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(0, edits)):
            words[k] = rng.choice(PIECES) + rng.choice(PIECES) + "x"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("nearest, few", [(1, 0), (1, 10**9), (2, 8), (16, 8)])
def test_no_link_is_lost_however_few_partners_are_listed(spark, monkeypatch, nearest, few):
    monkeypatch.setattr(jaccard_join, "NEAREST", nearest)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rng = random.Random(nearest * 7 + few)
    texts = crowd(rng, 40, 5) + crowd(rng, 30, 2) + crowd(rng, 20, 9)
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=3, num=90).collect()}
    sets = [shingles(t, 3) for t in texts]
    union = Union(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                union.join(i, j)
    assert got == {i: union.top(i) for i in range(len(texts))}
