"""The corpus pipeline stage by stage against plain versions of each stage."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from leasegrid.llm import language_id, pii
from leasegrid.llm.shared import held_out

from .test_operators import Union, pii_training, plain_alignment, plain_spans, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output, written as the pipeline does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in cp.STAGES:
        after = cp.stored(f(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns_and_order(spark, stages):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "personal_data", "pack"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == columns, name


def test_language_rejects_by_the_operator(stages):
    before, after = stages["language"]
    found = language_id.identify(before, language_id.learn(before.where(~held_out())), spans=False)
    kept = {r["doc_id"] for r in found.where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert set(rows(after)) == kept and len(kept) > 0.95 * before.count()


def test_texts_in_unlearned_scripts_leave(spark, stages):
    docs, clean = stages["language"]
    odd = spark.createDataFrame([(-1, "Съешь же ещё этих мягких французских булок", None, "s", 42), (-2, "春眠不觉晓，处处闻啼鸟。", None, "s", 12)], docs.schema)
    after = rows(cp.language(spark, docs.unionByName(odd), SF))
    assert after == rows(clean) and set(after) >= {i for i, r in rows(docs).items() if r["lang"] and re.search("[a-z]{3}", r["text"] or "")}


def test_one_of_each_class_stays(stages):
    before, after = (rows(x) for x in stages["near_duplicates"])
    sets = {i: shingles(r["text"], 5) for i, r in before.items()}
    union = Union(sets)
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and 100 * len(a & b) >= 80 * len(a | b):
                union.join(i, j)
    assert set(after) == {i for i in before if union.top(i) == i} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_leaks_go(spark, stages):
    before, after = (rows(x) for x in stages["benchmark_leaks"])
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {i for i, r in before.items() if any(
        len(a) >= 6 and len(set(a) & set(w)) >= len(set(a)) // 3 and plain_alignment(a, w) >= len(a) for w in [words(r["text"])[:3000]] for a in items)}
    assert set(before) - set(after) >= leaky


def test_leaks_go_by_row_with_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    texts = [(None, f"so {item}"), (None, "clean of it"), (5, item), (5, "clean namesake"), (6, None)]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], docs.schema)
    got = [(r["doc_id"], r["text"]) for r in cp.benchmark_leaks(spark, odd, SF).collect()]
    assert sorted(got, key=str) == sorted([texts[1], texts[3], texts[4]], key=str)


def test_personal_data_is_replaced(stages):
    before, after = (rows(x) for x in stages["personal_data"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert plain_spans(r["text"] or "") == "" or "[" in r["text"], i
        assert r["n_chars"] == len(r["text"])
        if not plain_spans(before[i]["text"]):
            assert r["text"] == before[i]["text"] or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r["text"])


def test_personal_data_is_learned_from_all_documents(spark):
    plain = spark.range(2_000, 2_000_000).select(F.col("id").alias("doc_id"), F.lit("plain words only").alias("text"))
    call = spark.createDataFrame([(-1, "call me at (974) 555-3436 now")], "doc_id long, text string")
    docs = pii_training(spark).unionByName(call).unionByName(plain).withColumn("n_chars", F.length("text").cast("long"))
    got = cp.personal_data(spark, docs, SF).where("doc_id = -1").first()
    assert got["text"] == "call me at [PHONE] now" and got["n_chars"] == len(got["text"])


def test_packing_holds_all_tokens(stages):
    before, pieces = stages["pack"]
    ids = {r["doc_id"]: [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(r["text"] or "", add_special_tokens=False).ids, 1]
           for r in before.collect()}
    got = pieces.collect()
    assert sum(p["length"] for p in got) == sum(map(len, ids.values()))
    import zlib

    for p in got:
        part = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]


def test_run_gives_the_last_stage(spark, stages):
    got = cp.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = stages["pack"][1].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stages_take_odd_and_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "the null id", "en", "s", 3), (-1, "", "en", "s", 0), (-2, "12 34", None, None, 5),
                                 (-3, "x" * 100_000, "en", "s", 1), (-3, "x" * 100_000, "en", "s", 1)], docs.schema)
    for start in (docs.limit(40).unionByName(odd), docs.where("false"), odd):
        df = start.withColumn("rep", F.lit(1)).withColumn("score", F.lit(2))
        for name, f in cp.STAGES:
            df = cp.stored(f(spark, df, SF), f"odd-{name}")
        df.count()
    assert pii.KINDS == ["email", "ip", "card", "phone"]
