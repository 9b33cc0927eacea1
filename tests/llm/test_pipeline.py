"""The pipeline's stages, each on what the one before kept, against plain code; rows that are hard on every stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docassay.llm import mixing, pii
from docassay.llm._common import materialise
from docassay.llm.queries import TARGETS, tokenizer_path

from .conftest import SF
from .test_documents import base_spans, brute_added, brute_classes, rows


def plain_redaction(text, model):
    out, at = "", 0
    kinds = (*pii.KINDS, "secret")
    for a, k, b in sorted([*base_spans(text), *brute_added(text, model)], key=lambda x: (x[0], -x[2])):
        if b > at:
            out, at = out + text[at : max(a, at)] + f"[{kinds[k].upper()}]", b
    return out + text[at:]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_stages_equal_plain_code(spark, documents, library):
    docs = documents.withColumn("extra", F.lit("kept"))
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["language_id", "minhash_near_dedup", "pii", "source_mixing", "bpe"]
    plain = sorted(tuple(r) for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"]))
    one = materialise(stages["language_id"](spark, docs, SF), "one")
    assert sorted(map(tuple, one.collect())) == plain and one.columns == docs.columns

    two = materialise(stages["minhash_near_dedup"](spark, one, SF), "two")
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(brute_classes(rows(one)).values()))
    assert {tuple(r) for r in two.collect()} <= {tuple(r) for r in one.collect()}

    three = materialise(stages["pii"](spark, two, SF), "three")
    model = pii.fit(pii.cells(two))
    want = {r["doc_id"]: plain_redaction(r["text"], model) for r in two.collect()}
    assert {r["doc_id"]: r["text"] for r in three.collect()} == want
    assert all(r["extra"] == "kept" and (r["n_chars"] == len(r["text"])) for r in three.collect() if "[" in r["text"])

    four = materialise(stages["source_mixing"](spark, three, SF), "four")
    labels = mixing.quality_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(three, labels, TARGETS).collect()}
    assert Counter(r["doc_id"] for r in four.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert {tuple(r) for r in four.collect()} <= {tuple(r) for r in three.collect()}

    five = stages["bpe"](spark, four, SF).collect()
    assert len(five) == four.count() and all(r["ids"] == library.encode(want[r["doc_id"]], add_special_tokens=False).ids for r in five)


def test_stages_of_nothing(spark, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.count() == 0, name
