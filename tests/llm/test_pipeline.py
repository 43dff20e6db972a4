"""Each stage of the pipeline against a plain version of it, on what its predecessor kept; and the run as a whole."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_text_operators import brute, plain_spans, plain_terms
from tidelog.llm import bpe, mixing, quality, textbuf, vocab


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of `documents` and of each stage, in the order in which they were written."""
    base = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out[name] = docs.collect()
    return out


def test_quality_keeps_what_scores_enough(spark, stages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    forest = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = []
    for r in stages["documents"]:
        x = quality.features(*textbuf.view(pa.array([r.text or ""]), 0, 1))[0]
        total = forest.prior
        for t in range(quality.TREES):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + (2 if x[forest.feature[t, node]] > forest.threshold[t, node] else 1)
            total += forest.leaf[t, node - 2**quality.DEPTH + 1]
        if 1 / (1 + np.exp(-total)) >= corpus_pipeline.LEAST_QUALITY:
            want.append(r)
    assert sorted(stages["quality"]) == sorted(want) and 0 < len(want) < len(stages["documents"])


def test_one_of_each_group_stays(stages):
    rows = {r.doc_id: r for r in stages["quality"]}
    found = brute([(i, r.text or "") for i, r in rows.items()], 5, 80)
    want = [i for i, (n, component) in found.items() if n == 0 or component == i]
    assert sorted(r.doc_id for r in stages["near_duplicates"]) == sorted(want) and len(want) < len(rows)
    assert all(rows[r.doc_id] == r for r in stages["near_duplicates"])


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r.text or "" for r in stages["near_duplicates"]}
    terms, total = plain_terms(sorted(before.items())), 0
    for r in stages["pii"]:
        text, out, at = before[r.doc_id], [], 0
        spans = [(a, b, "[" + ("EMAIL", "IP", "CARD", "PHONE")[k] + "]") for a, k, b in plain_spans(text)] + [(a, b, None) for a, b in terms[r.doc_id]]
        for a, b, name in sorted(spans, key=lambda s: s[:2]):
            if a >= at:
                out += [(text[at:a], True), (name, False)]
            at = max(at, b)
        out.append((text[at:], True))
        # A term is generalised or removed; all else is fixed.
        got, place = r.text or "", 0
        for piece, kept in out:
            if kept or piece is not None:
                assert got.startswith(piece, place)
                place += len(piece)
            elif got.startswith("[TERM]", place):
                place += 6
        assert place == len(got)
        total += len(spans) > 0
    assert total and sorted(r.doc_id for r in stages["pii"]) == sorted(before)


def test_the_mix_is_written_in_order(stages):
    rows = stages["pii"]
    sizes = {}
    for r in rows:
        sizes[r.source or mixing.UNKNOWN] = sizes.get(r.source or mixing.UNKNOWN, 0) + 1
    plan = mixing.schedule({s: -(-n // mixing.BLOCK) for s, n in sizes.items()}, {s: round(1000 * n**0.5) for s, n in sizes.items()})
    order = {t: s for s, at in plan.items() for t in at}
    left, want = dict(sizes), []
    for t in range(len(order)):
        n = min(mixing.BLOCK, left[order[t]])
        want += [order[t]] * n
        left[order[t]] -= n
    assert [r.source or mixing.UNKNOWN for r in stages["mixing"]] == want and sorted(stages["mixing"]) == sorted(rows)


def test_ids_are_the_librarys(stages):
    lib = vocab.tokenizer(vocab.public(bpe.VOCABULARY))
    texts = {r.doc_id: r.text or "" for r in stages["mixing"]}
    assert sorted(r.doc_id for r in stages["bpe"]) == sorted(texts)
    for r in stages["bpe"]:
        want = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want)
    places = sorted((r.mix_file, r.mix_row, r.doc_id) for r in stages["bpe"])
    assert [i for *_, i in places] == [r.doc_id for r in stages["mixing"]]


def test_run_gives_what_the_stages_give(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "ids").collect()
    assert {r.doc_id: r.ids for r in got} == {r.doc_id: r.ids for r in stages["bpe"]}
