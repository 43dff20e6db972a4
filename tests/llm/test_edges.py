"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import registry

LONG = "Lorem ipsum dolor sit amet, consectetur. " * 8000
ROWS = [
    (1, "The first text, with a few words in it.", "en", "a", 10),
    (1, "The first text, with a few words in it.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", None, 4),
    (None, "A text without an id, mail a.b@c.de or +49 30 1234567.", "en", "b", 1),
    (None, "A text without an id, mail a.b@c.de or +49 30 1234567.", "en", "b", 1),
    (5, "x", None, "b", 1),
    (6, LONG, "en", "hot", len(LONG)),
    (7, LONG + "end", "en", "hot", len(LONG)),
    (8, "漢字 かな 🙂 <|endoftext|> 4111 1111 1111 1111", "ja", "hot", 5),
]
EXTRA = ["_id", "_key", "_terms", "_has", "_row", "_source", "_part", "_at", "_hash", "_n", "text_key", "a.b", "c0", "score", "ids", "size", "shard", "slot", "n_tokens", "v", "vid", "node", "rank", "terms", "mix_slot", "base", "part", "n"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("edges"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("odd", ROWS), ("none", [])):
        docs = spark.createDataFrame(rows, schema)
        docs.withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3).write.parquet(f"{base}/{name}/documents.parquet")
        labels = [(1, 1, 0), (1, 0, 0), (3, 0, None), (None, 1, 1), (6, 1, 0), (7, None, 0), (4, 0, 0)] if rows else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/{name}/labels.parquet")
        inf, nan = float("inf"), float("nan")
        vectors = [(0, [0.5, 0.25], 1), (50, [0.1, -0.7], 2), (50, [0.1, -0.7], 2), (None, [1.0, 1.0], 0), (1, None, 0), (2, [inf, 0.0], 0), (3, [nan, 1.0], 0), (4, [None, 1.0], 0), (5, [0.5, 0.25], 0), (6, [0.5, 0.25], 0), (7, [2.0], 0), (8, [], 0)]
        spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).write.parquet(f"{base}/{name}/embeddings.parquet")
    return base


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_and_empty_tables(spark, tables, name):
    query = registry.queries()[name]
    assert query(spark, f"{tables}/none").collect() == []
    got = query(spark, f"{tables}/odd").collect()
    if name == "op7_topk":
        by = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
        assert {r.query_id for r in got} == {0, 50}
        assert by[0, 1] == (7, 128 * 512) and by[0, 2] == (5, 128 * 128 + 64 * 64) and by[0, 3][0] == 6 and by[0, 4] == (8, 0)
        assert by[0, 5] == (50, 128 * 25 + 64 * -180)
    else:
        key = lambda x: (x is None, x)
        assert sorted((r.doc_id for r in got), key=key) == sorted((r[0] for r in ROWS), key=key)
    if name == "op3_near_duplicates":
        by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
        assert by[2, 0] == 2 and by[3, 0] == 3 and by[4, 0] == 4 and by[5, 1] == 5
        assert {r.component_id for r in got if r.doc_id is None} == {None} and all(r.kept for r in got if r.doc_id in (1, 2, 3, None))
        assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    if name == "op9_language":
        assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    if name == "op1_quality":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    if name == "op6_pii":
        assert all(r.n_email == 1 and r.n_phone == 1 for r in got if r.doc_id is None)
        # The card stands once, so the terms that only its text has disclose it.
        assert [(r.n_card, r.spans) for r in got if r.doc_id == 8] == [(1, "term:0:2,term:3:5,term:6:7,term:10:19,card:22:41")]
        assert all(r.spans == "" for r in got if r.doc_id in (1, 2, 3, 4, 5, 6, 7))
    if name == "op5_shards":
        assert {(r.size, r.text_crc32) for r in got if r.doc_id in (2, 3)} == {(1, 0)}
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(16))


def test_pipeline(spark, tables):
    for name in ("none", "odd"):
        docs = spark.read.parquet(f"{tables}/{name}/documents.parquet")
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f"{tables}/pipeline/{name}/{stage}"
            f(spark, docs, f"{tables}/{name}").write.parquet(out)
            new = spark.read.parquet(out)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert new.columns == docs.columns
            if stage == "near_duplicates":
                before, after = docs.collect(), new.collect()
                for r in before:
                    if not (r.text or "").strip():
                        assert sum(x.doc_id == r.doc_id for x in after) == sum(x.doc_id == r.doc_id for x in before)
                assert all(sum(x.doc_id == i and x.text is not None and bool(x.text.strip()) for x in after) <= 1 for i in (1, None, 6))
            docs = new
        assert (docs.count() > 0) == (name == "odd")
