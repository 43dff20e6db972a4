"""Pfair schedules, rendezvous shards and top-k search against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing, shard, topk


def test_less_than_one_block_from_the_target(spark):
    sizes = {"a": 3000, "b": 1000, "c": 700, "d": 90}
    weights = {"a": 5, "b": 2, "c": 2, "d": 0.3}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    rows = mixing.mix(docs, weights, block=10).collect()
    assert len(rows) == sum(sizes.values())
    assert len({(r.mix_slot, r.mix_row) for r in rows}) == len(rows)
    blocks = {}
    for r in rows:
        assert blocks.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
    shares = {"a": 50, "b": 20, "c": 20, "d": 3}  # the given weights, in whole numbers
    total = sum(shares.values())
    assert mixing.whole(weights) == shares
    # Up to the first source's end the mix follows the weights at every slot.
    ends = [max(t for t, (s, _) in blocks.items() if s == source) for source in sizes]
    had = dict.fromkeys(sizes, 0)
    for t in range(min(ends) // total * total):
        source, block = blocks[t]
        assert block == had[source] and t >= block * total // shares[source] and t < -(-(block + 1) * total // shares[source])
        had[source] += 1
        assert all(abs(had[s] - shares[s] / total * (t + 1)) < 1 for s in sizes)


def furthest(blocks, targets):
    """How far any source is from its target weight, in blocks, after any slot until the first source ends."""
    plan = mixing.schedule(blocks, targets)
    assert sorted(t for at in plan.values() for t in at) == list(range(sum(blocks.values())))
    until, total = min(at[-1] for at in plan.values()) + 1, sum(targets.values())
    t = np.arange(1, until + 1)
    return max(np.abs(np.searchsorted(np.array(plan[s]), t) - w / total * t).max() for s, w in targets.items())


def test_less_than_one_block_from_the_given_targets():
    assert furthest({str(i): 2500 for i in range(20)}, {str(i): 1 for i in range(20)}) < 1 - 1e-9
    assert furthest({"large": 30_000, "small": 25}, {"large": 0.99919, "small": 0.00081}) < 1 - 1e-9
    assert furthest({str(i): 900 + i for i in range(7)}, {str(i): (i + 2) ** 0.5 for i in range(7)}) < 1


def test_less_than_one_block_from_the_flow_over_the_whole_mix():
    blocks, targets = {"a": 40, "b": 7, "c": 1, "d": 23, "e": 5, "f": 9}, {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.1, "e": 0.1}
    plan = mixing.schedule(blocks, targets)
    weighted = sum(n for s, n in blocks.items() if s in targets)
    had, even = dict.fromkeys(blocks, 0.0), dict.fromkeys(blocks, 0.0)
    for t in range(weighted):
        room = 1.0
        while room > 1e-12:
            live = {s: w for s, w in targets.items() if even[s] < blocks[s] - 1e-9}
            part = min([room, *((blocks[s] - even[s]) * sum(live.values()) / w for s, w in live.items())])
            for s, w in live.items():
                even[s] += part * w / sum(live.values())
            room -= part
        had = {s: sum(x <= t for x in at) for s, at in plan.items()}
        assert all(abs(had[s] - even[s]) < 1 for s in targets) and not had["f"]
    assert list(plan["f"]) == list(range(weighted, weighted + 9))


def test_parts_and_blocks_grow_with_the_table(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("other").alias("source"), F.lit("x").alias("a.b"))
    whole = sorted(map(tuple, mixing.mix(docs, {"hot": 1, "other": 2}).collect()))
    monkeypatch.setattr(mixing, "PART", 64)
    assert sorted(map(tuple, mixing.mix(docs, {"hot": 1, "other": 2}).collect())) == whole
    monkeypatch.setattr(mixing, "BLOCKS", 30)
    rows = mixing.mix(docs, {"hot": 1, "other": 2}).collect()
    assert {r.mix_slot for r in rows} == set(range(30)) and {r.mix_row for r in rows} == set(range(100))


@pytest.mark.parametrize("few", [0, 10**6])
def test_any_number_of_sources(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "SHARED", few)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("site"), F.least(F.col("id"), F.lit(699)).cast("string")).alias("source"))
    weights = mixing.tempered(docs)
    assert len(weights) == 700 and weights["site699"] == round(1000 * 4301**0.5)
    rows = mixing.mix(docs, weights).collect()
    assert sorted(r.doc_id for r in rows) == list(range(5000)) and len({r.source for r in rows}) == 700
    assert {r.mix_slot for r in rows} == set(range(699 + 269)) and len({(r.mix_slot, r.mix_row) for r in rows}) == 5000


def test_sources_without_weight_follow(spark):
    docs = spark.createDataFrame([(i, s) for s in ("a", None) for i in range(50)], "doc_id long, source string")
    rows = mixing.mix(docs, {"a": 1}, block=5).collect()
    assert max(r.mix_slot for r in rows if r.source == "a") < min(r.mix_slot for r in rows if r.source is None)


def test_whole_shares():
    assert mixing.whole({"a": 1, "b": 1}) == {"a": 1, "b": 1}
    assert mixing.whole({"a": 0.5, "b": 0.3, "c": 0.2}) == {"a": 5, "b": 3, "c": 2}
    assert mixing.whole({"web": 0.9995, "rare": 0.0005}) == {"web": 1999, "rare": 1}
    assert mixing.whole({"a": 0}) == {}


def test_weights_and_growth_of_shards(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shard.assign(docs, 4, [1, 1, 2, 4]).collect()
    share = np.bincount([r.shard for r in rows]) / len(rows)
    assert np.abs(share - np.array([1, 1, 2, 4]) / 8).max() < 0.015
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert all(r.grown_shard == 4 for r in moved) and abs(len(moved) / len(rows) - 0.2) < 0.015
    again = {r.doc_id: r.shard for r in shard.assign(docs, 5, [1, 1, 2, 4, 2]).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in rows)


@pytest.mark.parametrize("copies", [1, 9000])
def test_slots_have_no_gaps(spark, copies):
    docs = spark.range(300).union(spark.range(copies).select(F.lit(7).cast("long"))).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shard.assign(docs).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert all(r.n == r.d == r.b + 1 and r.a == 0 for r in rows) and sum(r.n for r in rows) == 300 + copies


def nearest(x, ids, queries, own, k=5):
    """Brute force in Python's whole numbers: (score, id) of the best k rows of each query."""
    out = []
    for q, i in zip(queries, own, strict=True):
        scores = [(-sum(int(a) * int(b) for a, b in zip(q, row, strict=True)), int(j)) for row, j in zip(x, ids, strict=True) if j != i]
        out.append([(-s, j) for s, j in sorted(scores)[:k]])
    return out


@pytest.mark.parametrize("d,spread", [(2, 5), (6, 30), (64, 200), (3, 2**26), (3, 2**31), (2, 2**40)])
def test_tree_is_exact(d, spread):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.integers(-spread, spread, (1, d)) * 5 + rng.integers(-spread, spread, (75, d)) for _ in range(10)] + [np.full((40, d), spread)]).astype(float)
    ids = rng.permutation(len(x) * 3)[: len(x)]
    ids[-3:] = ids[-1]  # one id three times
    own = np.append(ids[:30], ids[-1])
    queries = np.concatenate([x[:30], x[-1:]])
    place, scores, best = topk.Tree(x, ids).search(queries, own, np.full(31, -np.inf))
    got = [[(int(s), int(i)) for s, i in zip(scores[place == r], best[place == r], strict=True)] for r in range(31)]
    assert got == nearest(x, ids, queries, own)


def test_top_k_of_large_components(spark):
    rows = [(0, [1e7, 1.0]), (1, [9e6, 0.0]), (2, [1e7, 0.0])]
    got = topk.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 6553600000000000000), (1, 5898240000000000000)]
    # Beyond 64 bits the order is that of the exact scores, and the score is the nearest that fits.
    rows = [(0, [1e9, 1.0]), (1, [2e9, 0.0]), (2, [3e9, 0.0]), (3, [-3e9, 0.0]), (4, [-2e9, 0.0]), (5, [1.0, 0.0])]
    got = topk.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**63 - 1), (1, 2**63 - 1), (5, 256 * 10**9 * 256), (4, -(2**63)), (3, -(2**63))]


def test_queries_visit_only_cells_that_may_hold_an_answer(spark, monkeypatch):
    for name, value in {"SHARD": 64, "CELL": 32, "SAMPLE": 512, "GROUP": 16, "WAVES": (1, 4)}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    # Clusters of unit length, a very common vector, and rows repeated in full.
    centres = rng.normal(size=(30, 8))
    x = np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(60, 8)) * 0.02 for c in centres] + [np.tile(centres[:1], (300, 1))])
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(7, [float(a) for a in x[7]])] * 200
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    seen = []
    got = topk.search(spark, docs, every=20, seen=seen).collect()
    whole = np.floor(256 * np.array([v for _, v in rows]))
    own = [i for i in range(len(x)) if i % 20 == 0]
    want = nearest(whole, np.array([i for i, _ in rows]), whole[own], own)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert [by[i] for i in own] == want
    assert len(seen) == 3 and sum(n for n, _ in seen) < 0.4 * seen[0][1]


def test_shards_are_those_of_the_definition(spark):
    import hashlib
    import math
    import zlib

    rows = [(i, f"text {i % 7}") for i in range(400)] + [(None, None), (None, "x"), (5, "text 5"), (5, "other")]
    got = shard.assign(spark.createDataFrame(rows, "doc_id long, text string"))

    def place(key, n):
        def score(i):
            digest = hashlib.md5(f"{'null' if key is None else key}:{i}".encode()).hexdigest()
            return -1 / math.log((int(digest[:13], 16) + 0.5) / 2**52), -i

        return -max(score(i) for i in range(n))[1]

    want = sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), place(k, 16), place(k, 17)) for k, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got.collect()) == want
    assert sorted((r.shard, r.slot) for r in got.collect()) == sorted((s, i) for s in range(16) for i in range(sum(w[3] == s for w in want)))
