"""Folds step by step, against plain loops and known sequences."""

import random

import numpy as np
import pytest

from tidelog.operators import fold


def run(start_step, values):
    state, step = start_step
    out = []
    for v in values:
        state, got = step(state, v if isinstance(v, tuple) else (v,))
        out.append(got if len(got) > 1 else got[0])
    return out


def test_greedy_chunks():
    assert run(fold.greedy_chunks(10), [4, 6, 1, 9, 20, 3]) == [0, 0, 1, 1, 2, 3]


def test_age_chunks():
    assert run(fold.age_chunks(10), [0, 9, 10, 15, 21]) == [0, 0, 1, 1, 2]


def test_sequence_check():
    assert run(fold.sequence_check(), [0, 1, 1, 3, 2]) == ["ACCEPT", "ACCEPT", "DUPLICATE", "GAP", "ACCEPT"]
    assert run(fold.sequence_check(), [7, 8, 5]) == ["ACCEPT", "ACCEPT", "OLD"]


def test_sparse_index():
    got = run(fold.sparse_index(100), [60] * 6)
    assert [p for p, e in got if e] == [120, 240]
    assert run(fold.sparse_index(100, index_first=True), [60])[0] == (0, True)


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("name", ["greedy", "age", "rotation", "index", "index_first", "sequence"])
def test_records_taken_at_once_give_what_steps_give(name, seed):
    rng = random.Random(seed)
    start, step = {"greedy": lambda: fold.greedy_chunks(50), "age": lambda: fold.age_chunks(30), "rotation": lambda: fold.rotation(60, 40), "index": lambda: fold.sparse_index(70), "index_first": lambda: fold.sparse_index(70, True), "sequence": fold.sequence_check}[name]()
    sizes, times, at, seq, last = [], [], 0, [], 0
    for _ in range(900):
        sizes.append(rng.choice([0, 1, 5, 20, 200]))
        at += rng.choice([0, 1, 3, 25, -4])
        times.append(at)
        last = last + 1 if rng.random() < 0.8 else last + rng.randint(-3, 2)
        seq.append(last)
    columns = {"greedy": [sizes], "age": [times], "rotation": [sizes, times], "index": [sizes], "index_first": [sizes], "sequence": [seq]}[name]
    one, want = start, []
    for value in zip(*columns, strict=True):
        one, got = step(one, value)
        want.append(got)
    state, found, cut = start, [], [0, 1, 70, 71, 500, 900]
    for a, b in zip(cut, cut[1:], strict=False):
        state, got = step.many(state, *(np.array(c[a:b]) for c in columns))
        found += list(zip(*(x.tolist() for x in got), strict=True))
    assert found == want and state == one


def test_adaptive_size():
    assert run(fold.adaptive_size(), [60000, 60000, 60000, 130000])[2] == 131072
    assert run(fold.adaptive_size(), [100] * 5)[-1] == 32768
    assert run(fold.adaptive_size(), [100] * 4 + [30000] + [100] * 4)[-1] == 65536


def test_circuit_breaker():
    calls = [(i, False) for i in range(5)] + [(10, True), (60_004, True), (60_005, True), (60_006, False)]
    after = [x[2] for x in run(fold.circuit_breaker(), calls)]
    assert after == ["CLOSED"] * 4 + ["OPEN", "OPEN", "HALF_OPEN", "CLOSED", "CLOSED"]
    # Half open, the first failure opens again; after a success one more failure doesn't, and successes before an opening count.
    calls = [(0, False), (1, False), (1001, False), (2001, True), (2002, False), (2003, False), (3003, True)]
    after = [x[2] for x in run(fold.circuit_breaker(2, 1000, 2), calls)]
    assert after == ["CLOSED", "OPEN", "OPEN", "HALF_OPEN", "HALF_OPEN", "OPEN", "CLOSED"]


def test_token_bucket_keeps_the_rate():
    rng = random.Random(1)
    calls, t = [], 0
    for _ in range(200):
        t += rng.randint(0, 50)
        calls.append((t, rng.randint(1, 400)))
    goes = run(fold.token_bucket(1000), calls)
    assert goes == sorted(goes)
    for i in range(len(goes)):
        for j in range(i, len(goes)):
            assert sum(b for _, b in calls[i : j + 1]) <= 1000 + (goes[j] - goes[i]) * 1.0 + 1
    assert run(fold.token_bucket(10), [(0, 11)]) == [None]


@pytest.mark.parametrize("kinds", ["small", "any", "big small", "negative small", "negative big small any"])
def test_effects_of_stretches_compose_to_what_steps_give(kinds):
    for seed in range(20):
        rng = random.Random(seed)
        rate = rng.choice([7, 50, 1500, 5000])
        size = {"small": lambda: rng.randint(0, 1 + rate // 50), "any": lambda: rng.randint(0, rate + 2), "big": lambda: rate - rng.randint(0, 1 + rate // 700), "negative": lambda: -rng.randint(1, rate)}  # noqa: B023
        calls, t = [], rng.choice([-500, 0, 10**12])
        for _ in range(120):
            t += rng.choice([0, 0, 1, 3, 500, 3000])
            calls.append((t, size[rng.choice(kinds.split())]()))
        bucket, state, found = fold.Bucket(rate), None, []
        cut = sorted({0, 120, *(rng.randrange(120) for _ in range(6))})
        for a, b in zip(cut, cut[1:], strict=False):
            at, need = (np.array(x, np.int64) for x in zip(*((t, 1000 * n) for t, n in calls[a:b] if n <= rate), strict=True)) if any(n <= rate for _, n in calls[a:b]) else (np.zeros(0, np.int64),) * 2
            effect = fold.Effect(bucket)
            for part in (slice(None, 3), slice(3, None)):
                effect.add(at[part], need[part])
            state = bucket.start(effect.first) if state is None and len(at) else state
            after, goes = bucket.fold(state or bucket.nothing, at, need)
            assert fold.after(bucket, effect.packed(), state or bucket.nothing) == after
            state, goes = after if state else None, iter(goes.tolist())
            found += [next(goes) if n <= rate else None for _, n in calls[a:b]]
        assert found == run(fold.token_bucket(rate), calls)


def test_a_null_key_is_a_key_and_batches_carry_state(spark):
    # In batches of three, and in one that is long enough to be taken at once.
    long = spark.createDataFrame([(None if i % 2 else "a", i, 1) for i in range(400)], "k string, n int, size int")
    got = fold.ordered_fold(long, ["k"], ["n"], ["size"], *fold.greedy_chunks(5), "chunk long").collect()
    assert all([r.chunk for r in sorted((r for r in got if r.k == key), key=lambda r: r.n)] == [i // 5 for i in range(200)] for key in (None, "a"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    rows = spark.createDataFrame([(None if i % 2 else "a", i, 1) for i in range(40)], "k string, n int, size int")
    got = fold.ordered_fold(rows, ["k"], ["n"], ["size"], *fold.greedy_chunks(5), "chunk long").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in (None, "a"):
        assert [r.chunk for r in sorted((r for r in got if r.k == key), key=lambda r: r.n)] == [i // 5 for i in range(20)]


@pytest.mark.parametrize("name", ["default", "key_hash", "round_robin", "random", "sticky"])
def test_partitioners(name):
    from tidelog.functions.routing import partitioner

    assert partitioner(name)
    with pytest.raises(ValueError):
        partitioner("other")
