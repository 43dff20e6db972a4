"""Operators on texts against the libraries, brute force and planted cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import bpe, langid, neardup, pii, quality, textbuf, tokencount, vocab

ALPHABET = ["a", "b c", " ", "  ", "\n", "é", " ", "'s", "'", "1", "２", "，", "漢", "字", "<|endoftext|>", "　", "!", "?? ", "\r\n", "\t", "don't", "🙂", "́", "Z", "\x1c", "\x85"]


def mixed(seed, pieces, count, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def encoded(coder, texts):
    col, out = pa.array(texts, pa.string()), []
    for a, b in textbuf.slices(col):
        out += list(coder.encode(*textbuf.view(col, a, b)))
    return out


@pytest.mark.parametrize("pieces,count,longest", [(ALPHABET, 1500, 60), ([p for p in ALPHABET if " " not in p and "<" not in p], 12, 9000), ([p for p in ALPHABET if " " not in p], 6, 9000)])
def test_bpe_is_the_librarys(pieces, count, longest):
    path = vocab.public(bpe.VOCABULARY)
    lib, coder = vocab.tokenizer(path), bpe.Coder(path)
    texts = [*mixed(3, pieces, count, longest), "a" * 9000, " " * 9000, "\n" * 5000, ""]
    for text, (ids, decoded) in zip(texts, encoded(coder, texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids.decode() == ",".join(map(str, want))
        assert decoded.decode() == lib.decode(want, skip_special_tokens=False)


def test_shared_passages_are_encoded_once():
    coder = bpe.Coder(vocab.public(bpe.VOCABULARY))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(400))
    encoded(coder, [f"{word()} {word()} {passage} {word()}"])
    before = len(coder.chunks)
    encoded(coder, [f"{word()} other {word()} start {passage} end"])
    assert len(coder.chunks) - before <= 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=5))
def test_token_counts_are_the_librarys(texts):
    path = vocab.public(tokencount.VOCABULARY)
    got = tokencount.Counts(tokencount.Table(["the", "of"], [1, 1]), path).count(texts)
    assert got == [len(vocab.tokenizer(path).encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_whole_tables(spark, monkeypatch):
    """The query against the library, text by text; also with a small table and cache."""
    from tests.conftest import SMALL

    lib = vocab.tokenizer(vocab.public(tokencount.VOCABULARY))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.op2_token_counts(spark, SMALL).collect()} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in tokencount.op2_token_counts(spark, SMALL).collect())
    monkeypatch.setattr(tokencount, "CACHED", 2000)
    tiers = tokencount.Counts(tokencount.Table(["the", "of"], [1, 1]), vocab.public(tokencount.VOCABULARY))
    for i, t in texts.items():
        assert tiers.count([t]) == [want[i][1]]
    assert len(tiers.known) <= 2 + 2000 + max(len(set(t.split())) for t in texts.values())


def test_token_counts_of_odd_texts():
    path = vocab.public(tokencount.VOCABULARY)
    texts = mixed(4, ALPHABET, 400, 50)
    assert tokencount.Counts(tokencount.Table([], []), path).count(texts) == [len(vocab.tokenizer(path).encode(t, add_special_tokens=False).ids) for t in texts]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", "b.", ".", "1", "25", "3.", "+", "-", " ", "(", ")", "é", "4111111111111111", "x@y.z", "+1 ", "300"]), max_size=40).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_terms_that_disclose(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, some(40)) for i in range(200)]
    rows += [(1000 + i, f"{some(10)} write to Quentin Zanzibar at q.z@mail.example {some(10)}") for i in range(6)]
    rows += [(2000 + i, f"{some(3)} copied passage Unrepeated near copy@mail.example the end of it stays the same every time") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    text = dict(rows)
    for i in range(6):
        terms = [text[1000 + i][int(a) : int(b)] for kind, a, b in (s.split(":") for s in spans[1000 + i].split(",")) if kind == "term"]
        assert {"Quentin", "Zanzibar"} <= set(terms)
    assert all(spans[i] == "" for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zanzibar" not in clean[1000 + i] and "q.z@" not in clean[1000 + i] and "[EMAIL]" in clean[1000 + i] for i in range(6))
    assert all(clean[i] == text[i] for i in range(200))


def test_terms_that_disclose_from_afar(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, some(40)) for i in range(200)]
    # The name opens the text and the address closes it; one text has the name only, one the name inside an address only.
    rows += [(1000 + i, f"Ödön Zanzibar {some(25)} é q.z@mail.example") for i in range(20)]
    rows += [(1100, f"{some(20)} Zanzibar {some(5)}"), (1101, f"{some(20)} zanzibar@other.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans, text = {r.doc_id: r.spans for r in pii.find(docs).collect()}, dict(rows)
    terms = {i: {text[i][int(a) : int(b)] for kind, a, b in (s.split(":") for s in spans[i].split(",") if s) if kind == "term"} for i in spans}
    assert all(terms[1000 + i] == {"Ödön", "Zanzibar"} for i in range(20)) and terms[1100] == {"Zanzibar"} and not terms[1101]
    assert all(spans[i] == "" for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all(clean[1000 + i].startswith(" [TERM] ") and clean[1000 + i].endswith(" é [EMAIL]") for i in range(20))
    assert clean[1100] == text[1100].replace("Zanzibar", "[TERM]") and clean[1101].endswith(" [EMAIL]")
    assert all(clean[i] == text[i] for i in range(200)) and len(clean) == len(rows)


def plain_terms(rows):
    """The term spans of each (id, text) by the definition: PMI over whole documents."""
    total, docs = len(rows), []
    for i, text in rows:
        base = plain_spans(text)
        terms = {}
        for m in re.finditer("[A-Za-z\x80-\U0010ffff]+", text):
            if len(m.group().encode()) >= pii.SHORTEST and not any(a < m.end() and m.start() < b for a, _, b in base):
                word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m.group())
                terms.setdefault(word, []).append((m.start(), m.end()))
        values = {(k, text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b])) for a, k, b in base}
        docs.append((i, terms, values, {k for k, _ in values}))
    count = Counter(t for _, terms, _, _ in docs for t in terms)
    of = {c: sum(c in values for _, _, values, _ in docs) for c in {c for _, _, values, _ in docs for c in values}}
    of |= {k: sum(k in kinds for *_, kinds in docs) for k in range(4)}
    pair = Counter((c, t) for _, terms, values, kinds in docs for c in values | kinds for t in terms)

    def discloses(c, t):
        share = np.log2(of[c] / total)
        return share < 0 and np.log2(pair[c, t] * total / (of[c] * count[t])) >= -pii.ALPHA * share - 1e-9

    hit = {(c, t) for c, t in pair if (isinstance(c, tuple) or pair[c, t] >= pii.SUPPORT) and discloses(c, t)}
    several = {t for c, t in hit if isinstance(c, tuple) and of[c] > 1 and count[t] > 1}
    far = {t for c, t in hit if isinstance(c, tuple) and pair[c, t] >= pii.FAR}
    return {i: sorted(p for t, places in terms.items() if t in (several if kinds else far) or any((c, t) in hit for c in values | kinds) for p in places) for i, terms, values, kinds in docs}


def term_spans(spans):
    return sorted((int(a), int(b)) for kind, a, b in (s.split(":") for s in spans.split(",") if s) if kind == "term")


def test_terms_are_those_of_brute_force(spark, monkeypatch):
    from tests.conftest import SMALL

    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").collect()]
    # Values and terms that come again, with copies and a term in a text without the value.
    rows += [(10_000 + i, f"Zanzibar writes to q.z@mail.example {rows[i][1][:300]}") for i in range(12)]
    rows += [(11_000, "only Zanzibar here"), (11_001, "call +49 30 1234567 Unrepeated"), (11_002, "call +49 30 1234567 Unrepeated"), (11_003, "Unrepeated in a clean text"), (11_004, "Unrepeated for x@y.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_terms(rows)
    assert sum(map(bool, want.values())) > 50 and want[11_000] and not want[11_003]
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert {i: term_spans(x) for i, x in got.items()} == want
    monkeypatch.setattr(pii, "HARMLESS", 1)  # lists that are too long to be known everywhere
    monkeypatch.setattr(pii, "HELD", 500)
    assert {r.doc_id: r.spans for r in pii.find(docs).collect()} == got


def test_a_long_access_log_is_done_in_time(spark):
    rng = random.Random(9)
    log = "\n".join(f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)} GET /page{i} by user{rng.choice('abc')}" for i in range(6000))
    docs = spark.createDataFrame([(1, log), (2, "plain words"), (3, log[:5000])], "doc_id long, text string")
    pii.find(docs.limit(1)).collect()
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[1].n_ip == 6000 and got[1].spans.count("ip:") == 6000 and time.perf_counter() - began < 20


def test_sanitise_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de Zanzibar", "x", "y", "z", "w"), (2, None, "x", "y", "z", "w"), (3, "plain", "x", "y", "z", "w")], "doc_id long, text string, _id string, _key string, _terms string, `a.b` string")
    got = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert got[1].text == " [EMAIL] "
    assert got[2].text is None and got[3].text == "plain" and all((r["_id"], r["_key"], r["_terms"], r["a.b"]) == ("x", "y", "z", "w") for r in got.values())


def brute(rows, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text.translate(lower))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    to = {i: i for i in sets}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                to[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("limits", [{}, {"NODE": 8, "ALONE": 4, "ROOM": 1500, "DEPTH": 2}, {"NODE": 4, "ALONE": 4, "ROOM": 300, "DEPTH": 1, "FEW": 1, "HELD": 10, "WIDE": 2}, {"ALONE": 6, "ROOM": 500}])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, limits):
    """Also with nodes and rooms so small that branching, blocks and rooms of several blocks are needed."""
    for k, v in limits.items():
        monkeypatch.setattr(neardup, k, v)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(4, 120))]
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) if rng.random() < 0.8 else "  ".join(copy).upper())
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [f"{passage} {' '.join(rng.choice(words) for _ in range(60))}" for _ in range(30)] + ["", " ", "one", "One", "two words"]
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_recall_on_a_large_node(spark):
    """At the constants of production: 4,400 texts of one shape, in 1,100 groups of four whose members are at 0.85 or a little more from each other."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common, rows, pairs = [word() for _ in range(60)], [], []
    for group in range(1100):
        own = [word() for _ in range(10)]  # the common part alone makes any two of them alike at 0.6 or so
        for k in range(4):
            rows.append((4 * group + k, " ".join([*common, *own, *(word() for _ in range(11 if k else 0))])))
        pairs += [(4 * group, 4 * group + k) for k in (1, 2, 3)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()}
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(linked) == 3300 and all(100 * len(sets[0] & sets[4 * k]) < 85 * len(sets[0] | sets[4 * k]) for k in range(1, 50))
    found = np.mean([got[a] == got[b] for a, b in linked])
    assert found >= 0.999 and all(c % 4 == 0 for c in got.values()) and len(set(got.values())) >= 1100


def test_large_families_meet_representatives_first(spark, monkeypatch):
    """3,000 near copies of a text: each is read for a few rooms, not for one of every pair of blocks."""
    monkeypatch.setattr(neardup, "ROOM", 1 << 13)
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = [(i, " ".join([*base, word()])) for i in range(3000)]
    seen, rooms = [], neardup._in_rooms

    def counted(given, some_large, limit, room, payload):
        seen.append(given.agg(F.max("blocks")).first()[0])
        return rooms(given, some_large, limit, room, payload)

    seen_rows = spark.sparkContext.accumulator(0)
    inner = neardup._linked

    def linked(width, percent):
        f = inner(width, percent)

        def run(batches):
            def each():
                for batch in batches:
                    seen_rows.add(batch.num_rows)
                    yield batch

            return f(each())

        return run

    monkeypatch.setattr(neardup, "_in_rooms", counted)
    monkeypatch.setattr(neardup, "_linked", linked)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r.component_id for r in got} == {0} and max(seen) > 15
    assert seen_rows.value < 3 * len(rows)


def test_learnt_models_on_held_out_rows(spark):
    from tests.conftest import SMALL

    base = SMALL.replace("0.001", "0.01")
    q = quality.op1_quality(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in q]) >= 0.95
    lang = langid.op9_language(spark, base).join(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in lang]) >= 0.98


def plain_grams(text):
    """The n-grams of a text, with one blank for each run of other bytes and one before the first."""
    raw = re.sub(b"[^a-z\x80-\xff]+", b" ", text.lower().encode())
    raw = raw if raw.startswith(b" ") or not raw else b" " + raw
    return [raw[i : i + n] for n in langid.LENGTHS for i in range(len(raw) - n + 1)]


def test_languages_are_those_of_exact_sets(spark):
    """The filters' counts against those of plain sets, and what is decided by them."""
    from tests.conftest import SMALL

    path = f"{SMALL.replace('0.001', '0.01')}/documents.parquet"
    docs = spark.read.parquet(path)
    rows = sorted((r.doc_id, r.text or "", r.lang) for r in docs.collect())
    total = {}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            total.setdefault(lang, Counter()).update(plain_grams(text))
    sums = {lang: sum(c.values()) for lang, c in total.items()}
    kept = {lang: {g: n / sums[lang] for g, n in c.items() if n / sums[lang] >= langid.LEAST} for lang, c in total.items()}
    most = {}
    for c in kept.values():
        for g, x in c.items():
            most[g] = max(x, most.get(g, 0))
    has = {lang: {g for g, x in c.items() if x >= langid.PART * most[g]} for lang, c in kept.items()}
    filters = langid.fit(docs)
    assert filters.names == sorted(total) and len(filters.names) > 2
    off = 0
    for _, text, _ in rows[:200]:
        each = plain_grams(text)
        want = np.array([sum(g in has[lang] for g in each) for lang in filters.names])
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        got = filters.counts(*langid.grams(raw, np.array([0, len(raw)])), 1)[:, 0]
        assert np.abs(got - want).max() <= 0.02 * len(each) + 3
        off += want.max() > 0 and want.argmax() != got.argmax()
    assert off <= 2


def test_many_languages_are_learnt_and_told_apart(spark):
    """200 languages, some of them of one short document."""
    rng = random.Random(12)
    rows = []
    for lang in range(200):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(40)]
        rows += [(1000 * lang + i, " ".join(rng.choice(words) for _ in range(30)), f"l{lang:03d}") for i in range(1 if lang % 10 == 0 else 8)]
    rows = [(i + (zlib.crc32(str(i).encode()) % 4 == 2) * 500 if n % 8 == 0 else i, t, x) for n, (i, t, x) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(docs)
    learnt = {x for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(filters.names) == learnt and len(learnt) > 190 and len(filters.tables) == 4
    got = {r.doc_id: r for r in langid.detect(spark, docs, filters).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows if x in learnt]) > 0.97
    alone = spark.createDataFrame([(1, "an only short text", "one"), (3, "tout autre chose encore", "two")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.detect(spark, alone, langid.fit(alone)).collect()} == {1: "one", 3: "two"}


def test_popcounts():
    rng = np.random.default_rng(1)
    mask, row = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), np.sort(rng.integers(0, 4500, 5000))
    want = np.zeros((64, 4500))
    for m, r in zip(mask.tolist(), row.tolist(), strict=True):
        want[[b for b in range(64) if m >> b & 1], r] += 1
    assert (langid.popcounts(mask, row, 4500) == want).all() and (langid.popcounts(mask, row, 4500, 3) == want[:3]).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    from tidelog.llm.components import components

    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200, x) for x in range(201, 230)] + [(7, 7), (1000, 300), (300, 1000)]
    to: dict[int, int] = {}

    def root(x):
        while to.setdefault(x, x) != x:
            x = to[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        to[max(x, y)] = min(x, y)
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in to if root(v) != v}

@pytest.mark.parametrize("rows", [3, 20, 150])
def test_components_of_many_partitions(spark, monkeypatch, rows):
    """With partitions so small that they don't connect the whole, and that some are given back in pieces."""
    from tidelog.llm import components

    monkeypatch.setattr(components, "ROWS", rows)
    rng = random.Random(rows)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, x) for x in range(2000, 2060)] * 2
    rng.shuffle(edges)
    names = [(f"{a:05}".encode(), f"{b:05}".encode()) for a, b in edges]
    forest = components.Forest()
    for a, b in names:
        forest.add(a, b)
    want = {v: forest.least(v) for e in names for v in e if forest.least(v) != v}
    assert len(want) > 150 and want[b"00140"] == b"00100"
    got = components.components(spark.createDataFrame(names, "a binary, b binary").repartition(9)).collect()
    assert len(got) == len(want) and {bytes(r.a): bytes(r.b) for r in got} == want


def test_components_take_few_jobs(spark):
    """The driver keeps records of every job and task: a chain that one task can hold is no matter of many rounds."""
    from tidelog.llm.components import components

    order = list(range(3000))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long").repartition(20).checkpoint()
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    got = components(edges)
    assert jobs() - before <= 6
    assert {(r.a, r.b) for r in got.collect()} == {(v, 0) for v in range(1, 3000)}


def test_trees_are_walked_as_defined():
    """Scores against a walk of each tree for each row by itself."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.2).astype(float)
    forest = quality.boost(x, y)
    for row, got in zip(x, forest.score(x), strict=True):
        total = forest.prior
        for t in range(quality.TREES):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + (2 if row[forest.feature[t, node]] > forest.threshold[t, node] else 1)
            total += forest.leaf[t, node - 2**quality.DEPTH + 1]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    assert np.mean((forest.score(x) > 0.5) == y) > 0.95


def test_the_first_split_has_the_largest_gain():
    """The root of the first tree, and its leaves' values, by trying every cut of every feature."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20, (250, 4)).astype(np.float32)  # fewer values than bins, so every cut is tried
    y = ((x[:, 2] > 7) ^ (rng.random(250) < 0.1)).astype(float)
    forest = quality.boost(x, y)
    p = np.clip(y.mean(), 0.02, 0.98)
    g, h = p - y, np.full(250, p * (1 - p))

    def part(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + quality.LAMBDA)

    gains = {(f, c): part(x[:, f] <= c) + part(x[:, f] > c) - part(np.ones(250, bool)) for f in range(4) for c in np.unique(x[:, f])[:-1] if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= 1}
    best = max(gains, key=gains.get)
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == best
    node = np.zeros(250, int)
    for _ in range(quality.DEPTH):
        node = 2 * node + 1 + (x[np.arange(250), forest.feature[0][node]] > forest.threshold[0][node])
    for leaf in np.unique(node):
        rows = node == leaf
        assert abs(forest.leaf[0, leaf - 2**quality.DEPTH + 1] + quality.RATE * g[rows].sum() / (h[rows].sum() + quality.LAMBDA)) < 1e-12


def test_statistics_against_plain_counting():
    texts = ["", "One two two. THREE!", *mixed(5, ["Ab ", "c", "12 ", "! ", "é", "\n", "word ", "word word "], 30, 40)]
    col = pa.array(texts, pa.string())
    got = quality.features(*textbuf.view(col, 0, len(texts)))
    for text, row in zip(texts, got, strict=True):
        words = re.findall("[^\x20\x09-\x0d]+", text)
        assert abs(row[0] - np.log1p(len(text.encode()))) < 1e-5 and abs(row[1] - np.log1p(len(words))) < 1e-5
        lower = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words]
        some = max(len(words), 1)
        at = 2 + quality._CLASSES - 1 + 1  # after the sizes, the classes and the share of capitals
        assert abs(row[at] - sum(len(w.encode()) for w in words) / some) < 1e-4
        assert abs(row[at + 2] - len(set(lower)) / some) < 1e-6
        assert abs(row[at + 3] - max([lower.count(w) for w in lower], default=0) / some) < 1e-6


def test_an_id_with_any_number_of_rows_teaches_within_the_bound(spark):
    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    forest = quality.fit(docs, labels, max_rows=20)
    assert len(forest.leaf) == quality.TREES
