"""Divergence audit, decontamination, lexical search: SQL twins, brute force, odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slotflow.llm import contamination, divergence, fptree
from slotflow.llm.queries import QUERIES, SQL
from slotflow.llm.words import Words
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def terms_of(text, digits):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@given(st.text(st.characters(codec="utf-8"), max_size=40), st.booleans())
@settings(max_examples=300, deadline=None)
def test_words_are_pattern_matches(text, digits):
    split, data = Words(digits), text.encode()
    assert [w.decode() for w in split(data)] == terms_of(text, digits)
    assert [data[a:b].decode().lower() for a, b in split.places(data)] == [w.lower() for w in terms_of(text, digits)]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_decontamination", "op13_lexical_search"])
def test_like_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF) == []


# --- 11 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 5000])
def test_perfect_hash_is_minimal(n):
    keys = [f"t{i}".encode() for i in range(n)]
    seed, moves, slots = divergence.displaced(keys)
    assert sorted(slots) == list(range(n))
    held = divergence.Shards([(b"en", 1, 0, seed, moves, [keys[i] for i in np.argsort(slots)])])
    assert sorted(held.slots(b"en", keys).tolist()) == list(range(n))
    assert set(held.slots(b"en", [f"x{i}".encode() for i in range(1000)]).tolist()) == {-1} == set(held.slots(b"de", keys).tolist())


def test_shards_with_seeds_and_gaps():
    keys, rows = [f"t{i}".encode() for i in range(900)], []
    for shard in (0, 2, 3):  # shard 1 is in another volume
        own = [k for k in keys if crc32(k) % 4 == shard]
        plain = divergence._mixed
        if shard == 2:  # as if the first seeds had failed
            divergence._mixed = lambda term, seed: plain(term, seed) if seed >= 3 else 5
        try:
            seed, moves, slots = divergence.displaced(own)
        finally:
            divergence._mixed = plain
        assert seed == (3 if shard == 2 else 0)
        rows.append((b"en", 4, shard, seed, moves, [own[i] for i in np.argsort(slots)]))
    held = divergence.Shards(rows[::-1])
    got = dict(zip(keys, held.slots(b"en", keys).tolist()))
    assert sorted(s for s in got.values() if s >= 0) == list(range(held.size[b"en"]))
    assert {k for k, s in got.items() if s < 0} == {k for k in keys if crc32(k) % 4 == 1}


def brute_audit(rows, least, ranks):
    rows = [(t or "", a or "", b or "") for t, a, b in rows]
    seen, count, groups = {}, {}, {}
    for text, lang, source in rows:
        words = terms_of(text, False)
        seen.setdefault(lang, Counter()).update(set(words))
        count.setdefault((lang, source), Counter()).update(words)
        groups.setdefault(lang, set()).add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = sum((count[lang, s] for s in sources), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = share(whole)
        for s in sources:
            p = share(count[lang, s])
            pairs = sorted((-sum(abs(p[t] - o[t]) for t in kept), x.encode(), x) for x in sources - {s} for o in [share(count[lang, x])])
            over = sorted((q[t] - p[t], t.encode(), t) for t in kept if count[lang, s][t] and p[t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", over)):
                out += [(lang, s, part, x, -v, i + 1) for i, (v, _, x) in enumerate(found)]
    return sorted(out)


def test_audit_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "γάμμα", "delta", "épsilon", "x1y", "zeta"]
    rows = [(" ".join(rng.choices(words, weights=[9, 5, 4, 3, 2, 1, 1], k=rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", "z", None])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "xx", "a"), ("lonely", "xx", "b"), (None, None, None)] + [("alpha alpha", "en", "hot")] * 200
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, shard int, p int")
    want = brute_audit(rows, 30, 3)
    for how in ({}, {"volume_bytes": 200, "shard_keys": 2, "held_slots": 4, "sources": 2}):
        got = sorted(tuple(r) for r in divergence.audit(docs, ranks=3, **how).collect())
        assert got == want
    assert divergence.audit(docs.limit(0)).collect() == []


# --- 12 ----------------------------------------------------------------------------------------


def brute_hits(text, items, length):
    words, hit, named = terms_of(text, True), set(), set()
    for name, item in items:
        own = terms_of(item, True)
        k = min(length, len(own))
        for j in range(len(own) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == own[j : j + k]:
                    hit.update(range(i, i + k))
                    named.add(name)
    return len(words), len(hit), sorted(str(n) for n in named if n is not None)


@given(st.lists(st.text("ab c", max_size=24), max_size=6), st.text("ab c", max_size=60), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_automaton_against_brute_force(items, text, length):
    split = Words(True)
    named = list(enumerate(items))
    automaton = contamination.Automaton([(str(i), split(t.encode())) for i, t in named if split(t.encode())], length)
    words = split(text.encode())
    flags, states = automaton.scan(words) or (b"", set())
    assert (len(words), sum(flags), automaton.names(states)) == brute_hits(text, named, length)


def contaminated(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "Straße"]
    long = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 11, 40, 90]))) for _ in range(30)]
    items = [*enumerate(long), (3, "other words under a known key"), (None, "an item without any key at all is not named here"), (40, None), (41, ""), (42, "?!"), (43, long[5])]
    texts = [None, "", " .,", "W0"]
    for _ in range(60):
        own = rng.choice(long).split()
        cut = own[rng.randrange(max(1, len(own) // 2)) :]
        texts.append(", ".join([*rng.choices(vocabulary, k=rng.randrange(20)), *cut, *rng.choices(vocabulary, k=5)]).upper())
    texts += [texts[10]] * 50 + ["An item WITHOUT any key at all -- is not named here, or is it"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, found string, __h1 int")
    return docs, spark.createDataFrame(items, "item_id long, text string"), items, texts


@pytest.mark.parametrize("how", [{}, {"block_bytes": 300, "piece_words": 7}])
def test_hits_against_brute_force(spark, how):
    docs, known, items, texts = contaminated(spark)
    got = contamination.occurrences(docs, known, out="hits", **how)
    assert got.columns == [*docs.columns, "hits"]
    rows = {r["doc_id"]: r["hits"] for r in got.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        found = rows[i]
        # ASCII letters alone are lowered, and these items stay lower-cased: other letters are as they are.
        assert (found["n_words"], found["n_hit"], list(found["items"])) == brute_hits(text, items, 10), text
        assert sum(s["end"] - s["begin"] for s in found["spans"]) == found["n_hit"]


def test_passages_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before it. {item.title()}! After it, été, and much more to keep the share of it small", item, "clean", None, "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["cut"]) for r in contamination.decontaminate(docs, known, removed="cut").collect()}
    assert got == {0: ("Before it. ! After it, été, and much more to keep the share of it small", 11), 2: ("clean", 0), 3: (None, 0), 4: ("one two three", 0)}
    assert contamination.decontaminate(docs, known.limit(0)).count() == 5 and contamination.decontaminate(docs.limit(0), known).count() == 0


# --- 13 ----------------------------------------------------------------------------------------


def brute_search(docs, items, k):
    bags = [(key, Counter(terms_of(t, True))) for key, t in docs]
    bags = [(key, c) for key, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c in bags:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text, True)) if c[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("shape", ["one tree", "many trees", "blocks"])
def test_search_against_brute_force(spark, monkeypatch, shape):
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i % 180, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(30)))) for i in range(240)]
    docs += [(1000 + i, "t1 t2 t3 T1") for i in range(100)] + [(None, "t1 t2 t3 t1"), (None, "t9"), (500, None), (501, ""), (502, "...")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(20)] + [(7, "t1 t2"), (7, "t1 t2"), (90, None), (91, ""), (92, "unseen"), (None, "t1 t5")]
    if shape == "many trees":
        monkeypatch.setattr(fptree, "TREE", 20)
        monkeypatch.setattr(fptree, "LEAF", 2)
        monkeypatch.setattr(fptree, "DEPTH", 3)
    if shape == "blocks":
        monkeypatch.setattr(fptree, "ITEMS", 5)
    table = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, item int, terms string")
    known = spark.createDataFrame(items, "item_id long, text string")
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in fptree.top_documents(table, known, k=7).collect()), key=order)
    assert got == sorted(brute_search(docs, items, 7), key=order)
    assert fptree.top_documents(table.limit(0), known).collect() == [] == fptree.top_documents(table, known.limit(0)).collect()


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    df = np.sort(rng.integers(1, 400, 80))[::-1].copy()
    plan = fptree.Plan.of([sorted(rng.choice(80, 6, replace=False).tolist()) for _ in range(5)], df, 500, 3)
    held = {}
    for i in range(500):
        own = np.sort(plan.place[rng.choice(80, rng.integers(1, 20), replace=False)]).astype(np.int64)
        held.setdefault((own.tobytes(), rng.integers(1, 5, len(own)).tobytes(), int(rng.integers(50, 300))), []).append(i)
    docs = [(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), m, keys) for (a, b, m), keys in held.items()]
    tree, best, leaves = fptree.Tree(docs, 80), fptree.Best(plan), []
    leaf = best._leaf
    best._leaf = lambda tree, begin, end, open_: (leaves.append((end - begin) * len(open_)), leaf(tree, begin, end, open_))
    best.search(tree)
    every = plan.sums(plan.worth(tree.dense(0, len(tree.docs)), tree.m), np.arange(5))
    for item in range(5):
        rank = sorted((-int(s), tree.docs[i][3][0]) for i, s in enumerate(every[:, item]) if s > 0)[:3]
        assert [(-s, k[0]) for j, s, k in best.rows if j == item] == [(a, b) for a, b in rank]
    assert sum(leaves) < 0.9 * 5 * len(docs)
