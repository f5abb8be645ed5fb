"""Line dedup, SimHash, components, packing: brute force, SQL twins, odd rows."""

from __future__ import annotations

import random
from itertools import combinations
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slotflow.llm import lines, packing, simhash
from slotflow.llm.components import components
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i + 1000, i + 1001) for i in range(40)] + [(2000, i) for i in range(2001, 2100)]
    links = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    want = roots({n for p in pairs for n in p}, pairs)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(links.limit(0)).collect() == []


def test_lines_like_sql(spark):
    def run(spark, sf_dir):
        return lines.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), removed="n_removed")

    assert compare(spark, connect(SF), "lines", run, lines.SQL, SF) == []


def test_lines_of_repeated_keys_like_sql(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.choice([1, 2, 3, None]), "\n".join(rng.choices(["a", "b", " c", "", "d"], k=rng.randrange(14)))) for _ in range(120)]
    rows += [(7, "p\nq\nr"), (7, "p\nq\nr\ns"), (7, "o\np\nq\nr"), (7, "p\nq\nr")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, __key2 int, __hash2 string, __cut string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")

    def run(spark, sf_dir):
        read = spark.read.parquet(f"{sf_dir}/documents.parquet")
        assert lines.dedup_lines(read).columns == read.columns
        return lines.dedup_lines(read, removed="n_removed").select("doc_id", "text", "n_removed")

    assert compare(spark, con, "lines", run, lines.SQL, str(tmp_path)) == []


def test_lines_by_hand(spark):
    rows = [
        (1, "a\nb\nc\nd"),
        (2, "x\na\n\n b \nc\ny"),  # blank lines and margins do not hide a window
        (3, "b\nc\nd\ne"),
        (4, "a\na\na\na\na"),
        (5, "a\nb"),
        (6, None),
        (7, ""),
        (None, "b\nc\nd"),
        (1, "a\nb\nc\nd"),  # the same document again
    ]
    docs = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, __key string, removed int")
    got = lines.dedup_lines(docs, removed="n").collect()
    assert sorted((r.doc_id or 99, r.text or "", r.n) for r in got) == sorted(
        [(1, "a\nb\nc\nd", 0), (2, "x\ny", 4), (3, "e", 3), (4, "a\na\na\na\na"[:0] + "a", 4), (5, "a\nb", 0), (6, "", 0), (7, "", 0), (99, "", 3), (1, "a\nb\nc\nd", 0)]
    )
    assert next(r for r in got if r.doc_id == 6).text is None
    assert got[0].asDict().keys() == {"doc_id", "text", "__key", "removed", "n"}
    assert lines.dedup_lines(docs.limit(0)).collect() == []


def test_spans_of_a_hot_row_are_held_once(spark, monkeypatch):
    rows = [(1, "a\nb\nc\nd"), *[(7, "a\nb\nc\nd\ne")] * 400, *[(None, "x\na\nb\nc")] * 400]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {(r.doc_id, r.text, r.n) for r in lines.dedup_lines(docs, removed="n").collect()}
    assert got == {(1, "a\nb\nc\nd", 0), (7, "e", 4), (None, "x", 3)}
    assert lines.dedup_lines(docs).count() == len(rows)
    # What is joined back to each copy: as many spans as the text has repeated windows.
    monkeypatch.setattr(lines, "_without", lambda text, spans: F.struct(text.alias("text"), F.coalesce(F.size(spans), F.lit(0)).alias("lines")))
    assert {(r.doc_id, r.n) for r in lines.dedup_lines(docs, removed="n").collect()} == {(1, 0), (7, 2), (None, 1)}


def test_every_removed_line_stays_somewhere(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))) for i in range(200)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    before, after = {x for _, t in rows for x in t.split("\n")}, {x for r in got for x in r.text.split("\n")}
    assert before <= after


def plain_simhash(text, shingle=4):
    table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    words = (text or "").encode().translate(table).split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    count = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for bit in range(64):
            count[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * count[bit] > len(parts))


def test_triples_cover_every_four_positions():
    family = simhash.triples()
    assert len(family) == 20 and all(any(set(t) <= set(f) for t in family) for f in combinations(range(8), 4))


@pytest.mark.parametrize("limit", [simhash.LONGEST_POSTING, 3])
def test_simhash_against_all_pairs(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split() * 30
    near = [(10_000 + i, " ".join(w if rng.random() > 0.004 else f"w{rng.randrange(9)}" for w in base)) for i in range(120)]
    odd = [(20_000, None), (20_001, ""), (20_002, " \t\n"), (20_003, "É A"), (20_003, "É a"), (20_004, "long " * 150_000)]
    docs = docs.unionByName(spark.createDataFrame(near + odd, "doc_id long, text string")).withColumn("component_id", F.lit("clash")).withColumn("print", F.lit(1))
    got = simhash.near_duplicates(docs, longest_posting=limit).collect()
    source = docs.collect()
    prints = {}
    for r in source:
        prints.setdefault(r.doc_id, plain_simhash(r.text))
    assert len(got) == len(source) and all(int(r.fingerprint, 16) == prints[r.doc_id] for r in got)
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(prints, links)
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_crowded_links_exactly(spark, bits):
    rng = random.Random(bits)
    codes, rows = [0, (1 << 63)], []
    while len(codes) < 60:
        x = rng.choice(codes)
        for _ in range(rng.randrange(0, 6)):
            x ^= 1 << rng.randrange(64)
        codes.append(x)
    codes = sorted(set(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = [(s, i) for i, s in enumerate(signed)]
    got = simhash._crowded(spark.createDataFrame(rows, "print long, node long"), bits).collect()
    links = [(i, j) for i, j in combinations(range(len(codes)), 2) if (codes[i] ^ codes[j]).bit_count() <= bits]
    assert roots(range(len(codes)), [(r.a, r.b) for r in got]) == roots(range(len(codes)), links)


def test_simhash_without_keys_or_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "other words stand here now"), (7, "a b c d e"), (8, "x"), (8, "x"), (9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 7), (0, 7), (7, 7), (8, 8), (8, 8), (9, 8)]
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_first(docs).collect()) == [(0, "other words stand here now"), (7, "a b c d e"), (8, "x")]
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_first(docs.limit(0)).collect() == []


def test_simhash_links_rows_without_keys(spark):
    rng = random.Random(2)
    rows = []
    for group, keyless in enumerate((0.5, 0.9, 1.0)):
        base = [f"g{group}w{i % 14}" for i in range(420)]
        rows += [(None if rng.random() < keyless else 1000 * group + i + 1, " ".join(w if rng.random() > 0.004 else f"x{rng.randrange(9)}" for w in base)) for i in range(40)]
    prints = [plain_simhash(t) for _, t in rows]
    near = lambda some: [(i, j) for i, j in combinations(some, 2) if (prints[i] ^ prints[j]).bit_count() <= 4 or rows[i][0] is not None and rows[i][0] == rows[j][0]]
    up = roots(range(len(rows)), near(range(len(rows))))
    least = {}
    for i, (key, _) in enumerate(rows):
        least[up[i]] = min(least.get(up[i], float("inf")), float("inf") if key is None else key)
    keyed = [i for i, (key, _) in enumerate(rows) if key is not None]
    alone = roots(keyed, near(keyed))
    # Some components hold no key, some hold keyless rows, and some keyed rows meet through a keyless one only.
    assert float("inf") in least.values() and len({alone[i] for i in keyed}) > len({up[i] for i in keyed})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = sorted((key or -1, p, -1 if least[up[i]] == float("inf") else least[up[i]]) for i, ((key, _), p) in enumerate(zip(rows, prints)))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, int(r.fingerprint, 16), -1 if r.component_id is None else r.component_id) for r in got) == want
    kept = sorted((r.doc_id or -1, plain_simhash(r.text)) for r in simhash.keep_first(docs).collect())
    first = {c: min((prints[i] for i in up if up[i] == c), key=signed) for c in least}
    assert kept == sorted((-1, first[c]) if k == float("inf") else (k, next(prints[i] for i in keyed if rows[i][0] == k)) for c, k in least.items())


@pytest.fixture(scope="module")
def words():
    return packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aZé'stll 0.,!\t\n\x0b\x1c\x85\xa0µºªß×÷<|endoftext|>", max_size=40), st.sampled_from(["<|endoftext|>", "a<|startoftext|>b", "I'LL don't", "é"])), max_size=4))
def test_ids_are_the_tokenizers(words, texts):
    fast, whole = words
    assert [np.frombuffer(x, "<u4").tolist() for x in fast(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_parts_are_forgotten(words):
    fast = packing.WordTokenizer(PATH)
    fast.MOST_PARTS = 2
    texts = ["some words here", "and others there", "some words here"]
    assert list(fast(texts, together=1)) == list(words[0](texts))


def plain_sum_of_squares(lengths, size):
    gaps, out, filled = [], [], []
    for s in lengths:
        options = []
        for gap in sorted({g for g in gaps if s <= g < size}):
            after = [g for g in gaps]
            after.remove(gap)
            options.append((sum(after.count(g) ** 2 for g in set(after + [gap - s]) if g) + (0 if gap == s else 2 * after.count(gap - s) + 1), gap))
        new = sum(gaps.count(g) ** 2 for g in set(gaps) if g) + (0 if size == s else 2 * gaps.count(size - s) + 1)
        options.append((new, size))
        gap = min(options)[1]
        if gap != size:
            gaps.remove(gap)
        if gap > s:
            gaps.append(gap - s)
        filled.append(gap)
        out.append(gap)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares_against_its_definition(lengths):
    bins, offsets, filled = packing.sum_of_squares(np.array(lengths, dtype=np.int64), 12)
    gaps = [12 - int(o) for o in offsets]
    # The true sum of squares after each choice; a plain search makes the same choices.
    assert gaps == plain_sum_of_squares(lengths, 12)
    for b in range(len(filled)):
        own = [i for i in range(len(lengths)) if bins[i] == b]
        at = 0
        for i in own:
            assert offsets[i] == at
            at += lengths[i]
        assert at == filled[b] <= 12


@pytest.mark.parametrize("shard", [32_768, 60])
def test_packing_whole(spark, words, shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(90_000, None), (90_001, ""), (90_002, "word " * 70_000), (None, "no key"), (90_003, "twice"), (90_003, "twice")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("length", F.lit("clash"))
    rows = packing.pack(packing.pieces(docs, PATH), shard=shard).collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, [*words[1].encode(r.text or "", add_special_tokens=False).ids, 0])
    by_sequence, by_doc = {}, {}
    for r in rows:
        part = np.array(ids[r.key][r.start : r.start + r.length], dtype="<u4")
        assert crc32(part.tobytes()) == r.ids_crc32 and (r.length == 2048 or r.start + r.length == len(ids[r.key]))
        assert r.start == 2048 * r.piece
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc[r.key] = by_doc.get(r.key, 0) + r.length
    assert by_doc == {k: len(v) * (2 if k == 90_003 else 1) for k, v in ids.items()}
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.05 * (sum(r.length for r in rows) / 2048) + 2


def test_pieces_that_fill_nothing(spark):
    rows = [(i, 0, 0, 1500 if i % 2 else 1501, 7) for i in range(200)]
    cut = spark.createDataFrame(rows, packing._PIECES)
    got = packing.pack(cut, shard=20).collect()
    assert len(got) == 200 == len({r.sequence_id for r in got}) and all(r.offset == 0 for r in got)


def test_packing_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty, PATH)).collect() == []
