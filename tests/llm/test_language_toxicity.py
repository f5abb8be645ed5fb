"""Language ID and toxicity: held-out accuracy, definite results on odd rows."""

from __future__ import annotations

import math
import random
import re
from itertools import product

import pytest
import zstandard
from pyspark.sql import functions as F

from slotflow.llm import language, toxicity
from slotflow.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_languages(tables):
    docs, _ = tables
    model = language.fit(docs)
    judged = docs.where(held_out(F.col("doc_id"))).select("lang", language.identify(F.col("text"), model).alias("r"))
    rows = judged.select("lang", "r.*").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert sum(r.accepted for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_smallest_encoding_wins(tables):
    model = language.fit(tables[0])
    judge = model.judge()
    text = tables[0].where("lang = 'fr'").first().text
    sizes = dict(zip(judge.names, judge.sizes(text)))
    assert judge(text)[0] == min(sizes, key=sizes.get)
    assert judge(text) == judge(text)


def test_language_of_odd_rows(spark, tables):
    model = language.fit(tables[0])
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the of and " * 60_000), (5, "x"), (None, "le la de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(9))
    got = frame.select("text", held_out(F.col("doc_id")).alias("h"), language.identify(F.col("text"), model).alias("r")).select("text", "h", "r.*").collect()
    for r in got[:3]:
        assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
    assert got[3].lang_pred == "en" and got[4].lang_pred in model.judge().names
    assert got[5].h is False


def test_no_labelled_languages(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert model.dictionaries == () and model.judge()("words")[0] == "und"
    assert empty.select(language.identify(F.col("text"), model)).collect() == []


def test_fits_are_bounded_and_whole(spark):
    """A hot key gives one text, a language of long texts alone gets its dictionary."""
    hot = [(0, f"the ship sails in the morning number {i}", "en") for i in range(500)]
    long = [(i, "das schiff fährt am morgen über den see " * 600, "de") for i in range(1, 40)]
    docs = spark.createDataFrame([*hot, *long], "doc_id long, text string, lang string")
    collected = []
    plain = language.divide

    def watched(texts, *rest):
        collected.append(len(texts))
        return plain(list(texts), *rest)

    language.divide = watched
    try:
        model = language.fit(docs, per_language=20, longest=1000)
    finally:
        language.divide = plain
    assert len(collected) == 2 and max(collected) <= 20
    ask = spark.createDataFrame([("am morgen fährt das schiff über den see",), ("the ship sails in the morning",)], "text string")
    assert [r.p for r in ask.select(language.identify(F.col("text"), model)["lang_pred"].alias("p")).collect()] == ["de", "en"]


def test_smallest_size_by_brute_force(spark, tables):
    """The language is that whose dictionary makes the text smallest, recounted with plain compressors."""
    docs, _ = tables
    model = language.fit(docs)
    rows = docs.where("text is not null").limit(40).select("text", language.identify(F.col("text"), model).alias("r")).collect()
    how = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
    )

    def size(data, content, head=b""):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(head + data))

    seen = set()
    for row in rows:
        data = " ".join(row.text.lower().split()).encode()
        totals = []
        for (name, content), leads in zip(model.dictionaries, model.leads):
            if len(data) <= 256:
                totals.append((sum(size(data, content, x) - size(b"", content, x) for x in leads), name))
            else:
                totals.append((sum(size(data[i : i + 4096], content) for i in range(0, len(data), 4096)), name))
        low = min(totals)[0]
        assert row.r.lang_pred in {name for total, name in totals if total == low}
        seen.add(row.r.lang_pred)
    assert len(seen) > 1


def test_narrow_margin_is_rejected():
    same = b"alpha beta gamma delta " * 40
    judge = language.LanguageModel((("a", same), ("b", same)), ((b"alpha beta ",), (b"alpha beta ",))).judge()
    name, score, margin, accepted = judge("alpha beta gamma")
    assert (name, margin, accepted) == ("a", 0.0, False) and score == pytest.approx(0.5)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_distances():
    terms = ["abcab", "abcba", "bacca", "cab", "aabbccaabb", "bcabcabcab"]
    lexicon = toxicity.FuzzyLexicon(terms)
    words = ["".join(w) for n in range(2, 7) for w in product("abc", repeat=n)]
    words += ["aabbccaabb", "aabccaabb", "abbccaab", "aabbxcaaybb", "bcabcabca", "bcabcabcabaa", "xbcabcabcabx", "bcacabcabxx"]
    for word in words:
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= toxicity.allowed_edits(t)]
        assert lexicon.nearest(word) == (min(near) if near else None), word


def test_automaton_forgets_states():
    lexicon = toxicity.FuzzyLexicon(["abcdefghij"])
    lexicon.MOST_STATES = 3
    for _ in range(3):
        assert lexicon.nearest("abcdefghij") == (0, "abcdefghij")
        assert lexicon.nearest("abxdefghi") == (2, "abcdefghij")
        assert lexicon.nearest("zzz") is None


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    judged = docs.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("toxic", toxicity.score(F.col("text"), model).alias("r"))
    rows = judged.select("toxic", "r.*").collect()
    found = [r.predicted for r in rows if r.toxic == 1]
    assert len(found) > 50 and sum(found) / len(found) > 0.9
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) / len(clean) < 0.01


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def brute_score(text, model):
    """Every word against every term, every quotation by scanning on, every window counted anew."""
    low, closing = text.lower(), {'"': '"', "“": "”", "«": "»", "„": "“”"}
    words = [(m.group(), m.start()) for m in re.finditer(r"[^\W_]+", low)]
    hits = {}
    for i, (word, _) in enumerate(words):
        near = sorted((edit_distance(word, t), t) for t in model.terms if edit_distance(word, t) <= (0 if len(t) < 5 else 1 if len(t) < 10 else 2))
        if near and word not in model.spared:
            hits[i] = near[0]
    inside, at = set(), 0
    while at < len(low):
        line = low[at:].split("\n")[0]
        ends = [line.index(c, 1) for c in closing.get(low[at], "") if c in line[1:]]
        if ends:
            inside.update(range(at, at + min(ends) + 1))
            at += min(ends)
        at += 1
    outright = fuzzy = quoted = best = 0.0
    n_quoted = 0
    for i, (edits, term) in hits.items():
        weight, reach = model.terms[term], model.window
        told = any(abs(j - i) <= reach and w in toxicity._REPORTING for j, (w, _) in enumerate(words))
        before, after = [j for j in hits if j < i], [j for j in hits if j > i]
        near = (bool(before) and i - before[-1] <= reach) + (bool(after) and after[0] - i <= reach)
        if words[i][1] in inside or told:
            quoted, n_quoted = quoted + weight, n_quoted + 1
        elif edits:
            fuzzy += weight / (1 + edits)
        else:
            outright += weight
            best = max(best, weight * (1 + near / 4))
    values = [math.log(1 + x) for x in (outright, fuzzy, quoted, best, 100 * len(hits) / max(1, len(words)))]
    z = model.coefficients[0] + sum(c * v for c, v in zip(model.coefficients[1:], values))
    score = 1 / (1 + math.exp(-max(-30, min(30, z))))
    return score, int(score >= model.threshold), len(hits), n_quoted


def test_score_by_brute_force(spark):
    rng = random.Random(21)
    terms = {"vile": 3.0, "rotten": 2.5, "scoundrel": 4.0, "wretchedness": 1.5}
    model = toxicity.ToxicityModel(terms, frozenset({"gotten"}), (-3.0, 1.5, 0.8, -0.7, 0.9, 0.4))
    pool = ["the", "boat", "Vile", "rotten", "rottn", "gotten", "scoundrl", "scoundrels", "wretchednss", "retchedness", "said", "wort", '"', "“", "”", "«", "»", "„", "\n", "été", "x_y", "7"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(300)] + [None, "", '"vile', "vile" * 400, 'he said "vile" and left']
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", toxicity.score(F.col("text"), model).alias("r")).collect()
    for row in got:
        want = brute_score(row.text or "", model)
        assert abs(row.r.score - want[0]) < 1e-9 and tuple(row.r)[1:] == want[1:], row.text
    assert len({r.r.predicted for r in got}) == 2


def test_quotation_and_spelling_weigh_less():
    model = toxicity.ToxicityModel({"scoundrel": 5.0}, frozenset({"scoundrels"}), (-3.0, 2.0, 1.0, 0.2, 1.0, 0.1))
    scorer = toxicity.ToxicityScorer(model)
    outright, misspelt = scorer("you are a scoundrel today"), scorer("you are a scoundral today")
    quoted, reported = scorer('he wore "you scoundrel" today'), scorer("they called him a scoundrel")
    clean = scorer("a fine day for all scoundrels")
    assert outright[0] > misspelt[0] > quoted[0] >= reported[0] > clean[0]
    assert misspelt[2] == 1 and quoted[3] == 1 and reported[3] == 1 and clean[2] == 0


def test_quotations_of_any_length():
    scorer = toxicity.ToxicityScorer(toxicity.ToxicityModel({"scoundrel": 5.0}))
    long = "plain " * 200
    for a, b in ('""', "“”", "«»", "„“", "„”"):
        assert scorer(f"{a}{long}scoundrel {long}{b} end")[2:] == (1, 1)
        assert scorer(f"{a}{long}{b} {long}scoundrel {long}{a}{long}{b}")[2:] == (1, 0)
        assert scorer(f"{a}{long}\nscoundrel {long}{b}")[2:] == (1, 0)
    # As a search from mark to mark finds them, and in one pass.
    plain = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")
    rng = random.Random(4)
    for _ in range(2_000):
        text = "".join(rng.choice('"“”«»„\nab') for _ in range(rng.randrange(30)))
        assert toxicity.quotations(text) == [m.span() for m in plain.finditer(text)], text
    assert toxicity.quotations("“«„" * 300_000) == [(2, 4)] + [(3 * i + 2, 3 * i + 4) for i in range(1, 299_999)]


def test_hits_of_a_text_are_kept_to_its_end():
    scorer = toxicity.ToxicityScorer(toxicity.ToxicityModel({"scoundrel": 5.0, "blackguard": 4.0, "ruffian": 3.0}))
    text = "scoundrel and blackguard and ruffian"
    want = scorer(text)
    scorer.MOST_TOKENS = 1
    assert want[2] == 3 and all(scorer(t) == want for t in (text, text, text))
    scorer.hits = {}
    assert scorer(text) == want


def test_toxicity_of_odd_rows(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels.unionByName(labels))
    rows = spark.createDataFrame([(None,), ("",), ("clean words " * 100_000,), ("moron " * 50_000,)], "text string")
    got = rows.withColumn("score", F.lit("clash")).select(toxicity.score(F.col("text"), model).alias("r")).select("r.*").collect()
    assert [r.predicted for r in got] == [0, 0, 0, 1] and all(0 <= r.score <= 1 for r in got)


def test_no_labels_at_all(spark, tables):
    empty = tables[1].limit(0)
    model = toxicity.fit(tables[0], empty)
    assert model.terms == {} and toxicity.ToxicityScorer(model)("moron")[1] == 0
    nulls = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.fit(tables[0], nulls).terms == {}
