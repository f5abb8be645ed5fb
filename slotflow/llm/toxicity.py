"""Toxicity from a learned lexicon, found through misspellings, weighed by context.

The lexicon (terms with weights) is a trie. Intersected with the Levenshtein automata of its
terms it becomes one automaton that accepts every term within the allowed edits; its
deterministic states are made when a token first needs them. Each match is weighed by its
context window: a term inside quotation marks or beside reporting words counts apart from
one used outright, and matches close together raise each other. A logistic regression on
these window scores gives the score of a text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotflow.llm.common import learnable, only

RESULT = "score double, predicted int, n_terms int, n_quoted int"
_TOKEN = re.compile(r"[^\W_]+")
_MARK = re.compile(r"[\"“”«»„\n]")
_CLOSING = {'"': '"', "“": "”", "«": "»", "„": "“”"}
_REPORTING = frozenset(
    "said says quote quoted quotes wrote called word term slur cited reported "
    "sagte schrieb zitat zitiert nannte wort dit écrit citation cité mot dijo escribió cita citado palabra".split()
)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations of any length within a line: from a mark to the next that closes it, leftmost first."""
    marks = [(m.group(), m.start()) for m in _MARK.finditer(text)]
    closed: list[int | None] = [None] * len(marks)
    following: dict[str, int] = {}  # the next mark of each kind in the line
    for i in range(len(marks) - 1, -1, -1):
        mark = marks[i][0]
        if mark == "\n":
            following = {}
            continue
        closed[i] = min((following[c] for c in _CLOSING.get(mark, "") if c in following), default=None)
        following[mark] = i
    spans, i = [], 0
    while i < len(marks):
        end = closed[i]
        if end is not None:
            spans.append((marks[i][1], marks[end][1] + 1))
        i = i + 1 if end is None else end + 1
    return spans


def allowed_edits(term: str) -> int:
    """Short terms have too many neighbours that are other words."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class FuzzyLexicon:
    """The trie of the terms intersected with their Levenshtein automata.

    A state is a set of (trie node, edits so far); ``nearest`` walks a token through states
    and gives the closest term it is allowed to stand for.
    """

    MOST_STATES = 20_000  # memory of made states; beyond it they are made anew

    def __init__(self, terms: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.limit = [0]  # most edits that any term below a node allows
        for term in sorted(terms):
            node, edits = 0, allowed_edits(term)
            self.limit[0] = max(self.limit[0], edits)
            for letter in term:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.limit.append(0)
                node = self.next[node][letter]
                self.limit[node] = max(self.limit[node], edits)
            self.term[node] = term
        self._forget()

    def _forget(self) -> None:
        self._number: dict[frozenset[tuple[int, int]], int] = {}
        self._places: list[frozenset[tuple[int, int]]] = []
        self._moves: list[dict[str, int]] = []
        self._ends: list[tuple[int, str] | None] = []
        self._start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The state of these positions and those reached from them by leaving out letters."""
        todo = list(least)
        while todo:
            node = todo.pop()
            edits = least[node] + 1
            for child in self.next[node].values():
                if edits <= self.limit[child] and edits < least.get(child, 99):
                    least[child] = edits
                    todo.append(child)
        places = frozenset(least.items())
        if places not in self._number:
            ends = [(e, self.term[n]) for n, e in places if self.term[n] is not None and e <= allowed_edits(self.term[n])]
            self._number[places] = len(self._places)
            self._places.append(places)
            self._moves.append({})
            self._ends.append(min(ends) if ends else None)
        return self._number[places]

    def _step(self, state: int, letter: str) -> int:
        least: dict[int, int] = {}
        for node, edits in self._places[state]:
            same = self.next[node].get(letter)
            if same is not None and edits < least.get(same, 99):
                least[same] = edits
            if edits < self.limit[node]:
                if edits + 1 < least.get(node, 99):
                    least[node] = edits + 1  # a letter too many
                for child in self.next[node].values():
                    if edits < self.limit[child] and edits + 1 < least.get(child, 99):
                        least[child] = edits + 1  # another letter
        return self._state(least) if least else -1

    def nearest(self, token: str) -> tuple[int, str] | None:
        """(edits, term) of the closest term, the first of equally close ones; None if there is none."""
        if len(self._places) > self.MOST_STATES:
            self._forget()
        state = self._start
        for letter in token:
            found = self._moves[state].get(letter)
            if found is None:
                found = self._moves[state][letter] = self._step(state, letter)
            if found < 0:
                return None
            state = found
        return self._ends[state]


@dataclass(frozen=True)
class ToxicityModel:
    """Term weights, words that only look like terms, and the regression."""

    terms: dict[str, float] = field(default_factory=dict)
    spared: frozenset[str] = frozenset()
    coefficients: tuple[float, ...] = (-6.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    threshold: float = 0.3
    window: int = 8  # tokens on either side


class ToxicityScorer:
    """The model's automaton and memory of tokens; one per task."""

    MOST_TOKENS = 200_000

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.lexicon = FuzzyLexicon(model.terms)
        self.misses: set[str] = set()
        self.hits: dict[str, tuple[int, str]] = {}

    def matches(self, words: list[str]) -> bool:
        """Whether a term may be among the words; every unseen word goes through the automaton."""
        distinct = set(words)
        unseen = distinct - self.misses
        if len(self.misses) > self.MOST_TOKENS:
            self.misses = set()
        if len(self.hits) > self.MOST_TOKENS:
            self.hits = {}
        found = False
        for word in unseen:
            hit = self.hits.get(word)
            if hit is None and word not in self.model.spared:
                hit = self.lexicon.nearest(word)
            if hit is None:
                self.misses.add(word)
            else:
                found = True
                self.hits[word] = hit
        return found

    def features(self, text: str) -> tuple[list[float], int, int]:
        """Window scores of the whole text, its number of terms, and how many of them are quoted."""
        if not self.model.terms or not self.matches(tokens(text)):
            return [0.0] * 5, 0, 0
        low = text.lower()
        words = [(m.group(), m.start()) for m in _TOKEN.finditer(low)]
        spans = quotations(low)
        outright = fuzzy = quoted = best = 0.0
        n_quoted = last = span = 0
        places = [i for i, (w, _) in enumerate(words) if w in self.hits]
        reach = self.model.window
        for k, i in enumerate(places):
            word, at = words[i]
            edits, term = self.hits[word]
            weight = self.model.terms[term]
            while span < len(spans) and spans[span][1] <= at:
                span += 1
            marked = span < len(spans) and spans[span][0] <= at
            reported = any(w in _REPORTING for w, _ in words[max(0, i - reach) : i + reach + 1])
            near = (k > 0 and i - last <= reach) + (k + 1 < len(places) and places[k + 1] - i <= reach)
            last = i
            if marked or reported:
                quoted += weight
                n_quoted += 1
            elif edits:
                fuzzy += weight / (1 + edits)
            else:
                outright += weight
                best = max(best, weight * (1 + 0.25 * near))
        return [math.log1p(outright), math.log1p(fuzzy), math.log1p(quoted), math.log1p(best), math.log1p(100 * len(places) / max(1, len(words)))], len(places), n_quoted

    def __call__(self, text: str | None) -> tuple[float, int, int, int]:
        values, n_terms, n_quoted = self.features(text or "")
        z = self.model.coefficients[0] + sum(c * v for c, v in zip(self.model.coefficients[1:], values))
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return score, int(score >= self.model.threshold), n_terms, n_quoted


def regression(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression with an intercept by Newton's method; the intercept is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    toxic_rows: int = 4_000,
    clean_rows: int = 12_000,
    longest: int = 50_000,
    least_uses: int = 4,
    most_terms: int = 2_000,
    threshold: float = 0.3,
) -> ToxicityModel:
    """A model from at most ``toxic_rows`` and ``clean_rows`` labelled, learnable documents.

    They are those with the smallest key hashes; texts over ``longest`` characters are not
    learned from, and equal texts count once. A key with several labels is toxic if one of
    them is; of its texts the first in order counts, so that as many texts as keys at most
    leave the executors. A text counts once for each of its words, by the neighbours of the word's first
    use; equal neighbours count once, so that copies of one text do not make its words terms.
    A term is a word with at least ``least_uses`` such uses in toxic texts, and at least twenty
    times as large a share of them as in clean ones. No labels of either kind: a model without
    terms, which scores every text low.
    """
    marks = (
        only(labels, key=key, toxic=label)
        .where(F.col("key").isNotNull() & F.col("toxic").isin(0, 1) & learnable(F.col("key")))
        .groupBy("key")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("key"), "key"]
    picked = (
        marks.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(marks.where("toxic = 0").orderBy(*order).limit(clean_rows))
    )
    # At most toxic_rows + clean_rows keys.
    sample = (
        only(docs, key=key, text=text)
        .where((F.length("text") <= longest) & (F.length("text") > 0))
        .join(F.broadcast(picked), "key")
        .groupBy("key")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"))
        .persist()
    )

    def word_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uses: set[tuple[str, int, int]] = set()
            for value, toxic in zip(batch.column(0), batch.column(1)):
                words = tokens(value.as_py())
                mark, count = toxic.as_py(), len(words)
                first = {w: i for i, w in zip(range(count - 1, -1, -1), reversed(words))}
                for word, i in first.items():
                    before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < count else ""
                    uses.add((word, crc32(f"{before} {after}".encode()), mark))
            columns = list(zip(*uses)) if uses else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["word", "context", "toxic"])

    held = [sample]
    try:
        uses = sample.mapInArrow(word_uses, "word string, context long, toxic int").distinct()
        counted = uses.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        held.append(counted := counted.persist())
        total = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
        if not total or not total.bad or not total.good:
            return ToxicityModel(threshold=threshold)
        weight = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5) * (total.good / total.bad))
        chosen = (
            counted.withColumn("weight", weight)
            .where((F.col("bad") >= least_uses) & (F.col("weight") >= math.log(20)))
            .orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "word")
            .limit(most_terms)
            .collect()
        )
        terms = {row.word: float(row.weight) for row in chosen}
        if not terms:
            return ToxicityModel(threshold=threshold)
        spared = _lookalikes(counted, terms)
        model = ToxicityModel(terms, spared, threshold=threshold)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = ToxicityScorer(model)
            for batch in batches:
                rows = [scorer.features(t.as_py())[0] for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["values", "toxic"])

        rows = sample.mapInArrow(measured, "values array<double>, toxic int").collect()
    finally:
        for frame in held:
            frame.unpersist()
    x, y = np.array([r["values"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)
    return ToxicityModel(terms, spared, regression(x, y), threshold)


def _lookalikes(counted: DataFrame, terms: dict[str, float]) -> frozenset[str]:
    """Words near a term that clean texts use in their own right; all of them, out of the sample's words."""

    @F.arrow_udf("boolean")
    def near_a_term(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = FuzzyLexicon(terms)
        for batch in batches:
            yield pa.array([w.as_py() not in terms and lexicon.nearest(w.as_py()) is not None for w in batch], pa.bool_())

    own = counted.where("good >= 2 and good >= bad").where(near_a_term("word"))
    return frozenset(row.word for row in own.select("word").collect())


def score(text: Column, model: ToxicityModel) -> Column:
    """``score`` (0 to 1), ``predicted`` (score at least the threshold), ``n_terms``, ``n_quoted``.

    NULL and empty texts have no terms and get the score of a text without any. Texts of any
    length are read whole; repeated rows get equal scores.
    """

    @F.arrow_udf(RESULT)
    def judge_toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = ToxicityScorer(model)
        for batch in batches:
            found = [scorer(t.as_py()) for t in batch]
            columns = list(zip(*found)) if found else ((), (), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(columns[0], pa.float64()), *(pa.array(c, pa.int32()) for c in columns[1:])],
                ["score", "predicted", "n_terms", "n_quoted"],
            )

    return judge_toxicity(text)
