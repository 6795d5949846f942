"""Toxicity: misspelled lexicon terms by a Levenshtein automaton over a trie, scored in context.

Training mines the lexicon from labelled documents and fits a small logistic model on what the terms
do in their contexts. Scoring reads each text once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from condensa.llm.common import known_labels, map_texts
from condensa.session import materialize

#: Labelled documents of a class that training reads at most, taken by a hash of the key.
TRAINING_DOCS = 6000
#: Terms of the lexicon at most, the strongest first.
LEXICON_TERMS = 500
#: A term needs this share of the toxic training documents' contexts, and this odds ratio.
LEAST_SHARE, LEAST_CONTEXTS, LEAST_ODDS = 0.01, 4, 20.0
#: Tokens on either side that decide whether a term is quoted or addressed to someone.
WINDOW = 5
THRESHOLD = 0.7
#: Texts that are taken out of a batch together.
TOGETHER = 1000

#: Look-alike characters, quotation marks and words around quotation or address.
LOOK_ALIKE = str.maketrans("013457@$", "oieastas")
OPENING, CLOSING = "\"'«“„‘‚", "\"'»”“’‘"
REPORTING = frozenset(
    "said says called calls quote quoted word term insult slur wrote dijo palabra dit mot sagte wort".split()
)
ADDRESS = frozenset("you your you're u ur du dich dein ihr tu te toi vous tú usted eres are".split())

EDGE = re.compile(r"\A[\W_]+|[\W_]+\Z")
FEATURES = ("plain", "misspelled", "quoted", "addressed", "share")


def core(token: str) -> str:
    """A token in lower case without marks at its ends, look-alike characters made letters."""
    bare = EDGE.sub("", token.lower())
    return bare if bare.isalpha() else bare.translate(LOOK_ALIKE)


def allowed_edits(term: str) -> int:
    """Short terms have to be spelled right, long ones may differ by two edits."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class TermAutomaton:
    """Accepts the strings within each term's allowed edits of a term.

    The terms are a trie. A state is the set of (trie node, fewest edits) that what was read so far
    may have led to: the Levenshtein automata of all terms, run together on the trie. States and
    their steps are made when they are first needed and remembered, up to `most_states`, so a token
    costs about one look-up a character.
    """

    def __init__(self, terms: Iterable[str], most_states: int = 20_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most: list[int] = [0]  # edits allowed to any term below a node
        self.most_states = most_states
        for term in sorted(set(terms)):
            node, edits = 0, allowed_edits(term)
            self.most[0] = max(self.most[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], edits)
            self.term[node] = term
        self._restart()

    def _restart(self) -> None:
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.start = self._state({0: 0})

    def _state(self, spots: dict[int, int]) -> int:
        """The state of these spots and of those that leaving out letters leads to; -1 for none."""
        waiting = list(spots.items())
        while waiting:
            node, edits = waiting.pop()
            if edits > spots.get(node, edits):
                continue
            for child in self.children[node].values():
                if edits < self.most[child] and edits + 1 < spots.get(child, 99):
                    spots[child] = edits + 1
                    waiting.append((child, edits + 1))
        if not spots:
            return -1
        key = frozenset(spots.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [
                (edits, self.term[node])
                for node, edits in spots.items()
                if self.term[node] is not None and edits <= allowed_edits(self.term[node])
            ]
            best = min(ends, default=None)
            self.found.append((best[1], best[0]) if best else None)
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        spots: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.most[node] and edits < spots.get(node, 99):
                spots[node] = edits

        for node, edits in self.sets[state]:
            reach(node, edits + 1)
            for label, child in self.children[node].items():
                reach(child, edits + (label != letter))
        return self._state(spots)

    def match(self, token: str) -> tuple[str, int] | None:
        """The nearest term within its edits, ties in order of the alphabet, and the edits."""
        if len(self.sets) > self.most_states:
            self._restart()
        state = self.start
        for letter in token:
            following = self.steps[state].get(letter)
            if following is None:
                following = self.steps[state][letter] = self._step(state, letter)
            if following < 0:
                return None
            state = following
        return self.found[state]


class Model(NamedTuple):
    terms: tuple[str, ...]
    ordinary: frozenset[str]  # clean words that are near a term by chance
    weights: tuple[float, ...]  # of the features, then the constant


class Scanner:
    """Finds the terms of a text, and what their contexts make of them."""

    def __init__(self, terms: Iterable[str], ordinary: frozenset[str], kept: int = 100_000):
        self.automaton, self.ordinary, self.kept = TermAutomaton(terms), ordinary, kept
        self.cache: dict[str, tuple[str, int] | int] = {}

    def _look(self, token: str) -> tuple[str, int] | int:
        bare = core(token)
        found = self.automaton.match(bare) if bare else None
        if found and found[1] and bare in self.ordinary:
            found = None
        if len(self.cache) >= self.kept:
            self.cache.clear()
        if len(token) <= 64:
            self.cache[token] = found or 0
        return found or 0

    def hits(self, tokens: list[str]) -> list[tuple[int, str, int]]:
        """(place, term, edits) of the tokens that are a term."""
        known = list(map(self.cache.get, tokens))
        if None in known:
            known = [self._look(t) if k is None else k for t, k in zip(tokens, known)]
        return [(i, *k) for i, k in enumerate(known) if k]

    def features(self, text: str) -> list[float]:
        """Weighted counts of a text, in the order of `FEATURES`; all zero without a term.

        A quoted or reported term counts as quoted, not as abuse, and one with a word of address in
        its window counts as addressed, too.
        """
        tokens = text.split()
        found = self.hits(tokens)
        if not found:
            return [0.0] * len(FEATURES)
        plain = misspelled = quoted = addressed = 0
        for place, _, edits in found:
            if is_quoted(tokens, place):
                quoted += 1
                continue
            misspelled += edits > 0
            plain += edits == 0
            around = tokens[max(0, place - WINDOW) : place + WINDOW + 1]
            addressed += any(core(t) in ADDRESS for t in around)
        abuse = plain + 0.5 * misspelled
        share = 100 * abuse / len(tokens)
        counts = np.log1p([plain, misspelled, quoted, addressed, share])
        return counts.tolist()


def is_quoted(tokens: list[str], place: int) -> bool:
    """Whether marks open before and close behind within the window, or a word of report comes before."""
    before = tokens[max(0, place - WINDOW) : place + 1]
    behind = tokens[place : place + WINDOW + 1]
    opened = any(t[0] in OPENING for t in before)
    closed = any(t.rstrip(".,;:!?")[-1:] in CLOSING and t.rstrip(".,;:!?")[-1:] for t in behind)
    if opened and closed:
        return True
    return any(core(t) in REPORTING for t in tokens[max(0, place - 3) : place])


@lru_cache(maxsize=4)
def scanner(terms: tuple[str, ...], ordinary: frozenset[str]) -> Scanner:
    return Scanner(terms, ordinary)


def training_rows(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str, label: str, most: int
) -> DataFrame:
    """Documents to learn from, `_text, _label`, distinct: at most `most` keys of each class.

    The keys are the first by a hash; their number bounds the broadcast.
    """
    known = materialize(known_labels(labels.where(learn), key, label), "known-labels")
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = []
    for c in (0, 1):
        # by hash value first, so that no task sorts many more rows than are taken
        share = min(1.0, 1.2 * most / max(1, sizes.get(c, 0)))
        few = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))
        own = known.where((F.col("_label") == c) & few)
        chosen.append(own.orderBy(F.xxhash64(key), key).limit(most))
    taken = chosen[0].unionByName(chosen[1]).withColumnRenamed(key, "_key")
    met = docs.join(F.broadcast(taken), F.col(key) == F.col("_key"))
    rows = met.select(F.coalesce("text", F.lit("")).alias("_text"), "_label")
    return rows.groupBy(F.md5("_text")).agg(F.first("_text").alias("_text"), F.max("_label").alias("_label"))


def _contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words with what stands on both sides, so that copies of a passage count once."""
    for frame in frames:
        for text, label in zip(frame["_text"], frame["_label"]):
            tokens = [core(t) for t in text.split()]
            rows = {
                (w, f"{a} {b}")
                for w, a, b in zip(tokens, ["", *tokens], [*tokens[1:], ""])
                if w
            }
            if rows:
                words, around = zip(*rows)
                yield pd.DataFrame({"word": words, "around": around, "_label": label})


def mine_terms(rows: DataFrame, most: int = LEXICON_TERMS) -> tuple[list[str], DataFrame, int]:
    """Terms typical of toxic texts, all word counts, and the number of toxic texts.

    Words of any length can be terms; short ones have to be spelled right. A word is counted by its
    distinct contexts, as the words of a passage that was copied a thousand times have one.
    """
    words = rows.select("_text", "_label").mapInPandas(
        _contexts, schema="word string, around string, _label int"
    )
    once = words.select("word", F.xxhash64("around").alias("around"), "_label").distinct()
    counted = materialize(
        once.groupBy("word").agg(
            F.sum("_label").alias("toxic"), F.sum(1 - F.col("_label")).alias("clean")
        ),
        "word-contexts",
    )
    sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    least = max(LEAST_CONTEXTS, int(np.ceil(LEAST_SHARE * toxic)))
    typical = counted.where((F.col("toxic") >= least) & (odds >= LEAST_ODDS))
    strongest = typical.orderBy(F.desc("toxic"), "word").limit(most).collect()
    return sorted(r["word"] for r in strongest), counted, toxic


def _near_by_chance(counted: DataFrame, terms: tuple[str, ...]) -> frozenset[str]:
    """All words of clean texts that are near a term and no likelier in toxic ones.

    They are words of the training sample, at most `TRAINING_DOCS` documents a class, and few of those.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = TermAutomaton(terms)
        for frame in frames:
            near = [bool((m := automaton.match(w)) and m[1]) for w in frame["word"]]
            yield frame.loc[near, ["word"]]

    common = counted.where("clean >= 1 AND clean >= toxic / 4").select("word")
    near = common.mapInPandas(run, schema="word string").toArrow()
    return frozenset(near.column("word").to_pylist())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and constant by Newton steps; the ridge keeps them finite on separable data."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    weights = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (y - p) - penalty @ weights
        curve = (design.T * (p * (1 - p))) @ design + penalty
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    label: str = "toxic",
    most: int = TRAINING_DOCS,
) -> Model:
    """The model of the labelled rows that `learn` (a condition on the labels table) allows.

    The sample and the lexicon are bounded by parameters, whatever the size of the tables; the words
    near the lexicon by chance are all that the sample has. Without toxic or clean examples there are no terms, and the constant is the
    share of toxic ones, or 1 in 100.
    """
    rows = materialize(training_rows(docs, labels, learn, key, label, most), "toxicity-training")
    terms, counted, _ = mine_terms(rows)
    terms = tuple(terms)
    ordinary = _near_by_chance(counted, terms) if terms else frozenset()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Scanner(terms, ordinary)
        for frame in frames:
            x = pd.DataFrame([find.features(t) for t in frame["_text"]], columns=list(FEATURES))
            yield x.assign(_label=frame["_label"].to_numpy())

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", _label int"
    kinds = rows.select("_text", "_label").mapInPandas(run, schema=schema)
    grouped = kinds.groupBy(*FEATURES, "_label").count().orderBy(*FEATURES, "_label").toPandas()
    if not len(grouped) or grouped["_label"].nunique() < 2:
        share = 0.01 if not len(grouped) else float(np.clip(grouped["_label"].iloc[0], 0.01, 0.99))
        return Model((), frozenset(), (*[0.0] * len(FEATURES), float(np.log(share / (1 - share)))))
    x = np.repeat(grouped[list(FEATURES)].to_numpy(), grouped["count"], axis=0)
    y = np.repeat(grouped["_label"].to_numpy(dtype=float), grouped["count"])
    return Model(terms, ordinary, tuple(fit_logistic(x, y).tolist()))


def score(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """`key, score, predicted` of each row, from its whole text; null and empty texts have no term.

    Rows stand for themselves: repeated rows and null keys are answered each. Other columns are not
    read, texts of any length are read whole, an empty table gives an empty one. The model, of bounded size,
    goes with the tasks.
    """

    def run(texts: list[str]) -> list[np.ndarray]:
        scores = _scores(texts, model)
        return [scores, (scores >= threshold).astype(np.int32)]

    return map_texts(docs, key, text, run, "score double, predicted int")


def drop_toxic(
    docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of `docs`, all columns, that score below the threshold.

    Null and empty texts have no term and score as the model's constant does; repeated rows and null keys
    are judged each by themselves; a column may have any name; an empty table stays empty.
    """
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                texts = [t or "" for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(_scores(texts, model) < threshold))

    return docs.mapInArrow(run, schema=docs.schema)


def _scores(texts: list[str], model: Model) -> np.ndarray:
    find, weights = scanner(model.terms, model.ordinary), np.array(model.weights)
    x = np.array([find.features(t) for t in texts]).reshape(-1, len(FEATURES))
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
