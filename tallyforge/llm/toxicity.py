"""Toxicity: a lexicon learnt from labels, found with misspellings, and scored with its context.

The lexicon's terms form a trie. The Levenshtein automaton of one edit (a letter put in, left out, exchanged, or two
neighbours swapped) is intersected with the trie, and the product made deterministic as far as the words met need
it: a state is a set of places in the trie with the edits spent, and a table keeps the steps found so far. All words of a
block walk together, most stop after a few letters. Every term is sought with misspellings. Digits and signs
that stand for letters walk as those letters. Hits in quotation or after words of reporting weigh less.
The score is a logistic regression on how many hits there are, how dense, how close together and how quoted.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import labelled_sample, texts_of_sample, with_arrow

#: Labelled documents of each label that a model learns from, at most.
SAMPLE = 6000
#: Letters from which a term may have a letter exchanged or two swapped, and from which it may have one put in or left out: with fewer, every other word is an edit
#: away. A stem counts a letter less.
BENT, LOOSE = 4, 5
#: Letters of the stems that stand for all their words.
STEMS = (3, 4, 5, 6, 7, 8)
#: States of the product that a task remembers before it starts anew.
STATES = 200_000
#: Weights of a hit by kind (misspelt stem, misspelt, stem, exact) and of one in quotation. Misspelt stems are a feature of their own.
KIND_WEIGHT, QUOTED = np.array([0.0, 0.0, 0.8, 1.0, 1.0]), 0.3
_FUZZY_STEM, _FUZZY, _STEM, _EXACT = range(1, 5)
#: Words around a hit that are its context, and characters before it in which a word of reporting counts.
WINDOW, BEFORE = 12, 40
FEATURES = 6

#: Signs that are read as letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": ""}
#: Words that report what others say.
REPORTING = re.compile(r"\b(?:said|says|quote[ds]?|quoting|called|calls|wrote|writes|word|term|phrase|insult|slur)\b")
_LOW, _LEFT, _HIGH = map(ord, "„«“")
_MARKS = [_LOW, _LEFT, _HIGH, *map(ord, "”»")]

#: Edits spent on the way to a place in the trie: none, an exchange or swap, a letter put in or left out. A stem met with an edit stays met.
_NONE, _CHANGED, _SHIFTED, _MET = range(4)


class Automaton:
    """The deterministic product of the trie of ``terms`` (term, is a stem) and the one-edit automaton, built as words need it.

    State 0 is dead and state 1 the start. ``kind`` (0 none, 1 misspelt stem, 2 misspelt, 3 stem, 4 exact) and ``term`` say what a word that ends in a state
    is; ``stem`` marks states that have met a whole stem.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.classes = {c: i + 2 for i, c in enumerate(sorted({c for t, _ in terms for c in t}))}  # 0: no word character, 1: any other letter
        self._letters: list[str | None] = [None, None, *self.classes]
        self._children: list[dict[str, int]] = [{}]
        self._ends: dict[int, tuple[int, bool, int]] = {}  # term, is a stem, letters that count
        self._below = [0]  # letters that count of the longest term below
        for k, (t, stem) in enumerate(terms):
            path = [0]
            for c in t:
                at = self._children[path[-1]].setdefault(c, len(self._children))
                if at == len(self._children):
                    self._children.append({})
                    self._below.append(0)
                path.append(at)
            self._ends.setdefault(path[-1], (k, stem, len(t) - stem))
            for x in path:
                self._below[x] = max(self._below[x], len(t) - stem)
        self.forget()

    def __reduce__(self):
        return Automaton, (self.terms,)

    def forget(self) -> None:
        """Drops the states found so far; they are found again when words need them."""
        self._number: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self.table = np.zeros((64, len(self._letters)), np.int32)
        self.kind, self.term, self.stem = np.zeros(64, np.int8), np.zeros(64, np.int32), np.zeros(64, bool)
        self._add(frozenset())
        self.table[0] = 0
        self._add(frozenset({(0, _NONE, "")}))

    def _add(self, state: frozenset) -> int:
        n = self._number.setdefault(state, len(self._sets))
        if n == len(self._sets):
            self._sets.append(state)
            if n == len(self.kind):
                for name in ("table", "kind", "term", "stem"):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
            self.table[n] = -1
            self.kind[n], self.term[n], self.stem[n] = self._verdict(state)
        return n

    def follow(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after a letter (its class) each."""
        after = self.table[state, letter]
        if (after < 0).any():
            for s, c in set(zip(state[after < 0].tolist(), letter[after < 0].tolist())):
                n = self._add(self._step(self._sets[s], self._letters[c]))
                self.table[s, c] = n
            after = self.table[state, letter]
        return after

    def _step(self, state: frozenset, c: str | None) -> frozenset:
        """The triples (trie node, edits, swapped letter still due) after a letter; None is a letter of no term."""
        out = set()
        for node, edits, due in state:
            if edits == _MET:
                out.add((node, edits, due))
                continue
            children = self._children[node]
            if due:
                if c == due:
                    out.add((node, _CHANGED, ""))
                continue
            if c in children:
                out.add((children[c], edits, ""))
            if edits != _NONE or self._below[node] < BENT:
                continue
            out.add((node, _SHIFTED, ""))  # a letter put in
            for d, child in children.items():
                if d != c:
                    out.add((child, _CHANGED, ""))  # exchanged
                    if c in self._children[child]:
                        out.add((self._children[child][c], _CHANGED, d))  # swapped
                if c in self._children[child]:
                    out.add((self._children[child][c], _SHIFTED, ""))  # left out
        met = {(self._ends[n][0], _MET, "") for n, e, due in out if e in (_CHANGED, _SHIFTED) and not due and n in self._ends and self._ends[n][1] and self._allowed(n, e)}
        return frozenset(out | met)

    def _allowed(self, node: int, edits: int) -> bool:
        return self._ends[node][2] >= (BENT if edits == _CHANGED else LOOSE)

    def _verdict(self, state: frozenset) -> tuple[int, int, bool]:
        """(kind, term, stem met) of a word that ends here."""
        best = (0, -1, False)
        for node, edits, due in state:
            if edits == _MET:
                best = max(best, (_FUZZY_STEM, node, False))
            if edits == _MET or due:
                continue
            end = self._ends.get(node)
            if end and edits == _NONE:
                best = max(best, (_STEM, end[0], True) if end[1] else (_EXACT, end[0], False))
            elif end and self._allowed(node, edits):
                best = max(best, (_FUZZY_STEM if end[1] else _FUZZY, end[0], False))
            if edits == _NONE:
                for child in self._children[node].values():  # the last letter left out
                    if child in self._ends and self._allowed(child, _SHIFTED):
                        best = max(best, (_FUZZY_STEM if self._ends[child][1] else _FUZZY, self._ends[child][0], False))
        return best


@dataclass
class Toxicity:
    terms: list[tuple[str, bool]]
    weights: np.ndarray  # of the features, last the constant


@lru_cache(2)
def _automaton(terms: tuple[tuple[str, bool], ...]) -> tuple[Automaton, np.ndarray]:
    """The automaton of a worker, which its tasks share, and the class of each code point."""
    automaton = Automaton(list(terms))
    return automaton, _class_table(automaton)


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """1 for each code point that is a letter or a digit."""
    return np.array([chr(c).isalnum() for c in range(0x110000)], np.uint8)


def _class_table(automaton: Automaton) -> np.ndarray:
    table = _alphabet().copy()
    for c, k in automaton.classes.items():
        table[ord(c)] = k
    for sign, letter in LEET.items():
        table[ord(sign)] = automaton.classes.get(letter, 1)
    return table


def find_hits(texts: list[str], automaton: Automaton, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: all code points in a row, the texts' bounds in it, the number of each text's first word, word counts, and the hits (word, kind, term, start) in order."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = table[codes]
    sign = (codes == 64) | (codes == 36) | (codes == 42)  # @ $ * count inside words only
    word = (classes > 0) & ~sign
    inner = np.flatnonzero(sign[1:-1] & word[:-2] & word[2:]) + 1
    word[inner] = True
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    active, state, pos = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
    found = []
    while len(active):
        state = automaton.follow(state, classes[pos])
        pos = pos + 1
        over = (pos == ends[active]) | automaton.stem[state]
        hit = over & (automaton.kind[state] > 0)
        if hit.any():
            found.append(np.stack([active[hit], automaton.kind[state[hit]], automaton.term[state[hit]], starts[active[hit]]]))
        on = (state > 0) & ~over
        active, state, pos = active[on], state[on], pos[on]
    lengths = np.array([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    first = np.searchsorted(starts, bounds)
    hits = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    return codes, bounds, first, np.diff(first), hits[:, np.argsort(hits[0], kind="stable")]


def quoted(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place is inside quotation marks of its line or shortly after a word of reporting.

    Counts marks from the start of the line to the place, and to the line's end: straight ones must be odd before it and close after it, of
    others the last before it must be an opening one (a high one after a low one closes).
    """
    breaks = np.flatnonzero(codes == 10)
    nth = np.searchsorted(breaks, places)
    line = np.concatenate([[-1], breaks])[nth] + 1
    end = np.append(breaks, len(codes))[nth]
    marks = np.flatnonzero(codes == 34)
    before, all_ = (np.searchsorted(marks, x) - np.searchsorted(marks, line) for x in (places, end))
    inside = (before % 2 == 1) & (all_ > before)
    marks = np.flatnonzero(np.isin(codes, _MARKS))
    k = np.searchsorted(marks, places)
    own, at = np.concatenate([[0, 0], codes[marks]]), np.concatenate([[-2, -2], marks])  # two marks before all others
    ends_low = (own[k] == _LOW) & (at[k] >= line)
    inside |= (at[k + 1] >= line) & ((own[k + 1] == _LOW) | (own[k + 1] == _LEFT) | (own[k + 1] == _HIGH) & ~ends_low)
    for i in np.flatnonzero(~inside):
        before_ = codes[max(line[i], places[i] - BEFORE) : places[i]].tobytes().decode("utf-32-le", "surrogatepass")
        inside[i] = bool(REPORTING.search(before_))
    return inside


def features(texts: list[str], automaton: Automaton, table: np.ndarray) -> np.ndarray:
    """A row for each text: hits in all, their share of the words, distinct terms, most within a window, those in quotation, and misspelt stems."""
    if len(automaton.kind) > STATES:
        automaton.forget()
    codes, _, first, words, hits = find_hits([t.lower() for t in texts], automaton, table)
    out = np.zeros((len(texts), FEATURES))
    said = quoted(codes, hits[3])
    weights = KIND_WEIGHT[hits[1]] * np.where(said, QUOTED, 1.0)
    owner = np.searchsorted(first, hits[0], "right") - 1
    for k, a in zip(*np.unique(owner, return_index=True)):
        b = np.searchsorted(owner, k, "right")
        at, weight, quotes, fuzzy = hits[0, a:b], weights[a:b], said[a:b], hits[1, a:b] == _FUZZY_STEM
        sums = np.concatenate([[0], np.cumsum(weight)])
        near = sums[np.searchsorted(at, at + WINDOW, "left")] - sums[:-1]
        out[k] = [np.log1p(weight.sum()), np.log1p(100 * weight.sum() / max(words[k], 1)), np.log1p(len(set(hits[2, a:b][~quotes & ~fuzzy].tolist()))), near.max(), np.log1p((quotes & ~fuzzy).sum()), np.log1p(fuzzy.sum())]
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge on all but the constant."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """Terms (term, is a stem) that mark label 1 in ``sample`` (doc_id, text, y), the strongest first: all for which there is evidence.

    Counts documents by word and by stem. A term needs to be in five documents of label 1 and in one of two hundred of them, so the sample's bound
    is one of the lexicon too. A stem stands for its words if no single one of them makes up most of it.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)

    def stems_of(n: int) -> F.Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    stems = [stems_of(n) for n in STEMS]
    found = sample.select("y", F.explode(F.array_distinct(F.concat(words, *stems))).alias("term"))
    counts = found.groupBy("term").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    total, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    least = max(5, 0.005 * positive)
    odds = F.log((F.col("pos") + 0.5) / (positive + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (total - positive + 1))
    sure = odds - 1.64 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("n") - F.col("pos") + 0.5))  # few copies of one text are no evidence
    strong = counts.withColumn("odds", sure).where((F.col("pos") >= least) & (F.col("odds") >= 2.0))
    rows = strong.orderBy(F.desc(F.col("odds") + 0.2 * F.log("pos")), "term").collect()
    pos = {r["term"]: r["pos"] for r in rows}
    own: dict[str, int] = {}  # of each stem, the documents of its commonest word
    for term, n in pos.items():
        if not term.endswith("*"):
            for k in STEMS:
                own[term[:k]] = max(own.get(term[:k], 0), n)
    out: list[tuple[str, bool]] = []
    for term in pos:
        stem, text = term.endswith("*"), term.rstrip("*")
        shorter = [pos.get(text[:n] + "*", 0) for n in STEMS if n < len(text)]
        if stem and (own.get(text, 0) >= 0.6 * pos[term] or any(n >= 0.9 * pos[term] for n in shorter)):
            continue
        if not stem and any(n > pos[term] / 0.6 for n in shorter):
            continue
        out.append((text, stem))
    return out


def learn_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, seed: int = 0) -> Toxicity | None:
    """A model from labelled documents that aren't held out, at most about ``sample`` of each label, chosen by a seeded hash of the id.

    Only the lexicon and the features of the chosen reach the driver, one row an id and label: of the texts of an id that ``documents``
    repeats, the least counts. Null ids and labels teach nothing. Without both labels, as with empty tables, there is no model.
    """
    chosen, counts = labelled_sample(labels.where(~held_out()), label, sample, seed)
    if chosen is None:
        return None
    rows = texts_of_sample(docs, chosen)
    terms = learn_lexicon(rows)
    seen = _with_features(rows, terms).select("y", "features").toArrow()
    x, y = np.array(seen.column("features").to_pylist(), float).reshape(-1, FEATURES), seen.column("y").to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    weights = fit_weights(x, y)
    # the sample may hold more of label 1 than all labelled rows do
    weights[-1] += math.log(counts[1] / counts[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Toxicity(terms, weights)


def _with_features(df: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    def make():
        automaton, table = _automaton(tuple(terms))
        return lambda batch: [pa.array(list(features(batch.column("text").to_pylist(), automaton, table)), pa.list_(pa.float64()))]

    return with_arrow(df, "text", [T.StructField("features", T.ArrayType(T.DoubleType()))], make)


def score_toxicity(df: DataFrame, model: Toxicity | None, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``, the chance of label 1 for each whole text; a null text is an empty one, and without a model all have 0.

    Repeated rows get equal scores, an empty table gives no rows, and a column of the output's name is replaced.
    """
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    terms, weights = model.terms, model.weights

    def make():
        automaton, table = _automaton(tuple(terms))

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            x = features([t or "" for t in batch.column(text).to_pylist()], automaton, table)
            z = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
            return [pa.array(1 / (1 + np.exp(-z)))]

        return step

    return with_arrow(df, text, [T.StructField(out, T.DoubleType())], make)
