"""Quality rules: fixed rules on document statistics, then gradient-boosted trees over them.

The trees are learnt here from labelled documents, by histograms of at most BINS bins. Splits on a constrained
feature keep the score monotone in it: the children's values stay in order and within bounds that a split hands
down. A model is five flat numpy arrays, and scoring walks all rows through all trees at once, level by level.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import labelled_sample, texts_of_sample, with_arrow

#: Statistics that the rules use, and those that the trees add; the sign asks for a monotone score.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = {"symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": 0, "marks": -1, "bars": -1, "digits": 0, "word_length": 0, "distinct": 0, "commonest": -1, "ends": 0, "words": 0}
#: Labelled documents of each label that a model learns from, at most.
SAMPLE = 6000
#: A document is rejected if its score, the chance of label 1, is below this.
LEAST = 0.3
BINS = 32

_SYMBOLS, _CAPITALS, _DIGITS, _SPACE = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b" \t\n\r\x0b\x0c"


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base statistics of a whole text and its features."""
    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    real = [x for x in lines if x.strip(_SPACE)]
    dup = len(real) - len(set(real))
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        times = Counter(grams)
        often = np.array([times[g] > 1 for g in grams] + [False, False])
        repeated = int((often | np.roll(often, 1) | np.roll(often, 2)).sum())  # the two at the end are false: nothing rolls over
    counts = Counter(words)
    size, some = max(chars, 1), max(n, 1)
    marks = raw.count(b"!") + raw.count(b"?")
    features = [
        symbols / size, dup / max(len(real), 1), repeated / some, (len(raw) - len(raw.translate(None, _CAPITALS))) / size, marks / some, raw.count(b"|") / some,
        (len(raw) - len(raw.translate(None, _DIGITS))) / size, chars / some, len(counts) / some, max(counts.values(), default=0) / some, sum(x.rstrip(_SPACE)[-1:] in b".!?\"" for x in real) / max(len(real), 1), float(np.log1p(n)),
    ]
    return [n, chars, symbols, dup, repeated], features


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass
class Trees:
    """A forest in flat arrays: node i sends a row to left[i] or right[i] by feature[i] <= threshold[i]; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of features."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, smooth: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss, by Newton steps on histograms."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # bin b: c <= edges[b]
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    total = np.full(len(y), start)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + smooth), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        if level == depth or hs < 2 * least:
            return me
        best = (1e-6, None)
        for f, sign in enumerate(signs):
            gl, hl = (np.cumsum(np.bincount(bins[rows, f], w[rows], BINS))[: len(edges[f])] for w in (g, h))
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + smooth), low, high), np.clip(-gr / (hr + smooth), low, high)
            gain = -(gl * vl + 0.5 * (hl + smooth) * vl**2) - (gr * vr + 0.5 * (hr + smooth) * vr**2) + gs * value + 0.5 * (hs + smooth) * value**2
            gain[(hl < least) | (hr < least) | (sign * (vr - vl) < 0)] = -np.inf
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return me
        f, k, vl, vr = best[1]
        middle, left = (vl + vr) / 2, bins[rows, f] <= k
        bounds = [(low, high)] * 2 if not signs[f] else [(low, middle), (middle, high)] if signs[f] > 0 else [(middle, high), (low, middle)]
        a = grow(rows[left], g, h, level + 1, *bounds[0])
        b = grow(rows[~left], g, h, level + 1, *bounds[1])
        nodes[me][:4] = [f, float(edges[f][k]), a, b]
        return me

    everything = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        first = len(nodes)
        roots.append(grow(everything, p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = _flat(nodes, [first], 0.0, depth)
        at = np.full(len(y), first)
        for _ in range(depth):
            at = np.where(x[everything, tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
        total += tree.value[at]
    return _flat(nodes, roots, start, depth)


def _flat(nodes: list[list], roots: list[int], start: float, depth: int) -> Trees:
    f, t, a, b, v = zip(*nodes)
    return Trees(np.array(f), np.array(t), np.array(a), np.array(b), np.array(v), np.array(roots), start, depth)


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 0) -> Trees | None:
    """Trees learnt from the labelled documents that pass the rules, at most about ``sample`` of each label, chosen by a seeded hash of the id.

    Only the features of the chosen reach the driver, one row an id and label: of the texts of an id that ``documents`` repeats, the
    least counts. Null ids and labels teach nothing. Without both labels among those that pass, as with empty tables, there is no model.
    """
    chosen, _ = labelled_sample(labels, label, sample, seed)
    if chosen is None:
        return None
    rows = with_statistics(texts_of_sample(docs, chosen)).select("y", "n_words", "n_repeat_words", "features").toArrow()
    x = np.array(rows.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy().astype(float)
    passed = ~base_failed(rows.column("n_words").to_numpy(), rows.column("n_repeat_words").to_numpy())  # the rules take the others
    if len(set(y[passed])) < 2:
        return None
    return fit_trees(x[passed], y[passed], list(FEATURES.values()))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base statistics (long) and ``features`` (array<double>) of each whole text; a null text is an empty one. Columns of these names are replaced."""
    fields = [T.StructField(n, T.LongType()) for n in BASE] + [T.StructField("features", T.ArrayType(T.DoubleType()))]

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [statistics(x or "") for x in batch.column(text).to_pylist()]
            return [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(BASE))] + [pa.array([r[1] for r in rows], pa.list_(pa.float64()))]

        return step

    return with_arrow(df, text, fields, make)


def quality_verdicts(df: DataFrame, model: Trees | None, text: str = "text", least: float = LEAST) -> DataFrame:
    """``df`` with the base statistics, base_failed, score and kept; without a model the score is null and the rules alone decide.

    Texts without words fail the rules. Repeated rows get equal verdicts, an empty table gives no rows. Extra columns pass; those with
    an output's name are replaced.
    """
    fields = [T.StructField(n, T.LongType()) for n in BASE] + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [statistics(x or "") for x in batch.column(text).to_pylist()]
            base = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
            failed = base_failed(base[:, 0], base[:, 4])
            if model is None:
                score, good = pa.nulls(len(rows), pa.float64()), ~failed
            else:
                s = model.score(np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)))
                score, good = pa.array(s), ~failed & (s >= least)
            return [pa.array(np.ascontiguousarray(c)) for c in base.T] + [pa.array(failed), score, pa.array(good)]

        return step

    return with_arrow(df, text, fields, make)
