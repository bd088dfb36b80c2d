"""The pipeline's stages, each on what its predecessor kept, against brute-force versions; and their values on odd rows."""

import hashlib
import itertools
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from tallyforge.llm import bpe, line_dedup, near_copies, quality, queries, shards, toxicity
from tallyforge.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs, out = table(spark, SF, "documents"), []
    out.append([r.asDict() for r in docs.collect()])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append([r.asDict() for r in docs.collect()])
        docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in out[-1]], "doc_id long, text string, lang string, source string, n_chars long") if set(COLUMNS) <= set(docs.columns) else docs
    return out


def walked(model, x):
    total = model.start
    for at in model.roots:
        while model.left[at] != at:
            at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
        total += model.value[at]
    return total


def test_quality_rules(spark, stages):
    model = quality.learn_quality(table(spark, SF, "documents"), table(spark, SF, "labels"))
    kept = []
    for r in stages[0]:
        (n, _, _, _, repeated), features = quality.statistics(r["text"] or "")
        if n >= 50 and 100 * repeated <= 50 * n and (model is None or walked(model, features) >= -0.8472978603872036):  # the logit of 0.3
            kept.append(r)
    assert sorted(stages[1], key=str) == sorted(kept, key=str)


def test_line_dedup(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[1]]
    lines = sorted((i, k, line.encode().split()) for i, text in docs for k, line in enumerate(text.split("\n")) if len(line.encode().split()) >= 3)
    gone = set()
    for n, (i, k, words) in enumerate(lines):
        if any(words == o or min(len(words), len(o)) >= 5 and line_dedup.within_one(words, o) for _, _, o in lines[:n]):
            gone.add((i, k))
    want = {}
    for i, text in docs:
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        if left == text or re.search(r"[^\x20\x09-\x0D]", left):
            want[i] = left
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_dedup(stages):
    sets = {r["doc_id"]: set(near_copies.shingle_set(r["text"]).tolist()) for r in stages[2]}
    root = {i: i for i in sets}
    alike = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(root)
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(i for i, r in root.items() if i == r)


def fill(budget, nodes):
    """Shares of (cap, weight, key): full nodes first, what they leave by weight."""
    nodes, got = sorted(nodes, key=lambda n: (n[0] / n[1], n[2])), {}
    total = sum(w for _, w, _ in nodes)
    for k, (cap, w, key) in enumerate(nodes):
        if cap * total > budget * w:
            return got | {n[2]: budget * n[1] // total for n in nodes[k:]}
        got[key], budget, total = cap, budget - cap, total - w
    return got


def test_source_mixing(stages):
    leaves, docs = defaultdict(int), []
    for r in stages[3]:
        number = re.search("[0-9]+", r["source"] or "")
        domain = queries.DOMAINS[int(number[0]) % len(queries.DOMAINS)] if number else "unknown"
        leaf = (domain, r["lang"] or "unknown", r["source"] or "unknown")
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        leaves[leaf] += n
        docs.append((leaf, r["doc_id"], n))
    given = {(): sum(leaves.values()) * 900 // 1000}
    for level in (1, 2, 3):
        paths = sorted({p[:level] for p in leaves})
        given = {k: v for parent, budget in given.items() for k, v in fill(budget, [(sum(t for q, t in leaves.items() if q[:level] == p), queries.WEIGHTS.get(p, 1), p) for p in paths if p[:-1] == parent]).items()}
    taken = []
    for leaf, tokens in leaves.items():
        epochs, rest = divmod(given[leaf], tokens) if tokens else (0, 0)
        mine = sorted((hashlib.md5(f"7:{epochs}:{i}".encode()).hexdigest(), i, n) for own, i, n in docs if own == leaf)
        run = 0
        for _, i, n in mine:
            run += n
            if epochs >= 1 or rest and run <= rest:
                taken.append(i)
    assert sorted(r["doc_id"] for r in stages[4]) == sorted(taken)


def test_tokens(stages):
    encoder = bpe.Encoder(bpe.Ranks(open(queries.RANKS, "rb").read()), queries.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert sorted(r["doc_id"] for r in stages[5]) == sorted(texts)
    for r in stages[5]:
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["ids"] == encoder.texts([texts[r["doc_id"]]])[0].tolist()


# ---- values on odd rows


@pytest.fixture(scope="module")
def odd(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "en", "src1", 1, "x"), (1, words, "en", "src1", 1, "x"), (2, None, None, None, None, None), (None, words + " and more", None, "src2", 1, "x"), (None, None, None, None, None, None), (3, "", "de", "src3", 0, "y"), (4, " \n\t", "de", "?", 3, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")


def test_quality_of_odd_rows(odd):
    out = sorted(((r["doc_id"] or 0, *(r[c] for c in quality.BASE), r["base_failed"], r["kept"], r["score"]) for r in quality.quality_verdicts(odd, None).collect()), key=str)
    none = (0, 0, 0, 0, 0, True, False, None)
    chars = sum(len(f"w{i}") for i in range(80))
    assert out == sorted([(1, 80, chars, 0, 0, 0, False, True, None)] * 2 + [(0, 82, chars + 7, 0, 0, 0, False, True, None), (0, *none), (2, *none), (3, *none), (4, *none)], key=str)


def test_toxicity_of_odd_rows(odd):
    model = toxicity.Toxicity([("more", False)], toxicity.np.array([1.0, 1.0, 0, 0, 0, 0, -2.0]))
    out = toxicity.score_toxicity(odd, model, out="shard")
    assert out.columns == odd.columns
    scores = {(r["doc_id"], r["text"]): r["shard"] for r in out.collect()}
    empty = 1 / (1 + toxicity.math.exp(2))
    assert all(abs(scores[i, t] - empty) < 1e-12 for i, t in ((2, None), (None, None), (3, ""), (4, " \n\t")))
    assert all(s > empty for (_, t), s in scores.items() if t and "more" in t)


def test_shards_of_odd_rows(odd):
    out = shards.shuffled_shards(odd, shards=3, seed=1).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=str)
    assert sorted((r["shard"], r["slot"]) for r in out) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]


def test_pipeline_of_odd_rows(spark, odd):
    kept, ids = odd, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        ids.append(sorted((r["doc_id"] or 0) for r in kept.collect()))
    # texts without words fail the rules; the null id's line is one edit from none; of the equal rows of one id one stays; the mixture takes nine tenths at most
    assert ids[0] == [0, 1, 1] and ids[1] == [0, 1, 1] and ids[2] == [1]
    assert ids[3] in ([], [1]) and ids[4] == ids[3]
