"""SentencePiece encoding against its library, source divergence against SQL and plain Python, resampling against a brute-force version."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece

from pyspark.sql import functions as F

from tallyforge.llm import divergence, pieces, queries, resampling
from tallyforge.llm.common import table

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, rank string, g int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [
    (1, "alpha beta gamma " * 12, "en", "src1", 5, "x", 1),
    (1, "alpha beta gamma " * 12, "en", "src1", 5, "x", 1),
    (2, None, None, None, None, None, None),
    (None, "alpha beta " * 20, "en", "src2", 1, "x", 2),
    (None, None, None, None, None, None, None),
    (3, "", "de", "src3", 0, "y", 3),
    (4, " \n\t ", "de", "odd source", 4, "y", 3),
    (5, LONG, "en", "src1", 7, "z", 4),
    (6, LONG.upper() + " more", "en", "src2", 7, "z", 4),
    (7, "\U0001f600 naïve \x1c ſecret \0 token = 'abcdefgh12' \x85 ▁ <s>", "fr", "src2", 9, "z", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


# ---- 13: SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def model():
    with open(queries.PIECES, "rb") as f:
        return pieces.model_of(f.read())


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_pieces_equal_the_library(model, library):
    rng = random.Random(1)
    parts = ["a", "b", "e", "n", "t", "in", "▁", " ", "  ", "\n", "é", "\U0001f600", "\0", "日", "-", "=", "*", "1", "23", "ing", "ab\tc", "ﬁ", "́", "<s>", "<0x41>", "\r", "ǅ", "﻿", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [rng.choice(" -=*/e▁#a") * n + end for n in range(70) for end in ("", "x", " t")]
    texts += ["".join(rng.choice(model.tokens) for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    texts += ["a" * 5000, "".join(rng.choice("abcde") for _ in range(5000)), " " * 3000 + "x", ""]
    for text in texts:
        want = library.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text, True, True) == packed(want)
        assert model.decode(np.array(want)).decode() == library.decode(want)
        assert model.encode(text) == packed(library.encode(text))


def test_any_ids_decode_as_in_the_library(model, library):
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randrange(9))]
        assert model.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_dead_ends_are_taken_back(model):
    for text in ("▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁t", " internationalisation", "ertherinent" * 5):
        plain = text.replace("▁", " ")
        assert [model.tokens[i] for i in model.backtracked(plain)] == model.merged(plain)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(b"")


def test_op13(spark, odd, empty, library):
    out = {r["doc_id"]: r for r in queries.op13_sentencepiece(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_bos=True, add_eos=True)
        r = out[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = pieces.piece_decode(pieces.piece_encode(odd, queries.PIECES, out="rank"), queries.PIECES, "rank", "g")
    assert set(got.columns) == set(odd.columns)
    for r in got.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["rank"] == ids and r["g"] == library.decode(ids)
    assert pieces.piece_decode(odd.select(F.lit(None).cast("array<int>").alias("ids")), queries.PIECES).where("decoded = ''").count() == len(ODD)
    assert pieces.piece_encode(empty, queries.PIECES).count() == 0


# ---- 12: importance resampling


def plain_features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resampled(docs, target, percent=5):
    s, t, rows = Counter(), Counter(), []
    for _, text in docs:
        s.update(plain_features(text)[1])
    for text in target:
        t.update(plain_features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    for i, text in docs:
        words, features = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_op12(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    want = plain_resampled(docs, [r["text"] for r in table(spark, SF, "benchmark").collect()])
    out = queries.op12_importance_resampling(spark, SF)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 5


def test_resampling_of_odd_rows(spark, odd, empty):
    want = plain_resampled([(r[0], r[1]) for r in ODD], ["alpha beta word1 word2 word3"], 70)
    target = spark.createDataFrame([("alpha beta word1 word2 word3",), (None,)], "text string")
    assert sorted(map(tuple, resampling.resampled(odd, target, percent=70).collect()), key=str) == want
    assert resampling.resampled(empty, target).count() == 0
    assert resampling.resampled(odd, empty).count() == len(ODD)


@pytest.mark.parametrize("step", [1, 7, 64])
def test_the_ring_carries_over_steps(monkeypatch, step):
    monkeypatch.setattr(resampling, "STEP", step)
    rng = random.Random(step)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "é", " ", "-", "x1", "\n"]) for _ in range(rng.randrange(60)))
        for n in (1, 2, 3, 5):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
            want = Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1))
            assert Counter(np.concatenate([*resampling.feature_crcs(text, n), np.zeros(0, np.int64)]).tolist()) == want


def test_ranks_of_equal_rows(spark):
    rows = spark.createDataFrame([(k % 3,) for k in range(1000)], "v long").repartition(7)
    out = resampling.ranked(rows, [F.desc("v")]).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 1001))
    assert [r["v"] for r in sorted(out, key=lambda r: r["rank"])] == sorted((k % 3 for k in range(1000)), reverse=True)


# ---- 11: divergence of sources


def plain_divergence(docs, least, most=50):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        terms = Counter(re.findall(divergence.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(terms.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, part, item.decode(), -value, k + 1) for part, found in (("pair", pairs), ("term", terms[:most])) for k, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_divergence_of_odd_rows(odd, empty, least, monkeypatch):
    for name in ("ROWS_A_SHARD", "SHARES_A_SHARD", "PAIRS_A_BLOCK", "PART"):
        monkeypatch.setattr(divergence, name, {1: 400_000, 2: 200, 3: 1}[least] if name != "PAIRS_A_BLOCK" else {1: 500_000, 2: 2, 3: 1}[least])
    got = divergence.source_divergence(odd.limit(1000) if least == 1 else odd.where("doc_id is null or doc_id not in (5, 6)"), least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence([(r[1], r[2], r[3]) for r in ODD if least == 1 or r[0] not in (5, 6)], least)
    assert divergence.source_divergence(empty).count() == 0


def test_divergence_equals_sql(spark, tmp_path):
    path = str(tmp_path / "out")
    queries.op11_source_divergence(spark, SF).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    own = f"(select lang, source, part, item, value, rank from '{path}/*.parquet')"
    sql = f"(select lang, source, part, item, value, rank from ({queries.DIVERGENCE_SQL}))"
    assert duck.execute(f"select count(*) from {own}").fetchone()[0] > 50
    assert duck.execute(f"select count(*) from ({own} except all {sql})").fetchone() == (0,)
    assert duck.execute(f"select count(*) from ({sql} except all {own})").fetchone() == (0,)
    docs = table(spark, SF, "documents").select("text", "lang", "source").collect()
    assert sorted(duck.execute(sql).fetchall()) == plain_divergence([tuple(r) for r in docs], 30)
