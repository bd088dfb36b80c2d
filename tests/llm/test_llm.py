"""The training-data operators against brute-force versions, and on odd input."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import bpe, common, fingerprints, licenses, line_dedup, mixing, near_copies, quality, queries, secrets, shards, simhash, toxicity
from tallyforge.llm.common import table
from tallyforge.operators import graphs

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, shard string, __other int"


def rows_of(spark, name="documents", sf=SF):
    return [r.asDict() for r in table(spark, sf, name).collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta\nepsilon zeta eta theta iota kappa lambda mu", "en", "src1", 5, "x", 1),
        (1, "alpha beta gamma delta\nepsilon zeta eta theta iota kappa lambda mu", "en", "src1", 5, "x", 1),
        (2, None, None, None, None, None, None),
        (None, "alpha beta gamma delta", "en", "src2", 1, "x", 2),
        (None, None, None, None, None, None, None),
        (3, "", "de", "src3", 0, "y", 3),
        (4, " \n\t ", "de", "odd source", 4, "y", 3),
        (5, long, "en", "src1", 7, "z", 4),
        (6, long + " more", "en", "src1", 7, "z", 4),
        (7, "\U0001f600 naïve \x1c ſecret token = 'abcdefgh12' \x85", "fr", "src2", 9, "z", 5),
    ]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


# ---- 1: fingerprints


def test_fingerprints_of_edited_texts(spark):
    out = {r["doc_id"]: r for r in queries.op1_syncmer_fingerprints(spark, SF).collect()}
    docs = sorted(rows_of(spark), key=lambda r: r["doc_id"])
    assert len(out) == len(docs)
    for i, d in enumerate(docs):
        text, after = d["text"], docs[(i + 1) % len(docs)]["text"]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = out[d["doc_id"]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.as_text(fingerprints.sketch(text))
        assert r["edited_fingerprint"] == fingerprints.as_text(fingerprints.sketch(edited))
    assert np.mean([r["near_edited"] for r in out.values() if r["n_chars"] > 200]) > 0.4
    assert np.median([r["near_next"] for r in out.values()]) < 0.05


@pytest.mark.parametrize("cuts", [512, 3, 1])
def test_next_rows_across_ranges(spark, monkeypatch, cuts):
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", 7)
    monkeypatch.setattr(fingerprints, "CUTS", cuts)
    rows = [(i * i - 50, f"text number {i} " * 3) for i in range(100)] + [(10**15, "far away"), (10**15 + 1, "farther")]  # uneven ids leave ranges empty
    out = {r["doc_id"]: r for r in fingerprints.edited_halves(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        assert out[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_next_rows_of_nulls_and_ties(spark):
    docs = spark.createDataFrame([(None, "null id"), (None, None), (3, "b tie"), (3, "a tie"), (9, "last")], "doc_id long, text string")
    order = [(None, ""), (None, "null id"), (3, "a tie"), (3, "b tie"), (9, "last")]
    want = {(i, hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % 5][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order)}
    assert {(r["doc_id"], r["edited_sha256"]) for r in fingerprints.edited_halves(docs).collect()} == want


def test_anchors_are_closed_syncmers():
    text = "the quick brown fox jumps over the lazy dog and runs away"
    codes = np.array([ord(c) for c in text], np.uint64)
    at, h = fingerprints.anchors(codes, 10, 5)
    inner = fingerprints._mix(fingerprints._rolled(codes, 5)).tolist()
    expected = [i for i in range(len(text) - 9) if min(inner[i : i + 6]) in (inner[i], inner[i + 5])]
    assert at.tolist() == expected
    shifted, h2 = fingerprints.anchors(np.concatenate([np.array([120] * 7, np.uint64), codes]), 10, 5)
    assert set(h.tolist()) <= set(h2.tolist())  # the same anchors wherever the passage stands


def test_long_texts_have_the_same_sketch_in_steps(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    whole = fingerprints.sketch(text)
    monkeypatch.setattr(fingerprints, "STEP", 1000)
    assert (fingerprints.sketch(text) == whole).all()
    assert fingerprints.likeness(whole, whole) == 1.0


def test_fingerprints_on_odd_rows(spark, odd, empty):
    assert fingerprints.edited_halves(odd).count() == odd.count()
    assert fingerprints.edited_halves(empty).count() == 0
    assert fingerprints.with_fingerprint(odd, out="shard").where("text is null").select("shard").distinct().collect()[0][0] == ""
    assert fingerprints.shared_anchors(odd).count() > 0


# ---- 2: licences


def test_licenses(spark, odd, empty):
    mit = licenses.TEXTS["MIT"].replace("<year>", "2021").replace("<holder>", "Some One").upper()
    isc = licenses.TEXTS["ISC"].split("\n\n", 1)[1].replace("software", "  software ")
    docs = spark.createDataFrame([(1, mit), (2, isc), (3, mit + " and more"), (4, "prose\nReleased under the MIT Licence"), (5, None)], "doc_id long, text string")
    out = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan_licenses(docs).collect()}
    assert out == {1: ("MIT", []), 2: ("ISC", []), 3: (None, []), 4: (None, ["MIT"]), 5: (None, [])}
    rows = licenses.scan_licenses(odd)
    assert rows.columns == ["doc_id", "text_digest", "license", "notices"]
    assert sorted((r["doc_id"] or 0, r["license"], r["notices"]) for r in rows.collect()) == sorted((r["doc_id"] or 0, None, []) for r in odd.collect())
    assert licenses.scan_licenses(empty).count() == 0


# ---- 3: toxicity


def within(a, b):
    """Optimal string alignment distance of at most one."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if n == m:
        d = [i for i in range(n) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if n > m:
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_is_one_edit():
    terms = [("idiot", False), ("stupid", False), ("clown", False), ("vequ", True), ("cow", False)]
    auto = toxicity.Automaton(terms)
    table_ = toxicity._class_table(auto)
    rng = random.Random(1)
    words = set()
    for t, _ in terms:
        for _ in range(400):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                k = rng.randint(0, len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "i", "o", "t", "z", "n"])
                if rng.random() < 0.3 and len(w) > 1:
                    j = rng.randrange(len(w) - 1)
                    w[j], w[j + 1] = w[j + 1], w[j]
            words.add("".join(w))
    words = sorted(w for w in words if w)
    hits = toxicity.find_hits([" ".join(words)], auto, table_)[-1]
    got = {int(h[0]): int(h[1]) for h in hits.T}
    for i, w in enumerate(words):
        want = 4 if w in ("idiot", "stupid", "clown", "cow") else 3 if w.startswith("vequ") else 2 if any(within(w, t) for t in ("idiot", "stupid", "clown")) else 0
        assert got.get(i, 0) == want, w


def test_toxicity_context():
    auto = toxicity.Automaton([("idiot", False)])
    t = toxicity._class_table(auto)
    plain, said, leet, marked = toxicity.features(["you idiot , go", 'she read "you idiot , go" aloud', "you 1d10t", "an idiot### there"], auto, t)
    assert plain[0] > said[0] > 0 and said[4] > 0 and plain[4] == 0
    assert leet[0] == plain[0] == marked[0]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op3_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in scored)
    assert right / len(scored) > 0.93
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (4, 1)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(odd, labels)
    assert toxicity.score_toxicity(odd, model, out="shard").count() == odd.count()
    toxicity.learn_toxicity(empty, labels)
    assert toxicity.score_toxicity(odd, None).where("score <> 0").count() == 0
    assert toxicity.score_toxicity(empty, None).count() == 0


# ---- 4: byte-level BPE


@pytest.fixture(scope="session")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, odd, empty, reference_encoding):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    out = bpe.bpe_decode(bpe.bpe_encode(docs, queries.RANKS, queries.PATTERN), queries.RANKS).collect()
    assert sorted(out, key=str) == sorted(bpe.bpe_round_trip(docs, queries.RANKS, queries.PATTERN).collect(), key=str)
    assert len(out) == docs.count()
    for r in out:
        assert r["ids"] == reference_encoding.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.bpe_encode(empty, queries.RANKS, queries.PATTERN).count() == 0


def test_bpe_of_random_pieces(reference_encoding):
    ranks = bpe.Ranks(open(queries.RANKS, "rb").read())
    encoder = bpe.Encoder(ranks, queries.PATTERN)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeé \n'sß你!12") for _ in range(rng.randint(0, 90))) for _ in range(400)] + ["a" * 3000, "!" * 777, "<|endoftext|>", "\x1c\x85  x"]
    ids, offsets = encoder.texts(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == reference_encoding.encode_ordinary(t)
    encoder.forget()
    for t in texts[-4:]:
        assert encoder.texts([t], step=8)[0].tolist() == reference_encoding.encode_ordinary(t)


def test_bpe_digests(spark, reference_encoding):
    texts = {r["doc_id"]: r["text"] for r in rows_of(spark)}
    for r in queries.op4_byte_bpe(spark, SF).collect():
        ids = reference_encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# ---- 5: sharding


def test_shards(spark):
    out = queries.op5_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in rows_of(spark)}
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_of_many_buckets_are_the_same_each_time(spark, odd, empty, tmp_path):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    runs = [sorted((r["doc_id"], r["shard"], r["slot"]) for r in shards.shuffled_shards(d, shards=7, bucket_bytes=20_000).collect()) for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1]
    assert [i for _, i in sorted((r[1:], r[0]) for r in runs[0])] != sorted(r[0] for r in runs[0])
    again = shards.shuffled_shards(odd, shards=3)
    assert again.count() == odd.count() and again.schema["shard"].dataType.simpleString() == "int"
    assert shards.shuffled_shards(empty).count() == 0
    shards.write_shards(docs, str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4
    assert sorted(shards.fisher_yates(50, [1, 2]).tolist()) == list(range(50))


# ---- 6: quality


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_quality_statistics():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "é\t", "\n", "|", "a b c ", " ", "x\n"]) for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text)[0] == brute_statistics(text), repr(text)


def test_quality_query(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_quality_rules(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").collect()
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    passed = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] == bool(r["quality"]) for r in passed) / len(passed) > 0.95
    assert quality.quality_verdicts(odd, None, text="text").count() == odd.count()
    assert quality.quality_verdicts(empty, None).count() == 0
    assert quality.learn_quality(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None
    assert quality.quality_verdicts(odd, quality.learn_quality(odd, spark.createDataFrame([(1, 1), (3, 0), (5, 0)], "doc_id long, quality int"))).count() == odd.count()


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(4 * np.sin(6 * x[:, 0]) + 3 * x[:, 1])))).astype(float)
    model = quality.fit_trees(x, y, [-1, 0])
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4)], 1)
    assert (np.diff(model.score(grid)) <= 1e-12).all()
    free = quality.fit_trees(x, y, [0, 0])
    assert ((free.score(x) > 0.5) == y).mean() > 0.8
    assert (np.diff(free.score(grid)) > 0).any()


# ---- 7: SimHash


def brute_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= distance:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash_query(spark):
    docs = rows_of(spark)
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}
    roots = brute_components(set(fps.values()))
    smallest = {}
    for i, f in fps.items():
        smallest[roots[f]] = min(i, smallest.get(roots[f], i))
    out = queries.op7_simhash(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == smallest[roots[fps[r["doc_id"]]]]


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = {rng.getrandbits(64) for _ in range(n)}
    for c in centres:
        for _ in range(n // 6):
            out.add(c ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randint(0, 5))}))
    return out | {0, (1 << 64) - 1, 1 << 63, 7}


@pytest.mark.parametrize("distance,hot_key", [(3, 256), (3, 2), (2, 2), (1, 2), (3, 10)])
def test_links_give_all_components(spark, distance, hot_key):
    fps = clustered(240, distance)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = simhash.link_fingerprints(df, distance, hot_key)
    roots = {r["node"]: r["root"] for r in graphs.connected_components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for f, r in brute_components(fps, distance).items():
        want[r].add(f)
        got[roots.get(signed(f), signed(f))].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_partitions_keep_the_pigeonhole():
    rng = np.random.default_rng(1)
    for n in (10, 1000, 200_000, 50_000_000):
        bits = (rng.random((4000, 64)) < 0.5).astype(float)
        bits[:, 5] = bits[:, 40]
        pairs = bits.T @ bits / 4000 * n
        for distance in (1, 2, 3, 5):
            parts = simhash.plan_partitions(n, pairs, distance)
            used = [b for bits_, _ in parts for b in bits_]
            assert len(used) == len(set(used))
            assert any((5 in b) == (40 in b) for b, _ in parts)
            assert sum(t + 1 for _, t in parts) == distance + 1  # the others are -1


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    zero = {(r["doc_id"], r["component_id"]) for r in out if r["fp"] == 0}
    assert zero == {(2, 2), (3, 2), (4, 2), (None, 2)}
    kept = simhash.drop_near_duplicates(odd).collect()
    assert Counter(r["doc_id"] for r in kept)[1] == 1 and len(kept) < odd.count()
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_a_leaders_copies_keep_their_links(spark):
    """1 is alike 2 and 2 is alike 3, but 1 isn't alike 3, whatever else shares the key."""
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20] + ["c", "d"] + words[22:])), (3, " ".join(words[:20] + ["c", "d"] + words[22:60] + ["e", "f"] + words[62:]))]
    rows += [(10 + k, " ".join(words[:96] + [f"x{k}"] + words[97:])) for k in range(40)]  # copies of the first that differ near its end
    sets = {i: set(near_copies.shingle_set(t).tolist()) for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert like(1, 2) >= 0.8 and like(2, 3) >= 0.8 and like(1, 3) < 0.8
    for hot_key in (2, 10_000):
        kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), hot_key=hot_key).collect()
        assert [r["doc_id"] for r in kept] == [1]


@pytest.mark.parametrize("hot_key", [256, 4])
def test_near_copies_equal_brute_force(spark, hot_key):
    rng = random.Random(7)
    rows = [(d["doc_id"], d["text"]) for d in rows_of(spark)]
    passage = [f"common{i}" for i in range(40)]
    for k in range(40):  # copies in which words are exchanged, and texts that share a passage only
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(4, 200))]
        rows.append((10_000 + 100 * k, " ".join(words)))
        for c in range(1, 8):
            rows.append((10_000 + 100 * k + c, " ".join("x" + w if rng.random() < 0.004 * c else w for w in words)))
        rows.append((20_000 + k, " ".join(words[:40] + passage)))
    sets = {i: set(near_copies.shingle_set(t).tolist()) for i, t in rows}
    alike = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) * 10 >= 8 * (len(sets[a]) + len(sets[b]) - n)}
    assert len(alike) > 300
    kept = {r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), hot_key=hot_key).collect()}
    assert not any(a in kept and b in kept for a, b in alike)
    root = {i: i for i in sets}
    for a, b in sorted(alike) * 3:
        root[a] = root[b] = min(root[a], root[b])
    firsts = {i for i, r in root.items() if i == r}
    assert kept == firsts


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (5000, 5000), (None, 3)]
    out = {r["node"]: r["root"] for r in graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and all(out[1000 + i] == 1000 for i in range(50)) and out[5000] == 5000


# ---- 8: mixing


def test_mixing_budgets(spark):
    rows = [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 10), ("books", "en", "d", 5000), ("books", "en", "e", 0)]
    leaves = spark.createDataFrame(rows, "domain string, language string, origin string, tokens long")
    out = {r["origin"]: r["given"] for r in mixing.leaf_budgets(leaves, {}, 0.5, 1).collect()}
    # 3055 tokens: web can't take half of them, so it is filled, and books take what is left
    assert out == {"a": 100, "b": 1000, "c": 10, "d": 1945, "e": 0}
    # siblings come first: c is short by 95, which its domain's other language takes before the other domain
    out = {r["origin"]: r["given"] for r in mixing.leaf_budgets(leaves, {("web",): 1, ("books",): 9}, 0.2, 1).collect()}
    assert out["c"] == 10 and out["a"] + out["b"] in (111, 112) and out["a"] in (55, 56)


def test_mixing_prefixes(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    out = queries.op8_source_mixing(spark, sf).collect()
    docs = rows_of(spark, sf=sf)
    total = sum(len((d["text"] or "").split()) for d in docs)
    taken = sum(r["n_tokens"] for r in out)
    assert 0.57 * total < taken <= 0.6 * total
    assert len({(r["doc_id"], r["epoch"]) for r in out}) == len(out)
    mixed = mixing.mix_sources(odd, {}, queries.domain_of(), share=1.0, max_epochs=1)
    assert mixed.where("n_tokens > 0").count() == odd.where("text rlike '[^ \\n\\t]'").count()
    assert set(odd.columns) <= set(mixed.columns)
    assert mixing.mix_sources(empty, {}, queries.domain_of()).count() == 0


# ---- 9: line dedup


def brute_lines(docs, min_words=3, near_words=5):
    """The lines that go from each (doc_id, text)."""
    lines = [(i, k, line.encode().split()) for i, text in docs for k, line in enumerate(text.split("\n"))]
    lines = sorted((x for x in lines if len(x[2]) >= min_words), key=lambda x: x[:2])
    gone = set()
    for n, (i, k, words) in enumerate(lines):
        for _, _, other in lines[:n]:
            if words == other or len(words) >= near_words and len(other) >= near_words and line_dedup.within_one(words, other):
                gone.add((i, k))
                break
    return gone


def check_lines(spark, docs):
    gone = brute_lines(docs)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        assert out[i]["text"] == "\n".join(line for k, line in enumerate(text.split("\n")) if (i, k) not in gone)
        assert out[i]["n_dropped"] == sum((i, k) in gone for k in range(text.count("\n") + 1))


def test_line_dedup_of_edited_lines(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 14))] for _ in range(60)]
    docs = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k = rng.randint(0, len(words))
                words[k : k + rng.randint(0, 1)] = [f"w{rng.randrange(30)}"] * rng.randint(0, 1)
            lines.append("  ".join(words))
        docs.append((i * 3, "\n".join(lines)))
    check_lines(spark, docs)


def test_line_dedup_of_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark)]
    gone = brute_lines(docs)
    out = {r["doc_id"]: r for r in queries.op9_line_dedup(spark, SF).collect()}
    assert len(out) == len(docs)
    for i, text in docs:
        assert out[i]["text"] == "\n".join(line for k, line in enumerate(text.split("\n")) if (i, k) not in gone)
        assert out[i]["n_dropped"] == sum((i, k) in gone for k in range(text.count("\n") + 1))


def test_line_dedup_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(common.if_few, "__defaults__", (0,))
    docs = [(i, "\n".join([f"line of words number {i % 7} for the test", f"own {i} text of {i * i} here", "a short"])) for i in range(60)]
    check_lines(spark, docs)


def test_one_mistyped_word_in_short_and_long_lines(spark):
    check_lines(spark, [(1, "the quick brown fox jumps over dogs\nfive words are in this"), (2, "the quick brown fox jumped over dogs\nfive words are on this"), (3, "four words are here"), (4, "four words are there")])


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_sieve_keeps_all_keys(spark, bits):
    rows = spark.range(5000).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("a"), (F.col("id") % 3).alias("b"))
    keys = rows.where("a % 40 = 1 or a is null")
    out = common.sieved(rows, ["a", "b"], keys, ["a", "b"], bits=bits)
    assert out.count() == 5000 and out.columns == ["a", "b", "__maybe"]
    assert out.where("(a % 40 = 1 or a is null) and not __maybe").isEmpty()
    assert bits == 64 or out.where("__maybe").count() < 720
    assert common.sieved(rows, ["a", "b"], keys.limit(0), ["a", "b"]).where("__maybe").isEmpty()


def test_variants_meet_within_one_edit():
    rng = random.Random(6)
    for _ in range(500):
        a = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 6))]
        b = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 6))]
        meet = bool(set(line_dedup.variants(a).tolist()) & set(line_dedup.variants(b).tolist()))
        small = [a[:i] + x + a[j:] for i in range(len(a) + 1) for j in (i, i + 1) for x in ([], *([w] for w in (b"a", b"b", b"c")))]
        assert meet == (b in small) == line_dedup.within_one(a, b)


def test_line_dedup_on_odd_rows(spark, odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and line_dedup.dedup_lines(empty).count() == 0
    texts = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert texts[:2].count("") == 1 and None in texts  # the null id's line is in document 1
    assert [c for c in out.columns] == [*odd.columns, "n_dropped"]


# ---- 10: secrets


def brute_base(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in rows_of(spark, sf=sf)}
    names = ["assign", "access", "hex"]
    n = 0
    for r in queries.op10_secret_scan(spark, sf).collect():
        spans = brute_base(texts[r["doc_id"]])
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))
        n += len(spans)
    assert n > 0
    found = secrets.scan_secrets(odd, queries.RANKS, queries.PATTERN, out="shard").where("doc_id = 7").first()["shard"]
    assert [(s["kind"], s["start"]) for s in found] == [("assign", 17)]
    assert secrets.scan_secrets(empty, queries.RANKS, queries.PATTERN).count() == 0


def test_random_runs(reference_encoding):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(50)]
    hit = sum(bool(secrets.random_runs(f"see {k} there", reference_encoding)) for k in keys)
    assert hit >= 48
    for plain in ("the_quick_brown_fox_jumps_2024", "HttpServletRequestWrapperFactory", "python-3-11-2-linux-x86-64", "2024-01-02T03-04-05-678", "/usr/local/lib/python3/dist-packages", "src/main/java/org/example/Application", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "internationalization", "1234567890123456789012345"):
        assert not secrets.random_runs(plain, reference_encoding), plain


# ---- pipeline


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF))
        if name != "tokens":
            assert kept[-1].columns == docs.columns and kept[-1].schema.simpleString() == docs.schema.simpleString()
    sizes = [k.count() for k in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    fps = [brute_fingerprint(r["text"]) for r in kept[3].collect()]
    assert all((a ^ b).bit_count() > 3 for a, b in itertools.combinations(fps, 2))
    assert kept[-1].where("not round_trip").count() == 0
    run = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in run.collect()) == sorted(r["doc_id"] for r in kept[-1].collect())


def test_pipeline_on_empty_and_odd_tables(spark, odd, empty):
    for docs in (odd, empty):
        d = docs
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        assert d.count() <= docs.count()


def test_registered_queries_have_rows(spark):
    for name, query in queries.QUERIES.items():
        assert query(spark, SF).count() > 0, name
        assert re.match(r"op\d+_", name)
