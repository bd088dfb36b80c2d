"""Licence, toxicity and secret scans against brute-force versions, at any wrapping, and on long texts and hot rows."""

import hashlib
import itertools
import random
import re
import string
import textwrap
import time
from collections import Counter

import pytest

from tallyforge.llm import licenses, queries, secrets, toxicity
from tallyforge.llm.common import table

SF = "/root/testdata/sf0.001"
COMMON = "/usr/share/common-licenses"


def texts_of(spark, sf=SF):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}


# ---- licences


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p), width, break_long_words=False, break_on_hyphens=False) for p in licenses._paragraphs(text))


@pytest.mark.parametrize("name", sorted(licenses.TEXTS))
def test_texts_at_every_width(name):
    known = {d: n for d, n, kind in licenses.catalogue() if kind == "text"}
    text = licenses.TEXTS[name].replace("<year>", "1999-2021").replace("<holder>", "The Authors of Something, Incorporated, and all other contributors")
    for width in range(40, 121):
        assert any(known.get(d) == name for d in licenses.digests(wrapped(text, width))), width


@pytest.mark.parametrize("file,name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_published_texts_at_every_width(file, name):
    try:
        with open(f"{COMMON}/{file}", encoding="utf-8") as f:
            text = f.read()
    except OSError:
        pytest.skip("the system has no licence texts")
    known = {d: n for d, n, kind in licenses.catalogue() if kind == "text"}
    assert known[licenses.digests(text)[0]] == name
    for width in range(40, 121):
        assert known.get(licenses.digests(wrapped(text, width))[0]) == name, width


def test_forms_of_notices():
    body = licenses.TEXTS["ISC"].split("\n\n", 2)[2]
    known = {d: n for d, n, kind in licenses.catalogue() if kind == "text"}
    for head in ("ISC License\n\nCopyright 2020 A\nCopyright 2021 by B\n\n", "Copyright (c) 2020 A\n", "The ISC License (ISC)\nCopyright © 2004 A\nand B\n\n", "# Copyright (C) 1999 A\n# All rights reserved.\n#\n# ", "", "Portions Copyright 2001 A\n\n"):
        assert "ISC" in [known.get(d) for d in licenses.digests(head + body)], head
    sentence = "keep the above\ncopyright notice and this permission notice\nin all copies"
    assert licenses.canonical(sentence) == licenses.canonical(sentence, False) == "keep the above copyright notice and this permission notice in all copies"
    assert licenses.canonical("Copyright (c) 2020 A") == licenses.canonical("") == ""


@pytest.mark.parametrize("notice", ["Copyright Jane Doe", "Copyright Contributors to the Foo project", "Copyright The Authors. All rights reserved.", "(C) Jane Doe", "© Jane Doe", "Copyright Jane Doe\n(c) The Authors"])
def test_notices_without_a_year(notice):
    known = {d: n for d, n, kind in licenses.catalogue() if kind == "text"}
    title, _, body = licenses.TEXTS["MIT"].split("\n\n", 2)
    for width in range(40, 121):
        for text in (f"{notice}\n\n{body}", f"{title}\n\n{notice}\n\n{body}"):
            assert "MIT" in [known.get(d) for d in licenses.digests(wrapped(text, width))], width
    assert "MIT" in [known.get(d) for d in licenses.digests(f"{notice}\n{body}")]
    assert "MIT" not in [known.get(d) for d in licenses.digests(f"{body}\n\n{notice} keep what follows in mind")]


def test_a_sentence_on_copyright_stays_behind_the_head():
    text = "The first sentence has no title.\n\nCopyright law is a broad field.\n(c) is the third point."
    assert licenses.canonical(text) == licenses.canonical(text, False) == "the first sentence has no title copyright law is a broad field c is the third point"


def test_large_catalogue_and_own_notices(spark):
    entries = [(hashlib.sha256(f"body number {i}".encode()).hexdigest(), f"L{i:05}", "text") for i in range(20_000)]
    entries += [(hashlib.sha256(b"free for all").hexdigest(), "own", "notice")]
    docs = spark.createDataFrame([(1, "Body, number 19999!"), (1, "body number 7"), (2, "prose\nFREE -- for all\n"), (None, "body  number 20000")], "doc_id long, text string")
    rows = [(r["doc_id"], r["license"], r["notices"]) for r in licenses.scan_licenses(docs, entries).collect()]
    assert sorted(rows, key=str) == sorted([(1, "L19999", []), (1, "L00007", []), (2, None, ["own"]), (None, None, [])], key=str)
    as_table = spark.createDataFrame(entries, "digest string, license string, kind string")
    assert licenses.scan_licenses(docs, as_table).where("license = 'L19999'").count() == 1


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_of_licenses_equals_brute_force(spark, sf):
    whole = {d: n for d, n, kind in licenses.catalogue() if kind == "text"}
    lines = {re.sub(r"[\W_]+", " ", n).strip().casefold().replace("licence", "license").replace("version ", "v "): k for k, ns in licenses.NOTICES.items() for n in ns}
    out = {r["doc_id"]: r for r in queries.op2_license_scan(spark, sf).collect()}
    texts = texts_of(spark, sf)
    assert out.keys() == texts.keys()
    for i, text in texts.items():
        found = {lines.get(re.sub(r"[\W_]+", " ", x).strip().casefold().replace("licence", "license").replace("version ", "v ")) for x in text.split("\n")} - {None}
        assert out[i]["notices"] == ",".join(sorted(found))
        assert out[i]["license"] == next((whole[d] for d in licenses.digests(text) if d in whole), None)
        assert out[i]["text_digest"] == hashlib.sha256(licenses.canonical(text).encode()).hexdigest()


# ---- toxicity


def edits(word, shift):
    letters = string.ascii_lowercase
    out = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    if shift:
        out |= {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def test_every_term_is_sought_with_misspellings():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9))) for _ in range(500)})
    auto = toxicity.Automaton([(t, False) for t in terms])
    classes = toxicity._class_table(auto)
    exact = set(terms)
    words = sorted({rng.choice(sorted(edits(t, True))) for t in terms for _ in range(3)} | exact)
    hits = toxicity.find_hits([" ".join(words)], auto, classes)[-1]
    got = {int(w): int(k) for w, k in zip(hits[0], hits[1])}
    near = set().union(*(edits(t, len(t) >= toxicity.LOOSE) for t in terms if len(t) >= toxicity.BENT))
    for i, w in enumerate(words):
        assert got.get(i, 0) == (4 if w in exact else 2 if w in near else 0), w
    auto.forget()
    assert (toxicity.find_hits([" ".join(words)], auto, classes)[-1][:2] == hits[:2]).all()


def test_misspelt_stems():
    auto = toxicity.Automaton([("achlich", True), ("cow", False)])
    classes = toxicity._class_table(auto)
    words = {"achlichkeit": 3, "achlich": 3, "achlihckeit": 1, "chlichung": 1, "aachlichkeit": 1, "achxichab": 1, "chlihc": 0, "achli": 0, "cow": 4, "cox": 0, "achlic": 1}
    hits = toxicity.find_hits([" ".join(words)], auto, classes)[-1]
    got = {int(w): int(k) for w, k in zip(hits[0], hits[1])}
    assert {w: got.get(i, 0) for i, w in enumerate(words)} == words


def test_quotation_of_any_length():
    auto = toxicity.Automaton([("idiot", False)])
    classes = toxicity._class_table(auto)
    far = "so long a talk " * 80
    cases = {f'he read "{far} idiot {far}" aloud': 1, f'he read "{far}" and idiot {far}': 0, f"« {far} idiot {far} »": 1, f"„{far}“ {far} idiot": 0, f"„{far} idiot": 1, f'"open\n{far} idiot " x': 0, f"{far} she said idiot": 1}
    for text, said in cases.items():
        row = toxicity.features([text], auto, classes)[0]
        assert (row[4] > 0) == bool(said), text[:60]


def test_long_texts_take_linear_time():
    auto = toxicity.Automaton([("idiot", False)])
    classes = toxicity._class_table(auto)
    began = time.perf_counter()
    toxicity.features(['an idiot, "idoit" and prose ' * 370_000], auto, classes)  # 10 MB with 740,000 hits
    assert time.perf_counter() - began < 120


def test_labelled_ids_that_documents_repeat(spark):
    rows = [(i, f"you idiot and moron number {i}" if i % 2 else f"a fine day number {i}") for i in range(200)] + [(1, f"variant {i}") for i in range(3000)] + [(None, "idiot")] * 50
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen, counts = toxicity.labelled_sample(labels, "toxic", 6000, 0)
    sample = toxicity.texts_of_sample(docs, chosen)
    assert sample.count() == 200 and counts == {0: 100, 1: 100}
    model = toxicity.learn_toxicity(docs, labels)
    assert {("idiot", False), ("moron", False)} <= set(model.terms)
    out = {r["text"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame([(1, "what an idiot"), (2, "what a fine day")], "doc_id long, text string"), model).collect()}
    assert out["what an idiot"] > out["what a fine day"]


# ---- secrets


@pytest.fixture(scope="session")
def encoding():
    with open(queries.RANKS, "rb") as f:
        return secrets._encoding(f.read(), queries.PATTERN)


KEYS = set(string.ascii_letters + string.digits + "+/_=-")
HEXES = {32, 40, 56, 64, 96, 128}


def brute_random(text, encoding):
    """The rule of random runs, run by run and character by character."""

    def runs(s, allowed, start=0):
        for good, group in itertools.groupby(enumerate(s), lambda x: x[1] in allowed):
            at = list(group)
            if good and len(at) >= 16:
                yield start + at[0][0], start + at[-1][0] + 1

    def random_(run):
        run = run.strip("=")
        letters = sum(c in string.ascii_letters for c in run)
        is_hex = len(run) in HEXES and (all(c in "0123456789abcdef" for c in run) or all(c in "0123456789ABCDEF" for c in run))
        is_uuid = [len(x) for x in run.split("-")] == [8, 4, 4, 4, 12] and all(c in string.hexdigits + "-" for c in run)
        parts = "".join(c if c in string.ascii_letters + string.digits else " " for c in run).split()
        if is_hex or is_uuid or letters * 4 < len(run) or max(map(len, parts), default=0) < 8:
            return False
        name = run.rstrip(string.digits)
        if len(run) - len(name) <= 4 and name and not any(c in string.digits for c in name):
            return len(name) / len(encoding.encode_ordinary(name)) < 1.85
        return len(run) / len(encoding.encode_ordinary(run)) < 2.1

    for a, b in runs(text, KEYS):
        if random_(text[a:b]):
            yield a, b
        elif set(text[a:b]) & set("/="):
            yield from ((c, d) for c, d in runs(text[a:b], KEYS - set("/="), a) if random_(text[c:d]))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_of_secrets_equals_brute_force(spark, encoding, sf):
    texts = texts_of(spark, sf)
    for r in queries.op10_secret_scan(spark, sf).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = [(int(a), int(b)) for kind, a, b in spans if kind != "random"]
        want = [(a, b) for a, b in brute_random(texts[r["doc_id"]], encoding) if not any(c < b and a < d for c, d in base)]
        assert [(int(a), int(b)) for kind, a, b in spans if kind == "random"] == want


@pytest.mark.parametrize("letters,length,least", [(string.ascii_letters, 16, 0.97), (string.ascii_letters + string.digits, 16, 0.99), (string.ascii_letters + string.digits + "+/", 40, 0.99), (string.ascii_lowercase, 24, 0.85), (string.ascii_lowercase + string.digits, 20, 0.98)])
def test_recall_of_random_keys(encoding, letters, length, least):
    rng = random.Random(length)
    keys = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(400)]
    assert sum(bool(secrets.random_runs(f"see {k}.", encoding)) for k in keys) / len(keys) >= least


def test_keys_behind_paths(encoding):
    key = "q7Zk0PvB3mXw9LrT5yHd"
    text = f"/application/configuration/production/environment/settings/{key}"
    (a, b), *_ = secrets.random_runs(text, encoding)
    assert text[a:b].endswith(key) and not secrets.random_runs(text.removesuffix(key), encoding)


def test_spans_beside_many_patterns(encoding):
    rng = random.Random(7)
    piece = lambda n: "".join(rng.choice(string.ascii_letters) for _ in range(n))
    text = " ".join(f"token={piece(12)} {piece(22)}" for _ in range(2000))
    spans = secrets.find_secrets(text, encoding)
    assert Counter(k for _, k, _ in spans)[0] == 2000 and Counter(k for _, k, _ in spans)[3] > 1900
    taken = [(a, b) for a, k, b in spans if k != 3]
    assert all(not any(c < b and a < d for c, d in taken[max(0, i // 2 - 3) : i // 2 + 4]) for i, (a, k, b) in enumerate(spans) if k == 3)
    began = time.perf_counter()
    assert len(secrets.find_secrets((text + "\n") * 110, encoding)) > 400_000  # 10 MB
    assert time.perf_counter() - began < 120
