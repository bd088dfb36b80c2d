"""Near-duplicate lines, by a join on hashed deletion neighbourhoods.

A line is its words. Two lines are duplicates if their words are equal (lines of ``MIN_WORDS`` words or more) or if one
edit - a word put in, left out or exchanged - turns one into the other (both of ``NEAR_WORDS`` words or more). A
line goes if an earlier one, by document id and line number, is a duplicate of it, whether or not that one stays. With
``NEAR_WORDS`` of 5, lines that one edit parts are 0.8 alike or more.

Every variant of a line within the bound is a line with one word less, tagged by the place of the gap; the line
itself, tagged by each place where a gap could be, stands for the longer lines. All lines that emit an equal
variant are within one edit of each other, so each is compared with the earliest of them alone, on its words.
Any two lines within one edit share a half, and the edit is in the other: variants are emitted only for lines
that share a half with another line, and only for gaps in the half that they don't share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import blocks, bound_batches, cut, if_few, if_small, sieve_bits, sieved, stored

MIN_WORDS, NEAR_WORDS = 3, 5

#: Tables that whole texts are joined to may be broadcast with so many times the usual rows: shuffled texts are most of what a disk would hold.
TEXTS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HALVES = ["k1", "k2", "k3", "k4"]


def _half_keys(words: list[bytes]) -> tuple[int, int, int, int]:
    """Hashes of the first and the last half as a line of n words, and as one that had n - 1."""
    n, out = len(words), []
    for size in (n, n - 1):
        half = size // 2
        out.append(xxhash.xxh64_intdigest(b" ".join(words[:half]), 2 * size))
        out.append(xxhash.xxh64_intdigest(b" ".join(words[n - size + half :]), 2 * size + 1))
    return tuple(out)


def line_table(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """One row a line of ``min_words`` words or more of ``docs`` (doc_id, th, text).

    h1 and h2 hash its words; ``again`` marks a line that the same text has before; k1 to k4 hash its halves, null below ``near_words``.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id long, th long, line int, again boolean, h1 long, h2 long, k1 long, k2 long, k3 long, k4 long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                ids, ths, numbers, agains, digests, halves, wide = [], [], [], [], [], [], []
                for i, th, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text"))):
                    seen = set()
                    for number, line in enumerate((text or "").encode().split(b"\n")):
                        words = line.split()
                        if len(words) < min_words:
                            continue
                        digest = xxhash.xxh3_128_digest(b" ".join(words))
                        ids.append(i)
                        ths.append(th)
                        numbers.append(number)
                        agains.append(digest in seen)
                        digests.append(digest)
                        wide.append(len(words) >= near_words)
                        halves.append(_half_keys(words) if wide[-1] else (0, 0, 0, 0))
                        seen.add(digest)
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                k = np.array(halves, np.uint64).reshape(-1, 4).view(np.int64)
                mask = ~np.array(wide, bool)
                columns = [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(numbers, pa.int32()), pa.array(agains, pa.bool_())]
                columns += [pa.array(np.ascontiguousarray(h[:, c])) for c in (0, 1)] + [pa.array(np.ascontiguousarray(k[:, c]), mask=mask) for c in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "th", "text").mapInArrow(run, schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def variants(words: list[bytes], head: bool = True, tail: bool = True) -> np.ndarray:
    """Hashed keys of the line's deletion neighbourhood: each gap's place with the words left, then each place with all words.

    ``head`` and ``tail`` ask for gaps in the first half, the middle included, and in the last.
    """
    n = len(words)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    powers = np.cumprod(np.full(n, _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
    without = sums[:-1] + (sums[-1] - sums[1:]) * _INVERSE
    places = _mixed((np.arange(n + 1, dtype=np.uint64) + np.uint64(1)) * _BASE)
    low, high = 0 if head else (n - 1) // 2, n + 1 if tail else n // 2 + 1
    return np.concatenate([_mixed(without ^ places[:n])[low:high], _mixed(sums[-1] ^ places)[low:high]])


def within_one(a: list, b: list) -> bool:
    """Whether one edit at most turns the words a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, th, line) of each first occurrence in ``lines`` that has an earlier line within one edit; ``docs`` has the texts."""
    first = lines.where("not again and k1 is not null and doc_id is not null")
    halves = F.array(*[F.struct(F.col(k).alias("key"), F.lit(i % 2 == 0).alias("first_half")) for i, k in enumerate(_HALVES)])
    keyed = first.select("doc_id", "th", "line", "h1", "h2", F.explode(halves).alias("k")).select("*", "k.key", "k.first_half").drop("k")
    shared = cut(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"))
    near = keyed.join(if_few(shared), "key", "left_semi").groupBy("h1", "h2")
    place = [F.min("doc_id").alias("doc_id"), F.min_by("th", "doc_id").alias("th"), F.min_by("line", "doc_id").alias("line")]
    near = cut(near.agg(*place, F.bool_or(~F.col("first_half")).alias("head"), F.bool_or("first_half").alias("tail")).drop("h1", "h2"))
    n = near.count()
    likely = sieved(docs, ["doc_id", "th"], near, ["doc_id", "th"], bits=sieve_bits(n)).where("__maybe").drop("__maybe")
    texts = likely.join(if_small(near, n, TEXTS), ["doc_id", "th"]).select("doc_id", "th", "line", "head", "tail", F.get(F.split("text", "\n"), F.col("line")).alias("words"))
    texts = cut(texts.distinct())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "words", 1 << 17):
                keys = [variants(x.encode().split(), head, tail) for x, head, tail in zip(*(part.column(c).to_pylist() for c in ("words", "head", "tail")))]
                at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                some = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(some), *(part.column(c).take(at) for c in ("doc_id", "th", "line"))], names=["key", "doc_id", "th", "line"])

    own = texts.select("doc_id", "th", "line", "head", "tail", "words").mapInArrow(emit, "key long, doc_id long, th long, line int")
    lines_of_key = own.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("line").alias("c"), F.max("line").alias("d"))
    met = cut(lines_of_key.where("a <> b or c <> d").select("key"))
    own = own.join(if_few(met), "key", "left_semi")
    place = F.struct("doc_id", "line", "th")
    earliest = own.groupBy("key").agg(F.min(place).alias("e"))
    pairs = own.join(earliest, "key").where(F.struct("doc_id", "line") > F.struct("e.doc_id", "e.line"))
    pairs = pairs.select("doc_id", "th", "line", *[F.col(f"e.{c}").alias(f"{c}_e") for c in ("doc_id", "th", "line")]).distinct()
    other = texts.select(*[F.col(c).alias(f"{c}_e") for c in ("doc_id", "th", "line", "words")])
    compared = pairs.join(texts, ["doc_id", "th", "line"]).join(other, ["doc_id_e", "th_e", "line_e"]).select("doc_id", "th", "line", "words", "words_e")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(a.encode().split(), b.encode().split()) for a, b in zip(batch.column("words").to_pylist(), batch.column("words_e").to_pylist())]
            yield batch.select(["doc_id", "th", "line"]).filter(pa.array(good, pa.bool_()))

    return compared.mapInArrow(verify, "doc_id long, th long, line int").distinct()


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """``df`` with duplicate lines taken out of ``text``, and ``n_dropped``, the number of lines that went.

    Of equal lines the first of the smallest id stays; rows of one id are one document, whose equal lines in
    different rows all stay. Rows of a null id come last: they lose lines that others have, and are compared with
    equal lines only. Shorter lines and empty ones stay. Null texts stay null; an empty table gives no rows; repeated rows are one document
    and stay as often. Other columns pass, one named n_dropped is replaced. Only texts that a line is looked up in or taken from
    are shuffled, beyond what is broadcast: a bitmap of their ids tells them.
    """
    hashed = df.withColumn("__th", F.xxhash64(F.col(text)))
    docs = hashed.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("__th").alias("th"), F.col(text).alias("text")).where("text is not null")
    lines = stored(line_table(docs, min_words, near_words))
    repeated = lines.where("not again").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("d"))
    repeated = cut(repeated.where("n > 1 and d is not null").select("h1", "h2", "d"))
    exact = lines.where("not again").join(if_few(repeated), ["h1", "h2"]).where("doc_id is null or doc_id > d")
    gone = exact.select("doc_id", "th", "line").unionByName(lines.where("again").select("doc_id", "th", "line")).unionByName(near_lines(lines, docs))
    gone = cut(gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("__gone")))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__h"), "__gone")
    n = gone.count()
    marked = sieved(hashed.withColumn("__i", F.col(doc_id).cast("long")), ["__i", "__th"], gone, ["__id", "__h"], bits=sieve_bits(n))
    met = F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h"))
    likely = marked.where("__maybe").join(if_small(gone, n, TEXTS), met, "left")
    joined = likely.drop("__id", "__h").unionByName(marked.where("not __maybe").withColumn("__gone", F.lit(None).cast("array<int>")))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    columns = [F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(c) for c in df.columns if c != "n_dropped"]
    return joined.select(*columns, F.coalesce(F.size("__gone"), F.lit(0)).alias("n_dropped"))
