"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by the generalised pigeonhole principle.

The bits are dealt into a few partitions, correlated bits together. Partition i gets a threshold t_i, and
the thresholds of m partitions add up to ``distance - m + 1``: two fingerprints within ``distance`` then
differ in t_i or fewer bits in at least one partition. The number of partitions and the thresholds are
the cheapest by a dynamic program over estimated probes and candidates. Every fingerprint is indexed by its
bits in each partition and probes with those bits after all flips of up to t_i of them; candidates are
verified on all 64 bits inside the join, so only true links leave it.

An index key with more than ``hot_key`` fingerprints isn't joined. Its members, and the fingerprints that
probe it, are linked through the fingerprints around them instead (see ``_star_links``), with a number of
rows that is in proportion to the members, and the same components.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import cut, if_small, with_arrow
from tallyforge.operators.graphs import connected_components

BITS = 64
#: Shingles whose bits are unpacked at a time.
STEP = 1 << 17
#: Cost of verifying one candidate, in probes.
VERIFY = 10.0


def fingerprints(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text as uint64; a text without words has 0."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
        if not words:
            continue
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(seed))), ">u8")
        ones = np.zeros(BITS, np.int64)
        for start in range(0, len(hashes), STEP):
            bits = np.unpackbits(hashes[start : start + STEP].view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(hashes)).view(">u8")[0]
    return out


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``df`` with ``out``: the fingerprint's 64 bits as a long (a null text is an empty one)."""

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [(x or "").encode() for x in batch.column(text).to_pylist()]
            return [pa.array(fingerprints(texts, shingle, seed).view(np.int64))]

        return step

    return with_arrow(df, text, [T.StructField(out, T.LongType())], make)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both of each pair of bits set, over all rows of ``fps`` (fp)."""

    def run(batches):
        pairs, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            words = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).astype(">i8")
            bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            pairs += bits.T @ bits
            rows += len(bits)
        flat = np.append(pairs.ravel(), rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["pos", "n"])

    sums = fps.select("fp").mapInArrow(run, "pos int, n double").groupBy("pos").agg(F.sum("n").alias("n"))
    flat = np.zeros(BITS * BITS + 1)
    for pos, n in sums.collect():  # as many rows as pairs of bits, at any size of the input
        flat[pos] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def plan_partitions(rows: int, pairs: np.ndarray, distance: int = 3, most: int = 4) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed: the cheapest allocation for ``rows`` fingerprints."""
    n = max(rows, 1)
    one = np.diag(pairs) / n
    both = pairs / n
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-9))
    linked = np.abs((both - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(linked, 0)
    same = one**2 + (1 - one) ** 2  # two fingerprints agree in a bit
    p10, p01 = one[:, None] - both, one[None, :] - both
    agree = both**2 + p10**2 + p01**2 + np.maximum(1 - both - p10 - p01, 0) ** 2  # ... in both of two bits

    best: tuple[float, list] = (np.inf, [])
    for m in range(1, min(most, distance + 1) + 1):
        groups = _group_bits(linked, m)
        costs = []
        for bits in groups:
            equal = same[bits[0]]
            for k, b in enumerate(bits[1:], 1):
                equal *= max(min(agree[a, b] / max(same[a], 1e-9), 1.0) for a in bits[:k])
            costs.append({t: n * _ball(len(bits), t) * (1 + VERIFY * n * equal) if t >= 0 else 0.0 for t in range(-1, distance + 1)})
        table = {0: (0.0, [])}  # spent thresholds so far, counted from -1 a partition
        for cost in costs:
            nxt: dict = {}
            for spent, (total, chosen) in table.items():
                for t, c in cost.items():
                    if (k := spent + t + 1) <= distance + 1 and total + c < nxt.get(k, (np.inf,))[0]:
                        nxt[k] = (total + c, [*chosen, t])
            table = nxt
        total, chosen = table[distance + 1]  # sum of t_i is distance - m + 1
        if total < best[0]:
            best = (total, [(bits, t) for bits, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def _group_bits(linked: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of near-equal size: each takes the free bit that is most correlated with it."""
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (linked[b, list(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            nxt = max(free, key=lambda b: (linked[b, group].sum(), -b))
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in some)) for r in range(radius + 1) for some in combinations(bits, r)]


def link_fingerprints(fps: DataFrame, distance: int = 3, hot_key: int = 256) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps`` (fp: long) that give the components of "within ``distance`` bits".

    Below a hot key these are all such pairs; around one, enough of them and of links through it.
    """
    parts = plan_partitions(*bit_statistics(fps), distance)
    masks = [_signed(sum(1 << b for b in bits)) for bits, _ in parts]
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])).alias("p"))
    index = index.select(F.col("fp").alias("b"), "p.part", F.expr("fp & p.mask").alias("key"))
    flips = [F.struct(F.lit(i).alias("part"), F.lit(m).alias("mask"), F.lit(x).alias("flip")) for i, (m, (bits, t)) in enumerate(zip(masks, parts)) for x in _flips(bits, t)]
    probe = fps.select("fp", F.explode(F.array(*flips)).alias("p"))
    probe = probe.select(F.col("fp").alias("a"), "p.part", F.expr("(fp & p.mask) ^ p.flip").alias("key"))

    hot = cut(index.groupBy("part", "key").count().where(F.col("count") > hot_key).select("part", "key"))
    verified = F.expr(f"a < b and bit_count(a ^ b) <= {int(distance)}")
    if hot.isEmpty():
        return probe.join(index, ["part", "key"]).where(verified).select("a", "b").distinct()
    cold = index.join(hot, ["part", "key"], "left_anti")
    links = probe.join(cold, ["part", "key"]).where(verified).select("a", "b").distinct()
    members = cut(probe.join(hot, ["part", "key"], "left_semi").select("a").distinct())
    return links.unionByName(_star_links(members, distance))


def _star_links(members: DataFrame, distance: int) -> DataFrame:
    """Links among ``members`` (a) with the components of "within ``distance`` bits", in rows linear in the members.

    Two fingerprints are within ``distance`` just if some 64-bit value is within ``low`` bits of one and
    ``high`` of the other, low + high being the distance. All that are within ``low`` of a value are linked to
    the least of them (they are within 2 * low <= distance of each other), and so are those within ``high``.
    """
    low, high = distance // 2, distance - distance // 2
    every = list(range(BITS))
    near = members.select("a", F.explode(F.array(*[F.lit(x) for x in _flips(every, low)])).alias("x")).select("a", F.expr("a ^ x").alias("v"))
    centre = near.groupBy("v").agg(F.min("a").alias("b"))
    wide = members.select("a", F.explode(F.array(*[F.lit(x) for x in _flips(every, high)])).alias("x")).select("a", F.expr("a ^ x").alias("v"))
    return wide.join(centre, "v").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3, hot_key: int = 256) -> DataFrame:
    """Every row's (doc_id, text_hash, fp, component_id).

    ``component_id`` is the smallest id reachable over fingerprints that differ in ``distance`` bits or fewer. Rows
    of equal fingerprints are linked, so repeated rows share a component, empty and null texts share the
    fingerprint 0, and the links are sought between distinct fingerprints only. A null id never is the smallest
    unless all of its component are null. ``text_hash`` tells apart rows of one id with different texts. An empty
    table gives no rows.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    rows = cut(with_fingerprint(rows, "text", "fp", shingle).drop("text"))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(link_fingerprints(distinct.select("fp"), distance, hot_key))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(member, "fp").select("doc_id", "text_hash", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """``df`` with one row of each component of ``near_duplicates``: that of the smallest id (a tie: of the least text hash)."""
    return first_of_components(df, cut(near_duplicates(df, doc_id, text, shingle, distance)), doc_id, text)


def first_of_components(df: DataFrame, groups: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` with one row of each component of ``groups`` (doc_id, text_hash, component_id): that of the smallest id (a tie: of the least text hash).

    The rows that go are taken out, which are fewer than those that stay: if they are few, no text is shuffled.
    """
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("component_id").alias("__kept")).agg(F.min("text_hash").alias("__kept_hash"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("__kept_hash"))
    marked = groups.join(kept, F.col("component_id").eqNullSafe(F.col("__kept")), "left").select("doc_id", "text_hash", F.coalesce(stays, F.lit(False)).alias("__stays"))
    rows = cut(marked.groupBy("doc_id", "text_hash").agg(F.bool_or("__stays").alias("__stays"), F.count("*").alias("__n")).where("not __stays or __n > 1"))
    n_twice, n_gone = rows.agg(F.count_if("__stays"), F.count_if(~F.col("__stays"))).first()
    gone = rows.where("not __stays").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_hash"))
    own = F.col(doc_id).eqNullSafe(F.col("__gone")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__gone_hash"))
    left = df.join(if_small(gone, n_gone), own, "left_anti")
    if not n_twice:
        return left
    # rows of one id and text: one of them stays, and only they are grouped
    twice = rows.where("__stays").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_hash"))
    twice = if_small(twice, n_twice)
    once, several = left.join(twice, own, "left_anti"), left.join(twice, own, "left_semi")
    return once.unionByName(several.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).dropDuplicates([doc_id, "__hash"]).drop("__hash"))
