"""Order-dependent grouping within bounded scopes.

These results depend on the order in which rows are taken, so each scope - a sheet, a component, a material on a
sheet - is one group. Spark deals the scopes out; a scope holds what one drawing has, not what the corpus has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.operators.graphs import connected_components
from tallyforge.plans.checkpoints import cut


def _by_scope(rows: DataFrame, keys: list[str], order: str, solve: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """The rows that ``solve`` makes of each scope's rows in order. A task takes its scopes from one sorted stream of Arrow batches and holds one at a time: no call, frame or batch a scope."""
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scope, out = [], None, []
        for batch in batches:
            for r in batch.to_pylist():
                own = tuple(r[k] for k in keys)
                if own != scope and held:
                    out += solve(held)
                    held = []
                scope = own
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist(solve(held), types)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def cluster_values(rows: DataFrame, keys: list[str], value: str, handle: str, absolute: float = 2.0, relative: float = 0.005) -> DataFrame:
    """Greedy clusters of a key's values: in ascending order a value joins while it is within max(2, 0.5 %) of the running mean.

    Equal values are counted before they are grouped: once the first of them has joined, the others do. Returns keys, cluster (from 0),
    center, size and corroborated (two or more handles). Null values are left out.
    """

    def cluster(group: list[dict]) -> list[dict]:
        out: list[list] = []  # total, size, least and greatest handle
        for r in group:
            x, n, low, high = r["__x"], r["__n"], r["__low"], r["__high"]
            if out and abs(x - (mean := out[-1][0] / out[-1][1])) <= max(absolute, relative * abs(mean)):
                t, size, a, b = out[-1]
                out[-1] = [t + x * n, size + n, min(a, low), max(b, high)]
            else:
                out.append([x * n, n, low, high])
        own = {k: group[0][k] for k in keys}
        return [own | {"cluster": i, "center": t / n, "size": n, "corroborated": a != b} for i, (t, n, a, b) in enumerate(out)]

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__x")).agg(F.count("*").alias("__n"), F.min(handle).alias("__low"), F.max(handle).alias("__high"))
    return _by_scope(counted, keys, "__x", cluster, f"{kinds}, cluster int, center double, size long, corroborated boolean")


def merge_occurrences(rows: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Merges the occurrences of a key in id order: into the first kept one with the same evidence, the same leader, or an anchor within ``tolerance``.

    Rows have id, evidence (array), leader, x, y and confidence. A merge unions the evidence, which later rows are compared with; the
    kept row takes the id and confidence of the better of the two. Returns keys, id, confidence, evidence and merged (rows in all).
    """

    def merge(group: list[dict]) -> list[dict]:
        kept: list[dict] = []
        rank = lambda r: (math.nan if r["confidence"] is None else -r["confidence"], r["id"])
        for r in group:
            own, placed = frozenset(r["evidence"] or ()), r["x"] is not None and r["y"] is not None
            for k in kept:
                near = placed and k["x"] is not None and k["y"] is not None and abs(r["x"] - k["x"]) <= tolerance and abs(r["y"] - k["y"]) <= tolerance
                if own == k["evidence"] or (r["leader"] is not None and r["leader"] == k["leader"]) or near:
                    if rank(r) < rank(k):
                        k |= {"id": r["id"], "confidence": r["confidence"]}
                    k["evidence"] |= own
                    k["merged"] += 1
                    break
            else:
                kept.append(r | {"evidence": own, "merged": 1})
        return [{**{c: k[c] for c in (*keys, "id", "confidence", "merged")}, "evidence": sorted(k["evidence"])} for k in kept]

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in (*keys, "id"))
    return _by_scope(rows, keys, "id", merge, f"{kinds}, confidence double, merged long, evidence array<string>")


def guarded_components(rows: DataFrame, scope: str, passes: list[list[str]]) -> DataFrame:
    """Unions a scope's occurrences pass by pass: consecutive members of a bucket (one value of the pass's columns, two sheets or more).

    Rows have id, sheet, room and name and the columns of the passes. A union is refused if both groups have rooms, or both have
    names, and share none; so the result depends on the order, which is that of the passes and ids. Returns scope, id and component (least id).
    """

    def union(rows_: list[dict]) -> list[dict]:
        root = {r["id"]: r["id"] for r in rows_}
        traits = {r["id"]: ({r["room"]} - {None}, {r["name"]} - {None}) for r in rows_}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for columns in passes:
            buckets: dict[tuple, list[dict]] = {}
            for r in rows_:
                value = tuple(r[c] for c in columns)
                if all(v is not None and v == v for v in value):
                    buckets.setdefault(value, []).append(r)
            for _, bucket in sorted(buckets.items()):
                if len({r["sheet"] for r in bucket}) < 2:
                    continue
                for one, two in zip(bucket, bucket[1:]):
                    a, b = sorted((find(one["id"]), find(two["id"])))
                    if a == b or any(x and y and not x & y for x, y in zip(traits[a], traits[b])):
                        continue
                    root[b] = a
                    traits[a] = tuple(x | y for x, y in zip(traits[a], traits[b]))
        return [{scope: r[scope], "id": r["id"], "component": find(r["id"])} for r in rows_]

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return _by_scope(rows, [scope], "id", union, f"{scope} {kind(scope)}, id {kind('id')}, component {kind('id')}")


def greedy_pairs(pairs: DataFrame, scope: str, left: str, right: str, cost: str) -> DataFrame:
    """Takes a scope's pairs by ascending (cost, left, right), each row of either side once."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([cost, left, right])
        used_left, used_right, taken = set(), set(), []
        for a, b in zip(group[left], group[right]):
            taken.append(a not in used_left and b not in used_right)
            if taken[-1]:
                used_left.add(a)
                used_right.add(b)
        return group[pd.Series(taken, index=group.index, dtype=bool)]

    return pairs.select(scope, left, right, cost).groupBy(scope).applyInPandas(pick, pairs.select(scope, left, right, cost).schema)


def round_robin(rows: DataFrame, scope: str, pool: str, item: str, order: str, cap: int) -> DataFrame:
    """Takes a scope's items from its pools in turn (pools ascending, items by ``order``), each item once, until ``cap``.

    Returns scope, item, pool and turn. Ranks beyond twice the cap are cut by a window first, so a group has at most pools * 2 * cap rows.
    """
    spread = Window.partitionBy(scope, pool).orderBy(order, item)
    # at most cap of a pool's items are taken elsewhere before, and cap of its own
    pools = rows.select(scope, pool, item, order).withColumn("__r", F.row_number().over(spread)).where(F.col("__r") <= 2 * cap)

    def take(group: pd.DataFrame) -> pd.DataFrame:
        queues = [(p, g.sort_values("__r")[item].tolist()[::-1]) for p, g in sorted(group.groupby(pool), key=lambda x: x[0])]
        seen, out = set(), []
        while len(out) < cap and any(q for _, q in queues):
            for p, q in queues:
                while q and q[-1] in seen:
                    q.pop()
                if q and len(out) < cap:
                    seen.add(q[-1])
                    out.append((group[scope].iloc[0], q.pop(), p, len(out) + 1))
        return pd.DataFrame(out, columns=[scope, item, pool, "turn"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return pools.groupBy(scope).applyInPandas(take, f"{scope} {kind(scope)}, {item} {kind(item)}, {pool} {kind(pool)}, turn int")


#: Pairs of a scope whose components one task finds at once.
WHOLE = 50_000


def unique_assignment(pairs: DataFrame, scope: str, left: str, right: str, whole: int = WHOLE) -> DataFrame:
    """Per connected component of a scope's allowed pairs its one complete assignment of left rows to right rows.

    A component whose sides differ in number is ``unequal``, one with several complete assignments ``ambiguous``, one without any ``none``;
    they have one row without a pair. A ``unique`` one has a row for each pair. ``component`` is its least left row. Scopes of up to ``whole`` pairs are
    taken from one sorted stream a task, one at a time; components of larger ones are found as a graph, and each is one group: what hangs together
    in one drawing. Pairs with nulls are left out, repeated pairs count once.
    """
    own = cut(pairs.select(scope, left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct())
    kind = lambda c: pairs.schema[c].dataType.simpleString()
    schema = f"{scope} {kind(scope)}, component {kind(left)}, state string, {left} {kind(left)}, {right} {kind(right)}"

    def assign(rows: list[dict]) -> list[dict]:
        state, found = _assignment([(r[left], r[right]) for r in rows])
        least = min(r[left] for r in rows)
        return [{scope: rows[0][scope], "component": least, "state": state, left: a, right: b} for a, b in found or [(None, None)]]

    def solve(rows: list[dict]) -> list[dict]:
        return [out for part in _parts(rows, left, right) for out in assign(part)]

    # by a hash, so that a null scope may be large too; scopes of one hash go one way
    own = own.withColumn("__s", F.xxhash64(scope))
    large = cut(own.groupBy("__s").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("__s"))
    some = not large.isEmpty()
    small = own.join(large.hint("merge"), "__s", "left_anti") if some else own
    out = _by_scope(small, [scope], left, solve, schema)
    if not some:
        return out
    ends = own.join(large.hint("merge"), "__s", "left_semi").withColumns({"__a": F.xxhash64(F.lit("l"), scope, left), "__b": F.xxhash64(F.lit("r"), scope, right)})
    roots = connected_components(ends.select(F.col("__a").alias("a"), F.col("__b").alias("b")))
    rooted = ends.join(roots.select(F.col("node").alias("__a"), F.col("root").alias("__root")).hint("merge"), "__a").select("__root", scope, left, right)
    return out.unionByName(_by_scope(rooted, ["__root"], left, assign, schema))


def _parts(rows: list[dict], left: str, right: str) -> list[list[dict]]:
    """The rows of each connected component."""
    root: dict = {}

    def find(n):
        while root.setdefault(n, n) != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for r in rows:
        root[find((0, r[left]))] = find((1, r[right]))
    parts: dict = {}
    for r in rows:
        parts.setdefault(find((0, r[left])), []).append(r)
    return list(parts.values())


def _assignment(pairs: list[tuple]) -> tuple[str, list[tuple]]:
    """State and pairs of the unique complete assignment of a bipartite graph.

    A graph with one complete assignment only has a row with a single partner, and still has it after that pair is taken away; a rest in which all rows have
    several has none or several.
    """
    ahead: dict = {}
    for a, b in pairs:
        ahead.setdefault((0, a), set()).add((1, b))
        ahead.setdefault((1, b), set()).add((0, a))
    if 2 * sum(side == 0 for side, _ in ahead) != len(ahead):
        return "unequal", []
    taken, single = [], sorted((n for n, near in ahead.items() if len(near) == 1), key=str)
    while single:
        n = single.pop()
        if n not in ahead:
            continue
        if not ahead[n]:
            return "none", []
        (m,) = ahead[n]
        taken.append((n[1], m[1]) if n[0] == 0 else (m[1], n[1]))
        for x in (n, m):
            for y in ahead.pop(x):
                if y in ahead:
                    ahead[y].discard(x)
                    if len(ahead[y]) <= 1:
                        single.append(y)
    if not ahead:
        return "unique", sorted(taken)
    return ("ambiguous" if _complete(ahead) else "none"), []


def _complete(ahead: dict) -> bool:
    """Whether all left rows can be assigned at once: each is placed along a path that moves those placed before."""
    holder: dict = {}
    for start in (n for n in ahead if n[0] == 0):
        came, todo, free = {}, [start], None
        while todo and free is None:
            n = todo.pop()
            for m in ahead[n]:
                if m not in came:
                    came[m] = n
                    if m not in holder:
                        free = m
                        break
                    todo.append(holder[m])
        if free is None:
            return False
        while free is not None:
            n = came[free]
            before = next((m for m, h in holder.items() if h == n), None)
            holder[free] = n
            if before is not None and before != free:
                del holder[before]
            free = before
    return True


def repeated_shapes(shapes: DataFrame, scope: str, anchor_distance: str, step: float = 1.0, cap: int = 6) -> DataFrame:
    """Shapes of a scope with one signature - the sorted side lengths of the outline to ``step`` - that occur 2 to 20 times.

    ``shapes`` has points (array<struct<x,y>>) and multiplicity. Returns scope, signature, occurrences and nearest, the ``cap`` nearest by (distance, signature).
    """
    p = F.col("points")
    side = lambda q, i: F.sqrt((q["x"] - F.element_at(p, (i + 1) % F.size(p) + 1)["x"]) ** 2 + (q["y"] - F.element_at(p, (i + 1) % F.size(p) + 1)["y"]) ** 2)
    sides = F.array_sort(F.transform(F.transform(p, side), lambda x: F.round(x / step).cast("long")))
    groups = shapes.withColumn("signature", F.substring(F.sha2(F.array_join(sides, ","), 256), 1, 24)).groupBy(scope, "signature")
    found = groups.agg(F.sum("multiplicity").alias("occurrences"), F.min(anchor_distance).alias("nearest")).where("occurrences between 2 and 20")
    rank = F.row_number().over(Window.partitionBy(scope).orderBy("nearest", "signature"))
    return found.withColumn("rank", rank).where(F.col("rank") <= cap)
