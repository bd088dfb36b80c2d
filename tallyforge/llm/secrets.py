"""Secret scans: fixed patterns, and runs of characters that a tokenizer's vocabulary encodes badly.

A language model's vocabulary holds the common parts of words and identifiers, so prose and code take few tokens;
random strings take nearly one token for two characters. A run of key characters is a secret if its characters per token
stay under ``LOW``, or under ``LOW_LETTERS`` if it is made of letters, unless it is a digest, a UUID or mostly numbers. Names
made of words need no list: their words have more characters a token. A run with a path or a name in front of a key is
taken apart at slashes and equal signs if it isn't random as a whole.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import with_arrow

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a greedy run of 16 or more in all
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "random"]

#: A run that may be random: key characters, none of them before or after; and its parts.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
#: Characters per token under which a run counts as random, and one of letters alone, but for a number at its end. Long words of inflected languages have 2.0 or so.
LOW, LOW_LETTERS = 2.1, 1.85
#: Characters of the longest part between separators, at least: versions, dates and numbered names have short ones.
SOLID = 8
#: Characters whose tokens are counted at a time.
STEP = 4096
#: Runs that are no secrets: digests by their lengths in hexadecimal digits, UUIDs.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})")
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_SEPARATORS, _LETTERS = re.compile(r"[+/_=-]+"), re.compile(r"[A-Za-z]")
_NAME = re.compile(r"([A-Za-z+/_=-]+)[0-9]{0,4}")


@lru_cache(2)
def _encoding(content: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}
    return tiktoken.Encoding("shared", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_random(run: str, encoding: tiktoken.Encoding, low: float = LOW, low_letters: float = LOW_LETTERS) -> bool:
    """Whether the vocabulary encodes a run in few characters a token, and nothing else explains it."""
    run = run.strip("=")
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or 4 * len(_LETTERS.findall(run)) < len(run) or max(map(len, _SEPARATORS.split(run))) < SOLID:
        return False
    if name := _NAME.fullmatch(run):
        run, low = name[1], low_letters
    return len(run) < low * sum(len(encoding.encode_ordinary(run[i : i + STEP])) for i in range(0, len(run), STEP))


def random_runs(text: str, encoding: tiktoken.Encoding, low: float = LOW, low_letters: float = LOW_LETTERS) -> list[tuple[int, int]]:
    """Spans of the runs, or of their parts, that are random."""
    found = []
    for m in RUN.finditer(text):
        if is_random(m[0], encoding, low, low_letters):
            found.append(m.span())
        elif "/" in m[0] or "=" in m[0]:
            found += [(m.start() + a, m.start() + b) for a, b in (x.span() for x in PART.finditer(m[0]) if is_random(x[0], encoding, low, low_letters))]
    return found


def find_secrets(text: str, encoding: tiktoken.Encoding, low: float = LOW, low_letters: float = LOW_LETTERS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span in a text, in code points; kinds by their place in KINDS. Patterns first, then runs beside them."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    starts, reach = [s for s, _, _ in spans], [0]  # reach[i]: the greatest end of the first i patterns
    for _, _, end in spans:
        reach.append(max(reach[-1], end))
    beside = [(a, 3, b) for a, b in random_runs(text, encoding, low, low_letters) if reach[bisect_right(starts, b - 1)] <= a]
    return sorted(spans + beside)


def scan_secrets(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "secrets", low: float = LOW, low_letters: float = LOW_LETTERS) -> DataFrame:
    """``df`` with ``out``: array<struct<kind, start, end>> of the spans of each whole text, by start, then kind as in KINDS.

    Null and empty texts have none, repeated rows have equal ones, an empty table gives no rows, and a column of the output's name is
    replaced. The rank file is read on the driver; its size is that of a vocabulary. Time grows with the text's length, not its square.
    """
    with open(ranks_path, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        encoding = _encoding(content.value, pattern)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_secrets(x or "", encoding, low, low_letters)] for x in batch.column(text).to_pylist()]
            return [pa.array(rows, kind)]

        return step

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return with_arrow(df, text, [T.StructField(out, T.ArrayType(span))], make)


def span_columns(df: DataFrame, spans: str = "secrets") -> DataFrame:
    """``df`` with counts by base kind, the digest of the base spans and all spans as text, in place of the array."""

    def listed(column: F.Column) -> F.Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter(spans, lambda s: s["kind"] != KINDS[3])
    kinds = F.transform(spans, lambda s: s["kind"])
    count = {f"n_{k}": F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long") for k in KINDS[:3]}
    return df.withColumns({**count, "base_sha256": F.sha2(listed(base), 256), "spans": listed(F.col(spans))}).drop(spans)
