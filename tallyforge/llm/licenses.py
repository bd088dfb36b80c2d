"""License scans: whole texts and single lines, in canonical form, joined by digest with known licences.

The canonical form drops copyright notices and a title, folds case, turns all but letters and digits into single spaces and
replaces equivalent spellings, so licences that differ in those alone have one digest. A notice is told from a sentence
that a line break cut before "copyright" by what follows: a year, a sign, a placeholder, "by" or "all rights reserved". At a text's head, with nothing
but a title and other notices before it, whatever begins with "copyright" or its sign is one. Where it ends no mark
says, so a text has two forms: one drops the notice's whole paragraph and doesn't depend on how lines are wrapped, the other its
line, for texts that go on in the next line. The catalogue holds the digests of both forms of licence texts, and those of
the short notices that stand for them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import cut, if_few, with_arrow
from tallyforge.llm.license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

_NOTICE = re.compile(
    r"^\W*(?:(?:portions\s+)?copyright\s*(?:\(c\)|©|[0-9]{4}|[<\[{]|by\b|yyyy\b)|portions\s+copyright\b|(?:\(c\)|©)\s*(?:copyright\b|[0-9]{4}|[<\[{]|by\b|yyyy\b)|all\s+rights\s+reserved\W*$|copyright\b.*\b[12][0-9]{3}\b)",
    re.IGNORECASE,
)
_HEAD = re.compile(r"^\W*(?:portions\s+)?(?:copyright\b|\(c\)|©)", re.IGNORECASE)
_LICENSE = re.compile(r"licen[sc]e", re.IGNORECASE)
_OTHER = re.compile(r"[\W_]+")
_WORDS = re.compile(r"\b(?:" + "|".join(map(re.escape, SPELLINGS)) + r")\b")
#: Words of a title at most, of what goes on after a notice's line and still belongs to it, and of a paragraph at a text's head that is a notice by its first word alone.
TITLE, REST, HEAD = 12, 11, 40
#: Lines of documents that the shipped notices can equal have a word of this kind.
HINT = r"licen[sc]e|spdx|public domain|gpl|creative commons|cc by|cc0"


def _folded(text: str) -> str:
    return _WORDS.sub(lambda m: SPELLINGS[m[0]], _OTHER.sub(" ", text.casefold()).strip())


def _paragraphs(text: str) -> list[list[str]]:
    """The lines of each paragraph: lines without letters and digits part them."""
    out: list[list[str]] = [[]]
    for line in text.splitlines():
        if re.search(r"[^\W_]", line):
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def _title(part: str) -> bool:
    return len(part.split()) <= TITLE and bool(_LICENSE.search(part))


def _at_head(before: list[str]) -> bool:
    """Whether no more than a title stands before, so no sentence of a licence."""
    return not before or (len(before) == 1 and _title(before[0]))


def canonical(text: str, whole: bool = True) -> str:
    """The form of a text in which licences are compared: without notices - their ``whole`` paragraphs, or their lines alone - and title."""
    parts: list[str] = []
    for lines in _paragraphs(text):
        if whole:
            named = _at_head(parts) and _HEAD.match(lines[0]) and len(" ".join(lines).split()) <= HEAD
            if not named and not _NOTICE.match(lines[0]):
                parts.append(" ".join(lines))
            continue
        run: list[str] = []
        after = False  # a notice stands before the run in this paragraph
        for line in [*lines, None]:
            named = line is not None and _HEAD.match(line) and _at_head([*parts, " ".join(run)] if run else parts)
            if line is not None and not named and not _NOTICE.match(line):
                run.append(line)
                continue
            if run and not (after and len(" ".join(run).split()) <= REST):
                parts.append(" ".join(run))
            run, after = [], True
    if len(parts) > 1 and _title(parts[0]):
        parts = parts[1:]
    return _folded(" ".join(parts))


def line_form(text: str) -> str:
    """The canonical form of a single line; that of a copyright notice is empty."""
    return "" if _NOTICE.match(text) else _folded(text)


def _sha(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def digests(text: str) -> tuple[str, str]:
    """The digests of both canonical forms of a text."""
    return _sha(canonical(text)), _sha(canonical(text, False))


_NOTHING = _sha("")


def catalogue(texts: dict[str, str] = TEXTS, notices: dict[str, list[str]] = NOTICES, known: dict[str, list[str]] = DIGESTS) -> list[tuple[str, str, str]]:
    """(digest, licence, kind) of the known texts, given or by their digests, and notices."""
    rows = [(d, name, "text") for name, t in texts.items() for d in digests(t)]
    rows += [(d, name, "text") for name, ds in known.items() for d in ds]
    return sorted({r for r in rows + [(_sha(line_form(t)), name, "notice") for name, lines in notices.items() for t in lines] if r[0] != _NOTHING})


def with_digests(df: DataFrame, text: str = "text", hint: str | None = HINT) -> DataFrame:
    """``df`` with ``text_digest`` and ``other_digest``, of both forms of the whole text, and ``line_digests`` (array), of its lines that match ``hint``, or of all.

    A null text is an empty one; forms without words have no line digest. Columns of these names are replaced.
    """
    likely = re.compile(hint, re.IGNORECASE) if hint is not None else None

    def make():
        def of_lines(x: str) -> list[str]:
            if likely is not None and not likely.search(x):
                return []
            return sorted({_sha(form) for s in x.split("\n") if (likely is None or likely.search(s)) and (form := line_form(s))})

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            both = [digests(x) for x in texts]
            return [*(pa.array([d[k] for d in both], pa.string()) for k in (0, 1)), pa.array([of_lines(x) for x in texts], pa.list_(pa.string()))]

        return step

    fields = [T.StructField("text_digest", T.StringType()), T.StructField("other_digest", T.StringType()), T.StructField("line_digests", T.ArrayType(T.StringType()))]
    return with_arrow(df, text, fields, make)


def scan_licenses(df: DataFrame, known: DataFrame | list[tuple[str, str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_digest, license, notices) of every row: the licence whose whole text it is, or null, and those that its lines name.

    ``known`` is a catalogue (digest, license, kind: text or notice) of any size, by default the shipped one: digests meet it in hash joins, and it is
    broadcast only after a count. Of several licences with one digest the least name counts. A row without notices has an empty array; repeated rows
    and rows of one id are scanned each for itself; texts without words match nothing; null ids stay null; an empty table gives no rows.
    """
    spark, schema = df.sparkSession, "digest string, license string, kind string"
    if known is None or isinstance(known, list):
        entries = spark.createDataFrame(catalogue() if known is None else known, schema)
    else:
        entries = known.select("digest", "license", "kind")
    entries = cut(entries.where(F.col("digest") != _NOTHING).groupBy("digest", "kind").agg(F.min("license").alias("license")))
    of = lambda kind, key, out: if_few(entries.where(F.col("kind") == kind).select(F.col("digest").alias(key), F.col("license").alias(out)))
    rows = with_digests(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("__th")), hint=HINT if known is None else None).drop("text")
    rows = cut(rows)
    lines = rows.where(F.size("line_digests") > 0).select("doc_id", "__th", F.explode("line_digests").alias("line_digest")).distinct()
    named = lines.join(of("notice", "line_digest", "__notice"), "line_digest").groupBy("doc_id", "__th").agg(F.array_sort(F.collect_set("__notice")).alias("notices"))
    named = if_few(cut(named.select(F.col("doc_id").alias("__id"), F.col("__th").alias("__h"), "notices")), 500_000)
    out = rows.join(of("text", "text_digest", "__one"), "text_digest", "left").join(of("text", "other_digest", "__two"), "other_digest", "left")
    out = out.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
    return out.select("doc_id", "text_digest", F.coalesce("__one", "__two").alias("license"), F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
