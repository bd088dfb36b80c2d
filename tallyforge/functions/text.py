"""Text and code functions. Native columns wherever Spark has the parts."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dashes that count as one, and separators of lists. Fixed values.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\uff0d"
SEPARATORS = ",\uff0c;\uff1b|\uff5c"


def _normal(form: str, fold: bool, blank: str):
    """NFKC needs Python: Spark has no such function. One Arrow batch a call."""

    @F.pandas_udf(T.StringType())
    def apply(s: pd.Series) -> pd.Series:
        out = s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")
        out = out.str.replace(f"[{DASHES}]", "-", regex=True)
        out = out.str.replace(r"\s+", blank, regex=True).str.strip()
        return out.map(str.casefold, na_action="ignore") if fold else out

    return apply


#: T1, four variants: kept case and single spaces; folded case; no spaces; neither.
plain_text = _normal("NFKC", False, " ")
folded_text = _normal("NFKC", True, " ")
compact_text = _normal("NFKC", False, "")
match_key = _normal("NFKC", True, "")


def ascii_key(c: Column) -> Column:
    """T1 for text that is known to be ASCII: lower case without white space, inside codegen."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def material_codes(c: Column, families: list[str]) -> Column:
    """Codes FAMILY-number in order of appearance, the number padded to two digits, each once.

    A code embedded in a longer identifier doesn't count (F5).
    """
    names = "|".join(sorted(families, key=lambda f: (-len(f), f)))
    found = F.regexp_extract_all(F.upper(c), F.lit(rf"(?<![A-Z0-9])((?:{names})[- ]?[0-9]+)(?![A-Z0-9])"), F.lit(1))

    def code(x: Column) -> Column:
        number = F.regexp_extract(x, "([0-9]+)$", 1)
        family = F.regexp_replace(x, "[- ]?[0-9]+$", "")
        return F.concat(family, F.lit("-"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")))

    return F.array_distinct(F.transform(found, code))


def expand_range(c: Column, most: int = 200) -> Column:
    """``A-01~A-05`` gives each code from the first to the last; one code gives itself; otherwise null.

    Both ends must share the prefix, go upwards, and span ``most`` codes or fewer.
    """
    pattern = r"^([A-Z][A-Z0-9]*-)?([0-9]+)\s*[~\u2013]\s*([A-Z][A-Z0-9]*-)?([0-9]+)$"
    head, low, tail, high = (F.regexp_extract(c, pattern, i) for i in range(1, 5))
    a, b = low.try_cast("int"), high.try_cast("int")
    width = F.length(low)
    good = c.rlike(pattern) & ((tail == "") | (tail == head)) & (a <= b) & (b - a < most)
    codes = F.transform(F.sequence(F.coalesce(F.when(good, a), F.lit(1)), F.coalesce(F.when(good, b), F.lit(1))), lambda n: F.concat(head, F.lpad(n.cast("string"), F.greatest(width, F.length(n.cast("string"))), F.lit("0"))))
    return F.when(good, codes).when(c.rlike(r"^([A-Z][A-Z0-9]*-)?[0-9]+$"), F.array(c))


def clean_markup(c: Column) -> Column:
    """T4: visible text of a drawing's formatted text: control codes go, paragraph breaks become spaces."""
    c = F.regexp_replace(c, r"\\[Pp~]", " ")
    c = F.regexp_replace(c, r"\\[ACHQTWFfpcL][^;\\{}]*;", "")
    c = F.regexp_replace(c, r"\\S([^;^#/]*)[\^#/]([^;]*);", "$1/$2")
    c = F.regexp_replace(c, r"\\[LlOoKk]|[{}]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """T5: the whole key and its alphanumeric parts, sorted, each once."""
    key = F.lower(F.trim(c))
    return F.array_sort(F.array_distinct(F.concat(F.array(key), F.regexp_extract_all(key, F.lit("([a-z0-9]+)"), F.lit(1)))))


#: Attribute tags by the role that they play (T6). Fixed values.
ROLES = {"HT": "height", "HEIGHT": "height", "LEN": "length", "LENGTH": "length", "WD": "width", "WIDTH": "width", "QTY": "quantity", "COUNT": "quantity"}


def attribute_role(tag: Column) -> Column:
    """The role of an attribute's tag, null if it has none."""
    return F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.upper(F.trim(tag))]


def count_token(c: Column) -> Column:
    """The number of a count such as ``x 4``, ``4pcs`` or ``qty: 4``."""
    return F.regexp_extract(F.lower(c), r"(?:^|[^0-9a-z])(?:qty[:\s]*|x\s*)?([0-9]{1,6})\s*(?:pcs|sets?|x)?$", 1).try_cast("int")


def row_variant(title: Column) -> Column:
    """The base of a component's title and its letter, as a struct; no letter gives null."""
    pattern = r"^(.*[0-9])\s*-?\s*([A-Za-z])$"
    letter = F.regexp_extract(F.trim(title), pattern, 2)
    base = F.when(letter != "", F.trim(F.regexp_extract(F.trim(title), pattern, 1))).otherwise(F.trim(title))
    return F.struct(base.alias("base"), F.when(letter != "", F.upper(letter)).alias("variant"))


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters, sorted; shorter text stands for itself."""
    n = F.length(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(c.isNull(), None).otherwise(F.array_sort(F.array_distinct(pairs)))


def code_key(c: Column) -> Column:
    """A code without punctuation, null unless it has a letter and a digit."""
    key = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return F.when(key.rlike("[A-Z]") & key.rlike("[0-9]"), key)


#: Characters below the space that JSON has short escapes for.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(value: Column) -> Column:
    """A text as canonical JSON: quotes, backslashes and control characters escaped, everything else as it is; a null is null."""
    text = F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controlled = text
    for i in range(32):
        controlled = F.replace(controlled, F.lit(chr(i)), F.lit(_SHORT.get(chr(i), f"\\u{i:04x}")))
    escaped = F.when(text.rlike(r"[\x00-\x1f]"), controlled).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def content_id(prefix: str, fields: dict[str, Column]) -> Column:
    """``prefix:`` and 24 hexadecimal digits of the SHA-256 of the fields, as texts, in canonical JSON: names sorted, no spaces."""
    parts = [F.concat(F.lit(f"{json.dumps(name, ensure_ascii=False)}:"), json_string(fields[name])) for name in sorted(fields)]
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, 24))


def policy_hash(policy: dict) -> str:
    """SHA-256 of a policy as canonical JSON; driver-side configuration."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def has_cjk(c: Column) -> Column:
    """Whether the text has a CJK ideograph."""
    return c.rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]")


@F.pandas_udf(T.StringType())
def utf8_reading(s: pd.Series) -> pd.Series:
    """The text that Latin-1 bytes give when read as UTF-8; null if they aren't strict UTF-8 with an ideograph."""

    def read(x: str) -> str | None:
        try:
            out = x.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
        return out if any("\u3400" <= ch <= "\u9fff" for ch in out) else None

    return s.map(read, na_action="ignore")


def excel_safe(c: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def similarity_bigrams(a: Column, b: Column) -> Column:
    """Jaccard likeness of the bigrams of two texts, 0 if either has none."""
    x, y = bigrams(a), bigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def key_list(c: Column) -> Column:
    """The trimmed parts of a separated list, each once by its folded key, the first spelling kept."""
    parts = F.filter(F.transform(F.split(c, f"[{SEPARATORS}]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(F.exists(done, lambda y: F.lower(y) == F.lower(x)), done).otherwise(F.array_append(done, x)))
