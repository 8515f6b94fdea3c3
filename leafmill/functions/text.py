"""Scalar text functions as Column expressions; all stay inside whole-stage code generation.

`\\w`, `\\s` and `\\b` differ between regex engines, so patterns spell out their classes: WORD for
letters, numbers and the underscore, SPACE for white space of any script.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
# Ligatures and their letters.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st"))
# What full case folding does beyond lower case, to letters of the scripts in use; a capital sigma may come out final.
FOLDED = (("ß", "ss"), ("ŉ", "ʼn"), ("ǰ", "ǰ"), ("ς", "σ"), ("ſ", "s"), *(x if x[0] != "ﬅ" else ("ﬅ", "st") for x in LIGATURES))
# Headings of end sections, in the order they are tried.
END_HEADINGS = ("Notes", "Bibliography", "Index", "References", "Works Cited", "Endnotes")
# Names of embedding models contain one of these.
EMBEDDING_NAMES = ("embed", "bge", "nomic", "mxbai", "e5", "gte", "jina", "snowflake", "tarka")
# Fixed value: the RFC 4122 namespace for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

HYPHENATED = rf"([{WORD}])-[{SPACE}]*\n[{SPACE}]*([{WORD}])"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SPACES = rf"[{SPACE}]+"
EDGES = rf"^[{SPACE}]+|[{SPACE}]+$"
_BEFORE = rf"(?:^|[^{WORD}])"
ASSIGNED_SECRET = rf"(?i)({_BEFORE}(?:api[_-]?key|token|secret|password)[{SPACE}]*[=:][{SPACE}]*)([^{SPACE},;]+)"
BEARER = rf"(?i)({_BEFORE}Bearer[{SPACE}]+)([^{SPACE},;]+)"
QUERY_SECRET = rf"(?i)([?&](?:api[_-]?key|token|secret|password)=)([^&#{SPACE}]+)"
WINDOWS_PATH = rf"(?i)({_BEFORE})[A-Z]:\\[^{SPACE}\"']*"
UNIX_PATH = rf"(^|[^{WORD}:])/[^{SPACE}\"']+"
MARKER = r"\[[^\]\n]*PDF_PAGE[^\]\n]*\]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def collapse(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.btrim(F.regexp_replace(c, SPACES, " "))


def normalize(c: Column) -> Column:
    """Readable one-line text: ligatures undone, hyphenated line ends joined (the hyphen stays), controls and white space collapsed. Null becomes ''."""
    t = reduce(lambda x, l: F.replace(x, F.lit(l[0]), F.lit(l[1])), LIGATURES, F.coalesce(c, F.lit("")))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, HYPHENATED, "$1-$2"), CONTROLS, " ")
    return collapse(t)


def safe_stem(c: Column) -> Column:
    t = F.btrim(F.regexp_replace(strip(c), rf"[^{WORD}.-]+", "-"), F.lit(".-_"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("rag-source"))


def clean_label(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(strip(c), r"[\r\n\[\]]+", " "), SPACES, " ")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("Source"))


def fold(c: Column) -> Column:
    """Full case folding: lower case, and the letters that folding expands or maps elsewhere."""
    return reduce(lambda x, l: F.replace(x, F.lit(l[0]), F.lit(l[1])), FOLDED, F.lower(c))


def redact(c: Column) -> Column:
    """Secrets become [REDACTED] and local paths [LOCAL_PATH]; the order of the five rules matters."""
    t = c
    for pattern in (ASSIGNED_SECRET, BEARER, QUERY_SECRET):
        t = F.regexp_replace(t, pattern, "$1[REDACTED]")
    for pattern in (WINDOWS_PATH, UNIX_PATH):
        t = F.regexp_replace(t, pattern, "$1[LOCAL_PATH]")
    return t


def clean_photo_text(c: Column) -> Column:
    """Drop isolated pen strokes: two rules across lines, lines that are one stroke, three rules in a line."""
    across = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(^|[^{WORD}])['`][{SPACE}]*\)[{SPACE}]*(?=[a-z])", "$1")
    across = F.regexp_replace(across, rf"-[{SPACE}]*[,|][{SPACE}]*(?=[a-z])", "-")
    lines = F.filter(F.split(across, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]", -1), lambda x: ~strip(x).isin("|", "'", "`", ")", "(", "_", "-"))

    def one(x: Column) -> Column:
        x = F.regexp_replace(x, rf"(^|[^{WORD}])\|(?![{WORD}|])", "$1")
        x = F.regexp_replace(x, rf"(^|[^{WORD}])['`][{SPACE}]*\)(?=[{SPACE}]+[a-z])", "$1")
        x = F.regexp_replace(x, rf"-[{SPACE}]*[,|][{SPACE}]*(?=[a-z])", "-")
        return F.regexp_replace(x, rf"[{SPACE}]+$", "")

    return strip(F.array_join(F.transform(lines, one), "\n"))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for empty text."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ", -1)))


def base_url(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.rtrim(F.btrim(c), F.lit("/")), r"(?:/api/embed|/api/embeddings|/api/tags)$", ""), F.lit("/"))


def display_name(c: Column) -> Column:
    return F.element_at(F.split(c, ": ", 2), -1)


def positive_int(c: Column) -> Column:
    n = F.btrim(c).try_cast("bigint")
    return F.when(n > 0, n)


def clamped(c: Column, low: int, high: int, default: int) -> Column:
    """A setting parsed as a whole number, or its default, within its bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.btrim(c).try_cast("int"), F.lit(default))))


def span_identity(*parts: Column) -> Column:
    """Stable id of a text span; the parts mustn't be null."""
    return F.concat(F.lit("seg-"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 24))


def url_uuid5(c: Column) -> Column:
    """Version 5 UUID in the namespace of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def heading_pattern(headings: tuple[str, ...] = END_HEADINGS) -> str:
    """A heading at the start of a text: behind a bracketed marker, hash signs or emphasis marks."""
    names = "|".join(h.replace(" ", "[ ]") for h in headings)
    return rf"(?i)^[{SPACE}]*(?:\[[^\]\n]+\][{SPACE}]*)?(?:#{{1,6}}[{SPACE}]*)?[*_`~{SPACE}]*(?:{names})(?:$|[^\p{{L}}\p{{N}}])"


def last_marker(text: Column, before: Column) -> Column:
    """The last page marker that ends before a position, else ''."""
    found = F.regexp_extract_all(F.left(text, before), F.lit(MARKER), F.lit(0))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def is_embedding_name(c: Column) -> Column:
    return F.lower(c).rlike("|".join(EMBEDDING_NAMES))
