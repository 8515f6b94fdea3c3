"""One consistent form for text that looks the same (problem 5).

A quick check isolates the segments that normalisation could change; only those, with the character
before them as boundary context, are normalised, and the canonical segments are spliced into the
unchanged text. Words that mix look-alike letters of several scripts get the script that their
unmistakable letters show.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import written

# Characters without ink (the default-ignorable ones and controls that are no white space).
INVISIBLE = (
    "\\x00-\\x08\\x0e-\\x1b\\x7f-\\x84\\x86-\\x9f\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u200b-\\u200f"
    "\\u202a-\\u202e\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0\\ufff9-\\ufffb\\U0001bca0-\\U0001bca3\\U0001d173-\\U0001d17a\\U000e0000-\\U000e0fff"
)
# Spaces other than U+0020, and line ends other than U+000A.
SPACES = "\\t\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
LINE_ENDS = "\\x0b\\x0c\\x1c-\\x1f\\x85\\u2028\\u2029"
# Hyphens of the same look as U+002D.
HYPHENS = "\\u2010\\u2011\\u2043\\u2212\\ufe63\\uff0d"
# Latin letters and the Cyrillic and Greek letters that look the same, in the same order.
CYRILLIC = ("aceijopsxyhdqwABCEHIJKMOPSTXYv", "асеіјорѕхуһԁԛԝАВСЕНІЈКМОРЅТХУѵ")
GREEK = ("opviauyABEHIKMNOPTXYZ", "ορνιαυγΑΒΕΗΙΚΜΝΟΡΤΧΥΖ")
# The same for Armenian and Cherokee letters, and Latin letters that look like plain ones.
ARMENIAN = ("ghnoquLOSU", "ցհոօզսԼՕՏՍ")
CHEROKEE = ("ABCDEGHIJKLMPRSTVWYZ", "ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᎩᏃ")
LATIN = ("agI", "ɑɡǀ")
# The compatibility forms that look like what they decompose to.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")

_ALIKE = {"c": CYRILLIC, "g": GREEK, "a": ARMENIAN, "k": CHEROKEE}
_TO_LATIN = str.maketrans("".join(x[1] for x in (*_ALIKE.values(), LATIN)), "".join(x[0] for x in (*_ALIKE.values(), LATIN)))
_TO = {k: str.maketrans(*x) for k, x in _ALIKE.items()} | {"l": {}}
#: Letters that tell nothing about a word's script, by the script they might be of; an Armenian or Cherokee text shows by its other letters.
_SHARED = frozenset(CYRILLIC[0] + GREEK[0])
# Look-alikes that Russian has, by their Latin letter, with the marks that stand on them.
_RUSSIAN = frozenset("aceopxykmhtb\u0308\u0301\u0306")
_FOREIGN = re.compile(r"[ɐ-ʯǀͰ-֏Ꭰ-Ᏽἀ-῿]")
_SCRIPT_WORD = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ʯ̀-ͯͰ-ևᎠ-ᏽḀ-῿]+")


@cache
def _unstable() -> re.Pattern:
    """A run of characters that normalisation may change (quick check No or Maybe); `\\n` may complete a line end."""
    seconds, odd = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)), set()
    for c in range(0x80, 0x10000):
        if d := unicodedata.decomposition(x := chr(c)):
            if d[0] == "<":
                if d.split()[0] in SAME_LOOK and not d.split(" ", 1)[1].startswith("0020 "):
                    odd.add(c)
            else:
                if " " in d:
                    seconds.add(int(d.split()[1], 16))
                if unicodedata.normalize("NFC", x) != x:
                    odd.add(c)
        if unicodedata.combining(x):
            odd.add(c)
    runs: list[list[int]] = []
    for c in sorted(x for x in odd | seconds if x < 0x10000):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    # beyond the BMP everything counts as unstable: settling a stable segment changes nothing
    inside = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + INVISIBLE + SPACES + LINE_ENDS + HYPHENS + "\\r"
    return re.compile(f"[{inside}\\U00010000-\\U0010ffff]+\\n?")


_DROP, _SPACE, _HYPHEN = re.compile(f"[{INVISIBLE}]+"), re.compile(f"[{SPACES}]"), re.compile(f"[{HYPHENS}]")
_END = re.compile(f"\\r\\n|[\\r{LINE_ENDS}]")


def _folded(c: str) -> str:
    d = unicodedata.decomposition(c)
    if d[:1] == "<" and d.split()[0] in SAME_LOOK and not d.split(" ", 1)[1].startswith("0020 "):
        return unicodedata.normalize("NFKD", c)
    return c


def _settled(s: str) -> str:
    s = _HYPHEN.sub("-", _SPACE.sub(" ", _END.sub("\n", _DROP.sub("", s))))
    return unicodedata.normalize("NFC", "".join(map(_folded, s)))


def _spliced(text: str) -> str:
    """Canonical segments, each with the character before it as context, between the unchanged text."""
    out, at = [], 0
    for m in _unstable().finditer(text):
        start = max(at, m.start() - 1)
        out += [text[at:start], _settled(text[start : m.end()])]
        at = m.end()
    return "".join(out) + text[at:] if at else text


@cache
def _script(c: str) -> str:
    own = unicodedata.normalize("NFD", c)[0]
    base = own.translate(_TO_LATIN)
    if base in _SHARED or (base != own and own not in LATIN[1]) or unicodedata.category(base)[0] != "L":
        return ""
    at = ord(base)
    scripts = (("c", 0x400, 0x530), ("g", 0x370, 0x400), ("g", 0x1F00, 0x2000), ("a", 0x531, 0x588), ("k", 0x13A0, 0x13FE))
    return next((k for k, a, b in scripts if a <= at < b), "l")


@lru_cache(1 << 17)
def _clue(word: str) -> str:
    """The script that most of a word's unmistakable letters have; on ties Latin before Cyrillic, Greek, Armenian and Cherokee."""
    seen = [x for x in map(_script, word) if x]
    return max("lcgak", key=seen.count) if seen else ""


@lru_cache(1 << 17)
def _in_script(word: str, script: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(_TO_LATIN).translate(_TO[script]))


@lru_cache(1 << 17)
def _context(word: str, last: str) -> str:
    """The script of a word without a clear letter: Latin if Russian hasn't its letters, else that of its surroundings."""
    return "l" if last == "c" and not set(unicodedata.normalize("NFD", word).translate(_TO_LATIN).lower()) <= _RUSSIAN else last


def _one_script(text: str) -> str:
    words = list(_SCRIPT_WORD.finditer(text))
    clues = [_clue(m[0]) for m in words]
    last = next((c for c in clues if c), "l")  # words before the first clear one follow it
    out, at = [], 0
    for m, clue in zip(words, clues):
        last = clue or last
        word = m[0]
        if last == "l" and word.isascii():
            continue
        if (new := _in_script(word, clue or _context(word, last))) != word:
            out += [text[at : m.start()], new]
            at = m.end()
    # a letter of another script may compose with marks that its look-alike doesn't take
    return unicodedata.normalize("NFC", "".join(out) + text[at:]) if at else text


def canonical(text: str) -> str:
    """The one form of all texts that look like `text`, up to the width of its gaps.

    Invisible characters go; every kind of space becomes U+0020 and every kind of line end `\\n`;
    full-width forms, ligatures and look-alike hyphens take their plain form, accents are composed,
    look-alike letters take the script of the word's unmistakable letters, or else of the nearest
    clear word before it (at the start: after it; Latin where Russian hasn't the letters), or else
    Latin. Letter case, accents, digits and
    raised digits stay.
    """
    if text.isascii():
        return _spliced(text) if _ASCII_ODD.search(text) else text
    text = _spliced(text)
    return _one_script(text) if _FOREIGN.search(text) else text


_ASCII_ODD = re.compile("[\\x00-\\x08\\x0b-\\x1f\\x7f\\t]")



def look(text: str) -> str:
    """What two texts that look the same share: the canonical form with every gap as one space."""
    return " ".join(canonical(text).split())


def canonical_text(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, text): each row's text in canonical form; null stays null, rows are kept as they are.

    Other columns are ignored. Texts are handled whole, in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else canonical(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(new, pa.string())], ["key", "text"])

    schema = T.StructType([T.StructField("key", pages.schema[key].dataType), T.StructField("text", T.StringType())])
    return pages.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).select(F.col("key").alias(key), F.col("text").alias(text))


def look_keys(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, look, own): 128-bit hashes of a text's canonical look and of the text itself, each key once.

    Null texts and texts without a visible character give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            rows, looks, own = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                if seen := look(t):
                    rows.append(i)
                    looks.append(digest(seen))
                    own.append(digest(t))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int32())), pa.array(looks, pa.binary()), pa.array(own, pa.binary())], ["key", "look", "own"])

    schema = T.StructType([T.StructField("key", pages.schema[key].dataType), T.StructField("look", T.BinaryType()), T.StructField("own", T.BinaryType())])
    source = pages.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(run, schema).distinct()


def look_classes(keys: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, representative, look, texts): rows of `look_keys` whose look several different texts have.

    `representative` is the least key of those with the same text, so equal texts share one, and
    `texts` the number of different texts of the look. A class of any size is one row a member: a page
    that stands a million times in two spellings gives a million rows, not their pairs.
    """
    texts = keys.groupBy("look", "own").agg(F.min("key").alias("representative"))
    many = texts.groupBy("look").agg(F.count("*").alias("texts")).where(F.col("texts") > 1)
    kin = texts.join(many, "look")
    return keys.join(kin, ["look", "own"]).select(F.col("key").alias(key), F.col("representative"), F.lower(F.hex("look")).alias("look"), "texts")


def same_look_pairs(keys: DataFrame, key: str = "page_id") -> DataFrame:
    """(key_a, key_b), the smaller first: rows of `look_keys` that look the same but differ in code points.

    Derived from the classes: the representatives of one look are paired first and the members joined
    to the pairs afterwards, so copies of one text, however many, are never compared with each other.
    The result names every pair, as asked for; `look_classes` is the form whose size follows the input.
    """
    members = written(look_classes(keys, key), "look-classes")
    heads = members.where(F.col(key) == F.col("representative")).select("look", "representative")
    a, b = heads.alias("a"), heads.alias("b")
    pairs = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.representative") < F.col("b.representative"))).select(F.col("a.representative").alias("ra"), F.col("b.representative").alias("rb"))
    left = members.select(F.col(key).alias("x"), F.col("representative").alias("ra"))
    right = members.select(F.col(key).alias("y"), F.col("representative").alias("rb"))
    out = pairs.join(left, "ra").join(right, "rb").where(F.col("x") != F.col("y"))
    return out.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()
