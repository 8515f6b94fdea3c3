"""Keyword-stuffed pages, link lists and tag lists (problem 8).

Function words are learned per language from all documents; then every text is measured once, in
stretches of lines: share of function words, share of the few words the text keeps repeating, share
of its repeated word n-grams and lines, link share, table and settings syntax. Thresholds on these are calibrated per language over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import small, written

MIN_CHARS, MIN_SHARE = 200, 0.5
#: A function word stands in this share of the documents that the language's most widespread word is in.
SPREAD = 0.75
#: A stretch lacks function words below this part of its language's median share.
LACKING = 0.5
#: A stretch repeats keywords beyond this multiple of its language's median share of the top words.
REPEATING, REPEATING_RANGE = 3.0, (0.5, 0.65)
#: Fewer links than this are no list; nor are fewer tags, or tags that aren't most of a line's chunks.
MIN_LINKS, MIN_TAGS = 5, 5
#: A line is a list of tags if bare separators are this share of its chunks.
SEPARATED = 0.15
TOP_WORDS, TOP_COUNT, WINDOW = 6, 3, 40
#: Languages with fewer documents, or whose most widespread word isn't in this share of them, have no function words of their own.
MIN_DOCUMENTS, COMMON = 20, 0.5
#: Words in a row that stand this often in a text are repeated, and so is a line.
GRAM, GRAM_COUNT = 4, 3
_FS_BINS, _TOP_BINS, _REP_BINS = 40, 20, 20

_WORD = re.compile(r"[^\W\d_]+")
_ASIAN = re.compile(r"[぀-ヿ㐀-鿿]")
# scripts without spaces: a run of one kind of character is a word
_RUN = re.compile(r"[぀-ゟ]+|[゠-ヿ]+|[㐀-鿿]+|[^\W\d_぀-ヿ㐀-鿿]+")
_LINK = re.compile(r"<a [^>]*>[^<]*</a>|\[[^\]]*\]\([^)]*\)|(?:https?://|www\.)[^\s<>)\"]+")
_CODE = re.compile(r"`[^`]*`")
_SEPARATORS = frozenset("·•»›>|/⁄～~*◦")
_PAIR = re.compile(r'"\s*:')
_STAMPED = re.compile(r"[\[(]?(?:\d{4}-\d\d-\d\d|\d{1,2}:\d\d:\d\d)")  # a log repeats itself
_SETTING = re.compile(r'[\s\[\]{}(),"\d.:+-]*$|\s*[\w.-]+\s*[=:]\s*\S{1,40}\s*$')


def _words(line: str) -> list[str]:
    return (_RUN if _ASIAN.search(line) else _WORD).findall(line)


def _is_record(line: str) -> bool:
    """A line of settings, JSON or a table rather than of text."""
    if (pairs := len(_PAIR.findall(line))) and len(line) <= 60 * pairs:
        return True
    for mark in "|\t":
        cells = line.split(mark)
        if len(cells) >= 3 and sum(any(map(str.isdigit, c)) for c in cells) >= 2:
            return True
    return bool(_SETTING.match(line))


def _is_tags(chunks: list[str]) -> bool:
    """Hash tags, or items between bare separators, are most of the line; a leading quote or list mark is none."""
    if len(chunks) < MIN_TAGS:
        return False
    marks = sum(c in _SEPARATORS for c in chunks[1:])
    return marks >= SEPARATED * len(chunks) or sum(c[0] == "#" and len(c) > 1 for c in chunks) > len(chunks) / 2


def _repeated(stretches: list[tuple[list[str], int, str]]) -> list[float]:
    """The share of each stretch's words that repeated n-grams of the text cover; 1 for a repeated line, 0 for one with a time stamp."""
    lines = Counter(line for *_, line in stretches)
    texts = [[] if _STAMPED.match(line) else w for w, _, line in stretches]
    flat = [x for w in texts for x in w]
    grams = list(zip(*(flat[i:] for i in range(GRAM))))
    often = {g for g, n in Counter(grams).items() if n >= GRAM_COUNT}
    covered = bytearray(len(flat))
    if often:
        for i, g in enumerate(grams):
            if g in often:
                covered[i : i + GRAM] = b"\1" * GRAM
    out, at = [], 0
    for w, (_, _, line) in zip(texts, stretches):
        share = sum(covered[at : at + len(w)]) / len(w) if w else 0.0
        out.append(1.0 if w and lines[line] >= GRAM_COUNT else share)
        at += len(w)
    return out


def word_spread(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n_documents) over all documents; word '' counts the documents themselves.

    Partial counts are made per Arrow batch, so a word crosses the network once a batch, not once a
    document. Null languages and texts don't count.
    """
    schema = "lang string, word string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, Counter] = {}
            for of, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                t = t.lower()
                c = counts.setdefault(of, Counter())
                c[""] += 1
                c.update(set(_words(_LINK.sub(" ", t) if "://" in t or "www." in t else t)))
            rows = [(of, w, n) for of, c in counts.items() for w, n in c.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    source = documents.where(F.col(lang).isNotNull() & (F.col(lang) != "und") & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return source.mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n_documents"))


def function_words(documents: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, frozenset[str]]:
    """The function words of each language with at least MIN_DOCUMENTS documents.

    They stand in SPREAD of the most widespread word's documents, and that word in COMMON of the
    language's: so there are at most as many as a document has different words, divided by SPREAD x
    COMMON, and that is all that is collected. The code `und` is no language.
    """
    spread = written(word_spread(documents, text, lang), "word-spread")
    tops = spread.groupBy("lang").agg(F.max(F.when(F.col("word") == "", F.col("n_documents"))).alias("docs"), F.max(F.when(F.col("word") != "", F.col("n_documents"))).alias("top"))
    tops = tops.where((F.col("docs") >= MIN_DOCUMENTS) & (F.col("top") >= COMMON * F.col("docs"))).select("lang", "top")
    rows = spread.where(F.col("word") != "").join(small(written(tops, "language-tops")), "lang").where(F.col("n_documents") >= SPREAD * F.col("top")).select("lang", "word").collect()
    words: dict[str, set[str]] = {}
    for r in rows:
        words.setdefault(r["lang"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in words.items()}


def measures(documents: DataFrame, words: dict[str, frozenset[str]], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, learned, fs, top, rep, n_links, link_chars, chars, cells): one row per text of at least MIN_CHARS code points.

    `lang` is the language whose function words the text has most of (the row's own on a draw), `learned`
    tells that the row names a language with function words of its own, `fs`
    their share, `top` the share of its six most repeated other words, `rep` that of the words in its
    repeated n-grams and lines. `cells` counts the characters of stretches by their own three shares, in
    bins; tag lists stand in the highest bin of repetition, links, settings and table lines are kept out of it.
    """
    schema = T.StructType(
        [
            T.StructField("key", documents.schema[key].dataType),
            T.StructField("lang", T.StringType()),
            T.StructField("learned", T.BooleanType()),
            *[T.StructField(n, t) for n, t in (("fs", T.DoubleType()), ("top", T.DoubleType()), ("rep", T.DoubleType()))],
            *[T.StructField(n, T.LongType()) for n in ("n_links", "link_chars", "chars")],
            T.StructField("cells", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )
    kinds = [pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32()))]
    order = sorted(words)

    def measured(own: str | None, t: str) -> tuple:
        stretches, total, links, link_chars, tags = [], 0, 0, 0, 0
        for line in t.lower().split("\n"):
            line = line.strip()
            if not line:
                continue
            n = len(line)
            total += n
            if "://" in line or "www." in line:
                spans = [len(m[0]) for m in _LINK.finditer(line)]
                links += len(spans)
                if sum(spans) > n / 2:
                    link_chars += n
                    continue
                line = _LINK.sub(" ", line)
            if "`" in line:
                line = _CODE.sub(" ", line)
            if _is_record(line):
                continue
            if _is_tags(line.split()):
                tags += n
                continue
            w = _words(line)
            if len(w) > 1.5 * WINDOW:
                parts = [(w[i : i + WINDOW], f"{line}\n{i}") for i in range(0, len(w), WINDOW)]
                stretches += [(x, n * len(x) // len(w), part) for x, part in parts]
            else:
                stretches.append((w, n, line))
        counts: Counter = Counter()
        for w, *_ in stretches:
            counts.update(w)
        tokens = sum(counts.values())
        found = {x: sum(counts[w] for w in words[x]) for x in order}
        best = max(order, key=lambda x: (found[x], x == own), default=None)
        function = words.get(best, frozenset())
        rest = {w: c for w, c in counts.items() if w not in function}
        repeated = sorted((c for c in rest.values() if c >= TOP_COUNT), reverse=True)[:TOP_WORDS]
        floor = repeated[-1] if repeated else 0
        head = {w for w, c in rest.items() if floor and c >= floor}
        if len(head) > TOP_WORDS:  # ties at the end of the list: take them in order
            head = set(sorted(head, key=lambda w: (-rest[w], w))[:TOP_WORDS])
        cells: Counter = Counter()
        if tags:
            cells[0, 0, _REP_BINS] += tags
        repeats = _repeated(stretches)
        for (w, n, _), r in zip(stretches, repeats):
            f = sum(map(function.__contains__, w))
            other = len(w) - f
            h = sum(map(head.__contains__, w)) if head else 0
            cells[int(_FS_BINS * f / len(w)) if w else 0, int(_TOP_BINS * h / other) if other else 0, int(_REP_BINS * r)] += n
        share = sum(repeated) / max(1, sum(rest.values()))
        rep = sum(len(w) * r for (w, *_), r in zip(stretches, repeats)) / max(1, tokens)
        learned = own in words
        return best, learned, found.get(best, 0) / max(1, tokens), share, rep, links, link_chars, total, [[*k, v] for k, v in cells.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measured(of, t) for of, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], schema.names)

    source = documents.where(F.length(text) >= MIN_CHARS).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def spam_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, spam_share): texts of which more than half is repeated keywords, links or tags.

    A stretch of a text counts if it is mostly links (in texts with MIN_LINKS links or more), if its
    function words are less than LACKING of the language's median, or if its share of the text's most
    repeated words or of its repeated n-grams exceeds REPEATING times the language's median, or if it is a list of tags. Lines of
    tables, settings and JSON don't count. Null, empty and short texts are no cases; a wrong language
    doesn't matter where the text has the function words of another. Where a row names no language, or
    one without function words of its own (fewer than MIN_DOCUMENTS documents), and its text doesn't
    have those of any language, what it lacks is unknown: the other measures judge alone, so that
    prose of a rare language is never taken for spam. Rows with the same key are judged each for
    itself and reported once.
    """
    words = function_words(documents, text, lang)
    m = written(measures(documents, words, key, text, lang), "spam-measures")
    medians = m.where("learned").groupBy("lang").agg(F.percentile_approx("fs", 0.5, 1000).alias("fs50"), F.percentile_approx("top", 0.5, 1000).alias("top50"), F.percentile_approx("rep", 0.5, 1000).alias("rep50"))
    x = m.alias("m").join(small(written(medians, "language-medians")).alias("l"), F.col("m.lang").eqNullSafe(F.col("l.lang")), "left")
    least = F.lit(LACKING) * F.col("fs50") * _FS_BINS
    beyond = lambda c: F.least(F.greatest(F.lit(REPEATING) * F.col(c), F.lit(REPEATING_RANGE[0])), F.lit(REPEATING_RANGE[1]))
    # a language without function words of its own: what the text lacks of another's says nothing
    known = F.col("fs50").isNotNull() & (F.col("learned") | (F.col("fs") >= F.lit(LACKING) * F.col("fs50")))
    bad = F.filter("cells", lambda c: (known & ((c[0] + 1 <= least) | (c[0] == 0))) | (c[1] >= beyond("top50") * _TOP_BINS) | (c[2] >= beyond("rep50") * _REP_BINS))
    spam = F.aggregate(bad, F.lit(0), lambda a, c: a + c[3]) + F.when(F.col("n_links") >= MIN_LINKS, F.col("link_chars")).otherwise(0)
    scored = x.select(key, F.col("m.lang").alias("lang"), (spam / F.greatest(F.col("chars"), F.lit(1))).alias("spam_share"))
    return scored.where(F.col("spam_share") > MIN_SHARE).groupBy(key).agg(F.max_by("lang", "spam_share").alias("lang"), F.max("spam_share").alias("spam_share"))
