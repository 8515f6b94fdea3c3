"""Noise in text from scanned pages, and its repair (problem 2).

Edge lines: running headers and page numbers show by repetition within a document and by the run of
their numbers. Misread words: a word that neither the lexicon nor clean pages know is joined, by the
difference of anagram hashes that each confusion of the recognition makes, with the frequent words it
may stand for; the best-ranked explanation corrects it. Hyphens: the joined and the hyphenated form
are weighed by what is known of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import measured_bytes, small, written

# What recognition confuses, (true, seen), lower case.
CONFUSIONS = (
    ("e", "c"), ("o", "0"), ("l", "1"), ("l", "|"), ("i", "1"), ("s", "5"), ("a", "@"), ("t", "f"), ("h", "b"), ("b", "6"), ("b", "8"), ("g", "9"), ("z", "2"),
    ("d", "cl"), ("cl", "d"), ("m", "rn"), ("rn", "m"), ("n", "ri"), ("u", "ii"), ("w", "vv"), ("li", "h"),
    ("d", "c1"), ("d", "c|"), ("n", "r1"), ("u", "1i"), ("u", "i1"), ("m", "r1i"),
    ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "ss"), ("ß", "b"), ("é", "6"), ("ñ", "n"),
    ("о", "0"), ("и", "н"), ("н", "п"), ("з", "3"),
)
#: Confusions in one word at most.
DEPTH = 3
# Division marks at a line's end, and those that never belong to a word.
DIVIDERS, SOFT_DIVIDERS = "-‐¬­", "¬­"
# What an isolated pen stroke looks like.
STROKES = frozenset(["|", "_", "`", "'", "')", "`)", "(", ")", "~", "^", "\\"])
# Words before a printed page number.
PAGE_WORDS = "page|seite|página|pagina|страница|стр\\.|ページ|p\\.|s\\."

#: An edge line is a notice, not a header, if this many documents and this share of its source's scanned documents carry it;
#: one that repeats in its own document only if that share is ALMOST_ALL: no source gives most of its documents one chapter.
NOTICE_DOCUMENTS, NOTICE_SHARE, ALMOST_ALL = 3, 0.05, 0.5

#: Letters of a third of a line, and of a short line as a whole, that tell something by themselves.
MIN_THIRD, MIN_WHOLE = 5, 2

#: Non-blank lines at either end of a page among which its header and number are, and in which a divided word goes on behind them.
_EDGE, _NEXT = 3, 3
#: A lexicon of more bytes isn't shipped to the executors.
MOST_LEXICON_BYTES = 128 << 20
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏͰ-ӿ]+(?:[-'’][A-Za-zÀ-ÖØ-öø-ɏͰ-ӿ]+)*")
_OUTSIDE = re.compile(r"^[^\w@|]+|[^\w@|]+$")
_NO_WORD = re.compile(r"[\d.,:;/%-]+s?$|[A-Za-z]\d+$")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = re.compile(rf"\s*(?:(?P<word>{PAGE_WORDS})\s*|(?P<open>[-—–\[(|~])\s*)?(?P<core>[0-9lIO|oSBZ]{{1,4}}|[ivxlcdm1|]{{1,9}})\s*(?P<close>[-—–\])|~.])?\s*$", re.I)
_DIGITS = str.maketrans("lIO|oSsBZi", "1101055821")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_STOP = re.compile(r"(?<=\w\w)[.!?;:,](?=\s|$)")
_ASIAN_STOP = re.compile(r"[。！？、，；：]$")
_ASIDE = re.compile(r"^\s*(?:[0-9lIO|]{1,4}|[ivxlc]{1,9})\s+(?=\S)|\s+(?:[0-9lIO|]{1,4}|[ivxlc]{1,9})\s*$")


#: Anagram hashes are taken modulo this, so that a word of any length and script has one.
_MODULUS = (1 << 44) - 17


def anagram(word: str) -> int:
    return sum(pow(ord(c), 5, _MODULUS) for c in word) % _MODULUS


def anagram_column(word: Column) -> Column:
    """Sum of the fifth powers of the code points: equal for anagrams, and a confusion adds a constant."""
    m = F.lit(_MODULUS)

    def power(c: Column) -> Column:
        at = F.ascii(c).cast("long")
        return (((at * at * at) % m * at) % m * at) % m

    return F.aggregate(F.transform(F.split(word, ""), power), F.lit(0).cast("long"), lambda a, x: (a + x) % m)


def explain(seen: str, true: str, most: int = DEPTH) -> int:
    """The least number of confusions that turn `true` into `seen`; `most` + 1 if it takes more."""
    best = [most + 1]

    def go(i: int, j: int, cost: int) -> None:
        while i < len(seen) and j < len(true) and seen[i] == true[j]:
            for a, b in CONFUSIONS:
                if cost + 1 < best[0] and seen.startswith(b, i) and true.startswith(a, j) and a != b:
                    go(i + len(b), j + len(a), cost + 1)
            i, j = i + 1, j + 1
        if i == len(seen) and j == len(true):
            best[0] = min(best[0], cost)
        elif cost + 1 < best[0]:
            for a, b in CONFUSIONS:
                if seen.startswith(b, i) and true.startswith(a, j):
                    go(i + len(b), j + len(a), cost + 1)

    go(0, 0, 0)
    return best[0]


def first_change(seen: str, true: str) -> int:
    """The position in `seen` where it first differs."""
    return next((i for i, (a, b) in enumerate(zip(seen, true)) if a != b), min(len(seen), len(true)))


def printed_number(line: str) -> tuple[int, str] | None:
    """(value, style) of a line that holds only a printed page number, misread or not."""
    m = _NUMBER.match(line)
    if not m:
        return None
    core, style = m["core"], f"{'w' if m['word'] else m['open'] or ''}{m['close'] or ''}"
    low = core.lower().replace("1", "l").replace("|", "l")
    if any(c.isdigit() for c in core) or not _ROMAN.match(low) or core.isupper() and len(core) > 1 and set(core) <= set("IO"):
        digits = core.translate(_DIGITS)
        return (int(digits), style + "9") if digits.isdigit() and any(map(str.isdigit, core)) or style[:1] in ("w", "[", "-", "—") and digits.isdigit() else None
    values = [_ROMAN_VALUES[c] for c in low]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values)), style + "i"


_FOLDED = str.maketrans("cfb680|1i59@2äöüéо3н", "ethhholllsgazaoueoзп")


def _fold(words: list[str]) -> str:
    """Letters with every confusion undone towards one side, so that misread copies of a line meet."""
    s = "".join(c for c in "".join(words).lower() if c.isalnum() or c in "@|")
    for a, b in (("ß", "ss"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("li", "h")):
        s = s.replace(a, b)
    return s.translate(_FOLDED)


def _segments(line: str, head: bool = True, foot: bool = True) -> list[str]:
    """Five stretches of a possible header, folded; author and number left out; empty ones don't exist.

    Its thirds, and the line as a whole at the head and at the foot of a page if a third is too short
    to tell something (a line of one or two words, or in a script without spaces, has no thirds).
    """
    w = line.split(" — ")[-1].split()
    n = len(w)
    a, b = -(-n // 3), -(-2 * n // 3)
    thirds = [_fold(w[:a]), _fold(w[a:b]), _fold(w[b:])] if n >= 3 else [""] * 3
    whole = "" if min(map(len, thirds)) >= MIN_THIRD else _fold(w)
    return [*thirds, whole if head else "", whole if foot else ""]


def _token(w: str) -> str:
    return _OUTSIDE.sub("", w).lower()


def _facts(text: str, known: frozenset) -> tuple:
    """(edges, heads, splits, suspects, marks, number of lines) of one page; lines count from 1."""
    lines = [x.rstrip() for x in text.split("\n")]
    full = [i for i, x in enumerate(lines) if x]
    words = {i: lines[i].split() for i in full}
    firsts = {i: next((_token(w) for w in words[i] if w not in STROKES), "") for i in full}
    raw = {i: next((w for w in words[i] if w not in STROKES), "") for i in full}
    edges = []
    for k, i in enumerate(full):
        if k >= _EDGE and k < len(full) - _EDGE:
            continue
        line = lines[i].strip()
        number = printed_number(line)
        bare = line if number else _ASIDE.sub("", line)
        letters = [c for c in bare if c.isalpha()]
        after = words[full[k + 1]][0] if k + 1 < len(full) else ""
        last = bare.split()[-1] if bare.split() else ""
        # a heading-like line: capital at both ends, no stop, and what follows begins anew
        titled = bool(letters) and not _STOP.search(bare.split(" — ")[-1]) and bare[:1].isupper() and last[:1].isupper() and last[-1:].isalpha() and (not after or after[:1].isupper() or lines[i + 1 : i + 2] == [""])
        # a short line counts as a whole where a header stands: outermost but for a number, and no end of a sentence
        short = k < 2 and k < len(full) - k, len(full) - k <= 2 and len(full) - k <= k
        if _STOP.search(bare.split(" — ")[-1]) or _ASIAN_STOP.search(bare) or len(letters) < MIN_WHOLE:
            short = False, False
        edges.append(
            (i + 1, k + 1, len(full) - k, number[0] if number else -1, number[1] if number else "", [] if number else _segments(bare, *short), len(letters), bool(letters) and "".join(letters).isupper() and len(bare.split()) >= 4, titled and len(bare.split()) >= 5)
        )
    heads = [(i + 1, firsts[i], raw[i][:1].isupper()) for i in full[: _EDGE + 1]]
    splits, suspects, marks = [], [], []
    for k, i in enumerate(full):
        w = words[i]
        if any(x in STROKES for x in w):
            marks.append(i + 1)
            w = [x for x in w if x not in STROKES]
        if w and w[-1][-1] in DIVIDERS and len(left := _token(w[-1][:-1])) and (w[-1][-2:-1].isalpha() or w[-1][-2:-1] in "@|0123456789"):
            ahead = [(j + 1, firsts[j], raw[j][:1].isupper()) for j in full[k + 1 : k + 1 + _NEXT]]
            if _LETTER.search(left) or "@" in left:
                splits.append((i + 1, left, w[-1][-1], w[-1][:-1].isupper(), ahead))
                w = w[:-1]
        for n, x in enumerate(w):
            t = _token(x)
            if t and t not in known and not _NO_WORD.match(t):
                suspects.append((i + 1, n == 0, t))
    return edges, heads, splits, suspects, marks


_FACTS = (
    "page_id {p}, document_id {d}, page int, source long, edges array<struct<line:int,head:int,foot:int,value:int,style:string,segments:array<string>,letters:int,upper:boolean,titled:boolean>>, "
    "heads array<struct<line:int,word:string,upper:boolean>>, splits array<struct<line:int,left:string,mark:string,upper:boolean,ahead:array<struct<line:int,word:string,upper:boolean>>>>, "
    "suspects array<struct<line:int,first:boolean,word:string>>, marks array<int>"
)


def scanned(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("ocr_method") != "") & F.col("page_id").isNotNull() & (F.length("text") > 0))


def page_facts(pages: DataFrame, known: frozenset) -> DataFrame:
    """One row per scanned page with what its lines show by themselves; each page once."""
    schema = _FACTS.format(p=pages.schema["page_id"].dataType.simpleString(), d=pages.schema["document_id"].dataType.simpleString())
    lexicon = pages.sparkSession.sparkContext.broadcast(known)
    line = pa.struct([("line", pa.int32()), ("word", pa.string()), ("upper", pa.bool_())])
    kinds = [
        pa.list_(pa.struct([("line", pa.int32()), ("head", pa.int32()), ("foot", pa.int32()), ("value", pa.int32()), ("style", pa.string()), ("segments", pa.list_(pa.string())), ("letters", pa.int32()), ("upper", pa.bool_()), ("titled", pa.bool_())])),
        pa.list_(line),
        pa.list_(pa.struct([("line", pa.int32()), ("left", pa.string()), ("mark", pa.string()), ("upper", pa.bool_()), ("ahead", pa.list_(line))])),
        pa.list_(pa.struct([("line", pa.int32()), ("first", pa.bool_()), ("word", pa.string())])),
        pa.list_(pa.int32()),
    ]
    names = ["page_id", "document_id", "page", "source", "edges", "heads", "splits", "suspects", "marks"]

    def built(rows: list, kind: pa.DataType) -> list:
        if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
            return rows
        fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
        return [{f.name: built(x, f.type) for f, x in zip(fields, r)} for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.value
        for b in batches:
            facts = [_facts(t, words) for t in b.column("text").to_pylist()]
            cols = [pa.array([built(f[i], k) for f in facts], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.int32()), b.column(3), *cols], names)

    source = F.xxhash64("source") if "source" in pages.columns else F.lit(0).cast("long")
    return scanned(pages).select("page_id", "document_id", "page", source.alias("source"), "text").mapInArrow(run, schema).dropDuplicates(["page_id"])


def known_words(pages: DataFrame, lexicon: DataFrame, least: int = 2) -> DataFrame:
    """(word, listed, n, hash): the lexicon and the words of at least `least` pages that weren't scanned.

    Counts cover all pages; each Arrow batch sends a word once. Repeated rows of a page may count
    twice. Words in scripts without spaces are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for t in b.column("text").to_pylist():
                c.update(set(_WORD.findall(t.lower())))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    clean = pages.where((F.col("ocr_method").isNull() | (F.col("ocr_method") == "")) & (F.length("text") > 0)).select("text").mapInArrow(run, "word string, n long")
    clean = clean.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("word", F.lit(0).alias("listed"), "n")
    listed = lexicon.where(F.length("word") > 0).select(F.lower("word").alias("word"), F.lit(1).alias("listed"), F.coalesce("n_seen", F.lit(1)).cast("long").alias("n"))
    both = clean.unionByName(listed).groupBy("word").agg(F.max("listed").alias("listed"), F.sum("n").alias("n"))
    return both.withColumn("hash", anagram_column(F.col("word")))


def corrections(rare: DataFrame, known: DataFrame) -> DataFrame:
    """(word, best, cost): for distinct words that aren't known, the best-ranked known word they are a misreading of.

    The hash of a rare word plus the differences of up to DEPTH confusions whose seen side it contains
    is joined with the hashes of the known words; of the pairs that the confusions do explain, fewest
    confusions rank first, then listed words, then frequency, then the alphabet.
    """
    table = F.array(*[F.struct(F.lit(b).alias("seen"), F.lit((anagram(a) - anagram(b)) % _MODULUS).alias("delta")) for a, b in CONFUSIONS])
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("from"))
    can = rare.select("word", anagram_column(F.col("word")).alias("hash"), F.filter(table, lambda k: F.contains(F.col("word"), k["seen"])).alias("can")).where(F.size("can") > 0)
    step = lambda sums: F.flatten(
        F.transform(sums, lambda s: F.transform(F.sequence(s["from"], F.size("can") - 1), lambda i: F.struct((s["sum"] + F.get("can", i)["delta"]).alias("sum"), i.alias("from"))))
    )
    can = can.withColumn("s1", step(F.array(zero)))
    for n in range(2, DEPTH + 1):
        can = can.withColumn(f"s{n}", step(F.col(f"s{n - 1}")))
    sums = F.array_distinct(F.transform(F.concat(*[F.col(f"s{n}") for n in range(1, DEPTH + 1)]), lambda s: s["sum"]))
    tries = can.select("word", F.explode(sums).alias("delta"), "hash").select("word", ((F.col("hash") + F.col("delta")) % F.lit(_MODULUS)).alias("hash"))
    k = small(known.where(F.col("hash").isNotNull()).select(F.col("word").alias("best"), "listed", "n", "hash"))
    pairs = tries.join(k, "hash").select("word", "best", "listed", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost = [explain(x, y) for x, y in zip(b.column("word").to_pylist(), b.column("best").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cost, pa.int32())], [*b.schema.names, "cost"])

    schema = "word string, best string, listed int, n long, cost int"
    explained = pairs.mapInArrow(run, schema).where(F.col("cost").between(1, DEPTH))
    rank = F.struct(-F.col("cost"), F.col("listed"), F.col("n"), F.col("best"))
    return explained.groupBy("word").agg(F.max_by("best", rank).alias("best"), F.min("cost").alias("cost"))


def _has_thirds(segments: str) -> Column:
    return F.array_join(F.slice(segments, 1, 3), "") != ""


def _telling() -> Column:
    return F.length("segment") >= F.when(F.col("i") < 3, MIN_THIRD).otherwise(MIN_WHOLE)


def _ends(i: str) -> Column:
    """Both ends for a whole line."""
    return F.when(F.col(i) < 3, F.array(i)).otherwise(F.array(F.lit(3), F.lit(4)))


def _notices(facts: DataFrame, edges: DataFrame, places: DataFrame, weight: Callable[[Column], Column]) -> DataFrame:
    """(page_id, line, broad): edge lines that a share of their source's scanned documents carry, `broad` if almost all do.

    Whole lines are counted; a line is then known as one, misread or not, by half of its letters.
    """
    # where a short line stands is no matter here
    whole = F.array_join(F.when(_has_thirds("e.segments"), F.slice("e.segments", 1, 3)).otherwise(F.col("e.segments")), "")
    whole = F.xxhash64(whole).alias("whole")
    sizes = facts.select("source", "document_id").distinct().groupBy("source").agg(F.count("*").alias("size"))
    shared = edges.select("source", whole, "document_id").distinct().groupBy("source", "whole").agg(F.count("*").alias("n")).where(F.col("n") >= NOTICE_DOCUMENTS)
    shared = shared.join(small(written(sizes, "scanned-documents")), "source").select("source", "whole", (F.col("n") / F.col("size")).alias("share")).where(F.col("share") >= NOTICE_SHARE)
    shared = small(written(shared, "shared-lines"))
    x = edges.select("source", whole, F.col("e.segments").alias("segments")).join(shared, ["source", "whole"]).groupBy("source", "whole").agg(F.first("segments").alias("segments"), F.first("share").alias("share"))
    x = x.select("source", "share", F.posexplode("segments").alias("i", "segment")).where(_telling()).select("source", "share", F.explode(_ends("i")).alias("i"), "segment").groupBy("source", F.xxhash64("i", "segment").alias("place")).agg(F.max("share").alias("share"))
    hit = places.join(small(written(x, "notice-places")), ["source", "place"]).groupBy("page_id", "line")
    return hit.agg(weight(F.lit(True)).alias("notice"), weight(F.col("share") >= ALMOST_ALL).alias("broad")).where("notice").select("page_id", "line", "broad")


def _headers(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(page_id, line) of running headers among the edge lines."""
    e = facts.select("page_id", "document_id", "source", F.explode("edges").alias("e")).where((F.col("e.value") < 0) & (F.array_join("e.segments", "") != ""))
    s = e.select("page_id", "document_id", "source", F.col("e.line").alias("line"), F.col("e.letters").alias("letters"), F.posexplode("e.segments").alias("i", "segment")).where(_telling())
    # 64-bit hashes stand for the segments: they only meet within one document, or as notices
    place = F.xxhash64("i", "segment").alias("place")
    s = s.select("page_id", "document_id", "source", "line", "letters", F.when(F.col("i") < 3, F.length("segment")).otherwise(F.col("letters")).alias("got"), place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, i, segment = [], [], []
            for k, t in enumerate(b.column("title").to_pylist()):
                for n, x in enumerate(_segments(t)):
                    rows.append(k)
                    i.append(n)
                    segment.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(i, pa.int32()), pa.array(segment, pa.string())], ["document_id", "i", "segment"])

    d = facts.schema["document_id"].dataType.simpleString()
    names = F.explode(F.array(*[c for c in ("title", "author") if c in files.columns])).alias("title")
    titles = files.select("document_id", names).where(F.length("title") > 0).distinct().mapInArrow(run, f"document_id {d}, i int, segment string").where(_telling()).select("document_id", place)
    seen = written(s.groupBy("document_id", "place").agg((F.min("page_id") != F.max("page_id")).alias("again")), "edge-places")
    good = seen.where("again").select("document_id", "place", F.lit(False).alias("own")).unionByName(titles.select("document_id", "place", F.lit(True).alias("own")))
    good = small(written(good.groupBy("document_id", "place").agg(F.max("own").alias("own")), "header-places"))
    weight = lambda of: F.sum(F.when(of, F.col("got")).otherwise(0)) >= 0.5 * F.first("letters")
    matched = s.join(good, ["document_id", "place"]).groupBy("page_id", "line").agg(weight(F.lit(True)).alias("repeats"), weight(F.col("own")).alias("own"))
    notice = written(_notices(facts, e, s, weight), "notice-lines")
    broad = notice.where("broad").select("page_id", "line", F.lit(True).alias("broad"))
    repeated = matched.where("repeats").join(broad, ["page_id", "line"], "left").where(F.col("own") | F.col("broad").isNull())
    repeated = written(repeated.select("page_id", "line"), "repeated-headers")
    # a header that repeats nowhere (a short chapter): outermost but for a number beside it, on a page
    # without another, in capitals or shaped like a title
    rank = F.least(F.col("e.head"), F.col("e.foot"))
    lone = e.where(_has_thirds("e.segments") & (rank <= 2) & (F.col("e.upper") | F.col("e.titled"))).select("page_id", F.col("e.line").alias("line"), rank.alias("rank"))
    lone = lone.join(notice.select("page_id", "line"), ["page_id", "line"], "left_anti").join(repeated.select("page_id").distinct(), "page_id", "left_anti")
    lone = lone.groupBy("page_id").agg(F.min_by("line", F.struct("rank", "line")).alias("line"))
    return repeated.unionByName(lone).distinct()


def _numbers(facts: DataFrame, headers: DataFrame) -> DataFrame:
    """(page_id, line) of printed page numbers: the outermost line besides headers, one a page at most."""
    h = headers.groupBy("page_id").agg(F.collect_set("line").alias("drop"))
    f = facts.join(h, "page_id", "left")
    rest = F.array_sort(F.filter("edges", lambda e: ~F.coalesce(F.array_contains("drop", e["line"]), F.lit(False))))
    f = f.select("page_id", "document_id", "page", rest.alias("rest")).where(F.size("rest") > 0)
    ends = F.array_distinct(F.array(F.element_at("rest", 1), F.element_at("rest", -1)))
    c = f.select("page_id", "document_id", "page", F.explode(ends).alias("e")).where(F.col("e.value") >= 0)
    c = c.select("page_id", "document_id", "page", F.col("e.line").alias("line"), F.col("e.value").alias("value"), F.col("e.style").alias("style"), F.col("e.head").alias("head"))
    c = c.withColumn("shift", F.col("value") - F.col("page"))
    runs = c.groupBy("document_id", "shift").agg(F.count("*").alias("run"))
    styles = c.groupBy("document_id", "style").agg(F.count("*").alias("alike"))
    x = c.join(runs, ["document_id", "shift"]).join(styles, ["document_id", "style"])
    bare = F.col("style").isin("9", ".9", "i", ".i", ")9")
    sure = (F.col("run") >= 2) | (~bare) | ((F.col("value") < 1000) & ~F.col("style").isin("i", ")9")) | ((F.col("alike") >= 2) & (F.col("value") < 1000)) | ((F.col("style") == "i") & (F.col("value") > 1))
    best = F.max_by("line", F.struct("run", "alike", (-F.col("head")).alias("h")))
    return x.where(sure).groupBy("page_id").agg(best.alias("line"))


def findings(pages: DataFrame, files: DataFrame, lexicon: DataFrame) -> DataFrame:
    """What `_needs` finds, without what only the repair has to know."""
    return _needs(pages, files, lexicon).where(F.col("kind") != "rest")


def _needs(pages: DataFrame, files: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(page_id, line_no, kind, seen, put): what each line of a scanned page needs, and how to mend it.

    `header` and `page_number` lines go and carry nothing else. `hyphen`: the division mark goes, `seen`
    is the left part and `put` the rest of the word from the next body line, on the next page if need
    be. `misread`: the word `seen` becomes `put`; a divided word counts where its first wrong letter
    stands. `mark`: isolated strokes go. Pages without text or `ocr_method` give nothing; repeated rows
    of a page count once. The words of clean pages are added to the lexicon.
    `rest` tells a page that its first word is the rest of one on the page before.
    """
    listed = lexicon.where(F.length("word") > 0).select(F.lower("word").alias("word")).distinct()
    # the lexicon only thins out what the pages send: beyond the bound all words go to the anti-join below
    listed = written(listed, "lexicon-words")
    shipped = frozenset(r[0] for r in listed.collect()) if measured_bytes(listed) <= MOST_LEXICON_BYTES else frozenset()
    known = written(known_words(pages, lexicon), "known-words")
    facts = written(page_facts(pages, shipped), "scan-facts")
    headers = written(_headers(facts, files), "scan-headers")
    numbers = written(_numbers(facts, headers), "scan-numbers")
    edge = headers.unionByName(numbers.select("page_id", "line")).groupBy("page_id").agg(F.collect_set("line").alias("drop"))
    none = F.expr("cast(array() as array<int>)")
    f = facts.join(edge, "page_id", "left").withColumn("drop", F.coalesce("drop", none))
    body = lambda x: ~F.array_contains("drop", x["line"])
    turn = f.select("document_id", (F.col("page") - 1).alias("page"), F.col("page_id").alias("next_id"), F.get(F.filter("heads", body), F.lit(0)).alias("top"))
    splits = f.select("page_id", "document_id", "page", "drop", F.explode("splits").alias("s")).where(~F.array_contains("drop", F.col("s.line")))
    splits = splits.withColumn("ahead", F.get(F.filter("s.ahead", body), F.lit(0)))
    here = splits.where(F.col("ahead").isNotNull()).select("page_id", "s", F.col("ahead").alias("r"), F.col("page_id").alias("right_id"))
    over = splits.where(F.col("ahead").isNull()).join(turn, ["document_id", "page"], "left").select("page_id", "s", F.col("top").alias("r"), F.col("next_id").alias("right_id"))
    s = here.unionByName(over).select(
        "page_id", F.col("s.line").alias("line"), F.col("s.left").alias("left"), F.col("s.mark").alias("mark"), F.coalesce("r.word", F.lit("")).alias("right"), "right_id", F.col("r.line").alias("right_line"),
        (F.coalesce("r.upper", F.lit(False)) & ~F.col("s.upper")).alias("name"),
    )
    s = s.withColumn("joined", F.concat("left", "right")).withColumn("dashed", F.concat_ws("-", "left", "right"))
    s = written(s, "scan-splits")
    used = s.where(F.col("right") != "").select(F.col("right_id").alias("page_id"), F.col("right_line").alias("line"), F.lit(True).alias("first")).distinct()
    suspects = f.select("page_id", "drop", F.explode("suspects").alias("s")).where(~F.array_contains("drop", F.col("s.line"))).select("page_id", "s.line", "s.first", "s.word")
    suspects = suspects.join(used, ["page_id", "line", "first"], "left_anti")
    whole = s.where(F.col("right") != "")
    words = suspects.select("word").unionByName(whole.select(F.col("joined").alias("word"))).unionByName(whole.select(F.col("dashed").alias("word"))).distinct()
    rare = words.join(small(known.select("word")), "word", "left_anti")
    fixes = written(corrections(rare, known), "scan-corrections")
    fix, n_of = small(fixes), small(known.select("word", "n"))

    kj = n_of.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    kd = n_of.select(F.col("word").alias("dashed"), F.col("n").alias("n_dashed"))
    fj = fix.select(F.col("word").alias("joined"), F.col("best").alias("fix_joined"))
    fd = fix.select(F.col("word").alias("dashed"), F.col("best").alias("fix_dashed"))
    t = s.join(kj, "joined", "left").join(kd, "dashed", "left").join(fj, "joined", "left").join(fd, "dashed", "left")
    weight_joined, weight_dashed = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_dashed", F.lit(0))
    keeps = ~F.col("mark").isin(*SOFT_DIVIDERS) & (
        ((weight_dashed > 0) & (weight_dashed >= weight_joined)) | ((weight_joined == 0) & F.col("fix_joined").isNull() & (F.col("fix_dashed").isNotNull() | F.col("name")))
    )
    t = t.withColumn("divides", ~keeps & ((F.col("right") == "") | F.col("right").rlike(r"^[\p{L}@|0-9]")))
    hyphen = t.where("divides").select("page_id", "line", F.lit("hyphen").alias("kind"), F.col("left").alias("seen"), F.col("right").alias("put"))
    rest = t.where(F.col("divides") & (F.col("right") != "") & (F.col("right_id") != F.col("page_id")))
    rest = rest.select(F.col("right_id").alias("page_id"), F.col("right_line").alias("line"), F.lit("rest").alias("kind"), F.col("right").alias("seen"), F.lit(None).cast("string").alias("put"))
    seen = F.when(F.col("divides"), F.col("joined")).otherwise(F.col("dashed"))
    best = F.when(F.col("divides"), F.when(weight_joined == 0, F.col("fix_joined"))).otherwise(F.when(weight_dashed == 0, F.col("fix_dashed")))
    t = t.withColumn("seen", seen).withColumn("put", best).where(F.col("put").isNotNull() & (F.col("right") != ""))
    at = F.aggregate(F.sequence(F.lit(1), F.length("seen")), F.lit(0), lambda a, i: F.when((a == 0) & ((F.substr("seen", i, F.lit(1)) != F.substr("put", i, F.lit(1))) | (i > F.length("put"))), i).otherwise(a))
    left_side = at <= F.length("left")
    divided = t.select(F.when(left_side, F.col("page_id")).otherwise(F.col("right_id")).alias("page_id"), F.when(left_side, F.col("line")).otherwise(F.col("right_line")).alias("line"), F.lit("misread").alias("kind"), "seen", "put")
    plain = suspects.join(fix.select("word", "best"), "word").select("page_id", "line", F.lit("misread").alias("kind"), F.col("word").alias("seen"), F.col("best").alias("put"))
    marks = f.select("page_id", "drop", F.explode("marks").alias("line")).where(~F.array_contains("drop", F.col("line")))
    no = F.lit(None).cast("string")
    rows = [
        headers.select("page_id", "line", F.lit("header").alias("kind"), no.alias("seen"), no.alias("put")),
        numbers.join(headers, ["page_id", "line"], "left_anti").select("page_id", "line", F.lit("page_number").alias("kind"), no.alias("seen"), no.alias("put")),
        hyphen,
        rest,
        divided,
        plain,
        marks.select("page_id", "line", F.lit("mark").alias("kind"), no.alias("seen"), no.alias("put")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("page_id", F.col("line").alias("line_no"), "kind", "seen", "put").distinct()


def _mended(text: str, needs: list[dict]) -> str:
    """Continuous paragraphs of one page."""
    by: dict[int, list[dict]] = {}
    for x in needs:
        by.setdefault(x["line_no"], []).append(x)
    fixes = {x["seen"]: x["put"] for x in needs if x["kind"] == "misread"}
    paragraphs: list[str] = [""]
    join = None
    for n, line in enumerate(text.split("\n"), 1):
        mine = by.get(n, [])
        kinds = {x["kind"] for x in mine}
        if kinds & {"header", "page_number"}:
            continue
        words = [w for w in line.split() if w not in STROKES or "mark" not in kinds]
        if not words:
            if not line.strip() and paragraphs[-1] and join is None:
                paragraphs.append("")
            continue
        if words and any(x["kind"] == "rest" and x["seen"] == _token(words[0]) for x in mine):
            words = words[1:]
        if join is not None and words:  # the rest of a divided word is already there
            tail = words[0][len(join) :] if _token(words[0]) == join else words[0]
            paragraphs[-1] += tail if tail and not tail[:1].isalnum() else f" {tail}" if tail else ""
            words, join = words[1:], None
        words = [w.replace(_OUTSIDE.sub("", w), _cased(_OUTSIDE.sub("", w), fixes[t])) if (t := _token(w)) in fixes else w for w in words]
        if division := next((x for x in mine if x["kind"] == "hyphen"), None):
            if words:
                whole = words[-1].rstrip(DIVIDERS) + (division["put"] or "")
                words[-1] = _cased(whole, fixes.get(_token(whole), whole)) if _token(whole) in fixes else whole
                join = division["put"] or None
        if words:
            dash = paragraphs[-1][-1:] == "-" and paragraphs[-1][-2:-1].isalpha()
            paragraphs[-1] += ("" if dash or not paragraphs[-1] else " ") + " ".join(words)
    return "\n\n".join(p for p in paragraphs if p)


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def repaired(pages: DataFrame, files: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(page_id, text): each scanned page once, as continuous paragraphs parted by blank lines.

    The rest of a word that the next page begins with is added to the page where the word begins.
    """
    found = _needs(pages, files, lexicon).groupBy("page_id").agg(F.collect_list(F.struct("line_no", "kind", "seen", "put")).alias("needs"))
    p = scanned(pages).select("page_id", "text").dropDuplicates(["page_id"]).join(found, "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [_mended(t, n or []) for t, n in zip(b.column("text").to_pylist(), b.column("needs").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(new, pa.string())], ["page_id", "text"])

    return p.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string")
