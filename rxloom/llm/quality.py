"""Per-document text statistics and rule outcomes.

Documents longer than CHUNK characters are split into chunks; a chunk gives associative partial counts and, for the
line and the word that its ends cut, a boundary state. States of a document are merged in chunk order by a tree of
grouped merges (FAN chunks at a time), which joins cut words and cut lines exactly: the result is that of the whole
text at any chunk size. Ratios and rule outcomes are derived at the end. Documents of a single chunk need no shuffle.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from hashlib import blake2b
from heapq import nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.functions.arrow import Memo, arrow_schema
from rxloom.session import cut

CHUNK, FAN = 16_384, 64
STATS = (
    "doc_id long, n_chars long, n_lines long, word_count long, mean_word_length double, symbol_ratio double, digit_ratio double, "
    "upper_ratio double, odd_ratio double, vowel_ratio double, punctuated_line_share double, bullet_line_share double, common_word_share double, "
    "distinct_words double, sentence_rate double, prose_share double, list_share double, table_share double, junk_share double, kind string, rules string"
)
#: Frequent function words of the two languages.
COMMON = frozenset(
    """the of and to in a is that for it was on with as be by are this at from or an not were which but have has had been their its if may should
    than other into about after before between when during more most who each no do does all any also only over under within because such these those they them
    your you will can must until while both out so there then what how why whether against
    le la les de des du un une et en est que qui pour dans par sur au aux avec ne pas plus ce cette ces son sa ses ou où il elle ils elles se sont été être avoir
    a ont avait si mais comme sans sous entre vous votre vos nous leur leurs dont lors selon chez peut doit chaque tout tous toute toutes aussi depuis afin""".split()
)
#: What page navigation says.
NAVIGATION = frozenset("home products share help contact privacy terms print search log in back to top a z français francais english accueil produits aide imprimer recherche menu login next previous sitemap".split())
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NUMBER = re.compile(r"\d+")
MARK = re.compile(r"^\s*(?:[•▪◦·‣*–—-]\s|[•▪◦·‣]|\[[ xX]?\]\s|\(?(?:\d{1,3}|[A-Za-z])[.)]\s)")
LEADER = re.compile(r"(?:\.\s?){3,}\s*\d*\s*$")
KEY_VALUE = re.compile(r"^[^\W\d_][^\d:|]{1,30}?\s*(?::|\.\.)\s*[\d/.,]+(?:\s*[^\W\d_]{1,8})?$")
GAP = re.compile(r"\S(?: {2,}|\t)")
CAPTION = re.compile(r"^(?:table|tableau)\s+\d+\b", re.I)
CODE_FIELD = re.compile(r"^\d{8}\s*[,;]|^[^\s,;]+(?:[,;][^\s,;]+){2,}$|^(?:[^;.]{1,24}; ?){2,}[^;.]{1,24}$")
SENTENCE_END = re.compile(r"[.!?…][\"')\]»]*(?=\s|$)")

_PLAIN = set(".,;:!?'\"()-%/’‘“”«»–—…•[]&+°µ")
_VOWELS = set("aeiouyAEIOUYàâäéèêëîïôöùûüœæÀÂÄÉÈÊËÎÏÔÖÙÛÜŒÆ")


class _Classes(dict):
    """Class letter of each code point, found as needed: s blank, l lower, v lower vowel, u upper, w upper vowel, d digit, p plain, y symbol, o odd."""

    def __missing__(self, i: int) -> str:
        c = chr(i)
        if c.isspace() or i in (0x200B, 0xFEFF):
            k = "s"
        elif c in _READ:
            k = "l"
        elif c.isdigit():
            k = "d"
        elif c in _PLAIN:
            k = "p"
        elif c.isalpha() and i < 0x10000:
            k = ("w" if c in _VOWELS else "u") if c.isupper() else ("v" if c in _VOWELS else "l")
        else:
            k = "y" if i < 0x80 else "o"
        self[i] = k
        return k


#: What accented letters of UTF-8 that was read as a one-byte encoding look like; they are still read.
_READ = set("Ã©¨ª´®¹")
CLASSES = _Classes()
CHARS = ("space", "lower", "upper", "digit", "plain", "symbol", "odd", "vowel")
N_CHAR = len(CHARS)
#: What a piece of a line counts besides characters.
COUNTS = ("words", "word_chars", "common", "navigation", "numbers", "pipes", "tabs", "gaps", "commas", "semicolons", "ends")
N = N_CHAR + len(COUNTS)
KEEP, START = 512, 128
ZERO = (0,) * N


class Piece:
    """A part of one line.

    Short ones are kept as text. Of a long one, what lies between its first and its last tokens is counted; head and
    tail are the texts outside, which a neighbour may go on with, and start is how the piece begins.
    """

    __slots__ = ("hashes", "head", "n", "start", "tail", "text")

    def __init__(self, text: str | None, n: np.ndarray | None = None, head: str = "", tail: str = "", hashes: frozenset[int] = frozenset(), start: str = ""):
        self.text, self.n, self.head, self.tail, self.hashes, self.start = text, n, head, tail, hashes, start


def char_counts(s: str) -> tuple[int, ...]:
    n = s.translate(CLASSES).count
    lower_vowel, upper_vowel = n("v"), n("w")
    return n("s"), n("l") + lower_vowel, n("u") + upper_vowel, n("d"), n("p"), n("y"), n("o"), lower_vowel + upper_vowel


def stretch_counts(s: str) -> tuple[tuple[int, ...], frozenset[int]]:
    """(counts, hashes of the words) of a stretch that cuts no token."""
    if not s:
        return ZERO, frozenset()
    chars = common = navigation = 0
    seen = set()
    words = WORD.findall(s)
    for w in words:
        chars += len(w)
        w = w.lower()
        common += w in COMMON
        navigation += w in NAVIGATION
        seen.add(HASH[w])
    numbers = NUMBER.findall(s)
    for w in numbers:
        seen.add(HASH[w])
    n = s.count
    gaps = len(GAP.findall(s)) if "  " in s or "\t" in s else 0
    return (*char_counts(s), len(words), chars, common, navigation, len(numbers), n("|"), n("\t"), gaps, n(","), n(";"), len(SENTENCE_END.findall(s))), frozenset(seen)


def add_counts(s: str, n: np.ndarray) -> frozenset[int]:
    """Adds the counts of a stretch that cuts no token; gives the hashes of its words."""
    counts, hashes = stretch_counts(s)
    n += counts
    return hashes


FIRST_TOKEN, LAST_TOKEN = re.compile(r"\s*\S*\s+"), re.compile(r"\S+\s*$")
FIRST_RUN, LAST_RUN = re.compile(r"[\w'’]*[^\w'’\s]"), re.compile(r"(?<=[^\w'’\s])[\w'’]*$")


def close(p: Piece) -> Piece:
    """A piece of up to KEEP characters as it is; a longer one counted but for its first and last tokens.

    An endless token is cut where no word and no number goes on; one that is a single word stays text.
    """
    s = p.text
    if s is None or len(s) <= KEEP:
        return p
    m = FIRST_TOKEN.match(s)
    if not m or m.end() > KEEP // 2:
        m = FIRST_RUN.match(s) or m
    a = m.end() if m else len(s)
    low = max(a, len(s) - KEEP // 2)
    t = LAST_TOKEN.search(s, low)
    z = t.start() if t else len(s)
    if z == low:
        t = LAST_RUN.search(s, a)
        z = t.start() if t else a
    if z <= a:
        return p
    n = np.zeros(N, np.int64)
    hashes = add_counts(s[a:z], n)
    return Piece(None, n, s[:a], s[z:], hashes, s[:START])


def join(a: Piece, b: Piece) -> Piece:
    """The two pieces as one; associative."""
    if a.text is not None and b.text is not None:
        return close(Piece(a.text + b.text))
    if a.text is not None:
        c, n, hashes = close(Piece(a.text + b.head)), b.n.copy(), b.hashes
        start = (a.text + b.start)[:START]
        if c.text is not None:
            return Piece(None, n, c.text, b.tail, hashes, start)
        n += c.n
        hashes |= c.hashes | add_counts(c.tail, n)
        return Piece(None, n, c.head, b.tail, least(hashes), start)
    if b.text is not None:
        c, n, hashes = close(Piece(a.tail + b.text)), a.n.copy(), a.hashes
        if c.text is not None:
            return Piece(None, n, a.head, c.text, hashes, a.start)
        n += c.n
        hashes |= c.hashes | add_counts(c.head, n)
        return Piece(None, n, a.head, c.tail, least(hashes), a.start)
    n = a.n + b.n
    hashes = a.hashes | b.hashes | add_counts(a.tail + b.head, n)
    return Piece(None, n, a.head, b.tail, least(hashes), a.start)


def counted(p: Piece) -> tuple[tuple[int, ...], str, str, frozenset[int]]:
    """(counts, first characters, last characters, hashes) of a whole line."""
    if p.text is not None:
        n, hashes = stretch_counts(p.text)
        return n, p.text[:START], p.text[-START:], hashes
    n = p.n.copy()
    hashes = p.hashes | add_counts(p.head, n) | add_counts(p.tail, n)
    return tuple(n.tolist()), p.start, p.tail[-START:], hashes


#: Of the 64-bit hashes of the words the DISTINCT least are kept: the number of different words is exact below DISTINCT, and
#: beyond estimated with a standard error of 1.6 %. What is kept doesn't depend on chunks.
DISTINCT = 4096
HASH = Memo(lambda w: int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()), 100_000)


def least(hashes: frozenset[int]) -> frozenset[int]:
    return hashes if len(hashes) <= DISTINCT else frozenset(nsmallest(DISTINCT, hashes))


def number_of(hashes: frozenset[int]) -> float:
    return float(len(hashes) if len(hashes) < DISTINCT else (DISTINCT - 1) * 2.0**64 / max(hashes))

#: Counts of a document over its whole lines.
LINES = ("lines", "punctuated", "bullets", "prose", "list", "table", "junk", "prose_words")


def line_kind(n: tuple[int, ...], first: str, last: str) -> str:
    """prose, list (items), table (rows of fields) or junk; the first rule that holds decides."""
    space, lower, upper, digit, plain, symbol, odd, vowel, words, _, common, navigation, numbers, pipes, tabs, gaps, commas, semicolons, ends = n
    letters, solid = lower + upper, lower + upper + digit + plain + symbol + odd
    marks, marked = commas + semicolons, bool(MARK.match(first))
    s = first.strip() if space + solid <= START else ""
    leader = bool(LEADER.search(last.rstrip())) or "....." in first
    symbols = symbol - pipes
    if s and (CAPTION.match(s) or KEY_VALUE.match(s)):
        return "table"
    if odd > 0.07 * solid or symbols > 0.15 * solid + 2 or (symbols >= 3 and symbols > 0.1 * solid):
        return "junk"
    if solid >= 6 and not space and "=" in first:
        return "junk"
    if words >= 2 and navigation >= 0.7 * words and numbers == 0 and common < 0.6 * words:
        return "junk"
    listed = (marks * 5 >= words and common < 0.2 * words) or (semicolons * 8 >= words and not ends) or first.count("•") >= 3
    if (words >= 7 or (words >= 3 and ends)) and common >= 0.13 * words and not tabs and pipes < 2 and not leader and not (marked and words < 8) and not listed:
        return "prose"
    if pipes >= 2 or tabs or (gaps - (1 if marked or leader else 0) >= (1 if numbers else 2) and not leader):
        return "table"
    if s and CODE_FIELD.match(s) and not marked:
        return "table" if (digit and not s.upper().startswith("DIN 0")) or " " not in s.replace("; ", ";") else "list"
    if marked or leader:
        return "list"
    if letters > 12 and vowel < 0.2 * letters:
        return "junk"
    if solid > 24 and space * 24 < solid:
        return "junk"
    if solid >= 16 and not letters and numbers >= 3:
        return "junk"
    if words >= 12 and marks * 6 < words and ends:
        return "prose"
    return "list"


ENDINGS = frozenset(".!?…:;»\"'”")


class Doc:
    """Counts of whole lines, and the pieces of the lines that the ends of the text so far may cut."""

    __slots__ = ("hashes", "first", "last", "lines", "n")

    def __init__(self) -> None:
        self.n, self.lines, self.hashes = list(ZERO), [0] * len(LINES), set()
        self.first: Piece | None = None  # up to the first line end; None until a line end is seen
        self.last = Piece("")

    def line(self, p: Piece) -> None:
        n, first, last, hashes = counted(p)
        self.n = [a + b for a, b in zip(self.n, n)]
        self.hashes |= hashes
        if len(self.hashes) > 4 * DISTINCT:
            self.hashes = set(least(self.hashes))
        solid = sum(n[1:7])
        if not solid:
            return
        kind, lines = line_kind(n, first, last), self.lines
        lines[0] += 1
        lines[1] += last.rstrip()[-1:] in ENDINGS
        lines[2] += bool(MARK.match(first))
        lines[LINES.index(kind)] += solid
        if kind == "prose":
            lines[7] += n[N_CHAR]


def chunk_state(text: str) -> Doc:
    d = Doc()
    parts = text.split("\n")
    if len(parts) == 1:
        d.last = close(Piece(text))
        return d
    d.first, d.last = close(Piece(parts[0])), close(Piece(parts[-1]))
    for x in parts[1:-1]:
        d.line(Piece(x))
    return d


def merge(a: Doc, b: Doc) -> Doc:
    out = Doc()
    out.n, out.lines, out.hashes = [x + y for x, y in zip(a.n, b.n)], [x + y for x, y in zip(a.lines, b.lines)], set(least(a.hashes | b.hashes))
    if b.first is None:
        out.first, out.last = a.first, join(a.last, b.last)
        return out
    middle = join(a.last, b.first)
    out.last = b.last
    if a.first is None:
        out.first = middle
    else:
        out.first = a.first
        out.line(middle)
    return out


def finish(d: Doc) -> tuple:
    if d.first is not None:
        d.line(d.first)
    d.line(d.last)
    g = {k: int(v) for k, v in zip((*CHARS, *COUNTS), d.n)}
    li = {k: int(v) for k, v in zip(LINES, d.lines)}
    chars = sum(g[k] for k in CHARS[:7])
    solid = max(1, chars - g["space"])
    letters, words = g["lower"] + g["upper"], g["words"]
    distinct = number_of(least(d.hashes))
    mass = max(1, li["prose"] + li["list"] + li["table"] + li["junk"])
    share = {k: li[k] / mass for k in ("prose", "list", "table", "junk")}
    rate = g["ends"] / max(1, words)
    rules = []
    if chars == g["space"]:
        rules.append("blank")
    tokens = words + g["numbers"]
    if (tokens >= 12 and distinct <= 7.5 and distinct * 4 < tokens) or (tokens >= 6 and distinct < 2.5):
        rules.append("filler")
    if words >= 6 and g["navigation"] >= 0.75 * words and tokens - words <= 0.1 * tokens:
        rules.append("navigation")
    if letters > 30 and g["vowel"] < 0.2 * letters and share["table"] < 0.5:
        rules.append("no_vowels")
    if g["odd"] > 0.06 * solid:
        rules.append("odd_characters")
    if li["prose_words"] >= 25 and rate < 0.012 and share["prose"] > 0.4:
        rules.append("scrambled")
    if solid > 40 and words and g["word_chars"] > 18 * words:
        rules.append("endless_words")
    if rules:
        kind = "junk"
    elif share["prose"] >= 0.5:
        kind = "prose"
    else:
        kind = max(("list", "table", "junk"), key=lambda k: share[k])
    return (
        chars, li["lines"], words, g["word_chars"] / max(1, words), (g["symbol"] + g["odd"]) / solid, g["digit"] / solid, g["upper"] / max(1, letters), g["odd"] / solid,
        g["vowel"] / max(1, letters), li["punctuated"] / max(1, li["lines"]), li["bullets"] / max(1, li["lines"]), g["common"] / max(1, words), distinct, rate,
        share["prose"], share["list"], share["table"], share["junk"], kind, ",".join(rules),
    )


def text_statistics(text: str, chunk: int = CHUNK) -> tuple:
    """All statistics of one text, by chunks."""
    d = chunk_state(text[:chunk])
    for i in range(chunk, len(text), chunk):
        d = merge(d, chunk_state(text[i : i + chunk]))
    return finish(d)


def document_statistics(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document (doc_id, text) with its statistics and kind.

    A null text or doc_id has no row; an empty or blank one is junk with zero counts. Repeated rows of a doc_id of one chunk give
    their rows each; of a longer one doc_id must be unique. Extra columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [f.name for f in arrow_schema(spark, STATS)]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    first_pass = arrow_schema(spark, f"{STATS}, chunk_no int, piece string")
    empty = [pa.nulls(0, f.type) for f in first_pass]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The statistics of texts of one chunk, and the chunks of the others, FAN at a time."""
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            rows = [(i, *text_statistics(t), None, None) for i, t in zip(ids, texts) if len(t) <= chunk]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), first_pass)] if rows else empty, schema=first_pass)
            for key, t in zip(ids, texts):
                for start in range(0, len(t) if len(t) > chunk else 0, FAN * chunk):
                    parts = [t[i : i + chunk] for i in range(start, min(len(t), start + FAN * chunk), chunk)]
                    cols = [pa.nulls(len(parts), f.type) for f in first_pass]
                    cols[0] = pa.array([key] * len(parts), pa.int64())
                    cols[-2:] = [pa.array(range(start // chunk, start // chunk + len(parts)), pa.int32()), pa.array(parts, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, schema=first_pass)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [pickle.dumps(to_tuple(chunk_state(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("chunk_no"), pa.array(out, pa.binary())], names=["doc_id", "chunk_no", "state"])

    def merged(pdf: pd.DataFrame) -> Doc:
        ordered = pdf.sort_values("chunk_no")["state"]
        d = None
        for s in ordered:
            x = from_tuple(pickle.loads(s))
            d = x if d is None else merge(d, x)
        return d

    def partly(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "chunk_no": [pdf["chunk_no"].min()], "state": [pickle.dumps(to_tuple(merged(pdf)))]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(pdf["doc_id"].iloc[0]), *finish(merged(pdf)))], columns=names)

    # one scan of the texts; what is kept are statistics, and the texts of long documents
    kept = cut(base.mapInArrow(read, f"{STATS}, chunk_no int, piece string"))
    short = kept.where("piece IS NULL").drop("chunk_no", "piece")
    # chunks are spread, so that those of a huge document are read by many tasks
    pieces = kept.where("piece IS NOT NULL").select("doc_id", "chunk_no", F.col("piece").alias("text")).repartition("doc_id", "chunk_no")
    state = "doc_id long, chunk_no int, state binary"
    tree = pieces.mapInArrow(states, state).groupBy("doc_id", F.floor(F.col("chunk_no") / FAN)).applyInPandas(partly, state)
    return short.unionByName(tree.groupBy("doc_id").applyInPandas(final, STATS))


def to_tuple(d: Doc) -> tuple:
    piece = lambda p: None if p is None else (p.text, p.n, p.head, p.tail, p.hashes, p.start)
    return d.n, d.lines, d.hashes, piece(d.first), piece(d.last)


def from_tuple(t: tuple) -> Doc:
    d = Doc()
    d.n, d.lines, d.hashes = t[:3]
    d.first = None if t[3] is None else Piece(*t[3])
    d.last = Piece(*t[4])
    return d
