"""Repair of text from scanned pages: running lines, hyphenated line ends, misread characters.

Three passes over the pages, none of which shuffles text: (1) word counts of the corpus, of which only words above a
relative frequency are kept, so that the vocabulary has a size bound whatever the corpus; (2) for each form of line at a
page edge (names and numbers masked, misread words righted) the part of a monograph's pages that carry it: high for
headers and footers, low for headings; (3) the repair, in blocks of consecutive pages with a halo of neighbours, so that
no task holds more pages than that, however long a monograph is.

Within a block, edge lines of a running form or that fuzzily repeat over the monograph, and page numbers, are taken out.
Words broken at line ends are joined with the next line of content by the vocabulary: the corpus' and that of the
monograph, whose names no other page knows. An unknown word is misread if undoing a few known confusions of characters
gives a known one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.functions.arrow import Memo
from rxloom.session import cut

#: What is read, and what may have been printed.
CONFUSIONS = [
    ("c", "e"), ("+", "t"), ("á", "a"), ("l", "i"), ("ri", "n"), ("f", "t"), ("f", "r"), ("1", "i"), ("1", "l"), ("0", "o"), ("5", "s"), ("|", "l"), ("|", "i"), ("cl", "d"), ("e", "c"),
    ("rn", "m"), ("b", "h"), ("9", "g"), ("ii", "u"), ("6", "b"), ("8", "b"), ("vv", "w"), ("m", "in"), ("h", "li"), ("d", "cl"), ("m", "rn"), ("m", "ni"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
]
#: Signs that end a line within a word: hyphens, the soft hyphen and what it is misread as.
HYPHENS = "-‐‑­¬"
OUTSIDE = ".,;:()[]{}\"“”'‘’!?«»®™©*…"
#: A word of at least this part of all words is in the vocabulary: no more than 200,000 can be.
FREQUENCY = 1 / 200_000
#: A word this many times rarer than one that it may be a misreading of isn't taken for a word of its own.
RARER = 12
EDGE, BLOCK, HALO = 4, 256, 16
#: Of the pages of the monographs with a form of line, at least this part carries it if it runs.
COVERAGE, FORM_MONOGRAPHS = 0.5, 3
FUZZY = 0.82
PAGE_NUMBER = re.compile(r"^[\W_]*(?:page\s*)?(\d{1,4})(?:\s*(?:/|of|de|sur)\s*\d{1,4})?[\W_]*$", re.I)
NUMBERLIKE = re.compile(r"^[\W\d_]*$|^\d[\d.,]*(?:%|mg|mcg|g|ml|µg|iu|kg)?$")
MONTHS = frozenset("january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split())
DIGIT_MISREADS = str.maketrans("OoIl|SsB", "00111558")
DEFECTS = "page_id long, line_no int, defect string, word string"
PARAGRAPHS = "monograph_id long, page_id long, line_no int, text string"


def bare(token: str) -> str:
    return token.strip(OUTSIDE).lower()


#: Few tokens make up most of a text.
BARE = Memo(bare, 200_000)


def words_of(line: str) -> list[str]:
    return [w for w in map(BARE.__getitem__, line.split()) if w]


def undo(word: str, known, most: int = 3, budget: int = 4000) -> tuple[str, int] | None:
    """(right word, confusions undone): the best-known word that undoing the fewest confusions gives."""
    level, seen = {word}, {word}
    for depth in range(1, most + 1):
        following: set[str] = set()
        for w in level:
            for wrong, right in CONFUSIONS:
                i = w.find(wrong)
                while i >= 0:
                    following.add(w[:i] + right + w[i + len(wrong) :])
                    i = w.find(wrong, i + 1)
            if len(following) > budget:
                break
        following -= seen
        hits = [(known(x), x) for x in following]
        score, best = max(hits, default=(0, ""))
        if score > 0:
            return best, depth
        if depth >= 2 and len(word) < 7 or len(following) > budget:
            return None
        seen |= following
        level = following
    return None


class Vocabulary:
    """Counts of the corpus' frequent words, misreadings taken out."""

    def __init__(self, counts: dict[str, int], spread: frozenset[str] = frozenset()):
        self.counts, self.spread = counts, spread
        self.fix = Memo(lambda w: undo(w, self.known), 100_000)

    def __reduce__(self):
        return Vocabulary, (self.counts, self.spread)

    @classmethod
    def of(cls, counts: dict[str, int]) -> Vocabulary:
        most = max(counts.values(), default=0)

        def misread(w: str, n: int) -> bool:
            if n * RARER > most or not any(wrong in w for wrong, _ in CONFUSIONS):
                return False
            got = undo(w, lambda x: counts.get(x, 0) if counts.get(x, 0) >= RARER * n else 0, most=2, budget=400)
            return got is not None

        kept = {w: n for w, n in counts.items() if not NUMBERLIKE.match(w)}
        return cls({w: n for w, n in kept.items() if not misread(w, n)})

    def known(self, w: str) -> int:
        n = self.counts.get(w, 0)
        if n or "-" not in w.strip("-"):
            return n
        parts = [p for p in w.split("-") if p]
        return 1 if len(parts) > 1 and all(len(p) > 1 and p in self.counts for p in parts) else 0

    def right(self, w: str) -> str:
        if w in self.counts or NUMBERLIKE.match(w):
            return w
        got = self.fix[w]
        return got[0] if got else w

    def form(self, line: str) -> str:
        """A line with numbers and unknown words masked."""
        out = []
        for token in line.split():
            w = BARE[token]
            if not w:
                continue
            if any(c.isdigit() for c in w) and NUMBERLIKE.match(w):
                out.append("9")
                continue
            w = self.right(w)
            out.append("month" if w in MONTHS else w if self.common(w) else "9" if w.isdigit() else "x")
        return " ".join(out)

    def common(self, w: str) -> bool:
        return w in self.spread



def page_number(line: str) -> int | None:
    m = PAGE_NUMBER.match(line.strip())
    if not m and len(line.strip()) <= 12:
        t = line.strip()
        if sum(c.isdigit() for c in t):
            m = PAGE_NUMBER.match(t.translate(DIGIT_MISREADS))
    return int(m.group(1)) if m else None


def misread(n: int, right: int) -> bool:
    """One digit of the number is another than that of the right one."""
    a, b = str(n), str(right)
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def edges(lines: list[str]) -> list[int]:
    full = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({*full[:EDGE], *full[-EDGE:]})


#: A word that a line's end breaks; it doesn't count.
BROKEN = re.compile(rf"\S*[{re.escape(HYPHENS)}][^\S\n]*(?=\n|$)")
#: Monographs that a word must be in to be common.
SEVERAL = 5


def counted(pages: DataFrame) -> tuple[dict[str, int], set[str]]:
    """Frequent words with their counts, and those of them that several monographs use.

    Of each word a batch gives the SEVERAL least monographs; the least of all are among them, so whether a word has as many
    doesn't depend on batches.
    """
    schema = pa.schema([("word", pa.string()), ("monograph_id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            of: dict[str, list[int]] = {}
            for g, t in zip(b.column("monograph_id").to_pylist(), b.column("text").to_pylist()):
                words = list(filter(None, map(BARE.__getitem__, BROKEN.sub(" ", t).split())))
                c.update(words)
                for w in set(words):
                    some = of.get(w)
                    if some is None:
                        of[w] = [g]
                    elif g not in some and (len(some) < SEVERAL or g < some[-1]):
                        of[w] = sorted([*some, g])[:SEVERAL]
            rows = [(w, g, c[w] if k == 0 else 0) for w, some in of.items() for k, g in enumerate(some)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    found = pages.select("monograph_id", "text").mapInArrow(run, "word string, monograph_id long, n long")
    table = cut(found.groupBy("word", "monograph_id").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs")))
    total = table.agg(F.sum("n")).first()[0] or 0
    # at most 1 / FREQUENCY words
    rows = table.where(F.col("n") >= max(3, total * FREQUENCY)).collect()
    return {r[0]: r[1] for r in rows}, {r[0] for r in rows if r[2] >= SEVERAL}


def vocabulary_of(pages: DataFrame) -> Vocabulary:
    counts, spread = counted(pages)
    v = Vocabulary.of(counts)
    v.spread = frozenset(w for w in spread if w in v.counts)
    return v


def running_forms(pages: DataFrame, vocabulary) -> tuple[set[str], set[str]]:
    """Forms of edge lines that run through the monographs that have them, and those that several have but don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        for b in batches:
            out: dict[str, list] = {"monograph_id": [], "page": [], "form": []}
            for g, p, t in zip(b.column("monograph_id").to_pylist(), b.column("page").to_pylist(), b.column("text").to_pylist()):
                lines = t.split("\n")
                for i in edges(lines):
                    if len(lines[i].split()) <= 12 and page_number(lines[i]) is None and (f := v.form(lines[i])):
                        for k, x in zip(out, (g, p, f)):
                            out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("monograph_id", pa.int64()), ("page", pa.int32()), ("form", pa.string())]))

    base = pages.select("monograph_id", F.col("page").cast("int").alias("page"), "text")
    found = base.mapInArrow(run, "monograph_id long, page int, form string").distinct().groupBy("monograph_id", "form").agg(F.count("*").alias("k"))
    sizes = base.groupBy("monograph_id").agg(F.count_distinct("page").alias("n")).where("n >= 2")
    forms = found.join(sizes, "monograph_id").groupBy("form").agg(F.count("*").alias("monographs"), (F.sum("k") / F.sum("n")).alias("coverage"), F.sum("k").alias("pages"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # each page has 2 * EDGE forms at most, so no more than 2 * EDGE * 5,000 forms reach a 5,000th of the pages
    rows = forms.where((F.col("monographs") >= FORM_MONOGRAPHS) & (F.col("pages") >= total / 5000)).select("form", "coverage").collect()
    return {r.form for r in rows if r.coverage >= COVERAGE}, {r.form for r in rows if r.coverage < COVERAGE}


class Monograph:
    """Repair of the pages of one monograph that a block holds, in order of page_id."""

    def __init__(self, ids: list[int], numbers: list[int | None], texts: list[str | None], v: Vocabulary, running: set[str], content: set[str]):
        self.ids, self.v = ids, v
        self.lines = [(t or "").split("\n") for t in texts]
        self.numbers = numbers
        # a page fed twice says nothing new
        first: dict[tuple, int] = {}
        self.twin = [first.setdefault((n, t), i) != i if t else False for i, (n, t) in enumerate(zip(numbers, texts))]
        self.run = self.find_running(running, content)
        self.memo: dict[str, str | None] = {}
        self.names = self.find_names()

    def page_numbers(self, found: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
        """(page, line) of the numbers at page edges, found as (page, line, number), that count the pages.

        A sequence goes up with the pages: the distance of number and page is the same on two pages at least, or 0. A
        number with one digit misread belongs to the sequence that its page has no other number of.
        """
        place = [p if n is None else n for p, n in enumerate(self.numbers)]
        pages: dict[int, set[int]] = defaultdict(set)
        for p, _, n in found:
            pages[n - place[p]].add(place[p])
        steps = {d for d, on in pages.items() if d == 0 or len(on) >= 2}
        out = {(p, i) for p, i, n in found if n - place[p] in steps}
        seen = {p for p, _ in out}
        for p, i, n in found:
            if p not in seen and any(misread(n, place[p] + d) for d in steps):
                out.add((p, i))
        return out

    def find_running(self, running: set[str], content: set[str]) -> list[set[int]]:
        out: list[set[int]] = [set() for _ in self.lines]
        rest: list[tuple[int, int, str, str]] = []
        edge: list[tuple[int, int, int, int | None]] = []
        for p, lines in enumerate(self.lines):
            full = {i: k for k, i in enumerate(i for i, x in enumerate(lines) if x.strip())}
            edge += [(p, i, min(full[i], len(full) - 1 - full[i]), page_number(lines[i])) for i in edges(lines)]
        numbers = self.page_numbers([(p, i, n) for p, i, rank, n in edge if n is not None and rank < 3])
        for p, i, rank, n in edge:
            line = self.lines[p][i]
            if n is not None and rank < 3:
                if (p, i) in numbers:
                    out[p].add(i)
                continue
            if len(line.split()) > 12:
                continue
            form = self.v.form(line)
            if form in running and rank < 3:
                out[p].add(i)
            elif form not in content and rank < 3:
                rest.append((p, i, " ".join(re.sub(r"\d+", "9", line).lower().split()), form))
        pages = len({n for n, t in zip(self.numbers, self.twin) if not t}) or 1
        bags = [frozenset(line.split()) for _, _, line, _ in rest]
        for (p, i, line, form), bag in zip(rest, bags):
            alike = [(q, other, f) for (q, _, other, f), b in zip(rest, bags) if q != p and (f == form or 2 * len(bag & b) >= max(len(bag), len(b)))]
            if len(alike) < 2:
                continue
            same = {self.numbers[q] for q, other, f in alike if f == form or SequenceMatcher(None, line, other, autojunk=False).ratio() >= FUZZY} | {self.numbers[p]}
            if len(same) >= 3 and len(same) * 2 >= pages and not line.startswith("•"):
                out[p].add(i)
        # what resembles a line found above is one that was misread
        found = {" ".join(re.sub(r"\d+", "9", self.lines[p][i]).lower().split()) for p, at in enumerate(out) for i in at if page_number(self.lines[p][i]) is None}
        for p, i, line, _ in rest:
            if i not in out[p] and any(abs(len(f) - len(line)) <= 4 and SequenceMatcher(None, line, f, autojunk=False).ratio() >= 0.85 for f in found):
                out[p].add(i)
        return out

    def find_names(self) -> dict[str, int]:
        c: Counter = Counter()
        for p, lines in enumerate(self.lines):
            if self.twin[p]:
                continue
            for line in lines:
                words = words_of(line)
                if words and line.rstrip()[-1:] in HYPHENS:
                    words.pop()
                c.update(w for w in words if w not in self.v.counts and not NUMBERLIKE.match(w))
        self.count = c
        names: dict[str, int] = {}
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])):
            if n < 2:
                break
            got = undo(w, lambda x: names.get(x, 0) if names.get(x, 0) >= 2 * n else 0, most=2, budget=400) if names else None
            if got is None and (n >= 3 or self.v.fix[w] is None):
                names[w] = n
        return names

    def known(self, w: str) -> int:
        return self.names.get(w, 0) * 1000 or self.v.known(w)

    def right(self, w: str) -> str | None:
        """The right word of a misread one; None if it is right or can't be told."""
        if w in self.v.counts:
            return None
        if w not in self.memo:
            self.memo[w] = self.righted(w)
        return self.memo[w]

    def righted(self, w: str) -> str | None:
        if w in self.v.counts or w in self.names or NUMBERLIKE.match(w) or not w:
            return None
        if self.v.known(w) or self.compound(w):
            return None
        a = undo(w, lambda x: self.names.get(x, 0), most=2, budget=800) if self.names and len(w) >= 5 else None
        b = self.v.fix[w]
        got = min((x for x in (a, b) if x), key=lambda x: x[1], default=None)
        if got is None and "-" in w.strip("-"):
            parts = [p if self.known(p) or NUMBERLIKE.match(p) else (self.right(p) or "") for p in w.split("-")]
            if all(parts):
                return "-".join(parts)
        return got[0] if got else None

    def compound(self, w: str) -> bool:
        parts = w.split("-")
        return len(parts) > 1 and all(p and (self.known(p) or NUMBERLIKE.match(p)) for p in parts)

    def broken(self, line: str) -> str | None:
        """The part of a word at the end of a line that ends within it."""
        s = line.rstrip()
        if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalnum() and s[-2] not in "|+":
            return None
        w = s.split()[-1].rstrip(HYPHENS).lstrip(OUTSIDE).lower()
        return w or None

    def following(self, p: int, i: int) -> tuple[int, int] | None:
        """Page and line of the next line of content."""
        for q in range(p, len(self.lines)):
            if q > p and (self.twin[q] or self.numbers[q] == self.numbers[p]):
                continue
            for j in range(i + 1 if q == p else 0, len(self.lines[q])):
                if self.lines[q][j].strip() and j not in self.run[q]:
                    return q, j
        return None

    def joined(self, w: str, rest: str) -> tuple[str, bool] | None:
        """(whole word, whether it was misread); None if the two are no word together."""
        plain, own = w + rest, f"{w}-{rest}"
        a, b = self.known(plain), self.known(own)
        if a or b:
            return (plain if a >= b else own), False
        for x in (plain, own):
            if r := self.right(x):
                return r, True
        if rest in ("and", "or", "to", "et", "ou"):
            return None
        compound = self.known(w) and self.known(rest) and len(w) > 2 and len(rest) > 2
        return (own if compound else plain), False

    def defects(self) -> Iterator[tuple[int, int, str, str]]:
        taken: set[tuple[int, int]] = set()  # lines whose first word ends a word of the line before
        breaks: dict[tuple[int, int], tuple[str, tuple[int, int], str]] = {}
        for p, lines in enumerate(self.lines):
            for i, line in enumerate(lines):
                if i in self.run[p] or not (w := self.broken(line)):
                    continue
                at = self.following(p, i)
                if at is None:
                    continue
                token = self.lines[at[0]][at[1]].split()[0]
                rest = bare(token)
                # a possessive or a closing sign ends the word
                if not rest or not (rest[0].isalnum() or rest[0] in "|+"):
                    continue
                got = self.joined(w, rest.rstrip(HYPHENS) if len(self.lines[at[0]][at[1]].split()) == 1 else rest)
                if got is None:
                    continue
                whole, misread = got
                breaks[p, i] = (whole, at, w)
                taken.add(at)
                yield self.ids[p], i + 1, "hyphen_break", whole
                if misread:
                    flat = whole.replace("-", "")
                    where = at if flat.startswith(w.replace("-", "")) else (p, i)
                    yield self.ids[where[0]], where[1] + 1, "char_error", whole
        # a twin's first line is taken like that of the page it repeats
        same = {}
        for p in range(len(self.lines)):
            if not self.twin[p]:
                same[self.numbers[p]] = p
        for p, lines in enumerate(self.lines):
            q = same.get(self.numbers[p], p) if self.twin[p] else p
            for i, line in enumerate(lines):
                if i in self.run[p]:  # it goes as a whole, whatever was misread in it
                    yield self.ids[p], i + 1, "running_line", ""
                    continue
                tokens = line.split()
                if (p, i) in breaks:
                    tokens = tokens[:-1]
                if (q, i) in taken:
                    tokens = tokens[1:]
                for w in map(BARE.__getitem__, tokens):
                    if w not in self.v.counts and (r := self.right(w)) is not None:
                        yield self.ids[p], i + 1, "char_error", r
        self.breaks = breaks

    def paragraphs(self) -> Iterator[tuple[int, int, str]]:
        """(page_id, line_no of its first line, text), misread words righted."""
        list(self.defects())
        out: list[tuple[int, int, list[str]]] = []
        fresh, carried = True, False
        for p, lines in enumerate(self.lines):
            if self.twin[p]:
                continue
            begun = False
            for i, line in enumerate(lines):
                if i in self.run[p]:
                    continue
                if not line.strip():
                    if begun and not carried:
                        fresh = True
                    continue
                tokens = line.split()
                heading = bool(re.match(r"^\s*\d{1,2}\s+[A-Z][A-Z ,]+$", line)) or (len(tokens) <= 5 and line.strip().isupper())
                row = len(re.findall(r"\S {2,}\S", line)) >= 2
                item = tokens[0] in ("•", "-", "–", "*")
                if not begun and out and not fresh and not carried:  # a page break within a paragraph?
                    last = out[-1][2][-1] if out[-1][2] else ""
                    fresh = last[-1:] in ".!?:" and not tokens[0][:1].islower()
                begun = True
                if carried:
                    tokens = tokens[1:]
                elif fresh or heading or item or row or not out:
                    out.append((self.ids[p], i + 1, []))
                text = [self.mended(t) for t in tokens]
                if (p, i) in self.breaks:
                    head = tokens[-1][: len(tokens[-1]) - len(tokens[-1].lstrip(OUTSIDE))]
                    nxt = self.breaks[p, i][1]
                    after = self.lines[nxt[0]][nxt[1]].split()[0]
                    text[-1:] = [head + cased(self.breaks[p, i][0], tokens[-1]) + after[len(after.rstrip(OUTSIDE)) :]]
                out[-1][2].extend(text)
                carried = (p, i) in self.breaks
                fresh = (heading or row) and not carried
        for page, line, words in out:
            if words:
                yield page, line, " ".join(words)

    def mended(self, token: str) -> str:
        w = BARE[token]
        r = self.right(w)
        if r is None:
            return token
        core = token.strip(OUTSIDE)
        at = token.find(core)
        return token[:at] + cased(r, core) + token[at + len(core) :]


def cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and letters[0].isupper() else word


def repair(pages: DataFrame, paragraphs: bool = False) -> DataFrame:
    """Defects (page_id, line_no, defect, word) of all pages, or the paragraphs of each monograph.

    pages: page_id unique, monograph_id, page, text; a monograph's pages have neighbouring ids. Null and empty pages
    have no defects; a running line has no other defect; a page fed twice has its defects twice and its paragraphs once. Pages without monograph_id are read
    as one monograph; a page without page_id can't be named and is left out. Extra columns are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("monograph_id").cast("long"), F.lit(-1)).alias("monograph_id"), F.col("page").cast("int").alias("page"), "text").where("page_id IS NOT NULL")
    full = base.where("trim(text) <> ''").select("monograph_id", "page", "text")
    vocabulary = spark.sparkContext.broadcast(vocabulary_of(full))
    forms = spark.sparkContext.broadcast(running_forms(full, vocabulary))
    own = F.floor(F.col("page_id") / BLOCK)
    around = F.array_distinct(F.array(own, F.floor((F.col("page_id") - HALO) / BLOCK), F.floor((F.col("page_id") + HALO) / BLOCK)))
    blocks = base.withColumn("own", own).withColumn("block", F.explode(around))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, (running, content) = vocabulary.value, forms.value
        block = int(pdf["block"].iloc[0])
        out = []
        for g, part in pdf.sort_values("page_id").groupby("monograph_id", sort=False):
            mine = set(part.loc[part["own"] == block, "page_id"])
            if not mine:
                continue
            texts = [None if t is None or (isinstance(t, float)) else t for t in part["text"]]
            m = Monograph(part["page_id"].tolist(), [None if pd.isna(x) else int(x) for x in part["page"]], texts, v, running, content)
            if paragraphs:
                out += [(g, *x) for x in m.paragraphs() if x[0] in mine]
            else:
                out += [x for x in dict.fromkeys(m.defects()) if x[0] in mine]
        return pd.DataFrame(out, columns=[f.split()[0] for f in (PARAGRAPHS if paragraphs else DEFECTS).split(", ")])

    return blocks.groupBy("block").applyInPandas(run, PARAGRAPHS if paragraphs else DEFECTS)
