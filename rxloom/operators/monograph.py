"""Fields read from monograph text: sections, packaging, appearance, pH. Arrow batches, one call per document.

Documents given as pages are read in blocks of PAGES page numbers, so that a long one needn't be one task: a section that
is open at a block's end goes on in the next, and the fields of the blocks are combined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxloom.functions.arrow import Memo

#: Container words in the order in which they are looked for.
CONTAINERS = [
    "prefilled syringe", "auto-injector", "stick pack", "blister pack", "ampoule", "vial", "syringe", "cartridge", "blister", "bottle", "jar", "tube", "sachet", "pouch", "carton", "bag", "canister", "inhaler", "dropper",
    "suppository", "pen", "kit",
]
#: Other spellings of containers, as patterns.
SPELT = {"prefilled syringe": "pre-?filled syringe", "auto-injector": "auto[- ]?injector", "ampoule": "ampoule|ampule|ampul", "suppository": "suppositorie|suppository"}
#: A container is hidden by one whose name has its own among its words.
WITHIN = {o: [c for c in CONTAINERS if c in o.split()] for o in CONTAINERS if " " in o}
COLORS = "white to cream|off-white|greenish blue|brick red|light pink|light red|pale red|pale yellow|white|yellow|pink|red|blue|green|orange|brown|beige|purple"
SHAPES = "capsule-shaped|round|oval|ovaloid|biconvex|hexagonal|oblong|rectangular|triangular"
FIELDS = "doc_id long, pack_style string, pack_count string, color string, shape string, size_mm string, ph string, leader_share double"
#: Page numbers a block; a section has one row for each block that it reaches into.
PAGES = 1024
MARKED = "doc string, monograph_id long, block long, piece string, page int, line int, ends boolean, text string"
LEADER = re.compile(r"(?:\.\s?){4,}\s*\d*\s*$")
SIZE = re.compile(r"(\d+(?:\.\d+)?(?:\s*x\s*\d+(?:\.\d+)?)?)\s*mm\b")
PH = re.compile(r"\bpH\s*(?:of|is|:|=)?\s*(\d+(?:\.\d+)?)(?:\s*(?:-|–|to)\s*(\d+(?:\.\d+)?))?")
COUNT = re.compile(r"\b(\d{1,4})\s*(?:-\s*)?(?:count\b|tablets?\b|capsules?\b|vials?\b|units?\b)|\b(?:bottles?|blisters?|packs?|cartons?)\s+of\s+(\d{1,4})", re.I)


def container_labels(text: str) -> list[str]:
    """Containers named in a text, longer names before the shorter ones that they hold."""
    low, out = text.lower(), []
    for c in CONTAINERS:
        if re.search(rf"\b(?:{SPELT.get(c, c)})s?\b", low) and not any(c in WITHIN.get(o, []) for o in out):
            out.append(c)
    return [c.title() for c in out]


_DOSES = r"(?:COUNT|TABLETS?|TABS?|CAPSULES?|CAPS?|UNITS?)"
_SHOWN = {"G": "g", "ML": "mL", "L": "L"}


def _measures(t: str) -> str | None:
    """Sizes of one unit with a slash between them, or a single volume that is no concentration."""
    several = re.findall(r"\b(\d+(?:\.\d+)?)\s*(G|ML|L)\b", t) if "/" in t else []
    if len(several) > 1 and len({u for _, u in several}) == 1:
        return ", ".join(f"{n} {_SHOWN[u]}" for n, u in several)
    one = re.search(r"(?<![^\s.,(-])(\d+(?:\.\d+)?)\s*(ML|L)\b(?!\s*/)", t)
    return f"{float(one[1]):g} {_SHOWN[one[2]]}" if one else None


def _slashed(t: str) -> str | None:
    m = re.search(r"\b\d+(?:/\d+)+\b", t)
    return ", ".join(m[0].split("/")) + " count" if m else None


def _contained(t: str) -> str | None:
    """Counts with the container they stand before or after, in the order of containers; the container is named if there are several."""
    found: dict[str, str] = {}
    for c in CONTAINERS:
        if any(c in WITHIN.get(o, []) for o in found):
            continue
        word = rf"(?:{SPELT.get(c, c).upper()})S?"
        if m := re.search(rf"\b(\d+)\s+{_DOSES}\s+{word}\b", t) or re.search(rf"\b{word}\s+OF\s+(\d+)\b", t):
            found[c] = m[1]
    if len(found) == 1:
        return f"{next(iter(found.values()))} count"
    return "; ".join(f"{n}-count {c}" for c, n in found.items()) or None


def _counts(t: str) -> str | None:
    found = dict.fromkeys(re.findall(rf"\b(\d+)\s+{_DOSES}\b", t) + re.findall(r"\bOF\s+(\d+)\b", t))
    return "; ".join(f"{n} count" for n in found) or None


def pack_size(text: str | None) -> str | None:
    """Size of a package from free text: measures, then slashed counts, counts of containers, bare counts."""
    t = (text or "").upper()
    return next((r for rule in (_measures, _slashed, _contained, _counts) if (r := rule(t))), None)


def section(lines: list[str], start: re.Pattern, end: re.Pattern) -> tuple[int, int] | None:
    """(first, past the last) line of the section after the first start marker that is no contents entry."""
    for i, line in enumerate(lines):
        if start.search(line) and not line.rstrip().endswith(".") and not LEADER.search(line):
            stop = next((j for j in range(i + 1, len(lines)) if end.search(lines[j])), len(lines))
            return i + 1, stop
    return None


def contents_share(lines: list[str]) -> float:
    """Part of the lines that end in dot leaders; above 0.4 it is a contents page."""
    full = [x for x in lines if x.strip()]
    return sum(bool(LEADER.search(x)) for x in full) / len(full) if full else 0.0


def ph_values(text: str) -> str | None:
    """First pH value or range between 0 and 14."""
    for m in PH.finditer(text):
        found = [x for x in m.groups() if x]
        if all(float(x) <= 14 for x in found):
            return "-".join(found)
    return None


def fields(text: str | None) -> tuple:
    t = text or ""
    one = lambda p: (m.group(1) if (m := re.search(rf"\b({p})\b", t, re.I)) else None)
    size = SIZE.search(t)
    counts = list(dict.fromkeys(a or b for a, b in COUNT.findall(t)))
    color, shape = one(COLORS), one(SHAPES)
    return ("; ".join(container_labels(t)) or None, ", ".join(counts) or None, color and color.lower(), shape and shape.lower(), size and size.group(1), ph_values(t), contents_share(t.split("\n")))


def document_fields(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document with what its text says; null where it says nothing. Null texts give a row of nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(fields, 2_000)
        for b in batches:
            rows = [memo[t if isinstance(t, str) else None] for t in b[column]]
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")][1:])
            out.insert(0, "doc_id", b[key].to_numpy())
            yield out

    return docs.select(key, column).mapInPandas(run, FIELDS)


def sections(docs: DataFrame, start: str, end: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, first_line, text) of the section between the markers, for the documents that have it."""
    a, z = re.compile(start), re.compile(end)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[column]):
                lines = (t if isinstance(t, str) else "").split("\n")
                if at := section(lines, a, z):
                    out.append((k, at[0] + 1, "\n".join(lines[slice(*at)])))
            yield pd.DataFrame(out, columns=["doc_id", "first_line", "text"])

    return docs.select(key, column).mapInPandas(run, "doc_id long, first_line int, text string")


def paged(pages: DataFrame) -> DataFrame:
    """Pages of (page_id, monograph_id, page, text) with their document, place in it and block.

    Pages without a number follow the numbered ones by page_id; a page without a monograph is a document of its own.
    """
    page_id, page = F.col("page_id").cast("long"), F.col("page").cast("int")
    doc = F.coalesce(F.col("monograph_id").cast("string"), F.concat(F.lit("page "), page_id.cast("string")))
    at = F.coalesce(page.cast("long"), F.lit(2**31) + page_id, F.lit(2**62))
    one = pages.select(doc.alias("doc"), at.alias("at"), page_id.alias("page_id"), page.alias("page"), F.col("text").cast("string").alias("text"))
    return one.withColumn("block", F.greatest(F.floor(F.col("at") / F.lit(PAGES)), F.lit(0)))


def laid(rows: DataFrame) -> DataFrame:
    """Rows of paged() by block, in order. Only a block is held at once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "doc", "block").sortWithinPartitions("doc", "block", "at", "page_id")


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(monograph, document, block, [(place, page, text)]) of rows in order; of a page fed several times the fullest text."""
    rows = (r for b in batches for r in zip(b["doc"], b["block"], b["at"], b["page"], b["text"]))
    for (doc, block), group in groupby(rows, lambda r: r[:2]):
        held: dict[int, tuple] = {}
        for _, _, at, page, text in group:
            t = text if isinstance(text, str) else None
            if at not in held or len(t or "") > len(held[at][2] or ""):
                held[at] = at, None if pd.isna(page) else int(page), t
        yield None if doc.startswith("page ") else int(doc), doc, block, list(held.values())


def pieces(lines: list[str], start: re.Pattern, end: re.Pattern) -> list[tuple[int | None, int, int | None]]:
    """(start marker, first line, past the last) of the parts of lines that end markers bound.

    The first part has no start marker: it is in a section if one is open before it. A start marker within a section is
    its text. The end is None if no end marker follows; a line that is both markers ends a section and starts another.
    """
    out: list[tuple[int | None, int, int | None]] = []
    opened, first = None, 0
    for i, line in enumerate(lines):
        heading = not line.rstrip().endswith(".")
        if heading and end.search(line):
            out.append((opened, first, i))
            opened, first = None, i + 1
        if opened is None and heading and start.search(line) and not LEADER.search(line):
            if out:
                opened, first = i, i + 1
            else:  # whether this one starts a section depends on what is before
                opened = i
    return [*out, (opened, first, None)]


def page_sections(pages: DataFrame, start: str, end: str) -> DataFrame:
    """(monograph_id, page, first_line, part, text) of every section, page and first_line being those of its start.

    Pages are read in order, each once; a section goes on until an end marker or the end of its monograph. It has one row,
    or one for each block of PAGES page numbers that it reaches into, with part counting blocks from that of its start.
    """
    a, z = re.compile(start), re.compile(end)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        chars = 0
        for monograph, doc, block, held in blocks(batches):
            lines, place = [], []
            for _, page, text in held:
                if text is not None:
                    mine = text.split("\n")
                    lines += mine
                    place += [(page, i + 1) for i in range(len(mine))]
            found = pieces(lines, a, z)
            for k, (opened, first, stop) in enumerate(found):
                at = place[opened] if opened is not None else (None, None)
                one = doc, monograph, block
                if k == 0:
                    # nothing is open before block 0
                    out.append((*one, "head", *at, len(found) > 1, "\n".join(lines[:stop]) if block else None))
                    if opened is not None:
                        out.append((*one, "start", *at, None, "\n".join(lines[opened + 1 : stop])))
                elif opened is not None:
                    out.append((*one, "inner" if stop is not None else "tail", *at, None, "\n".join(lines[first:stop])))
            chars += sum(map(len, lines))
            if len(out) >= 2_000 or chars > 4_000_000:
                yield frame(out)
                out, chars = [], 0
        yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in MARKED.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"monograph_id": "Int64", "block": "int64", "page": "Int32", "line": "Int32", "ends": "boolean"})

    marked = laid(paged(pages)).mapInPandas(run, MARKED)
    at = F.struct("block", "page", "line")
    own = F.when(F.col("line").isNotNull(), at)
    state = marked.groupBy("doc", "block").agg(
        F.max(F.when(F.col("piece") == "head", F.col("ends"))).alias("ends"), F.max(F.when(F.col("piece") == "head", own)).alias("starts"), F.max(F.when(F.col("piece") == "tail", own)).alias("leaves"),
    )
    along = Window.partitionBy("doc").orderBy("block")
    run_no = F.coalesce(F.sum(F.col("ends").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = state.withColumn("carried", F.lag("leaves").over(along)).withColumn("run_no", run_no)
    since = Window.partitionBy("doc", "run_no").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.coalesce(F.first("carried").over(since), F.first("starts", ignorenulls=True).over(since)).alias("opening")
    state = state.select("doc", "block", opening)
    found = marked.join(state, ["doc", "block"]).withColumn("opening", F.when(F.col("piece").isin("inner", "tail"), at).otherwise(F.col("opening")))
    found = found.where((F.col("piece") != "head") == (F.col("opening.block") == F.col("block")))
    return found.select("monograph_id", F.col("opening.page").alias("page"), (F.col("opening.line") + 1).alias("first_line"), (F.col("block") - F.col("opening.block")).cast("int").alias("part"), "text")


def page_fields(pages: DataFrame) -> DataFrame:
    """One row per monograph with what its pages say, read in order, each once: fields() of all its text."""
    named = [f.split()[0] for f in FIELDS.split(", ")][1:-1]
    schema = "doc string, monograph_id long, block long, " + ", ".join(f"{c} string" for c in named) + ", leaders long, lines long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for monograph, doc, block, held in blocks(batches):
            lines = [x for at, _, t in held if t and (not block or at >= block * size) for x in t.split("\n") if x.strip()]
            said = fields("\n".join(t for _, _, t in held if t is not None))
            out.append((doc, monograph, block, *said[:-1], sum(bool(LEADER.search(x)) for x in lines), len(lines)))
            if len(out) >= 2_000:
                yield frame(out)
                out = []
        yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")]).astype({"monograph_id": "Int64", "block": "int64", "leaders": "int64", "lines": "int64"})

    rows, size = paged(pages), PAGES
    # the last lines of a block are read with the next one too, for what is written over its border
    border = rows.where((F.col("at") >= 0) & (F.pmod("at", F.lit(PAGES)) == PAGES - 1)).withColumn("block", F.col("block") + 1).withColumn("text", F.substring_index("text", "\n", -2))
    said = laid(rows.unionByName(border)).mapInPandas(run, schema)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("block"))).alias(c)
    in_order = F.array_sort(F.collect_list(F.when(F.col("pack_count").isNotNull(), F.struct("block", F.split("pack_count", ", ").alias("n")))))
    counts = F.array_join(F.array_distinct(F.flatten(F.transform(in_order, lambda x: x["n"]))), ", ")
    whole = said.groupBy("doc").agg(
        F.first("monograph_id").alias("monograph_id"), F.array_distinct(F.flatten(F.collect_list(F.split("pack_style", "; ")))).alias("styles"), counts.alias("pack_count"),
        *map(first, named[2:]), F.sum("leaders").alias("leaders"), F.sum("lines").alias("lines"),
    )
    has = lambda c: F.array_contains("styles", c.title())

    def style(c: str) -> Column:
        hidden = [has(o) for o, within in WITHIN.items() if c in within]
        return F.when(has(c) & ~(hidden[0] if hidden else F.lit(False)), F.lit(c.title()))

    styles = F.array_join(F.array(*map(style, CONTAINERS)), "; ")
    filled = lambda c: F.when(c != "", c)
    share = F.coalesce(F.try_divide("leaders", "lines"), F.lit(0.0))
    return whole.select("monograph_id", filled(styles).alias("pack_style"), filled(F.col("pack_count")).alias("pack_count"), *named[2:], share.alias("leader_share"))
