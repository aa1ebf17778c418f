"""Label fields read from the text of product monographs: a cascade of sections, headings and sentences.

A value is copied as it stands or the field is `Not in PM`; nothing is guessed. Each field has the page of the section
that it comes from. Patterns are tried in order; what they give is refused if it reads like a heading of another section
or like the patient's leaflet. Monographs are read by blocks of pages in order, each by one call in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.operators.grader import PH_SOLUBILITY
from rxloom.operators.monograph import blocks, container_labels, contents_share, laid, pack_size, paged

NOT_IN_PM, NEEDS_OCR, UNCOATED = "Not in PM", "needs OCR / manual check", "N/A (uncoated)"
#: Characters a page has at least if its text can be read.
PAGE_CHARS = 50
FIELDS = ("active_ingredient", "nonmedicinal_ingredients", "excipients_core", "excipients_coating", "preservatives", "pack_size", "pack_style", "color", "shape", "size_mm", "weight", "ph")
LABEL = "monograph_id long, " + ", ".join(f"{f} string, {f}_page int" for f in FIELDS) + ", needs_ocr int"

_I = re.IGNORECASE


def pattern(*some: str, flags: int = _I) -> re.Pattern:
    return re.compile("|".join(f"(?:{x})" for x in some), flags)


#: Units that make a line with a leading number a strength, not a heading.
_UNIT = r"(?:mg|mcg|µg|ug|ng|kg|g|ml|l|iu|mmol|meq|%)"
#: Where sections start and end.
COMPOSITION = pattern(r"^6[\.\s]+DOSAGE FORMS?(?!.*\.{4,}).*COMPOSITION", r"^6[\.\s]+PHARMACEUTICAL INFORMATION(?!.*\.{4,})", r"^PART II.*SCIENTIFIC INFORMATION(?!.*\.{4,})", r"^DOSAGE FORMS?,\s*(?:STRENGTHS?,\s*)?COMPOSITION(?!.*\.{4,})")
COMPOSITION_END = pattern(rf"^7[\.\s]+(?!{_UNIT}\b)[A-Za-z]", r"^PART\s+III", r"^CLINICAL\s+PHARMACOLOGY")
CHEMISTRY = pattern(r"^13[\.\s]+PHARMACEUTICAL INFORMATION", r"^PHARMACEUTICAL INFORMATION(?!.*\.{4,})")
CHEMISTRY_END = pattern(rf"^14[\.\s]+(?!{_UNIT}\b)[A-Za-z]", r"^NON-CLINICAL", r"^TOXICOLOGY")
DESCRIPTION, DESCRIPTION_END = pattern("Description"), pattern("Composition", "Packaging", "Storage", "MICROBIOLOGY")
CONSUMER = pattern(r"^PART\s+III", r"^CONSUMER\s+INFORMATION")
SUPPLY = pattern(r"AVAILABILITY\s+OF\s+DOSAGE\s+FORMS?", r"^SUPPLIED\b")
SUPPLY_END = pattern("MICROBIOLOGY", r"CLINICAL\s+(?:PHARMACOLOGY|TRIALS)", "PHARMACOKINETICS", "TOXICOLOGY", "REFERENCES")
#: What comes before a list of non-medicinal ingredients, in order of trust; and what ends or spoils one.
LIST_LEADS = [
    r"(?:^|\n)[ \t]*(?:Clinically\s+Relevant\s+)?Non[-\s]?medicinal\s+Ingredients?\s*:\s*|(?:^|\n)[ \t]*Nonmedical\s+Ingredients?\s*:\s*", r"non[-\s]?medicinal\s+excipients?\s*:\s*",
    r"(?:^|\n)\s*Composition\s*[:\-]\s*[^\n]{0,120}\bcontains?\s*[:\-]\s*", r"(?:^|\n)[ \t]*The\s+other\s+ingredients?\s+(?:are|is|includes?)\s*[:\-]?\s*",
    r"(?:(?:^|\n)[ \t]*(?:Clinically\s+Relevant\s+)?Non[-\s]?medicinal\s+Ingredients?|(?:^|\n)[ \t]*Nonmedical\s+Ingredients?)\s*[:\-]?\s*",
    r"Each\s+(?:gram|g\b|mL|litre|liter|tablet|capsule|unit|vial|ampoule|sachet)(?:\s+of\s+\S+(?:\s+\S+){0,3})?\s+contains?\s*[:\-]?\s*",
]
LIST_END = pattern(r"^(?:Packaging|Storage|Stability|Shelf\s+Life|Description\b|Administration\b|Route\b|Availability\b|Microbiology\b|PART\s+(?:I{1,3}|IV|VI{0,3}|IX|X)\b|\d+\s+(?:DOSAGE|PHARMACEUTICAL|CLINICAL|NON-CLINICAL|WARNINGS|ADVERSE))")
LEAFLET = pattern(r"\b(?:this\s+leaflet|contact\s+your\s+(?:doctor|pharmacist)|side\s+effect|how\s+to\s+(?:store|take|use)\b|missed\s+dose|overdose|usual\s+(?:adult\s+)?dose|what\s+the\s+medication|what\s+it\s+does|when\s+it\s+should\s+not)\b")
POISON = pattern(r"administration\s+strength", r"strength\s+and\s+dosage", r"recommended\s+dose", r"how\s+to\s+use", r"administration\s+and\s+dosage", "debossed", r"administration\s+form", r"form\s*/\s*strength", r"tablets?\s+with\s+['\"]", r"dosage\s+form")
PRESERVATIVES = pattern(r"\b(?:methylparaben|propylparaben|benzyl\s+alcohol|benzalkonium\s+chloride|sodium\s+benzoate|potassium\s+benzoate|benzoic\s+acid|sorbic\s+acid|phenoxyethanol|phenol|cresol|chlorobutanol|thimerosal)\b")
#: Words of sentences on packaging, and of others that resemble them.
CONTAINER = pattern(r"\b(?:bottles?|vials?|blisters?|blister\s+packs?|ampoules?|ampuls?|ampules?|syringes?|prefilled?\s+syringes?|cartridges?|auto.?injectors?|unit\s*[–-]?\s*dose\s+strips?|strips?|sachets?|tubes?|cartons?|pouches?|canisters?|inhalers?|pens?|droppers?)\b")
STRENGTH_NUMBER = pattern(r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|μg|micrograms?|nanograms?|ng\b|g\b|mEq|IU|mmol)\b")
CLINICAL = pattern(r"\b(?:patients?|subjects?|participants?|volunteers?|study|studies|clinical\s+trial|placebo|randomized|n\s*=\s*\d|adverse|efficacy|administered\s+to|half.?life|bioavailability|pharmacokinetic|absorption|distribution|elimination)\b")
KEEPING = pattern(r"\b(?:after\s+opening|discard(?:ed)?\b|days?\s+after|hours?\s+after|store(?:d)?\s+at\b|refrigerat|protect\s+from\s+(?:light|heat|moisture)|keep\s+out\s+of\s+reach|expir(?:y|ation)|shelf\s*life|should\s+be\s+(?:discarded|stored)|to\s+ensure\s+sterility)\b")
OFFERED = pattern(r"\bcontainers?\b", r"\bavailable\s+in\b", r"\bsupplied\s+in\b", r"\bpackaged\s+in\b")
#: Appearance.
_HUES = r"white|red|pink|orange|amber|yellow|gold(?:en)?|green|blue|purple|violet|brown|beige|grey|gray|black|tan|teal|maroon|ivory|peach|coral|lavender|lilac|rose|silver|salmon|olive|turquoise|aqua|indigo"
COLOR = pattern(rf"(?:light |pale |dark |bright |deep |off[-\s]?)?(?:{_HUES})\b")
COLOR_ON = pattern(rf"\s+to\s+(?:slightly\s+|almost\s+|very\s+|pale\s+|light\s+|dark\s+|off-?)?(?:{_HUES}|cream)\b")
SHAPE = pattern(r"\b(?:round|oval(?:oid)?|oblong|capsule[- ]?shaped|caplet|biconvex|pentagonal|hexagonal|octagonal|triangular|diamond|shield|kidney[-\s]shaped)\b")
MILLIMETRES = pattern(r"\d+(?:\.\d+)?\s*mm(?:\s*[×xX]\s*\d+(?:\.\d+)?\s*mm)?")
WEIGHT = re.compile(r"(?:tablet\s+weight|weight\s+of\s+(?:the\s+)?tablet|total\s+tablet\s+weight)\s*[:\-]?\s*(\d+(?:\.\d+)?\s*mg)", _I)
LOOKS = pattern(
    r"\b(?:tablets?|capsules?|caplets?|gelatin|softgels?|films?|coated|pellets?|granules?|lozenges?|suppositories?|injections?|infusions?|ampoules?|vials?|syrups?|suspensions?|solutions?|drops|creams?|gels?|ointments?|"
    r"lotions?|emulsions?|pastes?|patches?|inserts?|sprays?|aerosols?|topical|ophthalmic|nasal|transdermal|each|appearance|description|supplied|colou?rs?)\b"
)
SUBSTANCE = pattern(r"\bpowder\b", r"\bcrystalline\b")
COMES_IN = re.compile(rf"(?:comes?\s+in\s+(?:a\s+)?(?:[^\s.!?]+\s+){{0,6}}|is\s+(?:supplied\s+as\s+a\s+)?(?:[^\s.!?]+\s+){{0,4}}|available\s+as\s+(?:a\s+)?(?:[^\s.!?]+\s+){{0,4}})((?:light |pale |dark |bright |deep |off[-\s]?)?(?:{_HUES})\b)", _I)


class Provider(Protocol):
    """Hooks of a language model; each may say nothing."""

    def synonyms(self, term: str) -> list[str]: ...

    def fields(self, text: str, page: int | None, group: str) -> dict[str, dict]: ...

    def summary(self, record: dict) -> str | None: ...

    def confirm(self, ingredient: str, company: str, options: list[dict]) -> dict | None: ...


class NoProvider:
    """Says nothing: every field comes from the rules."""

    def synonyms(self, term: str) -> list[str]:
        return []

    def fields(self, text: str, page: int | None, group: str) -> dict[str, dict]:
        return {}

    def summary(self, record: dict) -> str | None:
        return None

    def confirm(self, ingredient: str, company: str, options: list[dict]) -> dict | None:
        return None


@dataclass
class Text:
    """Lines of a document, or of a part of it, with the page that each is on."""

    lines: list[tuple[int | None, str]] = field(default_factory=list)

    def __str__(self) -> str:
        return "\n".join(x for _, x in self.lines)

    def __bool__(self) -> bool:
        return bool(self.lines)

    @property
    def page(self) -> int | None:
        return self.lines[0][0] if self.lines else None

    def part(self, start: re.Pattern, end: re.Pattern | None) -> Text:
        """From the first heading that starts a section to the one that ends it; a line that ends in a full stop is none."""
        opened: list[tuple[int | None, str]] = []
        for page, raw in self.lines:
            line = raw.strip()
            heading = not line.endswith(".")
            if opened and end is not None and heading and end.search(line):
                break
            if opened or (heading and start.search(line)):
                opened.append((page, line))
        return Text(opened)


def first_group(text: str, *patterns: str) -> str | None:
    """What the first pattern that fits says, trimmed."""
    return next((m[1].strip() for p in patterns if (m := re.search(p, text, _I | re.S))), None)


def refused(value: str | None) -> bool:
    return bool(value and POISON.search(value))


def list_after(text: str) -> str | None:
    """The lines up to a blank one or another heading, as one; page numbers within a line break it."""
    out: list[str] = []
    for line in map(str.strip, re.sub(r"\s+-\s*\d+\s*-\s+", "\n", text).split("\n")):
        if (out and not line) or (line and LIST_END.match(line)):
            break
        if line:
            out.append(line)
    return " ".join(out) or None


def nonmedicinal(text: str) -> str | None:
    """The list of non-medicinal ingredients as it stands, by the most trusted lead whose list isn't the leaflet's."""
    lists = (list_after(text[m.end() :]) for lead in LIST_LEADS for m in re.finditer(lead, text, _I))
    return next((x for x in lists if x and not LEAFLET.search(x)), None)


def active(text: str) -> str | None:
    return first_group(text, r"(?:^|\n)[ \t]*Active\s+Ingredients?\s*[:\-][ \t]*(.+?)(?:\n|$)", r"contain(?:s|ing)?\s+(.+?)\s+as\s+(?:the\s+)?active\s+ingredient")


def excipients(text: str) -> tuple[str | None, str | None]:
    """(core, coating); a core without a coating is uncoated."""
    stop = r"(?:\n(?:[A-Z][a-z]{2,}|[A-Z]{3,})\s*[:\n]|\n\n|Film\s+Coat|$)"
    names = r"(?:Non-?medicinal\s+Ingredients?|Inactive\s+Ingredients?|Core\s+Tablet\s+Ingredients?|Core\s+Ingredients?)\s*[:\-]?\s*"
    core = first_group(text, rf"{names}(?:Core\s+Tablets?\s*[:\-]\s*)(.+?)(?:{stop[3:-1]}|Coating)", rf"{names}(.+?){stop}")
    coat = first_group(text, rf"Film\s+Coat(?:ing)?\s*[:\-]?\s*(.+?){stop}", rf"(?:^|\n)\s*Coating\s*:\s*(.+?){stop}")
    core, coat = (None if refused(x) else x for x in (core, coat))
    return core, coat or (UNCOATED if core else None)


def preservatives(text: str) -> str:
    """Y or N by an own entry, else by the list of ingredients; `Not in PM` without either."""
    if own := re.search(r"Preservatives?\s*[:\-]\s*(.+?)(?:\n|;|$)", text, _I):
        if re.search(r"\b(?:none|nil|not applicable|n/a)\b", own[1], _I):
            return "N"
        if PRESERVATIVES.search(own[1]):
            return "Y"
    listed = re.search(r"(?:Non-?medicinal|Inactive|Excipient)\s*(?:Ingredients?|Excipients?)?\s*[:\-]?\s*(?:Core\s+Tablets?\s*:\s*)?(.{20,}?)(?:\n\n|Film\s+Coat|\Z)", text, _I | re.S)
    return NOT_IN_PM if not listed else "Y" if PRESERVATIVES.search(listed[0]) else "N"


def acidity(text: str) -> str:
    """A pH value or range; a sentinel if the text tells the solubility at several pH values only."""
    at = re.findall(r"pH\s+\d+(?:\.\d+)?\s*[:\-]\s*[<>]?[\d.]+\s*(?:mg|µg|ug)/", text, _I)
    if len(at) > 1 or (at and re.search(r"pH[-\s]dependent", text, _I)):
        return PH_SOLUBILITY
    value = r"(\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?)"
    found = first_group(text, rf"(?:^|\n)[ \t]*pH(?:\s+range)?\s*[:\-]\s*{value}\s*(?:\n|$)", rf"\bpH\b[^\n]*?[:\-]\s*{value}(?!\s*[:\-]\s*[\d<>])")
    return found if found and all(float(x) <= 14 for x in re.findall(r"\d+(?:\.\d+)?", found)) else NOT_IN_PM


def plain_strength(s: str | None) -> str | None:
    m = re.match(r"(\d+(?:\.\d+)?)\s*(.*)", (s or "").strip())
    if not m:
        return (s or "").strip() or None
    return f"{m[1].rstrip('0').rstrip('.') if '.' in m[1] else m[1]} {m[2].strip()}".strip()


def appearance(text: str, strength: str | None = None) -> dict[str, str]:
    """Colour, shape, size and weight, of the strength's own bullet if there is one.

    A colour or shape counts within 200 characters of a word of dosage forms; a colour of a powder is the substance's.
    """
    if s := plain_strength(strength):
        own = re.search(rf"(?:^|[•\-*◦–—])\s*{re.escape(s).replace(chr(92) + ' ', chr(92) + 's*')}\s*[:\-]?\s*(.+?)(?=[•\-*◦–—]\s*\d|\n\n|\Z)", text, _I | re.S | re.M)
        text = own[1] if own else text
    near = lambda m: LOOKS.search(text[max(0, m.start() - 200) : m.start() + 200])
    out: dict[str, str] = {}
    if c := next((m for m in COLOR.finditer(text) if near(m) and not SUBSTANCE.search(text[m.start() : m.start() + 120])), None):
        more = COLOR_ON.match(text, c.end())
        out["color"] = text[c.start() : more.end() if more else c.end()].strip()
    if m := next(filter(near, SHAPE.finditer(text)), None):
        out["shape"] = m[0]
    if m := MILLIMETRES.search(text):
        out["size_mm"] = m[0].strip()
    if m := WEIGHT.search(text):
        out["weight"] = m[1].strip()
    return out


def pack_sentences(text: str) -> tuple[str | None, str | None]:
    """(sizes, styles) of all sentences that name a container and a count that is no strength, and aren't on trials or storage."""
    sizes: dict[str, None] = {}
    styles: dict[str, None] = {}
    for s in (" ".join(x.split()) for x in re.split(r"(?<=[.!?])\s+", text)):
        if len(s) < 10 or not CONTAINER.search(s) or CLINICAL.search(s) or KEEPING.search(s):
            continue
        if not re.search(r"\b\d+\b", STRENGTH_NUMBER.sub("", s)) and not OFFERED.search(s):
            continue
        if labels := container_labels(s):
            styles |= dict.fromkeys(labels)
            own = re.search(r"\b(?:available|provided|supplied|packaged|sold|dispensed)\s+(in\s+\S.+)", s, _I)
            told = own[1].strip() if own else s
            sizes[told if len(told) <= 250 else told[:250].rsplit(" ", 1)[0]] = None
    return ("; ".join(sizes) or None, "; ".join(styles)) if styles else (None, None)


def packaging(text: str) -> tuple[str | None, str | None]:
    """(size, style) of a block under a heading of its own, else of sentences anywhere."""
    for head in (r"^Packaging\s*$\n", r"^Packaging\s*:\s*"):
        m = re.search(rf"(?m){head}(.+?)(?=\n\n|\n[A-Z\d]|\Z)", text, _I | re.S)
        block = m[1].strip() if m else ""
        if len(block) > 5 and not re.search(r"the following|dosage strengths|dosage\s+form|:\s*$", block, _I | re.M) and (labels := container_labels(block)):
            return pack_size(block), "; ".join(labels)
    return pack_sentences(text)


def provided(said: dict[str, dict], names: tuple[str, ...], page: int | None) -> dict[str, tuple[str, int | None]]:
    """Values and pages of a provider's answer; what it didn't find is `Not in PM`."""
    return {f: (str(x["value"]).strip(), x.get("page") or page) if x.get("found") and x.get("value") else (NOT_IN_PM, None) for f in names if isinstance(x := said.get(f), dict)}


def scanned(pages: list[tuple[int | None, str | None]]) -> bool:
    """Too few characters a page to be text: it needs OCR."""
    return sum(len(t or "") for _, t in pages) < PAGE_CHARS * len(pages)


def label(pages: list[tuple[int | None, str | None]], strength: str | None = None, provider: Provider | None = None) -> dict[str, tuple[str, int | None]]:
    """(value, page) of each field of a monograph given as (page, text) in order."""
    ask = provider or NoProvider()
    whole = Text([(p, x) for p, t in pages for x in (t or "").split("\n")])
    body = Text([(p, x) for p, t in pages if contents_share((t or "").split("\n")) <= 0.4 for x in (t or "").split("\n")]) or whole
    composition, chemistry = whole.part(COMPOSITION, COMPOSITION_END), whole.part(CHEMISTRY, CHEMISTRY_END) or whole
    looks = (composition.part(DESCRIPTION, DESCRIPTION_END) or composition) if composition else (body.part(DESCRIPTION, DESCRIPTION_END) or whole)
    source = composition or whole
    text = str(source)
    out: dict[str, tuple[str, int | None]] = {}

    def put(name: str, value: str | None, page: int | None) -> None:
        out[name] = (value, page) if value and value != NOT_IN_PM else (NOT_IN_PM, None)

    core, coat = excipients(text)
    size, style = packaging(text)
    for name, value in (("nonmedicinal_ingredients", nonmedicinal(text)), ("active_ingredient", active(text)), ("excipients_core", core), ("excipients_coating", coat), ("preservatives", preservatives(text)), ("pack_size", size), ("pack_style", style)):
        put(name, value, source.page)
    said = ask.fields(str(looks), looks.page, "appearance")
    seen = {f: (v, looks.page) for f, v in appearance(str(looks), strength).items()} if not said else provided(said, ("color", "shape", "size_mm", "weight"), looks.page)
    if not said and not {"color", "shape"} & set(seen) and (part := whole.part(CONSUMER, None)) and (m := COMES_IN.search(str(part))):
        seen["color"] = (m[1].strip(), part.page)
    if not said and not {"color", "shape"} <= set(seen) and (part := body.part(SUPPLY, SUPPLY_END)):
        for f, v in appearance(str(part), strength).items():
            if f in ("color", "shape"):
                seen.setdefault(f, (v, part.page))
    for f in ("color", "shape", "size_mm", "weight"):
        put(f, *seen.get(f, (None, None)))
    acid = provided(ask.fields(str(chemistry), chemistry.page, "ph"), ("ph",), chemistry.page).get("ph")
    value = acid[0] if acid else acidity(str(chemistry))
    out["ph"] = acid or (value, None if value in (NOT_IN_PM, PH_SOLUBILITY) else chemistry.page)
    return out


def label_rows(pages: DataFrame, provider: Provider | None = None) -> DataFrame:
    """One row per monograph with the value and page of each field; needs_ocr where there is hardly any text.

    pages: page_id, monograph_id, page, text; read in order, each page number once by its fullest text. Null and empty
    pages say nothing. A monograph over several blocks of pages has of each field the first block's value.
    """
    names = [f.split()[0] for f in LABEL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        for monograph, doc, block, held in blocks(batches):
            some = [(page, t) for _, page, t in held]
            row = {"doc": doc, "block": block, "monograph_id": monograph, "needs_ocr": int(scanned(some))}
            for f, (value, page) in label(some, None, provider).items():
                row[f], row[f"{f}_page"] = value, page
            out.append(row)
            if len(out) >= 500:
                yield frame(out)
                out = []
        yield frame(out)

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc", "block", *names])
        return out.astype({"block": "int64", "monograph_id": "Int64", "needs_ocr": "int32"} | {f"{f}_page": "Int32" for f in FIELDS})

    said = laid(paged(pages)).mapInPandas(run, "doc string, block long, " + LABEL)
    first = lambda f: F.min_by(F.struct(F.col(f).alias("v"), F.col(f"{f}_page").alias("p")), F.when(F.col(f) != NOT_IN_PM, F.col("block"))).alias(f"_{f}")
    whole = said.groupBy("doc").agg(F.first("monograph_id").alias("monograph_id"), *map(first, FIELDS), F.min("needs_ocr").alias("needs_ocr"))
    return whole.select("monograph_id", *[c for f in FIELDS for c in (F.coalesce(F.col(f"_{f}.v"), F.lit(NOT_IN_PM)).alias(f), F.col(f"_{f}.p").alias(f"{f}_page"))], "needs_ocr")


def merged_labels(wanted: DataFrame, catalogue: DataFrame, documents: DataFrame, own: tuple[str, ...] = ("active_ingredient", "pack_size", "pack_style")) -> DataFrame:
    """Labels of products from two stages: what the catalogue says of `own` fields goes before the document's.

    wanted: din, drug_code; catalogue: drug_code, ok, pdf_url and the own fields, one row a code; documents: pdf_url, ok and
    all fields, one row a url. A stage that failed for now (ok false) writes no row for its products, so that they are asked
    again; a product without a document has `No PM available` in the document's fields. Each code and url is looked up once,
    however many products share it.
    """
    one = wanted.join(catalogue.withColumnRenamed("ok", "_c_ok").select("drug_code", "_c_ok", "pdf_url", *[F.col(f).alias(f"_c_{f}") for f in own]), "drug_code", "left").where(F.coalesce("_c_ok", F.lit(False)))
    names = [c for c in documents.columns if c not in ("pdf_url", "ok")]
    both = one.join(documents.withColumnRenamed("ok", "_d_ok"), "pdf_url", "left").where(F.col("pdf_url").isNull() | F.coalesce("_d_ok", F.lit(False)))
    none = lambda c: F.when(F.col("pdf_url").isNull(), "No PM available").otherwise(c)
    return both.select("din", "drug_code", "pdf_url", *[F.coalesce(F.nullif(F.trim(f"_c_{c}"), F.lit("")), none(F.col(c))).alias(c) if c in own else none(F.col(c).cast("string")).alias(c) for c in names])
