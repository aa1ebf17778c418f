"""Similarity and canonical forms that built-in functions don't have, for use in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher, get_close_matches
from fractions import Fraction
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from rxloom.functions.quantity import MASS

#: Pattern of the words that carry no identity of a company in matching; those without \\b leave the rest of a word.
COMPANY_WORDS = (
    r"incorporated|inc|limited|limitee|ltee|ltd\b|llc|llp|ulc|corporation|corp|co\b|sa\b|ag\b|gmbh|plc|sencrl|senc|sec\b|"
    r"pharmaceuticals|pharmaceutical|pharma\b|therapeutics|laboratoires|laboratoire|laboratories|laboratory|labs\b|lab\b|healthcare|health|canada|a division of|division|serono|consumer"
)
_COMPANY = re.compile(rf"\b(?:{COMPANY_WORDS})")
#: Words that a label may have besides its molecule and still be generic.
GENERIC_FILLERS = frozenset(
    """besylate mesylate maleate sulfate sulphate hydrochloride hcl hydrobromide fumarate succinate tartrate acetate sodium potassium calcium magnesium dihydrate usp bp ep ph eur
    tablet tablets tab tabs capsule capsules cap caps fc ec xr sr er la cr od mr""".split()
)
#: Entries that are no strength; units that a bare number may take from its neighbours.
NO_STRENGTH, SHARED_UNITS = {"", "NONE", "NAN", "NOT APPLICABLE", "N/A"}, ("%", "IU", "MCG", "MG", "MIU", "ML", "UG")
PART = re.compile(r"(?P<n>\d+(?:\.\d+)?)?\s*(?P<unit>.*)", re.S)


def ratio(a: str, b: str) -> float:
    """Gestalt similarity in percent; 0 if either is empty."""
    return SequenceMatcher(None, a, b).ratio() * 100 if a and b else 0.0


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, which the matching blocks of a ratio never exceed; bits stand for the places of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = left = (1 << len(a)) - 1
    for c in b:
        u = left & at.get(c, 0)
        left = (left + u | left - u) & full
    return len(a) - left.bit_count()


def reaches(a: str, b: str, least: float) -> bool:
    """ratio(a, b) >= least, for a least above 0; the ratio itself is taken only where its bounds allow that."""
    n = len(a) + len(b)
    return bool(a and b) and all(2.0 * m() / n * 100 >= least for m in (lambda: min(len(a), len(b)), lambda: common(a, b))) and ratio(a, b) >= least


def _letters(s: str) -> int:
    """Two bits a letter, for one and for more of it; what is no letter shares six classes."""
    bits = 0
    for c in s:
        k = 2 * (ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 6)
        bits |= 2 << k if bits >> k & 1 else 1 << k
    return bits


class Alike:
    """Distinct texts; those that may be like another are met by falling bound of the ratio, from lengths and letters."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.n = np.array([len(t) for t in texts], np.int64)
        self.bits = np.array([_letters(t) for t in texts], np.uint64)

    def to(self, text: str, least: float) -> Iterator[tuple[float, str]]:
        """(bound, text) of every text whose ratio to the given one may be the least, which is above 0."""
        own = np.uint64(_letters(text))
        m = np.minimum(self.n - np.bitwise_count(self.bits & ~own), len(text) - np.bitwise_count(~self.bits & own).astype(np.int64))
        bound = 2.0 * m / np.maximum(self.n + len(text), 1) * 100
        at = np.flatnonzero(bound >= least)
        for i in at[np.argsort(-bound[at], kind="stable")]:
            yield float(bound[i]), self.texts[i]


@lru_cache(50_000)
def company_core(s: str | None) -> str:
    """Lower-case ASCII without punctuation and company words."""
    t = unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").decode().lower()
    return " ".join(_COMPANY.sub(" ", re.sub("[.,/&]", "", t)).split())


def _milligrams(n: Fraction, unit: str) -> tuple[Fraction, str]:
    """The number in milligrams if the unit is a mass; a lone M is an M of MG."""
    micrograms = 1000 if unit == "M" else MASS.get(unit)
    return (n * micrograms / 1000, "MG") if micrograms and unit != "NG" else (n, unit)


@lru_cache(50_000)
def strength_tokens(s: str | None) -> tuple[str, ...]:
    """Sorted `number unit` tokens: masses in milligrams, mg in g as percent, a closing denominator off, a shared unit spread."""
    if (t := (s or "").strip().upper()) in NO_STRENGTH:
        return ()
    amounts: list[tuple[Fraction, str]] = []
    other: set[str] = set()
    parts = [p.strip() for p in re.split("[/;]", t)]
    for i, p in enumerate(parts):
        n, unit = (m := PART.fullmatch(p)) and m["n"], m["unit"].strip()
        if n is not None:
            amounts.append((Fraction(n), unit))
        elif unit == "G" and amounts and amounts[-1][1] == "MG":  # so many milligrams in a gram
            amounts[-1] = (amounts[-1][0] / 10, "%")
        elif unit and not (i and i == len(parts) - 1 and unit in ("ML", "G", "L")):
            other.add(unit)
    amounts = [_milligrams(n, u) for n, u in amounts]
    shared = max((u for _, u in amounts if u in SHARED_UNITS), default="")
    return tuple(sorted(other | {f"{float(n):g}{u or shared}" for n, u in amounts}))


def best_options(query: str, options: list[str], most: int = 10) -> list[str]:
    """Options that hold the query, or else up to three close ones."""
    q = query.strip().lower()
    hits = [o for o in options if q and q in o.lower()][:most]
    low = {o.lower(): o for o in reversed(options)}
    return hits or [low[x] for x in get_close_matches(q, list(low), n=3, cutoff=0.75)]


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(StringType())
def company_core_udf(a: pd.Series) -> pd.Series:
    return a.map(company_core)


@F.pandas_udf(StringType())
def strength_key_udf(a: pd.Series) -> pd.Series:
    return a.map(lambda s: "|".join(strength_tokens(s)))


def _within(short: str, long: str) -> bool:
    """The characters of one, in order, among those of the other."""
    at = -1
    return all((at := long.find(c, at + 1)) >= 0 for c in short)


def truncated_brand(a: str, b: str) -> bool:
    """Same first word, and the letters and digits of one in order within the other: a brand cut short."""
    first = [re.search("[a-z]+", x.lower()) for x in (a, b)]
    x, y = (re.sub("[^a-z0-9]", "", x.lower()) for x in (a, b))
    return all(first) and first[0][0] == first[1][0] and (_within(x, y) or _within(y, x))


def containment(needle: str | None, text: str | None, least: float = 0.9) -> float:
    """1 if the text holds the needle, in any letter case; else the likeness of the first window that is nearly it, or 0.

    Windows start at each of the first places, a quarter of the needle, and then at every such step. Needles of less than
    three characters are in nothing.
    """
    n, t = (needle or "").strip().lower(), (text or "").lower()
    if len(n) < 3:
        return 0.0
    if n in t:
        return 1.0
    last, step = len(t) - len(n), max(1, len(n) // 4)
    match = SequenceMatcher(None, "", "")
    match.set_seq1(n)
    for i in chain(range(min(step, last + 1)), range(step, last + 1, step)) if last > 0 else ():
        match.set_seq2(t[i : i + len(n)])
        if match.real_quick_ratio() >= least and match.quick_ratio() >= least and (r := match.ratio()) >= least:
            return r
    return 0.0


def fuzzy_contains(needle: str, text: str, least: float = 0.9) -> bool:
    return containment(needle, text, least) > 0


@F.pandas_udf(DoubleType())
def containment_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([containment(x, y) for x, y in zip(a, b)])
