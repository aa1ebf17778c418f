"""Quantities in text: numbers with units of many spellings, and their common units."""

from __future__ import annotations

import re
from fractions import Fraction
from math import floor

#: Micrograms in one of each mass unit.
MASS = {
    "NG": Fraction(1, 1000), "NANOGRAM": Fraction(1, 1000),
    "MCG": Fraction(1), "UG": Fraction(1), "MICROGRAM": Fraction(1),
    "MG": Fraction(1000), "MILLIGRAM": Fraction(1000),
    "G": Fraction(10**6), "GM": Fraction(10**6), "GRAM": Fraction(10**6),
    "KG": Fraction(10**9), "KILOGRAM": Fraction(10**9),
}
SCALE = {"": 1, "THOUSAND": 1000, "1000": 1000, "1,000": 1000, "MILLION": 10**6}
PERCENT_MICROGRAMS_PER_G = 10_000

_NUM = r"(?:\d+(?:,\d+)*(?:\.\d+)?|\.\d+)"
_MASS = r"(?P<mass>NANOGRAM|MICROGRAM|MILLIGRAM|KILOGRAM|GRAM|MCG|UG|NG|MG|KG|GM|G)S?(?![A-Z])\.?"
_PER = r"(?:\s*(?:/|PER)\s*(?P<of>\d+(?:\.\d+)?)?\s*(?P<by>ML|MILLILITRES?|MILLILITERS?|L|LITRES?|LITERS?|GRAMS?|GM|G)(?![A-Z])|\s?\.?(?P<inv>ML|G|L)\s?-1)"
_ACT = r"(?P<scale>THOUSAND|MILLION|1000|1,000)?\s*(?P<act>I\.\s?U\.?|IU|INTERNATIONAL UNITS?|UNITS?|U)(?![A-Z])"
_PCT = r"(?P<pct>%|PERCENT(?![A-Z])|PCT(?![A-Z]))\s*(?P<basis>[WV]/[WV])?"
_DENOM_UNKNOWN = r"(?P<odd>\s*(?:/|PER)\s*\d*\s*(?:ACT|DOSE|ACTUATION|SPRAY|PATCH|HR?|HOUR|DAY|TAB|CAP|VIAL|KG|MG|CM2?|DROP|PUFF|ML|L|G)(?![A-Z]))"
UNIT = re.compile(rf"\s*(?:{_MASS}{_PER}?|{_PCT}|{_ACT})")
ODD = re.compile(_DENOM_UNKNOWN)
NUMBER = re.compile(_NUM)
GROUPED = re.compile(r",(?=\d{3}(?!\d))")
OTHER_UNIT = re.compile(r"\s*[A-ZΜΩ]+[A-Z0-9./-]*")

#: (kind, factor): amount = number x factor in the kind's unit. None: no unit; UNKNOWN: a unit that isn't of a kind.
UNKNOWN = ("unknown", Fraction(0))


def fold(s: str) -> str:
    return s.upper().replace("Μ", "U").replace("µ", "U").replace(" ", " ").replace(" ", " ")


def number(s: str) -> Fraction:
    """A comma before exactly three digits groups thousands, any other is a decimal mark."""
    return Fraction(GROUPED.sub("", s).replace(",", "."))


def unit_at(s: str, i: int) -> tuple[tuple[str, Fraction] | None, int]:
    """Unit at i of a folded text, and where it ends."""
    m = UNIT.match(s, i)
    if not m:
        o = OTHER_UNIT.match(s, i)
        return (UNKNOWN, o.end()) if o and o.end() > i else (None, i)
    g = m.groupdict()
    if g["pct"]:
        return (("mass_per_g", Fraction(PERCENT_MICROGRAMS_PER_G)) if g["basis"] in (None, "W/W") else UNKNOWN), m.end()
    if g["act"]:
        odd = ODD.match(s, m.end())
        return (UNKNOWN, odd.end()) if odd else (("activity", Fraction(SCALE[g["scale"] or ""])), m.end())
    mass = MASS[g["mass"]]
    by = g["by"] or g["inv"]
    if not by:
        odd = ODD.match(s, m.end())
        if odd and not re.match(r"\s*/\s*\d", odd.group()):
            return UNKNOWN, odd.end()
        return ("mass", mass), m.end()
    of = Fraction(g["of"] or 1)
    if by[0] == "G" and of not in (1, 100):  # "0.5G/0.3G" is two masses, "2G/100G" a share
        return ("mass", mass), m.start("of") - 1 if s[m.start("of") - 1] == "/" else s.index("/", m.end("mass"))
    if not of:
        return UNKNOWN, m.end()
    per_ml = by.startswith(("ML", "MILLIL"))
    if per_ml or by[0] == "L":
        return ("mass_per_ml", mass / of / (1 if per_ml else 1000)), m.end()
    return ("mass_per_g", mass / of), m.end()


def quantities(strength: str | None, unit: str | None) -> list[tuple[Fraction, tuple[str, Fraction] | None]]:
    """(number, unit) of each number in the order written.

    A number's own unit in the text comes first, then the unit column; a unit written once for several numbers of the
    text holds for all of them. No number: none.
    """
    if strength is None:
        return []
    s = fold(strength)
    column = None
    if unit is not None and (u := fold(unit).strip()):
        column, end = unit_at(u, 0)
        if column is None and (m := NUMBER.match(u)):  # "1000 IU"
            column, end = unit_at(u, m.end())
            column = UNKNOWN if column in (None, UNKNOWN) else (column[0], column[1] * number(m.group()))
        if column is not None and u[end:].strip(" ."):
            column = UNKNOWN
        if column is None:
            column = UNKNOWN if u.strip("-. ") else None
    out: list[list] = []
    i = 0
    while i < len(s):
        m = NUMBER.match(s, i)
        if not m:
            i += 1
            continue
        own, i = unit_at(s, m.end())
        out.append([number(m.group()), own])
    written = {u for _, u in out if u is not None}
    if len(written) == 1:
        shared = written.pop()
        out = [[n, shared] for n, _ in out]
    return [(n, u if u is not None else column) for n, u in out]


def rounded(x: Fraction) -> int:
    return floor(x + Fraction(1, 2))
