"""A parsing expression grammar for fields that hold several values.

    list      <- item (delimiter item)*
    item      <- blank* (quoted / bare) blank*
    quoted    <- '"' ('""' / !'"' .)* '"' &(blank* (delimiter / end))
    bare      <- (bracketed / phrase / !delimiter .)+
    bracketed <- '(' (bracketed / !')' .)* ')'          also [ ] and { }
    phrase    <- '"' ('""' / !'"' .)* '"'               a quotation within a value

Each rule is a method of Packrat that gives where it ends, or -1 if it fails. Alternatives are tried in order and a failed
one gives back all it read: a quote or bracket that never closes is read again as a plain character and flags its item.
Ends of quotes and brackets are memoised by position, so that time and memory are linear however often one fails.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Entries that say that there is no value.
SENTINELS = {
    "", "-", "--", "N/A", "NA", "NONE", "NULL", "NIL", "NOT APPLICABLE", "NOT AVAILABLE", "UNKNOWN",
    "NOT IN PM", "NOT IN DPD", "NO PM AVAILABLE", "NO NOC RECORD", "NEEDS OCR / MANUAL CHECK", "N/A (UNCOATED)", "MULTI",
}
LIST_MARK = re.compile(r"^\s*(?:[•▪◦·‣*–—-]+\s+|[•▪◦·‣]|\(?(?:\d{1,3}|[A-Za-z])[.)]\s+)")
HEADING = re.compile(r"(?:^|(?<=[;.\n]))\s*[A-Za-z][A-Za-z]*(?: [A-Za-z]+){0,3}\s?:(?=\s)")
BLANK = " \t\r\n                ​ 　"


@dataclass(frozen=True)
class Grammar:
    """delimiters: ordered choices, each a pattern; the first that occurs outside quotes and brackets delimits a part.

    all_together: every choice delimits at once. conjunction: what may stand for the delimiter before the last value.
    """

    delimiters: tuple[str, ...]
    all_together: bool = False
    conjunction: str = ""
    headings: bool = False


#: Substance names never hold a bare delimiter; excipient names may ("silica, hydrated" where semicolons delimit).
SUBSTANCES = Grammar((r"[;,/+|&!\t\n]|(?<=\s)(?:AND|WITH|and|with|And|With)(?=\s)",), all_together=True)
LISTED = Grammar((r"\n|•", r"\t", r";", r"\|", r"(?<=\s)/(?=\s)", r"(?<=\s)\+(?=\s)", r","), conjunction=r"(?<![-\s])\s+(?:and|And|AND|et|ET)(?=\s)", headings=True)


def closings(s: str) -> dict[int, int]:
    """For each quote and opening bracket that closes, the index after what closes it; from the end, each position once."""
    n, out = len(s), {}
    quote = [-1] * (n + 2)  # after the quote that closes a text that goes on at a position
    after = {c: [-1] * (n + 1) for c in PAIRS}
    for j in range(n - 1, -1, -1):
        c = s[j]
        if c == '"':
            if quote[j + 1] > 0:
                out[j] = quote[j + 1]
            quote[j] = quote[j + 2] if s[j + 1 : j + 2] == '"' else j + 1
        else:
            quote[j] = quote[j + 1]
            if c in PAIRS and after[c][j + 1] > 0:
                out[j] = after[c][j + 1]
        for o, close in PAIRS.items():
            after[o][j] = j + 1 if c == close else after[o][out[j] if c in PAIRS and j in out else j + 1]
    return out


def skip_blank(s: str, i: int) -> int:
    while i < len(s) and s[i] in BLANK:
        i += 1
    return i


class Packrat:
    """The rules of the grammar over one text; a rule gives where it ends, -1 if it fails."""

    def __init__(self, s: str, delimiter: re.Pattern):
        self.s, self.delimiter = s, delimiter
        self.ends: dict[int, int] | None = None
        self.stop = special(delimiter.pattern)

    def closing(self, i: int) -> int:
        if self.ends is None:
            self.ends = closings(self.s)
        return self.ends.get(i, -1)

    def delimited(self, i: int) -> int:
        m = self.delimiter.match(self.s, i)
        return m.end() if m and m.end() > i else -1

    def bracketed(self, i: int) -> int:
        return self.closing(i) if self.s[i] in PAIRS else -1

    def phrase(self, i: int) -> int:
        return self.closing(i) if self.s[i] == '"' else -1

    def quoted(self, i: int) -> int:
        end = self.phrase(i)
        after = skip_blank(self.s, end) if end > 0 else -1
        return end if end > 0 and (after == len(self.s) or self.delimited(after) > 0 or self.delimited(end) > 0) else -1

    def bare(self, i: int) -> tuple[int, str]:
        """(end, flag): up to the next delimiter outside brackets and phrases."""
        flag = ""
        while m := self.stop.search(self.s, i):
            i, c = m.start(), m.group()
            if c not in OPENERS:
                if m.end() > i:
                    return i, flag
                i += 1
                continue
            end = self.bracketed(i)
            if end < 0:
                end = self.phrase(i)
            if end < 0:
                flag, end = "open_quote" if c == '"' else "open_bracket", i + 1
                if self.delimited(i) > 0:
                    return i, flag
            i = end
        return len(self.s), flag

    def item(self, i: int) -> tuple[int, str]:
        """(end, flag) of an item from i."""
        first = skip_blank(self.s, i)
        if first < len(self.s) and self.s[first] == '"':
            end = self.quoted(first)
            if end > 0:
                return self.bare(end)[0], ""  # blanks up to the delimiter
            end, flag = self.bare(i)
            return end, flag or ("text_after_quote" if self.phrase(first) > 0 else "")
        return self.bare(i)

    def items(self) -> list[tuple[int, int, str]]:
        out, i = [], 0
        while True:
            end, flag = self.item(i)
            out.append((i, end, flag))
            if end >= len(self.s):
                return out
            i = self.delimited(end)


OPENERS = frozenset('"([{')
_special: dict[str, re.Pattern] = {}


def special(delimiter: str) -> re.Pattern:
    """What ends a run of plain characters: an opener or a delimiter."""
    return _special.setdefault(delimiter, re.compile(rf'["(\[{{]|(?:{delimiter})'))


def spans(s: str, delimiter: re.Pattern) -> list[tuple[int, int, str]]:
    """(start, end, flag) of each item of the list."""
    return Packrat(s, delimiter).items()


def unquote(s: str) -> str:
    if len(s) > 1 and s[0] == '"' and closings(s).get(0) == len(s):
        s = s[1:-1]
    return s.replace('""', '"')


def clean(s: str, first: bool = True) -> str:
    """One value: blanks single, no list mark, no closing full stop or stray delimiter, no outer quotes."""
    s = " ".join(s.split())
    s = LIST_MARK.sub("", s, count=1) if first else s
    s = s.rstrip(" .;,") if not s.endswith('"') else s
    return " ".join(unquote(s.strip()).split()).rstrip(" .;,")


def parts(s: str, headings: bool) -> list[str]:
    """Text between part headings, the headings and what closes the part before them taken off."""
    if not headings:
        return [s]
    at = [m for m in HEADING.finditer(s)]
    if not at:
        return [s]
    out = [s[: at[0].start()]] + [s[m.end() : n.start() if n else len(s)] for m, n in zip(at, [*at[1:], None])]
    return [x.strip(BLANK + ";.") for x in out]


_compiled: dict[str, re.Pattern] = {}


def pattern(p: str) -> re.Pattern:
    return _compiled.setdefault(p, re.compile(p))


def parse(text: str | None, grammar: Grammar) -> list[tuple[int, str, str]]:
    """(position from 1, value, flag); a sentinel, blank or null field gives none. Values keep their letter case."""
    if text is None or " ".join(text.split()).upper() in SENTINELS:
        return []
    s = text.strip(BLANK)
    while s and s[-1] in ".;,":
        s = s[:-1].rstrip(BLANK)
    values: list[tuple[str, str]] = []
    for part in parts(s, grammar.headings):
        if not part:
            continue
        chosen, found = None, [(0, len(part), "")]
        for d in grammar.delimiters:
            found = spans(part, chosen := pattern(d))
            if sum(bool(part[a:b].strip(BLANK)) for a, b, _ in found) > 1:
                break
        got = [(part[a:b], f) for a, b, f in found if part[a:b].strip(BLANK)]
        if grammar.conjunction and chosen is not None and chosen.pattern == grammar.delimiters[-1] and got:
            last, flag = got.pop()
            last = re.sub(r"^\s*(?:and|et)\s+(?!/)", "", last, flags=re.I) if got else last
            cut = spans(last, pattern(grammar.conjunction))
            got += [(last[a:b], f or flag) for a, b, f in cut if last[a:b].strip(BLANK)]
        values += got
    out = []
    for v, f in values:
        if c := clean(v):
            out.append((len(out) + 1, c, f))
    return out
