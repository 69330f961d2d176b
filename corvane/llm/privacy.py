"""Personal information inside free text.

Weak supervision: patterns propose spans; labelers (shape, gazetteer, words before and after, and what
speaks against) vote for or against each. Expectation-maximisation over the vote patterns of the whole
corpus estimates how reliable each labeler is, without labels. Its posteriors train a logistic span
classifier over votes, shape and context, which decides.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ocr import is_page_number, is_scanned, is_titled, lines_of

CATEGORIES = ("name", "email", "phone", "identity_number", "street_address")
PLACEHOLDERS = {c: f"[{c.upper()}]" for c in CATEGORIES}

# Word lists of the context labelers.
TITLES = frozenset("mr mrs ms miss mx dr prof professor nurse sister doctor rev sir madam herr frau pt patient consultant matron".split())
PARTICLES = frozenset("van von der den de del della di da la le du dos bin ibn al ter ten".split())
ROLES = frozenset("interpreter daughter son wife husband mother father sister brother partner carer neighbour kin is name checked by with to thank from contact spoke called witnessed reviewed signed electronically copy seen discussed attended patient pt guardian relative aunt uncle".split())
AFTER_NAME = frozenset("was has reports asked attended who rn md phd said called lives phoned visited wrote for by on ; ,".split())
ORGANISATION = frozenset("hospital infirmary clinic institute centre center medical general regional teaching community cardiac vale ward wing records office department unit university school laboratory practice pharmacy trust".split())
EPONYM_NOUNS = frozenset("disease syndrome catheter line scale chart sign score test criteria ulcer stain coma palsy node reflex manoeuvre maneuver tube pouch fracture method".split())
PHONE_WORDS = frozenset("phone tel telephone mobile cell fax ring call back on reachable at number contact home work is pager text".split())
ID_WORDS = frozenset("ssn social security number mrn medical record passport national id dni card member insurance policy holder nhs no under with identity licence license".split())
NOT_PERSONAL = frozenset("specimen accession lot reagent order device protocol study loinc panel ward room bay batch serial catalogue ref code isbn grant trial model line confidential report referral note summary page".split())
ADDRESS_WORDS = frozenset("address lives at from home to delivered residence resides living moved discharged".split())
STREET_KINDS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Way|Terrace|Ter|Court|Ct|Close|Place|Pl|Boulevard|Blvd|Square|Sq|Row|Gardens|Crescent|Parade|Walk|Mews|Quay"
FOREIGN_KINDS = "gasse|straße|strasse|weg|allee|platz|ufer|damm|ring"

_BREAK = re.compile(r"(?<=[^\W_])[-­‐¬][ \t]*(?:\r\n|\n|\r)\s*(?=[^\W\d_])")
_NEVER_NAMES = TITLES | ORGANISATION | ROLES | NOT_PERSONAL | EPONYM_NOUNS
_BREAK_JVM = r"(?<=[\p{L}\p{N}])[-\u00ad\u2010\u00ac][ \t]*(?:\r\n|\n|\r)\s*(?=\p{L})"
_D = "[0-9OIlSB]"
_EMAIL = re.compile(
    r"[A-Za-z0-9][\w.+\-']*\s?(?:@|\s?[\[(]\s?at\s?[\])]\s?)\s?[A-Za-z0-9][\w\-]*(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z][\w\-]*)+"
    r"|[A-Za-z0-9][\w.+\-]*\s+at\s+[A-Za-z0-9][\w\-]*(?:\s+dot\s+[A-Za-z][\w\-]*)+", re.I)  # fmt: skip
_PHONE = re.compile(rf"(?<![\w.\-+])(?:\+?{_D}{{1,3}}[\s.\-]?)?(?:\({_D}{{2,5}}\)[\s.\-]?|{_D}{{2,5}}[\s.\-]?)(?:{_D}{{2,4}}[\s.\-]?){{1,3}}{_D}{{2,6}}(?![\w\-]|\.\d)")
_IDENTITY = re.compile(
    rf"(?<![\w\-.])(?:{_D}{{3}}[-\s]{_D}{{2}}[-\s]{_D}{{4}}|[A-Z]{{1,3}}-?{_D}{{6,10}}|{_D}{{7,9}}[A-Z]|{_D}{{6,10}})(?![\w]|-\d)")
_ADDRESS = re.compile(
    rf"(?:(?:Apt|Apartment|Flat|Unit|Suite)\.?\s?#?\s?\d+[A-Za-z]?,?\s+)?(?<![\w\-.]){_D}{{1,5}}[A-Za-z]?,?\s+(?:(?:[NSEW]\.?|North|South|East|West)\s+)?(?:[^\W\d_][\w'’]*\s+){{1,3}}(?:{STREET_KINDS})\b\.?"
    rf"|P\.?\s?O\.?\s?Box\s+{_D}+|\b[^\W\d_][\w]*(?:{FOREIGN_KINDS})\s+\d{{1,4}}\s?[a-z]?\b|(?<![\w\-])\d{{1,4}},?\s+(?:rue|calle|via|avenida|boulevard|place)\s+[^\W\d_][\w'’\-]*(?:\s+[^\W\d_][\w'’\-]*)?"
    rf"|\b(?:[^\W\d_][\w'’\-]*\s+){{1,4}}\d{{1,4}}[a-z]?,\s+\d{{4,5}}\s+[^\W\d_]{{3,}}"
    rf"|\b(?:Rue|Calle|Via|Avenida)\s+[^\W\d_][\w'’\-]*(?:\s+[^\W\d_][\w'’\-]*)?,?\s+\d{{1,4}}\b", re.I)  # fmt: skip
#: What an e-mail or street address must hold; the patterns above are only tried around these.
_EMAIL_ANCHOR = re.compile(r"@|[\[(]\s?at\s?[\])]|\sat\s+[A-Za-z0-9][\w\-]*\s+dot\s", re.I)
_ADDRESS_ANCHOR = re.compile(
    rf"\b(?:{STREET_KINDS}|Box|Rue|Calle|Via|Avenida)\b|(?:{FOREIGN_KINDS})\s+\d|\d[a-z]?,\s+\d{{4,5}}\s", re.I)
_NAME_TOKEN = re.compile(r"(?<![\w@.+\-])(?:[^\W\d_]\.(?=\s?[^\W\d_])|(?:[OoDdLl]['’])?[^\W\d_]{2,}(?:[-'’][^\W\d_]+)*)(?![\w@+]|[._\-]\w)")
_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_SHAPE = (re.compile(r"[A-Z]"), re.compile(r"[a-z]"), re.compile(r"\d"))


@dataclass
class Gazetteer:
    """Person and town names known from records, and how family names are composed."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    rare: frozenset[str] = frozenset()
    towns: frozenset[str] = frozenset()
    heads: frozenset[str] = field(default_factory=frozenset)
    tails: frozenset[str] = field(default_factory=frozenset)
    usual: frozenset[str] = frozenset()
    cache: dict[str, int] = field(default_factory=dict)

    def knows(self, word: str) -> int:
        """3 for a given name, 2 for a family name, 1 for a word composed like one, 0 otherwise."""
        if (strength := self.cache.get(word)) is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[word] = strength = self._strength(word.lower())
        return strength

    def _strength(self, w: str) -> int:
        if w in self.given:
            return 3
        parts = [p for p in re.split(r"[-'’]", w) if len(p) > 1]
        if any(p in self.family for p in parts):
            return 2
        if any(p in self.given for p in parts):
            return 3
        for p in parts:
            if p in self.rare or len(p) >= 5 and any(p[:k] in self.heads and p[k:] in self.tails for k in range(3, len(p) - 1)):
                return 1
        return 0


class View:
    """A text with words divided at line ends joined, and the way back to positions of the text."""

    def __init__(self, text: str):
        self.wrapped = is_scanned(text)
        furniture = []
        if self.wrapped:  # headers and page numbers may part a mention
            lines = [(at, line, line.strip()) for at, line in lines_of(text) if line.strip()]
            often = Counter(x for _, _, x in lines)
            after = False  # after a page number
            for at, line, x in lines:
                number = len(x) <= 20 and is_page_number(line)
                header = (after or often[x] > 1) and is_titled(x) and ":" not in x and "," not in line[:12]
                if number or header:
                    furniture.append((at, at + len(line) + 1))
                after = number
        pieces, starts, offsets, at, length = [], [], [], 0, 0
        for begin, end in self._skipped(text, furniture):
            if begin < at:
                continue
            pieces.append(text[at:begin])
            starts.append(length)
            offsets.append(at)
            length += begin - at
            at = end
        pieces.append(text[at:])
        starts.append(length)
        offsets.append(at)
        self.text = "".join(pieces)
        self.starts, self.offsets = starts, offsets

    @staticmethod
    def _skipped(text: str, furniture: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Spans that the view leaves out: page furniture with the blank lines around it, and line-end hyphens."""
        if not furniture:
            return [m.span() for m in _BREAK.finditer(text)]
        merged: list[list[int]] = []
        for a, b in furniture:
            while a > 0 and text[a - 1] in "\n\r\x0c \t" and a > 1 and text[a - 2] in "\n\r\x0c \t":
                a -= 1
            while b < len(text) and text[b] in "\n\r\x0c":
                b += 1
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out = []
        for a, b in merged:  # a word divided over the page break joins as well
            m = re.search(r"[-­‐¬][ \t]*[\n\r\x0c]\s*$", text[max(0, a - 20) : a])
            if m and text[b : b + 40].lstrip()[:1].isalpha():
                out.append((max(0, a - 20) + m.start(), b + len(text[b : b + 40]) - len(text[b : b + 40].lstrip())))
            else:
                out.append((a, min(b, len(text))))
        inside = [m.span() for m in _BREAK.finditer(text) if all(m.end() <= a or m.start() >= b for a, b in out)]
        return sorted(out + inside)

    def position(self, k: int) -> int:
        i = bisect_right(self.starts, k) - 1
        return self.offsets[i] + k - self.starts[i]


def _before(text: str, at: int, n: int = 4) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text[max(0, at - 60) : at])[-n:]]


def _after(text: str, at: int, n: int = 3) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text[at : at + 50])[:n]]


def _shape(s: str) -> str:
    s = _SHAPE[2].sub("9", _SHAPE[1].sub("a", _SHAPE[0].sub("A", s)))
    return re.sub(r"a+", "a", re.sub(r"\s+", " ", s))[:24]


def name_spans(view: View, gazetteer: Gazetteer) -> Iterator[tuple[int, int, list[int]]]:
    """(begin, end, strengths) of runs of words that may be a person's name."""
    text = view.text
    tokens = [(*m.span(), m.group()) for m in _NAME_TOKEN.finditer(text)]
    cached, knows = gazetteer.cache, gazetteer.knows
    known = [0 if w[-1] == "." else k if (k := cached.get(w)) is not None else knows(w) for _, _, w in tokens]
    n, i = len(tokens), 0

    def gap(k: int) -> str:
        return text[tokens[k][1] : tokens[k + 1][0]]

    def follows(k: int) -> bool:
        g = gap(k)
        if not 0 < len(g) <= 4 or g.strip(" \n\t\r\x0c"):
            return False
        return "\n" not in g or view.wrapped or known[k] == 3 and known[k + 1] in (1, 2) and g == "\n"

    def unusual(k: int) -> bool:
        """Whether a word is written like a name and isn't a word of the language."""
        w = tokens[k][2]
        return w[0].isupper() and w[1:].islower() and (low := w.lower()) not in gazetteer.usual and low not in _NEVER_NAMES

    def introduced(k: int, end: int) -> bool:
        """Whether the words before or after a run speak of a person."""
        before = tokens[k - 1][2].lower().rstrip(".") if k and not text[tokens[k - 1][1] : tokens[k][0]].strip(" \n.,:") else ""
        after = tokens[end + 1][2].lower() if end + 1 < n and not text[tokens[end][1] : tokens[end + 1][0]].strip(" \n,;(") else ""
        return (before in TITLES or before in ROLES or after in AFTER_NAME) and after not in EPONYM_NOUNS

    while i < n:
        begin, _, w = tokens[i]
        if not known[i] and not w[0].isupper():
            i += 1
            continue
        title = False
        if i and text[tokens[i - 1][1] : begin].strip(" \n.") == "" and tokens[i - 1][2].lower().rstrip(".") in TITLES and tokens[i - 1][2][0].isupper():
            title = w[0].isupper() and w.lower() not in _NEVER_NAMES
        strong = known[i] >= 2 or known[i] == 1 and w[0].isupper()
        initial = w[-1] == "." and w[0].isupper()
        named_after = w[0].isupper() and not w.isupper() and i + 1 < n and follows(i) and tokens[i + 1][2].lower() in EPONYM_NOUNS
        if named_after and not strong:
            yield begin, tokens[i][1], [0]
            i += 1
            continue
        if not (strong or title and len(w) > 1 or initial and i + 1 < n and follows(i) and (known[i + 1] or tokens[i + 1][2][-1] == "." and i + 2 < n and known[i + 2])):
            j = i
            while j < i + 3 and j + 1 < n and unusual(j) and unusual(j + 1) and follows(j):
                j += 1
            if j > i and introduced(i, j):  # unknown to the gazetteer, told by its letters and neighbours
                yield begin, tokens[j][1], [known[k] for k in range(i, j + 1)]
                i = j
            i += 1
            continue
        j, values = i, [known[i]]
        while j + 1 < n:
            nxt = tokens[j + 1][2]
            if follows(j) and (known[j + 1] >= 2 or known[j + 1] == 1 and nxt[0].isupper() or nxt[-1] == "." and nxt[0].isupper() and j + 2 < n and known[j + 2]):
                j += 1
            elif follows(j) and nxt.lower() in PARTICLES and j + 2 < n and follows(j + 1) and (known[j + 2] or tokens[j + 2][2].lower() in PARTICLES):
                j += 1
            elif j == i and known[j] in (1, 2) and known[j + 1] == 3 and re.fullmatch(r",\s{1,3}", gap(j)):
                j += 1
            elif title and not any(values) and follows(j) and unusual(j) and unusual(j + 1):
                j += 1
            else:
                break
            values.append(known[j])
        yield begin, tokens[j][1], values
        i = j + 1


Candidate = tuple[str, int, int, tuple[int, ...], list[int]]
LABELERS = ("shape", "gazetteer", "before", "after", "against")
_BITS = 16


def _features(category: str, votes: tuple[int, ...], span: str, before: list[str], after: list[str], extra: str) -> list[int]:
    items = [f"v{k}={v}" for k, v in enumerate(votes)] + [f"s={_shape(span)}", f"p1={before[-1] if before else ''}", f"p2={' '.join(before[-2:])}", f"n1={after[0] if after else ''}", f"x={extra}", "bias"]
    items.append("vv=" + "".join(map(str, votes)))
    return [crc32(f"{category}|{x}".encode()) & ((1 << _BITS) - 1) for x in items]


def _emails(t: str) -> Iterator[re.Match]:
    """The matches of the e-mail pattern, tried where the part before each anchor begins."""
    done = 0
    for anchor in _EMAIL_ANCHOR.finditer(t):
        k = anchor.start()
        while k > done and t[k - 1].isspace():
            k -= 1
        while k > done and (t[k - 1].isalnum() or t[k - 1] in "_.+-'"):
            k -= 1
        while k < anchor.start() and not (t[k].isascii() and t[k].isalnum()):
            k += 1
        if k < anchor.start() and (m := _EMAIL.match(t, k)):
            yield m
            done = m.end()


def _addresses(t: str) -> Iterator[re.Match]:
    """The matches of the address pattern, tried in the words around each anchor."""
    done = 0
    for anchor in _ADDRESS_ANCHOR.finditer(t):
        if anchor.start() < done:
            continue
        begin, end = anchor.start(), anchor.end()
        for _ in range(9):
            while begin > done and not t[begin - 1].isspace():
                begin -= 1
            while begin > done and t[begin - 1].isspace():
                begin -= 1
        for _ in range(6):
            while end < len(t) and not t[end].isspace():
                end += 1
            while end < len(t) and t[end].isspace():
                end += 1
        for m in _ADDRESS.finditer(t, begin, end):
            yield m
            done = m.end()
            if done >= anchor.end():
                break


def candidates(text: str, gazetteer: Gazetteer) -> list[Candidate]:
    """(category, begin, end, votes, features) of the proposed spans of a text, in positions of its view."""
    view = View(text)
    t, out = view.text, []

    def add(category: str, begin: int, end: int, votes: tuple[int, ...], before: list[str], after: list[str], extra: str = "") -> None:
        out.append((category, begin, end, votes, _features(category, votes, t[begin:end], before, after, extra)))

    taken: list[tuple[int, int]] = []
    for m in _emails(t):
        before, after = _before(t, m.start()), _after(t, m.end())
        s = m.group()
        plain = bool(re.fullmatch(r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)+", s))
        votes = (1 if plain else 0, 1 if re.search(r"(?:\.|dot\s)\s?(?:com|org|net|edu|gov|example|invalid|test|[a-z]{2})\b", s, re.I) else 0,
                 1 if set(before) & {"mail", "login", "contact", "to", "from", "email", "write", "writes"} else 0, 0, -1 if re.search(r"@\s*\d", s) else 0)
        add("email", m.start(), m.end(), votes, before, after)
        taken.append(m.span())

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    for m in _addresses(t):
        if not free(*m.span()):
            continue
        begin, s = m.start(), m.group()
        if s[0].isalpha() and re.search(r"\d,\s+\d{4,5}\s", s):  # street, number, postcode: the street is the run of capitals before the number
            lead = re.search(r"(?:[^\W\d_a-z][\w'’\-]*\s+(?:(?:der|den|dem|des|la|le|de)\s+)?)+(?=\d{1,4}[a-z]?,)", s)
            if not lead:
                continue
            begin, s = m.start() + lead.start(), s[lead.start() :]
        before, after = _before(t, begin), _after(t, m.end())
        inner = {w.lower() for w in re.findall(r"[^\W\d_]+", s)}
        near = " ".join(_WORDS.findall(t[m.end() : m.end() + 40])[:6]).lower()
        written = [w for w in re.findall(r"[^\W\d_]{2,}", s) if w.lower() not in PARTICLES]
        titled = all(w[0].isupper() for w in written)
        votes = (1 if titled else 0 if all(w.islower() for w in written) and s[:1].isdigit() else -1, 1 if any(town in near for town in gazetteer.towns) or re.search(r"\b\d{5}\b", near) else 0, 1 if set(before) & ADDRESS_WORDS else 0,
                 1 if re.search(r"postcode|post code|zip", near) else 0, -1 if inner & (ORGANISATION - {"unit"} | {"mg", "was", "the", "and", "of", "after"}) or set(before[-1:]) & {"ward", "room", "page"} else 0)
        add("street_address", begin, m.end(), votes, before, after)
        if votes[0] + votes[4] >= 0:
            taken.append((begin, m.end()))
    for m in _IDENTITY.finditer(t):
        if not free(*m.span()):
            continue
        before, after = _before(t, m.start(), 5), _after(t, m.end())
        s = m.group()
        if not any(c.isdigit() for c in s):
            continue
        labelled = bool(set(before[-3:]) & ID_WORDS - {"with", "under", "no"})
        strict = re.fullmatch(rf"{_D}{{3}}-{_D}{{2}}-{_D}{{4}}|[A-Z]{{3}}{_D}{{8}}|[A-Z]{_D}{{7,8}}|{_D}{{8}}[A-Z]|M-{_D}{{6}}", s)
        loose = re.fullmatch(rf"{_D}{{3}}[\s\-]{_D}{{2}}[\s\-]{_D}{{4}}", s)
        votes = (1 if strict else 0 if loose else -1, 0, 1 if labelled else 0, 0, -1 if set(before[-3:]) & NOT_PERSONAL else 0)
        add("identity_number", m.start(), m.end(), votes, before, after, _shape(s))
    for m in _PHONE.finditer(t):
        s = m.group()
        digits = re.sub(r"[^0-9OIlSB]", "", s)
        if not free(*m.span()) or not 9 <= len(digits) <= 13 or not any(c.isdigit() for c in s) or s.count("\n") > 1:
            continue
        before, after = _before(t, m.start()), _after(t, m.end())
        if re.fullmatch(rf"{_D}{{3}}[\s\-]{_D}{{2}}[\s\-]{_D}{{4}}|\d{{4}}-\d{{2}}-\d{{2}}.*", s):
            continue
        g = "".join(re.sub(rf"{_D}+", lambda x: str(len(x.group())), s).split())
        usual = bool(re.fullmatch(r"\+?1?[-.]?\(?3\)?[-.]?3[-.]?4|10|11|\+?\d?[-.]?3[-.]?3[-.]?(?:4|22)|53?3?3?|\+2?4?6?|533|\+246|\+210|3322|1?-?3-3-4|\+1\(3\)3-4", g)) or len(digits) in (10, 11, 12)
        votes = (1 if usual else 0, 1 if len(digits) in (10, 11, 12) else 0, 1 if set(before) & PHONE_WORDS else 0, 1 if set(after[:2]) & {"ext", "extension", "mobile", "home", "work"} else 0, -1 if set(before[-3:]) & (NOT_PERSONAL | {"ssn", "passport", "mrn", "member", "id"}) else 0)
        add("phone", m.start(), m.end(), votes, before, after, g)
    for begin, end, known in name_spans(view, gazetteer):
        if not free(begin, end):
            continue
        before, after = _before(t, begin), _after(t, end)
        span = t[begin:end]
        low = span.lower()
        prev, nxt = (before[-1] if before else ""), (after[0] if after else "")
        if prev == "." and len(before) > 1 and before[-2] in TITLES:
            prev = before[-2]
        words = re.findall(r"[^\W\d_]+", low)
        town = low in gazetteer.towns or f"{prev} {low}" in gazetteer.towns or f"{low} {nxt}" in gazetteer.towns
        cased = span[0].isupper()
        organisation = nxt in ORGANISATION or bool(set(words) & ORGANISATION) or (len(after) > 1 and nxt in ("|", "-") and after[1] in ORGANISATION) or prev in ("st", "port", "nether", "lower", "saint")
        votes = (
            1 if len(words) > 1 and cased else 0 if cased or len(known) > 1 else -1,
            1 if 3 in known and (2 in known or 1 in known or len(known) > 1) else 0 if max(known) >= 1 or len(known) > 1 or prev in TITLES else -1,
            1 if prev in TITLES or prev in ROLES or prev == ":" and len(before) > 1 and before[-2] in ROLES or prev == "," and len(before) > 1 and before[-2] in ROLES else 0,
            1 if nxt in AFTER_NAME or nxt in (",", ";", ".") and len(known) > 1 else 0,
            -1 if town or organisation or nxt in EPONYM_NOUNS else 0,
        )
        add("name", begin, end, votes, before, after, f"{''.join(map(str, sorted(set(known))))}{'t' if prev in TITLES else ''}")
    return [(c, view.position(a), view.position(b - 1) + 1, v, f) for c, a, b, v, f in out]


# Prior shares of votes against, abstentions and votes for, given a true and a false span.
BETTER_THAN_CHANCE = ((0.05, 0.35, 0.6), (0.4, 0.55, 0.05))


def estimate_reliabilities(patterns: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a vote pattern marks personal information, by expectation-maximisation per category.

    Starts from the vote sums; a labeler's outcomes are independent given the truth.
    """
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for category in CATEGORIES:
        votes = [v for c, v in patterns if c == category]
        if not votes:
            continue
        n = np.array([patterns[category, v] for v in votes], float)
        m = np.array(votes) + 1
        total = np.array([sum(v) + v[4] for v in votes], float)
        q = 1 / (1 + np.exp(-2.0 * (total - 0.5)))
        anchor = 0.1 * n.sum() + 1
        for _ in range(rounds):
            w1, w0 = n * q, n * (1 - q)
            prior = (w1.sum() + 1) / (n.sum() + 2)
            log1, log0 = np.full(len(votes), np.log(prior)), np.full(len(votes), np.log(1 - prior))
            for j in range(m.shape[1]):
                # the belief that labelers beat chance, as a tenth of the rows, keeps the classes from changing sides
                p1 = np.array([w1[m[:, j] == k].sum() + anchor * b for k, b in enumerate(BETTER_THAN_CHANCE[0])])
                p0 = np.array([w0[m[:, j] == k].sum() + anchor * b for k, b in enumerate(BETTER_THAN_CHANCE[1])])
                log1 += np.log(p1 / p1.sum())[m[:, j]]
                log0 += np.log(p0 / p0.sum())[m[:, j]]
            q = 1 / (1 + np.exp(np.clip(log0 - log1, -50, 50)))
        out.update({(category, v): float(x) for v, x in zip(votes, q)})
    return out


def train_classifier(rows: list[tuple[list[int], float]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic classifier over hashed features, fitted to posteriors with adaptive steps."""
    weights, squares = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-6)
    if not rows:
        return weights
    x = np.array([f for f, _ in rows])
    y = np.array([p for _, p in rows])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            p = 1 / (1 + np.exp(-weights[x[part]].sum(1)))
            grad = np.zeros_like(weights)
            np.add.at(grad, x[part].ravel(), np.repeat((p - y[part]) / len(part), x.shape[1]))
            at = np.flatnonzero(grad)
            grad[at] += decay * weights[at]
            squares[at] += grad[at] ** 2
            weights[at] -= rate * grad[at] / np.sqrt(squares[at])
    return weights


@dataclass
class Finder:
    """The trained model: gazetteer and classifier."""

    gazetteer: Gazetteer
    weights: np.ndarray

    def choose(self, proposed: list[tuple[str, int, int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """(category, begin, end, probability) of the mentions among proposed spans; of overlapping spans the likelier stays."""
        scored = [(c, a, b, float(1 / (1 + np.exp(-self.weights[f].sum())))) for c, a, b, f in proposed]
        kept: list[tuple[str, int, int, float]] = []
        for c in sorted((s for s in scored if s[3] >= 0.5), key=lambda s: (-s[3], s[1] - s[2], s[1])):
            if all(c[2] <= k[1] or c[1] >= k[2] for k in kept):
                kept.append(c)
        return sorted(kept, key=lambda s: s[1])

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """The mentions of a text."""
        return self.choose([(c, a, b, f) for c, a, b, _, f in candidates(text, self.gazetteer)])

    @staticmethod
    def redact(text: str, found: list[tuple[str, int, int, float]]) -> str:
        """The text with each mention replaced by the placeholder of its type."""
        out, at = [], 0
        for category, begin, end, _ in found:
            out += [text[at:begin], PLACEHOLDERS[category]]
            at = end
        return "".join([*out, text[at:]])


def learn_gazetteer(records: DataFrame, texts: DataFrame) -> Gazetteer:
    """The name words of person records that also occur in the texts; words that the texts mostly write in lower case are left out.

    So it is bounded by the words of the texts, not by the number of records. Names that occur once count as rare.
    Beginnings and endings that many family names share tell words composed like one.
    """
    names = records.select(F.explode_outer("names").alias("n"))
    given = names.select(F.explode(F.col("n.given")).alias("w")).select(F.lower(F.trim("w")).alias("w"), F.lit(1).alias("g"), F.lit(0).alias("f"))
    family = names.select(F.explode(F.split(F.lower(F.trim("n.family")), r"[-\s'’]+")).alias("w")).select("w", F.lit(0).alias("g"), F.lit(1).alias("f"))
    known = materialize(given.unionByName(family).where("length(w) > 2").groupBy("w").agg(F.sum("g").alias("g"), F.sum("f").alias("f")), "names")
    prose = F.regexp_replace("text", r"\S*[@_+]\S*", " ")  # addresses write names in lower case
    prose = F.regexp_replace(prose, rf"{_BREAK_JVM}", "")
    word = texts.select(F.explode(F.regexp_extract_all(prose, F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("w"))
    counts = materialize(word.groupBy("w").count().groupBy(F.lower("w").alias("k")).agg(F.sum(F.when(F.col("w") == F.lower("w"), F.col("count")).otherwise(0)).alias("low"), F.sum("count").alias("n")), "words")
    common = frozenset(counts.where("low >= 20 and low > 0.9 * n").select("k").toPandas()["k"])
    usual = frozenset(counts.where("low >= 3 and low > 0.1 * n").select("k").toPandas()["k"])
    there = known.join(counts.select(F.col("k").alias("w")), "w", "left_semi").toPandas()
    there = there[~there["w"].isin(common)]
    # a given name that some records hold as family name (swapped fields) stays a given name
    often = there["g"] + there["f"] >= 2
    as_given = there["g"] >= there["f"]
    cut = known.where("f >= 2 and f > g").join(counts.where("low >= 20 and low > 0.9 * n").select(F.col("k").alias("w")), "w", "left_anti")
    parts = cut.select(F.col("w"), F.explode(F.expr("if(length(w) > 4, sequence(3, length(w) - 2), array())")).alias("k")).select(F.expr("substring(w, 1, k)").alias("h"), F.expr("substring(w, k + 1)").alias("t"))
    heads, tails = (frozenset(parts.groupBy(c).count().where("count >= 6").select(c).toPandas()[c]) for c in ("h", "t"))
    towns = records.select(F.explode("addresses").alias("a")).select(F.lower(F.trim("a.city")).alias("w")).where("w <> ''").groupBy("w").count()
    towns = towns.withColumn("first", F.regexp_extract("w", r"(\p{L}{3,})", 1)).join(counts.select(F.col("k").alias("first")), "first", "left_semi").select("w").toPandas()
    return Gazetteer(frozenset(there["w"][often & as_given]), frozenset(there["w"][often & ~as_given]), frozenset(there["w"][~often]), frozenset(towns["w"]), heads, tails, usual)


_SPANS = "array<struct<category: string, a: long, b: long, votes: string, features: array<int>>>"


def propose(texts: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """(id, h, spans): the proposed spans of each text that has some; h is the hash of the text. Written once to the shared folder."""
    shared = texts.sparkSession.sparkContext.broadcast(gazetteer)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [[dict(zip(("category", "a", "b", "votes", "features"), (c, a, b, ",".join(map(str, v)), f))) for c, a, b, v, f in candidates(t, shared.value)] for t in pdf["text"]]
            some = [bool(r) for r in rows]
            yield pdf.loc[some, ["id", "h"]].assign(spans=[r for r in rows if r])

    return materialize(texts.select("id", F.xxhash64("text").alias("h"), "text").mapInPandas(spans, f"id string, h long, spans {_SPANS}"), "spans")


def learn(proposed: DataFrame, gazetteer: Gazetteer, max_texts: int = 4_000) -> Finder:
    """Reliabilities from the spans of all texts, and a classifier trained on those of at most ``max_texts`` texts chosen by a hash."""
    patterns = proposed.select(F.explode("spans").alias("s")).groupBy("s.category", "s.votes").count().collect()  # at most 3^5 per category
    posterior = estimate_reliabilities({(r.category, tuple(map(int, r.votes.split(",")))): r["count"] for r in patterns})
    chosen = proposed.select("id", "h", "spans").orderBy(F.xxhash64("id"), "id", "h").limit(max_texts)
    rows = chosen.select(F.explode("spans").alias("s")).select("s.*").toPandas()  # bounded by max_texts
    training = [(list(f), posterior[c, tuple(map(int, v.split(",")))]) for c, v, f in zip(rows["category"], rows["votes"], rows["features"])]
    return Finder(gazetteer, train_classifier(training))


def _texts(table: DataFrame) -> DataFrame:
    return table.where("id is not null and text is not null").select("id", "text").distinct()


def mentions(table: DataFrame, records: DataFrame, **bounds: int) -> DataFrame:
    """(id, category, start_pos, end_pos), distinct: the mentions of persons' data in ``text``.

    ``table`` needs id and text, ``records`` names and addresses for the gazetteer; other columns are ignored. Null
    ids and texts and empty texts have none. Repeated rows count once. Whole texts are searched, however long.
    """
    texts = _texts(table)
    gazetteer = learn_gazetteer(records, table.where("text is not null"))
    proposed = propose(texts, gazetteer)
    finder = texts.sparkSession.sparkContext.broadcast(learn(proposed, gazetteer, **bounds))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, c, a, b) for key, spans in zip(pdf["id"], pdf["spans"]) for c, a, b, _ in finder.value.choose([(s["category"], s["a"], s["b"], s["features"]) for s in spans])]
            yield pd.DataFrame(rows, columns=["id", "category", "start_pos", "end_pos"])

    return proposed.select("id", "spans").mapInPandas(find, "id string, category string, start_pos long, end_pos long").distinct()


def redact(table: DataFrame, records: DataFrame, **bounds: int) -> DataFrame:
    """(id, redacted_text), distinct: each text with typed placeholders; rows with a null id or text are left out, empty texts stay empty."""
    texts = _texts(table)
    gazetteer = learn_gazetteer(records, table.where("text is not null"))
    proposed = propose(texts, gazetteer)
    finder = texts.sparkSession.sparkContext.broadcast(learn(proposed, gazetteer, **bounds))

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                out.append(text if spans is None else finder.value.redact(text, finder.value.choose([(s["category"], s["a"], s["b"], s["features"]) for s in spans])))
            yield pd.DataFrame({"id": pdf["id"], "redacted_text": out})

    joined = texts.withColumn("h", F.xxhash64("text")).join(proposed, ["id", "h"], "left")
    return joined.select("id", "text", "spans").mapInPandas(replace, "id string, redacted_text string")
