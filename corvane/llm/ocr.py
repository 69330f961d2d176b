"""Noise in text from scanned pages.

A noisy-channel model: a read word comes from a true word by character confusions, and true words follow a
bigram model counted over the whole corpus. The probabilities of the confusions are estimated from the corpus
by expectation-maximisation over the words that only scanned texts have. Per line, candidate words are decoded
by Viterbi. Running headers are lines that recur at page tops across the corpus or within a text, and lines
there made of the words that such lines are made of; page numbers and divided words are found in the line structure.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# What a misread piece may have been in the original, with the probability that the estimation starts from.
CONFUSIONS = {
    "0": (("o", 0.002),), "1": (("l", 0.002), ("i", 0.0005)), "5": (("s", 0.002),), "9": (("g", 0.001),), "8": (("b", 0.0005),),
    "6": (("b", 0.0003), ("g", 0.0002)), "ﬁ": (("fi", 0.001),), "ﬂ": (("fl", 0.001),), "ﬀ": (("ff", 0.001),), "†": (("t", 0.001),), "à": (("a", 0.001),), "$": (("s", 0.0005),), "@": (("a", 0.0002),), "|": (("l", 0.0005), ("i", 0.0005)),
    "c": (("e", 0.002),), "e": (("c", 0.0002), ("o", 0.0001)), "l": (("i", 0.002), ("t", 0.0001)), "i": (("l", 0.0005), ("j", 0.0001)), "b": (("h", 0.001),), "h": (("b", 0.0003),),
    "ri": (("n", 0.002),), "n": (("ri", 0.0002), ("u", 0.0002)), "rn": (("m", 0.002),), "m": (("rn", 0.002),), "cl": (("d", 0.002),), "d": (("cl", 0.0003),),
    "ii": (("u", 0.002),), "u": (("ii", 0.0001), ("n", 0.0002)), "vv": (("w", 0.002),), "w": (("vv", 0.0001),), "o": (("e", 0.0001), ("a", 0.0002)), "a": (("o", 0.0001),), "f": (("t", 0.0001),), "t": (("f", 0.0001), ("l", 0.0001)),
    "q": (("g", 0.0001),), "g": (("q", 0.0001),), "v": (("y", 0.0001),), "y": (("v", 0.0001),), "in": (("m", 0.0005),), "nn": (("m", 0.0002),), "tl": (("d", 0.0001),), "li": (("h", 0.0002),), "o1": (("d", 0.0001),),
}
_ODD = "à†ﬁﬂﬀ"
_DIGIT_OF = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "g": "9"}
HYPHENS = "-­‐¬"

_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_EDGE = "\"'“”‘’.,;:!?()[]{}<>*#=_/\\-–—…•"
_PAGE = re.compile(r"[-–—\[(\s]*(?:p[a-zà]?[gq9]?[ec]?[.:]?|seite)?\s*(?:[0-9OIlSB]{1,4}|[ivxl]{1,6})(?:\s*(?:of|/|0f|von)\s*[0-9OIlSB]{1,4})?[-–—\])\s]*\.?", re.I)
_ROMAN = re.compile(r"(?:x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_DIVIDED = re.compile(rf"([^\W\d_†]|[^\W_])[{HYPHENS}][ \t]*$")
_NUMBER_LIKE = re.compile(r"[0-9OoIlSsB|]+(?:[.,:][0-9OoIlSsB|]+)*")
_LOWER_WORD = re.compile(r"(?:^|(?<=\s))[a-zà-öø-ÿ]")
_WRAP_END = re.compile(rf"[^\W_A-Z{{}}†,(/@{HYPHENS}]\s*$|[,{HYPHENS}†(/@]\s*$")
_WRAP_BEGIN = re.compile(r"\s*[^\W_A-Z†$(]|\s*[†$(]")
#: Widest line of a wrapped page.
WRAP_WIDTH = 110
#: Slots of the pair counts.
_PAIR_BITS = 22


def is_page_number(line: str) -> bool:
    """Whether a line holds only a page number: 7, - 7 -, [7], p. 7/9, Page 7 of 9 or vii."""
    s = line.strip(" \t\x0c\r")
    if not s or len(s) > 20 or not _PAGE.fullmatch(s):
        return False
    core = re.sub(r"^[\W_]*(?:p[^\W\d]{0,3}|seite)?[.:\s]+", "", s, flags=re.I).strip("-–—[]() .")
    if any(c.isdigit() for c in s):
        return True
    return bool(core) and core.islower() and bool(_ROMAN.fullmatch(core))


def is_titled(s: str) -> bool:
    """Whether a stripped line reads like a header or heading: three quarters of its words don't begin in lower case, and no sentence ends it."""
    return 0 < len(s) <= 90 and s[-1] not in ".,;:" and s[-1] not in HYPHENS and len(_LOWER_WORD.findall(s)) * 4 <= len(s.split())


def fold_line(line: str) -> str:
    """A line without case, numbers and the differences that misreadings make, to recognise it again."""
    s = _SPACE.sub(" ", line.strip().lower())
    s = re.sub(r"\s*\|?\s*p[aà][gq9][ec]\s+\S{1,4}$", "", s)
    s = " ".join("#" if sum(c.isdigit() for c in w) * 2 > len(w) else w for w in s.split(" "))
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w")):
        s = s.replace(a, b)
    return s.translate(str.maketrans("0o159$†àeihl|", "aalsgstaclbll"))


_LINE_END = re.compile(r"\r\n|\n|\r|\x0c")


def lines_of(text: str) -> list[tuple[int, str]]:
    """(offset, line) of a text; form feeds end lines too."""
    out, at = [], 0
    for m in _LINE_END.finditer(text):
        out.append((at, text[at : m.start()]))
        at = m.end()
    out.append((at, text[at:]))
    return out


def is_scanned(text: str) -> bool:
    """Whether a text is wrapped into lines within its sentences, as a scanned page is; one line in twenty may be wider than a page."""
    if "\n" not in text and "\r" not in text and "\x0c" not in text:
        return False
    lines = [s for s in _LINE_END.split(text) if s and not s.isspace()]
    if sum(len(s) > WRAP_WIDTH for s in lines) * 20 > len(lines):
        return False
    return any(len(a) >= 25 and "|" not in a and len(a.strip()) >= 25 and _WRAP_BEGIN.match(b) and _WRAP_END.search(a) for a, b in zip(lines, lines[1:]))


def pair_slot(before: str, word: str) -> int:
    """The slot of a pair of words in the table of pair counts."""
    return crc32(f"{before} {word}".encode()) & ((1 << _PAIR_BITS) - 1)


class Corpus:
    """What the corpus knows: word counts, pair counts by slot, lines that recur at page tops, and confusions."""

    def __init__(self, words: dict[str, float], pairs: tuple[np.ndarray, np.ndarray], headers: frozenset[str], headings: frozenset[str], header_words: frozenset[str], confusions: dict[str, tuple[tuple[str, float], ...]]):
        self.words, self.headers, self.headings, self.header_words, self.confusions = words, headers, headings, header_words, confusions
        self.sorted = sorted(words)
        self.total = sum(words.values()) + 1.0
        self.slots, self.pair_counts = pairs  # slots in order
        self.cache: dict[str, list[tuple[str, float]]] = {}
        self.pair_cache: dict[tuple[str, str], float] = {}
        self.token_cache: dict[str, tuple] = {}
        self.fold_cache: dict[str, str] = {}

    def unigram(self, word: str) -> float:
        return (self.words.get(word, 0.0) + 0.01) / self.total

    def bigram(self, before: str | None, word: str) -> float:
        """log P(word | before), interpolated."""
        if before is None:
            return math.log(self.unigram(word))
        if (known := self.pair_cache.get((before, word))) is not None:
            return known
        p = base = self.unigram(word)
        if (first := self.words.get(before)) is not None:
            c = 0.0
            if word in self.words:
                slot = pair_slot(before, word)
                k = int(self.slots.searchsorted(slot))
                c = float(self.pair_counts[k]) if k < len(self.slots) and self.slots[k] == slot else 0.0
            p = 0.6 * min(1.0, c / max(first, 0.05)) + 0.4 * base
        value = math.log(max(p, 1e-12))
        if len(self.pair_cache) > 500_000:
            self.pair_cache.clear()
        self.pair_cache[before, word] = value
        return value

    def begins_word(self, prefix: str) -> bool:
        k = bisect_left(self.sorted, prefix)
        return k < len(self.sorted) and self.sorted[k].startswith(prefix)

    def readings(self, low: str) -> dict[str, tuple[float, tuple[tuple[str, str], ...]]]:
        """Known words other than ``low`` that may stand behind it, with log channel probability and the confusions used."""
        odd = {k for k, c in enumerate(low) if not c.isalpha() and c not in "-'’" or c in _ODD}
        known_word = low in self.words
        limit = 0 if len(low) < 3 and not odd else 1 if known_word else 2
        found: dict[str, tuple[float, tuple[tuple[str, str], ...]]] = {}
        if not limit:
            return found
        limit = max(limit, len(odd) + (0 if known_word else 1))
        stack: list[tuple[str, int, tuple[tuple[str, str], ...], float]] = [("", 0, (), 0.0)]
        while stack:
            done, at, edits, cost = stack.pop()
            if at == len(low):
                if edits and done in self.words and (done not in found or cost > found[done][0]):
                    found[done] = (cost, edits)
                continue
            c = low[at]
            if at not in odd:
                stack.append((done + c, at + 1, edits, cost))
            if len(edits) < limit:
                for piece in (c, low[at : at + 2]):
                    for original, p in self.confusions.get(piece, ()):
                        # only beginnings of known words go on
                        if (len(piece) == 1 or at + 1 < len(low)) and self.begins_word(done + original):
                            stack.append((done + original, at + len(piece), (*edits, (piece, original)), cost + math.log(p)))
        return found

    def candidates(self, token: str) -> list[tuple[str, float]]:
        """(lower-case word, log channel probability) that may stand behind a read token."""
        low = token.lower()
        if (known := self.cache.get(low)) is not None:
            return known
        odd = [k for k, c in enumerate(low) if not c.isalpha() and c not in "-'’" or c in _ODD]
        found = {} if odd else {low: 0.0}
        found |= {w: cost for w, (cost, _) in self.readings(low).items()}
        if odd and not found:  # no known word: the likeliest reading of each odd character
            guess = "".join(max(self.confusions[c], key=lambda x: x[1])[0] if k in odd and c in self.confusions else c for k, c in enumerate(low))
            found[guess if _WORD.fullmatch(guess) else low] = 0.0
        out = sorted(found.items(), key=lambda x: -x[1])
        if len(self.cache) > 300_000:
            self.cache.clear()
        self.cache[low] = out
        return out

    def decode(self, options: list[list[tuple[str, float]]], before: str | None = None) -> list[str]:
        """The likeliest of the words of each place, by Viterbi; places with one word part the line into separate paths."""
        out = [o[0][0] for o in options]
        k, n = 0, len(options)
        while k < n:
            if len(options[k]) == 1:
                k += 1
                continue
            end = k
            while end < n and len(options[end]) > 1:
                end += 1
            left = out[k - 1] if k else before
            column = [(self.bigram(left, w) + c, (w,)) for w, c in options[k]]
            for choices in options[k + 1 : end]:
                column = [max(((s + self.bigram(path[-1], w) + c, (*path, w)) for s, path in column), key=lambda x: x[0]) for w, c in choices]
            if end < n:  # the word that follows decides as well
                column = [(s + self.bigram(path[-1], out[end]), path) for s, path in column]
            out[k:end] = max(column, key=lambda x: x[0])[1]
            k = end
        return out

    def token(self, token: str) -> tuple:
        """(offset of the core, core, right number or None, options or None, whether a sentence ends, whether nothing can be wrong) of a token."""
        if (known := self.token_cache.get(token)) is not None:
            return known
        core = token.strip(_EDGE)
        offset, fixed, options = (token.find(core) if core else 0), None, None
        usual = bool(core) and not ("@" in core and "." in core or "_" in core or "://" in core)
        ends = token[-1:] in (".!?:" if usual else ".!?")
        if usual:
            fixed = repair_number(core)
            if fixed is None and sum(c.isdigit() for c in core) * 2 < len(core) and (_WORD.fullmatch(core) or all(c.isalpha() or c in CONFUSIONS or c in "-'’" for c in core)) and any(c.isalpha() for c in core):
                options = self.candidates(core)
        plain = fixed is None and (options is None or len(options) == 1 and options[0][0] == core.lower())
        if len(self.token_cache) > 500_000:
            self.token_cache.clear()
        self.token_cache[token] = out = (offset, core, fixed, options, ends, plain)
        return out

    def fold(self, line: str) -> str:
        if (known := self.fold_cache.get(line)) is None:
            if len(self.fold_cache) > 100_000:
                self.fold_cache.clear()
            self.fold_cache[line] = known = fold_line(line)
        return known


def repair_number(token: str) -> str | None:
    """The number behind a token in which letters stand for digits, or None."""
    if not _NUMBER_LIKE.fullmatch(token) or token.isdigit():
        return None
    letters = [c for c in token if c.isalpha()]
    digits = [c for c in token if c.isdigit()]
    if not letters or not digits and token not in ("IO", "lO", "SO", "IOO", "lOO"):
        return None
    if re.fullmatch(r"\d{8}[A-Z]|\d{1,4}[bB]|[A-Z]\d{6,}", token):  # identity numbers and house numbers keep their letter
        return None
    return "".join(_DIGIT_OF.get(c, c) for c in token)


def _cased(word: str, token: str, starts: bool) -> str:
    letters = [c for c in token if c.isalpha() and c not in _ODD]
    if len(letters) > 1 and sum(c.isupper() for c in letters) >= 0.6 * len(letters) and not letters[-1].islower():
        return word.upper()
    first = token[0]
    if first.isalpha() and first != "†":
        return word[0].upper() + word[1:] if first.isupper() and not (first == "I" and word[0] == "l") else word
    return word[0].upper() + word[1:] if first == "$" or starts else word


def made_of(folded: str, words: frozenset[str]) -> bool:
    """Whether most words of a folded line are among ``words``, and at least two of them."""
    own = _WORD.findall(folded)
    known = sum(w in words for w in own)
    return known >= 2 and known * 4 >= len(own) * 3


def faults(text: str, corpus: Corpus) -> list[tuple[str, int, str]]:
    """(kind, start, repaired) of the faults of a scanned text."""
    out: list[tuple[str, int, str]] = []
    lines = lines_of(text)
    titled = [is_titled(line.strip()) for _, line in lines]
    folded = [corpus.fold(line) if t else "" for (_, line), t in zip(lines, titled)]
    often = Counter(f for f in folded if f)
    body: list[tuple[int, str]] = []
    top = True  # at the top of a page
    for (at, line), f, title in zip(lines, folded, titled):
        s = line.strip()
        if not s:
            continue
        if len(s) <= 20 and is_page_number(line):
            out.append(("page_number", at + line.index(s), ""))
            top = True
            continue
        if title and f not in corpus.headings and s.count(" | ") < 2:
            recurs = often[f] > 1 and top and len(f) > 8
            if f in corpus.headers or recurs or top and made_of(f, corpus.header_words):
                visible = at + line.index(s)
                out.append(("header", visible, ""))
                out += [("misread", a, w) for a, w in _misread([(visible, s)], corpus)]
                continue
        top = False
        body.append((at, line))
    # words divided at line ends
    used: set[int] = set()
    starts_at: dict[int, int] = {}
    for k in range(len(body) - 1):
        at, line = body[k]
        stripped = line.rstrip()
        if stripped[-1:] not in HYPHENS or not _DIVIDED.search(stripped):
            continue
        head = re.search(r"\S+$", stripped).group().lstrip(_EDGE)
        tail = re.match(r"\s*(\S+)", body[k + 1][1]).group(1)
        rest = tail.rstrip(_EDGE)
        if not head[:-1] or not rest or not any(c.isalpha() for c in head) or "|" in stripped or not (rest[0].isalpha() or rest[0] in CONFUSIONS):
            continue
        first = stripped.rindex(head)
        if (k, first) in starts_at.items():
            continue
        if any(c.isdigit() for c in head[-2:-1]) and not rest[0].islower():
            continue
        out.append(("hyphen", at + first, _joined(head[:-1], rest, corpus)))
        used |= {at + first, body[k + 1][0] + body[k + 1][1].index(tail)}
    out += [("misread", a, w) for a, w in _misread(body, corpus) if a not in used]
    return out


def _joined(a: str, b: str, corpus: Corpus) -> str:
    """The whole word of two pieces: with or without a hyphen of its own, misreadings repaired."""
    best, value = a + b, -1e9
    for glued in (a + b, f"{a}-{b}"):
        if _WORD.fullmatch(glued) and glued.lower() in corpus.words:
            score = math.log(corpus.unigram(glued.lower()))
            word = glued
        else:
            options = [(w, c) for w, c in corpus.candidates(glued) if w in corpus.words]
            if not options:
                continue
            w, c = max(options, key=lambda x: x[1] + math.log(corpus.unigram(x[0])))
            score, word = c + math.log(corpus.unigram(w)), _cased(w, glued, False)
        if score > value:
            best, value = word, score
    if value == -1e9:
        if a[:1].isupper() and b[:1].isupper() and not a.isupper():
            return f"{a}-{b}"
        parts = [p.lower() for p in (a.split("-")[-1], b.split("-")[0])]
        if all(p in corpus.words and len(p) > 3 for p in parts) and corpus.unigram(parts[0]) > 1e-5 and corpus.unigram(parts[1]) > 1e-5:
            return f"{a}-{b}"
    return best


def _misread(body: list[tuple[int, str]], corpus: Corpus) -> Iterator[tuple[int, str]]:
    """(start, right word) of the words and numbers with wrong characters, line by line."""
    before: str | None = None
    sentence = True
    known, own = corpus.token_cache, corpus.token
    for at, line in body:
        row = [known.get(t) or own(t) for t in line.split()]
        if all(t[5] for t in row):  # nothing can be wrong on this line
            for t in reversed(row):
                if t[3] is not None:
                    before = t[3][0][0]
                    break
            sentence = row[-1][4] if row else sentence
            continue
        cores, places, starts, options = [], [], [], []
        for m, (offset, core, fixed, choices, ends, _) in zip(_TOKEN.finditer(line), row):
            if fixed is not None:
                yield at + m.start() + offset, fixed
            elif choices is not None:
                cores.append(core)
                places.append(at + m.start() + offset)
                starts.append(sentence)
                options.append(choices)
            sentence = ends
        if not options:
            continue
        words = corpus.decode(options, before)
        before = words[-1]
        for core, place, start, word in zip(cores, places, starts, words):
            if word != core.lower():
                yield place, _cased(word, core, start)


def repaired_text(text: str, found: list[tuple[str, int, str]]) -> str:
    """Continuous paragraphs: furniture dropped, words joined and corrected, lines of a paragraph in one."""
    drop = {s for kind, s, _ in found if kind in ("header", "page_number")}
    fix = {s: w for kind, s, w in found if kind == "misread"}
    whole = {s: w for kind, s, w in found if kind == "hyphen"}
    paragraphs: list[list[str]] = [[]]
    skip_piece, gap = False, False
    for at, line in lines_of(text):
        if not line.strip():
            gap = True
            continue
        if at + len(line) - len(line.lstrip()) in drop:
            continue
        words = []
        for m in _TOKEN.finditer(line):
            token = m.group()
            if skip_piece:  # the rest of a divided word; punctuation after it stays
                tail = token[len(token.rstrip(_EDGE)) :]
                words.append("\0" + tail)
                skip_piece = False
                continue
            core = token.strip(_EDGE)
            begin = at + m.start() + max(0, token.find(core))
            if begin in whole and m.end() == len(line.rstrip()):
                words.append(token[: token.find(core)] + whole[begin])
                skip_piece = True
            elif begin in fix:
                words.append(token.replace(core, fix[begin], 1))
            else:
                words.append(token)
        row = " ".join(words)
        last = paragraphs[-1][-1] if paragraphs[-1] else ""
        ends = not last or last[-1] in ".!?:" or last.isupper() or "|" in last
        if (gap and ends) or (last and (last.isupper() or "|" in row or row.isupper())):
            paragraphs.append([])
        paragraphs[-1].append(row)
        gap = False
    return "\n".join(" ".join(p).replace(" \0", "") for p in paragraphs if p)


_DIVIDED_WORD = re.compile(rf"[^\W\d_]+[{HYPHENS}][ \t]*[\n\r\x0c]+\s*\S+")
_PART = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, key, slot, clean, scanned): words, lines and slots of pairs of a partition, already summed per thousand texts."""
    for pdf in batches:
        for begin in range(0, len(pdf), 1000):
            sums: dict[str, tuple[Counter, Counter]] = {k: (Counter(), Counter()) for k in ("word", "pair", "line", "top")}
            for text in pdf["text"].iloc[begin : begin + 1000]:
                scanned, top, seen, tops = int(is_scanned(text)), True, set(), set()
                for line in _LINE_END.split(text):
                    s = line.strip()
                    if not s:
                        continue
                    if scanned and len(s) <= 20 and is_page_number(line):
                        top = True
                    elif (top or not scanned) and is_titled(s):
                        f = fold_line(s)
                        seen.add(f)
                        if top and scanned:
                            tops |= set(_WORD.findall(f))
                        top = False
                    else:
                        top = False
                sums["line"][scanned].update(seen)
                sums["top"][scanned].update(tops)
                if scanned:
                    text = _DIVIDED_WORD.sub(" ", text)
                words = _PART.findall(text.lower())
                sums["word"][scanned].update(words)
                sums["pair"][scanned].update(zip(words, words[1:]))
            for kind in ("word", "line", "top"):
                clean, read = sums[kind]
                keys = [w for w in {**clean, **read} if not w[:1].isdigit() or kind == "line"]
                if keys:  # pandas takes a column of no keys for numbers, which can't be sent as strings
                    yield pd.DataFrame({"kind": kind, "key": keys, "slot": -1, "clean": [clean[w] for w in keys], "scanned": [read[w] for w in keys]})
            clean, read = sums["pair"]
            keys = [p for p in {**clean, **read} if not p[0][0].isdigit() and not p[1][0].isdigit()]
            if keys:
                slots = pd.DataFrame({"kind": "pair", "key": "", "slot": [pair_slot(*p) for p in keys], "clean": [clean[p] for p in keys], "scanned": [read[p] for p in keys]})
                yield slots.groupby(["kind", "key", "slot"], as_index=False).sum()[["kind", "key", "slot", "clean", "scanned"]]


def _expected(words: DataFrame, corpus: Corpus) -> dict[tuple[str, str], float]:
    """How often each confusion is expected to have happened, given the current model, over the words that only scanned texts have."""
    none = np.zeros(0, np.int32), np.zeros(0, np.float32)
    shared = words.sparkSession.sparkContext.broadcast(Corpus(corpus.words, none, frozenset(), frozenset(), frozenset(), corpus.confusions))

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, sums = shared.value, Counter()
        for pdf in batches:
            for word, n in zip(pdf["key"], pdf["scanned"]):
                ways = [(math.exp(cost) * c.unigram(w), edits) for w, (cost, edits) in c.readings(word).items()]
                # an unknown word may also be right as it is
                total = sum(p for p, _ in ways) + c.unigram(word) * (1 if word in c.words else 1e-3)
                for p, edits in ways:
                    for e in edits:
                        sums[e] += n * p / total
        yield pd.DataFrame([(a, b, x) for (a, b), x in sums.items()], columns=["piece", "original", "n"])

    rows = words.select("key", "scanned").mapInPandas(expect, "piece string, original string, n double").groupBy("piece", "original").agg(F.sum("n").alias("n"))
    return {(r.piece, r.original): r.n for r in rows.collect()}  # at most the pairs of CONFUSIONS


def learn(texts: DataFrame, rounds: int = 2) -> Corpus:
    """The model of a corpus (column ``text``), with the counts of all texts.

    Pair counts are summed in a table of fixed size, where rare pairs may share a slot; every word of a clean text
    and every word of three or more scanned ones is known, which is the vocabulary of the language. ``rounds`` of
    expectation-maximisation estimate how often each confusion happens to the pieces it can happen to.
    """
    counts = materialize(texts.select("text").mapInPandas(_count, "kind string, key string, slot long, clean long, scanned long").groupBy("kind", "key", "slot").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned")), "counts")
    known = (F.col("clean") > 0) | (F.col("scanned") >= 3) & ~F.col("key").rlike(f"[{_ODD}]")
    words = counts.where(F.col("kind") == "word")
    vocabulary = words.where(known).select("key", "clean", "scanned").toPandas()
    # a word that only scanned texts have may be a misreading and weighs little
    table = dict(zip(vocabulary["key"], (vocabulary["clean"] + 0.05 * vocabulary["scanned"]).tolist()))
    # a pair that occurs once may be what is to be judged itself
    slots = counts.where("kind = 'pair' and clean + scanned >= 2").select("slot", (F.col("clean") + 0.05 * F.col("scanned")).cast("float").alias("n")).toPandas()  # at most the slots
    order = np.argsort(slots["slot"].to_numpy(), kind="stable")
    pairs = slots["slot"].to_numpy(np.int32)[order], slots["n"].to_numpy(np.float32)[order]
    lines = counts.where("kind = 'line'").where((F.col("scanned") >= 3) & (F.col("clean") * 20 <= F.col("scanned")) | (F.col("clean") >= 2) & (F.col("clean") * 20 > F.col("scanned"))).select("key", (F.col("clean") * 20 <= F.col("scanned")).alias("header")).toPandas()
    headers = frozenset(lines["key"][lines["header"]])
    # words of recurring headers, unless other lines at page tops have them as often
    of_headers = Counter(w for f in headers for w in set(_WORD.findall(f)))
    tops = counts.where("kind = 'top' and scanned >= 3").join(words.select("key", F.col("clean").alias("elsewhere"), F.col("scanned").alias("all")), "key", "left").where("scanned * 2 >= all").select("key").toPandas()
    header_words = frozenset(w for w in tops["key"] if w in of_headers)
    corpus = Corpus(table, pairs, headers, frozenset(lines["key"][~lines["header"]]), header_words, CONFUSIONS)
    totals = {o: float((vocabulary["scanned"] * vocabulary["key"].str.count(re.escape(o))).sum()) for o in {o for ways in CONFUSIONS.values() for o, _ in ways}}
    unknown = words.where("clean = 0 and scanned > 0")
    for _ in range(rounds):
        n = _expected(unknown, corpus)
        # the starting probability counts as a thousand characters
        corpus.confusions = {piece: tuple((o, (n.get((piece, o), 0.0) + 1000 * p) / (totals[o] + n.get((piece, o), 0.0) + 1000)) for o, p in ways) for piece, ways in CONFUSIONS.items()}
        corpus.cache.clear()
    return corpus


def scanned_faults(candidates: DataFrame) -> DataFrame:
    """(id, kind, start_pos, repaired), distinct: the faults of the scanned texts, once per id.

    ``candidates`` needs id and text; other columns are ignored. Null and empty texts and texts that don't look
    scanned have none. Of an id with several texts each text is searched. Whole texts are searched, however long.
    """
    texts = candidates.where("id is not null and text is not null and trim(text) <> ''").select("id", "text").distinct()
    corpus = texts.sparkSession.sparkContext.broadcast(learn(texts))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, *f) for key, text in zip(pdf["id"], pdf["text"]) if is_scanned(text) for f in faults(text, corpus.value)]
            yield pd.DataFrame(rows, columns=["id", "kind", "start_pos", "repaired"])

    return texts.mapInPandas(find, "id string, kind string, start_pos long, repaired string").distinct()


def repair(candidates: DataFrame) -> DataFrame:
    """(id, scanned, repaired_text), distinct: each text, with those of scanned pages as continuous paragraphs."""
    texts = candidates.where("id is not null and text is not null").select("id", "text").distinct()
    corpus = texts.sparkSession.sparkContext.broadcast(learn(texts))

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scanned = [is_scanned(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "scanned": scanned, "repaired_text": [repaired_text(t, faults(t, corpus.value)) if s else t for t, s in zip(pdf["text"], scanned)]})

    return texts.mapInPandas(mend, "id string, scanned boolean, repaired_text string")


