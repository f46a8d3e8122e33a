"""Canonical form of a short request, and whether two of them ask the same.

Writing, politeness, the order of phrases and the notation of dates and times don't matter; words and values do.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .wordhash import fold

#: Italian names of the months, and phrases of greeting and politeness.
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
POLITE = (
    "per favore", "per cortesia", "per piacere", "per gentilezza", "grazie mille", "mille grazie", "grazie tante", "grazie", "se puoi", "se possibile", "se riesci", "quando puoi", "appena puoi",
    "ti prego", "ti ringrazio", "cortesemente", "gentilmente", "ehi", "ehila", "hey", "ciao", "salve", "buongiorno", "buonasera", "buon giorno", "buona sera", "scusa", "scusami", "senti",
)
#: Letters from which a word may have two slips.
LONG = 7
_POLITE = tuple(tuple(p.split()) for p in sorted(POLITE, key=lambda p: -len(p.split())))
#: The places of the polite phrases that begin with a word, longer ones first.
_BEGINNING = {w: [k for k, p in enumerate(_POLITE) if p[0] == w] for w in {p[0] for p in _POLITE}}

_TIME_WORD = r"(?:d?all?e|d?all'|ore|h|per le|entro le|verso le)"
_CLOCK = re.compile(r"(?<![\w/@])(\d{1,2})\s*(?:[:h]\s*|\s+e\s+)(\d{2})(?![\d/])")
_POINT_CLOCK = re.compile(rf"({_TIME_WORD}\s*(?:ore\s+)?)(\d{{1,2}})\.(\d{{2}})(?!\d|\.\d)")
_HOUR = re.compile(r"((?:d?all?e|ore)\s+(?:ore\s+)?)(\d{1,2})(?=[\s?!.,;]|$)(?!\s*[/:.h]\s*\d)(?!\s+e\s+\d)")
_FULL = re.compile(r"(?<![\w.:@])(\d{1,2})\s?[/.-]\s?(\d{1,2})(?:[/.-](\d{4}|\d{2}))?\b(?![/:]\d)")
_NAMED = re.compile(r"(?<![\d:.])(\d{1,2})\s*(?:°|º|o\b)?\s+(?:di\s+)?([a-z]{3,14})\b\.?")
_FIRST = re.compile(r"\b(?:primo|1°|1º)(?=\s+[a-z]{3})")
_DAY = re.compile(r"(?:\b(?:il|del|per il|di)\s+(?:giorno\s+)?|\bgiorno\s+|\bl')(?=@d)")
_NUMBERS = re.compile(r"(?<![@\d:/])\d[\d\s.\-/]*\d(?!\S*:)|\d+")
_TOKEN = re.compile(r"@\S+|[^\W_]+")
_CUT_VOWEL = re.compile(r"(?<=[aeiou])'(?=[\s?!.,;]|$)")
_ORE, _TAIL, _VALUE = re.compile(r"\bore\s+(?=@t)"), re.compile(r"(@[dt][\d:/]*\d)\S*"), re.compile(r"(@[dt][\d:/]+)")
_DIGIT, _NO_DIGIT = re.compile(r"\d"), re.compile(r"\D")
_APOSTROPHES = str.maketrans({"\u2019": "'", "\u2018": "'", "`": "'"})


def squeeze(word: str) -> str:
    """Without repetitions of a letter right after itself."""
    return re.sub(r"([^\W\d_])\1+", r"\1", word)


def same_but_for_slip(a: str, b: str) -> bool:
    """Equal, or equal but for slips of the keyboard: letters doubled, left out, or swapped with a neighbour.

    One slip is allowed, in words of `LONG` letters two. A letter in place of another is no slip, for that may be
    another value; digits never differ.
    """
    if a == b:
        return True
    if any(c.isdigit() for c in a + b) or min(len(a), len(b)) < 3:
        return False
    x, y = squeeze(a), squeeze(b)
    if x == y:
        return True
    if abs(len(x) - len(y)) > 2:
        return False
    if any(_one_slip(p, q) for p, q in {(a, b), (x, y), (a, y), (x, b)}):
        return True
    if len(x) > len(y):
        x, y = y, x
    # y loses or swaps first; the second slip must not put a letter back
    return len(y) >= LONG and any(len(z) >= len(x) and _one_slip(x, z) for z in _slips(y))


def _slips(word: str) -> set[str]:
    """Words with one letter fewer or two neighbours swapped."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}


def _one_slip(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :]
    return a[i:] == b[i + 1 :]


@lru_cache(100_000)
def _month(word: str) -> int:
    """Its number, of a month's name, its abbreviation, or either with a slip; 0 of another word."""
    for k, m in enumerate(MONTHS, 1):
        if word == m or 3 <= len(word) <= 4 and m.startswith(word):
            return k
    for k, m in enumerate(MONTHS, 1):
        if len(word) >= 4 and same_but_for_slip(word, m):
            return k
    return 0


def _named(m: re.Match) -> str:
    month = _month(m[2])
    return f"@d{int(m[1])}/{month}" if month and 1 <= int(m[1]) <= 31 else m[0]


def _full(m: re.Match) -> str:
    day, month = int(m[1]), int(m[2])
    if not (1 <= day <= 31 and 1 <= month <= 12):
        return m[0]
    return f"@d{day}/{month}" + (f"/{int(m[3]) % 100}" if m[3] else "")


@lru_cache(100_000)
def _polite_words(word: str) -> frozenset[str]:
    """The words of polite phrases that a word is, or is but for a slip."""
    return frozenset(q for p in _POLITE for q in p if word == q or len(q) > 3 and same_but_for_slip(word, q))


def _drop_polite(words: list[str]) -> list[str]:
    may = list(map(_polite_words, words))
    if not any(may):
        return words
    out, i = [], 0
    while i < len(words):
        for k in sorted(k for w in may[i] for k in _BEGINNING.get(w, ())):
            n = len(_POLITE[k])
            if n == 1 or i + n <= len(words) and all(q in m for q, m in zip(_POLITE[k], may[i:])):
                i += n
                break
        else:
            out.append(words[i])
            i += 1
    return out


@lru_cache(100_000)
def _together(word: str) -> bool:
    return word == "con" or same_but_for_slip(word, "insieme")


def _values(t: str) -> str:
    """A folded text with its dates, times and numbers written as values."""
    if "primo" in t or "1°" in t or "1º" in t:
        t = _FIRST.sub("1", t)
    t = _NAMED.sub(_named, t)
    if "." in t:
        t = _POINT_CLOCK.sub(lambda m: f"{m[1]}@t{int(m[2])}:{m[3]}", t)
    t = _CLOCK.sub(lambda m: f"@t{int(m[1])}:{m[2]}" if int(m[1]) < 25 and int(m[2]) < 60 else m[0], t)
    t = _FULL.sub(_full, t)
    t = _HOUR.sub(lambda m: f"{m[1]}@t{int(m[2])}:00", t)
    if "@" in t:
        t = _TAIL.sub(r" \1 ", _ORE.sub("", _DAY.sub("", t)))
    if "@" not in t:
        return _NUMBERS.sub(_number, t)
    return "".join(p if p[:1] == "@" else _NUMBERS.sub(_number, p) for p in _VALUE.split(t))


def _number(m: re.Match) -> str:
    return " @n" + _NO_DIGIT.sub("", m[0]) + " "


def canonical(prompt: str | None) -> tuple[list[str], list[str]]:
    """(values: dates, times and numbers, in order; the other words, phrases of company last) of a request."""
    if not prompt:
        return [], []
    t = fold(prompt).translate(_APOSTROPHES)
    if "'" in t:
        t = _CUT_VOWEL.sub("", t)
    t = " ".join(t.split())
    if _DIGIT.search(t) or "primo" in t or "@" in t:
        t = _values(t)
    words = _drop_polite(_TOKEN.findall(t))
    values = sorted(w for w in words if w[0] == "@")
    groups, own = [], []
    for w in words:
        if w[0] == "@":
            groups.append(own)
            own = []
        else:
            own.append(w)
    groups.append(own)
    # what follows the last "con" or "insieme" of each stretch between values is a phrase of its own
    request, phrases = [], []
    for g in groups:
        cut = max((i for i, w in enumerate(g) if _together(w)), default=None)
        tail: list[str] = []
        if cut is not None:
            tail, g = g[cut:], g[:cut]
        if tail and tail[-1] in ("alle", "dalle", "ale", "dale"):
            g, tail = [*g, tail[-1]], tail[:-1]
        request += g
        phrases += [tail] if tail else []
    return values, [w for p in sorted(phrases) for w in p] + request


def same_request(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]]) -> bool:
    """Whether two canonical forms have the same values and, in any order of phrases, the same words but for slips."""
    if a[0] != b[0] or len(a[1]) != len(b[1]):
        return False
    left, right = sorted(a[1]), sorted(b[1])
    only_a, only_b, i, j = [], [], 0, 0
    while i < len(left) or j < len(right):
        if j == len(right) or i < len(left) and left[i] < right[j]:
            only_a.append(left[i])
            i += 1
        elif i == len(left) or right[j] < left[i]:
            only_b.append(right[j])
            j += 1
        else:
            i, j = i + 1, j + 1
    for w in only_a:
        match = next((v for v in only_b if same_but_for_slip(w, v)), None)
        if match is None:
            return False
        only_b.remove(match)
    return True
