"""Parts of personal and collaboration names, and the edit metric between them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from quarry.llm.canonical_text import canonical

# Words around names, in their folded forms.
PARTICLES = frozenset("van der den de di da del della dos du la le von zu zum zur ter ten bin ibn al el af av".split())
TITLES = frozenset("dr prof professor mr mrs ms sir dame herr frau jr sr phd md".split())
BODIES = frozenset("collaboration collab coll group team consortium experiment".split())
OTHERS = frozenset({"et al", "and others", "others", "u a", "и др", "y otros", "et autres", "und andere", "and rest", "the rest", "anon", "anonymous", "unknown", "na", "n a", "none", "and the rest"})
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "al": "albert", "bert": "albert", "andy": "andrew", "drew": "andrew", "tony": "anthony", "toni": "anthony",
    "ben": "benjamin", "benny": "benjamin", "bill": "william", "billy": "william", "will": "william", "willy": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert",
    "charlie": "charles", "chuck": "charles", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david", "dick": "richard", "rick": "richard", "rich": "richard",
    "dima": "dmitri", "mitya": "dmitri", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "fran": "francisco", "paco": "francisco", "pancho": "francisco", "frank": "francis",
    "fred": "frederick", "freddy": "frederick", "gabi": "gabriela", "gaby": "gabriela", "gianni": "giovanni", "nino": "giovanni", "hans": "johannes", "hannes": "johannes", "jan": "johannes", "hank": "henry", "harry": "henry",
    "jack": "john", "johnny": "john", "jim": "james", "jimmy": "james", "jamie": "james", "joe": "joseph", "joey": "joseph", "pepe": "jose", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kolya": "nikolai", "nick": "nicholas",
    "larry": "lawrence", "len": "leonard", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "matt": "matthew", "max": "maximilian", "mike": "michael", "mick": "michael", "misha": "mikhail",
    "pat": "patricia", "pete": "peter", "petya": "petr", "ron": "ronald", "sam": "samuel", "steve": "stephen", "sue": "susanna", "susie": "susanna", "suzy": "susanna", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "volodya": "vladimir", "vova": "vladimir", "lucy": "lucia", "uschi": "ursula", "irka": "irina", "ira": "irina", "kostya": "konstantin", "lyosha": "alexei", "beppe": "giuseppe", "pino": "giuseppe", "nacho": "ignacio", "manolo": "manuel", "quique": "enrique",
}
LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})
# End.

INITIAL = re.compile(r"^(?:[^\W\d_]\.?-?)$")


def fold(text: str) -> str:
    """Lower-case letters without accents of the consistent form of a text."""
    lowered = unicodedata.normalize("NFKD", (canonical(text) or "").lower())
    return "".join(c for c in lowered if not unicodedata.combining(c)).translate(LETTERS)


def _parts(text: str) -> list[str]:
    """Given names and initials in order; ``J.D.``, ``J. D.`` and ``Zoe-Tove B.`` fall into their pieces."""
    out = []
    for word in re.findall(r"[^\W\d_]+", text):
        if word not in TITLES:
            out.append(word)
    return out


def surname_key(words: list[str]) -> str:
    """Surname without particles, with the two spellings of umlauts made one."""
    joined = "-".join(w for w in words if w not in PARTICLES) or "-".join(words)
    return re.sub(r"aa", "a", re.sub(r"(?<![aeiou])([aou])e", r"\1", joined))


@lru_cache(maxsize=100_000)
def _is_given(word: str, known: frozenset[str]) -> bool:
    return word in known or word in NICKNAMES


def parse_name(name: str | None, given: frozenset[str] = frozenset()) -> tuple[str, str, tuple[str, ...]] | None:
    """(kind, surname or body, given parts) of a name as people type it, or None if it names nobody.

    Kinds are ``person`` and ``body``.  ``given`` holds folded words known as given names; it tells
    ``Last First`` from ``First Last`` where there is no comma.
    """
    if not name:
        return None
    raw = " ".join((canonical(name) or "").split())
    text = fold(name)
    plain = " ".join(re.findall(r"[^\W_]+", text))
    if not plain or plain in OTHERS or not any(map(str.isalpha, plain)):
        return None
    words = plain.split()
    if BODIES & set(words) and len(words) > 1:
        rest = [w for w in words if w not in BODIES and w not in ("the", "on", "behalf", "of", "for")]
        return ("body", " ".join(rest), ()) if rest else None
    if "," in text:
        last, _, first = text.partition(",")
        last_words = [w for w in re.findall(r"[^\W\d_]+", last) if w not in TITLES]
        return ("person", surname_key(last_words), tuple(_parts(first))) if last_words else None
    tokens = [t for t in re.findall(r"[^\s,]+", text) if t.strip(".") not in TITLES]
    shown = [t for t in re.findall(r"[^\s,]+", raw) if fold(t).strip(".") not in TITLES]
    if not tokens:
        return None
    if len(tokens) == 1:
        return "person", surname_key(re.findall(r"[^\W\d_]+", tokens[0])), ()
    letters = [re.findall(r"[^\W\d_]+", t) for t in tokens]
    initials = [all(len(p) == 1 for p in ls) if ls else True for ls in letters]
    start = next((i for i, t in enumerate(tokens) if t in PARTICLES), None)
    if start:  # particles open the surname, which then runs to the end unless given names follow
        body, first = tokens[start:], tokens[:start]
    elif initials[-1]:  # Last F.M.
        cut = next(i for i in range(len(tokens)) if all(initials[i:]))
        body, first = tokens[:cut] or tokens[-1:], tokens[cut:]
    elif start == 0:
        cut = next((i for i in range(1, len(tokens)) if tokens[i - 1] not in PARTICLES), 1)
        body, first = tokens[: cut], tokens[cut:]
        if not first:
            body, first = tokens, []
    elif initials[0]:  # F. M. Last
        cut = next(i for i in range(len(tokens)) if not initials[i])
        body, first = tokens[cut:], tokens[:cut]
    else:
        upper = [len(s) > 2 and s.isupper() for s in shown]
        known = [_is_given(ls[0] if ls else "", given) for ls in letters]
        if len(shown) == len(tokens) and any(upper) and not all(upper):
            body = [t for t, u in zip(tokens, upper) if u]
            first = [t for t, u in zip(tokens, upper) if not u]
        elif known[-1] and not known[0]:
            body, first = tokens[:1], tokens[1:]
        elif not known[0] and len(tokens) > 2 and known[1]:
            body, first = tokens[:1], tokens[1:]
        else:
            body, first = tokens[-1:], tokens[:-1]
    body_words = [w for t in body for w in re.findall(r"[^\W\d_]+", t)]
    return ("person", surname_key(body_words), tuple(_parts(" ".join(first)))) if body_words else None


def edit_distance(a: str, b: str, most: int = 1 << 30) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions, a true metric; more than ``most`` may come out as ``most`` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    m, n, big = len(a), len(b), len(a) + len(b)
    seen: dict[str, int] = {}
    table = [[big] * (n + 2) for _ in range(m + 2)]
    for i in range(m + 1):
        table[i + 1][1] = i
    for j in range(n + 1):
        table[1][j + 1] = j
    for i in range(1, m + 1):
        last, row, above, x = 0, table[i + 1], table[i], a[i - 1]
        for j in range(1, n + 1):
            k, l = seen.get(b[j - 1], 0), last
            cost = 1
            if x == b[j - 1]:
                cost, last = 0, j
            row[j + 1] = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, table[k][l] + i - k + j - l - 1)
        seen[x] = i
    return table[m + 1][n + 1]


def within_one(a: str, b: str) -> bool:
    """Is the edit distance at most 1?  The same metric, without its table."""
    if a == b:
        return True
    m, n = len(a), len(b)
    if abs(m - n) > 1:
        return False
    i = 0
    while i < m and i < n and a[i] == b[i]:
        i += 1
    if m == n:
        return a[i + 1:] == b[i + 1:] or (i + 1 < m and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2:] == b[i + 2:])
    return a[i + 1:] == b[i:] if m > n else a[i:] == b[i + 1:]


def same_part(a: str, b: str) -> bool:
    """May two given parts be one name: equal, short for one, an initial of the other, or one edit apart?"""
    full_a, full_b = NICKNAMES.get(a, a), NICKNAMES.get(b, b)
    if a == b or full_a == full_b:
        return True
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0] or full_a[0] == full_b[0]
    return min(len(a), len(b)) >= 3 and within_one(a, b) or (len(a) > 4 < len(b) and a[:2] == b[:2] and (a.startswith(b) or b.startswith(a)))


def compatible(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """May two lists of given parts be the same person's?  Missing parts agree with anything."""
    return all(same_part(x, y) for x, y in zip(a, b))


def levenshtein(text: str, pattern: str) -> int:
    """Levenshtein distance by bit vectors, for titles."""
    if not pattern:
        return len(text)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top, score = (1 << len(pattern)) - 1, 1 << len(pattern) - 1, len(pattern)
    plus, minus = ones, 0
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & ones
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 | 1
        plus = (mh << 1 | ~(xv | ph)) & ones
        minus = ph & xv & ones
    return score
