"""Sentence boundaries in any script, by a hidden-event n-gram model and forward-backward posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import cut, spread

# Signs of writing systems.
END = ".!?…。！？｡।॥؟۔։။።"
CLOSE = "\"'”“»’)]}」』）］｝〉》】*_`~>"
OPEN = "\"'“„«‘([{「『（［｛〈《【¿¡*_`~<"
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", '"': '"'}
# End.

EMPTY_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
BARE = re.compile(r"[฀-໿ក-៿က-႟]")  # scripts whose sentences are parted by blanks only
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|\\[A-Za-z]+\*?|\$[^$\n]+\$|&[#A-Za-z0-9]{1,8};")
TAGGED = re.compile(r"[<\\$&]")
CJK_END = re.compile(r"[。！？｡…!?]+[」』）］｝〉》】”’\"*_`~]*")
DIGITS = re.compile(r"[0-9०-९๐-๙٠-٩]+")
BRACKET = re.compile("[" + re.escape("".join(sorted(set(PAIRS) | set(PAIRS.values())))) + "]")
CLOSERS = "»”)]"
ENDING = re.compile(f"[{re.escape(END)}]")
REPEATED = re.compile(r"(.)\1{3,}")
TAIL = re.compile(rf"([{re.escape(END)}]+)([{re.escape(CLOSE)}]*)$")

#: Distinct words and whole contexts kept in a model: those that reach this share of the whole count.
VOCABULARY = 50_000
CONTEXTS = 200_000
ROUNDS = 6
#: Longer tokens are no words: whatever they are, they count as their shape.
LONG_WORD = 40
#: Stands for any previous word; with a shape behind it, for any word of that shape.
ANY = "\x02"
#: How much less likely a sentence of one or two tokens is than a longer one.
SHORT = {1: 0.02, 2: 0.3}


def _word(token: str) -> str:
    """A token's identity to the model: without markup and opening signs, digits as one 9; the shape of a very long one."""
    bare = TAG.sub("", token) if TAGGED.search(token) else token
    bare = bare.lstrip(OPEN).rstrip(CLOSE)
    word = DIGITS.sub("9", bare) or token[:1]
    return word if len(word) <= LONG_WORD else _shape(word)


def _signs(text: str) -> str:
    """End signs, of which more than three equal ones in a row count as three."""
    return REPEATED.sub(r"\1\1\1", text)


def _mark(token: str) -> tuple[str, str] | None:
    """(identity, end signs) of a token that may end a sentence, else None."""
    if not ENDING.search(token):
        return None
    bare = TAG.sub("", token) if TAGGED.search(token) else token
    found = TAIL.search(bare)
    if not found:
        return None
    word = DIGITS.sub("9", bare[: found.start()].lstrip(OPEN))
    signs = _signs(found.group(1) + "".join(c for c in found.group(2) if c not in "*_`~>'"))
    if len(word) == 1 and word.isupper():
        word = "X"
    return (word if len(word) <= LONG_WORD else _shape(word)), signs


def _shape(word: str) -> str:
    """The class that stands for a word too rare to be kept."""
    if not word:
        return ""
    kind = "9" if word[0].isdigit() else "X" if word[0].isupper() else "x" if word[0].isalpha() else word[0]
    return f"\x01{kind}{'9' if kind != '9' and any(map(str.isdigit, word)) else ''}"


def _class(word: str) -> str:
    """All words of a word's shape, kept or not."""
    return ANY + (word if word[:1] == "\x01" else _shape(word))


def _inside(text: str) -> list[tuple[int, int]]:
    """Spans within matched brackets and quotation marks, outermost only: in order and apart from each other."""
    stack: list[tuple[str, int]] = []
    awaited: Counter[str] = Counter()
    spans: list[tuple[int, int]] = []
    for sign in BRACKET.finditer(text):
        char, i = sign.group(), sign.start()
        if awaited[char]:
            while stack[-1][0] != char:
                awaited[stack.pop()[0]] -= 1
            _, start = stack.pop()
            awaited[char] -= 1
            while spans and spans[-1][0] >= start:
                spans.pop()
            spans.append((start, i))
        elif char in PAIRS:
            stack.append((PAIRS[char], i))
            awaited[PAIRS[char]] += 1
    return spans


class Spans:
    """Is a growing position within a span?  Spans and positions are walked side by side."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans, self.at = spans, 0

    def hold(self, end: int, lead: int) -> bool:
        """Does a span that begins before ``end - lead`` go on at ``end``?"""
        while self.at < len(self.spans) and self.spans[self.at][1] < end:
            self.at += 1
        return self.at < len(self.spans) and self.spans[self.at][0] < end - lead


def _spaced(text: str) -> tuple[list[tuple[int, str, str, str, str, int]], str, tuple[str, str, str]]:
    """Candidates (end, previous, current, signs, next, tokens since the last), first word, last context.

    A token with an end sign is looked for from the end of the one before, and no token between
    them holds an end sign, so the first hit is its place.
    """
    spans = Spans(_inside(text))
    tokens = text.split()
    out, before, end, last = [], -1, 0, ("", "", "")
    for i, token in enumerate(tokens):
        closer = None
        if ENDING.search(token):
            end = text.find(token, end) + len(token)
            if i + 1 < len(tokens) and not tokens[i + 1].strip(CLOSERS):
                continue
            mark = _mark(token)
        elif i and token[0] in CLOSERS and not token.strip(CLOSERS) and (closer := _mark(tokens[i - 1])):
            end = text.find(token, end) + len(token)
            mark = (closer[0], _signs(closer[1] + token))
        else:
            continue
        if mark and not spans.hold(end, 1):
            behind = i - (2 if closer else 1)
            previous = _word(tokens[behind]) if behind >= 0 else ""
            if i + 1 < len(tokens):
                out.append((end, previous, *mark, _word(tokens[i + 1]), i - before))
                before = i
            else:
                last = (previous, *mark)
    return out, _word(tokens[0]) if tokens else "", last


def _chars(text: str, at: int) -> str:
    """Identity of what follows a boundary in a script without blanks."""
    while at < len(text) and (text[at].isspace() or text[at] in OPEN):
        at += 1
    if at >= len(text):
        return ""
    return text[at] if CJK.match(text[at]) else _shape(text[at]) + "c"


def _dense(text: str):
    spans, out, last, before = Spans(_inside(text)), [], ("", "", ""), 0
    for m in CJK_END.finditer(text):
        if spans.hold(m.end(), 1):
            continue
        signs = _signs(m.group().rstrip("*_`~"))
        follows = _chars(text, m.end())
        if follows:
            out.append((m.end(), "", "", signs, follows, 3 + m.end() - before))
            before = m.end()
        else:
            last = ("", "", signs)
    return out, _chars(text, 0), last


def _blank(text: str):
    """Every blank may part sentences; these scripts part no words, so four letters on either side of it stand for them."""
    tokens = [(m.end(), m.group()) for m in re.finditer(r"\S+", text)]
    first = lambda t: w[:4] if BARE.match(w := _word(t)) else _shape(w) + "b"
    final = lambda t: w[-4:] if BARE.match(w := _word(t)) else _shape(w) + "b"
    spans, out = Spans(_inside(text)), []
    for i, (end, token) in enumerate(tokens[:-1]):
        if spans.hold(end, 0):
            continue
        previous = final(tokens[i - 1][1]) if i else ""
        out.append((end, previous, final(token), " ", first(tokens[i + 1][1]), 3))
    last = (final(tokens[-2][1]) if len(tokens) > 1 else "", final(tokens[-1][1]), " ") if tokens else ("", "", "")
    return out, first(tokens[0][1]) if tokens else "", last


def _read(paragraph: str):
    if paragraph.isascii() or not (BARE.search(paragraph) or CJK.search(paragraph)):
        return _spaced(paragraph)
    letters = sum(map(str.isalpha, paragraph)) or 1
    if 3 * len(BARE.findall(paragraph)) > letters:
        return _blank(paragraph)
    if 3 * len(CJK.findall(paragraph)) > letters:
        return _dense(paragraph)
    return _spaced(paragraph)


def _paragraphs(text: str) -> Iterator[tuple[int, str]]:
    start = 0
    for gap in EMPTY_LINE.finditer(text):
        yield start, text[start: gap.start()]
        start = gap.end()
    yield start, text[start:]


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of contexts; a paragraph's first word and last signs are events that were seen."""
    counts: Counter[tuple[str, str, str, str, str]] = Counter()

    def emit() -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["seen", "previous", "current", "signs", "following", "n"])

    for batch in batches:
        for text in batch["text"]:
            for _, paragraph in _paragraphs(text):
                candidates, first, last = _read(paragraph)
                counts.update(("", p, c, s, f) for _, p, c, s, f, _ in candidates)
                if first:
                    counts["start", "", "", "", first] += 1
                if last[2]:
                    counts["end", *last, ""] += 1
        if len(counts) > 200_000:
            yield emit()
            counts.clear()
    if counts:
        yield emit()


def _known(kept: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in ("previous", "current", "following"):
                batch[c] = [w if w in kept or w[:1] == "\x01" else _shape(w) for w in batch[c]]
            yield batch.groupby(["seen", "previous", "current", "signs", "following"], as_index=False)["n"].sum()

    return run


def _events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts too rare to be kept whole, once as events without the next word and once as next words without the previous one."""
    for batch in batches:
        event, word = batch.copy(), batch[batch["seen"] == ""].copy()
        event["following"] = [_class(f) if not s else f for s, f in zip(event["seen"], event["following"])]
        event["seen"] = [s or "event" for s in event["seen"]]
        word["seen"], word["previous"] = "word", ANY
        yield pd.concat([event, word])


def _lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events without their previous word, next words after the shape of the current one."""
    for batch in batches:
        batch["previous"] = ANY
        batch["current"] = [_class(c) if s == "word" else c for s, c in zip(batch["seen"], batch["current"])]
        yield batch


def _with_classes(event: dict[tuple, tuple[float, float]], *words: dict[str, float]) -> None:
    """Add the sums of all words of a shape, which rows backed off to shapes look up."""
    for counts in words:
        for word, n in list(counts.items()):
            counts[_class(word)] = counts.get(_class(word), 0.0) + n
    for (order, *key), (b, n) in list(event.items()):
        if order == "c":
            shaped = ("c", _class(key[0]), key[1])
            x, y = event.get(shaped, (0.0, 0.0))
            event[shaped] = (x + b, y + n)


@dataclass
class Model:
    """Event probabilities by context and word probabilities after a boundary and after none."""

    kept: frozenset[str] = frozenset()
    event: dict[tuple, tuple[float, float]] = field(default_factory=dict)
    start: dict[str, float] = field(default_factory=dict)
    inner: dict[str, float] = field(default_factory=dict)
    total: tuple[float, float] = (1.0, 1.0)

    def known(self, word: str) -> str:
        return word if word in self.kept or word[:1] == "\x01" else _shape(word)

    def boundary(self, previous: str, current: str, signs: str) -> float:
        """P(boundary | words before), each order backed off to the next lower."""
        p = 0.5
        for key, weight in ((("s", signs), 2.0), (("c", current, signs), 3.0), (("p", previous, current, signs), 4.0)):
            b, n = self.event.get(key, (0.0, 0.0))
            p = (b + weight * p) / (b + n + weight)
        return min(max(p, 1e-6), 1 - 1e-6)

    def odds(self, previous: str, current: str, signs: str, following: str) -> tuple[float, float]:
        """Weights of a boundary and of none at a candidate."""
        p = self.boundary(previous, current, signs)
        size = len(self.kept) + 20
        after = (self.start.get(following, 0.0) + 0.1) / (self.total[0] + 0.1 * size)
        free = (self.inner.get(following, 0.0) + 0.1) / (self.total[1] + 0.1 * size)
        return p * after, (1 - p) * free


def _keys(previous: str, current: str, signs: str) -> tuple[tuple, ...]:
    """The events of a context, lowest order first."""
    low = ("s", signs), ("c", current, signs)
    return low if previous == ANY else (*low, ("p", previous, current, signs))


def fit(rows: list[tuple[str, str, str, str, str, int]], kept: frozenset[str]) -> Model:
    """Expectation-maximisation from paragraph edges, the only boundaries that are seen.

    Rows seen as ``event`` count for boundaries only and rows seen as ``word`` for next words only.
    """
    model = Model(kept)
    backed = any(r[0] in ("event", "word") for r in rows)
    starts: Counter[str] = Counter()
    words: Counter[str] = Counter()
    ends: Counter[tuple] = Counter()
    totals: Counter[tuple] = Counter()
    for seen, previous, current, signs, following, n in rows:
        if seen == "start":
            starts[following] += n
            continue
        for key in _keys(previous, current, signs) if seen != "word" else ():
            totals[key] += n
            if seen == "end":
                ends[key] += n
        if seen in ("", "word"):
            words[following] += n
    model.start, model.inner = dict(starts), {w: max(n - 4.0 * starts[w], 0.0) for w, n in words.items()}
    model.total = (sum(model.start.values()) or 1.0, sum(model.inner.values()) or 1.0)
    model.event = {k: (min(n, 4.0 * ends[k]), n - min(n, 4.0 * ends[k])) for k, n in totals.items()}
    for _ in range(ROUNDS):
        if backed:
            _with_classes(model.event, model.start, model.inner)
        event: dict[tuple, list[float]] = {}
        start: Counter = Counter(starts)
        inner: Counter = Counter()
        for seen, previous, current, signs, following, n in rows:
            if seen == "start":
                continue
            if seen == "end":
                share = 1.0
            else:
                b, w = model.odds(previous, current, signs, following)
                share = b / (b + w)
            if seen in ("", "word"):
                start[following] += n * share
                inner[following] += n * (1 - share)
            for key in _keys(previous, current, signs) if seen != "word" else ():
                e = event.setdefault(key, [0.0, 0.0])
                e[0] += n * share
                e[1] += n * (1 - share)
        model.event = {k: (b, n) for k, (b, n) in event.items()}
        model.start, model.inner = dict(start), dict(inner)
        model.total = (sum(start.values()) or 1.0, sum(inner.values()) or 1.0)
    return model


def posteriors(model: Model, candidates: list[tuple[int, str, str, str, str, int]]) -> list[float]:
    """Forward-backward over the candidates of a paragraph; states: a boundary is here, or not."""
    odds = [model.odds(model.known(p), model.known(c), s, model.known(f)) for _, p, c, s, f, _ in candidates]
    forward, backward = [], [(1.0, 1.0)] * len(odds)
    b, n = 1.0, 0.0
    for (x, y), candidate in zip(odds, candidates):
        short = SHORT.get(candidate[5], 1.0)
        b, n = (b * short + n) * x, (b + n) * y
        b, n = b / (b + n), n / (b + n)
        forward.append((b, n))
    for i in range(len(odds) - 2, -1, -1):
        x, y = odds[i + 1]
        short = SHORT.get(candidates[i + 1][5], 1.0)
        fb, fn = backward[i + 1]
        pb, pn = short * x * fb + y * fn, x * fb + y * fn
        backward[i] = (pb / (pb + pn), pn / (pb + pn))
    return [f[0] * g[0] / (f[0] * g[0] + f[1] * g[1]) for f, g in zip(forward, backward)]


def split(model: Model, text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of one text; they hold all of its characters that are not blank."""
    out = []
    for offset, paragraph in _paragraphs(text or ""):
        candidates = _read(paragraph)[0]
        start = 0
        for stop in [c[0] for c, p in zip(candidates, posteriors(model, candidates)) if p >= 0.5] + [len(paragraph)]:
            piece = paragraph[start:stop]
            if bare := piece.strip():
                left = offset + start + len(piece) - len(piece.lstrip())
                out.append((left, left + len(bare)))
            start = stop
    return out


def train(documents: DataFrame, text: str = "text") -> Model:
    """Count the contexts of all texts, back the rare ones off and fit the model.

    Words and whole contexts must reach 1 / ``VOCABULARY`` and 1 / ``CONTEXTS`` of their total count.
    No count is dropped: a rarer word counts as its shape; a rarer context counts as (previous,
    current, signs, shape of the next word) for boundaries and as (current, signs, next word) for
    words, and below the limit again as (current, signs, shape) and (shape, signs, next word).  So
    the rows that reach the driver are bounded by kept words, signs and shapes, whatever the input.
    """
    texts = spread(documents.select(F.col(text).alias("text")).filter("text is not null and text <> ''"))
    schema = "seen string, previous string, current string, signs string, following string, n long"
    raw = texts.mapInPandas(_contexts, schema)
    keys = ["seen", "previous", "current", "signs", "following"]
    raw = cut(raw.groupBy(*keys).agg(F.sum("n").alias("n")))
    words = raw.select(F.explode(F.array("previous", "current", "following")).alias("w"), "n").filter("w <> '' and not startswith(w, '\x01')")
    total = words.agg(F.sum("n")).first()[0] or 0
    kept = words.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(3, total // VOCABULARY))
    kept = frozenset(r["w"] for r in kept.select("w").collect())
    coded = raw.mapInPandas(_known(kept), schema).groupBy(*keys).agg(F.sum("n").alias("n"))
    total = raw.agg(F.sum("n")).first()[0] or 0
    limit = max(1, total // CONTEXTS)
    if limit > 1:
        coded = cut(coded)
        whole = (F.col("n") >= limit) | (F.col("seen") == "start")
        lower = cut(coded.filter(~whole).mapInPandas(_events, schema).groupBy(*keys).agg(F.sum("n").alias("n")))
        lowest = lower.filter(F.col("n") < limit).mapInPandas(_lowest, schema).groupBy(*keys).agg(F.sum("n").alias("n"))
        coded = coded.filter(whole).unionByName(lower.filter(F.col("n") >= limit)).unionByName(lowest)
    return fit(sorted(tuple(r) for r in coded.collect()), kept)


def sentences(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence, start_pos, end_pos) of every sentence, numbered from 0 within its text.

    Null, empty and blank texts have no sentences; very long texts are read whole, paragraph by
    paragraph; repeated rows are split each on their own; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *span) for k, t in zip(batch["key"], batch["text"]) for i, span in enumerate(split(shared.value, t))]
            yield pd.DataFrame(rows, columns=["key", "sentence", "start_pos", "end_pos"])

    kind = documents.schema[key].dataType.simpleString()
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null and text <> ''"))
    found = rows.mapInPandas(run, f"key {kind}, sentence int, start_pos int, end_pos int")
    return found.withColumnRenamed("key", key)
