"""One consistent form for texts that look the same: quick-check, normalise unstable segments, splice."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("аеорсухіјѕԁһԛԝӏАВЕКМНОРСТУХІЈЅԚԜ", "aeopcyxijsdhqwlABEKMHOPCTYXIJSQW"))
GREEK = dict(zip("αικνορυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aikvopuxyABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("օսհոցզԼՍՏՕ", "ouhngqLUSO"))
CHEROKEE = dict(zip("ᎪᎬᎳᎷᎻᏀᏃᏙᏚᏢᏤᏦᏒᏟ", "AEWMHGZVSPVKRC"))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE
#: Only letters whose lower-case look is unmistakable are turned back from Latin.
BACK = {"Cyrillic": {v: k for k, v in CYRILLIC.items() if v in "aeopcyxijsABEKMHOPCTYX"}, "Greek": {v: k for k, v in GREEK.items() if v in "ovABEZHIKMNOPTYX"}}
#: Scripts that are told apart; of the last two no letter is ever put in place of a Latin one.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
#: Compatibility forms that are another width or kind of the same sign; superscripts and the like differ in look.
SAME_SIGN = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
# End.

MARK = regex.compile(r"\p{M}")
WORD = regex.compile(r"[\p{L}\p{M}]+")
#: What need not be looked at: runs of stable characters, by far the most of any text.
PLAIN = regex.compile(r"^[\n\x20-\x7e]*$")


def _usual(char: str) -> str:
    """One step towards the usual form of a character that has no canonical decomposition."""
    category = unicodedata.category(char)
    if category == "Cf" or char in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or "\ufe00" <= char <= "\ufe0f":
        return ""
    if category == "Zs" or char in "\u2028\u2029\x0b\x0c\x85\t":
        return " "
    if category == "Cc":
        return char if char in "\n\r" else ""
    if char in "\u2010\u2011":
        return "-"
    kind = unicodedata.decomposition(char).split(" ")[0]
    if kind in SAME_SIGN or (kind == "<compat>" and category[0] in "LN" and char != "ſ"):
        return unicodedata.normalize("NFKC", char)
    return char


@lru_cache(maxsize=200_000)
def _folded(char: str) -> str:
    """The usual form of one character, without context; itself where it is already usual.

    The parts of a composed character are folded one by one and again until nothing changes, so a
    letter and its composed form end alike.
    """
    parts = unicodedata.normalize("NFD", char)
    folded = parts
    while (after := unicodedata.normalize("NFD", "".join(map(_usual, folded)))) != folded:
        folded = after
    return char if folded == parts and unicodedata.is_normalized("NFC", char) else unicodedata.normalize("NFC", folded)


@lru_cache(maxsize=200_000)
def _unstable(char: str) -> bool:
    """Quick-check property: may the character change, alone or with its neighbours?"""
    return char > "~" and (char in LOOKALIKE or _folded(char) != char or unicodedata.combining(char) > 0 or not unicodedata.is_normalized("NFC", char) or bool(MARK.match(char)) or "\u1161" <= char <= "\u11c2") or (char < " " and char not in "\n")


def _script(char: str) -> str:
    name = unicodedata.name(char, "")
    return next((s for s in SCRIPTS if name.startswith(s.upper())), "")


def _word(word: str, home: str) -> str:
    """Give a word of mixed scripts its own letters back; words of one script stay as they are.

    The exception is a word of Cyrillic look-alikes only in a text that has no other Cyrillic; a
    lone Greek letter is taken for a symbol.
    """
    count: dict[str, int] = {}
    for char in word:
        if s := _script(char):
            count[s] = count.get(s, 0) + 1
    if set(count) == {"Cyrillic"} and home == "Latin" and all(c in CYRILLIC or MARK.match(c) for c in word):
        return "".join(CYRILLIC.get(c, c) for c in word)
    other = next((s for s in SCRIPTS[1:] if s in count), "")
    if not other or "Latin" not in count or len(count) > 2:
        return word if len(count) < 3 else "".join(LOOKALIKE.get(c, c) for c in word)
    foreign = [c for c in word if _script(c) == other]
    to_latin = all(c in LOOKALIKE for c in foreign)
    back = BACK.get(other, {})
    to_other = all(c in back for c in word if _script(c) == "Latin")
    if to_latin and to_other:
        to_latin = home != other if home in ("Latin", "Cyrillic", "Greek") else count["Latin"] >= count[other]
    if to_latin and (other != "Greek" or count["Latin"] >= 2):
        return "".join(LOOKALIKE.get(c, c) for c in word)
    if to_other and not to_latin and (other == "Cyrillic" or count[other] > 2 * count["Latin"]):
        return "".join(back.get(c, c) if _script(c) == "Latin" else c for c in word)
    return word


def _home(text: str) -> str:
    """The script of the value: of its letters that cannot be taken for another script's."""
    sure = dict.fromkeys(SCRIPTS, 0)
    for char in text:
        if char.isalpha() and char not in LOOKALIKE and (s := _script(char)):
            sure[s] += char.lower() not in "aeopcyxijs"
    best = max(sure, key=sure.__getitem__)
    if best == "Latin" and sure["Cyrillic"]:
        return "mixed"
    return best if sure[best] else ""


def canonical(text: str | None) -> str | None:
    """The consistent form of one text; null stays null, and spelling, case and plain blanks stay too.

    The rewriting of unstable segments is repeated until nothing changes, so the form of a form is
    itself; should segments ever take turns, the smallest of these texts is the form.
    """
    seen = [text]
    while (after := _rewritten(text)) != text:
        if after in seen:
            return min(seen[seen.index(after):])
        seen.append(text := after)
    return text


def _rewritten(text: str | None) -> str | None:
    """One pass: unstable characters are found first; each is widened to a segment that ends at stable
    characters, words and their marks being kept whole, and only the segments are rewritten."""
    if not text or PLAIN.match(text):
        return text
    spots = [i for i, char in enumerate(text) if (char > "~" or char < " ") and _unstable(char)]
    if not spots:
        return text
    home, out, done = None, [], 0
    for spot in spots:
        if spot < done:
            continue
        start = end = spot
        while start > done and (text[start - 1].isalpha() or _unstable(text[start - 1])):
            start -= 1
        if start == spot and start > done and MARK.match(text[spot]):
            start -= 1
        end += 1
        while end < len(text) and (text[end].isalpha() or _unstable(text[end])):
            end += 1
        segment = unicodedata.normalize("NFC", "".join(_folded(c) for c in text[start:end]))
        if any(c in LOOKALIKE for c in segment):
            home = _home(unicodedata.normalize("NFC", "".join(map(_folded, text)))) if home is None else home
            segment = unicodedata.normalize("NFC", WORD.sub(lambda m: _word(m.group(), home), segment))
        out += [text[done:start], segment]
        done = end
    return "".join([*out, text[done:]])


def _canonical_series(values: pd.Series) -> pd.Series:
    return values.map(canonical, na_action="ignore")


def canonical_text(column: Column | str) -> Column:
    """Column form of :func:`canonical`, Arrow-batched."""
    return pandas_udf(_canonical_series, "string")(F.col(column) if isinstance(column, str) else column)


def _changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["canonical"] = [canonical(v) for v in batch["value"]]
        yield batch


def canonical_values(values: DataFrame) -> DataFrame:
    """Add ``canonical`` to a table with a string column ``value``, keeping all other columns.

    Values of plain ASCII are stable and never leave the JVM; the rest goes through Python in
    Arrow batches.  Nulls stay null, empty values empty; repeated rows stay repeated.  A column
    that was named ``canonical`` before is replaced.
    """
    values = values.drop("canonical")
    stable = F.col("value").isNull() | F.col("value").rlike(r"^[\n -~]*$")
    schema = values.schema.simpleString()[len("struct<"):-1] + ",canonical:string"
    fixed = values.filter(~stable).mapInPandas(_changed, schema)
    return values.filter(stable).withColumn("canonical", F.col("value")).unionByName(fixed)
