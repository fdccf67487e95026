"""TeX sources to numbered, anchored blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Commands and environments with a meaning of their own, accents.
SECTION = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}
MATH = "equation align gather multline eqnarray".split()
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327", "v": "\u030c", "=": "\u0304", ".": "\u0307", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "aa": "å", "AA": "Å", "i": "ı"}
# End.


def braced(text: str, at: int) -> tuple[str, int]:
    """The group that opens at ``at`` and the place after it; the rest of the text if it never closes."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{" and (i == 0 or text[i - 1] != "\\"):
            depth += 1
        elif text[i] == "}" and text[i - 1] != "\\":
            depth -= 1
            if not depth:
                return text[at + 1: i], i + 1
    return text[at + 1:], len(text)


def accents(text: str) -> str:
    """TeX accents and letters as characters."""
    import unicodedata

    text = re.sub(r"\\(" + "|".join(sorted(LETTERS, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\}|\s)?", lambda m: LETTERS[m[1]], text)
    put = lambda m: unicodedata.normalize("NFC", m[2].replace("ı", "i") + ACCENTS[m[1]])
    text = re.sub(r"\\(['`^\"~=.])\{?([A-Za-zı])\}?", put, text)
    return re.sub(r"\\([cvuHkr])\{([A-Za-z])\}", put, text)


def macros(text: str) -> tuple[dict[str, tuple[int, str]], str]:
    """User commands {name: (arity, body)} and the text without their definitions."""
    found, out, at = {}, [], 0
    for m in re.finditer(r"\\(?:re)?newcommand\*?\s*\{?\\([A-Za-z]+)\}?\s*(?:\[(\d)\])?\s*(?=\{)", text):
        if m.start() < at:
            continue
        body, end = braced(text, m.end())
        found[m[1]] = (int(m[2] or 0), body)
        out.append(text[at: m.start()])
        at = end
    return found, "".join(out) + text[at:]


def expand(text: str, known: dict[str, tuple[int, str]], passes: int = 4) -> str:
    """Text with user commands replaced by their bodies, nested ones in later passes."""
    for _ in range(passes):
        before, out, at = text, [], 0
        for m in re.finditer(r"\\([A-Za-z]+)", text):
            if m[1] not in known or m.start() < at:
                continue
            arity, body = known[m[1]]
            end, given = m.end(), []
            for _ in range(arity):
                if end < len(text) and text[end] == "{":
                    value, end = braced(text, end)
                    given.append(value)
            for i, value in enumerate(given, 1):
                body = body.replace(f"#{i}", value)
            out.append(text[at: m.start()] + body)
            at = end
        text = "".join(out) + text[at:]
        if text == before:
            break
    return text


def inline(text: str) -> str:
    """Prose of a paragraph: markers for citations and references, plain words for styled ones."""
    text = re.sub(r"~?\\cite[a-z]*\*?(?:\[[^\]]*\])*\{([^{}]*)\}", lambda m: " [cite: " + re.sub(r"\s*,\s*", ", ", m[1].strip()) + "]", text)
    text = re.sub(r"~?\\(?:eq|auto|c)?ref\{([^{}]*)\}", lambda m: f" [ref: {m[1].strip()}]", text)
    text = re.sub(r"\\(?:footnote|label)\{[^{}]*\}", "", text)
    for _ in range(6):
        text, n = re.subn(r"\\(?:text(?:it|bf|tt|rm|sc)|emph|mbox|underline)\{([^{}]*)\}|\{\\(?:it|bf|em|rm|tt|sc)\s+([^{}]*)\}", lambda m: m[1] or m[2] or "", text)
        if not n:
            break
    keep = re.split(r"(\$[^$]*\$|\[(?:cite|ref): [^\]]*\])", text)
    keep[::2] = [re.sub(r"\\[A-Za-z]+\*?|[{}]", "", s).replace("~", " ").replace("``", "“").replace("''", "”") for s in keep[::2]]
    return " ".join("".join(keep).split())


def anchor(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", label.lower())


def tex_blocks(source: str | None) -> list[dict]:
    """Blocks of a TeX source in order, with anchors: labels first, then running ``pN`` and ``bN``."""
    if not source:
        return []
    text = re.sub(r"(?<!\\)%[^\n]*\n?", "", source)
    known, text = macros(text)
    text = accents(expand(text, known))
    body = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.S)
    text = body[1] if body else text
    text = re.sub(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)", "", text, flags=re.S)
    env = "|".join([*MATH, "figure", "table", "verbatim", "lstlisting", "abstract"])
    cut = re.compile(rf"\\begin\{{(?P<env>{env})\*?\}}(?P<in>.*?)\\end\{{(?P=env)\*?\}}|\\(?P<sec>{'|'.join(SECTION)})\*?(?=\{{)|\$\$(?P<mm>.*?)\$\$|\\\[(?P<mb>.*?)\\\]", re.S)
    blocks: list[dict] = []
    numbers: dict[str, int] = {}

    def add(kind: str, **fields) -> None:
        label = re.search(r"\\label\{([^{}]*)\}", fields.pop("raw", ""))
        if kind in ("math", "figure", "table"):
            numbers[kind] = numbers.get(kind, 0) + 1
            fields["number"] = str(numbers[kind])
        blocks.append({"kind": kind, "anchor": anchor(label[1]) if label else "", **fields})

    def prose(piece: str) -> None:
        for part in re.split(r"\n[ \t]*\n|\\item\b(?:\[[^\]]*\])?", re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n\n", piece)):
            if said := inline(part):
                blocks.append({"kind": "paragraph", "anchor": "", "text": said})

    at = 0
    for m in cut.finditer(text):
        if m.start() < at:
            continue
        prose(text[at: m.start()])
        at = m.end()
        if m["sec"]:
            title, at = braced(text, m.end())
            label = re.match(r"\s*\\label\{([^{}]*)\}", text[at:])
            add("heading", title=inline(title), level=SECTION[m["sec"]], raw=label[0] if label else "")
            at += label.end() if label else 0
        elif m["env"] in MATH or m["mm"] is not None or m["mb"] is not None:
            inner = m["in"] or m["mm"] or m["mb"] or ""
            add("math", tex=re.sub(r"\\label\{[^{}]*\}", "", inner).strip(), raw=inner)
        elif m["env"] in ("figure", "table"):
            caption = re.search(r"\\caption(?:\[[^\]]*\])?(?=\{)", m["in"])
            file = re.search(r"\\includegraphics(?:\[[^\]]*\])?\{([^{}]*)\}", m["in"])
            add(m["env"], caption=inline(braced(m["in"], caption.end())[0]) if caption else "", file=file[1] if file else None, raw=m["in"])
        elif m["env"] == "abstract":
            prose(m["in"])
        else:
            add("code", text=m["in"].strip("\n"))
    prose(text[at:])
    paragraphs = 0
    for i, block in enumerate(blocks):
        if not block["anchor"]:
            if block["kind"] == "heading":
                block["anchor"] = "sec-" + anchor(block["title"]).strip("-")
            elif block["kind"] == "paragraph" and len(block["text"]) >= 80:
                paragraphs += 1
                block["anchor"] = f"p{paragraphs}"
            else:
                block["anchor"] = f"b{i + 1}"
    return blocks


FIELDS = ["kind", "anchor", "level", "number", "title", "text", "tex", "file", "caption"]


def parse_sources(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, kind, anchor, level, number, title, text, tex, file, caption) of TeX sources, one pass, Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *(b.get(f) for f in FIELDS)) for k, t in zip(batch["k"], batch["t"]) for i, b in enumerate(tex_blocks(t))]
            yield pd.DataFrame(rows, columns=["k", "idx", *FIELDS]).astype({"level": "Int64"})

    kind = sources.schema[key].dataType.simpleString()
    rows = sources.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")
    schema = f"k {kind}, idx int, kind string, anchor string, level int, number string, title string, text string, tex string, file string, caption string"
    return rows.mapInPandas(run, schema).withColumnRenamed("k", key)
