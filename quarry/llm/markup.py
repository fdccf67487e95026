"""Markup residue to clean text: block trees, wrapper induction by simple tree matching, content slots."""

from __future__ import annotations

import html
import marshal
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import cut, spread

# Element names of HTML and MathML, and what they do to the text.
BLOCK_TAGS = "html head body title main nav aside header footer article section div p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption form fieldset center hr br address details summary".split()
INLINE_TAGS = "a abbr acronym b bdi bdo big button cite code data del dfn em embed font i iframe img input ins kbd label link map mark meta meter noscript object option param picture progress q s samp script select small source span strike strong style sub sup svg template textarea time tt u var video wbr audio canvas ref nowiki math mi mo mn ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd semantics annotation".split()
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "wbr", "embed", "source", "param"}
CLOSES_ITSELF = {"p", "li", "tr", "td", "th", "dt", "dd", "option"}
MATH_ENVIRONMENTS = "equation align gather multline eqnarray displaymath math"
CODE_ENVIRONMENTS = "verbatim lstlisting minted Verbatim"
# End.

TAGS = "|".join(sorted(BLOCK_TAGS + INLINE_TAGS, key=len, reverse=True))
#: Constructs in order of precedence, each with the signs it can begin with.  No length is bounded:
#: every repeat ends at a sign that also ends the next attempt, so a text is read in linear time.
RULES = [
    ("<", r"(?P<comment><!--.*?-->|<!DOCTYPE[^>]*>|<\?xml[^>]*>)"),
    ("<", r"(?P<drop><(?P<dropped>script|style)\b[^>]*>.*?</(?P=dropped)\s*>)"),
    ("<", rf"(?P<tag><(?P<slash>/?)(?P<name>{TAGS})(?P<attrs>(?:\s[^<>]*|/)?)>)"),
    ("<", rf"(?P<torn></(?:{TAGS})[ \t]*(?=\n|\Z))"),
    ("&", rf"(?P<escaped>&lt;/?(?:{TAGS})\b[^<>&\n]*&gt;)"),
    ("&", r"(?P<entity>&(?:\#[0-9]{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)"),
    ("`~", r"(?P<fence>^(?P<ticks>```+|~~~+)[^\n`]*\n(?P<fenced>.*?)^(?P=ticks)[ \t]*$)"),
    ("\\", rf"(?P<texcode>\\begin\{{(?P<cenv>{CODE_ENVIRONMENTS.replace(' ', '|')})\*?\}}(?P<ccode>.*?)\\end\{{(?P=cenv)\*?\}})"),
    ("$\\", rf"(?P<texmath>\\begin\{{(?P<menv>{MATH_ENVIRONMENTS.replace(' ', '|')})\*?\}}(?P<mcode>.*?)\\end\{{(?P=menv)\*?\}}|\$\$(?P<mdouble>[^$]+)\$\$|\\\[(?P<mbracket>(?:[^\\]|\\(?![\[\]]))+)\\\])"),
    ("$\\", r"(?P<mathinline>\\\((?P<mparen>(?:[^\\\n]|\\(?![()]))+)\\\)|\$(?P<mdollar>(?![\s0-9.,]+[^\\^_{}$\n]*\$)[^$\\^_{}\n]*[\\^_{}][^$\n]*|[A-Za-z])\$)"),
    ("{", r"(?P<wikitable>^\{\|.*?^\|\}[ \t]*$)"),
    ("{", r"(?P<template>\{\{(?P<tbody>(?:[^{}]|\{\{[^{}]*\}\})+)\}\})"),
    ("[", r"(?P<wikilink>\[\[(?P<wbody>[^\[\]\n]+)\]\])"),
    ("!", r"(?P<image>!\[(?P<alt>[^\[\]\n]*)\]\([^)\s]+(?:[ ]+\"[^\"\n]*\")?\))"),
    ("[", r"(?P<link>\[(?P<ltext>[^\[\]\n]+)\](?:\([^)\s]+(?:[ ]+\"[^\"\n]*\")?\)|\[[^\[\]\s]+\](?!\w)))"),
    ("[", r"(?P<footnote>\[\^[^\[\]\s]+\]:?)"),
    (" [", r"(?P<refdef>^[ ]{0,3}\[[^\[\]\n]+\]:[ ]+\S+[^\n]*$)"),
    ("[", r"(?P<extlink>\[https?://[^\s\]]+(?:[ ](?P<etext>[^\]\n]+))?\])"),
    ("<", r"(?P<autolink><https?://[^>\s]+>)"),
    ("=", r"(?P<wikihead>^(?P<eq>={1,6})[ \t]*(?P<whead>[^=\n][^\n]*?)[ \t]*(?P=eq)[ \t]*$)"),
    ("=-", r"(?P<setext>^(?:={3,}|-{5,})[ \t]*$)"),
    ("#", r"(?P<mdhead>^(?P<hash>\#{1,6})[ \t]+(?P<mhead>[^\n]+?)[ \t#]*$)"),
    ("-", r"(?P<wikirule>^----[ \t]*$)"),
    ("*-_", r"(?P<mdrule>^(?:\*[ ]?\*[ ]?\*|---|_{3,})[ \t]*$)"),
    ("|", r"(?P<mdtable>(?:^\|[^\n]*\|[ \t]*\n)?^\|(?:[ ]?:?-{2,}:?[ ]?\|)+[ \t]*$(?:\n\|[^\n]*\|[ \t]*$)*)"),
    (">", r"(?P<quote>^>[ ]+)"),
    (":;", r"(?P<defined>^[:;]+[ ]*(?=\S))"),
    (" \t-+*#", r"(?P<bullet>^[ \t]*(?:[-+][ ]+|\*+[ ]+|\#+[ ]+)(?=\S))"),
    (" \t0123456789", r"(?P<ordered>^[ \t]*[0-9]{1,3}[.)][ ]+(?=\S))"),
    ("~", r"(?P<signed>~~~~~?)"),
    ("'", r"(?P<strong>'{5}|'{3}|'{2})"),
    ("*_", r"(?P<bold>(?<![\w*])\*\*(?=\S)(?P<btext>[^*\n]+?)(?<=\S)\*\*(?!\*)|(?<![\w_])__(?=\S)(?P<utext>[^_\n]+?)(?<=\S)__(?![\w_]))"),
    ("~", r"(?P<strike>~~(?=\S)(?P<dtext>[^~\n]+?)(?<=\S)~~)"),
    ("`", r"(?P<tick>`(?P<code>[^`\n]+)`)"),
    ("*_", r"(?P<emph>(?<![\w*])\*(?=[^\s*])(?P<itext>[^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])(?P<jtext>[^_\n]+?)(?<=[^\s_])_(?![\w_]))"),
    ("\\", r"(?P<texenv>\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?)"),
    ("\\", r"(?P<texhead>\\(?P<tlevel>part|chapter|section|subsection|subsubsection|paragraph|title)\*?\{(?P<thead>(?:[^{}\n]|\{[^{}\n]*\})*)\})"),
    ("\\", r"(?P<texitem>\\item\b(?:\[[^\]\n]*\])?[ \t]*)"),
    ("~\\", r"(?P<texdrop>~?\\(?:cite[a-z]*|ref|eqref|label|footnote|documentclass|usepackage|bibliography|bibliographystyle|pagestyle|vspace|hspace|input|include)\*?(?:\[[^\]\n]*\])?\{[^{}]*\})"),
    ("\\", r"(?P<texword>\\[A-Za-z]+\*?(?![A-Za-z])(?:\[[^\[\]\n]*\])?[ \t]?)"),
    ("\\", r"(?P<texescape>\\[%&_\#$,;!]|\\\\(?=\s|$))"),
    ("%", r"(?P<texcomment>^%[^\n]*$)"),
    ("\n", r"(?P<blank>\n[ \t]*(?:\n[ \t]*)+)"),
]
#: The constructs that can begin with a sign, as one pattern for each sign.
EVENTS = {sign: re.compile("|".join(rule for signs, rule in RULES if sign in signs), re.M | re.S | re.I) for sign in {c for signs, _ in RULES for c in signs}}
HTML = {"comment", "drop", "tag", "torn", "escaped", "entity"}
LATEX = {"texcode", "texmath", "mathinline", "texenv", "texhead", "texitem", "texdrop", "texword", "texescape"}
MARKDOWN = {"fence", "image", "link", "footnote", "refdef", "autolink", "setext", "mdrule", "mdtable", "bold", "strike", "tick", "emph"}
#: Groups that hold what a construct shows.
SHOWN = {"image": ("alt",), "link": ("ltext",), "bold": ("btext", "utext"), "strike": ("dtext",), "tick": ("code",), "emph": ("itext", "jtext")}
WIKI = {"wikitable", "template", "wikilink", "extlink", "wikihead", "wikirule"}
#: Cheap test, without captures, that JVM and Python share: a text without any of these holds no markup.
SUSPECT = r"[<&\\$*_`~|]|\{\{|\{\||\[\[|\]\(|\[\^|\[http|''|(?m)^[ \t]*(?:[#=>+:;%-]|\[[^\]]+\]:|[0-9]{1,3}[.)] )"

#: Where a construct can begin within a line, and what begins one at the start of a line.
SIGN = re.compile(r"[<&\\$\[!{`~*_'\n]")
LINE = re.compile(r"[ \t]*[#=>|%:;+\-*0-9]|[ ]{0,3}\[")
#: A text is a host's own, not its pages', if it stands on this share of at least so many pages.
CONSTANT_SHARE = 0.8
LEAST_PAGES = 5
#: Bytes of templates, or of constants, that are broadcast; beyond, pages are joined with them by host and salt.
BROADCAST_BYTES = 64 << 20
SALTS = 32


@dataclass
class Node:
    """A block of a page: its label, its own text and the blocks below it; ``mark`` stands for the whole text."""

    label: str
    text: str = ""
    children: list["Node"] = field(default_factory=list)
    kind: str = ""
    mark: bytes = b""


def mark_of(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).digest() if text else b""


def _events(text: str) -> Iterator[re.Match]:
    """All constructs of a text, from left to right; the patterns are tried only where one can begin."""
    at, size = 0, len(text)
    while at < size:
        if not at or text[at - 1] == "\n":
            if LINE.match(text, at) and (found := EVENTS[text[at]].match(text, at)):
                yield found
                at = max(found.end(), at + 1)
                continue
        if not (spot := SIGN.search(text, at)):
            return
        at = spot.start()
        if found := EVENTS[text[at]].match(text, at):
            yield found
            at = max(found.end(), at + 1)
        else:
            at += 1


def _shown(body: str) -> str:
    """What a template call shows: its last argument, if it has any."""
    return body.rpartition("|")[2] if "|" in body else ""


def parse(text: str | None) -> tuple[Node, list[str]]:
    """The block tree of a text and the markup languages it holds, in alphabetical order."""
    root = Node("page")
    if not text:
        return root, []
    stack, kinds, weak = [root], set(), {"bullet": 0, "star": 0, "hash": 0, "ordered": 0, "defined": 0, "quote": 0, "strong": 0, "mdhead1": 0}
    buffer: list[str] = []
    current = Node("text", kind="paragraph")

    def close() -> None:
        nonlocal current
        joined = "".join(buffer)
        if joined.strip():
            current.text = joined.strip("\n") if current.kind == "code" else " ".join(joined.split())
            stack[-1].children.append(current)
        buffer.clear()
        current = Node("text", kind="paragraph")

    def leaf(label: str, kind: str, content: str) -> None:
        nonlocal current
        close()
        current = Node(label, kind=kind)
        buffer.append(content)
        close()

    def begin(label: str, kind: str) -> None:
        nonlocal current
        close()
        current = Node(label, kind=kind)

    done = 0
    for m in _events(text):
        event = m.lastgroup  # the outermost group closes last
        buffer.append(text[done: m.start()])
        done = m.end()
        if event == "texcomment":
            if "latex" not in kinds:
                buffer.append(m.group())
        elif event in HTML:
            if event == "entity" and html.unescape(m.group()) == m.group():
                buffer.append(m.group())
                continue
            kinds.add("html")
            if event == "entity":
                buffer.append(html.unescape(m.group()))
            elif event == "drop":
                leaf(m.group("dropped").lower(), "dropped", m.group())
            elif event == "tag":
                name, closing = m.group("name").lower(), bool(m.group("slash"))
                if name == "pre":
                    close()
                    if not closing:
                        current = Node("pre", kind="code")
                elif name not in BLOCK_TAGS:
                    continue
                elif name in VOID_TAGS:
                    close()
                elif closing:
                    close()
                    if any(n.label == name for n in stack[1:]):
                        while stack.pop().label != name:
                            pass
                else:
                    close()
                    if name in CLOSES_ITSELF and stack[-1].label == name:
                        stack.pop()
                    if len(stack) < 40:
                        node = Node(name)
                        stack[-1].children.append(node)
                        stack.append(node)
        elif event in LATEX:
            kinds.add("latex")
            if event == "texcode":
                leaf("code", "code", m.group("ccode"))
            elif event == "texmath":
                leaf("math", "formula", m.group("mcode") or m.group("mdouble") or m.group("mbracket") or "")
            elif event == "mathinline":
                buffer.append(m.group("mparen") or m.group("mdollar") or "")
            elif event == "texhead":
                leaf(m.group("tlevel").lower(), "heading", m.group("thead"))
            elif event == "texitem":
                begin("item", "item")
            elif event == "texenv":
                close()
            elif event == "texescape":
                buffer.append(m.group()[1] if m.group()[1] in "%&_#$" else " ")
        elif event in MARKDOWN:
            kinds.add("markdown")
            if event == "fence":
                leaf("code", "code", m.group("fenced"))
            elif event == "setext":
                line = "".join(buffer).rstrip()
                buffer.clear()
                before, _, title = line.rpartition("\n")
                buffer.append(before)
                leaf("heading", "heading", title)
            elif event == "mdtable":
                leaf("table", "table", re.sub(r"[|\s]*\n[|:\-\s]*\n?", "\n", m.group()).replace("|", " "))
            elif event in ("refdef", "mdrule"):
                leaf(event, "dropped", m.group())
            else:
                buffer.append(next((m.group(g) for g in SHOWN.get(event, ()) if m.group(g) is not None), ""))
        elif event in WIKI:
            kinds.add("wiki")
            if event == "wikihead":
                leaf("heading", "heading", m.group("whead"))
            elif event == "wikitable":
                leaf("table", "table", re.sub(r"\{\|[^\n]*|\|\}|\|-+|[|!]+", " ", m.group()))
            elif event == "wikirule":
                leaf("rule", "dropped", m.group())
            elif event == "template":
                body = re.sub(r"\{\{([^{}]*)\}\}", lambda inner: _shown(inner.group(1)), m.group("tbody"))
                buffer.append(_shown(body))
            elif event == "wikilink":
                target, *shown = m.group("wbody").split("|")
                if re.match(r"(?i)category:", target):
                    leaf("category", "dropped", target)
                else:
                    buffer.append(shown[-1] if shown else "" if re.match(r"(?i)(file|image):", target) else target)
            else:
                buffer.append(m.group("etext") or "")
        elif event == "mdhead":
            weak["mdhead1" if len(m.group("hash")) == 1 else "quote"] += 1
            leaf("heading", "heading", m.group("mhead"))
        elif event == "quote":
            if weak["quote"] or not text[: m.start()].strip() or text[: m.start()].endswith("\n\n"):
                weak["quote"] += 1
                begin("quote", "quote")
            else:
                buffer.append(m.group())
        elif event == "bullet":
            sign = m.group().strip()
            weak["star" if sign[0] == "*" else "hash" if sign[0] == "#" else "bullet"] += 1
            begin("item", "item")
        elif event in ("ordered", "defined"):
            fresh = not text[: m.start()].rstrip(" \t") or text[: m.start()].endswith("\n\n")
            if event == "defined" or weak["ordered"] or (fresh and m.group().strip()[:-1] == "1"):
                weak[event] += 1
                begin("item", "item")
            else:
                buffer.append(m.group())
        elif event == "strong":
            weak["strong"] += 1
        elif event == "signed":
            kinds.add("wiki")
        elif event == "blank":
            close()
    buffer.append(text[done:])
    close()
    if weak["strong"] >= 2:
        kinds.add("wiki")
    if weak["quote"]:
        kinds.add("markdown")
    if weak["mdhead1"] and not ("wiki" in kinds and "markdown" not in kinds):
        kinds.add("wiki" if weak["mdhead1"] > 2 and "markdown" not in kinds else "markdown")
    if weak["bullet"] + weak["ordered"] > 1 and not kinds & {"wiki", "markdown"}:
        kinds.add("markdown")
    if weak["star"] + weak["hash"] and not kinds & {"wiki", "markdown"}:
        kinds.add("markdown" if not weak["hash"] else "wiki")
    if weak["defined"] and "wiki" not in kinds and re.search(r"(?m)^::+ ?\S", text):
        kinds.add("wiki")
    return root, sorted(kinds)



def _outline(node: Node, constants) -> Node:
    """The part of a page that is aligned: its paragraphs among ``constants`` and the blocks they stand in."""
    kept = []
    for child in node.children:
        if child.kind == "paragraph" and child.mark in constants:
            kept.append(Node(child.label, mark=child.mark))
        elif (inner := _outline(child, constants)).children:
            kept.append(inner)
    return Node(node.label, children=kept)


def _equal(a: Node, b: Node) -> bool:
    return a.label == b.label and a.mark == b.mark and len(a.children) == len(b.children) and all(map(_equal, a.children, b.children))


def _ends(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many equal nodes two lists begin and end with; the largest mapping may pair them."""
    most, first, last = min(len(a), len(b)), 0, 0
    while first < most and _equal(a[first], b[first]):
        first += 1
    while last < most - first and _equal(a[-1 - last], b[-1 - last]):
        last += 1
    return first, last


def _size(node: Node) -> int:
    return 1 + sum(map(_size, node.children))


def _chain(a: list[Node], b: list[Node], known: dict) -> tuple[int, tuple | None]:
    """Weight of the best matching of two lists in order, and its pairs as a chain from the last: (i, j, those before).

    Only nodes of one label and one text meet; the best chain that ends before a place comes from a tree of prefix maxima.
    """
    places: dict[tuple[str, bytes], list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault((y.label, y.mark), []).append(j)
    best: list[tuple[int, tuple | None]] = [(0, None)] * (len(b) + 1)
    for i, x in enumerate(a):
        for j in reversed(places.get((x.label, x.mark), ())):
            total, chain, k = 0, None, j
            while k:
                if best[k][0] > total:
                    total, chain = best[k]
                k &= k - 1
            total, chain, k = total + _match(x, b[j], known)[0], (i, j, chain), j + 1
            while k <= len(b):
                if best[k][0] < total:
                    best[k] = total, chain
                k += k & -k
    return max(best, key=lambda e: e[0])


def _match(a: Node, b: Node, known: dict) -> tuple[int, int, int, tuple | None]:
    """Weight of two nodes that can meet, how many equal children they begin and end with, and the chain between."""
    if (key := (id(a), id(b))) not in known:
        first, last = _ends(a.children, b.children)
        m, n = len(a.children) - last, len(b.children) - last
        inner, chain = _chain(a.children[first:m], b.children[first:n], known)
        known[key] = 1 + inner + sum(map(_size, a.children[:first])) + sum(map(_size, a.children[m:])), first, last, chain
    return known[key]


def weight(a: Node, b: Node, known: dict | None = None) -> int:
    """Simple tree matching: the pairs of the largest mapping of two trees that keeps order and ancestry.

    Only nodes of one label and one text are paired.
    """
    return _match(a, b, {} if known is None else known)[0] if a.label == b.label and a.mark == b.mark else 0


def _pairs(a: Node, b: Node, known: dict | None = None) -> list[tuple[Node, Node]]:
    """The pairs of the largest mapping of two trees."""
    known = {} if known is None else known
    if not weight(a, b, known):
        return []
    pairs = [(a, b)]
    _, first, last, chain = _match(a, b, known)
    for k in (*range(first), *range(-last, 0)):
        pairs += _pairs(a.children[k], b.children[k], known)
    while chain:
        i, j, chain = chain
        pairs += _pairs(a.children[first + i], b.children[first + j], known)
    return pairs


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Weight and pairs of the largest mapping of two trees."""
    known: dict = {}
    return weight(a, b, known), _pairs(a, b, known)


def merge(template: Node, page: Node) -> Node:
    """Add the outline of a page, or another template of the host, to a template.

    Every node without a counterpart is added and none is let go, so each page merged stands whole
    in the template.  What can enter are constants, so its size is that of a page's, not of all.
    """
    pairs = _pairs(template, page)
    mapped = {id(p): t for t, p in pairs}
    for t, p in pairs:
        children, at = [], 0
        for child in p.children:
            own = mapped.get(id(child), child)
            while own is not child and t.children[at] is not own:
                children.append(t.children[at])
                at += 1
            children.append(own)
            at += own is not child
        t.children = children + t.children[at:]
    return template


def _pack(node: Node) -> tuple:
    return node.label, node.mark, node.kind, bool(node.text) and node.kind != "dropped", [_pack(c) for c in node.children]


def _unpack(packed: tuple) -> Node:
    label, mark, kind, shown, children = packed
    return Node(label, " " if shown else "", [_unpack(c) for c in children], kind, mark)


def blocks_of(root: Node) -> list[tuple[str, str]]:
    """(kind, text) of the blocks of a page in order: all that is shown, with the structure it stands in."""
    out: list[tuple[str, str]] = []

    def walk(node: Node) -> None:
        for child in node.children:
            if child.text and child.kind != "dropped":
                kind = child.kind
                if kind == "paragraph" and node.label in ("h1", "h2", "h3", "h4", "h5", "h6", "title"):
                    kind = "heading"
                elif kind == "paragraph" and node.label in ("li", "dd", "dt"):
                    kind = "item"
                elif kind == "paragraph" and node.label in ("td", "th", "tr", "caption"):
                    kind = "table"
                out.append((kind, child.text))
            walk(child)

    walk(root)
    return out


def _walk(node: Node) -> Iterator[Node]:
    for child in node.children:
        yield child
        yield from _walk(child)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parse every page once: its markup, blocks, skeleton and the marks of its paragraphs."""
    for batch in batches:
        kinds, blocks, skeletons, marks = [], [], [], []
        for value in batch["value"]:
            root, found = parse(value)
            for node in _walk(root):
                node.mark = mark_of(node.text)
            kinds.append(found)
            blocks.append([{"kind": k, "text": t} for k, t in blocks_of(root)])
            skeletons.append(marshal.dumps(_pack(root)))
            marks.append(list({n.mark for n in _walk(root) if n.mark and n.kind == "paragraph"}))
        yield batch.assign(kinds=kinds, blocks=blocks, skeleton=skeletons, marks=marks)


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [marshal.dumps(_pack(_outline(_unpack(marshal.loads(s)), set(c)))) for s, c in zip(batch["skeleton"], batch["constants"])]
        yield pd.DataFrame({"host": batch["host"], "template": found})


def _combine(pieces: pd.DataFrame) -> pd.DataFrame:
    template, *others = (_unpack(marshal.loads(packed)) for packed in sorted(pieces["template"], key=lambda t: (-len(t), t)))
    for other in others:
        template = merge(template, other)
    return pd.DataFrame({"host": [pieces["host"].iloc[0]], "template": [marshal.dumps(_pack(template))]})


def _aligned(template: bytes, outline: Node) -> frozenset[int]:
    """Which paragraphs of an outline, in order, have a counterpart in the template."""
    paired = {id(p) for _, p in _pairs(_unpack(marshal.loads(template)), outline)}
    return frozenset(i for i, n in enumerate(n for n in _walk(outline) if n.mark) if id(n) in paired)


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leave out the blocks of a page that its host's template holds as constants, node by node."""
    for batch in batches:
        left = []
        known: dict[tuple[bytes, bytes], frozenset[int]] = {}
        for blocks, skeleton, template, constants in zip(batch["blocks"], batch["skeleton"], batch["template"], batch["constants"]):
            constants = set(constants)
            root = _unpack(marshal.loads(skeleton))
            outline = _outline(root, constants)
            key = template, marshal.dumps(_pack(outline))
            if key not in known:
                known[key] = _aligned(template, outline)
            shown = [n for n in _walk(root) if n.text]
            at = [i for i, n in enumerate(shown) if n.kind == "paragraph" and n.mark in constants]
            gone = {at[i] for i in known[key]}
            left.append([dict(b) for i, b in enumerate(blocks) if b["kind"] != "paragraph" or i not in gone])
        yield batch.drop(columns=["template", "constants"]).assign(blocks=left)


def _beside(pages: DataFrame, walls: DataFrame, *parting: str) -> DataFrame:
    """Pages with what is known of their hosts: broadcast, or by host and a salt of ``parting`` where it is much."""
    size = F.sum(sum(F.coalesce(F.length(c) if t == "binary" else F.size(c) * 12, F.lit(0)) for c, t in walls.dtypes if c != "host") + 256)
    if walls.agg(size).first()[0] <= BROADCAST_BYTES:
        return pages.join(F.broadcast(walls), "host")
    # A host may hold a third of all pages: its template is repeated and its pages are parted.
    salt = F.pmod(F.xxhash64(*parting), F.lit(SALTS))
    return pages.withColumn("salt", salt).join(walls.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"]).drop("salt")


def induce(parsed: DataFrame) -> DataFrame | None:
    """(host, constants, template) of the hosts that have constants, from the pages that ``_read`` parsed, or None.

    A paragraph is constant if it stands on ``CONSTANT_SHARE`` of the host's pages; every paragraph
    is counted over all of them.  Then only the outlines that constants form are merged, each
    different one once, in parts and then the parts.
    """
    pages = parsed.filter("host is not null")
    total = pages.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    counted = pages.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n"))
    sure = counted.join(total, "host").filter(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    sure = cut(sure.groupBy("host").agg(F.collect_list("mark").alias("constants")))
    if sure.isEmpty():
        return None
    outlines = _beside(pages.select("host", "skeleton"), sure, "skeleton").mapInPandas(_outlines, "host string, template binary").distinct()
    part = F.pmod(F.xxhash64("template"), F.lit(SALTS)).alias("part")
    parts = outlines.groupBy("host", part).applyInPandas(_combine, "host string, template binary")
    return cut(parts.groupBy("host").applyInPandas(_combine, "host string, template binary").join(sure, "host"))


def clean_markup(values: DataFrame) -> DataFrame:
    """Add ``kinds``, ``clean`` and ``blocks`` to values (key, host, value and any other columns).

    ``kinds`` names the markup languages of the value, ``blocks`` its content in order as (kind,
    text) with headings, items, code, tables, quotes and formulas kept apart, ``clean`` the same as
    text.  Paragraphs that are constant over the pages of a host, letter by letter, belong to its
    template and are left out where they align with it; a value that holds no markup comes out unchanged.  Null values stay null
    with empty arrays, and values of a null host are cleaned without a template.  Columns named like
    the added ones are replaced.

    Each page is parsed once; pages of a host without constants, most of them, are finished then.
    """
    values = values.drop("kinds", "clean", "blocks", "template", "skeleton", "marks", "constants")
    extra = "array<struct<kind:string,text:string>>"
    plain = F.col("value").isNull() | ~F.col("value").rlike(SUSPECT)
    none = values.filter(plain).withColumn("kinds", F.expr("cast(array() as array<string>)")).withColumn("clean", F.col("value"))
    none = none.withColumn("blocks", F.when(F.trim(F.coalesce("value", F.lit(""))) == "", F.expr(f"cast(array() as {extra})")).otherwise(F.array(F.struct(F.lit("paragraph").alias("kind"), F.col("value").alias("text")))))
    inner = values.schema.simpleString()[len("struct<"):-1]
    schema = f"{inner},kinds:array<string>,blocks:{extra},skeleton:binary,marks:array<binary>"
    parsed = cut(spread(values.filter(~plain)).mapInPandas(_read, schema))
    walls = induce(parsed)
    pages = parsed.drop("marks")
    kept = pages.drop("skeleton")
    if walls is not None:
        kind = f"{inner},kinds:array<string>,blocks:{extra},skeleton:binary"
        walled = _beside(pages, walls, "key", "value")
        stripped = walled.select(*pages.columns, "template", "constants").mapInPandas(_strip, kind).drop("skeleton")
        kept = kept.join(walls.select("host"), "host", "left_anti").select(kept.columns).unionByName(stripped)
    lines = F.array_join(F.transform("blocks", lambda b: F.when(b["kind"] == "item", F.concat(F.lit("- "), b["text"])).otherwise(b["text"])), "\n")
    cleaned = kept.withColumn("clean", F.when(F.size("kinds") > 0, lines).otherwise(F.col("value")))
    return none.unionByName(cleaned.select(none.columns))
