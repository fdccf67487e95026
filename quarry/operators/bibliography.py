"""Bibliographies of papers: entries of .bib and .bbl texts as records, several works of one line, tags."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import etl
from quarry.operators import works as W

# Forms of identifiers, journal references and names in the lines of a bibliography.
SKIPPED = {"comment", "preamble", "string", "control"}
DOI = re.compile(r"(?:doi\.org/|\bdoi\s*[:=]\s*\{?|\b)(10\.\d{4,9}/[^\s{},;\"'<>]+)", re.I)
ARXIV = re.compile(r"(?:arxiv\.org/(?:abs|pdf)/|\b(?:arxiv|eprint)\s*[:=]\s*\{?\"?)([\w.-]+/\d{7}|\d{4}\.\d{4,5})|\b((?:hep-(?:ph|ex|th|lat)|nucl-(?:th|ex)|astro-ph|gr-qc|math-ph|quant-ph)/\d{7})", re.I)
IDENTIFIER = re.compile(r"https?://\S+|\b\d{4}\.\d{4,5}(?:v\d+)?\b|\b[\w.-]+/\d{7}(?:v\d+)?\b|10\.\d{4,9}/\S+", re.I)
JOURNAL = [re.compile(r"([A-Z][A-Za-z.\s]{2,40}?)\s*([A-Z]?)\s*(\d+)\s*(?:,\s*(?:nos?\.?\s*\d+\s*)?)?,?\s*\((?P<year>\d{4})\)\s*,?\s*(?P<page>\d+)"), re.compile(r"([A-Z][A-Za-z.\s]{2,40}?)\s*([A-Z]?)\s*(\d+)\s*,\s*(?P<page>\d+)\s*\((?P<year>\d{4})\)")]
NAME = re.compile(r"^(?:[A-Z]\.\s*)*[A-Z][\w'’-]+(?:\s+(?:[A-Z]\.\s*)*[A-Z][\w'’-]+)?(?:,?\s*(?:[A-Z]\.\s*)+)?$")
# End.
RECORD = "label string, part int, ordinal int, title string, authors array<string>, year int, journal string, journal_key string, doi string, arxiv_id string, about string, raw string"
FIELDS = [f.split(" ")[0] for f in RECORD.split(", ")]


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _group(text: str, at: int, opening: str = "{", closing: str = "}") -> tuple[str, int]:
    """What stands in the group that opens at ``at``, and where it ends; an unclosed one runs to the end."""
    depth, i = 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        depth += (text[i] == opening) - (text[i] == closing)
        i += 1
        if not depth:
            return text[at + 1: i - 1], i
    return text[at + 1:], len(text)


def plain(text: str) -> str:
    """A line of TeX as text, without braces and commands."""
    text = etl.accents(text)
    while (inner := re.sub(r"\\[A-Za-z]+\*?\s*\{([^{}]*)\}", r"\1", text)) != text:
        text = inner
    bare = re.sub(r"\\[A-Za-z]+\*?\s?|[{}]", "", text).replace("~", " ")
    return _squeeze(bare.replace("``", '"').replace("''", '"')).strip(" ,;")


def bib_entries(text: str) -> dict[str, dict[str, str]]:
    """Fields of every entry of a .bib text by key; a broken entry does not cost the others."""
    out: dict[str, dict[str, str]] = {}
    for start in re.finditer(r"@(\w+)\s*(?=\{)", text):
        if start.group(1).lower() in SKIPPED:
            continue
        key, _, body = _group(text, start.end())[0].partition(",")
        fields, at = {}, 0
        while found := re.compile(r"(\w+)\s*=\s*").search(body, at):
            at = found.end()
            if body[at: at + 1] == "{":
                value, at = _group(body, at)
            else:
                quoted = re.compile(r'"((?:[^"\\]|\\.)*)"?' if body[at: at + 1] == '"' else r"([^,]*)", re.S).match(body, at)
                value, at = quoted.group(1), max(quoted.end(), at + 1)
            fields.setdefault(found.group(1).lower(), _squeeze(value))
        if _squeeze(key):
            out[_squeeze(key)] = fields
    return out


def bbl_items(text: str) -> list[tuple[str, str]]:
    """(key, line) of every item of a .bbl text or an inline bibliography, in order."""
    heads = []
    for start in re.finditer(r"\\bibitem\s*(?=[\[{])", text):
        at = start.end()
        if text[at] == "[":
            at = _group(text, at, "[", "]")[1]
            at += len(text[at:]) - len(text[at:].lstrip())
        if text[at: at + 1] == "{":
            key, end = _group(text, at)
            heads.append((start.start(), end, _squeeze(key)))
    out = []
    for i, (_, end, key) in enumerate(heads):
        stop = heads[i + 1][0] if i + 1 < len(heads) else len(text)
        closed = re.compile(r"\\end\s*\{thebibliography\}").search(text, end, stop)
        if key:
            out.append((key, text[end: closed.start() if closed else stop]))
    return out


def find_doi(text: str) -> str:
    found = DOI.search(text)
    return W.normal_doi(found.group(1)).rstrip(".,;)") if found else ""


def find_arxiv(text: str) -> str:
    found = ARXIV.search(text)
    return W.normal_arxiv(found.group(1) or found.group(2)) if found else ""


def find_year(text: str) -> int | None:
    """The last year in brackets, else the last plausible one; identifiers do not count, nor years to come."""
    bare = IDENTIFIER.sub(lambda m: " " * len(m.group()), text)
    years = re.findall(r"\((\d{4})\)", bare) or re.findall(r"\b(1[89]\d\d|20\d\d)\b", bare)
    return next((int(y) for y in reversed(years) if int(y) <= datetime.date.today().year + 1), None)


def journal_reference(text: str) -> tuple[str, str, str] | None:
    """(journal, volume, page) of the first printed journal reference in a line."""
    for pattern in JOURNAL:
        if (found := pattern.search(text)) and len(name := "".join(found.group(1).split()) + found.group(2)) >= 4:
            return name, found.group(3), found.group("page")
    return None


def place_key(journal: str, volume: str, page: str) -> str:
    return f"{re.sub('[^0-9a-z]+', '', journal.lower())},{volume},{page}"


def guess_authors(line: str) -> tuple[list[str], str]:
    """Names that open a line, and what follows them."""
    names, at = [], 0
    for stop in [*re.finditer(r",|\s+and\s+", line), None]:
        chunk = _squeeze(line[at: stop.start() if stop else len(line)])
        if not chunk or len(chunk.split()) > 4 or not NAME.match(chunk):
            return names, _squeeze(line[at:]).strip(" ,;")
        names.append(chunk)
        at = stop.end() if stop else len(line)
    return names, ""


def several_works(line: str) -> list[str]:
    """The works of one item: parted at semicolons and line breaks if two parts have an identifier, or a year and four words."""
    parts = [p for p in re.split(r";(?![^{]*\})|\\\\", line) if p.strip()]
    named = [p for p in parts if find_doi(p) or find_arxiv(p)]
    dated = [p for p in parts if len(plain(p).split()) >= 4 and find_year(plain(p))]
    return parts if len(parts) > 1 and max(len(named), len(dated)) > 1 else [line]


def from_bib(fields: dict[str, str]) -> dict:
    """A record from the fields of a .bib entry."""
    year, first = fields.get("year", ""), re.split("-+", fields.get("pages", ""))[0].strip()
    printed = [fields.get("journal", ""), fields.get("volume", ""), f"({year})" if year else "", first]
    record = {"title": plain(fields.get("title", "")), "authors": [plain(a) for a in re.split(r"\s+and\s+", fields.get("author", "")) if a.strip()], "year": int(year) if year.isdigit() else None}
    record["journal"] = _squeeze(" ".join(printed)) if printed[0] else ""
    record["doi"] = W.normal_doi(fields.get("doi", ""))
    record["arxiv_id"] = W.normal_arxiv(fields.get("eprint", "")) if fields.get("archiveprefix", "arXiv").lower() == "arxiv" else ""
    record["journal_key"] = place_key(printed[0], printed[1], first) if all((printed[0], printed[1], first)) else ""
    return record


def from_line(line: str) -> dict:
    """A record from a line of a .bbl, as far as its style tells."""
    stated: dict[str, list[str]] = {}
    for found in re.finditer(r"\\bibinfo\s*(?=\{)", line):
        name, at = _group(line, found.end())
        at += len(line[at:]) - len(line[at:].lstrip())
        if line[at: at + 1] == "{":
            stated.setdefault(_squeeze(name).lower(), []).append(plain(_group(line, at)[0]))
    first = lambda name: (stated.get(name) or [""])[0]
    text = plain(line)
    authors, about = [a for a in stated.get("author", []) if a], ""
    if not authors:
        authors, about = guess_authors(text)
    year = int(first("year")) if first("year").isdigit() else find_year(text)
    journal = _squeeze(" ".join([first("journal"), first("volume"), f"({year})" if year else "", first("pages")])) if first("journal") else ""
    place = journal_reference(journal or text)
    if place and not journal:
        journal = _squeeze(f"{place[0]} {place[1]} {f'({year})' if year else ''} {place[2]}")
    return {"title": first("title"), "authors": authors, "year": year, "journal": journal, "journal_key": place_key(*place) if place else "", "doi": find_doi(line), "arxiv_id": find_arxiv(line), "about": about, "raw": text}


def records_of(text: str | None, keys: list[str] | None = None) -> list[dict]:
    """Records of one paper's bibliography: fields of a .bib entry come before what its line says; keys never defined are left out."""
    bib, items = bib_entries(text or ""), bbl_items(text or "")
    lines = dict(items)
    ordinal = {key: n for n, (key, _) in enumerate(items, 1)}
    out = []
    for key in keys or list(dict.fromkeys([*lines, *bib])):
        for part, piece in enumerate(several_works(lines[key]) if key in lines else [None]):
            record = dict.fromkeys(FIELDS, "") | {"label": key, "part": part, "ordinal": ordinal.get(key) if not part else None, "authors": [], "year": None}
            record |= from_line(piece) if piece is not None else {}
            if not part and key in bib:
                record |= {name: value for name, value in from_bib(bib[key]).items() if value}
            if any(record[n] for n in ("title", "authors", "doi", "arxiv_id", "raw")):
                out.append(record)
    return out


def parse_bibliographies(texts: DataFrame, key: str = "slug", text: str = "text") -> DataFrame:
    """Records (key and the columns of ``RECORD``) of the bibliography texts of papers, one Arrow batch at a time.

    Balanced braces are beyond regular expressions, so this is the one stage that leaves the JVM.
    Null and empty texts give no rows.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *(r[f] for f in FIELDS)) for k, t in zip(batch["key"], batch["text"]) for r in records_of(t)]
            yield pd.DataFrame(rows, columns=["key", *FIELDS]).astype({"year": "Int64", "ordinal": "Int64"})

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("coalesce(text, '') <> ''").mapInPandas(run, f"key {kind}, {RECORD}").withColumnRenamed("key", key)


def assigned_tags(records: DataFrame, key: str, store: DataFrame) -> DataFrame:
    """(key, tag): a known work keeps the store's tag; others get their base tag and the next free suffix.

    Within a base tag records are ordered by their strongest identity, then by key, so that they get
    the same tags whenever they come; suffixes that the store has taken are passed over.
    """
    matched = W.priority_match(records, key, store).join(store.select("work_id", F.col("tag").alias("known")), "work_id").filter("coalesce(known, '') <> ''").select(key, "known")
    strongest = W.keyed(records, key).groupBy(key).agg(F.min_by("identity", "priority").alias("strongest"))
    fresh = records.select(key, W.base_tag().alias("base")).join(matched, key, "left_anti").join(strongest, key, "left")
    placed = fresh.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy(F.coalesce("strongest", F.lit("")), key)) - 1)
    tags = store.filter("coalesce(tag, '') <> ''").select("tag").distinct()
    last = F.regexp_extract("tag", "_([b-z])$", 1)
    position = F.when(last != "", F.ascii(last) - 97).otherwise(0)
    taken = tags.select(F.col("tag").alias("base"), F.lit(0).alias("at")).unionByName(tags.filter(last != "").select(F.regexp_replace("tag", "_[b-z]$", "").alias("base"), position.alias("at")))
    taken = taken.join(placed.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.collect_set("at").alias("taken"))  # at most 26 places
    free = F.array_except(F.sequence(F.lit(0), F.col("n") + 26), F.coalesce("taken", F.expr("cast(array() as array<int>)")))
    at = F.get(free, F.col("n"))
    suffix = F.when(at == 0, F.lit("")).when(at < 26, F.concat(F.lit("_"), F.char(97 + at))).otherwise(F.concat(F.lit("_"), (at + 1).cast("string")))
    new = placed.join(taken, "base", "left").select(key, F.concat("base", suffix).alias("tag"))
    return matched.select(key, F.col("known").alias("tag")).unionByName(new)
