"""Column expressions over texts, names and identifiers; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs folded before matching, stop words and furniture, clause and sentence marks.
QUOTES_FROM, QUOTES_TO = "“”„«»‘’‚‹›", "\"\"\"\"\"'''''"
ZERO_WIDTH = "​‌‍⁠﻿­"
TOPIC_STOPWORDS = (
    "a about also an and any are as at be been between both but by can could do does each for from had has have how if in into is it its "
    "many more most much no not of on or our over own same so some such than that the their them then there these they this those to under "
    "upon us use used using very was we were what when where which while who why will with within would"
).split()
META_TERMS = "review status present summarising theoretically motivated".split()
FURNITURE = (
    "search searches measurement measurements observation observations constraint constraints limit limits evidence study studies review "
    "overview status implications prospects test tests analysis new first precise improved report results "
    "et al cf ibid eq eqs eqn fig figs figure figures ref refs appendix appendices chapter panel"
).split()
ABBREVIATIONS = (
    "Phys Rev Lett Nucl Astropart Eur Mod Ann Prog Rept J Int Suppl Conf Proc Fig Figs Eq Eqs Sec Secs Chap App Ref Refs Tab Vol No Ed Eds pp "
    "al cf vs e.g i.e resp approx ca et Dr Prof Univ Inst Collab"
).split()
TAG_STOPWORDS = (
    "a an and are as at by for from in into is its of on or the to with within new study studies measurement measurements observation "
    "analysis using via towards toward its their this that these those effects effect"
).split()
#: White space of Unicode, as a class that Java and RE2 read alike.
BLANK = r"[\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# End.

#: Initials that stand behind a name.
INITIALS = r"( +([A-Z][.]?){1,3})+$"
MIN_PREFIX = 4
MAX_TERMS = 12


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def collapse(text: str | Column) -> Column:
    """One blank for every run of white space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c(text), BLANK + "+", " "))


def flatten(text: str | Column) -> Column:
    """The form phrases are searched in: quotes folded, zero-width signs out, white space collapsed."""
    return collapse(F.regexp_replace(F.translate(F.translate(F.coalesce(c(text), F.lit("")), QUOTES_FROM, QUOTES_TO), ZERO_WIDTH, ""), r"[\x00-\x1f]", " "))


def normalize_title(title: str | Column) -> Column:
    """Lower-case ASCII words of a title without TeX commands."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c(title), F.lit("")), r"\\[a-zA-Z]+", " ")), "[^0-9a-zA-Z]+", " "))


def truncate(text: str | Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    t = c(text)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def escape_cell(text: str | Column) -> Column:
    """A text as a cell of a pipe table."""
    return F.replace(collapse(text), F.lit("|"), F.lit("\\|"))


def words_of_block() -> Column:
    """What a reader reads of a block: text, title or caption by kind, else nothing."""
    kind = F.col("kind")
    said = F.when(kind == "paragraph", F.col("text")).when(kind == "heading", F.col("title")).when(kind.isin("figure", "table"), F.col("caption"))
    return F.coalesce(said, F.lit(""))


def display_of_block() -> Column:
    """What is shown of a block: words with numbers, formulas and code."""
    kind = F.col("kind")
    heading = F.concat_ws(" ", F.when(F.coalesce("number", F.lit("")) != "", F.col("number")), F.col("title"))
    shown = F.when(kind == "paragraph", F.col("text")).when(kind == "heading", heading).when(kind == "math", F.col("tex")).when(kind == "code", F.col("text"))
    shown = shown.when(kind == "table", F.concat_ws("\n", "caption", "tex")).when(kind == "figure", F.col("caption"))
    return F.coalesce(shown, F.lit(""))


def word_count(text: str | Column) -> Column:
    """Words parted by white space; 0 for null and blank texts."""
    bare = collapse(F.coalesce(c(text), F.lit("")))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " "))).cast("long")


# TeX that renderers do not know, and what stands for it.
MATH_NOISE = r"\\label\s*\{[^}]*\}|\\(?:nonumber|notag)(?![a-zA-Z])|\\(?:vspace|hspace)\*?\s*\{[^}]*\}|\\eqref\s*\{[^}]*\}|\\(?:hfill|hfil|vfill|noindent|protect|nobreak)(?![a-zA-Z])|\\ensuremath\s*(?=\{)"
MATH_REWRITES = [("thinspace", "\\,"), ("medspace", "\\;"), ("negthinspace", "\\!"), ("mbox", "\\text"), ("alt", "\\lesssim"), ("agt", "\\gtrsim")]
# End.


def safe_math(tex: str | Column) -> Column:
    """TeX of a formula with what renderers reject taken out or put otherwise; matrix commands become environments."""
    t = F.regexp_replace(c(tex), MATH_NOISE, "")
    for name, to in MATH_REWRITES:
        t = F.regexp_replace(t, rf"\\{name}(?![a-zA-Z])", to.replace("\\", "\\\\"))
    t = F.regexp_replace(t, r"\\isotope\s*\[([^\]]*)\]\s*\[([^\]]*)\]\s*\{([^}]*)\}", r"{}^{$1}_{$2}\\mathrm{$3}")
    return F.regexp_replace(t, r"\\([pbvVB]?)matrix\s*\{((?:[^{}]|\{[^{}]*\})*)\}", r"\\begin{$1matrix}$2\\end{$1matrix}")


def safe_prose(text: str | Column) -> Column:
    """Prose with each inline formula made safe_math()."""
    t = F.coalesce(c(text), F.lit(""))
    outside, inside = F.split(t, r"\$[^$]*\$", -1), F.regexp_extract_all(t, F.lit(r"\$([^$]*)\$"), F.lit(1))
    return F.array_join(F.transform(outside, lambda x, i: F.concat(x, F.when(i < F.size(inside), F.concat(F.lit("$"), safe_math(F.get(inside, i)), F.lit("$"))).otherwise(F.lit("")))), "")


def occurrences(text: str | Column, phrase: str) -> Column:
    """How often ``phrase`` stands in a text, without overlap."""
    t = c(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def location(slug: str = "slug", stem: str = "stem", anchor: str = "anchor") -> Column:
    """The address of a block; without an anchor, that of its chapter."""
    return F.concat(F.col(slug), F.lit("/"), F.col(stem), F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(F.lit("#"), F.col(anchor))).otherwise(F.lit("")))


def title_words(title: str | Column) -> Column:
    """Distinct words of a title in order."""
    return F.array_distinct(F.filter(F.split(normalize_title(title), " "), lambda w: w != ""))


def topic_terms(text: str | Column) -> Column:
    """The first ``MAX_TERMS`` distinct words of three letters or more that say something about a subject."""
    stop = strings(TOPIC_STOPWORDS + META_TERMS)
    return F.slice(F.filter(title_words(text), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)), 1, MAX_TERMS)


def topic_list(text: str) -> list[str]:
    """topic_terms() of a text that a person gave, on the driver."""
    barred, out = set(TOPIC_STOPWORDS) | set(META_TERMS), []
    for w in re.findall("[0-9a-z]+", re.sub(r"\\[a-zA-Z]+", " ", text).lower()):
        if len(w) >= 3 and w not in barred and w not in out:
            out.append(w)
    return out[:MAX_TERMS]


def word_matches(a: Column, b: Column) -> Column:
    """Equal words, or one the beginning of the other and the shorter of ``MIN_PREFIX`` letters."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= MIN_PREFIX) & (F.startswith(a, b) | F.startswith(b, a)))


def held_terms(text: str | Column, terms: list[str]) -> Column:
    """The given words that a text holds, as word_matches() has it.

    The text's words are bound once for each row; written out they would be parted anew for every word asked.
    """
    if not terms:
        return F.expr("cast(array() as array<string>)")
    near = strings(sorted({t[:MIN_PREFIX] for t in terms}))
    words = F.filter(F.split(normalize_title(text), " "), lambda w: F.array_contains(near, F.substring(w, 1, MIN_PREFIX)))
    return F.get(F.transform(F.array(words), lambda ws: F.filter(strings(terms), lambda t: F.exists(ws, lambda w: word_matches(w, t)))), F.lit(0))


def segments(text: str | Column) -> Column:
    """Runs of words that no punctuation divides; a hyphen within a word does not."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c(text), F.lit("")), r"\\[a-zA-Z]+", " "), r"([0-9A-Za-z])[-‐‑](?=[0-9A-Za-z])", "$1 ")
    return F.transform(F.split(F.lower(bare), "[^0-9a-z ]+"), lambda s: F.filter(F.split(s, " +"), lambda w: w != ""))


def ngrams(text: str | Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Distinct word n-grams within segments that may be terms.

    A term neither begins nor ends with a stop word or furniture and holds no number.
    """
    barred = strings(sorted(set(TOPIC_STOPWORDS) | set(FURNITURE)))

    def grams(words: Column, n: int) -> Column:
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        at = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(at, lambda i: F.slice(words, i, n))

    def of_size(n: int) -> Column:
        return F.flatten(F.transform(segments(text), lambda s: grams(s, n)))

    every = F.concat(*[of_size(n) for n in sizes])
    fit = F.filter(every, lambda g: ~F.array_contains(barred, F.element_at(g, 1)) & ~F.array_contains(barred, F.element_at(g, -1)) & ~F.exists(g, lambda w: w.rlike("^[0-9]+$")))
    return F.array_distinct(F.transform(fit, lambda g: F.array_join(g, " ")))


def escape_cell_split(line: str | Column) -> Column:
    """The cells of a pipe table's row; an escaped pipe stays in its cell."""
    inner = F.regexp_replace(F.trim(c(line)), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.trim(x))


def join_notes(*notes: Column) -> Column:
    """Notes that are not null with semicolons between; null if there are none."""
    return F.nullif(F.concat_ws("; ", *notes), F.lit(""))


def report_name(path: str | Column) -> Column:
    """Where the rendered form of a report source lies."""
    p = c(path)
    return F.when(F.endswith(p, F.lit(".source.md")), F.regexp_replace(p, r"\.source\.md$", ".md")).otherwise(F.regexp_replace(p, r"(\.md)?$", ".rendered.md"))


def surname(author: str | Column) -> Column:
    """What stands before the comma, else the last word that is not a run of initials."""
    a = F.trim(c(author))
    last = F.element_at(F.split(F.regexp_replace(a, INITIALS, ""), " "), -1)
    return F.when(F.contains(a, F.lit(",")), F.trim(F.split_part(a, F.lit(","), F.lit(1)))).otherwise(last)


def display_authors(authors: str | Column, shown: int = 3) -> Column:
    """The first authors by surname, and how many more there are."""
    a = F.filter(F.coalesce(c(authors), F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    names = F.array_join(F.transform(F.slice(a, 1, shown), lambda x: surname(x)), ", ")
    return F.when(F.size(a) > shown, F.concat(names, F.lit(" et al."))).otherwise(names)


def display_names(authors: str | Column, shown: int) -> Column:
    """The first names as they are written, and et al. where there are more; '' where there is none."""
    a = F.filter(F.transform(F.coalesce(c(authors), F.expr("cast(array() as array<string>)")), lambda x: collapse(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    names = F.array_join(F.slice(a, 1, shown), ", ")
    return F.when(F.size(a) > shown, F.concat(names, F.lit(" et al."))).otherwise(names)


def citation_text(authors: str | Column, year: str | Column) -> Column:
    """Surname, or surname and others, and year; Anon and n.d. where unknown."""
    a = F.filter(F.coalesce(c(authors), F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    who = F.when(F.size(a) == 0, F.lit("Anon")).when(F.size(a) == 1, surname(F.get(a, F.lit(0)))).otherwise(F.concat(surname(F.get(a, F.lit(0))), F.lit(" et al.")))
    return F.concat(who, F.lit(", "), F.coalesce(c(year).cast("string"), F.lit("n.d.")))


def normalize_doi(doi: str | Column) -> Column:
    """A DOI in lower case without blanks around, prefix and resolver; '' where there is none."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c(doi), F.lit("")))), r"^(https?://[^/]+/|doi: *)", "")


def normalize_arxiv(arxiv_id: str | Column) -> Column:
    """An arXiv identifier in lower case without prefix, address and version; '' where there is none."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(c(arxiv_id), F.lit("")))), r"^(https?://[^/]+/abs/|arxiv: *)", "")
    return F.regexp_replace(bare, r"v[0-9]+$", "")


def looks_like_arxiv(arxiv_id: str | Column) -> Column:
    return F.lower(F.trim(c(arxiv_id))).rlike(r"^(arxiv:)?([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})(v[0-9]+)?$")


def find_doi(text: str | Column) -> Column:
    """The first DOI in a text, or ''."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c(text), F.lit("")), r"(10\.[0-9]{4,9}/[^ \t\r\n,;]+)", 1), r"[.)]+$", "")


def find_arxiv(text: str | Column) -> Column:
    """The first arXiv identifier in a text, without version: after a prefix, else of a known form; or ''."""
    t = F.lower(F.coalesce(c(text), F.lit("")))
    marked = F.regexp_extract(t, r"arxiv[: ]\s*([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7})", 1)
    bare = F.regexp_extract(t, r"(?:^|[^0-9a-z./])((?:astro-ph|cond-mat|gr-qc|hep-(?:ex|lat|ph|th)|math-ph|nucl-(?:ex|th)|physics|quant-ph)/[0-9]{7})", 1)
    return F.coalesce(F.nullif(marked, F.lit("")), bare)


def find_year(text: str | Column) -> Column:
    """The last year in brackets, else the last plausible one at all; none later than next year; null if there is none."""
    t = F.regexp_replace(F.coalesce(c(text), F.lit("")), r"10\.[0-9]{4,9}/[^ \t\r\n,;]+|[0-9]{4}\.[0-9]{4,5}", " ")
    inner = F.regexp_extract_all(t, F.lit(r"\(([0-9]{4})\)"), F.lit(1))
    bare = F.regexp_extract_all(t, F.lit(r"\b((?:18|19|20)[0-9]{2})\b"), F.lit(1))
    latest = F.year(F.current_date()) + 1
    fit = lambda a: F.filter(a, lambda y: y.cast("int") <= latest)
    last = lambda a: F.get(fit(a), F.size(fit(a)) - 1)
    return F.when(F.size(inner) > 0, last(inner)).otherwise(last(bare)).try_cast("int")


def volume_page(key: str | Column) -> Column:
    """A journal key without its journal, null where there is none."""
    return F.when(F.contains(c(key), F.lit(",")), F.substring_index(c(key), ",", -2))


def journal_parts(journal: str | Column) -> Column:
    """(name, volume, page) of a printed journal reference in either order of year and page."""
    t = F.coalesce(c(journal), F.lit(""))
    a, b = r"^(.*?) ?([0-9]+) \(([0-9]{4})\) ([0-9]+)", r"^(.*?) ?([0-9]+), ([0-9]+)"
    pick = lambda i, j: F.coalesce(F.nullif(F.regexp_extract(t, a, i), F.lit("")), F.regexp_extract(t, b, j))
    return F.struct(pick(1, 1).alias("name"), pick(2, 2).alias("volume"), pick(4, 3).alias("page"))


def page_count(comment: str | Column, other: str | Column) -> Column:
    """Pages named in a comment, else a provider's; only counts of 1 to 1000 are believed."""
    own = F.regexp_extract(F.coalesce(c(comment), F.lit("")), r"(?i)([0-9]+) *pages?\b", 1).try_cast("int")
    good = lambda x: F.when(x.between(1, 1000), x)
    return F.coalesce(good(own), good(c(other)))


def anchor_slug(label: str | Column) -> Column:
    return F.regexp_replace(F.lower(c(label)), "[^a-z0-9]+", "-")


def sentence_marks(text: str | Column, clauses: bool = False) -> Column:
    """A collapsed text in which a \\x02 stands for every blank that parts sentences, of equal length.

    A mark and a blank part unless an abbreviation stands before the mark; two passes find
    abbreviations that follow each other.  Clauses are parted by semicolons too.
    """
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    marks = "[.!?;]" if clauses else "[.!?]"
    t = c(text)
    for _ in range(2):
        t = F.regexp_replace(t, rf"(^|[^A-Za-z.])({known})(\.*{marks}) ", "$1$2$3\x01")
    return F.regexp_replace(t, rf"({marks}) ", "$1\x02")


def sentences(text: str | Column, clauses: bool = False) -> Column:
    """Sentences, or clauses, that neither abbreviations nor numbers end; white space is collapsed."""
    parts = F.split(sentence_marks(collapse(F.coalesce(c(text), F.lit(""))), clauses), "\x02")
    return F.filter(F.transform(parts, lambda x: F.trim(F.translate(x, "\x01", " "))), lambda x: x != "")


def first_sentence(text: str | Column, limit: int) -> Column:
    """The first sentence, cut to a limit; '' where there is none."""
    return F.coalesce(truncate(F.get(sentences(text), F.lit(0)), limit), F.lit(""))


def readable(text: str | Column) -> Column:
    """Prose without inline formulas and citation or reference markers."""
    return collapse(F.regexp_replace(F.regexp_replace(F.coalesce(c(text), F.lit("")), r"\$[^$]*\$", " "), r"\[(?:cite|ref):[^\]]*\]", " "))


def cite_tags(text: str | Column) -> Column:
    """Tags of all citation markers of a text, in order."""
    inner = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(r"\[cite: *([^\]]*)\]"), F.lit(1))
    return F.filter(F.flatten(F.transform(inner, lambda s: F.split(s, " *, *"))), lambda t: t != "")


def ref_labels(text: str | Column) -> Column:
    """Labels of all reference markers of a text, in order."""
    return F.filter(F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(r"\[ref: *([^\]]*)\]"), F.lit(1)), lambda t: t != "")
