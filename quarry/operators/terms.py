"""Terminology: units of text, weighted n-grams, merged variants, subsumption, the report and stated aliases."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.runtime import cut

# What an occurrence weighs by the kind of text, the words that join two names and the sizes of their window.
STRUCTURE = {"heading": 6, "abstract": 4, "caption": 2, "body": 1, "title": 1}
CUES = ["also known as", "sometimes referred to as", "more often referred to as", "sometimes also called", "sometimes called", "also called", "referred to as", "known as", "namely", "i.e.", "termed", "or"]
ALIAS_WINDOW = 6
# End.
SUBSUME_PERCENT = 80
EXAMPLES = 3
BRACKET_WORDS = 3
PIVOT_BRACKET_WORDS = 2
QUOTED = 240
#: Where the title and the abstract of a paper stand among its chapters.
PAPER = "paper"
ORDER = ["slug", "rank", "chapter", "idx", "n"]


def units(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """(slug, kind, chapter, anchor, rank, idx, n, text): titles and headings whole, other prose clause by clause.

    Formulas and markers are left out; ``ORDER`` is the order of reading.
    """
    kind = F.when(F.col("kind") == "heading", "heading").when(F.col("kind").isin("figure", "table"), "caption").when(F.col("kind") == "paragraph", "body")
    inner = blocks.select("slug", kind.alias("kind"), F.col("stem").alias("chapter"), F.coalesce("anchor", F.lit("")).alias("anchor"), F.lit(1).alias("rank"), F.col("idx").cast("long").alias("idx"), T.readable(T.words_of_block()).alias("said")).filter("kind is not null")
    page = lambda kind, text, at: papers.select("slug", F.lit(kind).alias("kind"), F.lit(PAPER).alias("chapter"), F.lit("").alias("anchor"), F.lit(0).alias("rank"), F.lit(at).cast("long").alias("idx"), T.readable(text).alias("said"))
    every = inner.unionByName(page("heading", "title", 0)).unionByName(page("abstract", "abstract", 1)).filter("said <> ''")
    parts = F.when(F.col("kind") == "heading", F.array("said")).otherwise(T.sentences("said", clauses=True))
    return every.select("slug", "kind", "chapter", "anchor", "rank", "idx", F.posexplode(parts).alias("n", "text")).filter("text <> ''")


def _weight() -> Column:
    return F.create_map(*[F.lit(x) for pair in STRUCTURE.items() for x in pair])[F.col("kind")]


def weights(texts: DataFrame) -> DataFrame:
    """(term, weight, units): terms of (kind, text) units, each counted once a unit at its structure's weight."""
    rows = texts.select(_weight().alias("w"), F.explode(T.ngrams("text")).alias("term"))
    return rows.groupBy("term").agg(F.sum("w").cast("long").alias("weight"), F.count("*").alias("units"))


def examples(titles: DataFrame) -> DataFrame:
    """(term, weight, examples): terms of titles (key, title) with the ``EXAMPLES`` smallest keys that hold them.

    Keys are kept by rank in a window with a group limit, so a frequent term never gathers all of its keys.
    """
    rows = titles.select("key", F.explode(T.ngrams("title")).alias("term"))
    counted = rows.groupBy("term").agg(F.count("*").alias("weight"))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("term").orderBy("key"))).filter(F.col("rn") <= EXAMPLES)
    shown = first.groupBy("term").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    return counted.join(shown, "term")


def keyed_terms(weighted: DataFrame) -> DataFrame:
    """(term, weight, key): a term's words without their plural endings, where the words of all terms attest the rest.

    ``es`` is tried before ``s``.
    """
    words = weighted.select(F.explode(F.split("term", " ")).alias("w")).distinct()
    ending = lambda e, rank: F.when(F.endswith("w", F.lit(e)), F.struct(F.lit(rank).alias("rank"), F.expr(f"substring(w, 1, length(w) - {len(e)})").alias("stem")))
    tried = words.select("w", F.explode(F.array_compact(F.array(ending("es", 0), ending("s", 1)))).alias("t")).select("w", "t.rank", "t.stem")
    single = tried.join(words.select(F.col("w").alias("stem")), "stem", "left_semi").groupBy("w").agg(F.min_by("stem", "rank").alias("stem"))
    parts = weighted.select("term", "weight", F.posexplode(F.split("term", " ")).alias("i", "w")).join(single, "w", "left")
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("stem", "w").alias("s")))), lambda x: x["s"]), " ")
    return parts.groupBy("term", "weight").agg(spelt.alias("key"))


def merged(weighted: DataFrame) -> DataFrame:
    """(key, label, weight): variants made one; the label is the heaviest form, of equal ones the first by letters."""
    return keyed_terms(weighted.select("term", "weight")).groupBy("key").agg(F.min_by("term", F.struct(-F.col("weight"), "term")).alias("label"), F.sum("weight").alias("weight"))


def subsumed(weighted: DataFrame) -> DataFrame:
    """Terms of (term, weight) without those that a longer term holds at ``SUBSUME_PERCENT`` of their weight or more.

    The longer terms' inner word runs are joined by equality; nothing is compared pairwise.
    """
    words = F.split("term", " ")
    longer = weighted.filter(F.size(words) > 2).select(F.col("weight").alias("long_weight"), words.alias("w"))
    inner = longer.select("long_weight", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("term"))
    inner = inner.groupBy("term").agg(F.max("long_weight").alias("long_weight"))
    gone = weighted.join(inner, "term").filter(F.col("weight") * SUBSUME_PERCENT <= F.col("long_weight") * 100).select("term")
    return weighted.join(gone, "term", "left_anti")


def pivot(texts: DataFrame, topic: list[str]) -> DataFrame:
    """(term, units): the topic word that the fewest units hold, by letters where equal; the first word if none holds any.

    One pass with a counter for each of the at most ``MAX_TERMS`` topic words.
    """
    held = texts.select(T.held_terms("text", topic).alias("held"))
    counts = held.agg(*[F.count_if(F.array_contains("held", t)).alias(f"n{i}") for i, t in enumerate(topic)])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(t).alias("term"), F.col(f"n{i}").alias("units")) for i, t in enumerate(topic)])).alias("r")).select("r.*")
    return rows.orderBy(F.col("units") == 0, F.when(F.col("units") > 0, F.col("units")), F.when(F.col("units") > 0, F.col("term")), "at").limit(1).select("term", "units")


def shared_words(label: Column, topic: list[str]) -> tuple[Column, Column]:
    """The words of a term that the topic carries, and those it does not."""
    carried = lambda w: F.exists(T.strings(topic), lambda t: T.word_matches(w, t))
    words = F.split(label, " ")
    return F.filter(words, carried), F.filter(words, lambda w: ~carried(w))


def report(texts: DataFrame, titles: DataFrame, topic: list[str], least: int = 4, most: int = 20) -> DataFrame:
    """(term, weight, shared, new, score, places): what the texts hold beside the topic, the best ``most`` terms.

    Weights of units and of titles (title) add up, variants are merged before the least weight is asked
    for, terms of topic words only are left out, shorter terms give way to longer ones, and every shared
    word lowers the score by its part of the term.  ``places`` are the first ``EXAMPLES`` that hold it.
    """
    own = titles.select(F.lit("title").alias("kind"), F.col("title").alias("text"))
    every = texts.select("kind", "text").unionByName(own)
    keyed = cut(keyed_terms(weights(every).select("term", "weight")))
    labels = keyed.groupBy("key").agg(F.min_by("term", F.struct(-F.col("weight"), "term")).alias("label"), F.sum("weight").alias("weight")).filter(F.col("weight") >= least)
    shared, new = shared_words(F.col("label"), topic)
    kept = labels.withColumn("shared", shared).withColumn("new", new).filter(F.size("new") > 0)
    stays = subsumed(kept.select(F.col("key").alias("term"), "weight")).select(F.col("term").alias("key"))
    score = F.round(F.col("weight") * (1 - F.size("shared") / F.size(F.split("label", " "))), 4)
    best = cut(kept.join(stays, "key").withColumn("score", score).orderBy(F.desc("score"), F.desc("weight"), "label").limit(most))
    forms = F.broadcast(keyed.join(best.select("key"), "key").select("term", "key"))  # the spellings of at most ``most`` terms
    rows = texts.select(*ORDER, "anchor", F.explode(T.ngrams("text")).alias("term")).join(forms, "term")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*ORDER))
    where = T.location("slug", "chapter")
    first = rows.select("key", *ORDER, where.alias("where")).distinct().withColumn("rn", rank).filter(F.col("rn") <= EXAMPLES)
    places = first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "where"))), lambda x: x["where"]), " ").alias("places"))
    return best.join(places, "key", "left").select(F.col("label").alias("term"), "weight", F.array_join("shared", " ").alias("shared"), F.array_join("new", " ").alias("new"), "score", F.coalesce("places", F.lit("")).alias("places"))


def _matches(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= T.MIN_PREFIX and (a.startswith(b) or b.startswith(a)))


def _spoken(text: str) -> list[str]:
    """Words in order with brackets as words of their own."""
    plain = re.sub(r"([0-9A-Za-z])[-‐‑](?=[0-9A-Za-z])", r"\1 ", re.sub(r"\\[a-zA-Z]+", " ", text))
    return re.findall(r"[()]|[0-9a-z]+", plain.lower())


def _claims(pivot_word: str, topic: list[str]):
    cues = [(" ".join(c.replace(".", " ").split()), c) for c in CUES]
    cue_words = {w for c, _ in cues for w in c.split()}
    barred, stop = set(T.TOPIC_STOPWORDS) | set(T.FURNITURE), set(T.TOPIC_STOPWORDS) | cue_words

    def named(gram: tuple[str, ...]) -> bool:
        if gram[0] in barred or gram[-1] in barred or any(w in stop or w.isdigit() for w in gram):
            return False
        return not all(any(_matches(w, t) for t in topic) for w in gram)

    def inside(spans: list[list[str]], gram: tuple[str, ...]) -> bool:
        for span in spans:
            runs = {tuple(span[i: i + len(gram)]) for i in range(len(span) - len(gram) + 1)}
            if gram in runs or (len(span) <= PIVOT_BRACKET_WORDS and any(_matches(pivot_word, w) for w in span)):
                return True
        return False

    def of(text: str) -> Iterator[tuple[str, str, int]]:
        spoken = _spoken(text)
        for at in (i for i, w in enumerate(spoken) if _matches(pivot_word, w)):
            window = spoken[max(0, at - ALIAS_WINDOW): at + ALIAS_WINDOW + 1]
            words = [w for w in window if w not in "()"]
            line = f" {' '.join(words)} "
            cue = next((shown for said, shown in cues if f" {said} " in line), "")
            joined = " ".join(window)
            spans = [s for b in re.findall(r"\( ([^()]*)\)", joined) if 0 < len(s := b.split()) <= BRACKET_WORDS]
            if cue or spans:
                for n in (2, 3):
                    for gram in zip(*(words[i:] for i in range(n))):
                        if named(gram) and (cue or inside(spans, gram)):
                            yield " ".join(gram), cue or "()", at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(term, cue, at, *r[:-1], r[-1][:QUOTED]) for r in zip(*(batch[c] for c in (*ORDER, "anchor", "text"))) for term, cue, at in of(r[-1])]
            yield pd.DataFrame(rows, columns=["term", "cue", "at", *ORDER, "anchor", "quote"])

    return run


def stated_aliases(texts: DataFrame, weighted: DataFrame, pivot_word: str, topic: list[str], most: int = 10) -> DataFrame:
    """(term, slug, chapter, anchor, cue, quote): names that units put beside the pivot word with a cue or in brackets.

    Only units that can hold the pivot reach Python.  Of each name the first claim counts; of names of
    one place the longest stays; of spellings that differ by plurals the heaviest; the ``most`` heaviest
    come out, ties by letters.  No pivot, no aliases.
    """
    shape = "term string, cue string, at int, slug string, rank int, chapter string, idx long, n int, anchor string, quote string"
    if not pivot_word:
        return texts.sparkSession.createDataFrame([], "term string, slug string, chapter string, anchor string, cue string, quote string")
    near = texts.filter(F.contains(F.lower("text"), F.lit(pivot_word[: T.MIN_PREFIX])))
    found = near.mapInPandas(_claims(pivot_word, topic), shape)
    first = cut(found.withColumn("rn", F.row_number().over(Window.partitionBy("term").orderBy(*ORDER, "at"))).filter("rn = 1"))
    words = F.split("term", " ")
    longer = first.filter(F.size(words) > 2).select("slug", "chapter", "anchor", F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("term"))
    kept = first.join(longer.distinct(), ["slug", "chapter", "anchor", "term"], "left_anti")
    known = keyed_terms(weighted.select("term", "weight")).join(kept.select("term"), "term", "left_semi")
    ranked = kept.join(known, "term", "left").withColumn("key", F.coalesce("key", "term")).withColumn("weight", F.coalesce("weight", F.lit(0)))
    once = ranked.withColumn("one", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "term"))).filter("one = 1")
    return once.orderBy(F.desc("weight"), "term").limit(most).select("term", "slug", "chapter", "anchor", "cue", "quote")


def aliases(texts: DataFrame, name: str) -> DataFrame:
    """(alias, cue, claims): names that units (text) put beside ``name`` with a cue or in short brackets."""
    low = F.lower(T.collapse("text"))
    near = rf"{name}s?(?: \(([a-z][a-z -]{{2,30}})\)|(?: ?, ?| )({'|'.join(c.replace('.', r'[.]') for c in CUES)}),? (?:an? |the )?((?:[a-z-]+ ?){{1,2}}))"
    claims = F.explode(F.regexp_extract_all(low, F.lit(f"(?=({near}))"), 1))  # a claim may begin within another's alias
    hits = texts.filter(F.contains(low, F.lit(name))).select(claims.alias("t"))
    hits = hits.select(F.regexp_extract("t", near, 1).alias("b"), F.regexp_extract("t", near, 2).alias("cue"), F.regexp_extract("t", near, 3).alias("a"))
    rows = hits.select(F.trim(F.when(F.col("b") != "", F.col("b")).otherwise(F.col("a"))).alias("alias"), F.when(F.col("b") != "", F.lit("()")).otherwise(F.col("cue")).alias("cue"))
    return rows.filter("alias <> ''").groupBy("alias", "cue").agg(F.count("*").alias("claims"))
