"""Identity, matching, merging and lookup of cited works."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.functions import text as T

#: Names of the key kinds, strongest first; ``raw`` counts only where nothing else is known.
KINDS = ["doi", "arxiv", "inspire", "journal", "title"]
# Venues whose name says that a paper is a review, and the document type that does.
REVIEW_VENUES = ["Phys.Rept.", "Rev.Mod.Phys.", "Prog.Part.Nucl.Phys.", "Ann.Rev.Nucl.Part.Sci.", "Ann.Rev.Astron.Astrophys.", "Living Rev.Rel."]
REVIEW_TYPE = "review"
# End.
#: Handles of a bibliography line, strongest first.
CASCADE = ["doi", "arxiv", "journal", "volume_page", "title"]
LEAST_SLUG = 24
SHOWN = 5
ID_BUCKETS = 4_096
MERGEABLE = ["title", "authors", "year", "journal", "journal_key", "doi", "arxiv_id", "inspire_id", "citation_count"]


def identity_keys(prefix: str = "") -> Column:
    """Keys of a record in order of strength, null where a field gives none.

    Stand-ins name nothing: a DOI must have a suffix, an arXiv id its form, a journal key three parts.
    """
    col = lambda n: F.col(prefix + n)
    doi, arxiv = T.normalize_doi(col("doi")), T.normalize_arxiv(col("arxiv_id"))
    journal = F.lower(F.regexp_replace(F.coalesce(col("journal_key"), F.lit("")), "[^0-9a-zA-Z,]+", ""))
    title = T.normalize_title(col("title"))
    strong = [
        F.when(doi.rlike("^10[.][0-9]+/.+"), F.concat(F.lit("doi:"), doi)),
        F.when(T.looks_like_arxiv(arxiv), F.concat(F.lit("arxiv:"), arxiv)),
        F.when(F.coalesce(col("inspire_id"), F.lit("")).rlike("^[0-9]+$"), F.concat(F.lit("inspire:"), col("inspire_id"))),
        F.when(journal.rlike("^[^,]+,[^,]+,[^,]+$"), F.concat(F.lit("journal:"), journal)),
        F.when((title != "") & col("year").isNotNull(), F.concat(F.lit("title:"), title, F.lit("|"), col("year").cast("string"))),
    ]
    return F.array(*strong)


def keyed(records: DataFrame, key: str) -> DataFrame:
    """(key, identity, priority): one row for each key of a record, priority 0 the strongest."""
    rows = records.select(F.col(key), F.posexplode(identity_keys()).alias("priority", "identity"))
    return rows.filter("identity is not null").select(key, "identity", F.col("priority").cast("long").alias("priority"))


def priority_match(probe: DataFrame, key: str, store: DataFrame, store_key: str = "work_id") -> DataFrame:
    """(key, store_key, priority): the stored record of the strongest shared key; the smallest id wins a key."""
    index = keyed(store, store_key).groupBy("identity").agg(F.min(store_key).alias(store_key))
    hits = keyed(probe, key).join(index, "identity")
    return hits.groupBy(key).agg(F.min_by(store_key, F.struct("priority", store_key)).alias(store_key), F.min("priority").alias("priority"))


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that name one value only."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("other")).filter(F.col(value) == F.col("other")).drop("other")


def shared_identities(store: DataFrame) -> DataFrame:
    """(identity, count, tags): keys other than titles that stand under several tags, with the first ``SHOWN`` of them."""
    rows = keyed(store.filter("tag is not null"), "tag").filter("priority < 4").select("identity", "tag").distinct()
    several = rows.groupBy("identity").agg(F.count("*").alias("count")).filter("count > 1")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("identity").orderBy("tag"))).filter(F.col("rn") <= SHOWN)
    return several.join(first.groupBy("identity").agg(F.sort_array(F.collect_list("tag")).alias("tags")), "identity")


def from_records(records: DataFrame) -> DataFrame:
    """Catalogue records in the fields of a stored work; nested lists give their first publication."""
    m = F.col("metadata")
    publication = F.get(F.filter(m["publication_info"], lambda p: F.coalesce(p["material"], F.lit("publication")) != "erratum"), F.lit(0))
    letters = F.regexp_replace(F.lower(publication["journal_title"]), "[^0-9a-z]+", "")
    first_page = F.coalesce(publication["page_start"], publication["artid"])
    return records.select(
        "control_number",
        F.get(m["titles"], F.lit(0))["title"].alias("title"),
        m["authors"]["full_name"].alias("authors"),
        publication["year"].alias("year"),
        F.concat_ws(" ", publication["journal_title"], publication["journal_volume"], F.concat(F.lit("("), publication["year"].cast("string"), F.lit(")")), first_page).alias("journal"),
        F.concat_ws(",", letters, publication["journal_volume"], first_page).alias("journal_key"),
        F.get(m["dois"], F.lit(0))["value"].alias("doi"),
        F.get(m["arxiv_eprints"], F.lit(0))["value"].alias("arxiv_id"),
        F.col("control_number").cast("string").alias("inspire_id"),
        m["citation_count"].alias("citation_count"),
        m["document_type"].alias("document_type"),
        m["number_of_pages"].alias("pages"),
    )


def work_kind(journal: Column, types: Column) -> Column:
    """review by document type or the beginning of the venue, else article where either is known, else unknown."""
    squeezed = lambda c: F.replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("")), F.lit("."), F.lit(""))
    venue = squeezed(journal)
    named = F.filter(F.transform(F.coalesce(types, F.expr("cast(array() as array<string>)")), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    review = F.array_contains(named, REVIEW_TYPE)
    for v in REVIEW_VENUES:
        review = review | F.startswith(venue, squeezed(F.lit(v)))
    return F.when(review, "review").when((venue != "") | (F.size(named) > 0), "article").otherwise("unknown")


def held_index(papers: DataFrame) -> DataFrame:
    """(identity, slug): which paper holds a work; of papers sharing a key the last in name order."""
    doi, arxiv = T.normalize_doi("doi"), T.normalize_arxiv("arxiv_id")
    keys = F.array_compact(F.array(F.when(doi.rlike("^10[.][0-9]+/.+"), F.concat(F.lit("doi:"), doi)), F.when(T.looks_like_arxiv(arxiv), F.concat(F.lit("arxiv:"), arxiv))))
    return papers.select("slug", F.explode(keys).alias("identity")).groupBy("identity").agg(F.max("slug").alias("slug"))


def mark_held(store: DataFrame, papers: DataFrame) -> DataFrame:
    """(work_id, held, changed): the paper that holds each work, by DOI or arXiv id, and whether that is news."""
    hits = keyed(store, "work_id").filter("priority < 2").join(held_index(papers), "identity")
    held = hits.groupBy("work_id").agg(F.min_by("slug", "priority").alias("held"))
    return store.select("work_id", "held_as").join(held, "work_id", "left").select("work_id", "held", (~F.col("held").eqNullSafe(F.nullif("held_as", F.lit("")))).alias("changed"))


def status(store: DataFrame, papers: DataFrame, probe: DataFrame, key: str) -> DataFrame:
    """(key, status): held where a paper has the work, cited where only the store does, else new."""
    matched = priority_match(probe, key, store).select(key, "work_id")
    held = keyed(probe, key).filter("priority < 2").join(held_index(papers), "identity").select(key, "slug").groupBy(key).agg(F.min("slug").alias("slug"))
    both = probe.select(key).join(matched, key, "left").join(held, key, "left")
    return both.select(key, F.when(F.col("slug").isNotNull(), "held").when(F.col("work_id").isNotNull(), "cited").otherwise("new").alias("status"))


def fill(store: DataFrame, source: DataFrame, matches: DataFrame, overwrite: bool) -> DataFrame:
    """Stored works with fields of their matched source record: filled where empty, or the source's where it has any.

    ``matches`` has control_number and work_id; of several records for one work the smallest number counts.
    """
    chosen = matches.groupBy("work_id").agg(F.min("control_number").alias("control_number"))
    joined = store.alias("w").join(chosen, "work_id", "left").join(source.alias("s"), "control_number", "left")
    fields = ["title", "year", "journal", "doi"]
    kind = {f: dict(store.dtypes)[f] for f in fields}

    def value(f: str) -> Column:
        own, new = F.col(f"w.{f}"), F.col(f"s.{f}")
        if kind[f] == "string":
            own, new = F.nullif(own, F.lit("")), F.nullif(new, F.lit(""))
        return F.coalesce(new, own) if overwrite else F.coalesce(own, new)

    return joined.select("work_id", *[value(f).cast("long" if kind[f] == "int" else kind[f]).alias(f) for f in fields], F.col("control_number").isNotNull().alias("matched"))


def score(prefix: str = "") -> Column:
    """How much a record knows: verified first, then the number of filled fields."""
    col = lambda n: F.col(prefix + n)
    filled = [F.when(F.coalesce(col(n).cast("string"), F.lit("")) != "", 1).otherwise(0) for n in ("title", "year", "journal", "doi", "arxiv_id")]
    return F.when(F.coalesce(col("verified"), F.lit(False)), 10).otherwise(0) + sum(filled[1:], filled[0])


def upsert(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """(key, action): what a merge of incoming records (key and the fields of a work) does.

    The merge is a set: incoming records are tied to the store by their strongest shared key; a
    record tied to nothing is added once for all incoming records with the same strongest key; a tied
    record updates the stored one only if it knows more.  The store never shrinks.
    """
    tied = priority_match(incoming, "key", store)
    news = keyed(incoming, "key").groupBy("key").agg(F.min_by("identity", "priority").alias("strongest"))
    leaders = news.join(tied, "key", "left_anti").groupBy("strongest").agg(F.min("key").alias("leader"))
    known = store.select("work_id", score().alias("have"))
    rows = incoming.select("key", score().alias("bring")).join(tied.select("key", "work_id"), "key", "left").join(known, "work_id", "left").join(news, "key", "left").join(leaders, "strongest", "left")
    action = F.when(F.col("work_id").isNotNull(), F.when(F.col("bring") > F.col("have"), "updated").otherwise("unchanged"))
    return rows.select("key", action.when(F.col("leader").isNull() | (F.col("leader") == F.col("key")), "added").otherwise("repeated").alias("action"))


def slugify(text: Column, limit: int = 48, default: str = "section", whole_words: bool = False) -> Column:
    """Lower-case ASCII words joined by underscores, accents folded; cut at ``limit``, at a word's start if asked.

    There is no built-in that folds accents, so this is an Arrow-batched function; null counts as ''.
    """
    def one(value: str | None) -> str:
        folded = unicodedata.normalize("NFKD", re.sub(r"\\[a-zA-Z]+", " ", value or ""))
        name = "_".join(re.findall("[0-9a-z]+", "".join(c for c in folded if not unicodedata.combining(c)).lower()))
        short = name[:limit]
        if whole_words and len(name) > limit and name[limit] != "_" and short.rfind("_") >= LEAST_SLUG:
            short = short[: short.rfind("_")]
        return short.rstrip("_") or default

    return pandas_udf(lambda values: values.map(one), "string")(text)


def base_tag() -> Column:
    """surname_year_words: first author, year and four telling words of the title, or else of the journal."""
    who = slugify(T.surname(F.get("authors", F.lit(0))), 24, "anon")
    subject = F.coalesce(F.nullif("title", F.lit("")), F.nullif("journal", F.lit("")), F.lit(""))
    words = F.filter(F.split(slugify(subject, 200, ""), "_"), lambda w: (w != "") & ~F.array_contains(T.strings(T.TAG_STOPWORDS), w) & ~w.rlike("^[0-9]+$"))
    what = F.nullif(F.array_join(F.slice(words, 1, 4), "_"), F.lit(""))
    return F.concat_ws("_", who, F.coalesce(F.col("year").cast("string"), F.lit("nd")), what)


def lookup(store: DataFrame, tags: list[str] = (), needle: str = "", dois: list[str] = (), arxiv: list[str] = (), cited_by: list[str] = ()) -> DataFrame:
    """Records that any selector names: tags, DOIs or arXiv ids however written, papers that cite them, or a phrase.

    Most cited first, unknown counts last, ties by tag and id; a record that several selectors name
    comes once.  Without a selector there is nothing.
    """
    hay = F.lower(F.concat_ws(" ", "tag", "title", F.array_join(F.coalesce("authors", F.expr("cast(array() as array<string>)")), " "), "journal"))
    hits = [F.col("tag").isin(list(tags))] if tags else []
    hits += [F.contains(hay, F.lit(needle.lower()))] if needle else []
    hits += [T.normalize_doi("doi").isin([normal_doi(d) for d in dois])] if dois else []
    hits += [T.normalize_arxiv("arxiv_id").isin([normal_arxiv(a) for a in arxiv])] if arxiv else []
    hits += [F.exists(F.coalesce("cited_by", F.expr("filter(cited_by, x -> false)")), lambda e: e["slug"].isin(list(cited_by)))] if cited_by else []
    hit = F.lit(False)
    for h in hits:
        hit = hit | F.coalesce(h, F.lit(False))
    return store.filter(hit).orderBy(F.col("citation_count").desc_nulls_last(), "tag", "work_id")


def normal_doi(value: str) -> str:
    return re.sub(r"^(https?://[^/]+/|doi: *)", "", value.strip().lower())


def normal_arxiv(value: str) -> str:
    return re.sub(r"v[0-9]+$", "", re.sub(r"^(https?://[^/]+/abs/|arxiv: *)", "", value.strip().lower()))


def missing(store: DataFrame, tags: list[str] = (), dois: list[str] = (), arxiv: list[str] = ()) -> DataFrame:
    """(kind, asked): what was asked for by name and no record answers to."""
    spark = store.sparkSession
    asked = [("tag", t, t) for t in tags] + [("doi", d, normal_doi(d)) for d in dois] + [("arxiv", a, normal_arxiv(a)) for a in arxiv]
    rows = F.broadcast(spark.createDataFrame(asked, "kind string, asked string, value string"))  # what a person typed
    own = store.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("tag", F.col("tag")), ("doi", T.normalize_doi("doi")), ("arxiv", T.normalize_arxiv("arxiv_id")))])).alias("x")).select("x.*")
    known = own.join(rows.select("kind", "value"), ["kind", "value"], "left_semi").distinct()
    return rows.join(known, ["kind", "value"], "left_anti").select("kind", "asked")


def cited_by(store: DataFrame, papers: DataFrame) -> DataFrame:
    """Records that one of the papers (slug) cites."""
    edges = store.select("work_id", F.explode("cited_by.slug").alias("slug")).join(papers.select("slug").distinct(), "slug", "left_semi")
    return store.join(edges.select("work_id").distinct(), "work_id", "left_semi")


def cited_from_store(store: DataFrame, slug: str, most: int = 40) -> DataFrame:
    """(work_id, tag, cited): what a paper cites, most cited first."""
    spark = store.sparkSession
    mine = cited_by(store, spark.createDataFrame([(slug,)], "slug string"))
    return mine.orderBy(F.col("citation_count").desc_nulls_last(), "tag", "work_id").limit(most).select("work_id", "tag", F.col("citation_count").cast("long").alias("cited"))


def known_citers(probe: DataFrame, key: str, store: DataFrame) -> DataFrame:
    """(key, citers, first): for probes that the store knows, how many papers cite the work and the first ``SHOWN`` of them."""
    matched = priority_match(probe, key, store).select(key, "work_id")
    edges = store.select("work_id", F.explode("cited_by.slug").alias("slug")).filter("coalesce(slug, '') <> ''").distinct()
    rows = matched.join(edges, "work_id").select(key, "slug").distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("slug"))
    first = rows.withColumn("rn", rank).filter(F.col("rn") <= SHOWN).groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("slug")), ",").alias("first"))
    return rows.groupBy(key).agg(F.count("*").alias("citers")).join(first, key)


def publication_keys(records: DataFrame) -> DataFrame:
    """(control_number, key): a journal key for every way in which a record says where it appeared."""
    rows = records.select("control_number", F.explode("metadata.publication_info").alias("p"))
    page = F.coalesce(F.nullif("p.page_start", F.lit("")), "p.artid")
    parts = [F.regexp_replace(F.lower("p.journal_title"), "[^0-9a-z]+", ""), F.col("p.journal_volume"), page]
    full = [F.coalesce(x, F.lit("")) != "" for x in (F.col("p.journal_title"), F.col("p.journal_volume"), page)]
    return rows.filter(full[0] & full[1] & full[2]).select("control_number", F.concat_ws(",", *parts).alias("key")).distinct()


def reference_cascade(entries: DataFrame, key: str, store: DataFrame) -> DataFrame:
    """(key, work_id, match): what a line of a bibliography is, by its strongest handle.

    Tried in order: doi, arxiv, journal, volume_page, title.  A handle of volume and page alone counts
    only if it names one record of the store; of the others the smallest id wins.  ``entries`` has the
    columns doi, arxiv_id, journal_key and title.
    """
    def handles(rows: DataFrame, name: str) -> DataFrame:
        place = F.lower(F.regexp_replace(F.coalesce("journal_key", F.lit("")), "[^0-9a-zA-Z,]+", ""))
        whole = F.when(place.rlike("^[^,]+,[^,]+,[^,]+$"), place)
        doi, arxiv = T.normalize_doi("doi"), T.normalize_arxiv("arxiv_id")
        values = [F.when(doi.rlike("^10[.][0-9]+/.+"), doi), F.when(T.looks_like_arxiv(arxiv), arxiv), whole, T.volume_page(whole), F.nullif(T.normalize_title("title"), F.lit(""))]
        kinds = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("match"), v.alias("handle")) for i, (k, v) in enumerate(zip(CASCADE, values))])
        return rows.select(F.col(name), F.explode(kinds).alias("h")).select(name, "h.*").filter("handle is not null")

    index = handles(store, "work_id").groupBy("rank", "handle").agg(F.min("work_id").alias("work_id"), F.max("work_id").alias("other"))
    index = index.filter((F.col("rank") != CASCADE.index("volume_page")) | (F.col("work_id") == F.col("other"))).drop("other")
    hits = handles(entries, key).join(index, ["rank", "handle"])
    return hits.groupBy(key).agg(F.min_by("work_id", F.struct("rank", "work_id")).alias("work_id"), F.min_by("match", "rank").alias("match"))


def merge_store(store: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works, rewrites): the store with incoming records (key, slug, citing_key, tag and the fields of a work) folded in.

    Incoming records are tied to the store by their strongest shared key, or else to each other, so
    one work is added once.  The better of the tied records, verified first, then with more fields
    filled, gives its non-empty fields; tag and held_as never change; citations are added to the ones
    there.  ``rewrites`` (tag, to) names incoming tags whose work the store calls otherwise.  As a set
    operation it does not depend on the order of the records; new works are numbered after the
    largest id, by their strongest key.
    """
    tied = priority_match(incoming, "key", store).select("key", "work_id")
    news = keyed(incoming, "key").groupBy("key").agg(F.min_by("identity", "priority").alias("strongest"))
    rows = incoming.join(tied, "key", "left").join(news, "key", "left").withColumn("strongest", F.coalesce("strongest", F.concat(F.lit("key:"), F.col("key").cast("string"))))
    fresh = rows.filter("work_id is null").select("strongest").distinct()
    largest = store.agg(F.coalesce(F.max("work_id"), F.lit(0)).alias("largest"))
    bucket = F.pmod(F.xxhash64("strongest"), F.lit(ID_BUCKETS))
    own = fresh.withColumn("bucket", bucket).withColumn("own", F.row_number().over(Window.partitionBy("bucket").orderBy("strongest")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ids = own.join(F.broadcast(starts), "bucket").crossJoin(F.broadcast(largest)).select("strongest", (F.col("largest") + F.col("start") + F.col("own")).alias("new_id"))  # ID_BUCKETS rows and one row
    rows = rows.join(ids, "strongest", "left").withColumn("work_id", F.coalesce("work_id", "new_id"))
    fields = [c for c in MERGEABLE if c in incoming.columns]
    filled = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "[]"), 0).otherwise(1) for c in fields), F.lit(0))
    verified = F.coalesce("verified", F.lit(False))
    best = rows.groupBy("work_id").agg(F.max_by(F.struct(*fields, "tag", verified.alias("verified"), filled.alias("filled")), F.struct(verified, filled, -F.col("key"))).alias("i"))
    edges = rows.filter("coalesce(slug, '') <> ''").select("work_id", F.struct("slug", F.col("citing_key").alias("key")).alias("e")).distinct().groupBy("work_id").agg(F.collect_list("e").alias("edges"))
    both = store.withColumn("stored", F.lit(True)).join(best, "work_id", "full").join(edges, "work_id", "left")
    had = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "[]"), 0).otherwise(1) for c in fields), F.lit(0))
    mine = F.coalesce(store["verified"], F.lit(False))
    better = F.col("stored").isNull() | (F.col("i.verified") & ~mine) | ((F.col("i.verified") == mine) & (F.col("i.filled") > had))
    kind = dict(store.dtypes)

    def value(c: str) -> Column:
        if c == "cited_by":
            none = F.expr(f"cast(array() as {kind['cited_by']})")
            return F.array_sort(F.array_union(F.coalesce("cited_by", none), F.coalesce(F.col("edges").cast(kind["cited_by"]), none)))
        if c == "tag":
            return F.coalesce(store["tag"], F.when(F.col("stored").isNull(), F.col("i.tag")))
        if c == "verified":
            return F.when(better & F.col("i").isNotNull(), F.col("i.verified")).otherwise(store["verified"])
        if c not in fields:
            return F.col(c)
        new = F.col(f"i.{c}").cast(kind[c])
        empty = F.coalesce(new.cast("string"), F.lit("")).isin("", "[]")
        return F.when(better & ~empty, new).otherwise(store[c])

    works = both.select(*[value(c).alias(c) for c in store.columns])
    settled = rows.join(store.select("work_id", F.col("tag").alias("to")), "work_id")
    rewrites = settled.filter("tag is not null and to is not null and tag <> to").groupBy("tag").agg(F.min("to").alias("to"))
    return works, rewrites


def most_cited(store: DataFrame) -> DataFrame:
    """(work_id, position): rank by citations, largest first and unknown last, ties by tag and id.

    Ranks are counted within the groups of equal counts and those are laid end to end, so no task
    sorts the whole store.
    """
    count = F.coalesce("citation_count", F.lit(-1))
    own = Window.partitionBy(count).orderBy("tag", "work_id")
    sized = store.groupBy(count.alias("count")).agg(F.count("*").alias("n"))
    above = sized.select("count", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    placed = store.select("work_id", count.alias("count"), F.row_number().over(own).alias("rn"))
    return placed.join(above, "count").select("work_id", (F.col("above") + F.col("rn")).alias("position"))
