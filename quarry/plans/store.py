"""Queries over works, records and bibliographies, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import address as A
from quarry.operators import audit, overlap, render, search, tables
from quarry.operators import works as W
from quarry.plans.reading import AUTHORS, B, P, SURNAME, citation, squeeze, title_words
from quarry.runtime import table

L = "long"


def _w(s, d):
    return tables.works(s, d)


def _p(s, d):
    return tables.papers(s, d)


def _r(s, d):
    return W.from_records(tables.records(s, d))


def _edges(s, d):
    return tables.citations(_w(s, d))


def citation_edges(s, d):
    return _edges(s, d)


def identity_keys(s, d):
    return W.keyed(_w(s, d), "work_id")


def priority_match(s, d):
    return W.priority_match(_r(s, d), "control_number", _w(s, d))


def unambiguous_places(s, d):
    rows = _w(s, d).filter("tag is not null").select(F.explode(F.slice(W.identity_keys(), 4, 1)).alias("identity"), "tag").filter("identity is not null")
    return W.unambiguous(rows, "identity", "tag")


def shared_identities(s, d):
    return W.shared_identities(_w(s, d)).select("identity", "count", F.array_join("tags", ",").alias("tags"))


def record_fields(s, d):
    return _r(s, d).select("control_number", "title", F.size(F.coalesce("authors", F.expr("array()"))).cast(L).alias("authors"), F.col("year").cast(L).alias("year"), "journal", "journal_key", "doi", "arxiv_id", F.col("citation_count").cast(L).alias("citation_count"))


def held_index(s, d):
    return W.held_index(_p(s, d))


def mark_held(s, d):
    return W.mark_held(_w(s, d), _p(s, d))


def record_status(s, d):
    return W.status(_w(s, d), _p(s, d), _r(s, d), "control_number")


def status_counts(s, d):
    return W.status(_w(s, d), _p(s, d), _r(s, d), "control_number").groupBy("status").agg(F.count("*").alias("records"))


def fill_empty(s, d):
    return W.fill(_w(s, d), _r(s, d), W.priority_match(_r(s, d), "control_number", _w(s, d)), overwrite=False)


def canonical_overwrite(s, d):
    return W.fill(_w(s, d), _r(s, d), W.priority_match(_r(s, d), "control_number", _w(s, d)), overwrite=True)


def _incoming(s, d):
    return _r(s, d).withColumnRenamed("control_number", "key").withColumn("verified", F.lit(True))


def upsert_actions(s, d):
    return W.upsert(_w(s, d), _incoming(s, d))


def base_tags(s, d):
    rows = _w(s, d).select("work_id", W.base_tag().alias("base"))
    return A.suffixes(rows, "base", [F.col("work_id")]).select("work_id", "base", "unique_name")


def lookup(s, d):
    return W.lookup(_w(s, d), [], "lattice").select("work_id", "tag", F.col("citation_count").cast(L).alias("citation_count"))


def most_cited(s, d):
    return W.most_cited(_w(s, d))


def citation_texts(s, d):
    return _w(s, d).select("work_id", T.citation_text("authors", "year").alias("citation"), T.display_authors("authors").alias("shown"))


def work_rows(s, d):
    return render.work_rows(_w(s, d))


def find_in_raw(s, d):
    rows = _w(s, d).filter("raw is not null")
    parts = T.journal_parts("journal")
    return rows.select("work_id", T.find_doi("raw").alias("doi"), T.find_year("raw").cast(L).alias("year"), parts["name"].alias("name"), parts["volume"].alias("volume"), parts["page"].alias("page"))


def normal_identifiers(s, d):
    return _w(s, d).select("work_id", T.normalize_doi("doi").alias("doi"), T.normalize_arxiv("arxiv_id").alias("arxiv_id"))


def kind_counts(s, d):
    """Review, article or unknown by document type, over the catalogue's records."""
    types = F.coalesce("document_type", F.expr("array()"))
    kind = F.when(F.array_contains(types, "review"), "review").when(F.size(types) > 0, "article").otherwise("unknown")
    return _r(s, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("records"), F.count_if(F.col("pages").between(1, 1000)).alias("with_pages"))


def enrich(s, d):
    """Works with the catalogue's count and pages by arXiv id; unmatched works stay."""
    found = _r(s, d).select(T.normalize_arxiv("arxiv_id").alias("a"), F.col("citation_count").alias("n"), "pages").filter("a <> ''").groupBy("a").agg(F.max("n").cast(L).alias("n"), F.max("pages").cast(L).alias("pages"))
    return _w(s, d).select("work_id", T.normalize_arxiv("arxiv_id").alias("a")).join(found, "a", "left").select("work_id", "n", "pages")


def record_references(s, d):
    """References of records: how many, how many without any handle, how many to known records."""
    r = tables.records(s, d).select("control_number", F.explode("metadata.references").alias("r"))
    to = F.regexp_extract(F.coalesce(F.col("r.record.`$ref`"), F.lit("")), "([0-9]+)$", 1).try_cast("long")
    r = r.select("control_number", to.alias("target"), (F.col("r.record").isNull() & (F.size(F.coalesce("r.reference.dois", F.expr("array()"))) == 0) & (F.coalesce("r.reference.arxiv_eprint", F.lit("")) == "")).alias("bare"))
    known = tables.records(s, d).select(F.col("control_number").alias("target"), F.lit(1).alias("k"))
    return r.join(known, "target", "left").groupBy("control_number").agg(F.count("*").alias("listed"), F.count_if("bare").alias("bare"), F.count("k").alias("known"))


def authors_agree(s, d):
    """Matched records and works, and whether a surname of one is within one of the other; no author agrees."""
    pairs = W.priority_match(_r(s, d), "control_number", _w(s, d)).join(_r(s, d).select("control_number", F.col("authors").alias("ra")), "control_number").join(_w(s, d).select("work_id", F.col("authors").alias("wa")), "work_id")
    names = lambda c: F.transform(F.filter(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.lower(T.surname(x)))
    a, b = names(F.col("ra")), names(F.col("wa"))
    agree = (F.size(a) == 0) | (F.size(b) == 0) | F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))
    return pairs.select("control_number", "work_id", agree.alias("agree"))


def title_hits(s, d):
    wanted = table(s, d, "bib_entries").select(F.col("entry_id").alias("key"), "title")
    return search.title_hits(wanted, _w(s, d)).select(F.col("key").alias("entry_id"), "work_id", "score")


def rank_resort(s, d):
    return search.resort(_w(s, d).select("work_id", F.col("citation_count").cast(L).alias("cited"), F.col("work_id").alias("rank")), "cited").select("work_id", "cited").limit(50)


def _candidates(s, d):
    return _edges(s, d).groupBy("slug").agg(F.count("*").alias("n")).filter("n >= 10").select("slug")


def overlap_scores(s, d):
    return overlap.scores(_edges(s, d), _candidates(s, d))


def overlap_closest(s, d):
    return overlap.closest(_edges(s, d), _candidates(s, d), 10)


def list_containment(s, d):
    return overlap.containment(_edges(s, d), _candidates(s, d))


def scope_split(s, d):
    """Papers with citations, in the collection or outside of it."""
    sizes, held = overlap.sizes(_edges(s, d)), _p(s, d).select("slug")
    inside = sizes.join(held, "slug", "left_semi").withColumn("inside", F.lit(True))
    return inside.unionByName(sizes.join(held, "slug", "left_anti").withColumn("inside", F.lit(False)))


def unresolved_citations(s, d):
    return audit.unresolved(tables.blocks(s, d), _w(s, d)).select("tag", "chapters", F.array_join("files", ",").alias("files"))


def stale_held(s, d):
    return audit.stale_held(_w(s, d), _p(s, d))


def cited_both_ways(s, d):
    return audit.cited_both_ways(tables.blocks(s, d), _w(s, d))


def marker_reasons(s, d):
    """Markers made of each document's slug and title, checked like a report's."""
    docs = table(s, d, "documents")
    text = F.concat(F.lit("See (lit:"), F.coalesce("slug", F.lit("nobody")), F.lit("/01_introduction#sec-introduction) and (lit:"), F.coalesce("slug", F.lit("nobody")), F.lit(") and (lit:ref/"), F.coalesce("slug", F.lit("none")), F.lit(")"))
    marked = audit.report_markers(docs.select(F.col("doc_id").alias("report"), text.alias("text")))
    rows = audit.check_markers(marked, tables.blocks(s, d), _p(s, d), _w(s, d))
    return rows.select("report", F.col("pos").cast(L).alias("pos"), "target", "reason")


QUERIES = {f.__name__: f for f in (citation_edges, identity_keys, priority_match, unambiguous_places, shared_identities, record_fields, held_index, mark_held, record_status, status_counts, fill_empty, canonical_overwrite, upsert_actions, base_tags, lookup, most_cited, citation_texts, work_rows, find_in_raw, normal_identifiers, kind_counts, enrich, record_references, authors_agree, title_hits, rank_resort, overlap_scores, overlap_closest, list_containment, scope_split, unresolved_citations, stale_held, cited_both_ways, marker_reasons)}

# --- SQL ---------------------------------------------------------------------------------------

DOI = r"regexp_replace(lower(trim(coalesce({0}, ''))), '^(https?://[^/]+/|doi: *)', '')"
ARXIV = r"regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '^(https?://[^/]+/abs/|arxiv: *)', ''), 'v[0-9]+$', '')"
IS_ARXIV = r"regexp_matches({0}, '^(arxiv:)?([0-9]{{4}}\.[0-9]{{4,5}}|[a-z-]+/[0-9]{{7}})(v[0-9]+)?$')"
NORM = r"trim(regexp_replace(lower(regexp_replace(coalesce({0}, ''), '\\[a-zA-Z]+', ' ', 'g')), '[^0-9a-zA-Z]+', ' ', 'g'))"


def keys(table_name: str, key: str, alias: str) -> str:
    """CTE with (key, identity, priority) of a table in the fields of a work."""
    doi, arxiv = DOI.format("doi"), ARXIV.format("arxiv_id")
    journal = "lower(regexp_replace(coalesce(journal_key, ''), '[^0-9a-zA-Z,]+', '', 'g'))"
    title = NORM.format("title")
    return f"""{alias} AS (SELECT * FROM (
 SELECT {key}, 'doi:' || {doi} AS identity, 0::BIGINT AS priority FROM {table_name} WHERE regexp_matches({doi}, '^10[.][0-9]+/.+')
 UNION ALL SELECT {key}, 'arxiv:' || {arxiv}, 1 FROM {table_name} WHERE {IS_ARXIV.format(arxiv)}
 UNION ALL SELECT {key}, 'inspire:' || inspire_id, 2 FROM {table_name} WHERE regexp_matches(coalesce(inspire_id, ''), '^[0-9]+$')
 UNION ALL SELECT {key}, 'journal:' || {journal}, 3 FROM {table_name} WHERE regexp_matches({journal}, '^[^,]+,[^,]+,[^,]+$')
 UNION ALL SELECT {key}, 'title:' || {title} || '|' || year::VARCHAR, 4 FROM {table_name} WHERE {title} <> '' AND year IS NOT NULL))"""


REC = """rr AS (SELECT metadata AS m FROM inspire_record WHERE metadata.control_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metadata.control_number ORDER BY fetched_at DESC) = 1),
 r0 AS (SELECT m, list_filter(m.publication_info, lambda p: coalesce(p.material, 'publication') <> 'erratum')[1] AS pub FROM rr),
 r AS (SELECT m.control_number AS control_number, m.titles[1].title AS title, list_transform(m.authors, lambda a: a.full_name) AS authors, pub.year AS year,
  concat_ws(' ', pub.journal_title, pub.journal_volume, '(' || pub.year::VARCHAR || ')', coalesce(pub.page_start, pub.artid)) AS journal,
  concat_ws(',', regexp_replace(lower(pub.journal_title), '[^0-9a-z]+', '', 'g'), pub.journal_volume, coalesce(pub.page_start, pub.artid)) AS journal_key,
  m.dois[1].value AS doi, m.arxiv_eprints[1].value AS arxiv_id, m.control_number::VARCHAR AS inspire_id, m.citation_count AS citation_count, m.document_type AS document_type, m.number_of_pages AS pages FROM r0)"""
MATCH = f"{keys('works', 'work_id', 'wk')}, ix AS (SELECT identity, min(work_id) AS work_id FROM wk GROUP BY identity)"
RMATCH = f"{REC}, {MATCH}, {keys('r', 'control_number', 'rk')}, mt AS (SELECT control_number, arg_min(work_id, (priority, work_id)) AS work_id, min(priority) AS priority FROM rk JOIN ix USING (identity) GROUP BY control_number)"
PDOI, PARX = DOI.format("doi"), ARXIV.format("arxiv_id")
HELD = f"{P}, hi AS (SELECT identity, max(slug) AS slug FROM (SELECT slug, 'doi:' || {PDOI} AS identity FROM p WHERE regexp_matches({PDOI}, '^10[.][0-9]+/.+') UNION ALL SELECT slug, 'arxiv:' || {PARX} FROM p WHERE {IS_ARXIV.format(PARX)}) GROUP BY identity)"
EDGES = "e AS (SELECT DISTINCT x.slug AS slug, work_id FROM (SELECT work_id, unnest(cited_by) AS x FROM works) WHERE coalesce(x.slug, '') <> '')"
OVERLAP = f"""{EDGES}, n AS (SELECT slug, count(*) AS works FROM e GROUP BY slug), cd AS (SELECT slug FROM n WHERE works >= 10),
 sh AS (SELECT a.slug AS candidate, b.slug AS slug, count(*) AS shared FROM e a JOIN e b ON a.work_id = b.work_id AND a.slug <> b.slug WHERE a.slug IN (SELECT slug FROM cd) GROUP BY ALL),
 sc AS (SELECT sh.*, x.works AS mine, y.works AS theirs, least(x.works, y.works) AS least, x.works + y.works - shared AS total FROM sh JOIN n x ON x.slug = candidate JOIN n y ON y.slug = sh.slug)"""
STATUS = f"{RMATCH}, {HELD}, st AS (SELECT r.control_number, CASE WHEN r.control_number IN (SELECT control_number FROM rk JOIN hi USING (identity) WHERE priority < 2) THEN 'held' WHEN r.control_number IN (SELECT control_number FROM mt) THEN 'cited' ELSE 'new' END AS status FROM r)"


def filled(first: str, second: str) -> str:
    text = lambda f: f"coalesce(nullif({first}.{f}, ''), nullif({second}.{f}, '')) AS {f}"
    return f"WITH {RMATCH}, ch AS (SELECT work_id, min(control_number) AS control_number FROM mt GROUP BY work_id) SELECT w.work_id, {text('title')}, coalesce({first}.year, {second}.year)::BIGINT AS year, {text('journal')}, {text('doi')}, ch.control_number IS NOT NULL AS matched FROM works w LEFT JOIN ch ON ch.work_id = w.work_id LEFT JOIN r s ON s.control_number = ch.control_number"


def kind(journal: str, types: str) -> str:
    """review, article or unknown by document types and venue."""
    venue = f"replace(replace(lower(coalesce({journal}, '')), ' ', ''), '.', '')"
    reviews = " OR ".join(f"starts_with({venue}, '{v.lower().replace(' ', '').replace('.', '')}')" for v in W.REVIEW_VENUES)
    types = f"list_filter(list_transform(coalesce({types}, []), lambda t: lower(trim(t))), lambda t: t <> '')"
    return f"CASE WHEN list_contains({types}, 'review') OR {reviews} THEN 'review' WHEN {venue} <> '' OR len({types}) > 0 THEN 'article' ELSE 'unknown' END"


def known(verified: str) -> str:
    return f"CASE WHEN {verified} THEN 10 ELSE 0 END + " + " + ".join(f"CASE WHEN coalesce({f}::VARCHAR, '') <> '' THEN 1 ELSE 0 END" for f in ("title", "year", "journal", "doi", "arxiv_id"))


SQL = {
    "citation_edges": f"WITH {EDGES} SELECT slug, work_id FROM e",
    "identity_keys": f"WITH {keys('works', 'work_id', 'wk')} SELECT * FROM wk",
    "priority_match": f"WITH {RMATCH} SELECT * FROM mt",
    "unambiguous_places": f"WITH {keys('works', 'tag', 'wk')} SELECT identity, min(tag) AS tag FROM wk WHERE priority = 3 AND tag IS NOT NULL GROUP BY identity HAVING count(DISTINCT tag) = 1",
    "shared_identities": f"WITH {keys('works', 'tag', 'wk')} SELECT identity, count(DISTINCT tag) AS count, array_to_string(list(DISTINCT tag ORDER BY tag)[1:5], ',') AS tags FROM wk WHERE priority < 4 AND tag IS NOT NULL GROUP BY identity HAVING count(DISTINCT tag) > 1",
    "record_fields": f"WITH {REC} SELECT control_number, title, coalesce(len(authors), 0)::BIGINT AS authors, year::BIGINT AS year, journal, journal_key, doi, arxiv_id, citation_count::BIGINT AS citation_count FROM r",
    "held_index": f"WITH {HELD} SELECT * FROM hi",
    "mark_held": f"WITH {HELD}, {keys('works', 'work_id', 'wk')}, hd AS (SELECT work_id, arg_min(slug, priority) AS held FROM wk JOIN hi USING (identity) WHERE priority < 2 GROUP BY work_id) SELECT w.work_id, held, held IS DISTINCT FROM nullif(held_as, '') AS changed FROM works w LEFT JOIN hd USING (work_id)",
    "record_status": f"WITH {STATUS} SELECT * FROM st",
    "status_counts": f"WITH {STATUS} SELECT status, count(*) AS records FROM st GROUP BY status",
    "fill_empty": filled("w", "s"),
    "canonical_overwrite": filled("s", "w"),
    "upsert_actions": f"WITH {RMATCH}, nw AS (SELECT control_number, arg_min(identity, priority) AS strongest FROM rk GROUP BY control_number), ld AS (SELECT strongest, min(control_number) AS leader FROM nw WHERE control_number NOT IN (SELECT control_number FROM mt) GROUP BY strongest), br AS (SELECT control_number, {known('true')} AS bring FROM r), hv AS (SELECT work_id, {known('coalesce(verified, false)')} AS have FROM works) SELECT br.control_number AS key, CASE WHEN mt.work_id IS NOT NULL THEN CASE WHEN bring > have THEN 'updated' ELSE 'unchanged' END WHEN leader IS NULL OR leader = br.control_number THEN 'added' ELSE 'repeated' END AS action FROM br LEFT JOIN mt USING (control_number) LEFT JOIN hv ON hv.work_id = mt.work_id LEFT JOIN nw USING (control_number) LEFT JOIN ld USING (strongest)",
    "lookup": "SELECT work_id, tag, citation_count::BIGINT AS citation_count FROM works WHERE contains(lower(concat_ws(' ', tag, title, array_to_string(coalesce(authors, []), ' '), journal)), 'lattice')",
    "most_cited": "SELECT work_id, row_number() OVER (ORDER BY coalesce(citation_count, -1) DESC, tag NULLS FIRST, work_id) AS position FROM works",
    "citation_texts": f"SELECT work_id, {citation()} AS citation, array_to_string(list_transform(({AUTHORS})[1:3], lambda x: {SURNAME}), ', ') || CASE WHEN len({AUTHORS}) > 3 THEN ' et al.' ELSE '' END AS shown FROM works",
    "find_in_raw": rf"""WITH x AS (SELECT work_id, raw, coalesce(journal, '') AS j, regexp_replace(raw, '10\.[0-9]{{4,9}}/[^ \t\r\n,;]+|[0-9]{{4}}\.[0-9]{{4,5}}', ' ', 'g') AS t FROM works WHERE raw IS NOT NULL)
 SELECT work_id, regexp_replace(regexp_extract(raw, '(10\.[0-9]{{4,9}}/[^ \t\r\n,;]+)', 1), '[.)]+$', '') AS doi,
 coalesce(regexp_extract_all(t, '\(((?:18|19|20)[0-9]{{2}})\)', 1)[-1], regexp_extract_all(t, '\b((?:18|19|20)[0-9]{{2}})\b', 1)[-1])::BIGINT AS year,
 coalesce(nullif(regexp_extract(j, '^(.*?) ?([0-9]+) \(([0-9]{{4}})\) ([0-9]+)', 1), ''), regexp_extract(j, '^(.*?) ?([0-9]+), ([0-9]+)', 1)) AS name,
 coalesce(nullif(regexp_extract(j, '^(.*?) ?([0-9]+) \(([0-9]{{4}})\) ([0-9]+)', 2), ''), regexp_extract(j, '^(.*?) ?([0-9]+), ([0-9]+)', 2)) AS volume,
 coalesce(nullif(regexp_extract(j, '^(.*?) ?([0-9]+) \(([0-9]{{4}})\) ([0-9]+)', 4), ''), regexp_extract(j, '^(.*?) ?([0-9]+), ([0-9]+)', 3)) AS page FROM x""",
    "normal_identifiers": f"SELECT work_id, {PDOI} AS doi, {PARX} AS arxiv_id FROM works",
    "kind_counts": f"WITH {REC} SELECT CASE WHEN list_contains(coalesce(document_type, []), 'review') THEN 'review' WHEN len(coalesce(document_type, [])) > 0 THEN 'article' ELSE 'unknown' END AS kind, count(*) AS records, count(*) FILTER (pages BETWEEN 1 AND 1000) AS with_pages FROM r GROUP BY kind",
    "enrich": f"WITH {REC}, f AS (SELECT {PARX} AS a, max(citation_count)::BIGINT AS n, max(pages)::BIGINT AS pages FROM r GROUP BY a HAVING a <> '') SELECT work_id, n, pages FROM works LEFT JOIN f ON f.a = {ARXIV.format('works.arxiv_id')}",
    "record_references": f"WITH {REC}, x AS (SELECT m.control_number AS control_number, unnest(m.\"references\") AS f FROM rr), y AS (SELECT control_number, TRY_CAST(regexp_extract(coalesce(f.record.\"$ref\", ''), '([0-9]+)$', 1) AS BIGINT) AS target, f.record IS NULL AND len(coalesce(f.reference.dois, [])) = 0 AND coalesce(f.reference.arxiv_eprint, '') = '' AS bare FROM x) SELECT y.control_number, count(*) AS listed, count(*) FILTER (bare) AS bare, count(r.control_number) AS known FROM y LEFT JOIN r ON r.control_number = y.target GROUP BY y.control_number",
    "authors_agree": f"WITH {RMATCH}, z AS (SELECT mt.control_number, mt.work_id, list_transform({AUTHORS.replace('authors', 'r.authors')}, lambda x: lower({SURNAME})) AS a, list_transform({AUTHORS.replace('authors', 'w.authors')}, lambda x: lower({SURNAME})) AS b FROM mt JOIN r USING (control_number) JOIN works w ON w.work_id = mt.work_id) SELECT control_number, work_id, len(a) = 0 OR len(b) = 0 OR len(list_filter(a, lambda s: len(list_filter(b, lambda t: contains(s, t) OR contains(t, s))) > 0)) > 0 AS agree FROM z",
    "rank_resort": "SELECT work_id, citation_count::BIGINT AS cited FROM works ORDER BY citation_count DESC NULLS LAST, work_id LIMIT 50",
    "overlap_scores": f"WITH {OVERLAP} SELECT *, CASE WHEN least < 10 THEN NULL WHEN shared * 100 >= 15 * least THEN 'high' WHEN shared * 100 < 5 * least THEN 'low' ELSE 'partial' END AS band FROM sc",
    "overlap_closest": f"WITH {OVERLAP}, o AS (SELECT candidate, slug, shared, (shared * 1000000 // least)::BIGINT AS overlap_ppm FROM sc) SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY overlap_ppm DESC, slug) AS place FROM o QUALIFY place <= 10",
    "list_containment": f"WITH {OVERLAP}, c AS (SELECT work_id, count(*) AS citers FROM e GROUP BY work_id) SELECT e.slug AS candidate, count(*) AS works, count(*) FILTER (citers > 1) AS known, (count(*) FILTER (citers > 1) * 1000000 // count(*))::BIGINT AS contained_ppm FROM e JOIN c USING (work_id) WHERE e.slug IN (SELECT slug FROM cd) GROUP BY e.slug",
    "scope_split": f"WITH {OVERLAP} SELECT slug, works, slug IN (SELECT slug FROM papers WHERE slug IS NOT NULL) AS inside FROM n",
    "unresolved_citations": rf"WITH {B}, c AS (SELECT DISTINCT slug || '/' || stem AS file, unnest(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '\[cite: *([^\]]*)\]', 1), lambda s: regexp_split_to_array(s, ' *, *')))) AS tag FROM b) SELECT tag, count(*) AS chapters, array_to_string(list(file ORDER BY file)[1:5], ',') AS files FROM c WHERE tag <> '' AND tag NOT IN (SELECT tag FROM works WHERE tag IS NOT NULL) GROUP BY tag",
    "stale_held": "SELECT work_id, held_as FROM works WHERE coalesce(held_as, '') <> '' AND held_as NOT IN (SELECT slug FROM papers WHERE slug IS NOT NULL)",
    "cited_both_ways": rf"WITH {B}, c AS (SELECT DISTINCT slug, tag FROM (SELECT slug, unnest(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '\[cite: *([^\]]*)\]', 1), lambda s: regexp_split_to_array(s, ' *, *')))) AS tag FROM b) WHERE tag <> ''), l AS (SELECT DISTINCT x.slug AS slug, tag FROM (SELECT tag, unnest(cited_by) AS x FROM works) WHERE coalesce(x.slug, '') <> '' AND tag IS NOT NULL AND x.slug IN (SELECT slug FROM b)) SELECT *, 'cited_not_listed' AS side FROM (SELECT * FROM c EXCEPT SELECT * FROM l) UNION ALL SELECT *, 'listed_not_cited' FROM (SELECT * FROM l EXCEPT SELECT * FROM c)",
    "marker_reasons": f"""WITH {B}, {P}, m AS (SELECT doc_id AS report, 0::BIGINT AS pos, coalesce(slug, 'nobody') || '/01_introduction#sec-introduction' AS target, CASE WHEN coalesce(slug, 'nobody') NOT IN (SELECT slug FROM p) THEN 'no such paper' WHEN slug NOT IN (SELECT slug FROM b WHERE stem = '01_introduction') THEN 'no such chapter' WHEN slug NOT IN (SELECT slug FROM b WHERE stem = '01_introduction' AND anchor = 'sec-introduction') THEN 'no such anchor' ELSE '' END AS reason FROM documents
 UNION ALL SELECT doc_id, 1, coalesce(slug, 'nobody'), CASE WHEN coalesce(slug, 'nobody') IN (SELECT slug FROM p) THEN '' ELSE 'no such paper' END FROM documents
 UNION ALL SELECT doc_id, 2, 'ref/' || coalesce(slug, 'none'), CASE WHEN coalesce(slug, 'none') IN (SELECT tag FROM works WHERE tag IS NOT NULL) THEN '' ELSE 'no such record' END FROM documents) SELECT * FROM m""",
}
_DASH = "coalesce(nullif(trim({0}), ''), '—')"
SQL["work_rows"] = "SELECT work_id, '| ' || concat_ws(' | ', " + _DASH.format("tag") + ", replace(" + squeeze(_DASH.format("title")) + ", '|', '\\|'), " + citation() + ", " + _DASH.format("journal") + ", coalesce(citation_count::VARCHAR, '—')) || ' |' AS row FROM works"
