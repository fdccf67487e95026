"""Queries of the upkeep of a collection, of its reports and of lookups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import bibliography, collection, render, report, search, tables
from quarry.operators import works as W
from quarry.plans import reading as R
from quarry.plans import store as S
from quarry.plans.reading import B, P, squeeze
from quarry.runtime import table

L = "long"


def _b(s, d):
    return tables.blocks(s, d)


def _p(s, d):
    return tables.papers(s, d)


def _w(s, d):
    return tables.works(s, d)


def _records(s, d):
    return W.from_records(tables.records(s, d))


def known_papers(s, d):
    return collection.known_papers(_p(s, d), tables.citations(_w(s, d)))


def warning_codes(s, d):
    return collection.warning_codes(_p(s, d)).groupBy("slug", "code").agg(F.count("*").alias("warnings"))


def ingest_report(s, d):
    return collection.ingest_report(_p(s, d), tables.citations(_w(s, d)))


def chapters_with_text(s, d):
    return collection.chapters_with_text(_b(s, d))


def collection_index(s, d):
    """The index of the papers that cite something, with every paper of the collection put into it."""
    cited = tables.citations(_w(s, d)).select("slug").distinct()
    first = table(s, d, "papers").filter("slug is not null").groupBy("slug").agg(F.min_by(F.struct("title", "authors", "submitted_year", "publication", "abstract"), F.struct(F.coalesce("ingested", F.lit("")), F.coalesce("parser", F.lit("")))).alias("r")).select("slug", "r.*")
    index = first.join(cited, "slug", "left_semi").select("slug", collection.index_row(F.lit("")).alias("row"), F.xxhash64("slug").alias("place"))
    return collection.upsert_index(index, _p(s, d)).select("slug", "row", "action")


def renamed_figures(s, d):
    figures = _b(s, d).filter("kind = 'figure'").select("slug", "stem", F.col("idx").cast(L).alias("idx"), "file")
    renames = figures.select("slug", F.col("file").alias("old"), F.regexp_replace("file", r"[.][a-z]+$", ".png").alias("new")).filter("old <> new").distinct()
    return collection.renamed_files(figures, renames)


def _rewrites(s, d):
    """Tags of works that share a DOI, and the first of them by letters."""
    doi = T.normalize_doi("doi")
    rows = _w(s, d).filter("coalesce(tag, '') <> ''").select("tag", doi.alias("doi")).filter(F.col("doi").rlike("^10[.][0-9]+/.+"))
    first = rows.groupBy("doi").agg(F.min("tag").alias("to"))
    return rows.join(first, "doi").filter("tag <> to").groupBy("tag").agg(F.min("to").alias("to"))


def tag_rewrites(s, d):
    return collection.tag_rewrites(_b(s, d), _rewrites(s, d))


def expanded_keys(s, d):
    """Texts with their citation keys made the tags that the store gives them."""
    keys = _w(s, d).filter("coalesce(tag, '') <> ''").select("tag", F.explode("cited_by").alias("e")).select(F.col("e.slug").alias("slug"), F.col("e.key").alias("key"), "tag").filter("coalesce(slug, '') <> '' and coalesce(key, '') <> ''").distinct()
    mapping = keys.groupBy("slug", "key").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    return collection.rewritten_citations(_b(s, d), mapping)


def placed_labels(s, d):
    return collection.placed_labels(_p(s, d), _b(s, d))


def record_owners(s, d):
    return collection.ownership(_records(s, d), "control_number", _p(s, d))


def held_citers(s, d):
    return collection.citers(_w(s, d)).groupBy("held").agg(F.count("*").alias("citers"), F.min("slug").alias("first"))


def _asked(s, d):
    row = _w(s, d).agg(F.min(F.nullif("tag", F.lit(""))).alias("tag"), F.max(F.nullif(T.normalize_doi("doi"), F.lit(""))).alias("doi"), F.max(F.nullif(T.normalize_arxiv("arxiv_id"), F.lit(""))).alias("arxiv")).first()
    slug = tables.citations(_w(s, d)).agg(F.min("slug")).first()[0]
    return {"tags": [row.tag or "", "no_such_tag"], "dois": ["doi: " + (row.doi or ""), "10.0/none"], "arxiv": [row.arxiv or "", "0000.00000"]}, slug or ""


def lookup_any(s, d):
    asked, slug = _asked(s, d)
    return W.lookup(_w(s, d), cited_by=[slug], **asked).select("work_id", "tag")


def lookup_missing(s, d):
    return W.missing(_w(s, d), **_asked(s, d)[0])


def cited_works(s, d):
    return W.cited_from_store(_w(s, d), _asked(s, d)[1])


def record_citers(s, d):
    return W.known_citers(_records(s, d), "control_number", _w(s, d))


def publication_keys(s, d):
    return W.publication_keys(tables.records(s, d))


def reference_cascade(s, d):
    parts = T.journal_parts("journal")
    name = F.regexp_replace(F.lower(parts["name"]), "[^0-9a-z]+", "")
    entries = table(s, d, "bib_entries").withColumns({"doi": F.lit(""), "arxiv_id": F.lit(""), "journal_key": F.concat_ws(",", name, parts["volume"], parts["page"])})
    return W.reference_cascade(entries, "entry_id", _w(s, d))


def merged_store(s, d):
    """The store after all catalogue records were folded in as cited by the catalogue."""
    incoming = _records(s, d).withColumnsRenamed({"control_number": "key"}).withColumns({"slug": F.lit("catalogue"), "citing_key": F.col("key").cast("string"), "tag": F.concat(F.lit("record_"), F.col("key").cast("string")), "verified": F.lit(True)})
    works, _ = W.merge_store(_w(s, d), incoming)
    return works.select("work_id", "tag", "title", F.col("year").cast(L).alias("year"), F.size("cited_by").cast(L).alias("citations"))


def assigned_tags(s, d):
    """Tags of the bibliography entries, known ones from the store."""
    entries = table(s, d, "bib_entries").withColumns({"doi": F.lit(""), "arxiv_id": F.lit(""), "inspire_id": F.lit(""), "journal_key": F.lit("")})
    return bibliography.assigned_tags(entries, "entry_id", _w(s, d))


def raw_bibliographies(s, d):
    """Records of the raw lines of bibliography entries, as items of one bibliography for each paper."""
    lines = table(s, d, "bib_entries").filter("coalesce(raw, '') <> ''").select("slug", F.struct("entry_id", F.concat(F.lit("\\bibitem{"), F.col("entry_id").cast("string"), F.lit("} "), "raw")).alias("r"))
    texts = lines.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["col2"]), "\n").alias("text"))
    return bibliography.parse_bibliographies(texts).select("slug", F.col("label").cast(L).alias("entry_id"), F.col("part").cast(L).alias("part"), F.col("year").cast(L).alias("year"), "journal_key", "doi", "arxiv_id")


def held_names(s, d):
    return report.held_names(_w(s, d), _p(s, d))


def _reports(s, d):
    """A report for each document: it cites the document's paper and the first work, by tag, that the paper cites, and lists the paper.

    The tables hold no reports, so their text is put together here; names and targets are those of the data.
    """
    docs = table(s, d, "documents").select(F.col("doc_id").alias("report"), F.coalesce("slug", F.lit("nobody")).alias("slug"))
    tags = tables.citations(_w(s, d)).join(_w(s, d).select("work_id", "tag"), "work_id").groupBy("slug").agg(F.min("tag").alias("tag"))
    rows = docs.join(tags, "slug", "left").withColumn("tag", F.coalesce("tag", F.lit("none")))
    text = F.concat(F.lit("See (lit:"), "slug", F.lit("/01_introduction#sec-introduction) and (lit:ref/"), "tag", F.lit(").\n## References\n- (lit:"), "slug", F.lit(")\n- (lit:ref/no_such_tag) ⚠\n"))
    return rows.select("report", text.alias("text"))


def report_rendered(s, d):
    return report.rendered(_reports(s, d), _b(s, d), _p(s, d), _w(s, d))


def report_audit(s, d):
    return report.audited(_reports(s, d), _b(s, d), _p(s, d), _w(s, d))


def work_kinds(s, d):
    rows = _records(s, d).select("control_number", W.work_kind(F.col("journal"), F.col("document_type")).alias("kind"))
    return rows


def kind_filter(s, d):
    """How many records a filter for reviews keeps and drops, and why."""
    kinds = work_kinds(s, d)
    return kinds.agg(F.count_if(F.col("kind") == "review").alias("kept"), F.count_if(F.col("kind") == "article").alias("dropped_not_review"), F.count_if(F.col("kind") == "unknown").alias("dropped_unknown"))


def raw_identifiers(s, d):
    return _w(s, d).filter("raw is not null").select("work_id", T.find_arxiv("raw").alias("arxiv"), T.volume_page("journal_key").alias("volume_page"))


def abstract_cuts(s, d):
    first = F.get(F.filter(F.transform("metadata.abstracts", lambda a: T.collapse(a["value"])), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    return tables.records(s, d).select("control_number", F.coalesce(T.truncate(first, 400), F.lit("")).alias("abstract"))


def linked_texts(s, d):
    return render.linked(_b(s, d), _w(s, d), _p(s, d))


def flavored_chapters(s, d):
    return render.flavored_chapters(_b(s, d), "vscode").select("slug", "stem", F.length("markdown").cast(L).alias("letters"))


def paper_identity(s, d):
    return render.identity_rows(_p(s, d))


def work_pages(s, d):
    return render.work_pages(_w(s, d))


def query_ladder(s, d):
    """Documents by the first rung of a ladder of queries that finds them: all terms, the topic as a title's phrase, any term."""
    return search.ladder(table(s, d, "documents").select(F.col("doc_id").alias("key"), "title", F.concat_ws(" ", "title", "text").alias("words")), R.TOPIC).withColumnRenamed("key", "doc_id")


def named_paper(s, d):
    return search.named_paper(_w(s, d), "lattice calculation of the form factor", "Nemonarsen, D.", 2001)


def candidate_works(s, d):
    """Reference lists of records: works of the store they name by DOI or arXiv id, entries listed and entries without a handle."""
    refs = tables.records(s, d).select("control_number", F.posexplode("metadata.references").alias("at", "r")).select("control_number", "at", F.get("r.reference.dois", F.lit(0)).alias("doi"), F.col("r.reference.arxiv_eprint").alias("arxiv_id"))
    doi, arxiv = T.normalize_doi("doi"), T.normalize_arxiv("arxiv_id")
    keys = F.array_compact(F.array(F.when(doi.rlike("^10[.][0-9]+/.+"), F.concat(F.lit("doi:"), doi)), F.when(T.looks_like_arxiv(arxiv), F.concat(F.lit("arxiv:"), arxiv))))
    rows = refs.select("control_number", "at", keys.alias("keys"))
    index = W.keyed(_w(s, d), "work_id").filter("priority < 2").groupBy("identity").agg(F.min("work_id").alias("work_id"))
    found = rows.select("control_number", F.explode("keys").alias("identity")).join(index, "identity").groupBy("control_number").agg(F.count_distinct("work_id").alias("works"))
    counted = rows.groupBy("control_number").agg(F.count("*").alias("listed"), F.count_if(F.size("keys") == 0).alias("unidentified"))
    return counted.join(found, "control_number", "left").fillna(0, ["works"])


QUERIES = {f.__name__: f for f in (known_papers, warning_codes, ingest_report, chapters_with_text, collection_index, renamed_figures, tag_rewrites, expanded_keys, placed_labels, record_owners, held_citers, lookup_any, lookup_missing, cited_works, record_citers, publication_keys, reference_cascade, merged_store, assigned_tags, raw_bibliographies, held_names, report_rendered, report_audit, work_kinds, kind_filter, raw_identifiers, abstract_cuts, linked_texts, flavored_chapters, paper_identity, work_pages, query_ladder, named_paper, candidate_works)}

# --- SQL ---------------------------------------------------------------------------------------

SHOWN = "coalesce(CASE WHEN kind = 'paragraph' THEN text WHEN kind = 'heading' THEN concat_ws(' ', CASE WHEN coalesce(number, '') <> '' THEN number END, title) WHEN kind = 'math' THEN tex WHEN kind = 'code' THEN text WHEN kind = 'table' THEN concat_ws(chr(10), caption, tex) WHEN kind = 'figure' THEN caption END, '')"
NAMES = f"list_filter(list_transform(coalesce(authors, []), lambda x: {squeeze('x')}), lambda x: coalesce(x, '') <> '')"


def names(n: int) -> str:
    return f"(array_to_string(({NAMES})[1:{n}], ', ') || CASE WHEN len({NAMES}) > {n} THEN ' et al.' ELSE '' END)"


def dash(x: str) -> str:
    return f"coalesce(nullif({x}, ''), '—')"


def cell(x: str) -> str:
    return f"replace({squeeze(x)}, '|', '\\|')"


def index_row(description: str) -> str:
    return f"""'| ' || concat_ws(' | ', '[' || {cell("coalesce(nullif(title, ''), slug)")} || '](' || slug || '/INDEX.md)', {dash(cell(names(1)))}, {dash('submitted_year::VARCHAR')}, {dash(cell("coalesce(publication.journal, '')"))}, {dash(cell(description))}) || ' |'"""


FIRST = R.sentences(squeeze("coalesce(abstract, '')")) + "[1]"
FIRST = f"coalesce(CASE WHEN length({FIRST}) > 160 THEN rtrim(substring({FIRST}, 1, 159)) || '…' ELSE {FIRST} END, '')"
WARN = "CASE " + " ".join(f"WHEN contains(lower(w), '{said.lower()}') THEN '{code}'" for said, code in collection.WARNINGS) + " ELSE 'OTHER' END"
MARKS = r"regexp_extract_all(coalesce(text, ''), '\[cite: *([^\]]*)\]', 1)"
BETWEEN = r"regexp_split_to_array(coalesce(text, ''), '\[cite: *[^\]]*\]')"
KEYS_OF = f"list_filter(list_transform(string_split(x, ','), lambda k: {squeeze('k')}), lambda k: k <> '')"


def rewritten(mapping: str, key: str) -> str:
    """Texts rewritten by a one-row table mp (m MAP of key to the list of tags)."""
    inner = f"array_to_string(flatten(list_transform({KEYS_OF}, lambda k: coalesce(m[{key}], [k]))), ', ')"
    marker = f"CASE WHEN len({KEYS_OF}) > 0 THEN '[cite: ' || {inner} || ']' ELSE '[cite: ' || x || ']' END"
    return f"""WITH {B}, {mapping}, z AS (SELECT slug, stem, idx, coalesce(text, '') AS said, {BETWEEN} AS t, list_transform({MARKS}, lambda x: {marker}) AS r FROM b, mp WHERE len({MARKS}) > 0),
 y AS (SELECT slug, stem, idx::BIGINT AS idx, said, array_to_string(list_transform(range(1, len(t) + 1), lambda i: t[i] || coalesce(r[i], '')), '') AS rewritten FROM z) SELECT slug, stem, idx, rewritten FROM y WHERE rewritten <> said"""


WDOI, WARX = S.DOI.format("doi"), S.ARXIV.format("arxiv_id")
ASKED = f"""q AS (SELECT min(nullif(tag, '')) AS tag, max(nullif({WDOI}, '')) AS doi, max(nullif({WARX}, '')) AS arx FROM works), fs AS (SELECT min(slug) AS slug FROM e)"""
JP = "nullif(regexp_extract(j, '^(.*?) ?([0-9]+) \\(([0-9]{{4}})\\) ([0-9]+)', {0}), '')"
JQ = "regexp_extract(j, '^(.*?) ?([0-9]+), ([0-9]+)', {0})"
PLACE = "lower(regexp_replace(coalesce(journal_key, ''), '[^0-9a-zA-Z,]+', '', 'g'))"


def handles(source: str, key: str, alias: str) -> str:
    title = S.NORM.format("title")
    return f"""{alias} AS (SELECT {key}, 0 AS rank, 'doi' AS match, {WDOI} AS handle FROM {source} WHERE regexp_matches({WDOI}, '^10[.][0-9]+/.+')
 UNION ALL SELECT {key}, 1, 'arxiv', {WARX} FROM {source} WHERE {S.IS_ARXIV.format(WARX)}
 UNION ALL SELECT {key}, 2, 'journal', {PLACE} FROM {source} WHERE regexp_matches({PLACE}, '^[^,]+,[^,]+,[^,]+$')
 UNION ALL SELECT {key}, 3, 'volume_page', regexp_extract({PLACE}, '([^,]+,[^,]+)$', 1) FROM {source} WHERE regexp_matches({PLACE}, '^[^,]+,[^,]+,[^,]+$')
 UNION ALL SELECT {key}, 4, 'title', {title} FROM {source} WHERE {title} <> '')"""


HELD_NAMES = f"""{S.HELD}, {S.keys('works', 'work_id', 'wk')}, bk AS (SELECT work_id, arg_min(slug, priority) AS by_key FROM wk JOIN hi USING (identity) WHERE priority < 2 GROUP BY work_id),
 hn AS (SELECT w.tag, min(coalesce(nullif(w.held_as, ''), by_key, p.slug)) AS slug FROM works w LEFT JOIN bk ON bk.work_id = w.work_id LEFT JOIN p ON p.slug = w.tag WHERE coalesce(w.tag, '') <> '' GROUP BY w.tag HAVING min(coalesce(nullif(w.held_as, ''), by_key, p.slug)) IS NOT NULL)"""
REPORTS = f"""{B}, {HELD_NAMES}, {S.EDGES}, pt AS (SELECT e.slug, min(w.tag) AS tag FROM e JOIN works w ON w.work_id = e.work_id GROUP BY e.slug), dr AS (SELECT doc_id AS report, coalesce(d.slug, 'nobody') AS slug, coalesce(pt.tag, 'none') AS tag FROM documents d LEFT JOIN pt ON pt.slug = coalesce(d.slug, 'nobody')),
 tg AS (SELECT tag, bool_or(coalesce(verified, false)) AS sure FROM works WHERE coalesce(tag, '') <> '' GROUP BY tag), hp AS (SELECT slug FROM p), hc AS (SELECT DISTINCT slug FROM b WHERE stem = '01_introduction'), ha AS (SELECT DISTINCT slug FROM b WHERE stem = '01_introduction' AND anchor = 'sec-introduction'),
 k AS (SELECT dr.*, dr.slug IN (SELECT slug FROM hp) AS hp, dr.slug IN (SELECT slug FROM hc) AS hc, dr.slug IN (SELECT slug FROM ha) AS ha, dr.tag IN (SELECT tag FROM works WHERE tag IS NOT NULL) AS ht, tg.sure, tg.tag IS NOT NULL AS named,
  coalesce('slug:' || hn.slug, 'tag:' || dr.tag) AS work FROM dr LEFT JOIN tg ON tg.tag = dr.tag LEFT JOIN hn ON hn.tag = dr.tag)"""
INNER = r"regexp_extract(x, '^\[(?:cite|ref): *([^\]]*)\]$', 1)"
TAGS = f"list_filter(list_transform(string_split({INNER}, ','), lambda k: {squeeze('k')}), lambda k: k <> '')"
LABEL = f"lm[{squeeze(INNER)}]"
LINK = f"""CASE WHEN starts_with(x, '[cite:') THEN CASE WHEN len({TAGS}) > 0 AND len(list_filter({TAGS}, lambda k: cm[k] IS NULL)) = 0 THEN '(' || array_to_string(list_transform({TAGS}, lambda k: '[' || cm[k] || '](../../references/' || k || '.md)'), '; ') || ')' ELSE x END
 WHEN lm IS NULL OR {LABEL} IS NULL THEN x ELSE '[' || coalesce({LABEL}.number, '') || '](' || CASE WHEN coalesce({LABEL}.file, '') = stem THEN '' ELSE coalesce({LABEL}.file, '') || '.md' END || CASE WHEN coalesce({LABEL}.anchor, '') <> '' THEN '#' || {LABEL}.anchor ELSE '' END || ')' END"""
CITED_NAMES = f"cn AS (SELECT map_from_entries(list((tag, name))) AS cm FROM (SELECT tag, min({R.citation()}) AS name FROM works WHERE coalesce(tag, '') <> '' GROUP BY tag))"
NAMED = r"regexp_split_to_array(x, ' *, *')"

SQL = {
    "linked_texts": rf"""WITH {B}, {P}, {CITED_NAMES}, lb AS (SELECT slug, labels AS lm FROM p), z AS (SELECT b.slug, stem, idx, cm, lm, regexp_split_to_array(coalesce(text, ''), '\[(?:cite|ref): *[^\]]*\]') AS t, regexp_extract_all(coalesce(text, ''), '(\[(?:cite|ref): *[^\]]*\])', 1) AS ms FROM b CROSS JOIN cn LEFT JOIN lb ON lb.slug = b.slug),
 y AS (SELECT *, list_transform(ms, lambda x: {LINK}) AS r FROM z WHERE len(ms) > 0) SELECT slug, stem, idx::BIGINT AS idx, array_to_string(list_transform(range(1, len(t) + 1), lambda i: t[i] || coalesce(r[i], '')), '') AS linked FROM y""",
    "substitute_citations": rf"""WITH {B}, {CITED_NAMES}, z AS (SELECT slug, stem, idx, cm, regexp_split_to_array(coalesce(text, ''), '\[cite: *[^\]]*\]') AS t, {MARKS} AS ms FROM b, cn WHERE len({MARKS}) > 0),
 y AS (SELECT *, list_transform(ms, lambda x: CASE WHEN len(list_filter({NAMED}, lambda k: cm[k] IS NULL)) = 0 THEN '(' || array_to_string(list_transform({NAMED}, lambda k: cm[k]), '; ') || ')' ELSE '[cite: ' || x || ']' END) AS r FROM z)
 SELECT slug, stem, idx::BIGINT AS idx, array_to_string(list_transform(range(1, len(t) + 1), lambda i: t[i] || coalesce(r[i], '')), '') AS rendered FROM y""",
    "known_papers": f"WITH {S.EDGES}, {P} SELECT slug, slug IN (SELECT slug FROM p) AS held FROM (SELECT slug FROM e UNION SELECT slug FROM p WHERE slug <> '')",
    "warning_codes": f"WITH {P}, u AS (SELECT slug, unnest(warnings) AS w FROM p) SELECT slug, {WARN} AS code, count(*) AS warnings FROM u WHERE NOT contains(lower(w), 'placeholder residue') GROUP BY ALL",
    "ingest_report": f"WITH {S.EDGES}, {P}, n AS (SELECT slug, count(*) AS n FROM e GROUP BY slug) SELECT p.slug, coalesce(len(chapters), 0)::BIGINT AS chapters, coalesce(len(figures), 0)::BIGINT AS figures, coalesce(len(list_filter(figures, lambda f: coalesce(f.file, '') = '')), 0)::BIGINT AS figures_without_file, coalesce(len(authors), 0)::BIGINT AS authors, coalesce(len(warnings), 0)::BIGINT AS warnings, coalesce(len(unresolved_refs), 0)::BIGINT AS unresolved_refs, coalesce(n.n, 0) AS \"references\" FROM p LEFT JOIN n ON n.slug = p.slug",
    "chapters_with_text": f"WITH {B} SELECT slug, stem, coalesce(bool_or(kind <> 'heading' AND trim({SHOWN}) <> ''), false) AS has_text FROM b GROUP BY slug, stem",
    "collection_index": f"""WITH {S.EDGES}, {P}, f AS (SELECT * FROM papers WHERE slug IN (SELECT slug FROM e) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY coalesce(ingested, ''), coalesce(parser, '')) = 1),
 ix AS (SELECT slug, {index_row("''")} AS row FROM f), nw AS (SELECT slug, {index_row(FIRST)} AS new, {dash(cell("coalesce(publication.journal, '')"))} AS journal FROM p),
 j AS (SELECT slug, row, new, journal FROM ix FULL JOIN nw USING (slug)), g AS (SELECT *, regexp_extract(row, '^(.*) \\| ((?:[^|]|\\\\\\|)*) \\| ((?:[^|]|\\\\\\|)*) \\|$', 1) AS head, regexp_extract(row, '^(.*) \\| ((?:[^|]|\\\\\\|)*) \\| ((?:[^|]|\\\\\\|)*) \\|$', 3) AS tail FROM j),
 k AS (SELECT slug, row AS before, new, CASE WHEN row IS NULL THEN new WHEN new IS NULL THEN row ELSE head || ' | ' || journal || ' | ' || tail || ' |' END AS row FROM g) SELECT slug, row, CASE WHEN before IS NULL THEN 'added' WHEN new IS NULL THEN 'kept' WHEN row = before THEN 'present' ELSE 'journal' END AS action FROM k""",
    "renamed_figures": f"WITH {B} SELECT slug, stem, idx::BIGINT AS idx, regexp_replace(file, '[.][a-z]+$', '.png') AS file FROM b WHERE kind = 'figure'",
    "tag_rewrites": rewritten(f"dd AS (SELECT tag, {WDOI} AS doi FROM works WHERE coalesce(tag, '') <> '' AND regexp_matches({WDOI}, '^10[.][0-9]+/.+')), rw AS (SELECT tag, min(t) AS t FROM (SELECT dd.tag, (SELECT min(x.tag) FROM dd x WHERE x.doi = dd.doi) AS t FROM dd) WHERE tag <> t GROUP BY tag), mp AS (SELECT coalesce(map_from_entries(list((tag, [t]))), MAP {{}}) AS m FROM rw)", "k"),
    "expanded_keys": rewritten("kt AS (SELECT c.slug AS slug, c.key AS key, list(DISTINCT tag ORDER BY tag) AS tags FROM (SELECT tag, unnest(cited_by) AS c FROM works WHERE coalesce(tag, '') <> '') WHERE coalesce(c.slug, '') <> '' AND coalesce(c.key, '') <> '' GROUP BY ALL), mp AS (SELECT map_from_entries(list((slug || chr(1) || key, tags))) AS m FROM kt)", "slug || chr(1) || k"),
    "placed_labels": f"WITH {B}, {P}, l AS (SELECT slug, e.key AS label, e.value AS v FROM (SELECT slug, unnest(map_entries(labels)) AS e FROM p)), a AS (SELECT slug, anchor, min(stem) AS stem FROM b WHERE coalesce(anchor, '') <> '' GROUP BY slug, anchor), t AS (SELECT slug, c.title AS title, arg_min(c.stem, ord) AS stem FROM (SELECT slug, unnest(chapters) AS c, generate_subscripts(chapters, 1) AS ord FROM p) GROUP BY slug, c.title) SELECT l.slug, label, coalesce(a.stem, t.stem, '') AS stem FROM l LEFT JOIN a ON a.slug = l.slug AND a.anchor = l.v.anchor LEFT JOIN t ON t.slug = l.slug AND t.title = l.v.chapter",
    "record_owners": f"WITH {S.REC}, {S.HELD}, {S.keys('r', 'control_number', 'rk')}, c AS (SELECT control_number, slug, string_split(identity, ':')[1] AS \"by\" FROM rk JOIN hi USING (identity) WHERE priority < 2) SELECT control_number, slug, \"by\" FROM c QUALIFY row_number() OVER (PARTITION BY control_number ORDER BY CASE WHEN \"by\" = 'arxiv' THEN 0 ELSE 1 END, slug) = 1",
    "held_citers": "WITH c AS (SELECT DISTINCT held_as AS held, x.slug AS slug FROM (SELECT held_as, unnest(cited_by) AS x FROM works WHERE coalesce(held_as, '') <> '')) SELECT held, count(*) AS citers, min(slug) AS first FROM c WHERE coalesce(slug, '') <> '' AND slug <> held GROUP BY held",
    "lookup_any": f"WITH {S.EDGES}, {ASKED} SELECT DISTINCT w.work_id, w.tag FROM works w, q, fs WHERE w.tag = q.tag OR {S.DOI.format('w.doi')} = q.doi OR {S.ARXIV.format('w.arxiv_id')} = q.arx OR EXISTS (SELECT 1 FROM e WHERE e.work_id = w.work_id AND e.slug = fs.slug)",
    "lookup_missing": "SELECT * FROM (VALUES ('tag', 'no_such_tag'), ('doi', '10.0/none'), ('arxiv', '0000.00000')) AS t(kind, asked)",
    "cited_works": f"WITH {S.EDGES}, {ASKED} SELECT work_id, tag, citation_count::BIGINT AS cited FROM works WHERE work_id IN (SELECT work_id FROM e, fs WHERE e.slug = fs.slug) ORDER BY citation_count DESC NULLS LAST, tag NULLS FIRST, work_id LIMIT 40",
    "record_citers": f"WITH {S.RMATCH}, {S.EDGES} SELECT control_number, count(DISTINCT slug) AS citers, array_to_string(list(DISTINCT slug ORDER BY slug)[1:5], ',') AS first FROM mt JOIN e USING (work_id) GROUP BY control_number",
    "publication_keys": f"WITH {S.REC}, x AS (SELECT m.control_number AS control_number, unnest(m.publication_info) AS p FROM rr) SELECT DISTINCT control_number, concat_ws(',', regexp_replace(lower(p.journal_title), '[^0-9a-z]+', '', 'g'), p.journal_volume, coalesce(nullif(p.page_start, ''), p.artid)) AS key FROM x WHERE coalesce(p.journal_title, '') <> '' AND coalesce(p.journal_volume, '') <> '' AND coalesce(nullif(p.page_start, ''), p.artid, '') <> ''",
    "reference_cascade": f"""WITH jj AS (SELECT entry_id, title, coalesce(journal, '') AS j FROM bib_entries), en AS (SELECT entry_id, title, '' AS doi, '' AS arxiv_id, concat_ws(',', regexp_replace(lower(coalesce({JP.format(1)}, {JQ.format(1)})), '[^0-9a-z]+', '', 'g'), coalesce({JP.format(2)}, {JQ.format(2)}), coalesce({JP.format(4)}, {JQ.format(3)})) AS journal_key FROM jj),
 {handles('en', 'entry_id', 'eh')}, {handles('works', 'work_id', 'wh')}, ix AS (SELECT rank, handle, min(work_id) AS work_id FROM wh GROUP BY rank, handle HAVING rank <> 3 OR min(work_id) = max(work_id))
 SELECT entry_id, arg_min(work_id, (eh.rank, work_id)) AS work_id, arg_min(match, eh.rank) AS match FROM eh JOIN ix ON ix.rank = eh.rank AND ix.handle = eh.handle GROUP BY entry_id""",
    "held_names": f"WITH {HELD_NAMES} SELECT tag, slug FROM hn",
    "report_rendered": f"""WITH {REPORTS} SELECT report, 'See (' || CASE WHEN ha THEN '../' || slug || '/chapters/01_introduction.md#sec-introduction' ELSE 'lit:' || slug || '/01_introduction#sec-introduction' END || ') and (' || CASE WHEN ht THEN '../references/' || tag || '.md' ELSE 'lit:ref/' || tag END || ').' || chr(10) || '## References' || chr(10) || '- (' || CASE WHEN hp THEN '../' || slug || '/INDEX.md' ELSE 'lit:' || slug END || ')' || chr(10) || '- (lit:ref/no_such_tag) ⚠' || chr(10) AS rendered,
 (CASE WHEN ha THEN 0 ELSE 1 END + CASE WHEN ht THEN 0 ELSE 1 END + CASE WHEN hp THEN 0 ELSE 1 END + 1)::BIGINT AS unresolved FROM k""",
    "report_audit": f"""WITH {REPORTS}, kn AS (SELECT 'slug:' || slug AS work FROM p UNION SELECT 'tag:' || tag FROM tg),
 m AS (SELECT report, 'slug:' || slug AS work, 1 AS c, 0 AS l FROM k UNION ALL SELECT report, work, 1, 0 FROM k WHERE tag <> '' UNION ALL SELECT report, 'slug:' || slug, 0, 1 FROM k UNION ALL SELECT report, 'tag:no_such_tag', 0, 1 FROM k),
 s AS (SELECT report, work, max(c) AS c, max(l) AS l FROM m GROUP BY ALL), n AS (SELECT report, sum(c)::BIGINT AS citations, count(*) FILTER (work NOT IN (SELECT work FROM kn)) AS absent, count(*) FILTER (l = 0) AS cited_not_listed, count(*) FILTER (c = 0) AS listed_not_cited FROM s GROUP BY report),
 r AS (SELECT k.report, citations, absent, (CASE WHEN ha THEN 0 ELSE 1 END + CASE WHEN ht THEN 0 ELSE 1 END + CASE WHEN hp THEN 0 ELSE 1 END + 1)::BIGINT AS broken, 0::BIGINT AS cite_markers, cited_not_listed, listed_not_cited, (CASE WHEN named AND NOT sure THEN 1 ELSE 0 END)::BIGINT AS unflagged FROM k JOIN n ON n.report = k.report)
 SELECT *, absent + broken + cite_markers + cited_not_listed + listed_not_cited + unflagged = 0 AS ok FROM r""",
    "work_kinds": f"WITH {S.REC} SELECT control_number, {S.kind('journal', 'document_type')} AS kind FROM r",
    "kind_filter": f"WITH {S.REC}, k AS (SELECT {S.kind('journal', 'document_type')} AS kind FROM r) SELECT count(*) FILTER (kind = 'review') AS kept, count(*) FILTER (kind = 'article') AS dropped_not_review, count(*) FILTER (kind = 'unknown') AS dropped_unknown FROM k",
    "raw_identifiers": r"""WITH x AS (SELECT work_id, lower(raw) AS r, journal_key AS j FROM works WHERE raw IS NOT NULL) SELECT work_id, coalesce(nullif(regexp_extract(r, 'arxiv[: ]\s*([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7})', 1), ''), regexp_extract(r, '(?:^|[^0-9a-z./])((?:astro-ph|cond-mat|gr-qc|hep-(?:ex|lat|ph|th)|math-ph|nucl-(?:ex|th)|physics|quant-ph)/[0-9]{7})', 1)) AS arxiv,
 CASE WHEN contains(j, ',') THEN array_to_string(string_split(j, ',')[-2:], ',') END AS volume_page FROM x""",
    "abstract_cuts": f"WITH {S.REC}, a AS (SELECT m.control_number AS control_number, list_filter(list_transform(m.abstracts, lambda x: {squeeze('x.value')}), lambda x: coalesce(x, '') <> '')[1] AS a FROM rr) SELECT control_number, coalesce(CASE WHEN length(a) > 400 THEN rtrim(substring(a, 1, 399)) || '…' ELSE a END, '') AS abstract FROM a",
    "paper_identity": f"""WITH {P}, v AS (SELECT slug, ['Authors', 'Submitted', 'arXiv', 'Journal', 'Published', 'DOI', 'Ingested'] AS n, [{names(3)}, submitted_year::VARCHAR, arxiv_id, publication.journal, publication.published_year::VARCHAR, coalesce(nullif(publication.doi, ''), doi), ingested] AS x FROM p)
 SELECT slug, (i - 1)::BIGINT AS at, n[i] AS name, {cell("coalesce(nullif(trim(x[i]), ''), '—')")} AS value FROM (SELECT *, unnest(range(1, 8)) AS i FROM v)""",
    "work_pages": f"""WITH c AS (SELECT work_id, string_agg(DISTINCT x.slug, ', ' ORDER BY x.slug) AS citing FROM (SELECT work_id, unnest(cited_by) AS x FROM works) WHERE coalesce(x.slug, '') <> '' GROUP BY work_id)
 SELECT w.work_id, concat_ws(chr(10), '# ' || coalesce(nullif({squeeze('title')}, ''), nullif(tag, ''), '—'), {R.citation()}, CASE WHEN coalesce(journal, '') <> '' THEN 'Journal: ' || journal END, CASE WHEN coalesce(doi, '') <> '' THEN 'DOI: ' || doi END, CASE WHEN coalesce(arxiv_id, '') <> '' THEN 'arXiv: ' || arxiv_id END, 'Citations: ' || citation_count::VARCHAR, CASE WHEN coalesce(held_as, '') <> '' THEN 'Held as: ' || held_as END, 'Cited by: ' || citing) AS page FROM works w LEFT JOIN c USING (work_id)""",
    "query_ladder": f"""WITH d AS (SELECT doc_id, {R.title_words("concat_ws(' ', title, text)")} AS ws, {S.NORM.format('title')} AS t FROM documents), h AS (SELECT doc_id, t, len(list_filter({R.literal_list(R.TERMS)}, lambda k: list_contains(ws, k))) AS n FROM d)
 SELECT doc_id, CASE WHEN n = {len(R.TERMS)} THEN 'strict' WHEN contains(t, '{' '.join(R.TOPIC.split()[:6])}') THEN 'phrase' ELSE 'broad' END AS rung FROM h WHERE n > 0 OR contains(t, '{' '.join(R.TOPIC.split()[:6])}')""",
    "candidate_works": f"""WITH {S.REC}, {S.keys('works', 'work_id', 'wk')}, x AS (SELECT m.control_number AS control_number, unnest(m."references").reference AS f FROM rr), y AS (SELECT control_number, f.dois[1] AS doi, f.arxiv_eprint AS arxiv_id FROM x),
 z AS (SELECT control_number, list_filter([CASE WHEN regexp_matches({WDOI}, '^10[.][0-9]+/.+') THEN 'doi:' || {WDOI} END, CASE WHEN {S.IS_ARXIV.format(WARX)} THEN 'arxiv:' || {WARX} END], lambda k: k IS NOT NULL) AS ks FROM y),
 ix AS (SELECT identity, min(work_id) AS work_id FROM wk WHERE priority < 2 GROUP BY identity), f AS (SELECT control_number, count(DISTINCT work_id) AS works FROM (SELECT control_number, unnest(ks) AS identity FROM z) JOIN ix USING (identity) GROUP BY control_number)
 SELECT z.control_number, count(*) AS listed, count(*) FILTER (len(ks) = 0) AS unidentified, coalesce(any_value(f.works), 0) AS works FROM z LEFT JOIN f ON f.control_number = z.control_number GROUP BY z.control_number""",
}
