"""Queries over papers, blocks and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import address as A
from quarry.operators import audit, etl, render, search, tables, terms
from quarry.runtime import cut, table

PHRASE = "lattice calculation"
LONG_PHRASE = "the same holds for phase unknown to everybody"
TOPIC = "lattice calculation of inelastic scattering and the form factor in hadronic matter"
L = "long"


def _b(s: SparkSession, d: str) -> DataFrame:
    return tables.blocks(s, d)


def _p(s: SparkSession, d: str) -> DataFrame:
    return tables.papers(s, d)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("key"), F.concat_ws(" ", "title", "text").alias("words"))


def list_papers(s, d):
    return _p(s, d).select("slug", "title", "year", "ingested", F.size(F.coalesce("authors", F.expr("array()"))).cast(L).alias("authors"), F.size(F.coalesce("chapters", F.expr("filter(chapters, x -> false)"))).cast(L).alias("chapters"))


def chapters(s, d):
    rows = _p(s, d).select("slug", F.posexplode("chapters").alias("ord", "c"))
    named = F.size(F.filter(F.coalesce("c.anchors", F.expr("array()")), lambda a: a.rlike("^(sec|eq|fig|tab)-")))
    return rows.select("slug", F.col("ord").cast(L).alias("ord"), F.col("c.stem").alias("stem"), F.col("c.number").alias("number"), F.col("c.title").alias("title"), F.col("c.words").cast(L).alias("words"), named.cast(L).alias("named_anchors"))


def labels(s, d):
    return _p(s, d).select("slug", F.explode("labels").alias("label", "v")).select("slug", "label", "v.kind", "v.number", "v.anchor", "v.file")


def figures(s, d):
    return _p(s, d).select("slug", F.explode("figures").alias("f")).select("slug", F.col("f.file").alias("file"), F.col("f.label").alias("label"), F.col("f.anchor").alias("anchor"), T.truncate(T.collapse("f.caption"), 120).alias("alt"))


def block_words(s, d):
    return _b(s, d).groupBy("slug", "stem").agg(F.sum(T.word_count(T.words_of_block())).alias("words"), F.sum(F.length(T.display_of_block())).cast(L).alias("shown"), F.count("*").alias("blocks"))


def phrase_search(s, d):
    return search.phrase_search(_b(s, d), PHRASE)


def pattern_search(s, d):
    return search.pattern_search(_b(s, d), "[0-9]+ of the [a-z]+s were lost")


def phrase_backoff(s, d):
    return search.phrase_backoff(_b(s, d), LONG_PHRASE)


def heading_spans(s, d):
    return A.spans(_b(s, d)).filter("kind = 'heading'").select("slug", "stem", F.col("idx").cast(L).alias("idx"), "anchor", "span_end")


def scope_slice(s, d):
    first = _p(s, d).agg(F.min("slug")).first()[0] or "none"
    scopes = [A.parse_scope(f"{first}/01_introduction#sec-introduction"), A.parse_scope(f"{first}#p1..#p2")]
    found = A.resolve(_b(s, d), scopes)
    return found.select("slug", "stem", "start", "end")


def ambiguous_anchors(s, d):
    return A.ambiguous(_b(s, d)).select("slug", "anchor", "chapters", F.array_join("stems", ",").alias("stems"))


def _scopes(s, d):
    """Scopes over the first paper of the collection, and what cannot be read."""
    first = _p(s, d).agg(F.min("slug")).first()[0] or "none"
    return [A.parse_scope(t) for t in (f"{first}/01_introduction#sec-introduction", f"{first}#p1", f"{first}/no_such_chapter", f"{first}#no-such-anchor", "nobody_1900_nothing")]


def scope_refusals(s, d):
    return A.refused(_b(s, d), _scopes(s, d))


def scope_description(s, d):
    return A.described(A.resolve(_b(s, d), [A.Scope()]))


def paper_scopes(s, d):
    return A.papers_in(_p(s, d), [A.parse_scope("disk")])


def neighbours(s, d):
    return A.neighbours(_b(s, d)).select("slug", "stem", F.col("idx").cast(L).alias("idx"), "prev", "next", "parent")


def context_window(s, d):
    rows = A.context(_b(s, d), F.contains(F.lower(T.flatten(T.words_of_block())), F.lit(PHRASE)), 1)
    return rows.select("slug", "stem", F.col("idx").cast(L).alias("idx"))


def contents(s, d):
    return A.contents(_b(s, d), 2)


def word_cap(s, d):
    rows = _b(s, d).select("slug", "stem", "idx", "anchor", T.word_count(T.words_of_block()).alias("words"))
    kept = A.paper_caps(rows, "words", 20, 200)
    kept = kept.withColumn("loc", T.location())
    return kept.groupBy("slug").agg(F.count_if("kept").alias("blocks"), F.sum(F.when(F.col("kept"), F.col("words"))).alias("words"), F.min_by("loc", F.when(~F.col("kept"), F.col("rn"))).alias("resume"))


def fresh_anchors(s, d):
    return A.paragraph_anchors(_b(s, d)).select("slug", "stem", F.col("idx").cast(L).alias("idx"), "address")


def object_numbers(s, d):
    return A.object_numbers(_b(s, d)).select("slug", "stem", F.col("idx").cast(L).alias("idx"), "kind", "object_number")


def heading_numbers(s, d):
    return A.heading_numbers(_b(s, d)).select("slug", "stem", F.col("idx").cast(L).alias("idx"), "dotted")


def chapter_sections(s, d):
    return A.sections(_b(s, d))


def sentence_split(s, d):
    rows = _b(s, d).filter("kind = 'paragraph'").select("slug", "stem", "idx", F.posexplode(T.sentences("text")).alias("n", "sentence"))
    return rows.select("slug", "stem", F.col("idx").cast(L).alias("idx"), F.col("n").cast(L).alias("n"), "sentence")


def topic_terms(s, d):
    return _p(s, d).select("slug", F.array_join(T.topic_terms("title"), " ").alias("terms"))


def prefix_join(s, d):
    titles = _p(s, d).select(F.explode(T.topic_terms("title")).alias("term")).distinct()
    words = _docs(s, d).select(F.explode(T.title_words("words")).alias("word")).distinct()
    return search.prefix_matches(titles, words)


def df_weights(s, d):
    rows = search.term_weights(_docs(s, d), TOPIC)
    return rows.select("term", "df", F.floor(F.col("weight") * 1000).cast(L).alias("weight_milli"))


def coverage_topk(s, d):
    rows = search.coverage(_docs(s, d), TOPIC, 300)
    return rows.select(F.col("key").alias("doc_id"), F.floor(F.col("coverage") * 1000 + 0.0001).cast(L).alias("coverage_milli"), F.array_join("missing", " ").alias("missing"))


def residue_counts(s, d):
    return audit.residue(_b(s, d)).select("slug", "stem", F.col("commands").cast(L).alias("commands"), F.col("odd_blanks").cast(L).alias("odd_blanks"))


def references(s, d):
    return audit.references(_b(s, d), _p(s, d))


def scoped_audit(s, d):
    return audit.scoped(audit.references(_b(s, d), _p(s, d)).filter("reason <> ''"))


def _units(s, d):
    return terms.units(_b(s, d), _p(s, d))


def text_units(s, d):
    return _units(s, d).groupBy("slug", "kind").agg(F.count("*").alias("units"), F.sum(F.length("text")).cast(L).alias("letters"))


def ngram_weights(s, d):
    return terms.weights(_units(s, d)).filter("weight >= 4")


def title_terms(s, d):
    rows = terms.examples(_p(s, d).select(F.col("slug").alias("key"), "title"))
    return rows.select("term", "weight", F.array_join("examples", ",").alias("examples"))


def variant_merge(s, d):
    return terms.merged(cut(terms.weights(_units(s, d)))).filter("weight >= 4").select("key", "label", F.col("weight").cast(L).alias("weight"))


def subsumed_terms(s, d):
    merged = cut(terms.merged(cut(terms.weights(_units(s, d)))).filter("weight >= 4"))
    return terms.subsumed(merged.select(F.col("key").alias("term"), "weight")).orderBy(F.desc("weight"), "term").limit(20)


def terminology(s, d):
    """The report of a topic over all texts and the titles of all cited works."""
    rows = terms.report(_units(s, d), table(s, d, "works").select("title"), T.topic_list(TOPIC))
    return rows.select("term", F.col("weight").cast(L).alias("weight"), "shared", "new", F.round(F.col("score") * 100).cast(L).alias("score_cents"), "places")


def pivot_word(s, d):
    return terms.pivot(_units(s, d), T.topic_list(TOPIC))


def stated_aliases(s, d):
    """Names that the texts put beside the topic's rarest word."""
    pivot = pivot_word(s, d).first()
    return terms.stated_aliases(_units(s, d), terms.weights(_units(s, d)), pivot["term"] if pivot else "", T.topic_list(TOPIC))


def alias_claims(s, d):
    return terms.aliases(_units(s, d), "model")


def render_chapters(s, d):
    return render.chapters(_b(s, d))


def paper_pages(s, d):
    return render.paper_pages(_p(s, d))


def substitute_citations(s, d):
    return render.substituted(_b(s, d), tables.works(s, d))


def document_blocks(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "line"))
    line = T.collapse("line")
    kind = F.when(line.rlike("^(#+ |=+ )"), "heading").when(line.rlike("^([-*+] |[0-9]+[.] )"), "item").otherwise("paragraph")
    return rows.select("doc_id", F.col("idx").cast(L).alias("idx"), kind.alias("kind"), line.alias("text")).filter("text <> ''")


def tex_documents(s, d):
    """Blocks of the documents that carry TeX, by the source parser."""
    tex = table(s, d, "documents").filter(F.contains("text", F.lit("\\begin{")))
    return etl.parse_sources(tex, "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"))


def json_props(s, d):
    rows = table(s, d, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return rows.groupBy("event_type").agg(F.count("p.k").alias("with_k"), F.sum("p.k").alias("sum_k"))


def gate_violations(s, d):
    from pyspark.sql import Window

    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(s, d, "events").withColumn("gap", gap).filter(F.col("gap") < 60_000_000)
    return rows.groupBy("user_id").agg(F.count("*").alias("violations"), F.min("gap").alias("least_gap"))


def scorer_topk(s, d):
    rows = table(s, d, "embeddings").select("vec_id", "embedding")
    query = F.broadcast(rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")))
    product = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = rows.join(query).select("vec_id", F.floor(product * 10_000).cast(L).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


QUERIES = {f.__name__: f for f in (list_papers, chapters, labels, figures, block_words, phrase_search, pattern_search, phrase_backoff, heading_spans, scope_slice, scope_refusals, scope_description, paper_scopes, ambiguous_anchors, neighbours, context_window, contents, word_cap, fresh_anchors, object_numbers, heading_numbers, chapter_sections, sentence_split, topic_terms, prefix_join, df_weights, coverage_topk, residue_counts, references, scoped_audit, text_units, ngram_weights, title_terms, variant_merge, subsumed_terms, terminology, pivot_word, stated_aliases, alias_claims, render_chapters, paper_pages, substitute_citations, document_blocks, tex_documents, json_props, gate_violations, scorer_topk)}

# --- SQL ---------------------------------------------------------------------------------------

B = "b AS (SELECT DISTINCT ON (slug, stem, idx) * FROM blocks ORDER BY slug, stem, idx)"
P = "p AS (SELECT * FROM papers WHERE slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY coalesce(ingested, '') DESC, coalesce(parser, '') DESC) = 1)"
WORDS = "coalesce(CASE WHEN kind = 'paragraph' THEN text WHEN kind = 'heading' THEN title WHEN kind IN ('figure', 'table') THEN caption END, '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{T.BLANK}+', ' ', 'g'))"


def flat(x: str) -> str:
    quotes_from, quotes_to = T.QUOTES_FROM.replace("'", "''"), T.QUOTES_TO.replace("'", "''")
    return squeeze(f"regexp_replace(translate(translate({x}, '{quotes_from}', '{quotes_to}'), '{T.ZERO_WIDTH}', ''), '[\\x00-\\x1f]', ' ', 'g')")


def marks(x: str, clauses: bool = False) -> str:
    """sentence_marks() of a collapsed text."""
    known, sign = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS), "[.!?;]" if clauses else "[.!?]"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^A-Za-z.])({known})(\.*{sign}) ', '\1\2\3' || chr(1), 'g')"
    return rf"regexp_replace({x}, '({sign}) ', '\1' || chr(2), 'g')"


def sentences(x: str, clauses: bool = False) -> str:
    return f"list_filter(list_transform(string_split({marks(x, clauses)}, chr(2)), lambda z: trim(replace(z, chr(1), ' '))), lambda z: z <> '')"


def count_words(x: str) -> str:
    return f"(CASE WHEN {squeeze(x)} = '' THEN 0 ELSE len(string_split({squeeze(x)}, ' ')) END)"


def title_words(x: str) -> str:
    """Distinct words in order."""
    ws = rf"list_filter(string_split(trim(regexp_replace(lower(regexp_replace(coalesce({x}, ''), '\\[a-zA-Z]+', ' ', 'g')), '[^0-9a-zA-Z]+', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"(SELECT coalesce(list(w ORDER BY i), []) FROM (SELECT w, min(i) AS i FROM (SELECT unnest({ws}) AS w, generate_subscripts({ws}, 1) AS i) GROUP BY w))"


def literal_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


STOP = literal_list(T.TOPIC_STOPWORDS + T.META_TERMS)
BARRED = literal_list(sorted(set(T.TOPIC_STOPWORDS) | set(T.FURNITURE)))


def ngrams(x: str) -> str:
    segs = rf"list_transform(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce({x}, ''), '\\[a-zA-Z]+', ' ', 'g'), '([0-9A-Za-z])[-‐‑]([0-9A-Za-z])', '\1 \2', 'g')), '[^0-9a-z ]+'), lambda s: list_filter(string_split(s, ' '), lambda w: w <> ''))"
    grams = f"flatten(list_transform({segs}, lambda s: list_concat(" + ", ".join(f"list_transform(range(1, greatest(len(s) - {n - 1}, 0) + 1), lambda i: s[i:i + {n - 1}])" for n in (2, 3)) + ")))"
    fit = f"list_filter({grams}, lambda g: NOT list_contains({BARRED}, g[1]) AND NOT list_contains({BARRED}, g[-1]) AND len(list_filter(g, lambda w: regexp_full_match(w, '[0-9]+'))) = 0)"
    return f"list_distinct(list_transform({fit}, lambda g: array_to_string(g, ' ')))"


NEIGHBOURS = f"""WITH {B}, h AS (SELECT slug, stem, idx, anchor, coalesce(level, 0) AS lv FROM b WHERE kind = 'heading'), nb AS (
SELECT b.slug, b.stem, b.idx::BIGINT AS idx,
 (SELECT arg_max(anchor, idx) FROM b x WHERE x.slug = b.slug AND x.stem = b.stem AND x.idx < b.idx AND coalesce(x.anchor, '') <> '') AS prev,
 (SELECT arg_min(anchor, idx) FROM b x WHERE x.slug = b.slug AND x.stem = b.stem AND x.idx > b.idx AND coalesce(x.anchor, '') <> '') AS next,
 (SELECT arg_max(anchor, idx) FROM h WHERE h.slug = b.slug AND h.stem = b.stem AND h.idx < b.idx AND coalesce(h.anchor, '') <> '' AND (b.kind <> 'heading' OR h.lv < coalesce(b.level, 0))) AS parent"""
READ = squeeze(r"regexp_replace(regexp_replace(t, '\$[^$]*\$', ' ', 'g'), '\[(?:cite|ref):[^\]]*\]', ' ', 'g')")
UNITS = f"""{B}, {P}, u0 AS (
 SELECT slug, CASE WHEN kind = 'heading' THEN 'heading' WHEN kind IN ('figure', 'table') THEN 'caption' ELSE 'body' END AS kind, 1 AS rank, stem AS chapter, idx::BIGINT AS idx, coalesce(anchor, '') AS anchor, {WORDS} AS t FROM b WHERE kind IN ('heading', 'figure', 'table', 'paragraph')
 UNION ALL SELECT slug, 'heading', 0, 'paper', 0, '', coalesce(title, '') FROM p UNION ALL SELECT slug, 'abstract', 0, 'paper', 1, '', coalesce(abstract, '') FROM p),
 u1 AS (SELECT slug, kind, rank, chapter, idx, anchor, {READ} AS t FROM u0),
 u2 AS (SELECT *, CASE WHEN kind = 'heading' THEN [t] ELSE {sentences('t', True)} END AS ts FROM u1 WHERE t <> ''),
 u AS (SELECT slug, kind, rank, chapter, idx, anchor, unnest(ts) AS t, generate_subscripts(ts, 1) AS n FROM u2),
 wg AS (SELECT CASE kind WHEN 'heading' THEN 6 WHEN 'abstract' THEN 4 WHEN 'caption' THEN 2 ELSE 1 END AS w, unnest({ngrams('t')}) AS term FROM u),
 tw AS (SELECT term, sum(w)::BIGINT AS weight, count(*) AS units FROM wg GROUP BY term)"""


def merging(source: str) -> str:
    """CTEs mg (term, weight, key) and o (key, label, weight) of a table of (term, weight)."""
    return f"""ws AS (SELECT DISTINCT unnest(string_split(term, ' ')) AS w FROM {source}),
 sg AS (SELECT w, coalesce(CASE WHEN ends_with(w, 'es') AND w[1:-3] IN (SELECT w FROM ws) THEN w[1:-3] END, CASE WHEN ends_with(w, 's') AND w[1:-2] IN (SELECT w FROM ws) THEN w[1:-2] END, w) AS stem FROM ws),
 pt AS (SELECT term, unnest(string_split(term, ' ')) AS w, generate_subscripts(string_split(term, ' '), 1) AS i FROM {source}),
 mk AS (SELECT term, string_agg(stem, ' ' ORDER BY i) AS key FROM pt JOIN sg ON sg.w = pt.w GROUP BY term),
 mg AS (SELECT term, weight, key FROM {source} JOIN mk USING (term)),
 o AS (SELECT key, arg_min(term, (-weight, term)) AS label, sum(weight)::BIGINT AS weight FROM mg GROUP BY key)"""


def matched(a: str, b: str) -> str:
    return f"({a} = {b} OR (least(length({a}), length({b})) >= 4 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))))"


SPANS = f"""{B}, hs AS (SELECT slug, stem, idx, anchor, title, coalesce(level, 0) AS lv FROM b WHERE kind = 'heading'),
 sp AS (SELECT h.*, coalesce((SELECT min(x.idx) FROM hs x WHERE x.slug = h.slug AND x.stem = h.stem AND x.idx > h.idx AND x.lv <= h.lv), (SELECT max(idx) + 1 FROM b WHERE b.slug = h.slug AND b.stem = h.stem))::BIGINT AS span_end FROM hs h)"""
REFS = rf"""{B}, {P}, us AS (SELECT slug, label, count(*) AS uses FROM (SELECT slug, unnest(regexp_extract_all(coalesce(text, ''), '\[ref: *([^\]]*)\]', 1)) AS label FROM b) WHERE label <> '' GROUP BY ALL),
 lb AS (SELECT slug, e.key AS name, e.value.anchor AS anchor FROM (SELECT slug, unnest(map_entries(labels)) AS e FROM p)),
 rf AS (SELECT us.*, CASE WHEN EXISTS (SELECT 1 FROM lb WHERE lb.slug = us.slug AND (lb.name = us.label OR lb.anchor = us.label)) THEN ''
  WHEN EXISTS (SELECT 1 FROM b WHERE b.slug = us.slug AND b.anchor = us.label) THEN 'anchor only' WHEN us.slug IN (SELECT slug FROM p) THEN 'no such label' ELSE 'no such paper' END AS reason FROM us)"""


TERMS = T.topic_list(TOPIC)
HITS = f"""d AS (SELECT doc_id, unnest({title_words("concat_ws(' ', title, text)")}) AS w FROM documents), tt AS (SELECT unnest({literal_list(TERMS)}) AS term, generate_subscripts({literal_list(TERMS)}, 1) AS ord),
 hit AS (SELECT DISTINCT doc_id, term FROM d, tt WHERE w = term OR (least(length(w), length(term)) >= 4 AND (starts_with(w, term) OR starts_with(term, w)))),
 df AS (SELECT tt.term, tt.ord, count(doc_id) AS df FROM tt LEFT JOIN hit ON hit.term = tt.term GROUP BY ALL),
 wt AS (SELECT term, ord, df, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / greatest(df, 1)) AS weight FROM df)"""
SURNAME = "CASE WHEN contains(trim(x), ',') THEN trim(split_part(trim(x), ',', 1)) ELSE string_split(regexp_replace(trim(x), '( +([A-Z][.]?){1,3})+$', ''), ' ')[-1] END"
AUTHORS = "list_filter(coalesce(authors, []), lambda x: x IS NOT NULL AND trim(x) <> '')"


def citation(prefix: str = "") -> str:
    a = AUTHORS.replace("authors", prefix + "authors")
    first = SURNAME.replace("x)", f"({a})[1])")
    return f"((CASE WHEN len({a}) = 0 THEN 'Anon' WHEN len({a}) = 1 THEN {first} ELSE {first} || ' et al.' END) || ', ' || coalesce({prefix}year::VARCHAR, 'n.d.'))"


SQL = {
    "list_papers": f"WITH {P} SELECT slug, title, year, ingested, coalesce(len(authors), 0)::BIGINT AS authors, coalesce(len(chapters), 0)::BIGINT AS chapters FROM p",
    "chapters": f"WITH {P}, c AS (SELECT slug, unnest(chapters) AS c, generate_subscripts(chapters, 1) - 1 AS ord FROM p) SELECT slug, ord::BIGINT AS ord, c.stem AS stem, c.number AS number, c.title AS title, c.words::BIGINT AS words, len(list_filter(coalesce(c.anchors, []), lambda a: regexp_matches(a, '^(sec|eq|fig|tab)-')))::BIGINT AS named_anchors FROM c",
    "labels": f"WITH {P}, e AS (SELECT slug, unnest(map_entries(labels)) AS e FROM p) SELECT slug, e.key AS label, e.value.kind AS kind, e.value.number AS number, e.value.anchor AS anchor, e.value.file AS file FROM e",
    "figures": f"WITH {P}, f AS (SELECT slug, unnest(figures) AS f FROM p) SELECT slug, f.file AS file, f.label AS label, f.anchor AS anchor, CASE WHEN length({squeeze('f.caption')}) > 120 THEN rtrim(substring({squeeze('f.caption')}, 1, 119)) || '…' ELSE {squeeze('f.caption')} END AS alt FROM f",
    "block_words": f"WITH {B} SELECT slug, stem, sum({count_words(WORDS)})::BIGINT AS words, sum(length(coalesce(CASE WHEN kind = 'paragraph' THEN text WHEN kind = 'heading' THEN concat_ws(' ', CASE WHEN coalesce(number, '') <> '' THEN number END, title) WHEN kind = 'math' THEN tex WHEN kind = 'code' THEN text WHEN kind = 'table' THEN concat_ws(chr(10), caption, tex) WHEN kind = 'figure' THEN caption END, '')))::BIGINT AS shown, count(*) AS blocks FROM b GROUP BY slug, stem",
    "phrase_search": NEIGHBOURS + f""" FROM b), f AS (SELECT slug, stem, idx::BIGINT AS idx, kind, anchor, {flat(WORDS)} AS f FROM b),
 k AS (SELECT *, {marks('f')} AS m, string_split(lower(f), '{PHRASE}') AS ps FROM f WHERE contains(lower(f), '{PHRASE}')),
 q AS (SELECT *, unnest(range(1, len(ps))) AS i FROM k),
 a AS (SELECT *, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * {len(PHRASE)} + 1)::BIGINT AS pos FROM q),
 e AS (SELECT *, length(string_split(m[1:pos - 1], chr(2))[-1]) AS bef, length(string_split(m[pos + {len(PHRASE)}:], chr(2))[1]) AS aft FROM a),
 y AS (SELECT *, f[pos - bef:pos + {len(PHRASE)} + aft - 1] AS s FROM e),
 z AS (SELECT *, greatest(0, least(length(s), greatest(0, bef - {(300 - len(PHRASE)) // 2}) + 300) - 300) AS l FROM y),
 c AS (SELECT *, least(length(s), l + 300) AS r FROM z)
 SELECT c.slug, c.stem, c.idx, i - 1 AS match, kind, c.slug || '/' || c.stem || CASE WHEN coalesce(anchor, '') <> '' THEN '#' || anchor ELSE '' END AS location,
 trim(CASE WHEN length(s) <= 300 THEN s ELSE CASE WHEN l > 0 THEN '…' || s[l + 2:r] ELSE s[l + 1:r] END[1:CASE WHEN r < length(s) THEN -2 ELSE -1 END] || CASE WHEN r < length(s) THEN '…' ELSE '' END END) AS sentence, prev, next, parent
 FROM c JOIN nb ON nb.slug = c.slug AND nb.stem = c.stem AND nb.idx = c.idx""",
    "pattern_search": f"WITH {B} SELECT slug, stem, idx::BIGINT AS idx, unnest(regexp_extract_all({flat(WORDS)}, '(?i)[0-9]+ of the [a-z]+s were lost')) AS match FROM b",
    "phrase_backoff": f"WITH {B}, t AS (SELECT lower({flat(WORDS)}) AS f FROM b), n AS (SELECT unnest(range({len(LONG_PHRASE.split())}, 2, -1)) AS words), q AS (SELECT words, array_to_string(string_split('{LONG_PHRASE}', ' ')[1:words], ' ') AS phrase FROM n), c AS (SELECT words::BIGINT AS words, phrase, (SELECT count(*) FROM t WHERE contains(f, phrase)) AS hits FROM q) SELECT * FROM c WHERE hits > 0 ORDER BY words DESC LIMIT 1",
    "heading_spans": f"WITH {SPANS} SELECT slug, stem, idx::BIGINT AS idx, anchor, span_end FROM sp",
    "scope_slice": f"""WITH {SPANS}, {P}, k AS (SELECT b.slug, b.stem, b.idx, b.anchor, coalesce(sp.span_end, b.idx + 1)::BIGINT AS span_end FROM b LEFT JOIN sp ON sp.slug = b.slug AND sp.stem = b.stem AND sp.idx = b.idx WHERE b.slug = (SELECT min(slug) FROM p))
 SELECT slug, stem, min(idx)::BIGINT AS start, max(span_end) AS "end" FROM k WHERE (stem = '01_introduction' AND anchor = 'sec-introduction') OR anchor IN ('p1', 'p2') GROUP BY slug, stem""",
    "ambiguous_anchors": f"WITH {B} SELECT slug, anchor, count(DISTINCT stem) AS chapters, array_to_string(list(DISTINCT stem ORDER BY stem)[1:5], ',') AS stems FROM b WHERE coalesce(anchor, '') <> '' GROUP BY slug, anchor HAVING count(DISTINCT stem) > 1",
    "neighbours": NEIGHBOURS + " FROM b) SELECT * FROM nb",
    "context_window": f"WITH {B}, m AS (SELECT slug, stem, idx FROM b WHERE contains(lower({flat(WORDS)}), '{PHRASE}')), o AS (SELECT slug, stem, idx, row_number() OVER (PARTITION BY slug, stem ORDER BY idx) AS rn FROM b), om AS (SELECT o.* FROM o JOIN m USING (slug, stem, idx)) SELECT DISTINCT o.slug, o.stem, o.idx::BIGINT AS idx FROM o JOIN om ON om.slug = o.slug AND om.stem = o.stem AND abs(om.rn - o.rn) <= 1",
    "contents": f"WITH {SPANS}, wd AS (SELECT slug, stem, idx, {count_words(WORDS)} AS words FROM b), rk AS (SELECT *, dense_rank() OVER (PARTITION BY slug, stem ORDER BY lv) AS rank FROM sp) SELECT rk.slug, rk.stem, rk.idx::BIGINT AS idx, rk.anchor, rk.title, rk.rank::BIGINT AS rank, (SELECT sum(words) FROM wd WHERE wd.slug = rk.slug AND wd.stem = rk.stem AND wd.idx >= rk.idx AND wd.idx < rk.span_end)::BIGINT AS section_words, (SELECT max(rank) FROM rk x WHERE x.slug = rk.slug AND x.stem = rk.stem) > 2 AS deeper FROM rk WHERE rank <= 2",
    "word_cap": f"WITH {B}, w AS (SELECT slug, stem, idx, anchor, {count_words(WORDS)} AS words FROM b), r AS (SELECT *, row_number() OVER o AS rn, sum(words) OVER (o ROWS UNBOUNDED PRECEDING) AS run FROM w WINDOW o AS (PARTITION BY slug ORDER BY stem, idx)), k AS (SELECT *, rn <= 20 AND (rn = 1 OR run <= 200) AS kept FROM r) SELECT slug, count(*) FILTER (kept) AS blocks, sum(words) FILTER (kept)::BIGINT AS words, arg_min(slug || '/' || stem || CASE WHEN coalesce(anchor, '') <> '' THEN '#' || anchor ELSE '' END, rn) FILTER (NOT kept) AS resume FROM k GROUP BY slug",
    "fresh_anchors": f"WITH {B}, l AS (SELECT *, coalesce(anchor, '') = '' AS bare, coalesce(anchor, '') = '' AND kind = 'paragraph' AND length(coalesce(text, '')) >= 80 AS long FROM b) SELECT slug, stem, idx::BIGINT AS idx, CASE WHEN NOT bare THEN anchor WHEN long THEN 'p' || (count(*) FILTER (long) OVER w)::VARCHAR ELSE 'b' || (count(*) FILTER (bare AND NOT long) OVER w)::VARCHAR END AS address FROM l WINDOW w AS (PARTITION BY slug, stem ORDER BY idx ROWS UNBOUNDED PRECEDING)",
    "object_numbers": f"WITH {B} SELECT slug, stem, idx::BIGINT AS idx, kind, row_number() OVER (PARTITION BY slug, kind ORDER BY stem, idx) AS object_number FROM b WHERE kind IN ('figure', 'table', 'math')",
    "heading_numbers": f"WITH {B}, h AS (SELECT slug, stem, idx, coalesce(level, 0) AS lv, dense_rank() OVER (PARTITION BY slug ORDER BY stem) AS c FROM b WHERE kind = 'heading'), g AS (SELECT *, count(*) FILTER (lv = 2) OVER (PARTITION BY slug, stem ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM h WHERE lv > 1), t AS (SELECT *, count(*) FILTER (lv > 2) OVER (PARTITION BY slug, stem, s ORDER BY idx ROWS UNBOUNDED PRECEDING) AS t FROM g) SELECT slug, stem, idx::BIGINT AS idx, concat_ws('.', c, s, CASE WHEN lv > 2 THEN t END) AS dotted FROM t",
    "chapter_sections": f"WITH {B}, m AS (SELECT *, count(*) FILTER (kind = 'heading') OVER (PARTITION BY slug, stem ORDER BY idx ROWS UNBOUNDED PRECEDING) AS section FROM b) SELECT slug, stem, section, min(idx)::BIGINT AS first, max(idx)::BIGINT AS last, count(*) AS blocks, sum({count_words(WORDS)})::BIGINT AS words FROM m GROUP BY slug, stem, section",
    "topic_terms": f"WITH {P} SELECT slug, array_to_string(list_filter({title_words('title')}, lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))[1:12], ' ') AS terms FROM p",
    "prefix_join": f"WITH {P}, t AS (SELECT DISTINCT unnest(list_filter({title_words('title')}, lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))[1:12]) AS term FROM p), w AS (SELECT DISTINCT unnest({title_words("concat_ws(' ', title, text)")}) AS word FROM documents) SELECT term, word FROM t, w WHERE term = word OR (least(length(term), length(word)) >= 4 AND (starts_with(term, word) OR starts_with(word, term)))",
    "df_weights": f"WITH {HITS} SELECT term, df, floor(weight * 1000)::BIGINT AS weight_milli FROM wt",
    "coverage_topk": f"WITH {HITS}, k AS (SELECT DISTINCT doc_id FROM hit), s AS (SELECT k.doc_id, sum(CASE WHEN hit.term IS NOT NULL THEN weight ELSE 0 END) / sum(weight) AS coverage, coalesce(string_agg(CASE WHEN hit.term IS NULL THEN wt.term END, ' ' ORDER BY ord), '') AS missing FROM k CROSS JOIN wt LEFT JOIN hit ON hit.doc_id = k.doc_id AND hit.term = wt.term GROUP BY k.doc_id) SELECT doc_id, floor(coverage * 1000 + 0.0001)::BIGINT AS coverage_milli, missing FROM s WHERE coverage >= 0.34 ORDER BY coverage DESC, doc_id LIMIT 300",
    "residue_counts": rf"WITH {B} SELECT slug, stem, sum(len(regexp_extract_all(coalesce(text, ''), '\\[a-zA-Z]+')))::BIGINT AS commands, sum(len(regexp_extract_all(coalesce(text, ''), '  +|\n')))::BIGINT AS odd_blanks FROM b GROUP BY slug, stem HAVING commands + odd_blanks > 0",
    "references": f"WITH {REFS} SELECT slug, label, uses, reason FROM rf",
    "scoped_audit": f"WITH {REFS}, m AS (SELECT slug, count(*) AS mine FROM rf WHERE reason <> '' GROUP BY slug) SELECT slug, mine, ((SELECT sum(mine) FROM m) - mine)::BIGINT AS elsewhere FROM m",
    "ngram_weights": f"WITH {UNITS} SELECT * FROM tw WHERE weight >= 4",
    "title_terms": f"WITH {P}, g AS (SELECT slug, unnest({ngrams('title')}) AS term FROM p) SELECT term, count(*) AS weight, array_to_string(list(slug ORDER BY slug)[1:3], ',') AS examples FROM g GROUP BY term",
    "variant_merge": f"WITH {UNITS}, {merging('tw')} SELECT * FROM o WHERE weight >= 4",
    "subsumed_terms": f"WITH {UNITS}, {merging('tw')}, hv AS (SELECT key AS term, weight FROM o WHERE weight >= 4), lg AS (SELECT * FROM hv WHERE len(string_split(term, ' ')) = 3) SELECT term, weight FROM hv s WHERE NOT (len(string_split(term, ' ')) = 2 AND EXISTS (SELECT 1 FROM lg WHERE (starts_with(lg.term, s.term || ' ') OR ends_with(lg.term, ' ' || s.term)) AND s.weight * 80 <= lg.weight * 100)) ORDER BY weight DESC, term LIMIT 20",
    "sentence_split": f"WITH {B}, z AS (SELECT slug, stem, idx::BIGINT AS idx, {sentences(squeeze("coalesce(text, '')"))} AS ss FROM b WHERE kind = 'paragraph') SELECT slug, stem, idx, unnest(ss) AS sentence, (generate_subscripts(ss, 1) - 1)::BIGINT AS n FROM z",
    "text_units": f"WITH {UNITS} SELECT slug, kind, count(*) AS units, sum(length(t))::BIGINT AS letters FROM u GROUP BY slug, kind",
    "scope_refusals": f"WITH {B}, {P}, f AS (SELECT min(slug) AS slug FROM p), a AS (SELECT slug, '01_introduction' AS stem, 'sec-introduction' AS anchor FROM f UNION ALL SELECT slug, '', 'p1' FROM f UNION ALL SELECT slug, 'no_such_chapter', '' FROM f UNION ALL SELECT slug, '', 'no-such-anchor' FROM f UNION ALL SELECT 'nobody_1900_nothing', '', ''), r AS (SELECT a.slug || '/' || a.stem || '#' || a.anchor AS scope, a.anchor, (SELECT count(*) FROM b WHERE b.slug = a.slug) AS np, (SELECT count(*) FROM b WHERE b.slug = a.slug AND (a.stem = '' OR b.stem = a.stem)) AS nc, (SELECT list(DISTINCT b.stem ORDER BY b.stem) FROM b WHERE b.slug = a.slug AND (a.stem = '' OR b.stem = a.stem) AND a.anchor <> '' AND b.anchor = a.anchor) AS st FROM a) SELECT scope, CASE WHEN np = 0 THEN 'no such paper' WHEN nc = 0 THEN 'no such chapter' WHEN anchor <> '' AND st IS NULL THEN 'no such anchor' ELSE 'ambiguous anchor' END AS reason, coalesce(array_to_string(st[1:5], ','), '') AS candidates FROM r WHERE np = 0 OR nc = 0 OR (anchor <> '' AND (st IS NULL OR len(st) > 1))",
    "scope_description": f"WITH {B} SELECT count(DISTINCT slug) AS papers, count(*) AS chapters, sum(hi - lo + 1)::BIGINT AS blocks FROM (SELECT slug, stem, min(idx) AS lo, max(idx) AS hi FROM b GROUP BY slug, stem)",
    "paper_scopes": f"WITH {P} SELECT slug FROM p",
    "terminology": f"""WITH {UNITS}, tl AS (SELECT term, count(*) AS weight FROM (SELECT unnest({ngrams('title')}) AS term FROM works) GROUP BY term),
 al AS (SELECT term, sum(weight)::BIGINT AS weight FROM (SELECT term, weight FROM tw UNION ALL SELECT * FROM tl) GROUP BY term), {merging('al')}, tp AS (SELECT {literal_list(TERMS)} AS ts),
 hv AS (SELECT key, label, weight, string_split(label, ' ') AS ws, list_filter(string_split(label, ' '), lambda w: len(list_filter(ts, lambda t: {matched('w', 't')})) > 0) AS sh FROM o, tp WHERE weight >= 4),
 kp AS (SELECT * FROM hv WHERE len(sh) < len(ws)), lg AS (SELECT key, weight FROM kp WHERE len(string_split(key, ' ')) = 3),
 st AS (SELECT * FROM kp s WHERE NOT (len(string_split(key, ' ')) = 2 AND EXISTS (SELECT 1 FROM lg WHERE (starts_with(lg.key, s.key || ' ') OR ends_with(lg.key, ' ' || s.key)) AND s.weight * 80 <= lg.weight * 100))),
 bs AS (SELECT *, round(weight * (1 - len(sh) / len(ws)), 4) AS score FROM st ORDER BY score DESC, weight DESC, label LIMIT 20),
 pl AS (SELECT DISTINCT key, slug, rank, chapter, idx, n, slug || '/' || chapter || CASE WHEN anchor <> '' THEN '#' || anchor ELSE '' END AS wh FROM (SELECT slug, rank, chapter, idx, n, anchor, unnest({ngrams('t')}) AS term FROM u) JOIN mg USING (term) WHERE key IN (SELECT key FROM bs)),
 fp AS (SELECT key, array_to_string(list(wh ORDER BY slug, rank, chapter, idx, n)[1:3], ' ') AS places FROM pl GROUP BY key)
 SELECT label AS term, weight, array_to_string(sh, ' ') AS shared, array_to_string(list_filter(ws, lambda w: NOT list_contains(sh, w)), ' ') AS new, round(score * 100)::BIGINT AS score_cents, coalesce(places, '') AS places FROM bs LEFT JOIN fp USING (key)""",
    "pivot_word": f"WITH {UNITS}, tt AS (SELECT unnest({literal_list(TERMS)}) AS term), n AS (SELECT row_number() OVER () AS i, {title_words('t')} AS ws FROM u), c AS (SELECT term, count(*) AS units FROM n, tt WHERE len(list_filter(ws, lambda w: {matched('w', 'term')})) > 0 GROUP BY term) SELECT term, units FROM c ORDER BY units, term LIMIT 1",
    "render_chapters": f"WITH {B}, m AS (SELECT slug, stem, idx, coalesce(CASE WHEN kind = 'heading' THEN repeat('#', coalesce(level, 2)) || ' ' || CASE WHEN coalesce(number, '') <> '' THEN number || ' ' ELSE '' END || coalesce(title, '') WHEN kind = 'paragraph' THEN {squeeze('text')} WHEN kind = 'math' THEN '$$' || chr(10) || tex || chr(10) || '$$' WHEN kind = 'figure' THEN '![' || {squeeze('caption')} || '](' || file || ')' WHEN kind = 'table' THEN {squeeze('caption')} WHEN kind = 'code' THEN '```' || chr(10) || text || chr(10) || '```' END, '') AS md FROM b) SELECT slug, stem, string_agg(md, chr(10) || chr(10) ORDER BY idx) AS markdown FROM m WHERE md <> '' GROUP BY slug, stem",
    "document_blocks": f"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx FROM documents), s AS (SELECT doc_id, idx, {squeeze('line')} AS text FROM l) SELECT doc_id, idx::BIGINT AS idx, CASE WHEN regexp_matches(text, '^(#+ |=+ )') THEN 'heading' WHEN regexp_matches(text, '^([-*+] |[0-9]+[.] )') THEN 'item' ELSE 'paragraph' END AS kind, text FROM s WHERE text <> ''",
    "json_props": "SELECT event_type, count(json_extract(props, '$.k')) AS with_k, sum((json_extract(props, '$.k'))::INT)::BIGINT AS sum_k FROM events GROUP BY event_type",
    "gate_violations": "WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, count(*) AS violations, min(gap) AS least_gap FROM g WHERE gap < 60000000 GROUP BY user_id",
    "scorer_topk": "WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, floor(list_reduce(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE), lambda a, x: a + x) * 10000)::BIGINT AS score FROM embeddings, q) SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20",
    "paper_pages": f"WITH {P} SELECT slug, concat_ws(chr(10), '# ' || coalesce(title, '—'), array_to_string(list_transform(({AUTHORS})[1:3], lambda x: {SURNAME}), ', ') || CASE WHEN len({AUTHORS}) > 3 THEN ' et al.' ELSE '' END, coalesce(nullif(journal_ref, ''), '—'), array_to_string(list_transform(coalesce(chapters, []), lambda c: '| ' || coalesce(c.number, '') || ' | ' || replace({squeeze('coalesce(c.title, chr(32))')}, '|', '\\|') || ' | ' || coalesce(c.words, 0)::VARCHAR || ' |'), chr(10)), 'words: ' || coalesce(list_sum(list_transform(coalesce(chapters, []), lambda c: coalesce(c.words, 0))), 0)::BIGINT::VARCHAR) AS page FROM p",
    "substitute_citations": None,
}
SQL = {k: v for k, v in SQL.items() if v}
