import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import address as A
from quarry.operators import audit, etl, overlap, render, search, terms
from quarry.operators import works as W
from quarry.plans import catalog

BLOCK = "slug string, stem string, idx int, kind string, anchor string, level int, number string, title string, text string, tex string, caption string, file string"


def blocks(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (12 - len(r))) for r in rows], BLOCK)


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def chapter(spark):
    return blocks(
        spark,
        ("s", "1", 0, "heading", "sec-a", 2, "1", "Alpha"),
        ("s", "1", 1, "paragraph", "", None, None, None, "no address here"),
        ("s", "1", 2, "paragraph", "p1", None, None, None, "a b c"),
        ("s", "1", 3, "heading", "sec-b", 3, "1.1", "Beta"),
        ("s", "1", 4, "paragraph", "p2", None, None, None, "d e"),
        ("s", "1", 5, "heading", "sec-c", 2, "2", "Gamma"),
        ("s", "1", 6, "paragraph", "p3", None, None, None, "f"),
    )


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_a_query_agrees_with_its_sql(spark, data, name):
    """Rows and columns of every registered query are those of its SQL, on the smallest tables."""
    found = catalog.queries()[name](spark, data)
    con = duckdb.connect()
    for table in ("papers", "blocks", "works", "inspire_record", "bib_entries", "documents", "events", "embeddings"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    rows = con.sql(catalog.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(rows.columns)
    order = [rows.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in found.collect()) == sorted(repr([r[i] for i in order]) for r in rows.fetchall())


def test_a_heading_reaches_to_its_equal(spark):
    ends = {r.anchor: r.span_end for r in A.spans(chapter(spark)).collect() if r.kind == "heading"}
    assert ends == {"sec-a": 5, "sec-b": 5, "sec-c": 7}


def test_neighbours_step_over_blocks_without_an_anchor(spark):
    rows = {r.idx: r for r in A.neighbours(chapter(spark)).collect()}
    assert (rows[2].prev, rows[2].next, rows[2].parent) == ("sec-a", "sec-b", "sec-a")
    assert (rows[0].prev, rows[0].parent, rows[6].next) == (None, None, None)
    assert (rows[3].parent, rows[5].parent, rows[4].parent) == ("sec-a", None, "sec-b")


def test_scopes(spark):
    assert A.parse_scope("s/1#p1..#p3") == A.Scope("s", "1", "p1", "p3")
    assert A.parse_scope("disk") == A.Scope()
    for bad in ("", "a b", "s/1/2/3 x", "s..#e"):
        with pytest.raises(ValueError):
            A.parse_scope(bad)
    hull = A.resolve(chapter(spark), [A.parse_scope("s/1#p1"), A.parse_scope("s/1#p3")]).collect()
    assert [(r.start, r.end) for r in hull] == [(2, 7)]


def test_the_first_block_is_kept_over_the_cap(spark):
    rows = spark.createDataFrame([("s", i, w) for i, w in enumerate([500, 1, 1])], "slug string, idx int, words long")
    kept = A.capped(rows, ["slug"], [F.col("idx")], "words", 10, 100).filter("kept").collect()
    assert [r.idx for r in kept] == [0]


def test_a_phrase_is_found_over_breaks_and_quotes(spark):
    b = blocks(spark, ("s", "1", 0, "paragraph", "p1", None, None, None, "The “mean\nfree​ path” is long"), ("s", "1", 1, "code", "b2", None, None, None, "mean free path"))
    assert [r.idx for r in search.phrase_search(b, '"Mean  free path"').collect()] == [0]


def test_the_prefix_match_begins_at_four_letters_and_needs_no_nested_loop(spark):
    left, right = spark.createDataFrame([("neutrino",), ("abc",), ("abcd",)], "term string"), spark.createDataFrame([("neutrinos",), ("abcdef",), ("abc",)], "word string")
    found = search.prefix_matches(left, right)
    assert {tuple(r) for r in found.collect()} == {("neutrino", "neutrinos"), ("abcd", "abcdef"), ("abc", "abc")}
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_ngrams_stay_between_marks(spark):
    grams = one(spark, T.ngrams(F.lit("Cardiac risk factors: interface of diet and ST-elevation infarction")))
    assert "factors interface" not in grams and "st elevation infarction" in grams and "risk factors" in grams
    assert one(spark, T.ngrams(F.lit(None).cast("string"))) == [] == one(spark, T.ngrams(F.lit("")))


def test_a_longer_term_takes_the_shorter(spark):
    weighted = spark.createDataFrame([("acute infarction", 11), ("severe acute infarction", 10), ("old field", 10), ("old field theory", 2)], "term string, weight long")
    assert {r.term for r in terms.subsumed(weighted).collect()} == {"severe acute infarction", "old field", "old field theory"}


def test_a_plural_needs_its_singular(spark):
    weighted = spark.createDataFrame([("beam line", 5), ("beams line", 4), ("cross sections", 3)], "term string, weight long")
    assert {(r.key, r.label, r.weight) for r in terms.merged(weighted).collect()} == {("beam line", "beam line", 9), ("cross sections", "cross sections", 3)}


WORK = "work_id long, tag string, title string, authors array<string>, year int, journal string, journal_key string, doi string, arxiv_id string, inspire_id string, citation_count int, verified boolean, held_as string, cited_by array<struct<slug:string,key:string>>"


def works(spark, *rows):
    names = [f.split(" ")[0] for f in ("work_id long", "tag", "title", "authors", "year", "journal", "journal_key", "doi", "arxiv_id", "inspire_id", "citation_count", "verified", "held_as", "cited_by")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], WORK)


def test_the_strongest_key_decides(spark):
    store = works(spark, {"work_id": 1, "doi": "10.1/a"}, {"work_id": 2, "arxiv_id": "1234.56789"}, {"work_id": 3, "doi": "none", "arxiv_id": "n/a"})
    probe = works(spark, {"work_id": 7, "doi": "https://doi.example/10.1/A", "arxiv_id": "arXiv:1234.56789v2"}, {"work_id": 8, "doi": "none", "arxiv_id": "n/a"})
    assert [tuple(r) for r in W.priority_match(probe.withColumnRenamed("work_id", "k"), "k", store).collect()] == [(7, 1, 0)]


def test_an_upsert_adds_a_repeated_work_once(spark):
    store = works(spark, {"work_id": 1, "doi": "10.1/a", "title": "x"})
    new = works(spark, {"work_id": 5, "doi": "10.1/b"}, {"work_id": 6, "doi": "10.1/B"}, {"work_id": 7, "doi": "10.1/a"}, {"work_id": 8, "doi": "10.1/a", "title": "x", "year": 2000}, {"work_id": 9}).withColumnRenamed("work_id", "key")
    assert {r.key: r.action for r in W.upsert(store, new).collect()} == {5: "added", 6: "repeated", 7: "unchanged", 8: "updated", 9: "added"}


def test_unknown_counts_come_last(spark):
    store = works(spark, {"work_id": 1, "citation_count": None, "tag": "a"}, {"work_id": 2, "citation_count": 0, "tag": "b"}, {"work_id": 3, "citation_count": 9, "tag": "c"}, {"work_id": 4, "citation_count": 9, "tag": "b"})
    assert [r.work_id for r in W.most_cited(store).orderBy("position").collect()] == [4, 3, 2, 1]


def test_overlap_bands(spark):
    edges = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(17, 37)] + [("c", 0), ("c", 1)], "slug string, work_id long")
    rows = {r.slug: r for r in overlap.scores(edges, spark.createDataFrame([("a",)], "slug string")).collect()}
    assert (rows["b"].shared, rows["b"].band, rows["c"].band) == (3, "high", None)
    assert "a" not in rows


def test_markers_fail_for_their_first_reason(spark):
    b, p = chapter(spark), spark.createDataFrame([("s",)], "slug string")
    marks = audit.report_markers(spark.createDataFrame([("r", "(lit:s/1#p1) (lit:s/1#p9) (lit:s/2) (lit:t) (lit:ref/x) (lit:s)")], "report string, text string"))
    found = {r.target: r.reason for r in audit.check_markers(marks, b, p, works(spark, {"work_id": 1, "tag": "y"})).collect()}
    assert found == {"s/1#p1": "", "s/1#p9": "no such anchor", "s/2": "no such chapter", "t": "no such paper", "ref/x": "no such record", "s": ""}


def test_a_marker_with_an_unknown_tag_stays(spark):
    b = blocks(spark, ("s", "1", 0, "paragraph", "p1", None, None, None, "x [cite: a, b] y [cite: a, z] end"))
    store = works(spark, {"work_id": 1, "tag": "a", "authors": ["Lipari, P."], "year": 2002}, {"work_id": 2, "tag": "b", "authors": ["Q", "R"]})
    assert render.substituted(b, store).first().rendered == "x (Lipari, 2002; Q et al., n.d.) y [cite: a, z] end"


def test_abbreviations_and_decimals_end_nothing(spark):
    assert one(spark, T.sentences(F.lit("See Phys. Rev. D 108. It is 1.03. Yes"))) == ["See Phys. Rev. D 108.", "It is 1.03.", "Yes"]


def test_years_in_identifiers_do_not_count(spark):
    assert one(spark, T.find_year(F.lit("10.1234/a.2001 arXiv 2003.01234 (1999) 12"))) == 1999
    assert one(spark, T.find_year(F.lit("nothing"))) is None


def test_tex_becomes_anchored_blocks():
    source = r"""\newcommand{\pair}[2]{#1 and #2}
\begin{document}\section{First}\label{sec:one}
A \emph{styled} \pair{x}{y} by M\"uller~\cite{k1,k2}. % gone

\begin{equation}\label{eq:e} a=b \end{equation}
\begin{verbatim}
code {x}
\end{verbatim}
\begin{figure}\includegraphics{f.png}\caption{A $x$ plot}\end{figure}
Short, see \ref{eq:e}.
\end{document}"""
    found = etl.tex_blocks(source)
    assert [b["kind"] for b in found] == ["heading", "paragraph", "math", "code", "figure", "paragraph"]
    assert found[0]["anchor"] == "sec-one" and found[2]["anchor"] == "eq-e" and found[2]["tex"] == "a=b"
    assert found[1]["text"] == "A styled x and y by Müller [cite: k1, k2]." and found[5]["text"] == "Short, see [ref: eq:e]."
    assert found[3]["text"] == "code {x}" and found[4]["file"] == "f.png"
    assert etl.tex_blocks(None) == [] == etl.tex_blocks("")


def test_entry_has_rows(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == catalog.queries()["phrase_search"](spark, data).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_alias_claim_of_a_unit_counts(spark):
    texts = spark.createDataFrame([("The model (flux tube) is old. A model, also called the string model (lund), and the model (flux tube).",), ("No claim.",)], "text string")
    got = {(r.alias, r.cue): r.claims for r in terms.aliases(texts, "model").collect()}
    assert got == {("flux tube", "()"): 2, ("string model", "also called"): 1, ("lund", "()"): 1}
