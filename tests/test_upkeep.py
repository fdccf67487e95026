import io
import itertools
import json
import random
import tarfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import address as A
from quarry.operators import bibliography as G
from quarry.operators import collection as K
from quarry.operators import render, report, search, terms
from quarry.operators import works as W
from quarry.sources import archives, files
from quarry.sources import collection as C
from quarry.sources import remote as R
from tests.test_core import blocks, chapter, one, works

UNIT = "slug string, kind string, chapter string, anchor string, rank int, idx long, n int, text string"


def units(spark, *texts):
    return spark.createDataFrame([("s", "body", "1", f"p{i}", 1, i, 0, t) for i, t in enumerate(texts)], UNIT)


# --- addresses


def test_a_heading_without_an_anchor_is_no_parent(spark):
    b = blocks(spark, ("s", "1", 0, "heading", "sec-a", 2, "1", "A"), ("s", "1", 1, "heading", "", 3, None, "no anchor"), ("s", "1", 2, "heading", None, 3, None, "null"), ("s", "1", 3, "paragraph", "p1", None, None, None, "x"))
    assert {r.idx: r.parent for r in A.neighbours(b).collect()} == {0: None, 1: "sec-a", 2: "sec-a", 3: "sec-a"}


def test_inner_numbers_start_again(spark):
    rows = [("s", "1", i, "heading", f"a{i}", level, None, "x") for i, level in enumerate([1, 2, 3, 3, 2, 3])] + [("s", "2", 0, "heading", "b", 2, None, "y")]
    assert {(r.stem, r.idx): r.dotted for r in A.heading_numbers(blocks(spark, *rows)).collect()} == {("1", 1): "1.1", ("1", 2): "1.1.1", ("1", 3): "1.1.2", ("1", 4): "1.2", ("1", 5): "1.2.1", ("2", 0): "2.1"}


def test_only_blocks_without_an_anchor_are_counted(spark):
    b = blocks(spark, ("s", "1", 0, "paragraph", "mine", None, None, None, "x" * 90), ("s", "1", 1, "paragraph", "", None, None, None, "x" * 90), ("s", "1", 2, "paragraph", None, None, None, None, "short"), ("s", "1", 3, "code", "", None, None, None, "c"), ("s", "1", 4, "paragraph", "", None, None, None, "y" * 80))
    assert [r.address for r in A.paragraph_anchors(b).orderBy("idx").collect()] == ["mine", "p1", "b1", "b2", "p2"]


def test_scopes_that_name_nothing_or_two_things_are_refused(spark):
    b = blocks(spark, *[("s", stem, 0, "paragraph", "p1", None, None, None, "x") for stem in "12"], ("s", "1", 1, "paragraph", "p9", None, None, None, "x"))
    asked = [A.parse_scope(t) for t in ("s/1#p1", "s#p1", "s#p9", "s/3", "t", "s#none")]
    assert {(r.scope, r.reason, r.candidates) for r in A.refused(b, asked).collect()} == {("s/#p1", "ambiguous anchor", "1,2"), ("s/3#", "no such chapter", ""), ("t/#", "no such paper", ""), ("s/#none", "no such anchor", "")}
    with pytest.raises(A.ScopeError):
        A.checked(b, asked)
    assert A.checked(b, asked[:1]).count() == 1 and "NestedLoop" not in A.resolve(b, asked)._jdf.queryExecution().toString()
    for bad in ("s/1", "t"):
        with pytest.raises(A.ScopeError):
            A.papers_in(b, [A.parse_scope(bad)])
    assert A.papers_in(b, [A.parse_scope("disk"), A.parse_scope("t")]).count() == 1


# --- text


def test_blanks_of_unicode_are_blanks(spark):
    assert one(spark, T.collapse(F.lit("a  　b \n c "))) == "a b c" and one(spark, T.word_count(F.lit("a b"))) == 2
    b = blocks(spark, ("s", "1", 0, "paragraph", "p1", None, None, None, "mean free　path"))
    assert search.phrase_search(b, "mean free path").count() == 1


def test_sentences_and_clauses(spark):
    text = "See cf. Fig. 3 of Phys. Rev. D; it is 1.03. Yes! The end"
    assert one(spark, T.sentences(F.lit(text))) == ["See cf. Fig. 3 of Phys. Rev. D; it is 1.03.", "Yes!", "The end"]
    assert one(spark, T.sentences(F.lit(text), True))[:2] == ["See cf. Fig. 3 of Phys. Rev. D;", "it is 1.03."]
    assert one(spark, T.sentences(F.lit(None).cast("string"))) == [] and one(spark, T.first_sentence(F.lit("A b. C"), 3)) == "A…"


def test_small_text_functions(spark):
    assert one(spark, T.find_arxiv(F.lit("see arXiv:2001.01234v2"))) == "2001.01234" and one(spark, T.find_arxiv(F.lit("old hep-ph/0101234"))) == "hep-ph/0101234" and one(spark, T.find_arxiv(F.lit("x"))) == ""
    assert one(spark, T.find_year(F.lit("pages (3001) 1999"))) is None and one(spark, T.find_year(F.lit("9999 and 2001"))) == 2001
    assert one(spark, T.volume_page(F.lit("physrevd,12,345"))) == "12,345" and one(spark, T.join_notes(F.lit("a"), F.lit(None).cast("string"))) == "a" and one(spark, T.join_notes(F.lit(None).cast("string"))) is None
    assert one(spark, T.report_name(F.lit("a/r.source.md"))) == "a/r.md" and one(spark, T.escape_cell_split(F.lit(r"| a \| b | c |"))) == [r"a \| b", "c"]
    assert one(spark, T.surname(F.lit("Brieva F.A."))) == "Brieva" and one(spark, T.surname(F.lit("P. Lipari"))) == "Lipari" and one(spark, T.surname(F.lit("Lipari, P."))) == "Lipari"
    assert one(spark, W.slugify(F.lit("Glück & Argüelles: a \\emph{note}"))) == "gluck_arguelles_a_note" and one(spark, W.slugify(F.lit(None).cast("string"))) == "section"
    assert one(spark, W.slugify(F.lit("one two three four five six seven eight nine ten"), 30, "x", True)) == "one_two_three_four_five_six"
    assert one(spark, T.safe_math(F.lit(r"a \alt b \label{x}\pmatrix{1 & 2} \alter \mbox{y}"))) == r"a \lesssim b \begin{pmatrix}1 & 2\end{pmatrix} \alter \text{y}"
    assert one(spark, T.safe_prose(F.lit(r"x $a \alt b$ y \alt z"))) == r"x $a \lesssim b$ y \alt z"


def test_tags_leave_out_what_says_nothing(spark):
    store = works(spark, {"work_id": 1, "title": "A new measurement of 12 axions using its flux", "authors": ["Müller, K."], "year": 2001}, {"work_id": 2, "journal": "Acta Hadr. 7"}, {"work_id": 3})
    assert [r[0] for r in store.orderBy("work_id").select(W.base_tag()).collect()] == ["muller_2001_axions_flux", "anon_nd_acta_hadr", "anon_nd"]


# --- search and terms


def test_a_match_comes_with_its_sentence(spark):
    long = "Start here. " + "word " * 100 + "the mean free path " + "tail " * 100 + "end. Mean free path again; mean free path."
    rows = search.phrase_search(blocks(spark, ("s", "1", 0, "paragraph", "p1", None, None, None, long)), "mean free path").orderBy("match").collect()
    assert [r.match for r in rows] == [0, 1, 2] and rows[1].sentence == rows[2].sentence == "Mean free path again; mean free path."
    assert len(rows[0].sentence) <= 300 and rows[0].sentence.startswith("…") and rows[0].sentence.endswith("…") and "mean free path" in rows[0].sentence


def test_a_match_over_two_sentences_keeps_both(spark):
    b = blocks(spark, ("s", "1", 0, "paragraph", "p1", None, None, None, "One. It ends here. Then more. Last"))
    assert search.phrase_search(b, "here. then").first().sentence == "It ends here. Then more."


def test_neighbours_of_hits_are_those_of_the_whole_chapter(spark):
    found = search.phrase_search(chapter(spark), "d e").first()
    assert (found.location, found.prev, found.next, found.parent) == ("s/1#p2", "sec-b", "sec-c", "sec-b")


def test_title_hits_find_what_all_pairs_find(spark):
    rng = random.Random(3)
    words = "measurement heavy axion decay matter dense flux lattice gauge boson mixing neutrino solar halo theory field screening vector kaon threshold".split()
    titles = [" ".join(rng.choices(words, k=rng.randint(4, 10))) for _ in range(120)]

    def slip(t):
        i = rng.randrange(len(t))
        return rng.choice([t, "The " + t, t[:i] + "x" + t[i + 1:], t[:i] + t[i + 1:], t + " II"])

    wanted = [(i, slip(t)) for i, t in enumerate(titles)]
    import difflib
    near = {i for i, w in wanted if any(difflib.SequenceMatcher(None, " ".join(w.lower().split()), t).ratio() >= 0.95 for t in titles)}
    got = search.title_hits(spark.createDataFrame(wanted, "key long, title string"), spark.createDataFrame(list(enumerate(titles)), "work_id long, title string"))
    assert len({r.key for r in got.collect()} & near) >= 0.98 * len(near)


def test_title_hits_are_those_of_all_pairs(spark):
    import difflib
    rng = random.Random(5)
    words = "measurement heavy axion decay of in the a to matter dense flux lattice gauge boson mixing neutrino solar halo theory field screening vector kaon 7".split()
    stored = sorted({" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(200)} | {"measurement axions lattice neutrino screening threshold polarization"})

    def slips(t):
        for _ in range(rng.randint(1, 7)):
            i = rng.randrange(len(t))
            t = rng.choice([t[:i] + t[i + 1:], t[:i] + "x" + t[i:], t[:i] + "y" + t[i + 1:], t[:i] + " " + t[i:]])
        return " ".join(t.split())

    asked = sorted({slips(t) for t in stored for _ in range(2)} - {""}) + stored[:20] + ["meesurement axions lattice neutrina screening threshold polarizatyon"]
    true = {}
    for k, t in enumerate(asked):
        found = [(difflib.SequenceMatcher(None, t, u).ratio(), -i) for i, u in enumerate(stored)]
        if max(found)[0] >= 0.95:
            true[k] = (-max(found)[1], max(found)[0])
    assert len(asked) - 1 in true and len(true) > 100
    got = search.title_hits(spark.createDataFrame(list(enumerate(asked)), "key long, title string"), spark.createDataFrame(list(enumerate(stored)), "work_id long, title string"))
    assert {r.key: (r.work_id, r.score) for r in got.collect()} == true


def test_titles_of_one_form_are_not_all_compared(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    forms = [f"unified description of {word(8)} fields {word(7)} screening and the response function" for _ in range(400)]
    asked, held = (spark.createDataFrame([(t,) for t in part], "t string") for part in ([t[:30] + "x" + t[31:] for t in forms], forms))
    assert 400 <= search._close_titles(asked, held, 0.95).count() < 800


def test_a_named_paper_is_scored(spark):
    store = works(spark, {"work_id": 1, "title": "Decay of the axion", "authors": ["Smith, J."], "year": 2001}, {"work_id": 2, "title": "Decay of the axion in dense stars", "authors": ["Poe, E."], "year": 1990}, {"work_id": 3, "title": "Other things", "authors": None, "year": None})
    got = {r.work_id: (round(r.score, 2), r.match) for r in search.named_paper(store, "Decay of the axion", "J. Smith", 2002).collect()}
    assert got[1] == (1.0, "exact") and got[2] == (1.0, "approximate") and got[3][1] == "none"
    assert {r.work_id: r.match for r in search.named_paper(store, author="Poe").collect()} == {1: "none", 2: "exact", 3: "none"}


def test_a_model_scores_and_coverage_stands_in(spark):
    docs = spark.createDataFrame([(1, "lattice calculation"), (2, "lattice calculation of matter"), (3, "nothing")], "key long, words string")
    model = lambda topic, texts: [None if "matter" in t else 7.0 for t in texts]
    assert [(r.key, r.ranked) for r in search.scored(docs, "lattice calculation", model).collect()] == [(1, True), (2, False)]
    assert [r.ranked for r in search.scored(docs, "lattice calculation").collect()] == [False, False]


def test_variants_merge_before_the_least_weight(spark):
    texts = units(spark, *["The heavy beam line."] * 3, *["Two heavy beams lines."] * 3)
    got = {r.term: (r.weight, r.shared, r.new) for r in terms.report(texts, spark.createDataFrame([], "title string"), ["beam"], least=6).collect()}
    assert got == {"heavy beam line": (6, "beam", "heavy line")}
    weighted = spark.createDataFrame([("process", 1), ("processes", 1), ("boxes", 1), ("box", 2)], "term string, weight long")
    assert {r.term: r.key for r in terms.keyed_terms(weighted).collect()} == {"process": "process", "processes": "process", "boxes": "box", "box": "box"}


def test_units_are_clauses(spark):
    papers = spark.createDataFrame([("s", "A title", "First. Second; third.")], "slug string, title string, abstract string")
    got = [(r.kind, r.text) for r in terms.units(chapter(spark), papers).orderBy(*terms.ORDER).collect()]
    assert got[:4] == [("heading", "A title"), ("abstract", "First."), ("abstract", "Second;"), ("abstract", "third.")]


def test_the_pivot_is_the_rarest_present_word(spark):
    texts = units(spark, "heart attack", "heart failure", "hearts")
    assert terms.pivot(texts, ["heart", "attack", "none"]).first().term == "attack" and terms.pivot(texts, ["zzz", "none"]).first().term == "zzz"


def test_aliases_are_stated_beside_the_pivot(spark):
    texts = units(spark, "A heart attack, also known as acute myocardial infarction, is fatal.", "An acute coronary (heart attack) event was seen.", "A heart attack (Smith 1999) happened to small mice.", "Nothing here or there.")
    weighted = terms.weights(texts)
    got = {r.term: r.cue for r in terms.stated_aliases(texts, weighted, "attack", ["heart", "attack"]).collect()}
    assert got["acute myocardial infarction"] == "also known as" and "myocardial infarction" not in got and "acute myocardial" not in got
    assert {c for t, c in got.items() if "coronary" in t} == {"()"} and not any("mice" in t for t in got)
    assert terms.stated_aliases(texts, weighted, "", []).count() == 0


# --- collection


def test_keys_become_tags_only_within_markers(spark):
    b = blocks(spark, ("s", "1", 0, "paragraph", "p1", None, None, None, "k1 [cite: k1, k2] and [cite: k9] k1 [cite: ]"), ("t", "1", 0, "paragraph", "p1", None, None, None, "[cite: k1]"), ("s", "1", 1, "paragraph", "", None, None, None, None))
    mapping = spark.createDataFrame([("s", "k1", ["a", "b"])], "slug string, key string, tags array<string>")
    assert [tuple(r) for r in K.rewritten_citations(b, mapping).collect()] == [("s", "1", 0, "k1 [cite: a, b, k2] and [cite: k9] k1 [cite: ]")]
    swapped = {(r.slug, r.rewritten) for r in K.tag_rewrites(b, spark.createDataFrame([("k1", "z")], "tag string, to string")).collect()}
    assert swapped == {("s", "k1 [cite: z, k2] and [cite: k9] k1 [cite: ]"), ("t", "[cite: z]")}


def test_links_are_made_only_where_all_is_known(spark):
    b = blocks(spark, ("s", "1", 0, "paragraph", "p1", None, None, None, "x [cite: a, b] [cite: a, z] [ref: eq] [ref: fig] [ref: no] end"))
    store = works(spark, {"work_id": 1, "tag": "a", "authors": ["Lipari, P."], "year": 2002}, {"work_id": 2, "tag": "b", "authors": ["Q", "R"]})
    papers = spark.createDataFrame([("s", {"eq": ("equation", "5", "eq-5", "c", "1"), "fig": ("figure", "2", "fig-2", "c", "2")})], "slug string, labels map<string,struct<kind:string,number:string,anchor:string,chapter:string,file:string>>")
    assert render.linked(b, store, papers).first().linked == "x ([Lipari, 2002](../../references/a.md); [Q et al., n.d.](../../references/b.md)) [cite: a, z] [5](#eq-5) [2](2.md#fig-2) [ref: no] end"


def test_addresses_stand_where_an_editor_looks_for_them(spark):
    b = chapter(spark)
    assert render.flavored_chapters(b, "vscode").first().markdown.startswith('<a id="sec-a"></a>\n\n## 1 Alpha\n\nno address here')
    assert "a b c ^p1" in render.flavored_chapters(b, "obsidian").first().markdown and "Alpha ^" not in render.flavored_chapters(b, "obsidian").first().markdown


def test_a_repeated_paper_keeps_its_row_but_for_the_journal(spark):
    kind = "slug string, title string, authors array<string>, submitted_year int, publication struct<journal:string>, abstract string"
    papers = spark.createDataFrame([("a", "Old | title", ["Q"], 2001, ("J. 1",), "About. More"), ("b", "New", ["Q", "R"], 1999, None, "First one. Two")], kind)
    index = spark.createDataFrame([("a", "| [Mine](a/INDEX.md) | Q | 2001 | — | my own words |", 1), ("z", "| [Z](z/INDEX.md) | Z | 2000 | — | z |", 2)], "slug string, row string, place long")
    got = {r.slug: (r.row, r.action, r.place) for r in K.upsert_index(index, papers).collect()}
    assert got["a"] == ("| [Mine](a/INDEX.md) | Q | 2001 | J. 1 | my own words |", "journal", 3) and got["z"][1:] == ("kept", 2)
    assert got["b"] == ("| [New](b/INDEX.md) | Q et al. | 1999 | — | First one. |", "added", 1)


def test_a_cited_paper_is_not_removed_unless_forced(spark):
    papers = spark.createDataFrame([("a", "10.1/a", None), ("b", None, None)], "slug string, doi string, arxiv_id string")
    store = works(spark, {"work_id": 1, "tag": "x", "doi": "10.1/A", "held_as": "a", "cited_by": [("b", "k")]}, {"work_id": 2, "tag": "y"})
    kept = K.removal(papers, store, "a")
    assert (kept["removed"], kept["cited_by"]) == (False, 1)
    gone = K.removal(papers, store, "a", force=True)
    assert gone["unheld"] == 1 and [r.slug for r in gone["papers"].collect()] == ["b"] and gone["works"].filter("held_as is not null").count() == 0
    with pytest.raises(ValueError):
        K.removal(papers, store, "none")


def test_small_upkeep(spark):
    assert {r.slug: r.held for r in K.known_papers(spark.createDataFrame([("a",)], "slug string"), spark.createDataFrame([("a", 1), ("b", 1), ("", 2)], "slug string, work_id long")).collect()} == {"a": True, "b": False}
    rows = spark.createDataFrame([("a", ["INSPIRE-HEP gave no record for x", "odd", "Placeholder residue in y"])], "slug string, warnings array<string>")
    assert {(r.code, r.detail) for r in K.warning_codes(rows).collect()} == {("INSPIRE_NO_RECORD", "INSPIRE-HEP gave no record for x"), ("OTHER", "odd")}
    assert {(r.stem, r.has_text) for r in K.chapters_with_text(blocks(spark, ("s", "1", 0, "heading", "a", 1, None, "T"), ("s", "2", 0, "paragraph", "b", None, None, None, "x"))).collect()} == {("1", False), ("2", True)}
    figures = spark.createDataFrame([("a", "x.eps"), ("b", "x.eps")], "slug string, file string")
    assert {tuple(r) for r in K.renamed_files(figures, spark.createDataFrame([("a", "x.eps", "x.png")], "slug string, old string, new string")).collect()} == {("a", "x.png"), ("b", "x.eps")}
    where = spark.createDataFrame([("p",), ("p/1",), ("pq/1",)], "w string")
    assert [r.w for r in where.filter(K.belongs_to("w", F.lit("p"))).collect()] == ["p", "p/1"]
    assert [one(spark, W.work_kind(F.lit(j), F.lit(None).cast("array<string>"))) for j in ("Phys. Rept. 5", "Acta 1", "")] == ["review", "article", "unknown"]


def test_a_lookup_names_what_is_missing(spark):
    store = works(spark, {"work_id": 1, "tag": "a", "doi": "https://doi.example/10.1/A", "cited_by": [("p", "k")]}, {"work_id": 2, "tag": "b", "arxiv_id": "arXiv:2001.01234v3", "title": "Odd"}, {"work_id": 3, "tag": "c"})
    assert {r.work_id for r in W.lookup(store, ["c"], "odd", ["doi: 10.1/a"], ["2001.01234v1"], ["p"]).collect()} == {1, 2, 3} and W.lookup(store).count() == 0
    assert {tuple(r) for r in W.missing(store, ["a", "q"], ["10.1/a", "10.2/b"], ["2001.01234"]).collect()} == {("tag", "q"), ("doi", "10.2/b")}


def test_the_cascade_takes_the_strongest_handle(spark):
    store = works(spark, {"work_id": 1, "journal_key": "actahadr,7,99", "title": "One"}, {"work_id": 2, "journal_key": "nuclx,8,11", "title": "Two"}, {"work_id": 3, "journal_key": "other,8,11", "title": "Three"})
    entries = works(spark, {"work_id": 10, "journal_key": "longname,7,99", "title": "Two"}, {"work_id": 11, "journal_key": "unknown,8,11", "title": "three"}, {"work_id": 12, "journal_key": "nuclx,8,11"}, {"work_id": 13, "journal_key": ",,"})
    assert {r.k: (r.work_id, r.match) for r in W.reference_cascade(entries.withColumnRenamed("work_id", "k"), "k", store).collect()} == {10: (1, "volume_page"), 11: (3, "title"), 12: (2, "journal")}


def test_a_merge_adds_improves_and_rewrites(spark):
    store = works(spark, {"work_id": 1, "tag": "a", "doi": "10.1/a", "title": "x", "cited_by": [("p", "k")]}, {"work_id": 2, "tag": "b", "doi": "10.1/b", "title": "kept", "year": 1990, "verified": True})
    new = works(spark, {"work_id": 5, "tag": "n5", "doi": "10.1/A", "title": "better", "year": 2001, "cited_by": None}, {"work_id": 6, "tag": "n6", "doi": "10.1/c"}, {"work_id": 7, "tag": "n7", "doi": "10.1/C", "title": "fuller"}, {"work_id": 8, "tag": "b", "doi": "10.1/b", "title": "worse"})
    incoming = new.withColumnRenamed("work_id", "key").withColumn("slug", F.lit("q")).withColumn("citing_key", F.col("key").cast("string"))
    merged, rewrites = W.merge_store(store, incoming)
    got = {r.work_id: r for r in merged.collect()}
    assert (got[1].title, got[1].year, got[1].tag, [tuple(e) for e in got[1].cited_by]) == ("better", 2001, "a", [("p", "k"), ("q", "5")])
    assert (got[2].title, got[2].year) == ("kept", 1990) and (got[3].title, got[3].tag, len(got[3].cited_by)) == ("fuller", "n7", 2) and len(got) == 3
    assert {tuple(r) for r in rewrites.collect()} == {("n5", "a")}


# --- bibliographies


def test_bib_and_bbl_become_records():
    text = r"""@article{k1, author = {Brieva, F. and Rook, J.}, title="{On} the \emph{optical} model", journal = {Nucl. Phys.}, volume=A291, pages={299--316}, year = 1977, eprint={hep-ph/9901234}}
@comment{junk}
\begin{thebibliography}{9}
\bibitem[Label]{k1} F.A. Brieva and J.R. Rook, Nucl. Phys. A291 (1977) 299.
\bibitem{k2} A. Smith, Phys. Rev. C 48 (1993) 1246; B. Jones and C. Poe, Phys. Lett. B429, 263 (1998).
\bibitem{k3} Private note; see also the erratum.
\end{thebibliography} tail"""
    rows = {(r["label"], r["part"]): r for r in G.records_of(text)}
    assert set(rows) == {("k1", 0), ("k2", 0), ("k2", 1), ("k3", 0)}
    first = rows["k1", 0]
    assert (first["title"], first["authors"], first["year"], first["journal_key"], first["arxiv_id"]) == ("On the optical model", ["Brieva, F.", "Rook, J."], 1977, "nuclphys,A291,299", "hep-ph/9901234")
    assert (rows["k2", 0]["authors"], rows["k2", 0]["year"], rows["k2", 0]["journal_key"]) == (["A. Smith"], 1993, "physrevc,48,1246") and rows["k2", 1]["journal_key"] == "physlettb,429,263"
    assert rows["k3", 0]["ordinal"] == 3 and G.records_of(None) == [] == G.records_of("") and "tail" not in rows["k3", 0]["raw"]
    assert [r["label"] for r in G.records_of(text, ["k2", "none"])] == ["k2", "k2"]


def test_tags_pass_over_taken_suffixes(spark):
    store = works(spark, {"work_id": 1, "tag": "poe_2001_axion", "doi": "10.1/a"}, {"work_id": 2, "tag": "poe_2001_axion_c", "doi": "10.1/b"})
    new = works(spark, *[{"work_id": 10 + i, "title": "Axion", "authors": ["Poe"], "year": 2001, "doi": f"10.1/z{i}"} for i in range(3)], {"work_id": 20, "doi": "10.1/B"}).withColumnRenamed("work_id", "k")
    assert {r.k: r.tag for r in G.assigned_tags(new, "k", store).collect()} == {10: "poe_2001_axion_b", 11: "poe_2001_axion_d", 12: "poe_2001_axion_e", 20: "poe_2001_axion_c"}


# --- reports


def test_a_report_is_rendered_and_audited(spark):
    b, p = chapter(spark), spark.createDataFrame([("s", "10.1/s", None)], "slug string, doi string, arxiv_id string")
    store = works(spark, {"work_id": 1, "tag": "held", "doi": "10.1/S", "verified": True}, {"work_id": 2, "tag": "loose", "verified": False}, {"work_id": 3, "tag": "sure", "verified": True})
    text = "See (lit:s/1#p1), (lit:ref/loose) and (lit:ref/sure).\n## References\n- (lit:ref/held)\n- (lit:ref/loose) ⚠ text\n- (lit:ref/sure)\n"
    reports = spark.createDataFrame([("good", text), ("bad", "Only (lit:t/1) and (lit:ref/loose) [cite: x]."), ("none", None)], "report string, text string")
    assert {tuple(r) for r in report.held_names(store, p).collect()} == {("held", "s")}
    got = {r.report: r for r in report.rendered(reports, b, p, store).collect()}
    assert got["good"].rendered.startswith("See (../s/chapters/1.md#p1), (../references/loose.md)") and got["good"].unresolved == 0 and got["none"].rendered == ""
    assert got["bad"].rendered == "Only (lit:t/1) and (../references/loose.md) [cite: x]." and got["bad"].unresolved == 1
    rows = {r.report: r for r in report.audited(reports, b, p, store).collect()}
    assert rows["good"].ok and rows["good"].citations == 3 and rows["none"].ok
    assert (rows["bad"].absent, rows["bad"].broken, rows["bad"].cite_markers, rows["bad"].cited_not_listed, rows["bad"].unflagged, rows["bad"].ok) == (1, 1, 1, 2, 1, False)


# --- sources


def test_archives_are_opened_and_inlined(spark, tmp_path):
    def archive(name, members, link=False):
        with tarfile.open(tmp_path / name, "w:gz") as out:
            for path, text in members.items():
                info = tarfile.TarInfo(path)
                data = text if isinstance(text, bytes) else text.encode()
                info.size = len(data)
                out.addfile(info, io.BytesIO(data))
            if link:
                info = tarfile.TarInfo("l")
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                out.addfile(info)

    archive("a.tar.gz", {"m.tex": b"\\documentclass{x}\\input{sec/one} caf\xe9", "sec/one.tex": "One \\input{two}", "sec/two.tex": "Two", "other.tex": "\\documentclass{y}", "r.bbl": "\\bibitem{k} x"})
    archive("b.tar.gz", {"m.tex": "x"}, link=True)
    (tmp_path / "c.gz").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.tex").write_text("plain")
    rows = {r.path.rsplit("/", 1)[1]: r for r in archives.read_archives(spark, str(tmp_path / "*")).collect()}
    assert rows["a.tar.gz"].main == "m.tex" and rows["a.tar.gz"].source == "\\documentclass{x}One Two café" and "bibitem" in rows["a.tar.gz"].bibliography
    assert "leaves" in rows["b.tar.gz"].error and "PDF" in rows["c.gz"].error and rows["d.tex"].source == "plain"
    held = {"a.tex": "\\input{a}"}
    assert archives.inlined("a.tex", held) == "\\input{a}"


def test_a_line_file_is_read_in_ranges(spark, tmp_path, monkeypatch):
    lines = [f"line {i} " + "ü" * (i % 7) for i in range(200)]
    path = tmp_path / ".hidden"
    path.write_text("\n".join(lines) + "\n")
    reader = files.LineReader(str(path))
    for split in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(files, "SPLIT", split)
        got = list(itertools.chain.from_iterable(reader.read(p) for p in reader.partitions()))
        assert [x for x, _ in got] == lines
    assert files.line_at(str(path), got[5][1]) == 6


def test_a_collection_round_trips(spark, data, tmp_path):
    root = str(tmp_path / "c")
    files.init_collection(root, "obsidian")
    assert files.flavor(root) == "obsidian"
    with pytest.raises(FileExistsError):
        files.init_collection(root)
    own = spark.read.parquet(f"{data}/blocks.parquet").dropDuplicates(["slug", "stem", "idx"])
    own = own.withColumn("idx", F.row_number().over(Window.partitionBy("slug", "stem").orderBy("idx")) - 1)
    n = C.write_block_lines(own, root)
    assert n == own.select("slug", "stem").distinct().count() and C.write_block_lines(own, root) == 0
    names = ["slug", "stem", "idx", "kind", "anchor", "level", "title"]
    assert {tuple(r) for r in C.read_blocks(spark, root).select(names).collect()} == {tuple(r) for r in own.select(names).collect()}
    papers = spark.read.parquet(f"{data}/papers.parquet").filter("slug is not null").dropDuplicates(["slug"])
    assert C.write_manifests(papers, root) == papers.count() == C.read_manifests(spark, root).count()
    slug = papers.agg(F.min("slug")).first()[0]
    assert C.read_paper(spark, root, slug).count() == 1 and C.stored_texts(spark, root).count() == n and C.raw_texts(spark, root).filter("nuls > 0").count() == 0
    with pytest.raises(FileNotFoundError):
        C.read_paper(spark, root, "nobody")
    store = spark.read.parquet(f"{data}/works.parquet").drop("work_id")
    assert C.write_store(store, root) == store.count() == C.read_store(spark, root).count()
    (tmp_path / "c" / "r.source.md").write_text("x")
    assert C.report_sources(spark, root).count() == 1


def test_answers_are_parsed(spark):
    rows = [("q", json.dumps({"hits": {"total": 9, "hits": [{"metadata": {"control_number": 5, "titles": [{"title": "T"}]}}]}})), ("r", json.dumps({"metadata": {"control_number": 6}})), ("bad", "<html>"), ("none", None)]
    got = {(r.request, r.total, r.metadata.control_number) for r in R.catalogue_hits(spark.createDataFrame(rows, "request string, body string")).collect()}
    assert got == {("q", 9, 5), ("r", 1, 6)}
    feed = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="x"><entry><id>http://x/abs/2001.00001v2</id><title>A\n b</title><published>2020-01-02T00:00:00Z</published><author><name>Q</name></author><author><name>R</name></author><arxiv:doi>10.1/a</arxiv:doi></entry></feed>'
    row = R.feed_entries(spark.createDataFrame([("q", feed), ("n", "<feed/>")], "request string, body string")).first()
    assert (row.arxiv_id, row.version, row.title, row.authors, row.year, row.doi) == ("2001.00001", "v2", "A b", ["Q", "R"], 2020, "10.1/a")
    work = {"message": {"DOI": "10.1/A", "title": ["T"], "author": [{"given": "J.", "family": "Q"}], "container-title": ["J. Odd"], "volume": "3", "page": "4-9", "issued": {"date-parts": [[2001, 2]]}}}
    row = R.registry_works(spark.createDataFrame([("q", json.dumps(work)), ("n", "{}")], "request string, body string")).first()
    assert (row.title, row.authors, row.year, row.journal, row.doi) == ("T", ["Q, J."], 2001, "J. Odd 3 (2001) 4", "10.1/a")


def test_requests_come_in_batches(spark):
    keys = spark.createDataFrame([(i % 700,) for i in range(1000)], "recid long")
    asked = [r.request for r in R.batched(keys, "recid", 40, lambda ks: F.concat(F.lit("recid "), F.array_join(ks, " or recid "))).collect()]
    found = [x for r in asked for x in r.removeprefix("recid ").split(" or recid ")]
    assert sorted(map(int, found)) == list(range(700)) and max(r.count(" or ") for r in asked) < 40


def test_queries_for_a_named_paper():
    assert R.title_query("A  title", "Poe", 2001) == 'ti:"A title" AND au:"Poe" AND submittedDate:[200001010000 TO 200112312359]'
    assert R.fallback_query("", "x") is None and R.loose_query("of the", "x") is None and R.fallback_query("Heavy axion", "") == "ti:Heavy AND ti:axion"
    assert R.filters(["hep-ph", "nucl-th"], "2020-01-02") == " AND (cat:hep-ph OR cat:nucl-th) AND submittedDate:[202001020000 TO 999912312359]" and R.filters() == ""


def test_processes_share_a_gate(tmp_path):
    now, slept = [100.0], []
    make = lambda: R.SharedGate(str(tmp_path), clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    make().wait("catalogue")
    assert make().wait("catalogue") == pytest.approx(0.5)
    (tmp_path / ".gate.json").write_text("damaged")
    assert make().wait("catalogue") == 0
    gate = R.SharedGate(str(tmp_path / "none"), clock=lambda: now[0], sleep=slept.append)
    gate.wait("catalogue")
    assert gate.local_only
