import itertools
import random
import unicodedata
from collections import Counter

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import entity_match, groups, markup, mixing, name_variants, packing, queries, set_join, term_counts, tokens
from quarry.llm import names as N
from quarry.llm import sentences as S
from quarry.llm.canonical_text import canonical, canonical_values

# --- 1. term counts


def test_terms_agree_with_brute_force(spark):
    rng = random.Random(1)
    words = ["the", "Axion", "über", "x1y", "ab", "мюон", "no-go", "粒子物理"]
    rows = [("s", "t", i % 40, " ".join(rng.choices(words, k=rng.randint(0, 9))) if i % 7 else None, rng.choice([None, "", "Axion field"]), "extra") for i in range(40)]
    rows += rows[:5] + [("s", "t", 99, "the " * 5000, None, "long"), (None, None, None, "nullkey term", None, "x")]
    df = spark.createDataFrame(rows, "slug string, stem string, idx int, text string, title string, term string")
    places, records, unique = Counter(), Counter(), {r[:3]: r for r in rows}
    for r in unique.values():
        found = [t for v in r[3:5] if v for t in regex.findall(r"\p{L}{3,}", v.lower())]
        places.update(found)
        records.update(set(found))
    n = sum(bool(r[3] or r[4]) for r in unique.values())
    mark = {t: "rare" if c < 3 else "common" if 10 * c > n else "keep" for t, c in records.items()}
    got = {r.term: (r.places, r.records, r.mark) for r in term_counts.term_counts(df, ["slug", "stem", "idx"], ["text", "title"]).collect()}
    assert got == {t: (places[t], records[t], mark[t]) for t in places}
    assert sorted(r.term_id for r in term_counts.term_counts(df, ["slug", "stem", "idx"], ["text", "title"]).collect()) == list(range(len(places)))


def test_terms_of_an_empty_table(spark):
    assert term_counts.term_counts(spark.createDataFrame([], "k int, text string"), ["k"], ["text"]).count() == 0


# --- 2. canonical text


@pytest.mark.parametrize("value, wanted", [
    ("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"), ("José", "José"), ("a​b­c", "abc"), ("a b", "a b"), ("ﬁeld", "field"), ("résοlutiοn", "résolution"), ("Мoдель", "Модель"),
    ("Steрrestomаrd, E.", "Steprestomard, E."), ("of а boson", "of a boson"), ("µ and τ", "μ and τ"), ("μ and τ", None), ("10² decades", None), ("Модель распада (lobramion)", None), ("Łucja Döbrumerul", None),
    ("double  blank", None), ("νN scattering", None), ("ΔE", None), ("", None), (None, None),
])
def test_the_consistent_form(value, wanted):
    assert canonical(value) == (value if wanted is None else wanted)


def test_every_character_has_one_form():
    for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))):
        once = canonical(c)
        assert canonical(once) == once == canonical(unicodedata.normalize("NFC", c)) == canonical(unicodedata.normalize("NFD", c)), hex(ord(c))


def test_kinds_of_hyphens_and_composed_marks_meet():
    assert canonical("a\u2011b") == canonical("a\u2010b") == "a-b" and canonical("\u03d4") == canonical("\u03d2\u0308") == "\u03ab"


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeopcеорс\u200b\u0301\u0308\u2011\u00a0ο\u03d4ﬁＡ"), st.characters(exclude_categories=["Cs"])), max_size=20))
def test_the_form_is_stable_and_composed(text):
    once = canonical(text)
    assert canonical(once) == once
    assert canonical(unicodedata.normalize("NFC", text)) == canonical(unicodedata.normalize("NFD", text))
    assert canonical("plain " + "x" * 1000) == "plain " + "x" * 1000


def test_values_keep_rows_and_columns(spark):
    rows = [(1, "a b", "c"), (1, "a b", "c"), (2, None, None), (3, "", "z"), (4, "plain", "q")]
    got = canonical_values(spark.createDataFrame(rows, "id int, value string, canonical string")).collect()
    assert sorted((r.id, r.canonical or "") for r in got) == [(1, "a b"), (1, "a b"), (2, ""), (3, ""), (4, "plain")]
    assert canonical_values(spark.createDataFrame([], "value string")).count() == 0


# --- 3. set join


def jaccard_pairs(sets, least, percent):
    clean = {k: {t for t in v if t} for k, v in sets.items() if v is not None}
    clean = {k: v for k, v in clean.items() if len(v) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(clean), 2) if 100 * len(clean[a] & clean[b]) >= percent * len(clean[a] | clean[b])}


def test_pairs_agree_with_brute_force(spark):
    rng = random.Random(2)
    base = [[f"t{rng.randint(0, 60)}" for _ in range(rng.choice([5, 6, 8, 9, 14, 30]))] + ["hot"] for _ in range(25)]
    sets = {}
    for i in range(250):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = f"t{rng.randint(0, 60)}"
        sets[i] = s + ["", None, s[0]]
    sets |= {900: None, 901: [], 902: ["a"]}
    df = spark.createDataFrame([(k, v, "x") for k, v in sets.items()], "id long, tags array<string>, rep string")
    got = {(r.key_a, r.key_b) for r in set_join.similar_pairs(df, "id", "tags").collect()}
    wanted = jaccard_pairs(sets, 5, 60)
    assert got == wanted and len(wanted) > 100
    links = {r.key: r for r in set_join.similar_links(df, "id", "tags").collect()}
    copies = {k: frozenset(t for t in v if t) for k, v in sets.items() if v and len({t for t in v if t}) >= 5}
    for k, r in links.items():
        others = {b if a == k else a for a, b in wanted if k in (a, b)}
        assert r.links == sum(copies[o] != copies[k] for o in others) and r.copies == sum(copies[o] == copies[k] for o in copies)


def test_pairs_of_an_empty_table(spark):
    assert set_join.similar_pairs(spark.createDataFrame([], "id long, tags array<string>"), "id", "tags").count() == 0


# --- 4. matching


def records(spark, rows):
    return spark.createDataFrame(rows, "key long, scope string, title string, authors array<string>, year int, journal string, score double")


def test_records_match_across_noise(spark):
    right = records(spark, [
        (1, None, "Scalar attenuation of hyperons in dense matter", ["Nemonarsen, D."], 1984, "Acta Hadr. 12 (1984) 345", 0.0), (2, None, "Scalar attenuation of hyperons in dense matter. II", ["Nemonarsen, D."], 1985, None, 0.0),
        (3, None, "Vector screening of kaons near the threshold", ["Everin, S.", "Trobuk, A."], 2001, "Eur.Phys.Notes 7 (2001) 99", 0.0), (4, None, None, None, None, None, 0.0), (5, None, "", [], None, "", 0.0),
    ])
    left = records(spark, [
        (10, "p", "scalar atenuation of hyperons in dense matter", ["D. Nemonarsen"], 1984, None, 1.0), (11, "p", "Scalar attenuation of hyperons in dense matter. II", ["D. Nemonarsen"], 1985, None, 1.0),
        (12, "p", None, ["S. Everin"], 2001, "Eur. Phys. Notes 7, 99", 1.0), (13, "q", "Vector screening of kaons near the thresh...", ["Everin, S.", "others"], 2001, None, 1.0), (14, None, None, None, None, None, 1.0),
        (15, None, "Something else altogether about bosons", ["Everin, S."], 2001, None, 1.0),
    ])
    got = {r.left_key: r.right_key for r in entity_match.match_records(left, right).collect()}
    assert got == {10: 1, 11: 2, 12: 3, 13: 3}
    assert entity_match.match_records(left.limit(0), right).count() == 0


def test_slips_at_both_ends_of_a_title_match(spark):
    title = "Measurement of the inelastic form factor of heavy axions in dense matter"
    left = records(spark, [
        (1, "a", "Measurment of the inelastic form factor of heavy axions in dense mater", None, 2001, None, 0.0),
        (2, "b", "Measurment of the inelastic form factor of heavy ...", None, 2001, None, 0.0),
        (3, "c", "Measurment of the inelastic form factor of heavy axions in dense mater", ["Steprestomart, E."], 2001, None, 0.0),
    ])
    right = records(spark, [(10, None, title, ["Steprestomard, E."], 2001, "Phys. Rev. D 12 (2001) 345", 0.0)])
    assert {(r.left_key, r.right_key) for r in entity_match.match_records(left, right).collect()} == {(1, 10), (2, 10), (3, 10)}


def test_a_hot_work_meets_all_of_its_entries(spark):
    title, place = "Scalar attenuation of hyperons in dense matter", "Acta Hadr. 12 (1984) 345"
    same = [(i, f"p{i}", title, ["Nemonarsen, D."], 1984, place, 0.0) for i in range(60)]
    forms = [(100 + i, f"p{100 + i}", title, ["Nemonarsen, D.", f"{'bcdfghklmn'[i % 10]}{'aeiou'[i // 10]}rkelsen, A."], 1984, place, 0.0) for i in range(40)]
    pair = [(200, "q", title, ["Nemonarsen, D."], 1984, place, 0.0), (201, "q", title, ["Nemonarsen, D."], 1984, place, 0.0)]
    right = records(spark, [(k, None, title, ["Nemonarsen, D."], 1984, place, 0.0) for k in (5, 7, 9)])
    got = {r.left_key: r.right_key for r in entity_match.match_records(records(spark, same + forms + pair), right).collect()}
    assert {k: v for k, v in got.items() if k < 200} == {r[0]: 5 for r in same + forms}
    assert {got[200], got[201]} == {5, 7}


def test_the_assignment_is_the_best(spark):
    rng = random.Random(3)
    for _ in range(60):
        edges = [(l, 100 + r, round(rng.random(), 3)) for l in range(4) for r in range(4) if rng.random() < 0.7]
        weight = {(l, r): c for l, r, c in edges}
        best = max(sum(weight[l, r] for l, r in zip(range(4), p) if r is not None and (l, r) in weight) for p in itertools.permutations([100, 101, 102, 103])) if edges else 0
        found = entity_match._assign(edges)
        assert abs(sum(c for *_, c in found) - best) < 1e-9
        assert len({l for l, *_ in found}) == len({r for _, r, _ in found}) == len(found)


@pytest.mark.parametrize("n", [12, 13, 40, 10_000])
def test_equal_entries_of_many_papers_all_mean_the_one_work(spark, n):
    schema = "key long, scope string, title string, authors array<string>, year int, journal string"
    row = ("Decay of the axion in dense matter", ["Smith, J.", "Lee, K."], 2011, "Acta Hadr. B 12 (2011) 345")
    left = spark.createDataFrame([(i, f"paper {i}", *row) for i in range(n)], schema)
    right = spark.createDataFrame([(7, None, *row), (8, None, "Another matter altogether", ["Poe, E."], 2001, None)], schema)
    got = entity_match.match_records(left, right).collect()
    assert {(r.left_key, r.right_key) for r in got} == {(i, 7) for i in range(n)}


def test_candidates_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(4)
    words = "axion decay dense matter quark gluon lattice field gauge boson neutrino mass mixing solar flux dark halo".split()
    schema = "key long, scope string, title string, authors array<string>, year int, journal string"

    def record(key, scope):
        return key, scope, " ".join(rng.sample(words, 6)), [f"{rng.choice('ABCDEF')}ranton, J."], 2000 + rng.randint(0, 5), None

    many = [record(i, None) for i in range(1500)]
    few = [(9000 + i, "p", *many[100 * i][2:]) for i in range(15)]
    left, right = spark.createDataFrame(few, schema), spark.createDataFrame(many, schema)
    found = []
    for block in (48, 4_096):
        monkeypatch.setattr(entity_match, "BLOCK", block)
        found.append({tuple(r) for r in entity_match.candidates(left, right).collect()})
    assert found[0] == found[1] and len({x[0] for x in found[0]}) == 15


def test_large_runs_of_one_key_ask_for_more(spark, monkeypatch):
    schema = "key long, scope string, title string, authors array<string>, year int, journal string"
    monkeypatch.setattr(entity_match, "RUN_PAIRS", 10)
    rng = random.Random(6)
    names = ["".join(rng.choices("abcdefghiklmnoprstuvz", k=9)) for _ in range(120)]
    right = spark.createDataFrame([(i, None, "Introduction", [f"{n.capitalize()}, J."], 2000, None) for i, n in enumerate(names)], schema)
    left = spark.createDataFrame([(1000 + i, f"p{i}", "Introduction", [f"{n.capitalize()}, J."], 2000, None) for i, n in enumerate(names)], schema)
    assert {(r.left_key - 1000, r.right_key) for r in entity_match.match_records(left, right).collect()} >= {(i, i) for i in range(120)}


def test_large_runs_of_one_key_lose_no_pair(spark, monkeypatch):
    schema = "key long, scope string, title string, authors array<string>, year int, journal string"
    rng = random.Random(8)
    surnames = ["Steprestomart", "Steprestomard", "Stepres", "Ste", "Everinsk", "Evreinsk", "Everins", "Eve", "Lindber", "Lundberg", "Lindberg"]

    def record(key):
        journal = rng.choice([None, "Acta Hadr. 12 (1984) 345", "Acta Hadr. 13 (1984) 1", "Eur. Phys. Notes 7, 99"])
        return key, f"p{key}", rng.choice(["Introduction to the theory of hadrons", "Introduction"]), [f"{n}, J." for n in rng.sample(surnames, rng.choice([0, 1, 1, 2]))] or None, rng.choice([None, *range(1980, 1992)]), journal

    left, right = (spark.createDataFrame([record(start + i) for i in range(400)], schema) for start in (1000, 5000))
    monkeypatch.setattr(entity_match, "WINDOW", 1)
    found = []
    for pairs in (10**9, 10):
        monkeypatch.setattr(entity_match, "RUN_PAIRS", pairs)
        found.append({tuple(r) for r in entity_match.candidates(left, right).collect()})
    assert found[0] == found[1] and len(found[0]) > 1000


def test_records_without_common_ends_have_no_alike_names():
    rng = random.Random(9)
    for _ in range(20_000):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))
        q = list(p)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(q) + 1)
            q[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        q = "".join(q)
        if entity_match._alike(p, q):
            assert not entity_match._ends([p]).isdisjoint(entity_match._ends([q]))


# --- 5. names


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_the_edit_distance_is_a_metric(a, b, c):
    d = N.edit_distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)
    assert N.within_one(a, b) == (d(a, b) <= 1)


def test_close_surnames_agree_with_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("bdgklmnrstv", k=1) + rng.choices("aeiou", k=1)) * 3 + rng.choice(["ov", "sen", "art"]) for _ in range(60)]
    names = set(base)
    for b in base:
        i = rng.randrange(len(b) - 1)
        names |= {b[:i] + b[i + 1:], b[:i] + b[i + 1] + b[i] + b[i + 2:], b[:i] + "x" + b[i:]}
    df = spark.createDataFrame([(n,) for n in names], "surname string")
    got = {(r.a, r.b): r.edits for r in name_variants.close_surnames(df).collect()}
    assert got == {(a, b): d for a, b in itertools.combinations(sorted(names), 2) if (d := N.levenshtein(a, b)) <= 2}
    assert got.keys() >= {(a, b) for a, b in itertools.combinations(sorted(names), 2) if N.edit_distance(a, b) <= 1}


def test_names_of_any_length_and_script_meet(spark):
    names = ["x" * 70, "x" * 71, "x" * 60 + "y" * 9, "ю" * 5, "ю" * 6, "", "a", "ab", "abc", "長谷川", "長谷", "🙂🙂🙂", "🙂🙂"]
    got = {(r.a, r.b) for r in name_variants.close_surnames(spark.createDataFrame([(n,) for n in names + names], "surname string")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(n for n in names if n), 2) if N.levenshtein(a, b) <= 2}
    assert name_variants.close_surnames(spark.createDataFrame([], "surname string")).count() == 0


def _distinct_names(n):
    rng = random.Random(8)
    return sorted({"".join(rng.choice(["bra", "ko", "lin", "du", "ste", "mor", "va", "gi"]) for _ in range(rng.randint(2, 6))) for _ in range(n)})


def test_pivots_part_the_names(spark, monkeypatch):
    monkeypatch.setattr(name_variants, "CELL", 60)
    names = _distinct_names(1500)
    placed = name_variants.cells(spark.createDataFrame([(n,) for n in names], "surname string")).groupBy("cell").agg(F.count_if("home").alias("home"), F.count("*").alias("all")).collect()
    assert sum(r.home for r in placed) == len(names)
    # Without pivots there is one cell and every name is compared with every name.
    assert len(placed) > 5 and sum(r.home * r.all for r in placed) < 0.6 * len(names) ** 2
    got = {(r.a, r.b) for r in name_variants.close_surnames(spark.createDataFrame([(n,) for n in names], "surname string")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(names, 2) if abs(len(a) - len(b)) <= 2 and N.levenshtein(a, b) <= 2}


def test_a_slip_of_a_hot_surname_is_linked_at_any_size(spark):
    given = [f"{a}{b}{c}o" for a in "bcdfgklm" for b in "aeiou" for c in "klmnrstv"]
    rows = [(f"Strobanik, {g.capitalize()}",) for g in given] + [(f"Strobanic, {g.capitalize()}",) for g in given[::40]]
    got = {(r.name_a, r.name_b) for r in name_variants.name_pairs(spark.createDataFrame(rows, "name string")).collect()}
    assert {(f"Strobanic, {g.capitalize()}", f"Strobanik, {g.capitalize()}") for g in given[::40]} <= got


def test_variants_of_one_person_are_linked(spark):
    people = [["Stebruhalune, Elizabeth", "Dr. Elizabeth Stebruhalune", "Stebruhalune, E.", "Liz Stebruhalune", "Steburhalune, Elizabeth", "Stebruhalune, Elizabeth", "ＳＴＥＢＲＵＨＡＬＵＮＥ， Elizabeth"], ["Stebruhalune, Gabriela", "G. Stebruhalune"], ["TAKAPUREZ Collaboration", "The Takapurez Collab."]]
    rows = [(n, "x") for p in people for n in p] * 2 + [("et al.", "x"), ("", "x"), (None, None), ("u. a.", "x")]
    got = {(r.name_a, r.name_b) for r in name_variants.name_pairs(spark.createDataFrame(rows, "name string, person string")).collect()}
    assert got == {pair for p in people for pair in itertools.combinations(sorted(p), 2)}
    assert name_variants.name_pairs(spark.createDataFrame([], "name string")).count() == 0


# --- 6. markup


@pytest.mark.parametrize("text, kinds", [
    ("a <b>bold</b> word", ["html"]), ("x &amp; y", ["html"]), ("&lt;i&gt;x&lt;/i&gt;", ["html"]), ("# Head\n\n- a\n- b", ["markdown"]), ("a **b** c", ["markdown"]), ("see [x](y.md)", ["markdown"]), ("''x'' is", ["wiki"]), ("[[a|b]] c", ["wiki"]),
    ("== H ==\n* a", ["wiki"]), (r"a \emph{b}", ["latex"]), ("$q^{2}$", ["latex"]), ("{{term|x}} and $\\pi$", ["latex", "wiki"]), ("the N* state and B* too", []), ("x < 0.2 and c > 7", []), ("mean <E> stays", []), ("costs $40 or $50", []),
    ("key_one_b, not key_two_b", []), ("a*b and c*d", []), ("run #18", []), ("[Not included.] note {8}", []), ("R&D scale", []), ("", []), (None, []),
])
def test_markup_is_told_from_ordinary_signs(text, kinds):
    assert markup.parse(text)[1] == kinds


def test_structure_and_template(spark):
    page = "<html><body><h1>T{0}</h1><p>Text {0} differs.</p><ul><li>one {0}</li></ul><pre>x = {0}</pre><p>Copyright group</p></body></html>"
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [(i, "h", page.format(w), "old", None) for i, w in enumerate(words)] + [(90, "h", None, "", None), (91, None, "plain", "", None), (92, "h", "", "", None), (93, "h", "<p>" + "long " * 20000 + "</p>", "", None)]
    got = {r.key: r for r in markup.clean_markup(spark.createDataFrame(rows, "key int, host string, value string, clean string, template string")).collect()}
    assert [tuple(b) for b in got[0].blocks] == [("heading", "Talpha"), ("paragraph", "Text alpha differs."), ("item", "one alpha"), ("code", "x = alpha")]
    assert got[0].kinds == ["html"] and "Copyright" not in got[3].clean and got[91].clean == "plain" and got[90].clean is None and got[92].kinds == []
    assert len(got[93].clean) > 90_000
    assert markup.clean_markup(spark.createDataFrame([], "key int, host string, value string")).count() == 0


def test_tree_matching_keeps_order():
    def tree(*labels):
        return markup.Node("r", children=[markup.Node(x) for x in labels])

    assert markup.align(tree("a", "b", "c"), tree("a", "c"))[0] == 3 and markup.align(tree("a", "b"), tree("b", "a"))[0] == 2


def test_only_what_is_equal_letter_by_letter_is_template(spark):
    page = "<html><body><p>Measured value was {0} units in run {1}.</p><p>{2}</p><p>All rights reserved</p></body></html>"
    rows = [(i, "h", page.format(i, 7 * i, "word " * 60 + f"last words {i}")) for i in range(8)]
    got = {r.key: r for r in markup.clean_markup(spark.createDataFrame(rows, "key int, host string, value string")).collect()}
    for i in range(8):
        assert f"Measured value was {i} units in run {7 * i}." in got[i].clean and f"last words {i}" in got[i].clean and "rights" not in got[i].clean
    assert len(got) == 8


def test_a_constant_in_the_middle_and_of_late_pages_is_found(spark):
    start = "".join(f"<p>filler {n} of the first page</p>" for n in range(300))
    rows = [(0, "h", start)] + [(i, "h", f"<p>a {i}</p><p>b {i}</p><p>Follow the group</p><p>c {i}</p><p>d {i}</p>") for i in range(1, 60)]
    got = {r.key: r for r in markup.clean_markup(spark.createDataFrame(rows, "key int, host string, value string").repartition(1)).collect()}
    assert not any("Follow" in r.clean for r in got.values()) and all(f"c {i}" in got[i].clean for i in range(1, 60)) and got[0].clean.count("filler") == 300


def test_a_constant_is_a_share_of_all_pages_of_its_host(spark):
    rows = [(i, "h", f"<p>shared note</p><p>own {i}</p>" if i % 2 else f"<p>own {i}</p>") for i in range(40)]
    got = markup.clean_markup(spark.createDataFrame(rows, "key int, host string, value string")).collect()
    assert sum("shared note" in r.clean for r in got) == 20


def test_templates_join_alike_with_and_without_broadcast(spark, monkeypatch):
    rows = [(i, f"h{i % 3}", f"<p>own {i}</p><p>foot {i % 3}</p>") for i in range(60)]
    df = spark.createDataFrame(rows, "key int, host string, value string")
    small = {(r.key, r.clean) for r in markup.clean_markup(df).collect()}
    monkeypatch.setattr(markup, "BROADCAST_BYTES", 0)
    assert {(r.key, r.clean) for r in markup.clean_markup(df).collect()} == small == {(i, f"own {i}") for i in range(60)}


def test_a_template_has_room_for_every_constant(spark):
    nav = [f"<div><p>entry {n}</p></div>" if n % 3 else f"<p>entry {n}</p>" for n in range(400)]
    rows = [(i, "h", "".join(x for n, x in enumerate(nav) if (n + i) % 10) + f"<p>own {i}</p>" + "<p>note</p>" * (i % 3)) for i in range(20)]
    many = [(100 + i, f"h{i // 5}", f"<p>foot {i // 5}</p><p>own {i}</p>") for i in range(60)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows + many, "key int, host string, value string").repartition(parts)
        got = {r.key: r.clean.split("\n") for r in markup.clean_markup(df).collect()}
        assert got == {i: [f"own {i}"] + ["note"] * (i % 3) for i in range(20)} | {100 + i: [f"own {i}"] for i in range(60)}


def test_a_mapping_pairs_as_much_as_can_be():
    rng = random.Random(5)

    def tree(depth):
        node = markup.Node(rng.choice("ab"), mark=rng.choice([b"", b"x"]))
        node.children = [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
        return node

    def size(node):
        return 1 + sum(map(size, node.children))

    def most(a, b):  # every cut of both lists, without a shortcut
        if (a.label, a.mark) != (b.label, b.mark):
            return 0
        best = {}
        for i in range(len(a.children) + 1):
            for j in range(len(b.children) + 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + most(a.children[i - 1], b.children[j - 1])) if i and j else 0
        return 1 + best[len(a.children), len(b.children)]

    for _ in range(200):
        a, b = tree(3), tree(3)
        b.label, b.mark = a.label, a.mark
        found, pairs = markup.align(a, b)
        assert found == len(pairs) == most(a, b)
        whole = markup.merge(markup._unpack(markup._pack(a)), markup._unpack(markup._pack(b)))
        assert markup.align(whole, a)[0] == size(a) and markup.align(whole, b)[0] == size(b)


def test_long_constructs_are_markup_too():
    assert markup.parse("$$" + "x + " * 900 + "y^2$$")[1] == ["latex"] and markup.parse("see [" + "word " * 100 + "](y.md)")[1] == ["markdown"]
    assert markup.parse("a {{note|" + "word " * 100 + "{{inner|x}} end}} b")[1] == ["wiki"]
    tree = markup.parse("a {{note|b {{inner|x}} c}} d")[0]
    assert markup.blocks_of(tree) == [("paragraph", "a b x c d")]


# --- 7. groups


@pytest.mark.parametrize("bound", [3, 50, 2_000_000])
def test_components_agree_with_brute_force(spark, bound):
    rng = random.Random(bound)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(7, i) for i in range(200, 240)] + [(5, 5), (None, 3), (3, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame([(a, b, "x") for a, b in edges * 2], "a long, b long, node string").repartition(6)
    assert {(r.node, r.group_id) for r in groups.components(df, bound).collect()} == {(x, root(x)) for x in parent}


def test_identifiers_tie_however_written(spark):
    rows = [(1, "10.99101/A.1", None, None), (2, " https://doi.example/10.99101/a.1; ", "arXiv:1234.56789v2", None), (3, None, "https://eprint.example/abs/1234.56789", "Acta Hadr. B, 12 , 345-350"), (4, "none", "n/a", "actahadrb,12,345"), (5, "10.", "", "toappear,,"), (6, "10.", None, "toappear,,"), (7, None, None, ",,")]
    got = groups.publication_groups(spark.createDataFrame(rows, "work_id long, doi string, arxiv_id string, journal_key string")).collect()
    assert {(r.work_id, r.group_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert groups.publication_groups(spark.createDataFrame([], "work_id long, doi string, arxiv_id string, journal_key string")).count() == 0


# --- 8. packing


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, None, 3, 50, 99, 100, 101, 777, rng.randint(1, 400)]), "x") for i in range(600)] + [(7, 40, "x"), (None, 5, "x")]
    sizes = spark.createDataFrame(rows, "key long, tokens long, container string")
    kinds = spark.createDataFrame([("s", 100), ("m", 512), ("none", 0)], "pack_kind string, capacity_tokens int")
    for shard in (50, 20_000):
        got = packing.pack(sizes, kinds, shard).collect()
        for kind, capacity in (("s", 100), ("m", 512)):
            mine = [r for r in got if r.pack_kind == kind]
            assert Counter({k: n for k, n in Counter(r.key for r in mine if r.piece == 0).items()}) == Counter(k for k, *_ in rows if k is not None)
            assert sum(r.tokens for r in mine) == sum(t or 0 for k, t, _ in rows if k is not None)
            used = Counter()
            for r in mine:
                used[r.container] += r.tokens
                assert r.start_token % capacity == 0 and (r.tokens == capacity or r.piece == max(x.piece for x in mine if x.key == r.key) or r.key == 7)
            assert max(used.values()) <= capacity and used[-1] == 0
            full = [v for c, v in used.items() if c >= 0]
            assert sum(full) / (len(full) * capacity) > 0.9
    assert packing.pack(sizes.limit(0), kinds).count() == 0


def test_an_item_goes_where_squares_become_smallest():
    rng = random.Random(6)
    packer, counts = packing.Packer(30), Counter()
    for _ in range(300):
        size = rng.randint(1, 30)
        def after(gap):
            c = Counter(counts)
            if gap < 30:
                c[gap] -= 1
            if gap - size:
                c[gap - size] += 1
            return sum(v * v for v in c.values())
        options = [g for g in counts if counts[g] > 0 and g >= size] + [30]
        best = min(map(after, options))
        before = Counter(packer.used)
        number = packer.place(size)
        counts = Counter(30 - u for u in packer.used if u < 30)
        assert sum(v * v for v in counts.values()) == best


def test_tokens_round_trip(spark):
    coder = tokens.encoding()
    text = "Ünï <|endoftext|> 粒子 x" * 3
    assert coder.decode(coder.encode_ordinary(text)) == text
    rows = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9)], "k int, text string, tokens int")
    assert {r.k: r.tokens for r in tokens.token_counts(rows).collect()} == {1: len(coder.encode_ordinary(text)), 2: 0, 3: 0}


# --- 9. mixing


def test_shares_are_met_within_repeats(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(1, 60), ["a"] if i % 3 else ["b", "a"], "x") for i in range(3000)] + [(9001, 10, [], "x"), (9002, None, ["a"], "x"), (9003, 5, None, "x"), (9004, 5, ["zz"], "x")]
    sizes = spark.createDataFrame(rows, "key long, tokens long, sources array<string>, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 5)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix(sizes, targets, seed=1)
    used = Counter()
    for r in chosen.collect():
        used[r.key] += r.uses
        assert r.source in dict(((k, s) for k, _, s, _ in rows)).get(r.key)
    assert max(used.values()) <= 3 and not set(used) & {9001, 9002, 9003, 9004}
    share = {r.source: r.reached_share for r in mixing.shares(chosen, sizes, targets).collect()}
    assert abs(share["a"] - 5 / 9) < 0.01 and abs(share["b"] - 4 / 9) < 0.01 and share["c"] == 0
    assert mixing.mix(sizes.limit(0), targets).count() == 0


def test_the_flow_prefers_few_repeats():
    flows = mixing.plan({("a",): 100, ("b",): 1000}, {"a": (0.5, 4), "b": (0.5, 4)}, total=400)
    assert sum(flows[("a",), "a"]) == 200 and flows[("a",), "a"][:2] == [100, 100] and flows[("b",), "b"][0] == 200


def test_equal_content_belongs_to_all_of_its_sources(spark):
    rows = [(i, "a", f"a{i}", 10) for i in range(50)] + [(100 + i, "b", f"a{i}", 10) for i in range(20)] + [(300, None, "a1", 10), (301, "c", "a2", 10), (302, "a", None, 10)]
    sizes = spark.createDataFrame(rows, "key long, source string, content string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {r.key: r.sources for r in mixing.with_sources(sizes, "content", "source", targets).collect()}
    assert sorted(got[3]) == sorted(got[103]) == ["a", "b"] and got[30] == ["a"] and got[300] == [] and sorted(got[301]) == ["a", "b", "c"] and got[302] == ["a"] and len(got) == len(rows)
    chosen = mixing.mix(mixing.with_sources(sizes, "content", "source", targets), targets).collect()
    taken = Counter()
    for r in chosen:
        taken[r.source] += r.uses * r.tokens
    # b alone holds 20 documents; with the copies of its texts under a it fills half of all 73.
    assert abs(taken["a"] - taken["b"]) <= 20 and taken["b"] > 300


def test_patterns_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PATTERNS", 3)
    rng = random.Random(2)
    rows = [(i, rng.sample("abcde", rng.randint(1, 4)), 10) for i in range(400)]
    sizes = spark.createDataFrame(rows, "key long, sources array<string>, tokens long")
    targets = spark.createDataFrame([(s, 0.2, 2) for s in "abcde"], "source string, target_share double, max_repeats int")
    for r in mixing.shares(mixing.mix(sizes, targets), sizes, targets).collect():
        assert abs(r.reached_share - 0.2) < 0.02


def test_all_patterns_are_planned_with(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, rng.sample("abcdefgh", rng.randint(1, 6)), rng.randint(1, 40)) for i in range(2000)]
    rows += [(5000 + i, ["h", "z"], 10) for i in range(30)]
    sizes = spark.createDataFrame(rows, "key long, sources array<string>, tokens long")
    targets = spark.createDataFrame([(s, 0.1, 1 + n % 3) for n, s in enumerate("abcdefghz")], "source string, target_share double, max_repeats int")
    found = []
    for patterns in (100_000, 3):
        monkeypatch.setattr(mixing, "PATTERNS", patterns)
        found.append({tuple(r) for r in mixing.mix(sizes, targets).collect()})
    assert found[0] == found[1]
    taken = Counter()
    for _, source, tokens, uses in found[0]:
        taken[source] += tokens * uses
    assert taken["z"] == 30 * 10 * 3 and all(abs(n - taken["z"]) <= 40 for n in taken.values()) and len(taken) == 9


def test_the_flow_is_the_largest_of_least_cost():
    rng = random.Random(3)
    for _ in range(120):
        names = "abcde"[:rng.randint(1, 5)]
        patterns = {tuple(sorted(rng.sample(names, rng.randint(1, len(names))))): rng.randint(1, 200) for _ in range(9)}
        goal = {s: (rng.choice([0.1, 0.2, 0.4]), rng.randint(1, 4)) for s in names}
        live = {s: t for s, t in goal.items() if any(s in p for p in patterns)}
        whole = sum(share for share, _ in live.values())
        some = [c for n in range(1, len(live) + 1) for c in itertools.combinations(live, n)]

        def supply(chosen, passes):
            return sum(n * min(passes, max((live[s][1] for s in p if s in chosen), default=0)) for p, n in patterns.items())

        def quotas(size):
            return {s: int(size * live[s][0] / whole) for s in live}

        largest, above = 0, supply(tuple(live), 9)
        while largest < above:
            middle = (largest + above + 1) // 2
            fits = all(sum(quotas(middle)[s] for s in c) <= supply(c, 9) for c in some)
            largest, above = (middle, above) if fits else (largest, middle - 1)
        for total in (None, int(largest * 0.6), int(largest * 1.5)):
            flows = mixing.plan(patterns, goal, total)
            quota = quotas(largest if total is None else total)
            for (p, s), amounts in flows.items():
                assert s in p and len(amounts) == live[s][1]
            for p, n in patterns.items():
                assert all(sum(a[r] for (q, _), a in flows.items() if q == p and r < len(a)) <= n for r in range(4))
            for passes in range(1, 5):  # what a cut of the sources lets through, for as many passes as cost so much at most
                most = min(sum(quota[s] for s in live if s not in c) + supply(c, passes) for c in [(), *some])
                assert sum(sum(a[:passes]) for a in flows.values()) == most


# --- 10. sentences


@pytest.fixture(scope="module")
def model(spark, data):
    return S.train(spark.read.parquet(f"{data}/documents.parquet"))


def test_spans_hold_every_sign(spark, data, model):
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        spans = S.split(model, r.text)
        text = r.text or ""
        assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))

def test_spans_are_walked_as_a_scan_finds_them():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("(ab )[]“”\"«»x. ") for _ in range(rng.randint(0, 60)))
        spans = S._inside(text)
        assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))
        for lead in (0, 1):
            walk = S.Spans(spans)
            for end in range(1, len(text) + 1):
                assert walk.hold(end, lead) == any(a < end - lead and b >= end for a, b in spans)


def test_one_paragraph_of_many_quotations_is_read_in_linear_time():
    import time

    times = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        S.split(S.Model(), "“A thing was said (by us).” " * n + "「これ。」と言った。" + "(open " * n)
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * times[0] + 1
    assert S._word("x" * 41) == S._shape("x" * 41) and S._mark("y" * 50 + "!!!!!!!!") == (S._shape("y"), "!!!")



def test_rules_that_always_hold(model):
    assert S.split(model, None) == S.split(model, "") == S.split(model, " \n\n ") == []
    assert len(S.split(model, "One line\nand more\n\nnext, without a mark")) == 2
    inner = "It says (see Sec. 7. All. Done) here."
    assert S.split(model, inner) == [(0, len(inner))]
    assert [b - a for a, b in S.split(model, "該当なし。「ずれはない。」")] in ([5, 8], [13])


def test_rare_contexts_are_backed_off(spark, monkeypatch):
    words = [a + b + "o" for a in "bcdfghkl" for b in "aeiou"]
    pairs = [(words[i % 40], words[(7 * i + i // 40) % 40]) for i in range(200)]
    texts = [f"We see {p} approx. {q} here.\n\nThe {p} is {q}. The {q} is {p}." for p, q in pairs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = S.train(df)
    monkeypatch.setattr(S, "CONTEXTS", 20)
    model = S.train(df)
    assert {"approx", *words} <= model.kept
    assert sum(model.event[("c", "approx", ".")]) == pytest.approx(200)
    for key in [k for k in whole.event if k[0] in "sc"]:
        assert sum(model.event[key]) == pytest.approx(sum(whole.event[key]))
    for word in {**whole.start, **whole.inner}:
        assert model.start.get(word, 0) + model.inner.get(word, 0) == pytest.approx(whole.start.get(word, 0) + whole.inner.get(word, 0))
    assert [S.split(model, t) for t in texts] == [S.split(whole, t) for t in texts]


def test_sentence_rows(spark, model):
    rows = [(1, "A. B", "x"), (1, "A. B", "x"), (2, None, "x"), (3, "word " * 30000, "x")]
    got = S.sentences(spark.createDataFrame(rows, "doc_id long, text string, sentence string"), model).collect()
    assert Counter(r.doc_id for r in got)[3] == 1 and 2 not in {r.doc_id for r in got}
    assert S.sentences(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


# --- all queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_a_query_runs_and_keeps_its_columns(spark, data, name):
    found = queries.queries()[name](spark, data)
    assert found.count() > 0
    wanted = {"p1_found": ["term", "mark"], "p2_found": ["work_id", "field", "pos"], "p3_found": ["work_a", "work_b"], "p4_found": ["entry_id", "work_id"], "p5_found": ["name_a", "name_b"], "p6_found": ["tab", "rec_id", "field", "markup"], "p7_found": ["work_id", "group_id"], "p10_found": ["doc_id", "start_pos", "end_pos"]}
    if name in wanted:
        assert found.columns == wanted[name] and found.count() == found.distinct().count()
