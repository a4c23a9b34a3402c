from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import leakage

DOCS, ITEMS = "doc_id long, text string, item_id long, id string", "item_id long, text string, doc_id long"
WORD = st.sampled_from("a b c".split())


def shared(doc, item, least):
    d, t = leakage.words(doc), leakage.words(item)
    grams = {tuple(t[i : i + least]) for i in range(len(t) - least + 1)}
    return any(tuple(d[i : i + least]) in grams for i in range(len(d) - least + 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(WORD, max_size=40), st.lists(st.lists(WORD, max_size=15), max_size=4), st.integers(2, 5))
def test_automaton_finds_what_brute_force_finds(doc, items, least):
    pairs = [(i, " ".join(t)) for i, t in enumerate(items)]
    sam = leakage.SuffixAutomaton(pairs, least)
    spans = sam.spans(doc)
    found = set().union(*(sam.items_of(doc, s) for s in spans)) if spans else set()
    assert found == {i for i, t in pairs if shared(" ".join(doc), t, least)}
    text = [" ".join(t) for t in items]
    longest = [max((n for n in range(len(doc) - i + 1) if n == 0 or any(f" {' '.join(doc[i:i+n])} " in f" {t} " for t in text)), default=0) for i in range(len(doc))]
    want = {(i, i + n) for i, n in enumerate(longest) if n >= least and (i == 0 or longest[i - 1] < n + 1)}
    assert set(spans) == want


def test_documents_and_items(spark):
    run = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"x {run.upper().replace(' ', ' - ')} y", 7, ""), (2, run.replace("six", "sux"), 7, ""), (3, None, 7, ""), (4, "", 7, ""), (1, run, 7, ""), (None, run, 7, "")]
    items = [(10, f"zero {run}", 0), (11, None, 0), (12, "short", 0), (10, f"zero {run}", 0), (13, run + " thirteen", 0)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = sorted((r.doc_id, r.item_id, r.longest) for r in leakage.leaks(d, b).collect())
    assert got == [(1, 10, 12), (1, 10, 12), (1, 13, 12), (1, 13, 12)]
    parts = sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, b, max_bytes=1).collect())
    assert parts == [(1, 10), (1, 10), (1, 13), (1, 13)]
    for many in ({}, {"max_bytes": 1}):
        shares = {(r.doc_id, r.item_id, r.covered) for r in leakage.leaks(d, b, **many).collect()}
        assert shares == {(1, 10, 12 / 14), (1, 13, 12 / 14), (1, 10, 1.0), (1, 13, 1.0)}
    once, parted = (sorted(((r.doc_id, r.text) for r in leakage.without_leaks(d, b, max_covered=0.9, **x).collect()), key=repr) for x in ({}, {"max_bytes": 1}))
    assert once == parted and (1, "x  y") in once
    cleaned = {(r.doc_id, r.text) for r in leakage.without_leaks(d, b).collect()}
    assert (4, "") in cleaned and (3, None) in cleaned and (1, None) in cleaned


def test_empty_tables_and_long_text(spark):
    none_d, none_b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    d = spark.createDataFrame([(1, "w " * 500_000, 1, "")], DOCS)
    b = spark.createDataFrame([(1, "w " * 12, 1)], ITEMS)
    assert leakage.leaks(none_d, b).count() == 0
    assert leakage.leaks(d, none_b).count() == 0
    assert [tuple(r)[:2] for r in leakage.leaks(d, b).collect()] == [(1, 1)]


def test_spans_of_several_parts_are_united(spark):
    a, b = " ".join(f"a{i}" for i in range(14)), " ".join(f"b{i}" for i in range(13))
    d = spark.createDataFrame([(1, f"x {a} {b} y z", 0, "")], DOCS)
    items = spark.createDataFrame([(1, a, 0), (2, f"{a.split()[-1]} {b}", 0)], ITEMS)
    got = {tuple(r) for r in leakage.leaks(d, items, max_bytes=1).collect()}
    assert got == {(1, 1, 14, 27 / 30), (1, 2, 14, 27 / 30)} == {tuple(r) for r in leakage.leaks(d, items).collect()}
    assert leakage.without_leaks(d, items, max_covered=0.95, max_bytes=1).first().text == "x  y z"


def test_automaton_size_is_bounded_by_words():
    items = [(i, " ".join(f"w{(i * 37 + k * k) % 500}" for k in range(200))) for i in range(40)]
    sam = leakage.SuffixAutomaton(items, 12)
    assert len(sam.next) <= 2 * 40 * 200 + 1
    assert sum(map(len, sam.items.values())) <= 40 * 200
