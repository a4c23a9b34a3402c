import hashlib
from collections import Counter

from pagemill.llm import sitelines
from pagemill.llm.htmlblocks import norm, text_blocks

SCHEMA = "raw_html_path string, site_name string, html string, key string, salt int, keys string"


def page(*lines):
    return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"


def sample():
    rows = []
    for i in range(40):
        rows.append((f"a{i}", "big", page("Menu", f"text {i}", "LEGAL  notice" if i % 2 else "legal notice", *(["rare"] if i < 4 else []), *(["Share"] * 2 if i < 6 else [])), "k", 0, ""))
    rows += [(f"b{i}", "small", page("Menu", "x", f"y{i}"), "k", 0, "") for i in range(4)]
    rows += [("n", None, page("Menu"), "k", 0, ""), ("e", "big", None, "k", 0, ""), ("z", "big", "", "k", 0, "")]
    return rows


def brute(rows):
    totals = Counter(r[1] for r in rows)
    holds = {r[0]: {hashlib.md5(norm(t).encode()).hexdigest()[:16] for t in text_blocks(r[2])} for r in rows}
    files = Counter((r[1], k) for r in rows for k in holds[r[0]])
    return {(r[0], k) for r in rows for k in holds[r[0]] if files[r[1], k] >= 5 and files[r[1], k] >= 0.12 * totals[r[1]]}


def test_excessive_lines_match_brute_force(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    for limits in ({}, {"limit": 0, "per_salt": 7}):
        got = [tuple(r) for r in sitelines.excessive(df, **limits).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(sample())


def test_neighbours_form_one_block_and_are_deleted(spark):
    rows = [(f"p{i}", "s", page("one", "two", f"own {i}", "three"), "", 0, "") for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = sitelines.boilerplate_blocks(sitelines.lines(df)).groupBy("block").count().collect()
    assert sorted(r["count"] for r in blocks) == [1, 2]
    texts = {r.raw_html_path: (r.text, r.lines_removed) for r in sitelines.without_excessive(df).collect()}
    assert texts["p3"] == ("own 3", 3)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sitelines.excessive(empty).count() == 0
    assert sitelines.without_excessive(empty).count() == 0


def test_occurrences_are_runs_of_one_block():
    assert sitelines.occurrences([1, 2, 9, 2, 1, 3, 3, 8], {1: 1, 2: 1, 3: 3}) == [(0, 2), (3, 5), (5, 7)]
    assert sitelines.occurrences([], {}) == []


def test_blocks_table(spark):
    rows = [(f"p{i}", "s", page("one", "two", f"own {i}", "three"), "", 0, "") for i in range(10)]
    got = sitelines.blocks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.lines for r in got) == [1, 2, 2] and len({r.block_key for r in got}) == 2
    assert sitelines.blocks(spark.createDataFrame([], SCHEMA)).count() == 0
