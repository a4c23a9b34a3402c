import random

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import residue, template
from pagemill.llm.htmlblocks import norm

SCHEMA = "raw_html_path string, site_name string, html string, s long, path string, blocks string, salt int"
WORDS = "amber birch cloud drift eagle field glass harbor island jungle kettle lemon marble nectar olive pearl quarry raven saddle tunnel".split()


def sentence(r, n=9):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(r, site, body=None):
    """A page with all kinds of chrome, and its main-body blocks."""
    own = body if body is not None else [f"Title {r.randrange(10**6)}", *(sentence(r) for _ in range(r.randint(2, 5)))]
    main = [f"<h1>{own[0]}</h1>"] + [f"<p>{x}</p>" for x in own[1:]]
    if r.random() < 0.5:
        main.insert(r.randint(1, len(main)), f"<p>Reviewed by {r.choice(WORDS).capitalize()}, staff of {site}</p>")
    if r.random() < 0.6:
        main.insert(r.randint(0, len(main)), "<div>All rights stay with us</div>")
    if r.random() < 0.3:
        main.append(f'<div class="cm1"><p>{r.choice(WORDS)}: {sentence(r)}</p><p>{r.choice(WORDS)}: {sentence(r)}</p></div>')
    if r.random() < 0.4:
        main.append("<div><p>Related</p><ul>" + "".join(f'<li><a href="/{i}">{sentence(r, 4)}</a></li>' for i in range(3)) + "</ul></div>")
    side = "".join(f'<li><a href="/s{i}">Menu entry {i}</a></li>' for i in range(6))
    return f"<html><head><title>t</title></head><body><header><ul>{side}</ul></header><div class='{site}-m'>{''.join(main)}</div><footer><p>Changed on 202{r.randint(0, 5)}-01-0{r.randint(1, 9)}</p></footer></body></html>", own


def rows(seed, n=60):
    r = random.Random(seed)
    out, true = [], {}
    for site in ("alpha", "beta"):
        for i in range(n):
            html, own = page(r, site)
            out.append((f"{site}{i}", site, html, 1, "p", "b", 2))
            true[f"{site}{i}"] = {norm(x) for x in own}
    return out, true


def test_main_bodies_come_out_whole_and_clean(spark):
    data, true = rows(3)
    got = {r.raw_html_path: {norm(b) for b in r.blocks} for r in template.main_bodies(spark.createDataFrame(data, SCHEMA)).collect()}
    hit = sum(len(got[p] & true[p]) for p in true)
    assert hit / sum(len(v) for v in got.values()) > 0.98
    assert hit / sum(len(v) for v in true.values()) > 0.98


def test_odd_inputs(spark):
    data, _ = rows(4, 5)
    data += [("n", None, "<p>alone</p>", 1, "p", "b", 2), ("e", "alpha", None, 1, "p", "b", 2), ("z", "alpha", "", 1, "p", "b", 2), (None, "beta", "<h1>x</h1>", 1, "p", "b", 2), data[0]]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.raw_html_path, r.block_key) for r in template.body_keys(df).collect()}
    assert not {p for p, _ in got} & {"e", "z"}
    assert any(p == "n" for p, _ in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert template.body_keys(empty).count() == 0 and template.template_classes(empty).count() == 0
    deep = "<div class='a'>" * 30_000 + "x"
    assert template.body_keys(spark.createDataFrame([("d", "s", deep, 1, "p", "b", 2)], SCHEMA)).count() <= 1
    assert template.body_keys(spark.createDataFrame([("l", "s", "<p>" + "word " * 200_000 + "</p>", 1, "p", "b", 2)], SCHEMA)).count() == 1


def test_equal_vectors_form_one_class(spark):
    data = [(f"p{i}", "s", f"<body><p>constant one here</p><p>constant two here</p><p>{sentence(random.Random(i))}</p></body>", 1, "p", "b", 2) for i in range(12)]
    classes = template.template_classes(spark.createDataFrame(data, SCHEMA)).collect()
    assert max(c.tokens for c in classes) >= 2 and all(c.files <= c.total for c in classes)


def test_classes_nest(spark):
    data = [(f"p{i}", "s", f"<body><p>constant head line</p><div class='n'><p>{'only sometimes here' if i % 2 else i}</p></div></body>" if i % 4 else f"<body><p>constant head line</p><p>{i}</p></body>", 1, "p", "b", 2) for i in range(16)]
    classes = {c.files: c for c in template.template_classes(spark.createDataFrame(data, SCHEMA)).collect()}
    assert classes[16].parent_class is None
    assert classes[8].parent_class == classes[12].class_id and classes[12].parent_class == classes[16].class_id


def test_residue_files(spark):
    r = random.Random(5)
    data, cases = [], set()
    for site in ("alpha", "beta"):
        for i in range(80):
            kind = i % 16
            body = None
            if kind == 0:
                body = ["Page not found", "Check the address or go back to the home page."]
            elif kind == 1:
                body = ["{{ page.title }}", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "[Insert text here] ${name}"]
            elif kind == 2:
                body = [f"Title {i}", *(sentence(r) for _ in range(4)), "Writers type lorem ipsum into a template.", sentence(r)]
            html, _ = page(r, site, body)
            if kind == 3:
                html = f'<html><body><header><ul><li><a href="/s0">Menu entry 0</a></li></ul></header><div class="{site}-m"><div id="root"></div><noscript><p>Please enable JavaScript to continue.</p></noscript></div></body></html>'
            if kind in (0, 1, 3):
                cases.add(f"{site}{i}")
            data.append((f"{site}{i}", site, html, 1, "p", "b", 2))
    pages = spark.createDataFrame(data, SCHEMA)
    prose = spark.createDataFrame([(sentence(r),) for _ in range(400)], "text string")
    got = {x.raw_html_path for x in residue.residue_files(pages, prose).collect()}
    assert len(got & cases) / len(cases) > 0.95 and len(got & cases) / max(1, len(got)) > 0.95


def test_residue_odd_inputs(spark):
    df = spark.createDataFrame([("a", None, None, 1, "", "", 0), ("b", "s", "", 1, "", "", 0), ("c", "s", "<p></p>", 1, "", "", 0)], SCHEMA)
    assert residue.residue_files(df, spark.createDataFrame([(None,), ("",)], "text string")).count() == 0
    assert residue.residue_files(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_residue_models_count_long_documents_and_pages(spark):
    r = random.Random(9)
    latin = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua veniam nostrud ullamco laboris commodo".split()

    def verse():
        return " ".join(r.choice(latin) for _ in range(9)).capitalize() + "."

    data = [(f"p{i}", "s", page(r, "s", [f"Title {sentence(r, 3)}", *(verse() if i % 2 else sentence(r) for _ in range(4))])[0], 1, "p", "b", 2) for i in range(40)]
    pages = spark.createDataFrame(data, SCHEMA)
    short = [(sentence(r),) for _ in range(100)]
    # in a domain with a long Latin text Latin pages are prose
    long = " ".join(verse() for _ in range(6000))
    assert len(long) > 300_000
    assert residue.residue_files(pages, spark.createDataFrame(short, "text string")).count() == 20
    assert residue.residue_files(pages, spark.createDataFrame([*short, (long,)], "text string")).count() == 0
    texts = residue.main_texts(spark.createDataFrame([("x", "s", f"<p>{long}</p>", 1, "p", "b", 2)], SCHEMA), template.template(pages))
    counted = residue._counted(texts, residue._add_all)[2]
    assert counted.total == len(long) + residue.ORDER - 1
    for table, slots in zip(counted.counts, residue._slots(residue._codes([residue._plain(long)])[0])):
        assert (table == np.bincount(slots, minlength=1 << residue.BITS)).all()


def test_large_sites_are_split(spark):
    data, _ = rows(6, 30)
    df = spark.createDataFrame(data, SCHEMA)
    valid = template.template(df)
    one, other = (template.attach(df, valid, **x).select("path", F.size("blocks").alias("n"), F.size("main").alias("m")) for x in ({}, {"limit": 0, "per_salt": 4}))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def bodies(spark, data):
    return {r.raw_html_path: [norm(b) for b in r.blocks] for r in template.main_bodies(spark.createDataFrame(data, SCHEMA)).collect()}


def test_classed_content_stays_without_template_evidence(spark):
    data, _ = rows(7, 40)
    html, own = page(random.Random(71), "alpha")
    extra = '<section id="usage"><p>Quick amber usage words</p></section><div class="note"><p>Rare marble note words</p></div><div class="highlight"><pre>run --fast</pre></div><ul class="simple"><li>Single olive point</li></ul>'
    data.append(("x", "alpha", html.replace("</h1>", "</h1>" + extra), 1, "p", "b", 2))
    got = bodies(spark, data)["x"]
    assert {"quick amber usage words", "rare marble note words", "run --fast", "single olive point", *map(norm, own)} <= set(got)


def test_frequent_code_and_sections_stay(spark):
    r = random.Random(72)
    data = []
    for i in range(40):
        extra = f'<div class="highlight"><pre>run --job {sentence(r, 3)}</pre></div><section id="usage"><p>{sentence(r)}</p></section>' if i % 2 else ""
        data.append((f"p{i}", "s", f'<body><div class="top"><p>Site head line</p></div><div class="m"><h1>Title {sentence(r, 3)}</h1><p>{sentence(r)}</p>{extra}<p>{sentence(r)}</p></div></body>', 1, "p", "b", 2))
    got = bodies(spark, data)
    assert all(len(b) == (5 if int(p[1:]) % 2 else 3) and "site head line" not in b for p, b in got.items())


def test_layouts_of_a_third_keep_their_bodies(spark):
    r = random.Random(73)
    data, true = [], {}
    for i in range(60):
        own = [sentence(r) for _ in range(4)]
        true[f"p{i}"] = {norm(x) for x in own}
        data.append((f"p{i}", "s", f'<body><header><h1>T {sentence(r, 3)}</h1></header><div class="layout{i % 3}">{"".join(f"<p>{x}</p>" for x in own)}</div><div class="foot"><p>Made by us in town</p></div></body>', 1, "p", "b", 2))
    got = bodies(spark, data)
    assert all(true[p] <= set(b) and "made by us in town" not in b for p, b in got.items())


def test_small_sites_keep_their_bodies(spark):
    html = '<body><nav><p>Way home</p></nav><header><h1>T</h1></header><div class="content"><h2>First part</h2><p>Amber birch cloud.</p></div><div class="links"><ul><li><a href="/a">A</a></li></ul></div><footer><p>End</p></footer></body>'
    got = bodies(spark, [("a", "one", html, 1, "p", "b", 2), ("b", "two", html, 1, "p", "b", 2), ("c", "two", html, 1, "p", "b", 2)])
    assert all(b == ["t", "first part", "amber birch cloud."] for b in got.values()) and len(got) == 3


def test_residue_that_a_site_repeats(spark):
    r = random.Random(8)
    error, filler = ["Page not found", "Check the address or go back to the home page."], ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "[Insert text here] ${name}"]
    data, cases = [], {}
    for site, n in (("alpha", 60), ("beta", 30)):
        for i in range(n):
            body = None
            if i % 3 == 0 if site == "alpha" else i < 3:
                body = error
            elif i % 3 == 1 and site == "alpha" and i < 30:
                body = [f"Title {sentence(r, 3)}", *filler]
            html, own = page(r, site, body)
            if body:
                cases[f"{site}{i}"] = {norm(x) for x in own}
            data.append((f"{site}{i}", site, html, 1, "p", "b", 2))
    pages = spark.createDataFrame(data, SCHEMA)
    got = bodies(spark, data)
    assert sum(true <= set(got[p]) for p, true in cases.items()) >= 0.95 * len(cases)
    prose = spark.createDataFrame([(sentence(r),) for _ in range(400)], "text string")
    found = {x.raw_html_path for x in residue.residue_files(pages, prose).collect()}
    assert len(found & set(cases)) >= 0.9 * len(cases) and len(found & set(cases)) >= 0.9 * len(found)


def test_validity_by_class_size(spark):
    r = random.Random(9)
    data = []
    for i in range(30):
        note = "<div class='box'><p>Contents</p><p>Way back home again</p></div>" if i % 2 else ""
        word = "<p>Examples</p>" if i % 3 == 0 else ""
        data.append((f"p{i}", "s", f"<body><main><h1>T {sentence(r, 3)}</h1><p>{sentence(r)}</p>{word}<p>{sentence(r)}</p>{note}</main></body>", 1, "p", "b", 2))
    got = bodies(spark, data)
    assert all(("examples" in b) == (int(p[1:]) % 3 == 0) for p, b in got.items())  # alone in its class
    assert not any("contents" in b or "way back home again" in b for b in got.values())  # in the class of its container
