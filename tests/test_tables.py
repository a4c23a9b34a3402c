import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text, urls
from pagemill.model import Options, SiteConfig
from pagemill.operators import dedup, nav, quality
from pagemill.plans import engine, output
from pagemill.sources import config, http, index, store

URLS = [
    ("HTTPS://User:pw@Docs.Example:443/a/b/;x?q=1#f", "https://docs.example/a/b?q=1"), ("http://h.example", "http://h.example/"), ("//h.example/a//", "https://h.example/a"), ("https://h.example/a;b;c", "https://h.example/a"),
    ("mailto:x@y", "mailto://x@y"), ("", "https:///"),
]


def one(spark, df_col, value, name="url"):
    return spark.createDataFrame([(value,)], f"{name} string").select(df_col(F.col(name)).alias("r")).first().r


@pytest.mark.parametrize("raw,want", URLS)
def test_normalize(spark, raw, want):
    got = one(spark, urls.normalize, raw)
    assert got == want
    if raw and not raw.startswith("mailto"):
        assert one(spark, urls.normalize, got) == got


@pytest.mark.parametrize(
    "url,want",
    [("https://h.example/", "index.md"), ("https://h.example", "index.md"), ("https://h.example/a/", "a/index.md"), ("https://h.example/a/b.html", "a/b.md"), ("https://h.example/a/b.md?x=1", "a/b.md"), ("https://h.example/a.html/", "a.md")],
)
def test_output_path(spark, url, want):
    assert one(spark, lambda c: urls.output_path("o", urls.site(c), c), url) == f"o/h.example/{want}"


def test_allowed(spark):
    rows = [("https://a/docs/x", ["/docs/"], None, True), ("https://a/blog", ["/docs/"], [], False), ("https://a/docs/x.pdf", ["/docs/"], [r"\.pdf$"], False), ("https://a/x", None, None, True)]
    df = spark.createDataFrame(rows, "url string, allow array<string>, deny array<string>, want boolean")
    assert df.where(urls.allowed(F.col("url"), F.col("allow"), F.col("deny")) != F.col("want")).count() == 0


def test_absolute(spark):
    rows = [("/a", "https://h/x/y", "https://h/a"), ("b", "https://h/x/y", "https://h/x/b"), ("b", "https://h", "https://h/b"), ("//o/z", "https://h/x", "https://o/z"), ("http://q", "https://h", "http://q"), ("#f", "https://h/x#g", "https://h/x#f")]
    df = spark.createDataFrame(rows, "u string, base string, want string")
    assert [r.got for r in df.select(urls.absolute(F.col("u"), F.col("base")).alias("got")).collect()] == [r[2] for r in rows]


def test_dedup_keeps_the_first_and_the_best(spark):
    e = spark.createDataFrame([("a.md", 2), ("a", 5), ("b", 1), (None, 0)], "url string, pos long")
    assert {tuple(r) for r in dedup.endpoints(e).select("url", "pos").collect()} == {("a", 2), ("b", 1)}
    m = spark.createDataFrame([(1, "a", "html"), (2, "a.md", "html"), (3, "a.md", "markdown"), (4, "a.md", "markdown"), (5, None, None)], "record_id long, url string, source string")
    assert {tuple(r) for r in dedup.manifest(m).collect()} == {("a", 3), (None, 5)}


def test_low_value(spark):
    cases = {"short": True, "\n".join(["a line of text"] * 6): False, "x" * 400: True, "---\na: 1\n---\n" + "\n".join(["a line of text"] * 6): False}
    for body, want in cases.items():
        assert one(spark, text.low_value, body) is want


def test_plain_and_column_checks_agree(spark):
    texts = ["", "# a\n##### b\n\n```python\nif a:\nb\\_c\n```\n", "[a](b) " * 40, "Copyright " * 9, "x" * 700, "```\nq", "####### no\n## y\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, md string")
    rows = {r.i: r for r in quality.evaluated(df).collect()}
    for i, md in enumerate(texts):
        plain = quality.evaluate(md)
        for k in quality.CHECKS:
            assert rows[i][f"check_{k}"].passed == plain["checks"][k]["passed"], (k, md)
            assert rows[i][f"check_{k}"].score == pytest.approx(plain["checks"][k]["score"], abs=6e-4)
        assert rows[i].passed == plain["passed"]
        assert (rows[i].retry_action and rows[i].retry_action.action) == (plain["retry_action"] and plain["retry_action"]["action"])


def test_judging_asks_only_gray_rows(spark):
    df = quality.evaluated(spark.createDataFrame([(1, "```\n" + "x" * 200), (2, "# T\n" + "word " * 200)], "i long, md string"), threshold=0.9)
    out = quality.judged(df, lambda gray: gray.select("i", F.lit(True).alias("llm_passed"), F.lit("ok").alias("llm_reason")), "i")
    assert {r.i: (r.passed, r.llm_passed) for r in out.collect()} == {1: (True, True), 2: (True, None)}


def test_indexes(spark):
    files = spark.createDataFrame([("s", "# c\n- [A](https://h.example/a): x\nhttps://h.example/a.md\nhttps://h.example/?q=<id>\n- https://h.example/b/\n"), ("n", None)], "site_name string, text string")
    got = [(r.url, r.pos) for r in index.llms(files).orderBy("pos").collect()]
    assert got == [("https://h.example/a", 1), ("https://h.example/b", 4)]
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://h.example/b </loc></url><url><loc></loc></url><url><loc>https://h.example/c#x</loc></url></urlset>'
    sm = index.sitemap(spark.createDataFrame([("s", xml)], "site_name string, xml string"))
    assert [r.url for r in sm.orderBy("pos").collect()] == ["https://h.example/b", "https://h.example/c"]
    assert [r.url for r in index.merged(index.llms(files), sm).orderBy("pos").collect()] == ["https://h.example/a", "https://h.example/b", "https://h.example/c"]
    sites = spark.createDataFrame([("s", ["/c"], [])], "site_name string, allow_patterns array<string>, deny_patterns array<string>")
    assert [r.url for r in index.sitemap(spark.createDataFrame([("s", xml)], "site_name string, xml string"), sites).collect()] == ["https://h.example/c"]


def nodes(spark):
    rows = [("s", 1, None, 0, "Start", "/", "core"), ("s", 2, None, 1, "Guide", None, None), ("s", 3, 2, 1, "Deep", "/d", None), ("s", 4, 2, 0, "Install", "/i", "core"), ("s", 5, 3, 0, None, "/i", None), ("t", 6, None, 0, "Other", "x", "core"), ("s", 7, 99, 0, "Lost", "/l", "core")]
    return spark.createDataFrame(rows, "site_name string, node_id int, parent_id int, pos int, title string, url string, priority string")


def test_navigation(spark):
    sites = spark.createDataFrame([("s", "https://s.example"), ("t", "https://t.example/a/")], "site_name string, base_url string")
    flat = [(r.site_name, r.url) for r in nav.flatten(nodes(spark), sites).orderBy("site_name", "rank").collect()]
    assert flat == [("s", "https://s.example/"), ("s", "https://s.example/i"), ("s", "https://s.example/d"), ("s", "https://s.example/i"), ("t", "https://t.example/a/x")]
    assert {r.site_name: (r.core, r.secondary) for r in nav.priority_stats(nodes(spark)).collect()} == {"s": (2, 2), "t": (1, 0)}
    assert {r.node_id for r in nav.chosen(nodes(spark), None, ["deep"]).collect()} == {1, 2, 4, 6}
    assert {r.node_id for r in nav.chosen(nodes(spark), "INSTALL").collect()} == {2, 4, 6}  # t falls back to its tree
    assert {r.node_id for r in nav.chosen(nodes(spark), "deep", ["guide"]).collect()} == {1, 2, 3, 4, 5, 6}
    idx = spark.createDataFrame([("s", "https://s.example/d", 1), ("s", "https://s.example/new", 2), ("u", "https://u.example/", 1)], "site_name string, url string, rank long")
    pages, stats = nav.discover(nodes(spark), sites, idx)
    assert {r.url for r in pages.where("priority = 'index'").collect()} == {"https://s.example/new", "https://u.example/"}
    assert {r.site_name: r.core for r in stats.collect()} == {"s": 3, "t": 1}


PAGE = "<main>\n<h1>T</h1>\n" + "\n".join(f"<p>Paragraph {i} says something of use about the service and its parts.</p>" for i in range(12)) + "\n</main>"


def records(spark):
    rows = [
        (1, "https://h.example/a", "html", None, PAGE, 9), (2, "https://h.example/b.md", "markdown", "", "# T\n\n" + "some words here.\n\n" * 60, 9), (3, "https://h.example/c", "html", "sphinx", None, 9),
        (4, "https://h.example/d", "html", "", "tiny", 9), (5, None, None, "weird", PAGE, 9),
    ]
    return spark.createDataFrame(rows, "record_id long, url string, source string, framework string, content string, _extra int")


def test_engine(spark):
    got = {r.record_id: r for r in engine.run(records(spark)).collect()}
    assert (got[1].status, got[1].framework) == ("passed", "generic") and got[1].report.checks["length"].passed
    assert (got[2].status, got[2].framework, got[2].steps) == ("passed", "gitbook", ["markdown_normalize", "quality_gate"])
    assert (got[3].status, got[3].content, got[3].error) == ("failed", None, "no content")
    assert (got[4].status, got[4].content, got[4].steps) == ("skipped_low_quality", "", ["skipped_low_quality"])
    assert got[5].framework == "weird" and got[5]._extra == 9
    assert engine.run(records(spark).limit(0)).count() == 0
    assert engine.run(records(spark), Options(precheck=False)).where("status = 'skipped_low_quality'").count() == 0


def test_outputs(spark, tmp_path):
    done = engine.run(records(spark).withColumn("fetched_at", F.lit(None).cast("timestamp")).withColumn("content_hash", F.lit("h")))
    buckets = {(r.site, r.bucket): r.pages for r in output.summary(done).collect()}
    assert buckets[("h.example", "failed")] == 1 and buckets[("h.example", "passed")] == 3
    docs = output.documents(done.where("url IS NOT NULL"), "out", F.timestamp_seconds(F.lit(0)))
    assert output.write_files(docs, str(tmp_path)).count() == 4
    assert (tmp_path / "out/h.example/a.md").read_text().startswith("---\nsource_url: https://h.example/a\nfetched_at: 1970-01-01T00:00:00+00:00\ncontent_hash: h\nframework: generic\n---\n# T")
    evil = spark.createDataFrame([("../../x.md", "t")], "path string, document string")
    output.write_files(evil, str(tmp_path)).count()
    assert (tmp_path / "outside/x.md").exists()


def test_fetch(spark):
    md = "# T\n" + "text " * 60
    gitbook = '<meta name="generator" content="GitBook"><div class="group/codeblock"></div>'

    def transport(method, url, headers, seconds):
        if url.endswith("/down"):
            raise OSError("no route")
        if url.endswith("/gone"):
            return http.Response(404)
        if url.endswith("g.md"):
            return http.Response(200, md.encode())
        return http.Response(200, gitbook.encode() if url.endswith("g") else b"<p>x</p>")

    pages = spark.createDataFrame([("h", f"https://h.example/{p}") for p in ("g", "x", "down", "gone")], "site_name string, url string")
    got = {r.url.rsplit("/", 1)[1]: r for r in http.fetch(pages, transport).collect()}
    assert (got["g"].source, got["g"].framework, got["g"].content_hash) == ("markdown", "gitbook", hashlib.sha256(md.encode()).hexdigest())
    assert (got["x"].source, got["x"].status) == ("html", "fetched")
    assert (got["down"].http_status, got["down"].status) == (0, "failed") and (got["gone"].http_status, got["gone"].status) == (404, "failed")
    assert http.locate_llms("https://h.example/docs/", lambda m, u, h, s: http.Response(200 if u == "https://h.example/llms.txt" else 404)) == "https://h.example/llms.txt"
    assert http.locate_sitemap("https://h.example/", lambda *a: 1 / 0) is None


def test_store(spark, tmp_path):
    (tmp_path / "b.html").write_text("<p>é</p>")
    (tmp_path / "a.html").write_bytes(b"<p>\xff</p>")
    (tmp_path / "c.md").write_text("m")
    rows = store.scan_html(spark, str(tmp_path)).orderBy("url").collect()
    assert [(r.url, r.http_status) for r in rows] == [("store:a", 200), ("store:b", 200)] and "é" in rows[1].content
    for name in ("manifest.json", "_hidden.json"):
        (tmp_path / name).write_text(json.dumps({"generated_at": "t", "total": 1, "pages": [{"url": "u", "http_status": 200, "source": "html"}]}, indent=2))
        assert [r.url for r in store.read_manifest(spark, str(tmp_path / name)).collect()] == ["u"]
    assert store.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    assert store.clean(str(tmp_path)) == 0 and store.clean(str(tmp_path), True) == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_hidden.json", "c.md"]


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    assert config.load(path).options == Options()
    c = config.load(path)
    c.options.max_retries = 5
    c.sites["x"] = SiteConfig("https://x.example", ["/a"])
    config.save(c, path)
    again = config.load(path)
    assert again.options.max_retries == 5 and again.sites["x"].allow_patterns == ["/a"]


def test_stream(spark, tmp_path):
    from pagemill.streaming import pages

    rows = [("https://h.example/a", "html", "", PAGE, "h1"), ("https://h.example/a", "html", "", PAGE, "h1"), ("https://h.example/b", "html", "", PAGE, "h2")]
    df = spark.createDataFrame(rows, "url string, source string, framework string, content string, content_hash string").withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.select("url", "source", "framework", "content", "fetched_at", "content_hash").write.parquet(str(tmp_path / "in"))
    q = pages.start(pages.clean(pages.read(spark, str(tmp_path / "in")), Options(precheck=False)), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.url for r in out.collect()) == ["https://h.example/a", "https://h.example/b"]


def test_chat():
    from pagemill.model import LLMConfig
    from pagemill.sources import chat

    sent = []

    def post(url, headers, body, seconds):
        sent.append((url, headers["Authorization"], json.loads(body)["messages"][1]["content"]))
        return json.dumps({"choices": [{"message": {"content": ' {"passed": true} '}}]}).encode()

    assert chat.chat(LLMConfig()) is None
    ask = chat.chat(LLMConfig("https://m.example/v1/", "k", "m"), post=post)
    assert quality.judge(ask)("page")["passed"] and sent == [("https://m.example/v1/chat/completions", "Bearer k", "page")]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from pagemill import cli

    monkeypatch.chdir(tmp_path)
    (tmp_path / "store").mkdir()
    (tmp_path / "store/a.html").write_text(PAGE)
    monkeypatch.setattr(cli, "local_session", lambda *a: spark)
    assert cli.main(["spin", "store", "--out", "o"]) == 0
    assert "passed\t1" in capsys.readouterr().out and list((tmp_path / "o").rglob("*.md"))
    cli.main(["store", "status", "store"])
    assert "'files': 1" in capsys.readouterr().out
    cli.main(["store", "list", "store"])
    assert "store:a" in capsys.readouterr().out

    def transport(method, url, headers, seconds):
        if url.endswith("/llms.txt"):
            return http.Response(200, b"https://h.example/docs/a\nhttps://h.example/blog/b\n")
        return http.Response(200 if "/docs/" in url else 404, PAGE.encode())

    cli.main(["feed", "https://h.example/", "--discover-only"], transport)
    assert capsys.readouterr().out.split() == ["https://h.example/docs/a"]
    cli.main(["feed", "https://h.example/"], transport)
    assert (tmp_path / "out/h.example/docs/a.md").exists()
    cli.main(["store", "clean", "store", "--force"])
    assert not (tmp_path / "store/a.html").exists()
