import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators import dedup, markdown, nav
from pagemill.sources import http, index, store

PAGE = "<html><body><main><h1>Title</h1>" + "<p>Words that say something about the matter at hand.</p>" * 14 + "</main></body></html>"
RECORDS = "record_id long, url string, source string, http_status int, content_hash string, raw_html_path string, raw_md_path string, framework string, status string"


def test_best_record_for_any_number(spark):
    rows = [(-5, "a", "html"), (7, "a.md", "html"), (2**61 + 5, "b", "markdown"), (2**60 + 9, "b.md", "markdown"), (-(2**63), "c.md", None), (2**63 - 1, "c", None)]
    df = spark.createDataFrame(rows, "record_id long, url string, source string")
    assert {tuple(r) for r in dedup.manifest(df).collect()} == {("a", -5), ("b", 2**60 + 9), ("c", 2**63 - 1)}
    best = store.best_records(df.withColumn("http_status", F.lit(200)))
    assert {r.record_id for r in best.collect()} == {-5, 2**60 + 9, 2**63 - 1}


def test_manifest_round_trip(spark, tmp_path):
    rows = [(-2, "https://h/a", "html", 200, "x", "a.html", None, None, "fetched"), (3, "https://h/b", "html", 404, None, None, "", "mkdocs", "failed")]
    df = spark.createDataFrame(rows, RECORDS)
    store.write_manifest(df, str(tmp_path))
    got = store.read_manifest(spark, f"{tmp_path}/manifest.json").orderBy("pos").collect()
    assert [(r.pos, r.url, r.http_status, r.html_file, r.framework) for r in got] == [(-2, "https://h/a", 200, "a.html", ""), (3, "https://h/b", 404, "", "mkdocs")]
    store.write_manifest(df.limit(0), str(tmp_path))
    assert store.read_manifest(spark, f"{tmp_path}/manifest.json").count() == 0


def test_pages_are_written_and_found_again(spark, tmp_path):
    md = "# Native\n\n" + "text of the page " * 40
    rows = [("https://h/a", "html", 200, PAGE, None), ("https://h/a.md", "markdown", 200, PAGE, md), ("https://h/gone", "html", 404, None, None), (None, "html", 200, PAGE, None)]
    got = spark.createDataFrame(rows, "url string, source string, http_status int, html string, md string").withColumn("record_id", F.monotonically_increasing_id())
    got = got.withColumns({"content_hash": F.lit("h"), "framework": F.lit(""), "status": F.lit("fetched")})
    records = store.write_pages(got, str(tmp_path)).cache()
    assert {r.raw_html_path for r in records.collect()} == {store.file_name("https://h/a", ".html"), store.file_name("https://h/a.md", ".html"), ""}
    store.write_manifest(records.where("url IS NOT NULL"), str(tmp_path))
    found = store.stored_records(spark, str(tmp_path)).collect()
    assert [(r.url, r.source, r.content) for r in found] == [("https://h/a.md", "markdown", md)]  # native Markdown stands for its page
    with pytest.raises(ValueError):
        store.write_pages(got, "s3a://bucket/x")


def test_malformed_sitemaps_are_rows(spark):
    good = '<?xml version="1.0"?><s:urlset xmlns:s="x"><s:url><s:loc>https://h/a&amp;b</s:loc></s:url></s:urlset>'
    files = spark.createDataFrame([("good", good), ("bad", "<urlset><loc>https://h/x</loc>"), ("none", None), ("empty", "")], "site_name string, xml string")
    assert [tuple(r) for r in index.sitemap(files).select("site_name", "url").collect()] == [("good", "https://h/a&b")]
    assert {r.site_name for r in index.sitemap_errors(files).collect()} == {"bad", "empty"}


def test_fetch_in_lanes(spark):
    pages = spark.createDataFrame([("h", f"https://h/{i}", 0.0, 3, "me") for i in range(20)] + [("h", None, None, None, None)], "site_name string, url string, crawl_delay double, max_concurrency int, user_agent string")
    got = http.fetch(pages, lambda m, u, h, s: http.Response(200, h["User-Agent"].encode()), 0.0, "other")
    assert {(r.http_status, r.html) for r in got.collect()} == {(200, "me")} and got.count() == 20


REPLY = json.dumps({"sections": [{"title": "Start", "url": "/docs/a", "priority": "core", "children": [{"title": "Blog", "url": "/docs/b"}]}]})


def test_discovery_from_pages(spark):
    html = "<nav class='sidebar'><a href='/docs/a'>Start</a></nav>"
    pages = spark.createDataFrame([("one", "https://one/", html), ("two", "https://two/", "<p>no navigation</p>"), ("three", "https://three/", None)], "site_name string, url string, html string")
    sites = spark.createDataFrame([("one", "https://one/"), ("two", "https://two/")], "site_name string, base_url string")
    listed = spark.createDataFrame([("one", "https://one/docs/c", 0), ("two", "https://two/docs/d", 0)], "site_name string, url string, rank long")
    nodes = nav.read_trees(pages, lambda prompt: REPLY)
    assert [(r.site_name, r.title, r.parent_id) for r in nodes.orderBy("node_id").collect()] == [("one", "Start", None), ("one", "Blog", 1)]
    found, stats = nav.discover(nodes, sites, listed)
    assert {(r.site_name, r.url, r.priority) for r in found.collect()} == {("one", "https://one/docs/a", "core"), ("one", "https://one/docs/b", "secondary"), ("one", "https://one/docs/c", "index"), ("two", "https://two/docs/d", "index")}
    assert [tuple(r) for r in stats.collect()] == [("one", 2, 1)]
    found, _ = nav.discover(nodes, sites, listed, exclude=["blog"])
    assert {(r.site_name, r.url) for r in found.collect()} == {("one", "https://one/docs/a"), ("two", "https://two/docs/d")}
    assert nav.read_trees(pages, lambda prompt: 1 / 0).count() == 0 == nav.read_trees(pages, None).count()


def test_feed_and_spin_by_the_manifest(spark, tmp_path, capsys, monkeypatch):
    from pagemill import cli

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "local_session", lambda *a: spark)
    (tmp_path / "pagemill.yaml").write_text("sites:\n  mine:\n    base_url: https://h.example/\n    allow_patterns: ['/guide/']\n    crawl_delay: 0.0\n    user_agent: agent-x\n")

    def transport(method, url, headers, seconds):
        if url.endswith("/llms.txt"):
            return http.Response(200, b"https://h.example/guide/a\nhttps://h.example/docs/b\nhttps://h.example/guide/gone\n")
        return http.Response(200, PAGE.encode()) if url.endswith("/a") and headers.get("User-Agent") == "agent-x" else http.Response(404)

    assert cli.main(["feed", "https://h.example/", "--site", "mine", "--skip-pipeline"], transport) == 0
    assert "stored\t2" in capsys.readouterr().out and not (tmp_path / "out").exists()
    cli.main(["store", "list", "store/mine"])
    shown = capsys.readouterr().out
    assert "ok\thttps://h.example/guide/a" in shown and "--\thttps://h.example/guide/gone" in shown
    cli.main(["spin", "store/mine", "--out", "o"])
    assert "passed\t1" in capsys.readouterr().out and (tmp_path / "o/h.example/guide/a.md").exists()


def test_lines_of_markdown():
    assert markdown.code_lines(["a", "```", "b", "~~~", "c"]) == [False, True, True, True, False]
    assert markdown.layout_tag("{% endcode %}") == ("code", True, True) == markdown.layout_tag(" {% /code % } ")
    assert markdown.layout_tag("{% content-ref url='a' %}")[0] == "content-ref" and markdown.layout_tag("{% other %}") is None
    assert markdown.layout_tag("{% tabs %} and more {% x %}")[2] is False
    assert markdown.heading("###### x ") == (6, "x") and markdown.heading("####### x") is None and markdown.heading("#x") is None


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    from pagemill import session

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    class Frame:
        sparkSession = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d: d})()})()

    with pytest.raises(RuntimeError):
        session.checkpoint(Frame())
