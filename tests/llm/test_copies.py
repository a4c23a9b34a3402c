import random

from pagemill.llm import copies

SCHEMA = "record_id long, url string, content_hash string, key string, salt int, id long"


def rows(*items):
    return [(i, u, h, "clash", 1, 9) for i, u, h in items]


def brute(items):
    def squeeze(t):
        return "".join(c for c in (t or "").lower() if c.isalnum())

    groups = {}
    for i, u, h in items:
        if squeeze(h):
            base, _, q = (u or "").partition("?")
            q = q.split("#")[0].replace("&amp;", "&")
            fields = sorted(f for part in q.split("&") for f in map(squeeze, part.split(";")) if f)
            groups.setdefault((squeeze(base), tuple(fields), squeeze(h)), []).append(i)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def spellings(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = 0 if r.random() < 0.4 else r.randrange(30)
        q = [f"a={k % 3}", "b=x", "c=Y"]
        r.shuffle(q)
        u = f"https://Host.example/p-{k}?{r.choice(['&', ';', '&amp;']).join(q)}"
        u = r.choice([u, u.upper(), f" <{u}> ", u.replace("/p-", "//p_"), u + "#"])
        h = f"{k:04x}ab"
        h = r.choice([h, h.upper(), h[:2] + "-" + h[2:], None, "", " - "]) if r.random() < 0.5 else h
        out.append((i, u, h))
    return out


def test_pairs_match_brute_force_on_both_paths(spark):
    items = spellings(400, 1)
    df = spark.createDataFrame(rows(*items), SCHEMA)
    want = brute(items)
    for hot in (1, 3, 10_000):  # all hot, some hot, none hot
        got = [tuple(r) for r in copies.copies(df, hot=hot, salts=3).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_collapse_counts_every_record_once(spark):
    items = spellings(300, 2)
    df = spark.createDataFrame(rows(*items), SCHEMA)
    for hot in (2, 10_000):
        got = {r.record_id: r.copies for r in copies.collapse(df, hot=hot, salts=4).collect()}
        assert sum(got.values()) == len(items)
        assert len(got) == len(items) - len(brute(items))


def test_nulls_repeats_and_empty_table(spark):
    items = [(1, None, "aa"), (2, "", "A A"), (3, None, None), (4, "u?x=1&y=2", "ff"), (4, "u?y=2&x=1", "ff"), (5, "u?x=12&y=", "ff"), (None, "u", "aa")]
    df = spark.createDataFrame(rows(*items), SCHEMA)
    assert {tuple(r) for r in copies.copies(df).collect()} == {(1, 2)}
    assert copies.copies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert copies.collapse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_values(spark):
    u = "https://h.example/" + "a-" * 200_000
    df = spark.createDataFrame(rows((1, u, "x" * 100_000), (2, u.upper(), "X" * 100_000)), SCHEMA)
    assert [tuple(r) for r in copies.copies(df).collect()] == [(1, 2)]


def test_fields_set_apart_by_semicolons(spark):
    items = [(1, "https://h.example/a?os=linux;tab=ui;lang=en", "f0"), (2, "https://h.example/a?lang=en&os=linux&tab=ui", "F-0"), (3, "https://h.example/a?lang=en&amp;tab=ui;os=linux", "f0"), (4, "https://h.example/a?lang=en", "f0")]
    assert {tuple(r) for r in copies.copies(spark.createDataFrame(rows(*items), SCHEMA)).collect()} == {(1, 2), (1, 3)}
