import random
from collections import Counter

from pagemill.llm import sentences

NAMES = "Arven Belto Corin Dalmo Esker Fintu".split()


def corpus(n, seed):
    """Documents with known sentences: abbreviations, numbers, quotations, languages."""
    r = random.Random(seed)

    def one():
        a, k = r.choice(NAMES), r.randint(1, 99)
        return r.choice(
            [
                f"Dr. {a} measured {k}.5 ms for each run.", f"See Fig. {k} and the notes of {a}.", f"Why does {a} wait for {k} seconds?", f'"Start {a} first." is the usual advice.', f"The log said \"all {a} lost.\"",
                f"Never delete {a.lower()}.cfg now!", f"It costs {k} more, e.g. in {a} shops.", f"({a} is closed.)", f"Wait... {a} may still run.", f"Items, parts, etc. and {a} are kept by Prof. {r.choice(NAMES)}.",
            ]
        )

    def zh():
        return r.choice([f"为什么{r.choice(NAMES)}很慢？", "不要删除文件！", f"操作员说：“{r.choice(NAMES)}已丢失。”", "安装程序问：“准备好了吗？”然后等待。"])

    docs = []
    for i in range(n):
        f, gap = (zh, "") if i % 4 == 0 else (one, " ")
        lines = [[f() for _ in range(r.randint(1, 4))] for _ in range(r.randint(2, 5))]
        docs.append(("\n".join(gap.join(x) for x in lines), [s for x in lines for s in x]))
    return docs


def test_held_out_accuracy(spark):
    train, held = corpus(600, 1), corpus(150, 2)
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(train)], "doc_id long, text string, token string")
    fitted = sentences.fit(df, sample=600)
    hit = got = want = 0
    for text, true in held:
        out = [text[a:b] for a, b in sentences.split(text, *fitted)]
        hit += sum((Counter(out) & Counter(true)).values())
        got += len(out)
        want += len(true)
    assert hit / got > 0.97 and hit / want > 0.97


def test_offsets_cover_every_line(spark):
    rows = [(1, "  A b c. \r\n\r\n- item one\n　x ", ""), (2, None, ""), (3, " \n\t", ""), (4, "", ""), (1, "same", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = {(r.doc_id, r.start_char, r.end_char) for r in sentences.sentences(df).collect()}
    assert got == {(1, 2, 8), (1, 13, 23), (1, 25, 26), (1, 0, 4)}


def test_candidates():
    def ends(line):
        found, last = sentences.candidates(line)
        return [line[: c.end] for c in found], last is not None

    assert ends("Open a.txt at 7.5 now.") == ([], True)
    assert ends("He said “x.” Then (y.) z") == (["He said “x.”", "He said “x.” Then (y.)"], False)
    assert ends("1. item. Next") == (["1. item."], False)
    assert ends("„A b.“ So c.")[0] == ["„A b.“"]
    assert ends("是吗？“走。”他说。")[0] == ["是吗？", "是吗？“走。”"]


def test_empty_table_and_long_text(spark):
    schema = "doc_id long, text string"
    assert sentences.sentences(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a" * 300_000 + ". " + "B " * 100_000)], schema)
    assert sentences.sentences(df).count() >= 1


def test_token_classes_agree_with_the_counts(spark):
    train = corpus(300, 3)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train)], "doc_id long, text string")
    _, ends, starts = sentences.fit(df, sample=100)
    for side, token, hits, n in sentences.token_counts(df).collect():
        got = (ends if side == "e" else starts)(token)
        want = "?" if n < 4 else ("0" if n >= 12 else "~") if not hits else "1" if hits / n < 0.01 else "2" if hits / n < 0.08 else "3"
        assert got == want
    assert ends("never seen") == "?"


def test_without_examples_the_prior_decides(spark):
    df = spark.createDataFrame([(1, "One ends here. Two ends there. but not here")], "doc_id long, text string")
    assert sorted((r.start_char, r.end_char) for r in sentences.sentences(df).collect()) == [(0, 14), (15, 43)]
    assert sentences._prev_token("x " + "é" * 90 + ".", 92) == "é" * 90


def test_tokens_over_the_bound_are_joined(spark):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(300, 5))]
    df = spark.createDataFrame([*rows, *rows[:20], (1, None), (2, "")], "doc_id long, text string")
    model, ends, starts = sentences.fit(df)
    bounded, few_ends, few_starts = sentences.fit(df, most=5)
    assert 0 < len(few_ends.digests) <= 5 < len(ends.digests) and 0 < len(few_starts.digests) <= 5 < len(starts.digests)
    assert bounded.index == model.index and (bounded.weights == model.weights).all()
    whole, *others = (Counter(map(tuple, sentences.sentences(df, **x).collect())) for x in ({}, {"most": 5}, {"most": 0}))
    assert whole.total() > 2000 and all(x == whole for x in others)
