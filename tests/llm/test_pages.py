"""Operators on pages and conversations, and the pipeline."""

import hashlib
import math
import random
import re

import pytest

import corpus_pipeline
from gaugeflow.llm import chat, dom, queries, urls

SF = "/root/testdata/sf0.001"


def test_blocks_of_broken_markup():
    t = dom.Tree("<p><b>one &amp; two<br>three<p>four\n  five<script>if (a<b) {x()}</script><ul><li>six<li>seven</ul> tail &am")
    assert [b for _, b, _ in t.blocks] == ["one & two three", "four five", "six", "seven", "tail &am"]
    assert dom.Tree("").blocks == [] and dom.Tree("<script>var x = '<p>'").blocks == [] and dom.Tree("<!-- <p>no</p> --><td>a<td>b").blocks[-1][1] == "b"


@pytest.mark.parametrize("html, texts", [
    ("<p>if a <![ b then</p><p>second</p>", ["if a", "second"]), ("<p>a</p><![ endif]--><p>b</p>", ["a", "b"]), ("<p>a</p><![x y]><p>b</p>", ["a", "b"]), ("<p>a<![", ["a<!["]), ("<![endif]--><p>a</p><p>[b]></p>", ["a", "[b]>"]),
    ("<p>a &#" + "9" * 5000 + "; b</p><p>c</p>", ["a \ufffd b", "c"]), ("<p>&#" + "0" * 5000 + "65;</p><p>c</p>", ["A", "c"])])
def test_text_after_broken_declarations(html, texts):
    assert [b for _, b, _ in dom.Tree(html).blocks] == texts


def test_siblings_on_long_flat_pages():
    t = dom.Tree("<body>" + "".join(f"<p>{'x' * (k + 1)}</p>" for k in range(200)) + "<div>end</div></body>")
    keep, x = dom.features(t)
    at = {name: dom.NAMES.index(name) for name in ("place", "before", "after", "same_siblings")}
    rows = [r for k, r in zip(keep.tolist(), x, strict=True) if t.tag[k] in ("p", "div")]
    for k, r in enumerate(rows):
        want = {"place": k / 201, "before": math.log1p(k) if k else 0, "after": math.log1p(k + 2) if k < 199 else math.log1p(3) if k == 199 else 0, "same_siblings": math.log1p(200 if k < 200 else 1)}
        assert {name: r[c] for name, c in at.items()} == pytest.approx(want)


@pytest.fixture(scope="module")
def model(spark):
    return dom.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_main_text_of_all_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in dom.extract(pages, model).collect():
        t = dom.Tree(html[r.page_id])
        inside = [False] * len(t.tag)
        for k in range(1, len(t.tag)):
            inside[k] = inside[t.parent[k]] or t.tag[k] == "article"
        assert r.text == "\n".join(x for n, x, _ in t.blocks if inside[n])


def test_held_out_layouts(spark, model):
    right = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id >= 100").collect():
        t = dom.Tree(r.html)
        keep, _ = dom.features(t)
        good = dict(zip(keep.tolist(), dom.semantic_labels(t, keep).tolist(), strict=True))
        main, other = [b for n, b, _ in t.blocks if good.get(n)], [b for n, b, _ in t.blocks if not good.get(n)]
        new = dom.Tree(dom.layout(main, other + main, random.Random(r.page_id + 5)))
        keep, x = dom.features(new)
        label = dict(zip(keep.tolist(), dom.given_labels(new, keep).tolist(), strict=True))
        right += dom.decode(new, keep, dom.probabilities(model, x)) == [b for n, b, _ in new.blocks if label.get(n)]
        total += 1
    assert right >= 0.7 * total  # whole pages right, in layouts and with names the training did not make


def test_decoding_never_keeps_below_a_rejected_element():
    t = dom.Tree("<div><nav><p>a</p></nav><p>b</p></div>")
    keep, _ = dom.features(t)
    p = {"html": 0.9, "div": 0.9, "nav": 0.001, "p": 0.9}
    assert dom.decode(t, keep, dom.np.array([p[t.tag[k]] for k in keep])) == ["b"]


def test_odd_pages(spark, model):
    rows = [(1, None, None, "x"), (2, "u", "", "y"), (None, "v", "<p>text only here", "z"), (3, "w", "<article><p>" + "long " * 20_000 + "</p></article>", "n"), (3, "w", "<article><p>again</p></article>", "n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in dom.extract(pages, model).where("page_id IS NULL OR page_id < 3").collect()}
    assert got[1, None] == "" and got[2, "u"] == "" and len(dom.extract(pages, model).where("page_id = 3").collect()) == 2
    assert dom.extract(pages.limit(0), None).count() == 0 and dom.train(pages.where("page_id = 1")) is None


RULES = [urls.Rule("com/", "allow"), urls.Rule("example.com/en/", "block"), urls.Rule("www.example.com/en/", "allow"), urls.Rule("net/es/", "block")]


@pytest.mark.parametrize("url, host, path, rule", [
    ("http://Example.COM/en/1?x#y", "example.com", "/en/1", "example.com/en/"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("x://a.www.example.com/en/q", "a.www.example.com", "/en/q", "www.example.com/en/"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/"), ("http://a.com", "a.com", "", None), ("http://b.com?q=/x", "b.com", "", None), ("http://c.net/es", "c.net", "/es", None), ("http://com/z", "com", "/z", "com/"),
    ("no scheme", "", "", None), (None, "", "", None), ("http://É.com/a\nb", "É.com", "/a\nb", "com/"), ("a://b://c/d", "b:", "//c/d", None)])
def test_rules(spark, url, host, path, rule):
    row = urls.split_url(spark.createDataFrame([(1, url)], "page_id bigint, url string")).withColumn("fit", urls.longest_rule(RULES)).first()
    assert (row.host, row.path, row.fit and row.fit.rule) == (host, path, rule)


def test_template_tree(spark):
    rows, labels = [], []
    for i in range(400):
        kind = ("good", "spam")[i % 2]
        rows.append((i, f"http://h.org/{kind}/{i}/x", "clash"))
        labels.append((i, kind == "spam" and i % 20 != 1))
    rows += [(1000 + i, f"http://h.org/{'abcd'[i % 4]}{'xyz'[i % 3]}/page", "clash") for i in range(40)] + [(None, "http://h.org/spam/7/x", "c"), (5000, None, "c"), (5001, "http://h.org/" + "s/" * 40, "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    got = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame(labels, "page_id bigint, bad boolean"), []).collect()}
    assert len(got) == len(rows)
    assert got[0].template == "/good/*/*" and got[0].verdict == "allow" and got[1].template == "/spam/*/*" and got[1].verdict == "block" and got[None].verdict == "block"
    assert got[1000].template == "/*/*" and got[5001].template.endswith("/**") and got[5000].template == "" and got[5000].verdict == "allow"
    none = spark.createDataFrame([], "page_id bigint, bad boolean")
    assert {r.verdict for r in urls.judge(pages, none, []).collect()} == {"allow"} and urls.judge(pages.limit(0), none, RULES).count() == 0


def test_template_tree_on_large_hosts(spark):
    """A section's verdict depends on its own labels, not on how large its host is; digits in a name do not merge it."""
    part = [("good", False, 200), ("spam", True, 60), ("mp3", True, 100)]
    for large in (1, 25):
        rows = [(f"http://h.org/{kind}/{i}", bad) for kind, bad, n in part for i in range(n * (large if kind == "good" else 1))]
        rows += [(f"http://h.org/{k}{v}/x", bad) for k, v, bad in [("2024-05-", d % 9, True) for d in range(180)] + [("", 77, True)] * 30 + [("9f86d081884c7d65", "", True)] * 30]
        pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string")
        labels = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(rows)], "page_id bigint, bad boolean")
        seen = {(r.path.split("/")[1], r.template, r.verdict) for r in urls.judge(pages, labels, []).collect()}
        assert {("spam", "/spam/*", "block"), ("mp3", "/mp3/*", "block"), ("good", "/good/*", "allow")} <= seen
        assert {t for s, t, _ in seen if s[0] in "279"} == {"/*/x"} or {t for s, t, _ in seen if s[0] in "279"} == {"/*/*"}


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|a", "<\\\\|<|", "", "<<||", "\\", "a\nb", "<\\b|", "\\n", "<|im_start|>user\nx"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and not re.search(r"<\||\n", chat.escape_role(text))


def _digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_windows(spark):
    rng = random.Random(2)
    rows = [(1, 0, "system", "be brief", 0)] + [(1, k, ("user", "assistant")[k % 2], " ".join(["word"] * rng.randrange(0, 60)), 0) for k in range(1, 400)]
    rows += [(2, None, None, None, 0), (2, None, "assistant", "", 0), (None, 3, "assistant", "<|im_end|>", 0), (3, 1, "assistant", "tie b", 0), (3, 1, "assistant", "tie a", 0), (3, 1, "assistant", "tie a", 0), (4, 0, "assistant", "x " * 5000, 0)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, window int")
    made = chat.windows(table, queries.tokenizer_path(), 5, budget=512, history=64, reserve=160)
    by = {}
    for w in made.orderBy("conv_id", "window").collect():
        turns = chat.parse(w.text)
        assert len(turns) == w.turns and (w.conv_id == 4 or w.tokens <= 512)
        if w.conv_id == 1:
            assert turns[0] == ("system", "be brief")
            by.setdefault(1, []).extend(turns[w.repeated :])
            before = by[1][: len(by[1]) - len(turns[w.repeated :])]
            assert w.repeated == 0 or before[len(before) - (w.repeated - 1) :] == turns[1 : w.repeated]
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x, _ in rows if c == conv])
        said = "".join(x for _, r, x in turns if r == "assistant")
        r = back[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), _digest([t[1:] for t in turns]))
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.windows(table.limit(0), queries.tokenizer_path(), 2)).count() == 0


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        seen.append((name, before))
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            kept = docs.collect()
    texts = {r.doc_id: r.text for r in kept}
    for t in texts.values():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
        grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        assert not any(tuple(b[i : i + 10]) in grams for b in bench if len(b) >= 10 for i in range(len(b) - 9))
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(texts)
    first, repeats = {}, 0
    for k in sorted(texts):
        w = texts[k].lower().split()
        repeats += any(first.setdefault(tuple(w[i : i + 51]), k) != k for i in range(len(w) - 50))
    assert repeats == 0 and [n for n, _ in seen] == [n for n, _ in corpus_pipeline.STAGES]
    assert corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]
