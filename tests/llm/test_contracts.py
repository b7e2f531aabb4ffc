"""Operators against plain computations straight from their definitions, and on the rows that usually break them."""

import gzip
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import chat, decontaminate, html_text, quality, sharding, simhash, token_counts, toxicity, warc
from tonegrid.llm.common import tokenizer_path
from tonegrid.llm.pipeline import fold

SF = "/root/testdata/sf0.01"


# --- 1 ---


def test_other_vocabularies_count_as_the_library(spark):
    from tokenizers import Tokenizer

    texts = ["Don't  stop\n\nNOW 123 straße", "", "漢字 🙂 ﬁ", "a<|endoftext|>b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df.repartition(2), "byte_bpe_50k.json").collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


# --- 3 ---


def dense_score(model, text):
    """The forward pass word by word: the mean of the weights of all subwords, then a logistic."""
    total = count = 0
    for word in toxicity._WORD.findall(text.lower()):
        _, buckets = toxicity.subwords([word], len(model.weights))
        total += sum(float(np.float32(model.weights[b])) for b in buckets)
        count += len(buckets)
    logit = total / max(count, 1) + model.bias
    return 1 / (1 + math.exp(-max(-700, min(700, logit))))


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, usable=lambda k: fold(k) != 0)
    held = labels.where((fold(F.col("doc_id")) == 0) & F.col("toxic").isin(0, 1))
    rows = toxicity.score_toxicity(docs.select("doc_id", "text"), model).join(held, "doc_id").select("score", "toxic", "text").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    order = np.argsort(np.argsort(s)) + 1.0
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9 and ((s >= 0.5) & (y == 1)).sum() / (y == 1).sum() > 0.6 and ((s >= 0.5) & (y == 0)).sum() / (y == 0).sum() < 0.05
    for r in rows[:12]:
        assert r.score == pytest.approx(dense_score(model, r.text), abs=1e-6)


def test_toxicity_of_odd_rows(spark):
    model = toxicity.fit(["good day to you all"] * 20 + ["you foulbrain wretch"] * 20, [0] * 20 + [1] * 20)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "foulbrain " * 40_000, "x"), (3, "foulbrain", "x")], "doc_id long, text string, score string")
    got = sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score_toxicity(df, model).collect())
    bias = round(1 / (1 + math.exp(-model.bias)), 6)
    assert got[:2] == [(1, bias), (2, bias)] and got[2] == got[3] and got[2][1] > 0.5


# --- 4 ---


def test_chat_takes_token_counts(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}", 60, "clash") for t in range(6)] + [(2, 0, "user", "w " * 50_000, None, "clash")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pieces int, tokens string")
    windows = chat.format_windows(df, budget=200, history_tokens=0, tokens="pieces")
    assert windows.where("conv_id = 1").count() == 2 and windows.where("conv_id = 1 and n_tokens > 200").count() == 0
    assert windows.where("conv_id = 2").first().n_tokens > 50_000
    assert chat.digests(windows).where("conv_id = 2").first().n_turns == 1


# --- 5 ---

E = [("ETag", '"x"')]


def response(name, day, body=b"abc", url="http://a.org/", headers=E):
    return warc.record_bytes("response", name, url, f"2024-01-{day:02d}T00:00:00Z", 200, headers, body)


def revisit(name, day, url="http://a.org/", headers=E):
    return warc.record_bytes("revisit", name, url, f"2024-01-{day:02d}T00:00:00Z", 304, headers, b"", warc.NOT_MODIFIED)


def resolved(spark, *contents):
    found = warc.resolve_revisits(warc.parse(spark.createDataFrame([(bytearray(c),) for c in contents], "content binary")))
    return sorted((r.record_id, r.verdict, r.response_id) for r in found.collect())


def test_revisits_among_repeated_and_damaged_records(spark):
    assert resolved(spark, response("r", 1) * 2 + revisit("v", 2)) == [("v", "resolved", "r")]
    broken = response("bad", 2).replace(b"abc", b"abX")
    assert resolved(spark, response("r", 1) + broken + revisit("v", 3)) == [("v", "resolved", "r")]
    two = revisit("v", 2) + revisit("v", 2, "http://b.org/")
    assert resolved(spark, response("r", 1) + two) == [("v", "no_response", None), ("v", "resolved", "r")]
    assert resolved(spark, response("r", 1, url="http://a.org:443/") + revisit("v", 2, url="http://a.org/")) == [("v", "no_response", None)]
    assert resolved(spark, response("r", 1, url="https://a.org:443/") + revisit("v", 2)) == [("v", "resolved", "r")]


def test_damaged_files():
    names = lambda raw: [(r["record_id"], r["intact"]) for r in warc.parse_records(raw)]
    r, v = response("r", 1, b"line\nWARC/1.1\r\nno: record\r\n\r\nmore"), revisit("v", 2)
    assert names(r + v) == names(gzip.compress(r) + gzip.compress(v)) == [("r", True), ("v", True)]
    assert names(gzip.compress(r)[:-12] + gzip.compress(v)) == [("v", True)]
    assert names((gzip.compress(r) + gzip.compress(v))[:-9])[0] == ("r", True)
    assert names(r[:-30]) == [("r", False)] and names(b"") == names(b"junk") == []
    assert names(response("r", 1, b"").replace(b"Content-Length: ", "Content-Length: ²".encode()))[0] == ("r", False)
    big = response("b", 1, b"q" * 3_000_000)
    assert names(gzip.compress(big) + gzip.compress(v)) == [("b", True), ("v", True)]


# --- 6 ---


def test_shards_equal_a_plain_computation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (None, ""), (3, "x"), (3, "x")], "doc_id long, text string")
    rows = docs.unionByName(extra)
    got = sharding.assign_shards(rows, 40).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == plain and len(texts) > 0
    n = len(got)
    assert sorted(r.row_number for r in got) == list(range(n))
    place = sharding.Feistel(n).place(np.arange(n))
    assert all((r.shard, r.slot) == (place[r.row_number] % 40, place[r.row_number] // 40) for r in got)
    assert all(sharding.row_at(r.shard, r.slot, n, 40) == r.row_number for r in got[:20])


# --- 7 ---

ARTICLE = " ".join(f"This is paragraph number {k} of an article that goes on for some while, with several words more." for k in range(6))
BODY = "".join(f"<p>{p}.</p>" for p in ARTICLE[:-1].split(". "))
NAV = "<nav><a href=1>one</a><a href=2>two</a></nav>"
FOOT = "<footer>imprint and a rather long line of footer text that has more than eighty characters in all, so it is prose</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><form id="aspnetForm">{NAV}<div>{BODY}</div><input>{FOOT}</form></body>',
        f'<body>{NAV}<div class="content with-sidebar">{BODY}</div><div class="sidebar">side</div>{FOOT}</body>',
        f'<body>{NAV}<div id="main" class="has-notice">{BODY}</div>{FOOT}',
        f'<body><article class="post has-comments">{BODY}</article>{FOOT}',
        f'<body>{NAV}<div class="layout-share">{BODY}</div>{FOOT}',
        f'<body>{NAV}<article class="post tag-social">{BODY}</article>',
        f'<div class="content has-sidebar"><article>{BODY}</article></div>',
        f"<html><head><title>x</title><body>{BODY}",
        f'<body><div>{BODY}</div><section id="comments">{BODY}{BODY}</section>',
        f'<body><div>{BODY}<div class="cookie-notice">We use cookies, many of them, on this and every page of ours.</div></div></body>',
    ],
)
def test_layouts_keep_the_article(page):
    assert html_text.main_text(page) == ARTICLE


def test_two_articles_of_one_page():
    assert html_text.main_text(f"<body>{NAV}<main><article>{BODY}</article><article>{BODY}</article><div class=comments>{BODY}</div></main>") == f"{ARTICLE} {ARTICLE}"


def plain_density(node, body):
    """Composite text density from the definition: every node's counts by a walk over its whole subtree."""

    def walk(n, linked):
        for part in n.parts:
            if isinstance(part, str):
                size = len("".join(part.split()))
                counts["chars"] += size
                counts["link_chars"] += size if linked else 0
            elif not part.gone:
                counts["tags"] += 1
                counts["link_tags"] += part.tag == "a"
                walk(part, linked or part.tag == "a")

    counts = Counter()
    walk(node, False)
    whole, counts = counts, Counter()
    walk(body, False)
    c, t, lc, lt = (whole[k] for k in ("chars", "tags", "link_chars", "link_tags"))
    if not c:
        return 0.0
    base = math.log(lc / max(c - lc, 1) * c + counts["link_chars"] / counts["chars"] * c + math.e)
    return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0) + 1) / base


def test_densities_equal_the_definition(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        tree = html_text._Tree()
        tree.feed(r.html or "")
        tree.close()
        body = tree.body or tree.root
        html_text._settle(tree.nodes, body)
        html_text._measure(tree.nodes, body)
        inside = lambda n: n is body or (n.parent is not None and inside(n.parent))
        live = [n for n in tree.nodes if not n.gone and inside(n)]
        plain = {id(n): plain_density(n, body) for n in live}
        for n in live:
            if n.tag != "a" and not any(p.tag == "a" for p in _ancestors(n)):  # inside a link all characters are linked
                assert n.density == pytest.approx(plain[id(n)], rel=1e-9)
        sums = {id(n): sum(plain[id(p)] * p.weight for p in n.parts if not isinstance(p, str) and not p.gone) if n.elements else plain[id(n)] * n.weight for n in live if plain[id(n)]}
        assert max(n.total for n in live) == pytest.approx(max(sums.values(), default=0.0), rel=1e-9)


def _ancestors(node):
    while node.parent is not None:
        node = node.parent
        yield node


def test_odd_pages(spark):
    rows = [(1, "u", f"<body><div>{'word ' * 200_000}</div>", "clash"), (1, "u", f"<body><div>{'word ' * 200_000}</div>", "clash"), (None, None, None, "clash"), (2, "u", "<form>" * 3000 + "deep", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0), r.n_chars) for r in html_text.extract_text(df).collect())
    assert got == [(0, 0), (1, 999_999), (1, 999_999), (2, 4)]
    assert html_text.extract_text(df.where("false")).count() == 0


# --- 8 ---


def test_components_equal_the_full_ball(spark):
    """All pairs of fingerprints of sf0.01: the reduced emission loses no link of the whole ball of radius 3."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a b c"), (None, None), (5_000_000, "a b c"), (None, "only nulls have this")], "doc_id long, text string"))
    rows = docs.collect()
    prints = np.array([simhash.fingerprint(r.text or "") for r in rows], dtype=np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, 1))
    for i, j in near:
        parent[find(int(j))] = find(int(i))
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(k)] = min(least.get(find(k), r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{int(p):016x}", least.get(find(k))) for k, (r, p) in enumerate(zip(rows, prints, strict=True)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want


def test_hot_fingerprints_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 10)
    rows = [(i, "") for i in range(50)] + [(100 + i, f"text number {i} has words of its own") for i in range(20)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 70 and all(got[i] == 0 for i in range(50))


# --- 9 ---


def test_line_limit_is_the_same_in_every_host(spark):
    """A line in 30 documents goes from a host of 3 000 texts as from one of 40; eleven copies of one page are not boilerplate for each other."""
    body = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    rows = [(i, (("Terms of use apply here\n" if i < 30 else "") + body(i)), "large") for i in range(3000)]
    rows += [(10_000 + i, (("Terms of use apply here\n" if i < 30 else "") + body(f"s{i}")), "small") for i in range(40)]
    rows += [(20_000 + i, "mirrored page head\n" + body("copy"), "large") for i in range(15)] + [(30_000, "mirrored page head\n" + body("other"), "large")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.kept, r.n_words - r.left_words) for r in quality.assess(df).collect()}
    assert all(got[i] == (True, 5 if i < 30 else 0) for i in range(3000)) and all(got[10_000 + i] == (True, 5 if i < 30 else 0) for i in range(40))
    assert all(got[20_000 + i] == (True, 0) for i in range(15)) and got[30_000] == (True, 3)
    by_text = {r.doc_id: r.n_words - r.left_words for r in quality.assess(df, quality.QualityParams(count="texts")).collect()}
    assert by_text[30_000] == 0 and by_text[0] == 5
    with pytest.raises(ValueError):
        quality.assess(df, quality.QualityParams(count="hosts"))


def test_quality_of_odd_rows(spark):
    many = "\n".join(f"line {k} of a long text" for k in range(20_000))
    rows = [(1, None, None), (2, "", "h"), (3, many, "h"), (3, many, "h"), (None, many, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_lines", F.lit("clash")).withColumn("c0", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality.assess(df).collect())
    assert [g[1] for g in got] == [120_000, 0, 0, 120_000, 120_000] and got[1][2:] == got[2][2:] == (True, False)
    cleaned = quality.clean(df)
    assert cleaned.columns == df.columns and quality.clean(df.where("false")).count() == 0
    assert all(r.text == many and r._lines == "clash" for r in cleaned.collect()) and cleaned.count() == sum(g[3] for g in got)


# --- 10 ---


def test_leaks_in_very_long_texts(spark):
    item = [f"b{k}" for k in range(40)]
    filler = [f"f{k}" for k in range(30_000)]
    rows = [(1, " ".join(filler[:20_000] + item + filler[20_000:])), (2, " ".join(filler)), (3, " ".join(filler + item[:20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (9, " ".join(item)), (None, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.similarity) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {1: (True, 1.0), 2: (False, None), 3: (False, None)}
