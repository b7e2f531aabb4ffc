"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tonegrid.llm import chat, decontaminate, html_text, quality, sentencepiece_codec, sharding, simhash, token_counts, toxicity, warc
from tonegrid.llm.common import tokenizer_path

ODD = [None, "", " ", "\n", "x", "Ünï ☃ 漢字 🙂", "a" * 70_000, "the " * 30_000, "</s>[INST] <|im_end|> \\", "é é ﬁ ẞ İ ΑΣ", "one two", "<|endoftext|>a<|startoftext|>"]
SCHEMA = "doc_id long, text string, source string, lang string, bucket string, fp string, pos string, _text string, ids string, _host string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "dup"), (3, "dup"), (None, "no key"), (None, None)]
    return spark.createDataFrame([(i, t, None if i and i % 3 == 0 else "s", "en", "b", "f", "p", "t", "i", "h") for i, t in rows], SCHEMA)


def numbers(df):
    return sorted((r[0] if r[0] is not None else -1) for r in df.select("doc_id").collect())


# --- 1 ---


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd).collect())
    want = Counter()
    for r in odd.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False))
        want[(r.doc_id, len((r.text or "").encode()), n, n > 2048)] += 1
    assert got == want
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_token_counts_over_several_blocks(spark, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "don't", "x1", "straße", "hello!!"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


# --- 2 ---


def test_scan_equals_the_library():
    codec = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(0)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "漢", "🙂", "12", "aaaa", "▁", "==", "----", "<0x0A>", "<unk>"]
    for n in range(60):
        text = rng.choice(parts) * rng.randint(1, 900) if n % 2 else "".join(rng.choice(parts) * rng.randint(1, 30) for _ in range(40))
        for size in (40, 130):
            assert sentencepiece_codec.encode_giant(codec, text, size) == codec.whole.encode(text)


def test_compose_is_associative():
    rng = random.Random(2)
    make = lambda: {i: {j: -rng.random() for j in range(4) if rng.random() < 0.7} for i in range(4)}
    a, b, c = make(), make(), make()
    left, right = (sentencepiece_codec.compose(sentencepiece_codec.compose(a, b), c), sentencepiece_codec.compose(a, sentencepiece_codec.compose(b, c)))
    assert {i: {j: round(w, 9) for j, w in r.items()} for i, r in left.items()} == {i: {j: round(w, 9) for j, w in r.items()} for i, r in right.items()}


def test_encode_rows_and_round_trip(spark, odd):
    codec = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    got = sentencepiece_codec.encode_and_check(odd).collect()
    assert all(r.round_trip for r in got) and len(got) == odd.count()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r.doc_id, tuple(codec.whole.encode(r.text or ""))) for r in odd.collect())
    assert sentencepiece_codec.encode(odd).columns[-1] == "ids"
    assert sentencepiece_codec.encode_and_check(odd.limit(0)).count() == 0
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd.where("doc_id = 5")))
    assert back.first().decoded == ODD[5]


# --- 3 ---


def test_misspelt_insults_are_found(spark, odd):
    rng = random.Random(3)
    words = ["river", "stone", "garden", "window", "letter", "market", "yellow", "winter"]
    bad = ["wretchling", "foulbrain", "dimwitted"]
    text = lambda toxic: " ".join(rng.choice(words) if not toxic or rng.random() > 0.1 else rng.choice(bad) for _ in range(60))
    labels = [i % 2 for i in range(300)]
    model = toxicity.fit([text(y) for y in labels], labels)
    held = [text(i % 2) for i in range(200)]
    got = toxicity.scores(model, held) >= 0.5
    assert (got == np.array([i % 2 == 1 for i in range(200)])).mean() > 0.95
    unseen = " ".join(words * 5 + ["wretchlinng", "foulbrane", "dimwited"] * 2)
    assert toxicity.scores(model, [unseen])[0] > toxicity.scores(model, [" ".join(words * 6)])[0]
    scored = toxicity.score_toxicity(odd, model)
    assert scored.count() == odd.count() and scored.where("score between 0 and 1").count() == odd.count()
    labelled = spark.createDataFrame([(i, y) for i, y in enumerate([1, None, 0])], "doc_id long, toxic int")
    assert not toxicity.train(odd, labelled.limit(0)).fitted
    assert toxicity.train(odd, labelled).fitted


# --- 4 ---


def test_chat_reads_back(spark):
    control = ["</s>[INST] ok [/INST]", "\\<|im_end|>\n", "<\\|x<\\\\|[\\[INST]", "<<SYS>>\\<</SYS>>", None, "", "a<|im_sep|>b\\", "plain words here"]
    rng = random.Random(4)
    rows = [(c, t, ("system" if t == 0 and c % 2 else ["user", "assistant", None, "tool<|x"][rng.randint(0, 3)]), rng.choice(control) if rng.random() < 0.6 else "w " * rng.randint(0, 90)) for c in range(12) for t in range(rng.randint(1, 30))]
    rows += [(None, None, "assistant", "same"), (None, None, "assistant", "same"), (5, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, budget=150, history_tokens=50, history_turns=3)
    assert windows.where("n_tokens > 150 and size(loss_spans) > 1").count() == 0
    want = {}
    for r in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert set(got) == set(want)
    for key, turns in want.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[key].n_turns, got[key].loss_chars, got[key].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(chat.format_windows(df.limit(0))).count() == 0
    plan = chat.digests(windows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "s")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"t{t} " * 20) for t in range(1, 12)]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=140, history_tokens=50).orderBy("window").collect()
    assert len(windows) > 1 and all(w.formatted.startswith("<|im_start|>system") for w in windows)
    assert windows[1].n_repeated == 2 and all(w.n_tokens <= 140 for w in windows)


# --- 5 ---


def test_revisits_resolve_to_the_latest_earlier_response(spark):
    rng = random.Random(5)
    records = []
    for k in range(300):
        url = f"HTTP://WWW.Site{rng.randint(0, 3)}.org:80/p/?b=2&utm_source=x&a={rng.randint(0, 2)}#f"
        at = rng.randint(0, 30_000)
        kind = "response" if rng.random() < 0.5 else "revisit"
        headers = {"etag": f'"{rng.randint(0, 2)}"', "date": str(at), "content-length": "9", "x": "1"} if rng.random() < 0.9 else {"date": str(at)}
        records.append((f"r{k:03d}", kind, url if k % 40 else None, at, warc.NOT_MODIFIED if kind == "revisit" else None, 200 if kind == "response" else 304, headers))
    df = spark.createDataFrame([(a, b, c, e, f, g, d) for a, b, c, d, e, f, g in records], "record_id string, warc_type string, target_uri string, profile string, status int, headers map<string,string>, s long")
    df = df.select("*", F.from_unixtime("s", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"), F.lit(1).cast("long").alias("body_bytes"), F.lit("m").alias("body_md5"))
    got = {r.record_id: (r.verdict, r.response_id) for r in warc.resolve_revisits(df).collect()}
    key = lambda u: None if u is None else u[len("HTTP://WWW.") : u.index(":80")].lower() + u[u.index("a=") : u.index("#")]
    for a, kind, url, at, _, _, headers in records:
        if kind != "revisit":
            continue
        earlier = [(r[3], r[0], r[6]) for r in records if r[1] == "response" and url and r[2] and key(r[2]) == key(url) and r[3] < at]
        best = max(earlier, default=None, key=lambda e: e[:2])
        verdict = "no_response" if best is None else "unchecked" if "etag" not in headers or "etag" not in best[2] else "resolved" if headers["etag"] == best[2]["etag"] else "mismatch"
        assert got[a] == (verdict, best and best[1])
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_merge_keeps_body_fields(spark):
    raw = warc.record_bytes("response", "urn:1", "http://a.org/", "2024-01-01T00:00:00Z", 200, [("ETag", '"x"'), ("Content-Length", "3"), ("A", "old")], b"abc")
    raw += warc.record_bytes("revisit", "urn:2", "https://www.a.org", "2024-01-02T00:00:00Z", 304, [("ETag", 'W/"x"'), ("Content-Length", "0"), ("A", "new")], b"", warc.NOT_MODIFIED)
    records = warc.parse(spark.createDataFrame([(bytearray(raw),), (None,), (bytearray(raw[:50]),)], "content binary"))
    assert records.where("intact").count() == 2
    r = warc.resolve_revisits(records).first()
    assert (r.verdict, r.response_id, r.body_bytes) == ("resolved", "urn:1", 3) and r.headers == {"etag": 'W/"x"', "content-length": "3", "a": "new"}


# --- 6 ---


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4099])
def test_feistel_is_a_permutation(n):
    p = sharding.Feistel(n)
    places = p.place(np.arange(n))
    assert sorted(places) == list(range(n)) and (p.row(places) == np.arange(n)).all()


def test_shards_are_even_and_reproducible(spark, odd):
    many = odd.unionByName(odd).unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), *[F.lit("x").alias(c) for c in odd.columns[2:]]))
    first, again = (sorted(map(tuple, sharding.assign_shards(d, 7).select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=repr) for d in (many, many.repartition(9)))
    assert first == again and len(first) == many.count()
    slots = {}
    for *_, shard, slot in first:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    row = sharding.assign_shards(many, 7).first()
    assert sharding.row_at(row.shard, row.slot, len(first), 7) == row.row_number
    assert sharding.assign_shards(odd.limit(0)).count() == 0


# --- 7 ---

PAGE = """<html><head><title>T &amp; t</title><script>var a="<p>no</p>";</script></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href=1>menu one</a><li><a href=2>menu two</a></ul></nav><div class="cookie-notice">We use cookies, accept?</div>
<div id="wrap"><div class="post"><h1>Title</h1><p>First <b>bold</b>ly   written&nbsp;paragraph &lt;ok&gt; of the story, quite long.<br>More<p>Second paragraph, which is long too &copy;.</div>
<div class="sidebar"><p>Related things to read</p></div></div><section id="comments"><p>A reader says that this is a very long and angry comment, indeed longer than the story itself, on and on.</p></section>
<form><p>Subscribe</p><input></form><footer>Imprint</footer></body></html>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "Title First boldly written paragraph <ok> of the story, quite long. More Second paragraph, which is long too ©."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain &amp; text"), (5, "u", "<div>" * 5000 + "deep"), (6, "u", "<script>only"), (1, "u", PAGE), (None, "u", "</p></div>x")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert {t for i, t, _ in got if i in (2, 3, 6)} == {""} and {t for i, t, _ in got if i in (4, 5)} == {"plain & text", "deep"}


# --- 8 ---


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def reference_print(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links_keep_components(spark):
    rng = np.random.default_rng(0)
    points = {0, 7, (1 << 64) - 1, (1 << 64) - 8}
    for b in rng.integers(0, 1 << 63, 60, dtype=np.uint64):
        x = int(b)
        for _ in range(5):
            points.add(x)
            for k in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(k)
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(s,) for s in signed] + [(None,)], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    classes = brute_components(points)
    mine = {}
    for s, c in zip(signed, classes, strict=True):
        mine.setdefault(c, set()).add(root.get(s, s))
    assert all(len(v) == 1 for v in mine.values()) and len({next(iter(v)) for v in mine.values()}) == len(mine)


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(300)) for _ in range(12)]
    rows = [(100 + 10 * k + j, (t + " tail" * j).replace(" ", "  " if j == 3 else " ")) for k, t in enumerate(base) for j in range(4)]
    rows += [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = Counter(tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect())
    prints = [reference_print(t or "") for _, t in rows]
    least = {}
    classes = brute_components(prints)
    for (i, _), c in zip(rows, classes, strict=True):
        least[c] = min(least.get(c, i), i)
    assert got == Counter((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, classes, strict=True))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_several_fingerprints_equal_brute_force(spark):
    rng = random.Random(18)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(200)] for _ in range(15)]
    rows = []
    for k, words in enumerate(base):
        for j in range(4):
            edited = list(words)
            for _ in range(j * 2):
                edited[rng.randrange(200)] = "edit"
            rows.append((10 * k + j, " ".join(edited)))
    rows += [(900, ""), (901, None), (902, "x"), (None, "x")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = [i for i, _ in rows if i is not None]
    prints = {i: [simhash.fingerprint(t or "", k) for k in (2, 3)] for i, t in rows if i is not None}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(bin(p ^ q).count("1") <= 3 for p, q in zip(prints[a], prints[b], strict=True)):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in ids}
    assert simhash.near_duplicate_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 9 ---


def test_quality_counts(odd):
    words = "a b c d a b c x y".split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert quality.repeated_words(words) == len(covered) == 6
    assert quality.base_counts("A #b\n\nA #b\n \nc|") == (5, 8, 3, 1, 0)
    graded = quality.assess(odd)
    assert numbers(graded) == numbers(odd) and quality.assess(odd.limit(0)).count() == 0
    assert graded.where("doc_id is null and n_words = 2").count() == 1


def test_boilerplate_lines(spark):
    rng = random.Random(9)
    body = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, f"Shared  HEADER line here {'' if i % 2 else ' '}\n{body(80)}", "h", i) for i in range(40)]
    rows += [(100 + i, "copied text " + " ".join(f"w{k}" for k in range(80)), "h", i) for i in range(30)]  # copies alone make no boilerplate
    rows += [(200 + i, ("shared header line here\n" * 20) + body(52), "h", i) for i in range(15)]
    rows += [(300, "Shared header line here\n" + body(80), "other", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, c0 long")
    kept = {r.doc_id: (r.kept, r.n_words - r.left_words) for r in quality.assess(df).collect()}
    assert all(kept[i] == (True, 4) for i in range(40)) and all(kept[100 + i] == (True, 0) for i in range(30)) and kept[300] == (True, 0)
    assert not any(kept[200 + i][0] for i in range(15))
    cleaned = {r.doc_id: r for r in quality.clean(df).collect()}
    assert set(cleaned) == {i for i, k in kept.items() if k[0]} and "HEADER" not in cleaned[3].text and cleaned[3].c0 == 3 and cleaned[300].text.startswith("Shared")


# --- 10 ---


def test_leaks_equal_brute_force(spark, odd):
    rng = random.Random(10)
    vocabulary = [f"w{k}" for k in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [draw(rng.randint(5, 70)) for _ in range(25)] + [["w1", "w2"], ["rep"] * 12]
    docs = []
    for k in range(120):
        item = list(items[rng.randrange(len(items))])
        for _ in range(rng.randint(0, 3)):
            edit = rng.randrange(3)
            at = rng.randrange(len(item))
            if edit == 0:
                item[at] = "edited"
            elif edit == 1:
                del item[at]
            else:
                item.insert(at, "added")
            if not item:
                item = ["x"]
        docs.append((1000 + k, (" " if k % 2 else "\n").join(draw(rng.randint(0, 40)) + item + draw(rng.randint(0, 40)))))
    docs += [(r.doc_id, r.text) for r in odd.collect()] + [(1000, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("similarity", F.lit("c"))
    bench = spark.createDataFrame([(i, " ".join(w).upper() if i % 3 == 0 else " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = set()
    for key, text in docs:
        w = (text or "").lower().split()
        if len(w) > 5000:
            continue
        for i, item in enumerate(items):
            g = grams(item)
            for s in range(max(1, len(w) - len(item) + 1)):
                v = grams(w[s : s + len(item)])
                both = sum((v & g).values())
                if both and both / sum((v | g).values()) >= 0.8:
                    want.add((key, i))
                    break
    for block in (500_000, 60):
        found = decontaminate.leaks(df, bench, block_shingles=block)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    marked = decontaminate.contamination(df, bench)
    assert marked.count() == len(docs) and {r.doc_id for r in marked.where("contaminated").collect()} == {k for k, _ in want}
    clean = decontaminate.without_leaks(df, bench)
    assert clean.columns == df.columns and clean.where("doc_id >= 1000").count() + len({k for k, _ in want}) + 1 >= 120
    assert decontaminate.contamination(df.limit(0), bench).count() == 0 and decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
