"""Operators against brute force, on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.llm import html, importance, jaccard, licenses, media, mixing, packing, rules, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "two words"), (5, "x" * 70_000), (6, "a b c d e " * 3000), (7, "é ß 日本 \U0001f600"), (8, "one")]


def table(spark, tmp, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with odd documents, labels and pages; another with empty tables."""
    tmp, none = (str(tmp_path_factory.mktemp(x)) for x in ("odd", "none"))
    docs = [(i, t, "en", s, 0) for (i, t), s in zip(ODD, itertools.cycle(["b", None, "a"]), strict=False)]
    for d, rows in ((tmp, docs), (none, [])):
        table(spark, d, "documents", rows, DOC)
        table(spark, d, "labels", [(1, 1, 0), (4, 1, 0), (4, 0, 1), (None, 0, 1), (6, 0, 1)] if rows else [], "doc_id long, quality long, toxic long")
        table(spark, d, "pages", [(1, "http://h/x", None), (2, None, "<p>a"), (3, "nonsense", ""), (3, "http://h/x", "<b>&lt;<p>x</b>")] if rows else [], "page_id long, url string, html string")
    return tmp, none


QUERIES = [media.op1_chunked_media, importance.op2_importance_resampling, mixing.op3_systematic_mix, html.op4_wrapper_induction, rules.op5_boosted_rules, toxicity.op6_counterfactual_toxicity, jaccard.op7_signature_trees, packing.op8_length_buckets, licenses.op9_license_rules, sharding.op10_virtual_slots]


@pytest.mark.parametrize("f", QUERIES, ids=lambda f: f.__name__)
def test_odd_and_empty_tables(spark, odd, f):
    got = f(spark, odd[0]).collect()
    assert len(got) == (4 if "op4" in f.__name__ else len(ODD))
    assert f(spark, odd[1]).count() == 0


def test_clashing_columns_are_replaced(spark):
    names = ["Kept", "score", "N_words", "predicted", "log_weight", "_key", "_kept", "_rank", "_u", "_copies", "_n", "bucket", "_bin", "place", "shard", "virtual_slot", "licenses", "_at", "_part", "h", "n", "slice", "html_"]
    docs = spark.createDataFrame([(i, f"w{i} " * (i + 1), "a", 5, 9, *["x"] * len(names)) for i in range(20)], ", ".join(["doc_id long", "text string", "source string", "n_tokens long", "size long", *[f"{n} string" for n in names]]))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality long, toxic long")
    for t, kind in (
        (rules.judge(docs, rules.train(docs, labels)).select("kept"), "boolean"),
        (importance.resample(docs, labels, store_text=True).select("_kept"), "boolean"),
        (toxicity.score(docs, toxicity.train(docs, labels)).select("score"), "double"),
        (mixing.mix(docs).select("_copies"), "bigint"),
        (packing.pack(docs).select("bucket"), "int"),
        (sharding.assign(docs)[0].select("shard"), "int"),
        (licenses.scan(docs, F.col("text")).select("licenses"), "string"),
        (jaccard.linked(docs).select("component_id"), "bigint"),
    ):
        assert t.dtypes[0][1] == kind and t.count() == 20


# --- 1


def test_cuts_cover_and_survive_edits():
    r = random.Random(1)
    a = bytes(r.randrange(32, 127) for _ in range(200_000))
    ends = media.cuts(a)
    assert ends[-1] == len(a) and all(x < y for x, y in itertools.pairwise(ends))
    sizes = [y - x for x, y in itertools.pairwise([0, *ends])]
    assert min(sizes[:-1]) >= media.LEAST and max(sizes) <= media.MOST
    parts = lambda b: {b[x:y] for x, y in itertools.pairwise([0, *media.cuts(b)])}
    assert len(parts(a) & parts(a[:90_000] + b"new" + a[90_000:])) >= len(ends) - 4
    assert media.cuts(b"") == [] and media.samples(media.wave(b"ab")) == b"ab"


def test_media_round_trip(spark, tmp_path):
    r = random.Random(2)
    long_ = "".join(r.choice("abcdef ghij\n") for _ in range(150_000))
    docs = [(i, t) for i, t in enumerate([None, "", "x", "x", "é" * 96, long_, long_ + "tail", long_])]
    table(spark, tmp_path, "documents", [(*d, "", "", 0) for d in docs], DOC)
    got = {x["doc_id"]: x for x in media.op1_chunked_media(spark, str(tmp_path)).collect()}
    for i, t in docs:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        x = got[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert x["media_sha256"] == hashlib.sha256(media.wave(p)).hexdigest() and x["media_bytes"] == len(p) + 44
    lists, chunks = media.store(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    distinct = {p for _, t in docs for p in media.split(t)[2]}
    assert chunks.count() == len(distinct) < sum(len(media.split(t)[2]) for _, t in docs)
    assert lists.count() == len(docs)


def test_texts_of_usual_length_share_chunks():
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))
    common = whole = 0
    for _ in range(20):
        shared = prose(700)
        a, b, c = (media.split(t)[2] for t in (prose(40) + shared, shared + prose(90), shared))
        assert b[0] == media.wave(b"".join(b[1:]))[: media.HEADER] and b[0] not in c
        common += sum(map(len, {*a} & {*b})) + sum(map(len, {*b} & {*c}))
        whole += 2 * len(shared)
    assert common > whole / 2
    assert all(media.unpacked(media.packed(x)) == x for x in (b"", b"D", b"BZh", b"a" * 9000, prose(900).encode()))


def test_a_broken_chunk_is_noticed(spark):
    rows = spark.createDataFrame([(b"m" * 16, [(0, b"d" * 16, media.bz2.compress(b"abc"))])], "media binary, chunks array<struct<place:int,digest:binary,data:binary>>")
    with pytest.raises(Exception, match="digest"):
        media.rebuilt(rows).collect()


# --- 2


def test_importance_weights_equal_brute_force(spark):
    texts = ["good words here, really!", "bad %% bad", "", "Good WORDS", "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    good = spark.createDataFrame([(0,), (3,)], "doc_id long")
    m = 64
    got = importance.fit(docs, good, m)
    known = importance.Hashes()

    def grams(t):
        one, _, two = importance.ngrams([t], known, m)
        return [*one.tolist(), *two.tolist()]

    raw, tgt = Counter(g for t in texts for g in grams(t)), Counter(g for i in (0, 3) for g in grams(texts[i]))
    q = np.array([raw[b] + 1 for b in range(m)], dtype=float)
    q /= q.sum()
    p = np.array([tgt[b] for b in range(m)]) + importance.PRIOR * q
    assert np.allclose(got, np.log(p / p.sum()) - np.log(q))
    w = {r["doc_id"]: r["log_weight"] for r in importance.weigh(docs, got).collect()}
    for i, t in enumerate(texts):
        assert w[i] == pytest.approx(sum(got[g] for g in grams(t)))


def test_the_model_grows_with_the_texts(spark):
    docs = lambda n: spark.range(n).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 2000) as text")
    good = spark.createDataFrame([(1,)], "doc_id long")
    few, many = (len(importance.fit(docs(n), good)) for n in (10, 30_000))
    assert few == importance.LEAST < many == 30 * importance.SLICE
    one, _, two = importance.ngrams([" ".join(f"w{i}" for i in range(9000))], importance.Hashes(), 4096)
    assert not {*one.tolist()} & {*two.tolist()} and max(one) < 512 <= min(two) and max(two) < 4096


def test_resampling_keeps_the_largest_keys(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("the of and to in is it on".split()) for _ in range(60)) if i % 5 else " ".join(r.choice(["@@", "##", "zz%"]) for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 300, 2)], "doc_id long, quality long, toxic long")
    got = importance.resample(docs, labels).collect()
    kept = {x["doc_id"] for x in got if x["_kept"]}
    assert kept == {i for i in range(300) if i % 5}
    least = min(x["_key"] for x in got if x["_kept"])
    assert all(x["_key"] <= least for x in got if not x["_kept"])
    assert {x["doc_id"] for x in importance.resample(docs, labels).collect() if x["_kept"]} == kept


# --- 3


def fill(sizes, weights, cap=3):
    """Targets by sharing the excess until none is above its cap."""
    t, free, left = {}, dict(weights), float(sum(sizes.values()))
    while free:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in share if share[s] > cap * sizes[s]]
        if not over:
            return t | share
        for s in over:
            t[s] = cap * sizes[s]
            left -= t[s]
            del free[s]
    return t


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_stepwise_sharing(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{k}": r.choice([0, 3, 10, 200, 5000]) for k in range(7)}
    names = sorted(sizes)
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    t = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.targets(t).collect()}
    assert all(got[s] == pytest.approx(want[s]) for s in names)


def test_mix_counts(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randrange(0, 80), r.choice(["a", "b", "c", None]), 7) for i in range(800)]
    t = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")).collect()
    by = defaultdict(list)
    for x in t:
        by[x["source"]].append(x)
    for xs in by.values():
        assert max(x["_copies"] for x in xs) <= 3
        taken, target = sum(x["_copies"] * x["_size"] for x in xs), xs[0]["_target"]
        assert abs(taken - target) <= 80
        rate = target / xs[0]["_source_size"]
        assert {x["_copies"] for x in xs} <= {int(rate), int(rate) + 1}


# --- 4

PAGE = "<!DOCTYPE html><html><head><title>t</title><script>var a='</p>'</script></head><body><div class=top><a href=/>Site name</a></div><nav><ul><li>Home</ul></nav><div id=box><h1>{0}</h1><p>{1} &amp; more<br>line<p>{2}</div><div class=credits>Powered by Engine</div><form><p>x</form></body>"


def test_template_is_learnt_from_a_host(spark):
    rows = [(i, "http://h.example/a", PAGE.format(f"T{i}", f"first {i}", f"second  {i}")) for i in range(6)]
    got = {x["page_id"]: x for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "T3\nfirst 3 & more line\nsecond 3" and got[3]["n_chars"] == len(got[3]["text"])


def test_copies_of_a_page_make_no_template(spark):
    rows = [(i, "http://h.example/a", PAGE.format("T", "one", "two")) for i in range(9)]
    texts = {x["text"] for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(texts) == 1 and "one & more line\ntwo" in texts.pop()


def test_template_of_all_pages_and_layouts(spark):
    one = "<body><div class=a><div><p>Menu</p></div><div class=x>{0}</div><div class=z>Made by us</div></div></body>"
    two = "<body><section class=b><p>Other menu</p></section><section class=c><h2>{0}</h2><p>text {0}</p></section><section class=d>Terms</section></body>"
    notice = "<body><div class=a><div class=k>We moved</div><div><p>Menu</p></div><div class=x>{0}</div><div class=z>Made by us</div></div></body>"
    pages = [(i, "http://h.example/a", (two if i % 2 else one if i % 20 == 0 else notice).format(f"T{i}")) for i in range(40)]
    got = {x["page_id"]: x["text"] for x in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\ntext T{i}" if i % 2 else f"T{i}" for i in range(40)}


def test_template_in_the_middle_of_a_long_run(spark):
    page = lambda i: "<body><article>" + "".join(f"<p>w{i} {k}</p>" if k != 6 + i % 3 else "<p>Subscribe now</p>" for k in range(14)) + "</article></body>"
    got = html.main_text(spark.createDataFrame([(i, "http://h.example/a", page(i)) for i in range(10)], "page_id long, url string, html string")).collect()
    assert all("Subscribe" not in x["text"] and x["text"].count("\n") == 12 for x in got)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<article><header><h1>H</h1><p>by me</p></header><p>a<!-- no --> b</p><aside>s</aside><div class='comments'><p>c</p></div></article><footer>f</footer>", "H\na b"),
        ("<body><div class='cookie-notice'>c</div><div class='has-sidebar'><p>x</p><div class=ad-slot>buy</div></div></body>", "x"),
        ("<main><ul><li>one<li>two &lt;3</ul><table><tr><td>a<td>b</table></main>", "one\ntwo <3\na\nb"),
        ("<article><p><b>x<p>y</p></article><p>z", "x\ny"),
        ("<form id=page><nav>n</nav><h1>T</h1><p>x</p><label>name</label><input><ol class=commentlist><li>c</ol></form>", "T\nx"),
        ("<p hidden>h</p><p style='display: none'>d</p><p>ok</p>", "ok"),
        ("<article><pre> a\n  b </pre><blockquote>q</blockquote></article><article class=comment>no no no no no no</article>", "a b\nq"),
    ],
)
def test_extraction(page, want):
    assert html.extract(page) == want


def test_alignment_maps_equal_nodes():
    a, b = (html.outline(html.parse(p)) for p in ("<div><h1>x</h1><p>1</p><p>s</p></div>", "<div><h1>y</h1><p>2</p><p>3</p><p>s</p></div>"))
    pairs = [(x[0], x[1] == y[1]) for x, y in html.align(a, b) if x[0] == "p"]
    assert sorted(pairs) == [("p", False), ("p", True)]


def matched(a, b):
    """The most nodes that simple tree matching maps, by its recurrence."""
    if a[0] != b[0]:
        return 0
    x, y = a[2], b[2]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + matched(p, q))
    return 1 + m[-1][-1]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_against_brute_force(seed):
    r = random.Random(seed)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else r.choice('xyz')}</{t}>" for t in r.choices(["div", "section", "ul"], k=r.randrange(1, 4)))

    for _ in range(20):
        a, b = (html.outline(html.parse(page(2))) for _ in range(2))
        pairs = html.align(a, b)
        place = [{id(x): k for k, x in enumerate(html.nodes_of(t))} for t in (a, b)]
        at = sorted((place[0][id(x)], place[1][id(y)]) for x, y in pairs)
        assert all(x[0] == y[0] for x, y in pairs) and len({i for i, _ in at}) == len({j for _, j in at}) == len(at)
        assert all(j < k for (_, j), (_, k) in itertools.pairwise(at))
        assert len(at) <= matched(a, b) and (a[1] != b[1] or len(at) == len(html.nodes_of(a)))
    same = html.outline(html.parse(page(3)))
    assert len(html.align(same, same)) == matched(same, same)


def test_deep_and_wide_pages():
    assert html.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    wide = "".join(f"<p>a {i}</p><h2>b {i}</h2>" for i in range(10_000))
    assert html.extract(f"<article>{wide}</article>").count("\n") == 19_999
    a, b = (html.outline(html.parse(f"<article>{w}</article>")) for w in (wide, wide.replace("<p>a 77</p>", "<p>new</p><p>a 77</p>")))
    assert len(html.align(a, b)) == len(html.nodes_of(a))
    assert html.extract("<article><p>x</p><div class='social-studies'>y</div><section class='notice-of-meeting'><p>z</p></section><math><mi>e</mi></math><div class='ad-slot'>buy</div></article>") == "x\ny\nz\ne"
    assert html.extract("<article><p>a</div></section><b>b<table><tr><td>c</article></p>d") == "a\nb\nc"


# --- 5


def brute(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(3)}
    lines, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in lines
            lines.add(line)
    return [len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), dups, len(covered)]


def test_statistics_equal_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", "a a a a", "a b c a b c", "x\nx\n\n\nx y\n x", *(" ".join(r.choice("ab c # de\n %".split(" ")) for _ in range(r.randrange(0, 90))) for _ in range(200))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words_x int")
    model = rules.fit(np.zeros((0, len(rules.FEATURES))), np.zeros(0), [0] * len(rules.FEATURES))
    for x in rules.judge(docs, model).collect():
        b = brute(texts[x["doc_id"]])
        assert [x[k] for k in rules.BASE] == b
        assert x["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])


def test_trees_learn_and_stay_monotonic():
    r = np.random.RandomState(0)
    x = r.rand(1500, 3)
    y = (((x[:, 0] > 0.5) | (x[:, 1] > 0.9)) ^ (r.rand(1500) < 0.05)).astype(float)
    m = rules.fit(x, y, [1, 0, -1])
    assert ((m.margin(x) > 0) == (y > 0.5)).mean() > 0.9
    grid = np.linspace(-1, 2, 200)
    for row in x[:40]:
        for j, s in ((0, 1), (2, -1)):
            z = np.repeat(row[None, :], 200, axis=0)
            z[:, j] = grid
            assert (s * np.diff(m.margin(z)) >= -1e-12).all()


# --- 6


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(6)
    bad, words = ["dolt", "twit", "oafish"], [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(600):
        t = [r.choice(words) for _ in range(30)]
        if i % 4 == 0:
            t[r.randrange(30)] = r.choice(bad)
        if i % 8 == 0:
            t[r.randrange(30)] = "muslim"
        rows.append((i, " ".join(t)))
        labels.append((i, int(any(b in t for b in bad))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic long")
    model = toxicity.train(docs, lab, ~toxicity.held_out(F.col("doc_id")))
    y = dict(labels)
    out = toxicity.score(docs, model).select("doc_id", "score", "predicted", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    test = [x for x in out if x["h"]]
    assert {x["doc_id"] for x in test} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(x["predicted"] == y[x["doc_id"]] for x in test) >= 0.95 * len(test)
    s = {x["t"]: x["score"] for x in toxicity.score(spark.createDataFrame([("the muslim people met",), ("the christian people met",), (None,)], "text string").withColumn("t", F.col("text")), model).collect()}
    assert abs(s["the muslim people met"] - s["the christian people met"]) < 0.05 and s["the muslim people met"] < 0.5 and 0 <= s[None] <= 1


def test_every_swap_of_a_long_document_counts():
    parts, place = toxicity.Parts(), np.arange(1 << toxicity.BITS)
    a, b = toxicity.IDENTITY[0][0], toxicity.IDENTITY[-1][0]
    text = "\n".join([f"the {a} people met"] * 100 + [f"the {b} people met"])
    got = toxicity.changes(text, parts, place)
    one, last = (len(toxicity.swaps(toxicity.words(f"the {x} people met"), parts)) for x in (a, b))
    assert sum(got.values()) == 100 * one + last > 64 and sorted(got.values())[0] == 1 and max(got.values()) == 100


def test_the_penalty_spares_neutral_mentions(spark):
    """Where toxic texts name groups more often than others do, the penalised model takes fewer neutral held-out mentions for toxic."""
    r = random.Random(16)
    insults, words = [f"insult{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(5)], [f"w{i}" for i in range(200)]
    terms = [t for g in toxicity.IDENTITY[:2] for t in g]
    rows, labels, neutral = [], [], set()
    for i in range(3000):
        t, bad = [r.choice(words) for _ in range(20)], i % 3 == 0
        if bad:
            t[r.randrange(20)] = r.choice(insults)
        if r.random() < (0.7 if bad else 0.06):
            t[r.randrange(20)] = r.choice(terms)
            if not bad:
                neutral.add(i)
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic long")
    wrong, right = [], []
    for weight in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.train(docs, lab, ~toxicity.held_out(F.col("doc_id")), counterfactual=weight)
        out = toxicity.score(docs, model).filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", "score", "predicted").collect()
        wrong.append(sum(x["score"] for x in out if x["doc_id"] in neutral) / sum(x["doc_id"] in neutral for x in out))
        right.append(sum(x["predicted"] == dict(labels)[x["doc_id"]] for x in out) / len(out))
    assert wrong[1] < 0.7 * wrong[0] and right[1] >= right[0] - 0.01


# --- 7


def components(texts, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(low))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n=260):
    """Texts of common words with quoted passages, and families of near copies at every distance."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [r.choice(words) for _ in range(60)]
    texts = []
    while len(texts) < n:
        base = [r.choice(words) for _ in range(r.choice([2, 5, 7, 9, 30, 80, 300]))]
        if r.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 25])):
            copy = list(base)
            for _ in range(int(len(base) * r.choice([0, 0.01, 0.02, 0.03, 0.04]))):
                copy[r.randrange(len(copy))] = r.choice([*words, "NEW"])
            texts.append(" ".join(copy).upper() if r.random() < 0.1 else " ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "k", "percent", "block", "page"), [(1, 4, 85, 128, 16), (2, 5, 80, 8, 3), (3, 2, 60, 4, 2), (4, 1, 90, 16, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, k, percent, block, page):
    """Small blocks and pages make every path run: split groups, both sides of a block pair, trees of several levels."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PAGE", page)
    texts = corpus(seed)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.linked(spark.createDataFrame(texts, "doc_id long, text string"), k, percent).collect()}
    assert got == components(texts, k, percent)


def test_tree_loses_no_pair():
    r = np.random.RandomState(5)
    base = r.randint(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: r.randint(50, 90)], r.randint(0, 2**63, r.randint(0, 30)).astype(np.uint64)])) for _ in range(120)]
    n, bits = np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets]
    ids = np.arange(120)
    i, j, _ = jaccard.near_in_tree(ids, n, bits, ids, np.full(120, -1), 70)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a, b in itertools.combinations(range(120), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 70 * len(np.union1d(sets[a], sets[b]))}
    assert want <= got and len(got) < 120 * 119 // 2
    x, y, _ = jaccard.near_rows(np.zeros(12, dtype=int), n[:12], bits[:12], ids[:12], np.full(12, -1), 70)
    assert {(a, b) for a, b in want if b < 12} <= {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}


# --- 8


@pytest.mark.parametrize("seed", range(5))
def test_bounds_are_optimal(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 60), 9))
    counts = [r.randrange(1, 20) for _ in lengths]
    for k in (1, 2, 3, 9, 12):
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))
        best = min(cost((*x, lengths[-1])) for x in itertools.combinations(lengths[:-1], min(k, 9) - 1))
        assert cost(packing.best_bounds(np.array(lengths), np.array(counts), k)) == best


def test_batches_keep_the_budget(spark):
    r = random.Random(8)
    rows = [(i, r.choice([0, 1, 5, 40, 300, 1023, 1024, 1025, 3000, 9000])) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 5, 4096).collect()
    by = defaultdict(list)
    for x in got:
        assert x["n_tokens"] <= x["bucket_len"]
        by[x["bucket"], x["batch"]].append(x)
    for xs in by.values():
        assert len(xs) * xs[0]["bucket_len"] <= 4096 or len(xs) == 1
        assert sorted(x["place"] for x in xs) == list(range(len(xs)))
    full = Counter(b for b, _ in by)
    assert all(max(k for b, k in by if b == x) == n - 1 for x, n in full.items()) and len(got) == 900


# --- 9


def test_license_rules(spark):
    texts = ["x.\nLicensed under the Apache License, Version 2.0.", "Permission is hereby granted. Released under the MIT License! All rights reserved.", "MIT.", None, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."]
    got = [x["licenses"] for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), F.col("text")).orderBy("doc_id").collect()]
    assert got == ["Apache-2.0", "MIT", "", "", "BSD-2-Clause"]


MIT = """The MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n'


@pytest.mark.parametrize("width", [50, 72, 79])
@pytest.mark.parametrize("mark", ["", " * ", "// ", "# ", "dnl ", "\r"])
def test_wrapped_licenses(spark, width, mark):
    def wrapped(text):
        lines = [x for line in text.split("\n") for x in textwrap.wrap(line, width) or [""]]
        return "".join(f"{x}\r\n" if mark == "\r" else f"{mark}{x}".rstrip() + "\n" for x in lines)

    texts = [MIT, GPL.format(3), GPL.format(2), BSD.format("2."), BSD.format("(b)"), APACHE, "Code, licensed under the MIT License, see LICENSE", "The project is not licensed under the MIT License. Permission is no\nMIT License matter."]
    docs = spark.createDataFrame([(i, wrapped(t)) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    got = [(x["sentence_ids"], x["licenses"]) for x in licenses.scan(docs, F.col("text")).orderBy("doc_id").collect()]
    bsd = ("bsd_grant,bsd_source,bsd_binary", "BSD-2-Clause")
    gpl = ("gpl3_grant,gpl_warranty,gpl_details", "GPL-3.0")
    assert got == [("mit_title,mit_grant,mit_condition", "MIT"), gpl, ("gpl2_grant,gpl_warranty,gpl_details", "GPL-2.0"), bsd, bsd, ("apache_header,apache_compliance,apache_copy_at", "Apache-2.0"), ("mit_notice", "MIT"), ("", "")]
    assert all(any(k in s for k in licenses.KEYS) for s in licenses.SENTENCES)


NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def test_rules_use_up_sentences_in_order(spark):
    """Ordered, longest first: three clauses are one licence, two licences in a text are two, a reservation counts alone only."""
    texts = ["Copyright (c) 2020 X. All rights reserved.\n\n" + BSD.format("2.") + NAMES, NAMES + BSD.format("2."), MIT + "\n" + BSD.format("2.") + NAMES + "\n" + MIT, GPL.format(3) + "\n" + GPL.format(2), "All rights reserved.", "SPDX-License-Identifier: MIT\n\nSPDX-License-Identifier: Apache-2.0\n"]
    got = [x["licenses"] for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), F.col("text")).orderBy("doc_id").collect()]
    assert got == ["BSD-3-Clause", "BSD-2-Clause", "BSD-3-Clause,MIT", "GPL-3.0,GPL-2.0", "Proprietary", "Apache-2.0,MIT"]


# --- 10


def test_rebalancing_moves_few_slots():
    r = random.Random(10)
    held = [r.choice([0, 10, 1000, 5000]) for _ in range(2000)]
    one = sharding.first_map(2000, 24)
    two = sharding.rebalanced(held, one, 24)
    load = [sum(h for h, s in zip(held, two, strict=True) if s == k) for k in range(24)]
    assert max(load) - min(load) <= 1000 and sum(a != b for a, b in zip(one, two, strict=True)) < 700
    assert sharding.rebalanced(held, two, 24) == two and sharding.rebalanced([0] * 50, sharding.first_map(50, 24), 24)


def test_shards(spark, tmp_path):
    r = random.Random(11)
    table(spark, tmp_path, "documents", [(i, "é" * r.randrange(0, 400), "", "", 0) for i in range(3000)], DOC)
    got = sharding.op10_virtual_slots(spark, str(tmp_path)).collect()
    by = defaultdict(list)
    for x in got:
        by[x["shard"]].append(x)
    assert set(by) == set(range(24)) and all(sorted(x["slot"] for x in xs) == list(range(len(xs))) for xs in by.values())
    load = [sum(x["size"] for x in xs) for xs in by.values()]
    assert max(load) - min(load) < 0.01 * sum(load) / 24


def test_a_stored_map_is_read_and_edited(spark, tmp_path):
    store = str(tmp_path / "maps")
    r = random.Random(12)
    docs = lambda lo, hi: spark.createDataFrame([(i, r.randrange(8, 9000)) for i in range(lo, hi)], "doc_id long, size long")
    first, path = sharding.assign(docs(0, 4000), 256, 8, store=store)
    old = {x["doc_id"]: x for x in first.collect()}
    assert path == store and {x["map_version"] for x in old.values()} == {2}
    again = {x["doc_id"]: x["shard"] for x in sharding.assign(first.select("doc_id", "size"), 256, 8, store=store)[0].collect()}
    assert again == {i: x["shard"] for i, x in old.items()} and spark.read.parquet(store).select("version").distinct().count() == 2
    grown = sharding.assign(first.select("doc_id", "size").unionByName(docs(4000, 6000)), 256, 9, store=store)[0].collect()
    maps = defaultdict(dict)
    for x in spark.read.parquet(store).collect():
        maps[x["version"]][x["virtual_slot"]] = x["shard"]
    assert {x["map_version"] for x in grown} == {3} and set(maps) == {1, 2, 3} and {x["shard"] for x in grown} == set(range(9))
    assert all(maps[3][x["virtual_slot"]] == x["shard"] and x["virtual_slot"] == old.get(x["doc_id"], x)["virtual_slot"] for x in grown)
    assert sum(maps[2][s] != maps[3][s] for s in range(256)) < 128
    with pytest.raises(ValueError, match="slots"):
        sharding.assign(docs(0, 9), 64, 8, store=store)


def test_hot_and_null_ids_spread(spark, tmp_path):
    texts = ["é" * (k % 50) for k in range(3000)]
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(3000)]
    table(spark, tmp_path, "documents", [(i, None if k == 5 else t, "", "", 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOC)
    got = sharding.op10_virtual_slots(spark, str(tmp_path)).collect()
    want = Counter((i, len((t if k != 5 else "").encode()) + 8, zlib.crc32((t if k != 5 else "").encode())) for k, (i, t) in enumerate(zip(ids, texts, strict=True)))
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == want
    load = Counter()
    for x in got:
        load[x["shard"]] += x["size"]
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 24
    assert len({x["virtual_slot"] for x in got if x["doc_id"] == 7}) > 500
    assert {x["map_version"] for x in got} == {2}
