"""Language ID, toxicity, personal data and main text: held-out accuracy, plain patterns, brute-force cuts."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bendpoint.llm import html_main, langid, pii, toxicity

from .conftest import rows

EN = "the quick brown fox and the lazy dog went with that other one which was over there"
DE = "der schnelle braune fuchs und der faule hund gingen mit dem anderen der dort war"


def drawn(words, n, seed):
    draw = np.random.default_rng(seed)
    return [" ".join(draw.choice(words.split(), 12)) for _ in range(n)]


def test_langid(docs_of):
    train = [(i, t, "en") for i, t in enumerate(drawn(EN, 80, 1))] + [(i, t, "de") for i, t in enumerate(drawn(DE, 40, 2))]
    model = langid.train(docs_of([*train, (900, "abc", None), (901, None, "en")]))
    assert model.langs == ["de", "en"]
    test = [(i, t, "x") for i, t in enumerate(drawn(EN, 30, 3) + drawn(DE, 30, 4))]
    odd = [(100, None), (101, ""), (102, "12 %% \n"), (103, "é"), (104, (EN + " ") * 9000), (0, test[0][1])]
    out = langid.identify(docs_of(test + odd).withColumn("score", F.lit("clash")), model).collect()
    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out}
    assert len(out) == 66 and all(0 <= s <= 1 for _, s in found.values())
    assert all(found[i, t][0] == ("en" if i < 30 else "de") for i, t, _ in test)
    assert [found[i, t][0] for i, t in odd[:3]] == ["und"] * 3 and found[100, None][1] == 0
    assert found[103, "é"][0] in model.langs and found[104, odd[4][1]][0] == "en"
    # many texts at once and one at a time give the same
    texts = [t for _, t, _ in test] + ["", "a"]
    one = [langid.classify([t], model) for t in texts]
    names, scores = langid.classify(texts, model)
    assert names == [n[0] for n, _ in one] and np.allclose(scores, [s[0] for _, s in one])


def test_langid_learned_nothing(docs_of):
    model = langid.train(docs_of([(1, "abc", None)]))
    assert rows(langid.identify(docs_of([(1, "abc")]), model), "lang_pred", "score") == [("und", 0.0)]
    assert langid.identify(docs_of([]), model).count() == 0


def test_kernel_likes_gaps_and_inserted_letters():
    like = lambda a, b: float(toxicity._vectors([a])[0] @ toxicity._vectors([b])[0])
    assert like("idiot", "idiot") == pytest.approx(1)
    assert like("idiot", "i-d.i*o t") == pytest.approx(1)
    assert like("idiot", "idxiot") > 0.5 > like("idiot", "editor")
    assert like("idiot", "the") == 0 and like("ab", "ab") == 0
    kernel = toxicity.Kernel(["idiot", "moron"])
    words = ["idiot", "idxiot", "!?", "", "moron!", "cat", "morbid"]
    found, likeness = kernel.likeness(words)
    for w, row in zip(found, likeness, strict=True):
        want = np.array([like(words[w], x) for x in ("idiot", "moron")])
        assert np.allclose(row, np.where(want >= toxicity.LEAST_LIKENESS, want, 0), atol=1e-5)
    assert {0, 1, 4} <= set(found.tolist()) and not {2, 3, 5} & set(found.tolist())


def test_toxicity(spark, docs_of):
    draw = np.random.default_rng(5)
    clean = drawn(EN, 200, 6)
    bad = [" ".join(draw.permutation([*t.split(), draw.choice(["idiot", "moron", "scum"])])) for t in drawn(EN, 60, 7)]
    docs = [(i, t) for i, t in enumerate(clean + bad)]
    labels = spark.createDataFrame([(i, None if i == 3 else int(i >= 200)) for i, _ in docs], "doc_id bigint, toxic int")
    model = toxicity.train(docs_of(docs), labels)
    test = [(0, "you are an IDIOT, that is"), (1, "what a m o r o n there"), (2, "such an id.iot over there"), (3, "the lazy dog"), (4, None), (5, ""), (6, "what an idxiot")]
    out = {r.doc_id: r for r in toxicity.judge(docs_of(test).withColumn("whole", F.lit(0)), model).collect()}
    assert [out[i].predicted for i in range(6)] == [1, 1, 1, 0, 0, 0]
    assert out[6].score > 2 * out[3].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = toxicity.judge(docs_of([(i, t) for i, t in enumerate(drawn(EN, 100, 8))]), model)
    assert held.agg(F.sum("predicted")).first()[0] == 0
    none = toxicity.train(docs_of(docs), labels.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.judge(docs_of(test), none).collect()} == {0}
    assert toxicity.judge(docs_of([]), model).count() == 0


PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain(text):
    def passes(kind, m):
        digits = re.sub(r"[^0-9]", "", m)
        if kind == 1:
            return all(int(p) <= 255 for p in m.split("."))
        if kind == 2:
            return 12 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == 0 or 9 <= len(digits) <= 15

    found = [(m.start(), m.end(), k) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if passes(k, m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_patterns():
    draw = np.random.default_rng(9)
    odd = ["a@b.c_d@e.f g%h@i-j.k.l@m.n", "@@a@b@c.d", "1.2.3.4.5.6.7.8.9", "300.1.1.1 1.1.1.1", "é@a.b", "x@y.z.@q.w", "4111 1111-1111 1111 1", "+1 (2) 3-4 ("]
    odd += ["".join(draw.choice(list("ab1.2@+- (_"), 60)) for _ in range(400)]
    odd += ["0000 0000 0000", "1" * 5000, "a" * 5000 + "@"]
    for text in odd:
        assert pii.base_spans(text) == plain(text), text


def test_personal_data(docs_of):
    text = "é mail jo.doe at example dot com, call (017) 555-7713, from 10.1.2.3\nor x.1@mail.org"
    docs = [(1, text), (2, None), (3, ""), (4, "in 1999 we met at noon"), (1, text), (5, "order 1234567890123456 shipped")]
    out = pii.find_personal_data(docs_of(docs).withColumn("spans", F.lit("clash"))).collect()
    by = {r.doc_id: r for r in out}
    named = lambda spans: [(s.kind, text[s.start : s.end]) for s in spans]
    assert named(by[1].base) == [("ip", "10.1.2.3"), ("email", "x.1@mail.org")]
    assert named(by[1].spans) == [("email", "jo.doe at example dot com"), ("phone", "(017) 555-7713"), ("ip", "10.1.2.3"), ("email", "x.1@mail.org")]
    assert len(out) == 6 and all(not by[i].spans for i in (2, 3, 4, 5))
    assert pii.find_personal_data(docs_of([])).count() == 0


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(10)
    crf = pii.Crf()
    crf.emit, crf.move = draw.normal(size=crf.emit.shape), draw.normal(size=crf.move.shape)
    chains = [draw.integers(0, pii.BUCKETS, (n, 9)) for n in (1, 4, 3, 2)]
    for chain, path in zip(chains, crf.decode(chains), strict=True):
        def total(p, chain=chain):
            score = crf.start[p[0]] + sum(crf.emit[f].sum(axis=0)[s] for f, s in zip(chain, p, strict=True))
            return score + sum(crf.move[a, b] + crf.allowed[a, b] for a, b in zip(p[:-1], p[1:], strict=True))

        best = max(total(p) for p in itertools.product(range(len(pii.STATES)), repeat=len(chain)))
        assert total(path.tolist()) == pytest.approx(best)


def test_minimum_cut_is_least():
    draw = np.random.default_rng(11)
    for _ in range(200):
        n = int(draw.integers(1, 9))
        cost = [float(x) / 2 for x in draw.integers(-6, 7, n)]
        edges = [(a, b, float(draw.integers(1, 6)) / 2) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.4]

        def energy(labels, cost=cost, edges=edges):
            own = sum((c if not k else 0) if c > 0 else (-c if k else 0) for c, k in zip(cost, labels, strict=True))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        least = min(energy(x) for x in itertools.product([False, True], repeat=n))
        assert energy(html_main.min_cut(cost, edges)) == pytest.approx(least)


def test_main_text(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav><!-- <p>no</p> --><div class='ad-box'>Buy</div>"
        "<article><h1>A &amp; B</h1><p>One,\n two<br>three <b>bold</b> &lt;x&gt; &#233;.<p>Short<p>1 < 2 <div class=comments><p>I disagree."
        "</div><aside>Related</aside><form>Sign up</form><p>Last &nbsp; one.</p></article><footer>&copy; us"
    )
    pages = [(1, "u", page), (2, "v", None), (3, "w", ""), (4, "x", "<nav>only</nav>"), (5, "y", "<p>Broken <b <p>page"), (1, "u", page), (6, "z", "<article>" + "<p>word.</p>" * 3000)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit(0))
    out = html_main.extract(table).collect()
    by = {r.page_id: r.text for r in out}
    assert by[1] == "A & B\nOne, two three bold <x> é.\nShort\n1 < 2\nLast one."
    assert [by[i] for i in (2, 3, 4)] == ["", "", ""] and by[6] == "\n".join(["word."] * 3000)
    assert len(out) == 7 and all(r.n_chars == len(r.text) for r in out)
    assert html_main.extract(table.filter(F.lit(False))).count() == 0


def test_main_text_weighs_names_against_the_text():
    weights = html_main.fit()
    story = "<h1>A title of the page</h1><p>The first paragraph of it, which has commas, and ends here.</p><p>Fine.</p>"
    aside = '<div class="sidebar"><ul><li><a>Other story</a><li><a>One more</a></ul></div>'
    text = "A title of the page\nThe first paragraph of it, which has commas, and ends here.\nFine."
    for page in (
        f'<body class="has-sidebar">{story}{aside}</body>',
        f'<body class="sidebar"><article class="post social">{story}</article>{aside}</body>',
        f'<body><div class="page with-header"><article>{story}</article></div><nav>Menu</nav></body>',
        f'<body><article><div class="header">{story}</div><div class="related"><a>More</a></div></article></body>',
    ):
        assert html_main.main_text(page, weights) == text
        found = html_main.blocks(page)
        sure = {b.tags for b, c in zip(found, html_main.costs(found, weights), strict=True) if abs(c) > 20}
        assert all("nav" in tags for tags in sure)
    # an item that the classifier alone would drop is content by its neighbours, as the cut decides
    page = html_main.blocks("<article><p>Some text, and more.</p><p><a>Read it</a></p><ul><li><a>One</a></ul><p>The end of the text.</p></article>")
    cost = html_main.costs(page, weights)
    assert cost[2] < 0 and html_main.min_cut(cost, html_main.smoothness(page)) == [True] * 4


def test_toxicity_sees_a_letter_in_every_gap(spark, docs_of):
    like = lambda a, b: float(toxicity._vectors([a])[0] @ toxicity._vectors([b])[0])
    # subsequences of more than eight letters count, listed or through the dense table
    assert like("abxxxxxxxxxxc", "abc") > 0 and like("a" + "x" * 30 + "bc", "abc") > 0
    insults = ["idiot", "moron", "clown", "trash", "loser", "stupid", "worthless", "pathetic"]
    kernel = toxicity.Kernel(insults)
    gapped = [x.join(w) for w in insults for x in "xqz"]
    found, likeness = kernel.likeness(gapped)
    assert found.tolist() == list(range(len(gapped)))
    want = toxicity._vectors(gapped) @ toxicity._vectors(insults).T
    assert np.allclose(likeness, want, atol=1e-5) and (likeness.argmax(axis=1) == np.arange(len(gapped)) // 3).all()
    # held-out rows, with any letter in any gap
    draw = np.random.default_rng(12)

    def put(texts, spell):
        return [" ".join(draw.permutation([*t.split(), spell(str(draw.choice(insults)))])) for t in texts]

    def spaced(w):
        return "".join(c + str(draw.choice(list("xqkvzjwy"))) for c in w[:-1]) + w[-1]

    clean = drawn(EN, 200, 13)
    bad = put(drawn(EN, 80, 14), str) + put(drawn(EN, 160, 15), spaced)
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(440)], "doc_id bigint, toxic int")
    model = toxicity.train(docs_of(list(enumerate(clean + bad))), labels)
    held = drawn(EN, 50, 16) + put(drawn(EN, 50, 17), spaced)
    out = toxicity.judge(docs_of(list(enumerate(held))), model).collect()
    assert sum(r.predicted for r in out if r.doc_id < 50) <= 2
    assert sum(r.predicted for r in out if r.doc_id >= 50) >= 45


def test_addresses_of_many_parts_are_whole():
    for address in (
        "name [at] mail [dot] example [dot] com",
        "john at mail dot example dot co dot uk",
        "jo (at) a (dot) b (dot) c (dot) d (dot) example (dot) org",
    ):
        text = f"please write to {address} today, or later, or on any other day of the week"
        ((_, more),) = pii.find([text], pii.trained())
        assert [(text[a:b], k) for a, b, k in more] == [(address, 0)]
