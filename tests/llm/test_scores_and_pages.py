import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import embedding_dedup, html_text, language_model, queries, toxicity, url_filter
from rosterlake.llm.support import fold
from rosterlake.llm.url_filter import UrlRule

SMALL = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op1_toxicity(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "s"), (2, "", "s"), (3, "you are an idiot, scum and a loser. idiot!", "s"), (None, "fine day", "s"), (3, "a " * 50000, "s")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, fold("doc_id", 5) == 0)
    assert len(toxicity.score(docs, model).collect()) == 5
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.train(docs.limit(0), labels, fold("doc_id", 5) == 0)
    assert [r.score for r in toxicity.score(docs.limit(1), empty).collect()] == [0.5]


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.2
    votes = np.ones((6000, len(toxicity.VOTERS) + 1), int)
    for j, (hit, wrong) in enumerate([(0.9, 0.02), (0.7, 0.02), (0.6, 0.2)]):
        votes[:, j] = np.where(rng.random(6000) < np.where(y, hit, wrong), 2, 1)
    votes[:, 3] = votes[:, 0]  # says what voter 0 says
    votes[:, 4] = np.where(rng.random(6000) < np.where(y, 0.1, 0.95), 0, 1)
    votes[:300, -1] = 2 * y[:300]  # some rows have a label
    model = toxicity.fit_label_model(votes, np.ones(6000))
    assert abs(model.shares[0, 2, 1] - 0.9) < 0.05 and abs(model.shares[2, 2, 1] - 0.6) < 0.06
    assert model.correlations[0, 3] > 0.95 and abs(model.correlations[0, 1]) < 0.2
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95


def brute_em(votes, counts, rounds=30):
    """The label model in plain loops."""
    rows, n = range(len(votes)), len(votes[0])
    label = [v[-1] for v in votes]
    lean = [sum(x == 2 for x in v) - 0.5 * sum(x == 0 for x in v) for v in votes]
    belief = [label[r] / 2 if label[r] != 1 else 0.9 if lean[r] > 0 else 0.1 for r in rows]
    known = [counts[r] if label[r] != 1 or all(x == 1 for x in label) else 0 for r in rows]
    prior = min(max((sum(known[r] * belief[r] for r in rows) + 1) / (sum(known) + 2), 0.001), 0.5)

    def posterior(v, silence):
        odds = math.log(prior / (1 - prior))
        for j in range(n):
            evidence = math.log(share[j][v[j]][1] / share[j][v[j]][0])
            if v[j] != 1:
                odds += evidence / max(sum(max(corr[k][j], 0) for k in range(n) if v[k] != 1), 1)
            elif silence:
                odds += evidence / sum(max(corr[j][k], 0) for k in range(n))
        return 1 / (1 + math.exp(-min(max(odds, -50), 50)))

    for _ in range(rounds):
        share = []
        for j in range(n):
            sums = [[sum(counts[r] * (belief[r] if c else 1 - belief[r]) for r in rows if votes[r][j] == v) for c in (0, 1)] for v in range(3)]
            share.append([[(sums[v][c] + 0.3) / (sum(s[c] for s in sums) + 0.9) for c in (0, 1)] for v in range(3)])
        cov = [[0.0] * n for _ in range(n)]
        for r in rows:
            for c in (0, 1):
                rest = [votes[r][j] - 1 - (share[j][2][c] - share[j][0][c]) for j in range(n)]
                weight = counts[r] * (belief[r] if c else 1 - belief[r])
                for j in range(n):
                    for k in range(n):
                        cov[j][k] += weight * rest[j] * rest[k]
        corr = [[1.0 if j == k else cov[j][k] / math.sqrt(max(cov[j][j], 1e-9) * max(cov[k][k], 1e-9)) for k in range(n)] for j in range(n)]
        belief = [posterior(v, True) for v in votes]
    return [posterior(v, False) for v in votes]


def test_label_model_equals_brute_force():
    rng = random.Random(8)
    votes = [[rng.choice([0, 1, 1, 2]) for _ in range(4)] + [rng.choice([0, 1, 1, 2])] for _ in range(25)]
    counts = [rng.randrange(1, 50) for _ in votes]
    model = toxicity.fit_label_model(np.array(votes), np.array(counts))
    assert model.posterior(np.array(votes)) == pytest.approx(brute_em(votes, counts), abs=1e-6)


def brute_features(text):
    for p in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        text = text.replace(p, " ")
    words = {w for w in re.split("[\x00-\x20]+", text.lower()) if w}
    return {b"w" + w.encode() for w in words} | {f"{n}{w[:n]}".encode() for w in words for n in (4, 5, 6, 7) if len(w) > n}


def test_votes_and_scores_equal_brute_force(spark):
    toxic = {b"wmud": 9.0, b"4slim": 8.0, b"wbogus": 7.0, b"5grimy": 6.0}
    texts = ["", "mud", "All is MUD, mud; mud!", "slimy things", "you are a mud", "GRIMY GRIMYEST SHOUT of mud", "fine words only", "idiot", "a " * 300 + "mud slimes bogus"]
    voters = toxicity.Voters(toxicity.Lexicon(toxic, ()))
    for text in texts:
        words = toxicity.words_of(text)
        fired = Counter()
        for w in words:
            hit = {zlib.crc32(f) % 4 if f[:1] == b"w" else 4 + zlib.crc32(f) % 2 for f in brute_features(w.decode()) if f in toxic}
            fired.update(hit | ({6} if w.decode() in toxicity.INSULTS else set()))
        total = sum(fired.values())
        want = ["+" if fired[i] else "0" for i in range(7)]
        want.append("+" if words and total >= max(3, 0.01 * len(words)) else "0")
        want.append("+" if "you are a mud" in text else "0")
        want.append("+" if total and sum(w.isupper() for w in text.split()) * 3 > len(words) else "0")
        want.append("-" if not any(fired[i] for i in (0, 1, 2, 3, 6)) else "0")
        want.append("-" if not fired[4] + fired[5] else "0")
        assert voters.vote(text) == "".join(want), text
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.train(docs, labels, fold("doc_id", 5) == 0)
    given = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        odds = model.intercept + sum(model.weights.get(f, 0.0) for f in brute_features(given[r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(odds, -40), 40))))


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://example.org/", "https://a.example.org/en/1299?x=1", "http://example.org/en/2",
    "ftp://x.y.example.org/es/", "http://badexample.org/es/", "http://example.org/es", "http://q.com/fr/1#t", "http://q.com/de/", "http://com/de/x",
    "x://y://z.org/a", "http://a.net/", "http://org?x", "http://u:p@b.com:80/fr/", "http://.org/", "http://a..org/x", "http://example.org/\nen/1",
]


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.host + r.path, r.verdict), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_filter_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, url_host string")
    rules = [*queries.URL_RULES, UrlRule("block", "org", "/"), UrlRule("block", "b.com:80", ""), UrlRule("allow", "y.example.org", "/es/")]
    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == len(URLS) + 3
    merged = {(r.host, r.path): r for r in sorted(rules)}.values()
    for i, u in enumerate(URLS + URLS[:3]):
        r = got[i]
        assert (r.url_host, r.url_path, r.url_rule, r.url_verdict) == brute_url(u, merged), u
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, []).where("url_verdict = 'allow'").count() == len(URLS) + 3


def test_url_filter_takes_long_urls(spark):
    host = "a." * 100_000 + "example.org"
    urls = [f"http://{host}/es/x", f"http://example.org/{'en/' * 100_000}", "x" * 200_000 + "://org/", f"http://{'o' * 200_000}.org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    url_filter.filter_urls(pages.limit(1), queries.URL_RULES).collect()
    began = time.time()
    got = {r.page_id: r for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    assert time.time() - began < 10
    assert [(got[i].url_rule, got[i].url_verdict) for i in range(4)] == [("example.org/es/", "block"), ("org/", "allow"), ("org/", "allow"), ("org/", "allow")]
    assert got[0].url_host == host


def test_url_filter_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(url_filter.oracle_sql(queries.URL_RULES)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op2_url_filter(spark, sf).collect())


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="nav-open"><header>Site</header>
<nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<div id=main>INNER</div><aside>Side</aside><div class="ad-box">Buy</div><section id="comments"><p>First!</p></section>
<form>Mail <input name=x></form><script>document.write("<p>no</p>")</script><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<h1>Head&amp;line</h1><p>One <b>bold\n\t  word</b>.<p>Two&nbsp;is<br>here", "Head&line One bold word. Two is here"),
        ("<article><p>A b c.</p><div class=share>Tell</div><section><p>D e f &lt;g&gt;</p></section></article>", "A b c. D e f <g>"),
        ("<p>x<p>y<ul><li>i<li>j</ul><table><tr><td>1<td>2</table>", "x y i j 1 2"),
        ("<article><header><h1>Title</h1></header><p>A b c d e.</p><p class=reply>So he said.</p><section id=related><h2 id=related-work>Related</h2><p>Text of it, long enough to be dense.</p></section></article>", "Title A b c d e. So he said. Related Text of it, long enough to be dense."),
        ("<![foo[bar]]><p>One line of text.</p><p>And one more.</p>", "One line of text. And one more."),
        ("<p>Text before.</p><p>It goes on here.</p><!-- left open <p>no</p>", "Text before. It goes on here."),
        ("<div><p>First part is long enough to count.</p></div><div><p>Second part is also here to stay.</p></div>", "First part is long enough to count. Second part is also here to stay."),
    ],
)
def test_main_text(inner, want):
    assert html_text.main_text(PAGE.replace("INNER", inner)) == want


ARTICLE = "<h1>Of wind</h1><p>The wind <b>blows<br>from</b> the sea.</p><p>Yes.</p><p>In the morning it turns, and by noon nobody speaks of it any more.</p>"
TEXT = "Of wind The wind blows from the sea. Yes. In the morning it turns, and by noon nobody speaks of it any more."
NAV = "<nav><ul><li><a href=/a>Menu</a><li><a href=/b>Two</a></ul></nav><div class=ad>Buy it now.</div>"
FOOT = "<footer>&copy; 2020 by someone</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body>{NAV}<div class="site has-sidebar"><div>{ARTICLE}</div></div>{FOOT}</body>',
        f"<body><form action=/x>{NAV}<div>{ARTICLE}</div><input name=q><button>Go</button>{FOOT}</form></body>",
        f"<body>{NAV}{ARTICLE}{FOOT}</body>",
        f"<body>{NAV}<div><section>{ARTICLE}</section></div>{FOOT}",
        f"<body>{NAV}<div id=content>{ARTICLE}</div><section id=comments><h3>Comments</h3><div class=comment><p>I like it, well written and true.</p></div></section>{FOOT}",
        f"<body>{NAV}<div>{ARTICLE}</div><div class=related><a href=1>More of this</a> <a href=2>And of that</a></div>{FOOT}",
        f"<body>{NAV}<div>{ARTICLE}</div>{FOOT}<a href='",
        f"<!-- a -- b --><!--><body><script>if (a < b) '<!--'</script>{NAV}<div>{ARTICLE}</div>{FOOT}",
    ],
)
def test_density_alone_finds_the_text(page):
    assert html_text.main_text(page) == TEXT


def sentences(word, n):
    return "".join(f"<p>The {word} goes on at {i} with enough of a sentence to be read.</p>" for i in range(n))


@pytest.mark.parametrize("tag", ["section id=comments", "ol class=commentlist", "div class=sidebar", "div class=cookie-notice", "div class=notice", "section id=discussion"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>"])
@pytest.mark.parametrize("own", ["<article>{}</article>", "<div class=content>{}</div>", "{}"])
def test_the_article_wins_over_longer_comments_and_notices(tag, inner, own):
    page = f"<body>{NAV}{own.format(sentences('article', 3))}<{tag}>{inner.format(sentences('other', 12))}</{tag.split()[0]}>{FOOT}</body>"
    found = html_text.main_text(page)
    assert found.count("article") == 3 and "other" not in found


def test_sections_of_an_article_stay_whatever_their_name():
    own = '<section class="social-history"><h2>Social history</h2>' + sentences("social", 2) + '</section><section id=related><h2>Related work</h2>' + sentences("related", 2) + "</section>"
    other = "<section id=comments><h2>Comments</h2>" + sentences("other", 2) + "</section><section class=newsletter><h2>Letter</h2><p>Mail</p><input></section><div class=related><h3>More</h3><a href=1>That</a><p>other</p></div>"
    found = html_text.main_text(f"<body>{NAV}<article>{sentences('article', 3)}{own}{sentences('article', 1)}{other}</article>{FOOT}</body>")
    assert [found.count(w) for w in ("article", "social", "related", "other", "Letter")] == [4, 2, 2, 0, 0]


def test_wrappers_stay():
    article = f"<article>{sentences('article', 3)}</article>"
    for page in (f"<form>{article}</form>", f"<div id=social-wrapper>{article}<section id=comments>{sentences('other', 9)}</section></div><p>Copyright</p>", f"<div class=notice>{sentences('article', 3)}</div>"):
        found = html_text.main_text(f"<body>{NAV}{page}{FOOT}</body>")
        assert found.count("article") == 3 and "other" not in found and "Copyright" not in found


def test_articles_of_given_pages_without_their_tag(spark, sf):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    wrong = 0
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", article)]
        wrong += html_text.main_text(re.sub("<(/?)article>", r"<\1div>", r.html)) != " ".join(x for x in parts if x)
    assert len(rows) > 200 and wrong == 0


@pytest.mark.parametrize("tag", ["</i>", "<i>", "<!--", "<a href='", "<![x[", "<p><div>", "<table><td>", "<p><i><ul>", "</td>", "<", "&amp", "<b x="])
def test_odd_pages_take_little_time(tag):
    began = time.time()
    html_text.main_text("<p>" + "<i>" * 16000 + tag * 16000 + "text" + "</b>" * 16000)
    assert time.time() - began < 3


def test_html_of_pages_and_odd_rows(spark, sf):
    odd = ["", "plain words", "<p>a", "</div></p>b", "<!-- <p>x</p> -->", "<" * 2000, "<div>" * 3000 + "deep" + "</div>" * 3000, "&#x41;&bogus;&am", "<body></body>"]
    pages = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate([*odd, None, odd[1]])], "page_id long, url string, html string, main_text string")
    got = {r.page_id: r.main_text for r in html_text.extract(pages).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 6, 8, 9, 10)] == ["", "plain words", "a", "b", "", "deep", "", "", "plain words"]
    assert got[7] == "A&bogus;&am" and html_text.extract(pages.limit(0)).count() == 0
    given = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html

    for r in queries.op5_html_text(spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", given[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == " ".join(x for x in parts if x) and r.n_chars == len(r.text)


def brute_links(vectors, threshold=0.9):
    n = len(vectors)
    linked = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or len(a) != len(b) or not np.isfinite(a).all() or not np.isfinite(b).all():
                continue
            a, b = np.array(a, float), np.array(b, float)
            if a.any() and b.any() and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                linked[i].add(j)
                linked[j].add(i)
    return linked


def test_embedding_links_and_recall(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        for noise in (0, 0, 0.1, 0.25, 0.3, 0.42):
            other = rng.standard_normal(64)
            other -= other @ base * base
            rows.append((base + noise * other / np.linalg.norm(other)).astype(np.float32).tolist())
    rows += [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [1e30] * 64, [1e30] * 64]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, id int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    assert sorted(got) == list(range(len(rows)))
    linked = brute_links(rows)
    total, found = sum(map(len, linked)), sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= len(linked[i]) for i in got)
    assert found >= 0.9 * total
    for i, r in got.items():
        assert r.kept == (r.component_id == i) and r.component_id <= i
    for i in range(360, 364):
        assert got[i].n_links == 0
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_unrelated_vectors_meet_equally_rarely_at_every_size(spark):
    rng = np.random.default_rng(9)
    found = {}
    for n in (5000, 20000):
        x = rng.standard_normal((n, 64))
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(8)
        found[n] = embedding_dedup.candidates(frame, embedding_dedup.plan_for(n, 0.9)).count() / n
    assert found[20000] < 1.5 * max(found[5000], 2) and max(found.values()) < 12


@pytest.mark.parametrize("vectors", [2000, 40_000, 1_000_000])
def test_recall_at_the_threshold(spark, vectors):
    """Pairs at a cosine of exactly 0.90 under the plan of tables of several sizes."""
    rng = np.random.default_rng(10)
    n = 1500
    u, o = (rng.standard_normal((n, 96)) for _ in range(2))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    o -= (o * u).sum(1, keepdims=True) * u
    w = 0.9005 * u + math.sqrt(1 - 0.9005**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    rows = [(i, v) for i, v in enumerate([*u.tolist(), *w.tolist()])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    got = embedding_dedup.near_vectors(frame, plan=embedding_dedup.plan_for(vectors, 0.9))
    assert got.where(f"vec_id >= {n} and component_id = vec_id - {n}").count() >= 0.92 * n


def brute_model(docs, held, order=3):
    lower = lambda t: (t or "").encode().lower().split()
    grams = lambda d: ((i, n, tuple([b"\r", *d][i + 2 - n : i + 2])) for i in range(len(d)) for n in range(2, order + 1) if i + 2 - n >= 0)
    train = [[*lower(t), b"\n"] for (i, t), h in zip(docs, held) if not h]
    words = Counter(w for d in train for w in d)
    total, v = sum(words.values()), len(words)
    count, history = Counter(), Counter()
    for d in train:
        for _, _, g in grams(d):
            count[g] += 1
            history[g[:-1]] += 1
    stats = Counter()
    for g, c in count.items():
        if history[g[:-1]] >= 2:
            b = int(math.log2(history[g[:-1]]))
            stats[len(g), b, 0] += c
            stats[len(g), b, 1] += c == 1
    p1 = lambda w: (words[w] + 0.1) / (total + 0.1 * (v + 1))
    out = []
    for i, t in docs:
        d = [*lower(t), b"\n"]
        p = [p1(w) for w in d]
        base = sum(map(math.log10, p))
        for at, n, g in sorted(grams(d), key=lambda x: x[1]):
            h = history[g[:-1]]
            if h >= 2:
                b = int(math.log2(h))
                keep = min(max((stats[n, b, 1] + 1) / (stats[n, b, 0] + 2), 0.02), 1.0)
                p[at] = (1 - keep) * count[g] / h + keep * p[at]
        out.append((i, len(d), sum(words[w] > 0 for w in d), total, base, sum(map(math.log10, p))))
    return out


@pytest.mark.parametrize(
    "order, size, tokens, pool",
    [(3, language_model.BLOCK_BYTES, language_model.BUCKET_TOKENS, 4096), (3, 500, 200, 4096), (4, 900, 300, 2), (2, 500, 200, 3), (1, 500, 500, 4), (3, 500, 200, 3)],
)
def test_language_model_equals_brute_force(spark, monkeypatch, order, size, tokens, pool):
    """pool: blocks that ask together; their totals are those of single blocks."""
    monkeypatch.setattr(language_model, "POOL", pool)
    rng = random.Random(6)
    words = ["The", "the", "cat", "sat", "É", "on", "a", "mat.", "zig"] + [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 69])]) for _ in range(rng.randrange(40)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "\x0b \x0c"), (153, docs[7][1]), (160, "new words only")]
    docs += [(200, " ".join(rng.choice(words) for _ in range(3500)))]  # read by several lanes
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block int, held string").repartition(3)
    found = language_model.score_texts(frame, fold("doc_id", 10) == 0, order=order, block_bytes=size, bucket_tokens=tokens)
    got = found.orderBy("doc_id").collect()
    for r, w, h in zip(got, brute_model(docs, held, order), held, strict=True):
        assert r.held_out == h and tuple(r)[2:5] == w[1:4] and (r.doc_id, r.base_score, r.score) == (w[0], pytest.approx(w[4]), pytest.approx(w[5]))


def test_a_pool_asks_in_one_row_and_hands_on():
    keys = np.array([3, 9, 1 << 63], np.uint64)
    grams = lambda at, counts: language_model.Grams(np.zeros(0, int), keys[at], np.array(counts), np.zeros(2, int))
    asked = [r | {"pool": 7} for block, at, counts in ((1, [0, 2], [5, 1]), (2, [1, 2], [2, 0])) for r in grams(at, counts).questions(block, 2, 1, np.array([4, 6], np.uint8))]
    rows = pa.Table.from_pylist(asked, schema=language_model._QUESTION.append(pa.field("pool", pa.int64())))
    (one,) = language_model.pooled(rows).to_pylist()
    assert one["block"] == 7 and language_model.widen(one["counts"], 3).tolist() == [5, 2, 1] and language_model.unpack(one["bins"], 1).tolist() == [4, 4, 6]
    told = pa.Table.from_pylist([{"block": 7, "bucket": 0, "n": 2, "totals": language_model.narrow(np.array([50, 20, 10])), "stats": [3]}], schema=language_model._ANSWER)
    got = {r["block"]: language_model.widen(r["totals"], 2).tolist() for r in language_model.handed(rows, told).to_pylist()}
    assert got == {1: [50, 10], 2: [20, 10]}


def test_counts_above_four_bytes_are_whole():
    keys = np.array([5, 1 << 63], np.uint64)
    grams = language_model.Grams(np.zeros(0, int), keys, np.array([3_000_000_000, 1 << 60]), np.zeros(2, int))
    asked = [r for block in (1, 2) for r in grams.questions(block, 1, 1)]
    rows = language_model.answer(pa.Table.from_pylist(asked, schema=language_model._QUESTION)).to_pylist()
    assert [language_model.widen(r["totals"], 2).tolist() for r in rows[:2]] == [[6_000_000_000, 1 << 61]] * 2
    assert rows[2]["stats"] == [2, 6_000_000_000 + (1 << 61)]


def test_language_model_beats_its_base_and_odd_tables(spark):
    rows = queries.op9_language_model(spark, SMALL).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert rows[1] > rows[0]
    frame = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert language_model.score_texts(frame, F.lit(True)).count() == 2
    assert language_model.score_texts(frame.limit(0), F.lit(True)).count() == 0
