"""HTML, toxicity, URL filters, Jaccard join, licenses and the pipeline against brute force and planted cases."""

import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldloom.llm import html_main, jaccard_join, licenses, quality_rules, toxicity, url_filters
from fieldloom.llm.queries import URL_RULES, held_out, tokenizer_path

from .cases import documents, empty, words

PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies</div><nav><a href="/">Home</a></nav>'
    '<header><h1>Site</h1></header><div class="wrap-with-sidebar"><article class="post-12"><h1>Head &eacute;</h1><p>One  <i>a</i>b &lt;x&gt;<p>Two<ul><li>x<li>y</ul>'
    '<form>no<input></form><div class="ad-box">buy</div><section class="comments"><p>a long comment that goes on and on and on and on</section></article></div><footer>f</footer></body></html>'
)


def test_html_leaves_furniture_out(spark):
    pages = spark.createDataFrame([(1, "http://A.test/1", PAGE, 5), (2, None, None, 5), (3, "x", "", 5), (1, "http://A.test/1", PAGE, 5), (4, "http://a.test/2", "<p>cut <b>off &am", 5), (5, "http://a.test", "<div>" * 3000 + "deep", 5)], "page_id long, url string, html string, path long")
    got = sorted((r.page_id, r.text) for r in html_main.main_text(pages).collect())
    assert got == [(1, "Head é One ab <x> Two x y")] * 2 + [(2, ""), (3, ""), (4, "cut off &am"), (5, "deep")]
    assert html_main.main_text(pages.limit(0)).count() == 0


def test_html_hosts_agree_on_a_path(spark):
    page = lambda i: f'<body><div class="c{i}"><p>{words(60, i)}</p></div><div class="rail"><p>{words(10, i)}</p></div></body>'
    odd = f'<body><div class="c9"><p>{words(40, 9)}</p></div><div class="rail"><p>{words(60, 8)}</p></div></body>'
    pages = spark.createDataFrame([(i, "http://h.test/", page(i)) for i in range(5)] + [(9, "http://h.test/", odd)], "page_id long, url string, html string")
    assert [tuple(r) for r in html_main.host_paths(pages).collect()] == [("h.test", "html/body/div.cN", 5)]
    assert next(r.text for r in html_main.main_text(pages).collect() if r.page_id == 9) == words(40, 9)


@pytest.mark.parametrize("page", ["a<b " * 250_000, "<div>" * 100_000 + "x", "<span>" * 40_000 + "<p>x<hr>" * 40_000, "<div>" * 40_000 + "</x>" * 80_000, '<a "' * 200_000])
def test_html_parser_is_linear(page):
    begun = time.process_time()
    html_main.extract(page, "html/body/div.c")
    assert time.process_time() - begun < 20


def test_html_words_of_furniture_within_the_article():
    page = "<body><article><h1 class='header'>Head</h1><p class='text legal'>one</p><div class='legal'>gone</div><p class='ad'>gone</p><div class='comments'>gone</div><p>two</p></article></body>"
    assert html_main.extract(page, None) == "Head one two"


def test_html_article_in_sibling_containers():
    page = f'<body><div class="content"><p>{words(60, 1)}</p></div><div class="rail"><p>{words(9, 3)}</p></div><div class="content"><p>{words(60, 2)}</p></div></body>'
    path = html_main.best(html_main.containers(html_main.parse(page)))[1].path
    assert html_main.extract(page, path) == f"{words(60, 1)} {words(60, 2)}"


def test_segments_are_maximal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.integers(-3, 4, rng.integers(1, 14)).tolist()

        def brute(lo, hi):
            best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = -best[2], -best[2] - best[1]
            return brute(lo, i) + [(best[0], i, j)] + brute(j, hi)

        got = toxicity.segments([(s, i, i + 1) for i, s in enumerate(scores)])
        assert [g[0] for g in got] == [b[0] for b in brute(0, len(scores))]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter(~held_out()))
    assert "idiot" in model.terms and len(model.terms) < 50
    rows = toxicity.score(docs, model).selectExpr("row.doc_id as doc_id", "score").join(labels, "doc_id").filter(held_out()).collect()
    right = [(r.score >= 0.5) == bool(r.toxic) for r in rows]
    assert sum(right) >= 0.93 * len(right) and not any(r.score >= 0.5 for r in rows if not r.toxic)
    cases = toxicity.score(documents(spark), model).collect()
    assert len(cases) == documents(spark).count() and all(0 <= r.score < 0.5 for r in cases)
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.fit(empty(spark), labels).bias == float("-inf")


def test_toxicity_learns_from_bounded_rows_and_from_a_repeated_row_once(spark):
    lines = [(i, f"you awful lout number {i} go away" if i % 2 else f"a calm river number {i} flows on") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(400, 0)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(lines, "doc_id long, text string"), labels)
    again = toxicity.fit(spark.createDataFrame(lines + [lines[1]] * 900, "doc_id long, text string"), labels)
    assert once == again and {"awful", "lout"} <= set(once.terms)
    hot = spark.createDataFrame(lines + [(400, f"word{i} river") for i in range(3_000)], "doc_id long, text string")
    taken = []
    whole = toxicity._logistic
    try:
        toxicity._logistic = lambda x, y: taken.append(len(x)) or whole(x, y)
        toxicity.fit(hot, labels, max_labelled=500)
    finally:
        toxicity._logistic = whole
    assert taken == [500]


def test_toxicity_tokens_of_a_long_text_are_the_same_in_runs():
    text = words(3_000, 4) + " \u00e9t\u00e9 \u65e5\u672c" * 50 + "x" * 500
    for chars in (1, 7, 1_000, 10**9):
        assert [t for run in toxicity.token_runs(text, chars) for t in run] == toxicity._TOKEN.findall(text)
    assert list(toxicity.token_runs("")) == []


def test_url_rules_and_method(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://m.example.com/en/", "http://a.com", "http://a.net/fr/1", "http://evilnet/es/", "nothing", None, "http://spam-farm.test.org/de/1", "http://quietriver.test.org/de/2#t", "http://a.net/fr"]
    pages = spark.createDataFrame([(i, u, f"<p>{words(50, i)}</p> quiet river quiet river", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, rule long")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, URL_RULES).collect()}
    assert [got[i].rule for i in range(10)] == ["www.example.com/en/", "example.com/en/", None, "net/fr/", None, None, None, None, None, None]
    assert [got[i].verdict for i in range(10)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow"]
    assert (got[0].host, got[0].path, got[2].path, got[5].host, got[6].host) == ("www.example.com", "/en/1", "", "", "")
    assert url_filters.split_word("quietriver", {"quiet": 5, "river": 5, "qui": 1}, 20) == ["quiet", "river"]
    assert url_filters.judge_urls(pages.limit(0), URL_RULES).count() == 0


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts):
    sets = {t: shingles(t) for t in texts}
    links, near = dict.fromkeys(texts, 0), defaultdict(set)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x = len(sets[a] & sets[b])
            if x and x >= 0.8 * (len(sets[a]) + len(sets[b]) - x):
                links[a] += 1
                links[b] += 1
                near[a].add(b)
                near[b].add(a)
    return links, near


def near_group(n):
    base = words(200, 77).split()
    out = []
    for i in range(n):
        w = list(base)
        for k in range(i % 3):
            w[(i * 37 + k * 61) % 200] = f"new{i}"
        out.append(" ".join(w))
    return out


def test_jaccard_links_are_exact(spark, sf_dir):
    """A near group larger than a block, copies, and the cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text")
    group = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(near_group(150))], "doc_id long, text string")
    docs = docs.unionByName(group).unionByName(documents(spark).select("doc_id", "text")).cache()
    known = [(r.doc_id, r.text or "") for r in docs.collect()]
    texts = list(dict.fromkeys(t for _, t in known))
    links, near = brute_links(texts)
    least, of_class = {}, {}
    for d, t in known:
        if d is not None:
            least[t] = min(least.get(t, d), d)
    for t in texts:
        seen, todo = {t}, [t]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        of_class[t] = min((least[x] for x in seen if x in least), default=None)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(known)
    want = sorted(((d, of_class[t], least.get(t), links[t], sum(t == x for _, x in known)) for d, t in known), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_candidates_meet_only_their_own_texts(spark):
    """Null and repeated doc_ids: a row for each candidate, not one for each pair, before the texts are read."""
    docs = spark.createDataFrame([(None if i % 2 else 7, words(30, i)) for i in range(200)], "doc_id long, text string")
    candidates = docs.select("doc_id", jaccard_join.key_of(docs.text).alias("key"), F.lit(1).cast("long").alias("component"), F.lit(200).cast("long").alias("size"))
    rows = jaccard_join.own_texts(docs, candidates).collect()
    assert len(rows) == 200 and all(jaccard_join.text_key(r.text) == bytes(r.key) for r in rows)


def test_prefixes_are_shortened_to_the_recall():
    assert [jaccard_join.depth_for(r) for r in (0.5, 0.998, 0.99999)] == [8, 5, 3]
    assert 1 - (1 - 0.8**5) ** jaccard_join.TREES >= jaccard_join.RECALL


def outside_phrases(scanner, name):
    """A place of the template's words near the middle at which no deciding phrase is cut, if there is one."""
    words_ = scanner.templates[name]
    inside = {i for phrase in scanner.phrases[name] for places in phrase for i in range(places[0] + 1, places[-1] + 1)}
    free = [i for i in range(1, len(words_)) if i not in inside]
    return min(free, key=lambda i: abs(i - len(words_) // 2), default=None)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_with_inserted_words(name):
    """Whatever plain alignment of the whole text covers is found, however many words stand in between."""
    scanner = licenses.Scanner({name: licenses.TEMPLATES[name]})
    at = outside_phrases(scanner, name)
    if at is None:
        return
    own = [m.group() for m in licenses._WORD.finditer(licenses.TEMPLATES[name])]
    for n in (1, 13, 30, 200):
        text = " ".join([words(20, 5), *own[:at], words(n, n), *own[at:], words(20, 6)])
        split = licenses.words_of(text)
        pairs = licenses.align(split, scanner.templates[name])
        found = scanner.scan(text)
        if len(pairs) >= scanner.least * len(own) and scanner.decided(name, split, pairs):
            assert found and found[0][1] >= len(pairs) / len(own) - 1e-9
        assert [f[0] for f in found] in ([name], [])
    assert scanner.scan(" ".join(own)) and len(own) == len(scanner.templates[name])


def test_licenses_far_apart_and_many():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["mit-text"].split()
    middle = len(mit) // 2
    text = " ".join([*mit[:middle], words(40, 1), *mit[middle:], words(500, 2), *mit, words(90, 3), *mit[:middle], words(25, 4), *mit[middle:]])
    assert [f[0] for f in scanner.scan(text)] == ["mit-text"] * 3
    many = (licenses.TEMPLATES["apache-2.0"] + " " + words(30, 7) + "\n") * 400
    assert len(scanner.scan(many)) == 400


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_is_found(name):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    text = f"{words(200, 1)}\n{licenses.TEMPLATES[name]}\n{words(100, 2)}\n{licenses.TEMPLATES[name]} end"
    found = scanner.scan(text)
    assert [s[0] for s in found] == [name, name] and all(s[1] == 1 for s in found)
    assert all(text[s[3] : s[4]].split()[0].strip('"') in licenses.TEMPLATES[name] for s in found)


def test_license_with_changes(spark):
    text = licenses.TEMPLATES["mit-text"].replace("sublicense", "relicense").replace("free of charge", "for free")
    assert licenses.Scanner(licenses.TEMPLATES).scan(text)[0][:1] == ("mit-text",)
    rows = licenses.scan_documents(documents(spark)).collect()
    assert len(rows) == documents(spark).count() and all(r.n_spans == 0 and r.license is None for r in rows)
    assert licenses.scan_documents(empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("notice", "license"),
    [
        ("Released under the BSD License.", "bsd-notice"),
        ("Released under the X License.", None),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
        ("This work is licensed under the GNU General Public License v3.0.", "gpl-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3.0"),
        ("This work is licensed under the GNU General Public License, version 1.", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Licensed under the Apache License 2.0.", "apache-2.0"),
        ("Licensed under CC BY 3.0.", "cc-by-3.0"),
        ("Licensed under CC BY 1.0.", None),
        ("Licensed under CC BY-ND 4.0.", "cc-by-nd-4.0"),
        ("Licensed under CC BY-XX 4.0.", None),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa-4.0"),
        (licenses.TEMPLATES["gpl-header"].replace("version 3", "version 2"), "gpl-2.0-header"),
        (licenses.TEMPLATES["gpl-header"].replace("version 3", "version 1"), None),
        (licenses.TEMPLATES["mpl-2.0"].replace("v. 2.0", "v. 1.1"), None),
    ],
)
def test_license_near_misses(notice, license):
    found = licenses.Scanner(licenses.TEMPLATES).scan(f"{words(50, 1)}\n{notice}\n{words(50, 2)}")
    assert [s[0] for s in found] == ([license] if license else [])


def test_license_deciding_phrases_are_in_their_templates():
    assert set(licenses.DECIDING) == set(licenses.TEMPLATES)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert all(found for phrases in scanner.phrases.values() for found in phrases)


def test_alignment_increases():
    pairs = licenses.align("a b c x d e f".split(), "a c b y d e g f".split())
    assert pairs == sorted(pairs) and all(a[1] < b[1] for a, b in zip(pairs, pairs[1:])) and len(pairs) >= 5


def test_pipeline_keeps_and_drops(spark):
    """Each stage against what it must do to its own input."""
    sf = "/root/testdata/sf0.01"
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.staged(stage(spark, before, sf), "test-" + name.replace(" ", "-"))
        assert after.columns == docs.columns
        assert after.exceptAll(before).isEmpty() and 0 < after.count() < before.count()
        before = after
    kept = [r.text for r in before.select("text").collect()]
    links, _ = brute_links(kept)
    assert len(set(kept)) == len(kept) and not any(links.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert 3 < len(corpus_pipeline.STAGES) < 6


def kept_of(rows):
    """The rows (doc_id, text) that stay by brute force: one of each near-duplicate class, of the least doc_id, null last, then text key."""
    texts = list(dict.fromkeys(t for _, t in rows))
    _, near = brute_links(texts)
    out, seen = set(), set()
    for t in texts:
        if t not in seen:
            group, todo = {t}, [t]
            while todo:
                new = near[todo.pop()] - group
                group |= new
                todo += new
            seen |= group
            out.add(min(((d, x) for d, x in rows if x in group), key=lambda r: (r[0] is None, r[0] or 0, jaccard_join.text_key(r[1]))))
    return out


def test_pipeline_of_an_empty_table_and_of_odd_rows(spark, sf_dir, tmp_path):
    """No documents; and nulls, repeats, long texts and columns whose names operators use inside."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, rows in (("none", empty(spark)), ("odd", documents(spark))):
        rows.withColumn("key", F.lit(1)).withColumn("row", F.lit("r")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    held = corpus_pipeline.keep_quality(spark, docs, "")
    assert held.columns == docs.columns and {r.doc_id for r in held.collect()} >= {6, None}
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(set(texts)) == len(texts) == len({r.text or "" for r in docs.collect()}) - 1


def test_pipeline_keeps_columns_with_names_of_its_own(spark):
    docs = documents(spark).selectExpr("*", "doc_id as _key", "lang as own", "source as key", "n_chars as text_id", "lang as _own", "'x' as row")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    given = {(r.doc_id, r.text): r for r in docs.collect()}
    assert left and all(r == given[r.doc_id, r.text] for r in left)


def test_pipeline_is_the_plain_stages(spark, sf_dir, tmp_path):
    """run() against plain Python: kept documents and their pieces, with null and repeated doc_ids among them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = [r.text for r in quality_rules.judge(docs).filter("kept").select("row.text").limit(12).collect()]
    odd = [(None, good[0]), (None, good[0]), (None, good[1] + " end"), (900001, good[2] + " other words " * 90), (900001, good[3] + " more of it " * 90)]
    odd += [(None, good[4] + " new line here " * 90)] * 2
    more = spark.createDataFrame(odd, "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    clean = quality_rules.judge(docs).filter("kept").select("row.*")
    model = toxicity.fit(clean, labels.filter(~held_out()))
    rows = [(r.doc_id, r.text or "") for r in clean.select("doc_id", "text").collect()]
    assert {d for d, _ in odd} <= {d for d, _ in rows}
    want = kept_of([(d, t) for d, t in rows if toxicity.probability(toxicity.evidence(t, model)[0], model) < 0.5])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    held = Counter()
    for r in pieces:
        held[r.doc_id] += r["length"]
    sizes = Counter()
    for d, t in want:
        sizes[d] += len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert held == sizes
