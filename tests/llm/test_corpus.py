"""The corpus operators against brute force on small tables: nulls, empty texts, ties, repeated rows, clashing columns."""

import hashlib
import html
import inspect
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import components, decontamination, jaccard_join, language, line_templates, markov, mixing, page_text, quality, sharding, topk

random.seed(3)
WORDS = ["the", "of", "and", "red", "blue", "green", "stone", "river", "cloud", "iron"] + ["".join(random.choice("abcdeghilmnorst") for _ in range(random.randrange(3, 9))) for _ in range(300)]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, rid long, gid string, shard int, score double, spans string"


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """Documents with extra columns named like internal ones."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, "g", 1, 0.5, "s") for i, t, lang, src in rows], EXTRA)


BASE = [prose(60) for _ in range(8)]
NEAR = BASE[0].split()
NEAR[30] = "changed"
ROWS = [(1, BASE[0], "en", "a"), (2, " ".join(NEAR), "en", "a"), (3, BASE[0], "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, "  \n ", "fr", "c"), (7, "one two", "fr", "c"), (8, "One two", "fr", "a"), (9, BASE[1], "de", "a"), (9, BASE[1], "de", "a"), (11, BASE[2] + "\n" + BASE[3], "de", "b"), (12, prose(4000), "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def test_sharding_rows_law_and_proportions(spark, docs, nothing):
    got = sharding.stratified_shards(docs, shards=5).collect()
    assert len(got) == len(ROWS)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(5)) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    want = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == want
    assert sharding.stratified_shards(nothing).count() == 0
    many = table(spark, [(i, "x", "en", "a" if i % 3 else "b") for i in range(240)])
    by = Counter((r["shard"], r["source"]) for r in sharding.stratified_shards(many, shards=8).collect())
    assert all(abs(by[(s, "b")] - 10) <= 1 for s in range(8))


def test_mixing_targets_and_limits(spark, docs, nothing):
    got = mixing.fair_mix(docs, keep=["text", "score"]).collect()
    assert len(got) == len(ROWS) and all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2 for r in got)
    assert {r["size"] for r in got if r["text"] is None} == {0}
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert math.isclose(sum(t for t, _ in targets.values()), 1.5 * total) and all(t <= 2 * s + 1e-9 for t, s in targets.values())
    many = table(spark, [(i, prose(5 + i % 7), "en", "abcd"[i % 4]) for i in range(400)])
    first, again = mixing.fair_mix(many).collect(), mixing.fair_mix(many.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in first) == sorted((r["doc_id"], r["taken"]) for r in again)
    for s in "abcd":
        own = [r for r in first if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 24
    assert mixing.fair_mix(nothing).count() == 0


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(10, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == iw[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_decontamination_equals_brute_force(spark, docs, nothing):
    items = [(1, " ".join(BASE[0].split()[5:30])), (2, "ONE, two!"), (10, BASE[3]), (3, None), (4, " , "), (5, "the the the the the the the the the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("rid", F.lit(1)).withColumn("pos", F.lit("x"))
    more = docs.unionByName(table(spark, [(20, "the " * 30, "en", "a"), (21, "xx ÉONE two", "fr", "a")]))
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontamination.contamination(more, bench).collect())
    assert got == sorted((r["doc_id"], *brute_hits(r["text"], items)) for r in more.collect())
    assert decontamination.contamination(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())


def test_proximity_matches(spark):
    words = [f"v{i}" for i in range(10)]
    moved = words[:5] + ["and"] + words[5:]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(words[:9]))], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    _, matches, _ = decontamination.find_phrases(d, b, slack=1)
    rows = matches.groupBy("rid").agg(F.max("exact").alias("exact")).collect()
    assert sorted(r["exact"] for r in rows) == [False, True]


def brute_classes(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return sorted((rows[i][0], len(s), min(rows[k][0] for k in range(len(rows)) if label[k] == label[i])) for i, s in enumerate(sets))


def test_similarity_classes_equal_brute_force(spark, docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = prose(50).split()
    for k in range(40):  # a chain of copies, each a few words from the one before
        base[random.randrange(50)] = f"n{k}"
        rows.append((100 + k, " ".join(base)))
    boiler = prose(20)
    rows += [(200 + k, boiler + " " + prose(15 + k)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("n")).withColumn("bits", F.lit(0))
    for size, num, den in ((4, 85, 100), (5, 4, 5)):
        found = jaccard_join.similar_classes(df, size=size, num=num, den=den).cache()
        least = {r["component"]: r["id"] for r in found.groupBy("component").agg(F.min("id").alias("id")).collect()}
        assert sorted((r["id"], r["n_shingles"], least[r["component"]]) for r in found.collect()) == brute_classes(rows, size, num, den)
    assert jaccard_join.similar_classes(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_line_templates(spark, docs, nothing):
    foot = "This page was printed {} times in all"
    long = prose(60)
    rows = [(i, f"{prose(12)}\n{foot.format(i)}\n" + (long if i < 2 else prose(9)), "en", "a") for i in range(6)] + [(10, None, "en", "a"), (11, "", "en", "a"), (12, "own line here now", "en", "a"), (12, "own line here now", "en", "a"), (13, "own line here now\n\nother", "en", "a")]
    got = {r["id"]: r for r in line_templates.drop_recurring_lines(table(spark, rows)).collect()}
    assert all(got[i]["n_dropped"] == (2 if i < 2 else 1) and "printed" not in got[i]["text"] for i in range(6))
    assert (got[10]["text"], got[11]["text"], got[12]["n_dropped"], got[13]["n_dropped"]) == (None, "", 0, 0)
    fields = table(spark, [(i, f"n{i} n{i + 1} n{i + 2} n{i + 3}", "en", "a") for i in range(5)])  # variable fields only: no template
    assert all(r["n_dropped"] == 0 for r in line_templates.drop_recurring_lines(fields).collect())
    assert line_templates.drop_recurring_lines(nothing).count() == 0


def greedy_templates(forms, similarity=0.8):
    """The template of each form (tokens: documents) of a leaf, one form after another."""
    seeds, at = [], {}
    for f in sorted(forms, key=lambda f: (-forms[f], f)):
        at[f] = next((s for s in seeds if sum(a == b for a, b in zip(f, s, strict=True)) >= similarity * len(f)), f)
        seeds += [f] * (at[f] == f)
    return at


def test_several_templates_a_leaf(spark):
    fruit, trees = ["apple", "pear", "plum", "fig"], ["oak", "elm", "ash"]
    rows = [(i, f"{prose(12)}\nwe have now {f} in the big old red basket", "en", "a") for i, f in enumerate(fruit)]
    rows += [(10 + i, f"{prose(12)}\nwe have now cut {t} trees down behind your house", "en", "a") for i, t in enumerate(trees)]
    rows += [(20, prose(12) + "\nwe have now nothing else to say about it all", "en", "a")]
    rows += [(30 + i, f"{prose(12)}\n12 34 56  total\n7{i} 8{i} 9{i} total", "en", "a") for i in range(3)]  # the first line recurs, the other's fields differ
    got = {r["id"]: r for r in line_templates.drop_recurring_lines(table(spark, rows)).collect()}
    assert all("we have now" not in got[i]["text"] for i in [*range(4), 10, 11, 12]) and got[20]["n_dropped"] == 0
    assert all(got[30 + i]["n_dropped"] == 1 and f"7{i} 8{i} 9{i} total" in got[30 + i]["text"] for i in range(3))


@pytest.mark.parametrize("n", [6, 12])
def test_further_templates_cover_their_leaf(spark, n):
    forms = {}
    for _ in range(60):
        near = random.choice(sorted(forms)) if forms and random.random() < 0.7 else ("a", "b", "c", *random.choices("klmnop", k=n - 3))
        cut = random.randrange(3, n)
        forms[(*near[:cut], random.choice("klmnop"), *near[cut + 1 :])] = random.randrange(1, 4)
    names = {f: i for i, f in enumerate(sorted(forms))}
    df = spark.createDataFrame([(names[f], 0, list(f), n, d) for f, d in forms.items()], "key long, leaf long, line array<string>, n int, n_docs long")
    rows = [r for t in line_templates.further_templates(df, 3, 0.8) for r in t.collect()]
    at = {r["key"]: r["template"] for r in rows}
    assert len(at) == len(rows)
    want = greedy_templates(forms)
    seeds = {names[f] for f in forms if want[f] == f}
    lines = {i: f for f, i in names.items()}
    assert {k for k in lines if at.get(k, k) == k} == seeds
    assert all(sum(a == b for a, b in zip(lines[k], lines[t], strict=True)) >= 0.8 * n for k, t in at.items())


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(90)]
    v += [(200 + i, v[0][1]) for i in range(30)] + [(300, None), (301, [1.0] * 15 + [None]), (302, [1.0] * 15 + [float("nan")]), (303, [1.0] * 3), (304, []), (305, [float("inf")] * 16)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("dim", F.lit(1))
    good = {i: [math.floor(64 * x) for x in e] for i, e in v if e and None not in e and all(map(math.isfinite, e))}
    want = []
    for q in (i for i in good if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good if c != q and len(good[c]) == len(good[q]))[:20]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.exact_topk(df.limit(0), F.lit(True)).count() == 0


def test_topk_leaves_rows_uncompleted():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 64))
    v = np.floor(64 * (centres[rng.integers(0, 10, 3000)] + 0.5 * rng.normal(size=(3000, 64)))).astype(np.int64)
    ids, q = np.arange(3000), v[:100]
    exact = q @ v.T
    exact[np.arange(100), np.arange(100)] = -(2**60)
    want = np.sort(exact, axis=1)[:, ::-1][:, :20]
    for at in range(4):
        qids, score = topk.gather(ids[:100], q, ids, v, 20, at)
        cutoffs = np.array([score[qids == i].min() for i in range(100)], float)
        assert (cutoffs <= want[:, -1]).all()
        qids, rows, score, completed = topk.resolve(ids[:100], q, ids, v, cutoffs, 20)
        assert all((score[qids == i] == want[i]).all() and (exact[i, rows[qids == i]] == want[i]).all() for i in range(100))
        assert completed < 0.3 * exact.size
    assert topk.resolve(ids[:100], q, ids, v, np.full(100, -np.inf), 20)[3] == 100 * 2999  # without cutoffs all are
    huge = np.array([[2**40, 2**40], [2**40, -(2**40)]])
    assert topk.resolve(np.array([7]), huge[:1], np.array([1, 2]), huge, np.array([-np.inf]), 2)[2].tolist() == [2**63 - 1, 0]


def test_topk_of_repeated_rows_and_long_vectors(spark):
    v = [(20, [1.0, 2.0]), (20, [0.5, 2.0]), (20, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.0, 0.0]), (40, [0.1] * 5000), (41, [0.2] * 5000)]
    got = topk.exact_topk(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    f = lambda x: [math.floor(64 * y) for y in x]
    one = sum(a * b for a, b in zip(f([0.5, 2.0]), f([3.0, 1.0]), strict=True))
    assert sorted(map(tuple, got)) == [(20, 1, 1, one), (20, 2, 1, one), (20, 3, 2, 0), (40, 1, 41, 5000 * 6 * 12)]


def test_page_text(spark):
    page = lambda body, foot="Footer of a": f"<html><head><title>T</title><script>x('</p>')</script></head><body><nav><ul><li>Home</li></ul></nav><div class='ad banner'>Buy</div><article><h1>H</h1>{body}</article><div>{foot}</div><footer>c</footer></body></html>"
    bare = lambda body: f"<body><p>Menu line</p><p>{body}</p><p>Bottom line</p></body>"
    rows = [(1, "http://a/x/1", page("<p>One &amp; <b>two</b>\n three<p>Four")), (2, "http://a/x/2", page("<p>One &amp; two three</p><p>Five</p>")), (3, "http://a/x/2", page("<p>One &amp; two three</p><p>Five</p>")), (4, "http://b/1", bare("Alpha")), (5, "http://b/2", bare("Beta")), (6, None, None), (7, "::", ""), (8, "http://c/", "plain &lt;text&gt;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))
    got = {r["id"]: r["text"] for r in page_text.extract_text(df).collect()}
    assert got[1].split("\n")[:3] == ["H", "One & two three", "Four"] and "Footer" not in got[1] and "Buy" not in got[1]
    assert got[2].split("\n") == got[3].split("\n") == ["H", "One & two three", "Five"]
    assert (got[4], got[5], got[6], got[7], got[8]) == ("Alpha", "Beta", "", "", "plain <text>")
    assert page_text.extract_text(df.limit(0)).count() == 0
    assert html.unescape("&amp;") == "&"


def test_markup():
    lines = page_text.lines_of
    comments = "<article class='comment'><p>reader says</p></article>"
    assert lines(f"<main><article><p>A{comments}</article></main><section id='comments'><article><p>body</p></article></section>") == (["A"], [True])
    assert lines("<article><div class='entry-header'><h1>Title</h1></div><p class='notice-of-rights'>R</p><div class='related-posts'>x</div><ul class='share'><li>y</ul></article>")[0] == ["Title", "R"]
    assert lines('<p title="oops>Hello <a href="x">you</a> <b data-h="<i>k</i>" class=z>B</b>')[0] == ["Hello you B"]
    assert lines("<nav><ul><li>x<article><p>T</article>") == (["T"], [True])  # nothing closes the menu
    assert lines("<aside class='teasers'><article><p>other page</p></article></aside><main><p>M</main>") == (["M"], [True])
    assert lines("a<!-- <p>b</p> --> c<script>'<p>'</script><br>d &amp;lt; <P>E</P><textarea>f") == (["a c d &lt;", "E"], [False, False])
    assert lines(None) == lines("") == ([], []) and lines("x" * 10**6)[0] == ["x" * 10**6]


def random_page(kind):
    """html of a kind of page of site `kind`, and the text that is its own."""
    own = [prose(random.randrange(3, 40)) for _ in range(random.randrange(1, 6))]
    esc = lambda t: html.escape(t).replace(" ", random.choice([" ", "\n", "\t "]), 1)
    paras = "".join(f"<p>{esc(t)}" + random.choice(["</p>", ""]) for t in own)
    head, foot = "<head><title>T</title><style>p{}</style></head>", "<footer><p>All rights</p></footer>"
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a>" for i in range(4)) + "</ul>"
    body = {
        "article": f"<nav>{menu}</nav><article>{paras}<aside>aside</aside></article>",
        "main": f"<header>{menu}</header><main><header>{''.join(f'<h2>{esc(own[0])}</h2>')}</header>{''.join(f'<div>{esc(t)}</div>' for t in own[1:])}</main><div role='complementary'>more</div>",
        "blog": f"<div id='menu'>{menu}</div><main><article class='post'>{paras}</article><section class='comments-area'><article class='comment'><p>Nice</p></article></section></main>",
        "bare": f"<p>Welcome to this site</p>{''.join(f'<p>{esc(t)}</p>' for t in own)}<p>Write to us</p>",
        "table": f"<table><tr><td>Top of the site</td></tr>{''.join(f'<tr><td>{esc(t)}</td></tr>' for t in own)}<tr><td>Bottom</td></tr></table>",
    }[kind]
    return f"<html>{head}<body>{body}{foot}</body></html>", "\n".join(own)


def test_extraction_of_several_kinds_of_pages(spark):
    kinds = ["article", "main", "blog", "bare", "table"]
    pages = [(i * 10 + k, f"http://{kind}/a/{i}", *random_page(kind)) for k, kind in enumerate(kinds) for i in range(8)]
    again = [(1000, "http://bare/a/3?x", pages[27][2], pages[27][3]), (1001, "http://bare/a/3", pages[27][2], pages[27][3])]  # copies of one page of bare, beside it
    print_view = pages[26][2].replace("Welcome", "Print. Welcome")
    df = spark.createDataFrame([(i, u, h) for i, u, h, _ in pages + again], "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in page_text.extract_text(df).collect()}
    want = {i: t for i, _, _, t in pages + again}
    assert {i for i in want if got[i] != want[i]} == set()
    long = "".join(f"<p>{prose(30)}</p>" for _ in range(5))
    two = [(1, "http://x/1", f"<p>Menu</p>{long}<p>seen 3 times</p>"), (2, "http://x/1/print", f"<p>Menu</p>{long}<p>seen 4 times</p>")]  # a near copy is no site
    got = page_text.extract_text(spark.createDataFrame(two, "page_id long, url string, html string")).collect()
    assert all(len(r["text"].split("\n")) == 7 for r in got) and print_view


def test_shared_lines_is_a_longest_common_subsequence():
    for _ in range(200):
        a, b = [random.randrange(4) for _ in range(random.randrange(9))], [random.randrange(4) for _ in range(random.randrange(9))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = sorted(page_text.shared_lines(a, b).items())
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_forward_recursion_equals_the_sum_over_paths():
    rng = np.random.default_rng(2)
    k = 3
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.random((markov.CLASSES, k))
    hmm = markov.HiddenMarkov(start, move, emit)
    texts = [np.array([5, 9, 5, 0]), np.array([0]), np.array([7, 0])]

    def likelihood(x):
        return sum(start[p[0]] * math.prod(move[a, b] for a, b in zip(p, p[1:], strict=False)) * math.prod(emit[c, s] for c, s in zip(x, p, strict=True)) for p in itertools.product(range(k), repeat=len(x)))

    assert np.allclose(hmm.log10(texts), [math.log10(likelihood(x)) for x in texts])


def test_expected_counts_equal_the_sum_over_paths():
    rng = np.random.default_rng(7)
    k = 2
    hmm = markov.HiddenMarkov(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.random((markov.CLASSES, k)))
    texts = [np.array([5, 9, 5, 0]), np.array([0]), np.array([7, 0])]
    emitted, moved, started = np.zeros((markov.CLASSES, k)), np.zeros((k, k)), np.zeros(k)
    hmm.expected(texts, emitted, moved, started)
    want_e, want_m, want_s = np.zeros_like(emitted), np.zeros_like(moved), np.zeros_like(started)
    for x in texts:
        paths = list(itertools.product(range(k), repeat=len(x)))
        p = np.array([hmm.start[z[0]] * math.prod(hmm.move[a, b] for a, b in zip(z, z[1:], strict=False)) * math.prod(hmm.emit[c, s] for c, s in zip(x, z, strict=True)) for z in paths])
        for z, w in zip(paths, p / p.sum(), strict=True):
            want_s[z[0]] += w
            for c, state in zip(x, z, strict=True):
                want_e[c, state] += w
            for a, b in zip(z, z[1:], strict=False):
                want_m[a, b] += w
    assert all(np.allclose(x, y, atol=1e-4) for x, y in ((emitted, want_e), (moved, want_m), (started, want_s)))


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(8)
    for penalty in (0.5, 3.0):
        scores = rng.normal(size=(12, 3)).astype(np.float32)
        texts = [rng.integers(0, 12, n) for n in (0, 1, 5, 6, 3, 1)]
        worth = lambda t, z: sum(float(scores[w, s]) for w, s in zip(t, z, strict=True)) - penalty * sum(a != b for a, b in zip(z, z[1:], strict=False))  # noqa: B023, E731
        for t, z in zip(texts, language.viterbi(texts, scores, penalty), strict=True):
            best = max(worth(t, p) for p in itertools.product(range(3), repeat=len(t)))
            assert len(z) == len(t) and abs(worth(t, z) - best) < 1e-4


def test_training_passes():
    assert markov.ROUNDS == 6 and inspect.signature(markov.score_texts).parameters["rounds"].default == 6


def test_scoring_contract(spark, docs, nothing):
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    counts = Counter(w for i, t, _, _ in ROWS if train(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = sorted((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in markov.score_texts(docs, ~language.held_out(F.col("doc_id"), 1), rounds=2).collect())
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None])
    assert got == sorted((i, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(base(t), 6)) for i, t, _, _ in ROWS)
    assert markov.score_texts(nothing, F.lit(True), rounds=1).count() == 0


def test_one_state_is_the_smoothed_unigram_model(spark, docs):
    for r in markov.score_texts(docs, F.lit(True), states=1, rounds=1).collect():
        assert abs(r["score"] - r["base_score"]) < 0.02 * abs(r["base_score"]) + 2


def test_language_spans(spark, nothing):
    en, el = ["the of and stone river with that from", "and the iron cloud of that river"], ["και το νερό της πέτρας από", "το νερό και η πέτρα"]
    rows = [(i, random.choice(en), "en", "a") for i in range(20)] + [(30 + i, random.choice(el), "el", "a") for i in range(20)]
    model = language.train_language_model(table(spark, rows))
    assert model.languages == ["el", "en"]
    test = table(spark, [(1, en[0] * 3, "x", "a"), (2, el[0], None, "a"), (3, en[0] + " " + el[0] + " " + el[1], None, "a"), (4, "12 !!", None, "a"), (5, None, None, "a"), (6, "", None, "a")])
    got = {r["doc_id"]: r for r in language.label_languages(test, model, keep=["doc_id", "score", "spans"]).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "el", "el", "und", "und", "und"]
    assert len(got[3]["spans_"]) == 2 and 0.5 < got[3]["score_"] < 1
    assert language.label_languages(nothing, model).count() == 0
    empty = language.train_language_model(nothing)
    assert {r["lang_pred"] for r in language.label_languages(test, empty).collect()} == {"und"}


def test_letters_of_unlearned_scripts_have_no_vote(spark):
    rows = [(i, "the of and stone river with that from", "en", "a") for i in range(20)]
    model = language.train_language_model(table(spark, rows))
    test = table(spark, [(1, "the stone нет вода река", None, "a"), (2, "нет вода", None, "a"), (3, "12 - 3", None, "a")])
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language.label_languages(test, model, keep=["doc_id"]).collect()}
    assert got == {1: ("en", round(8 / 19, 6)), 2: ("en", 0.0), 3: ("und", 0.0)}  # letters that nothing tells apart: the commonest language


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d = (prose(50) for _ in range(4))
    docs = table(spark, [(None, a, "en", "a"), (None, b, "en", "a"), (5, c, "en", "a"), (5, d, "en", "a"), (7, a, "en", "a"), (8, d, "en", "b")])
    left = corpus_pipeline.deduplicate(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(7, a), (None, b), (5, c), (5, d)])
    spark.createDataFrame([(1, b), (2, c)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in clean) == Counter([(None, a), (5, d), (7, a), (8, d)])


def test_labellers_that_never_meet_are_of_different_kinds():
    patterns = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]])
    counts = np.array([900, 40, 40, 20])
    assert [list(f) for f in quality.families(patterns, counts)] == [[0], [1], [2]]
    posterior = quality.label_posteriors(patterns, counts)
    assert (posterior > 0.5).tolist() == [False, True, True, True] and posterior[0] < 0.1
    assert not len(quality.label_posteriors(np.zeros((0, 3), int), np.zeros(0)))


@pytest.mark.parametrize("share", [0.05, 0.1])
def test_planted_accuracies_are_recovered(share):
    rng = np.random.default_rng(0)
    alarms, hits = np.array([0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05]), np.array([0.9, 0.8, 0.7, 0.6, 0.8, 0.5, 0.7, 0.6])
    bad = rng.random(100_000) < share
    votes = np.where(rng.random((len(bad), 8)) < np.where(bad[:, None], hits, alarms), quality.BAD, quality.GOOD)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts)
    assert abs(model.prior - share) < 0.005 and np.abs(model.rates[:, 1] - hits).max() < 0.06
    assert np.abs(model.rates[:, 0] - alarms).max() < 0.012
    said = (quality.label_posteriors(patterns, counts) > 0.5)[at.ravel()]
    any_vote = (votes == quality.BAD).any(axis=1)
    assert (said == bad).mean() > 0.995 and (said == any_vote).mean() < 0.9
    labelled = np.stack([np.bincount(at.ravel()[:5000], weights=bad[:5000] == k, minlength=len(patterns)) for k in (0, 1)], axis=1)
    assert (((quality.label_posteriors(patterns, counts, labelled) > 0.5)[at.ravel()]) == bad).mean() > 0.995


def test_gradient_of_the_scorer():
    rng = np.random.default_rng(1)
    sizes = np.array([12, 8, 9])
    slots, y = rng.integers(0, 50, sizes.sum()), np.array([1, 0, 1])
    w = np.zeros(quality.SLOTS, np.float32)
    w[:50] = rng.normal(size=50)

    def loss(weights, bias, c):
        total, at = 0.0, 0
        for n, label in zip(sizes, y, strict=True):
            own, at = slots[at : at + n], at + n
            z = bias + sum(float(weights[s]) * (1 if i < 8 else 1 / math.sqrt(max(quality.LEAST_TOKENS, (n - 8) / 3))) for i, s in enumerate(own))
            total += math.log1p(math.exp(-z if label else z)) * (label == c)
        return total

    got = quality.gradient(slots, sizes, y, quality.LinearScorer(w, 0.3))
    for c in (0, 1):
        for slot in (int(slots[0]), int(slots[13]), int(slots[-1])):
            up, down = w.astype(float), w.astype(float)
            up[slot] += 1e-4
            down[slot] -= 1e-4
            assert abs((loss(up, 0.3, c) - loss(down, 0.3, c)) / 2e-4 - got[c][slot]) < 1e-3
        assert abs((loss(w, 0.3 + 1e-4, c) - loss(w, 0.3 - 1e-4, c)) / 2e-4 - got[c][-1]) < 1e-3


def test_quality(spark, nothing):
    rows = [(i, prose(40), "en", "a") for i in range(60)] + [(100 + i, " | ".join(prose(30).split()), "en", "a") for i in range(12)] + [(200 + i, prose(20) + " idiot moron scum " + prose(10), "en", "a") for i in range(12)] + [(300, None, "en", "a"), (301, "", "en", "a")]
    got = {r["id"]: r for r in quality.classify_quality(table(spark, rows)).collect()}
    assert sum(got[i]["keep"] for i in range(60)) >= 58
    assert sum(not got[100 + i]["keep"] for i in range(12)) >= 11 and sum(not got[200 + i]["keep"] for i in range(12)) >= 11
    assert not got[300]["keep"] and not got[301]["keep"]
    assert quality.classify_quality(nothing).count() == 0
    labels = spark.createDataFrame([(i, int(i < 100), int(i >= 200)) for i in [*range(60), *range(100, 112), *range(200, 212), 999]] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    more = [*rows, (1, prose(40), "en", "a"), (1, prose(40), "en", "a"), (None, prose(40), "en", "a"), (400, prose(30_000), "en", "a")]  # ids given twice, a null id, a very long text
    got = quality.classify_quality(table(spark, more), labels).collect()
    assert len(got) == len(more) and all(r["keep"] for r in got if r["id"] is None or r["id"] == 400)
    assert sum(r["keep"] for r in got if r["id"] and 100 <= r["id"] < 212) <= 2
    assert quality.classify_quality(nothing, labels.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, nothing, tmp_path):
    import corpus_pipeline as pipeline

    a, b = prose(40), prose(60)
    rows = [(1, a, "en", "a"), (1, a, "en", "a"), (1, b, None, None), (None, None, "en", "a"), (2, "", "en", None), (2, " \n", "en", "b"), (3, prose(20_000), "en", "b")]
    docs = table(spark, rows).withColumn("row", F.lit("clash")).withColumn("component", F.lit(1))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    counts = {"language_id": 4, "ngram_jaccard": 6, "decontamination": 7}  # without letters; the second row of a text; none
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == pipeline.COLUMNS
        texts = Counter(r["text"] for r in left.collect())
        assert sum(texts.values()) == counts.get(name, sum(texts.values())) and {a, b} <= set(texts)
        empty = stage(spark, nothing, str(tmp_path))
        assert empty.columns == pipeline.COLUMNS and empty.count() == 0
    taken = Counter(r["text"] for r in pipeline.mix(spark, docs, "").collect())
    assert max(taken.values()) <= 4 and not {None, "", " \n"} & set(taken)  # a is there twice
    placed = pipeline.shard(spark, docs, "").collect()
    assert len(placed) == len(rows) and pipeline.shard(spark, nothing, "").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(50), "en", "ab"[i % 2], 1) for i in range(20)]
    rows += [(50, rows[0][1], "en", "a", 1), (51, " ".join(rows[1][1].split()[:25]) + " " + prose(20), "en", "b", 1), (52, "123", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r["doc_id"] for r in out}
    assert not left & {50, 52, 3} and left <= set(range(20)) | {51}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "mixing", "sharding"]
