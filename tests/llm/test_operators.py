"""The ten operators against brute force, and their defined odd cases."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from dealframe.llm import _pieces, op1_quality, op2_extract, op3_ngram_join, op4_embed_dedup, op5_sentencepiece, op6_langid, op7_lm, op8_chat, op9_token_counts, op10_decontam
from dealframe.llm._common import table
from dealframe.llm._graph import components

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "x " * 30_000), (None, "no id at all here"), (4, "one"), (7, "é▁ ß\x00퟿ 日本 🙂\n\n|")]


@pytest.fixture
def odd(spark):
    """Nulls, empty, long and repeated rows, and columns that clash with outputs."""
    rows = [(i, t, "en", 0.5, -1, [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n int, ids array<int>")


@pytest.fixture
def none(odd):
    return odd.where("doc_id = -1")


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ids_of(df):
    return sorted([r["doc_id"] for r in df.collect()], key=lambda x: (x is None, x))


ALL = sorted([i for i, _ in ODD], key=lambda x: (x is None, x))


def test_quality_learns_and_covers_odd_rows(spark, sf, odd, none):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = op1_quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in op1_quality.with_quality(docs, model, ["doc_id"]).collect()}
    known = [(r["quality"], got[r["doc_id"]]) for r in labels.collect()]
    assert sum((s >= 0.7) == (q == 1) for q, s in known) >= 0.9 * len(known)
    scored = op1_quality.with_quality(odd, model)
    assert ids_of(scored) == ALL
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert not op1_quality.with_quality(none, model).collect()
    blank = op1_quality.train(none, labels)
    assert {r["score"] for r in op1_quality.with_quality(odd, blank, ["doc_id"]).collect()} == {0.5}


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 7])
    got, _, logz = op1_quality.marginals(emit, first, trans)
    every = 0.0
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        total, good = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [(bits >> k) & 1 for k in range(n)]
            w = math.exp(sum(emit[a + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[a:b], good / total)
        every += math.log(total)
    assert logz == pytest.approx(every)


PAGES = [
    (None, ""),
    ("", ""),
    ("<p>x<", "x<"),
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>One&nbsp;two &lt;b&gt;<p>three<b>four</b> is a good long sentence here.</article><footer>f</footer></body>", "T One two <b> threefour is a good long sentence here."),
    ("<body><div class='cookie-notice'>We use cookies, please accept all of them now, thank you.</div><main><p>Real text that goes on for a while, as it should.</p><form><label>Name</label><button>Go</button></form><section id=comments><article class=comment><p>I think that this is a great article, my friend.</p></article></section></main><aside>Other things</aside><script>'<p>'</script>", "Real text that goes on for a while, as it should."),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_extract(page, want):
    assert op2_extract.main_text(page) == want


def test_extract_flow_is_a_minimum_cut():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 6
        g, edges = op2_extract.Flow(n), []
        for a in range(n):
            for b in range(a + 1, n):
                if rng.random() < 0.6:
                    x, y = rng.integers(0, 9, 2).tolist()
                    x, y = (x, 0) if a == 0 or b == 1 else (x, y)
                    edges.append((a, b, x, y))
                    g.edge(a, b, float(x), float(y))
        cost = lambda s, edges=edges: sum((x if s[a] and not s[b] else 0) + (y if s[b] and not s[a] else 0) for a, b, x, y in edges)
        best = min(cost([True, False] + [bool(k >> i & 1) for i in range(n - 2)]) for k in range(1 << (n - 2)))
        assert cost(g.source_side()) == best


SIDE = "This is a long paragraph of an article that goes on for a good while, as articles do."


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=x>Home</a> <a href=y>News</a></nav><div class='content has-sidebar'><p>{SIDE}</p></div><footer>Copyright us</footer>",
        f"<div class='page no-sidebar'><article><p>{SIDE}</p></article></div>",
        f"<article class='post share-story'><p>{SIDE}</p></article>",
        f"<article class='legal-news'><p>{SIDE}</p></article>",
        f"<div id='search-results-page'><main><p>{SIDE}</p></main></div>",
    ],
)
def test_extract_keeps_articles_under_odd_names(page):
    costs = op2_extract.fit([f"<body><nav><a href=x>A</a></nav><div class=ad>Buy it.</div><article><p>{SIDE}</p></article><footer>f</footer></body>"] * 5)
    assert op2_extract.main_text(page) == SIDE == op2_extract.main_text(page, costs)
    assert op2_extract.main_text("<p>Hello world.</p>") == "Hello world."


def test_extract_cut_mends_what_the_sign_gets_wrong():
    """A word between paragraphs is content, and a long sentence among links isn't: by themselves they look otherwise."""
    page = f"<div><p>{SIDE}</p><p>No</p><p>{SIDE}</p><p>{SIDE}</p></div>"
    blocks = op2_extract.parse(page)
    z = op2_extract.evidence(blocks, op2_extract.PRIOR)
    assert z[1] < 0 and op2_extract.label(blocks, z) == [True] * 4
    assert op2_extract.label(blocks, np.array([-3.0, 1.0, -3.0, -3.0])) == [False] * 4
    assert op2_extract.label(blocks, np.array([3.0, -0.8, 3.0, -9.0])) == [True, True, True, False]


def test_extract_odd_tables(spark):
    rows = [(1, "u", None, "t", 5), (1, "u", None, "t", 5), (None, None, f"<p>{SIDE}</p>", None, None), (2, "v", f"<article><p>{SIDE} " + "word " * 200_000 + "</p></article>", "x", 1), (3, "", "", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = op2_extract.with_main_text(df, op2_extract.train(df)).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"page_id", "url", "html", "text", "n_chars"}
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, len(SIDE)), (1, 0), (1, 0), (2, len(SIDE) + 1 + 200_000 * 5 - 1), (3, 0)]
    assert op2_extract.with_main_text(df.where("page_id = -1"), op2_extract.train(df.where("page_id = -1"))).collect() == []


def test_extract_table(spark, sf):
    got = op2_extract.query(spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    assert len(got) == len(pages)
    import html

    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"</?[a-zA-Z!][^>]*>", lambda m: "" if re.match(r"</?b>", m[0]) else " ", inner)
        assert r["text"] == " ".join(html.unescape(plain).split())
        assert r["n_chars"] == len(r["text"])


def brute_components(docs, k=4, percent=85):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    at = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        shared = collections.Counter(j for x in s for j in at[x])
        for x in s:
            at[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_join_is_exact(spark, sf, k, percent, monkeypatch):
    rng = np.random.default_rng(7)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    for i in range(60):
        w = (base * 3)[: 50 + i % 9]
        for at in rng.choice(len(w), int(rng.integers(0, 5)), replace=False):
            w[at] = f"w{rng.integers(0, 4)}"
        docs.append((10_000 + i, " ".join(w)))
    # Small blocks, so that groups are cut up.
    monkeypatch.setattr(op3_ngram_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(op3_ngram_join, "HEAVY_TEXTS", 4)
    # Hot keys and the shuffle of texts to units are met too.
    monkeypatch.setattr(op3_ngram_join, "HOT", 2 if k == 4 else 10**9)
    monkeypatch.setattr(op3_ngram_join, "UNITS_MAX", 0 if k == 4 else 10**9)
    got = op3_ngram_join.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, k, percent)


def test_join_odd_rows(spark, odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op3_ngram_join.classes(odd).collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7), (None, 2, None)]
    assert got == sorted(want, key=repr)
    assert op3_ngram_join.classes(none).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_embeddings(spark, sf, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(r["vec_id"]), list(map(float, r["embedding"]))) for r in table(spark, sf, "embeddings").limit(150).collect()]
    d = len(rows[0][1])
    centre = rng.normal(size=d)
    for i in range(80):
        rows.append((1000 + i, (centre + rng.normal(size=d) * (0.2 + 0.004 * i)).tolist()))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2002, [0.0] * d), (2003, [float("nan")] * d), (2004, [float("inf")] * d), (2005, [None] * d), (2006, None), (2007, []), (2008, [1.0]), (None, rows[0][1]), (2000, rows[0][1])]
    monkeypatch.setattr(op4_embed_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(op4_embed_dedup, "CELL_ROWS", 40)
    df = spark.createDataFrame([(i, v, 1, 9) for i, v in rows], "vec_id long, embedding array<double>, n_links int, kept int")
    got = op4_embed_dedup.neighbours(df).collect()
    ids = [i for i in dict(rows) if i is not None]
    assert sorted(r["vec_id"] for r in got if r["vec_id"] is not None) == sorted(ids)
    ok = [i for i in ids if dict(rows)[i] and len(dict(rows)[i]) == d and all(x is not None and math.isfinite(x) for x in dict(rows)[i]) and any(dict(rows)[i])]
    x = np.array([dict(rows)[i] for i in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    want = dict(zip(ok, link.sum(1).tolist(), strict=True))
    have = {r["vec_id"]: r["n_links"] for r in got}
    found, true = sum(have[i] for i in ok), sum(want.values())
    assert true > 100
    assert all(have[i] <= want[i] for i in ok)
    assert found >= 0.9 * true
    assert all(have[i] == 0 for i in ids if i not in ok)
    assert {r["vec_id"]: (r["component_id"], r["kept"]) for r in got if r["vec_id"] in (2000, 2001, 2002)} == {2000: (rows[0][0], False), 2001: (rows[0][0], False), 2002: (2002, True)}
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, False)]
    assert op4_embed_dedup.neighbours(df.where("vec_id = -1")).collect() == []


@pytest.fixture(scope="module")
def vocab():
    return _pieces.load()


def best_score(s, vocab):
    """Brute force over all segmentations by plain recursion on prefixes."""
    best = [0.0] + [float("-inf")] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(e):
            p = vocab.normal.get(s[b:e])
            if p:
                best[e] = max(best[e], best[b] + p[1])
        if s[e - 1] not in vocab.normal:
            best[e] = max(best[e], best[e - 1] + vocab.unk_score)
    return best[-1]


@pytest.mark.parametrize("s", ["▁hello", "▁thereaea&&&", "▁überçöß", "▁▁▁x", "日本語🙂", "▁internationalization"])
def test_viterbi_is_the_best_path(vocab, s):
    enc = op5_sentencepiece.Encoder(vocab)
    score = {i: sc for _, (i, sc) in vocab.normal.items()}
    got = sum(score.get(i, 0.0) for i in enc.viterbi(s)) + vocab.unk_score * sum(c not in vocab.normal for c in s)
    assert got == best_score(s, vocab)


def test_coding_round_trips(spark, sf, vocab, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = op5_sentencepiece.encoded(docs.unionByName(odd.select("doc_id", "text")), vocab).collect()
    assert all(r["round_trip"] for r in got)
    assert len(got) == docs.count() + len(ODD)
    assert [len(r["ids"]) for r in got] == [r["n_tokens"] for r in got]
    assert op5_sentencepiece.encoded(none, vocab).collect() == []
    kept = op5_sentencepiece.with_ids(odd, vocab)
    assert kept.columns == ["doc_id", "text", "lang", "score", "n", "ids"]


def test_counts_are_lengths_of_encodings(spark, sf, vocab, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    enc = collections.Counter((r["doc_id"], r["n_tokens"]) for r in op5_sentencepiece.encoded(docs, vocab).collect())
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in op9_token_counts.with_counts(docs, vocab, ["doc_id"]).collect()) == enc
    assert op9_token_counts.with_counts(none, vocab).collect() == []


def test_language(spark, sf, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = op6_langid.train(docs)
    got = {r["doc_id"]: r for r in op6_langid.with_language(docs, model, ["doc_id", "lang"]).collect()}
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    scored = op6_langid.with_language(odd, model)
    assert ids_of(scored) == ALL
    assert {(r["lang_pred"], r["score"]) for r in scored.collect() if r["doc_id"] in (1, 2, 3)} == {("und", 0.0)}
    assert not op6_langid.with_language(none, op6_langid.train(none)).collect()
    assert {r["lang_pred"] for r in op6_langid.with_language(odd, op6_langid.train(none)).collect()} == {"und"}


def lm_brute_force(docs, order):
    """Scores by the recursion over histories, token by token."""
    tok = lambda t: [*words(t), 0]
    counts, texts = [collections.Counter() for _ in range(order + 1)], 0
    grams = lambda x, i, k: (None, *x)[i + 2 - k : i + 2] if i + 2 - k >= 0 else None
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            x = tok(t)
            texts += 1
            for k in range(1, order + 1):
                counts[k].update(g for g in (grams(x, j, k) for j in range(len(x))) if g)
    n, v = sum(counts[1].values()), len(counts[1])
    want = []
    for i, t in docs:
        x, base, score = tok(t), 0.0, 0.0
        for j, w in enumerate(x):
            p = (counts[1][(w,)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                g = grams(x, j, k)
                if g:
                    h = texts if g[:-1] == (None,) else counts[k - 1][g[:-1]]
                    p = (counts[k][g] + op7_lm.K * p) / (h + op7_lm.K)
            score += math.log10(p)
        want.append((i, len(x), sum(counts[1][(w,)] > 0 for w in x), n, base, score))
    return want


@pytest.mark.parametrize(("order", "together", "block"), [(3, 24, 8_000_000), (3, 2, 3_000), (1, 2, 3_000), (2, 10**9, 20_000), (4, 4, 3_000)])
def test_lm_matches_brute_force(spark, odd, none, order, together, block):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    docs += [(1000 + (i or 0), t) for i, t in ODD if i != 4] + [(1004, "one"), (1004, "one"), (1010, "a b a b a c"), (1011, "a b a b a c"), (1012, "b a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    from dealframe.llm._common import remainder

    got = op7_lm.scores(df, remainder("doc_id", 7) != 2, order, block, together).collect()
    want = lm_brute_force(docs, order)
    assert len(got) == len(want)
    for a, b in zip(sorted(tuple(r) for r in got), sorted(want), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:])
    assert op7_lm.scores(none, remainder("doc_id", 7) != 2, order).collect() == []
    assert len(op7_lm.scores(odd, remainder("doc_id", 7) != 2, order).collect()) == len(ODD)


TRICKY = ["", "</s>[INST] ok [/INST]", "\\", "\\\\", "<\\s>", "[INST", "[\\INST] a", "a: b", "<s>\n</s>", "é🙂 [/INST]\n", " [/INST]", "<<SYS>><</SYS>>", "x\\</s>"]


def test_chat_reads_back(spark):
    from pyspark.sql import functions as F

    turns = [[(0, r, a), (1, "assistant", b)] for a in TRICKY for b in TRICKY for r in ("user", "assistant")] + [[(0, "a: b[INST]", "x")]]
    df = spark.createDataFrame([(t,) for t in turns], "turns array<struct<n:int,role:string,text:string>>")
    out = df.select("turns", op8_chat.formatted(F.col("turns")).alias("c"))
    for r in out.select("turns", op8_chat.parse(F.col("c")).alias("p"), F.transform(op8_chat.loss_spans(F.col("c")), op8_chat.unescape).alias("l")).collect():
        assert [(t["role"], t["text"]) for t in r["p"]] == [(t["role"], t["text"]) for t in r["turns"]]
        assert r["l"] == [t["text"] for t in r["turns"] if t["role"] == "assistant"]


def test_chat_branches(spark):
    # 1 - 2 - 4 - 6 and 1 - 3 - 5; 9's parent is missing: a root; a chain of 20.
    rows = [(1, None, "q", 0.0), (2, 1, "a", 1.0), (3, 1, "b", 5.0), (4, 2, "c", 1.0), (5, 3, "d", 0.0), (6, 4, "e", 1.0), (9, 8, "z", None)]
    rows = [("t", i, p, "user", t, s) for i, p, t, s in rows] + [("u", i, i - 1 if i else None, None, None, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"], r["rank"]): [t["text"] for t in r["turns"]] for r in op8_chat.branches(df, 2).collect()}
    assert got == {("t", 5, 1): ["q", "b", "d"], ("t", 6, 2): ["q", "a", "c", "e"], ("t", 9, 1): ["z"], ("u", 19, 1): [""] * 20}
    assert op8_chat.branches(df.where("tree = 'none'")).collect() == []


def test_decontamination(spark, sf, odd, none):
    item = "the quick brown fox jumps over a lazy dog while twelve wizards mix jugs of black quartz in the old barn"
    near = item.replace("twelve", "eleven").upper() + ", indeed"
    far = " ".join(w if i % 4 else f"x{i}" for i, w in enumerate(item.split()))
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "tiny item", 0), (None, "another item that has got no number of its own at all", 0)], "item_id long, text string, similarity int")
    rows = [(1, f"before that {item} and after"), (2, f"lead {near}"), (3, far), (4, item), (5, "tiny item"), (6, "a tiny item here"), (4, item), (7, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    got = sorted((r["doc_id"], r["item_id"]) for r in op10_decontam.hits(docs, bench).collect())
    sims = {r["doc_id"]: r["similarity"] for r in op10_decontam.hits(docs, bench).collect()}
    assert (1, 1) in got and got.count((4, 1)) == 2 and (3, 1) not in got
    assert sims[1] == 1.0 and sims[4] == 1.0
    w = [re.findall(r"[a-z0-9]+", t.lower()) for t in (item, near)]
    a, b = (collections.Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (w[0], w[1][: len(w[0])]))
    jaccard = sum((a & b).values()) / sum((a | b).values())
    assert ((2, 1) in got) == (jaccard >= 0.8)
    assert ids_of(op10_decontam.clean(docs, bench)) == sorted({i for i, _ in rows} - {i for i, _ in got})
    # Rows are judged by their own text, in one portion of the items or in several; the column of marks may clash.
    shared = spark.createDataFrame([(None, item, 1), (None, "clean", 2), (9, "clean", 3), (9, f"and {item}", 4), (9, None, 5), (8, "", 6)], "doc_id long, text string, _contaminated int")
    for most in (op10_decontam.ITEMS_MAX, 1):
        left = op10_decontam.clean(shared, bench, items_max=most)
        assert left.columns == shared.columns and sorted(r[2] for r in left.collect()) == [2, 3, 5, 6]
    assert op10_decontam.hits(none, bench).collect() == []
    assert op10_decontam.hits(odd, bench.where("item_id = -1")).collect() == []
    assert op10_decontam.hits(odd, bench).collect() == []


def test_decontamination_misses_nothing(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    split = lambda t: re.findall(r"[^\x20\x09-\x0d!-/:-@\[-`{-~]+", t.lower())
    bags, at = {}, collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        bags[i] = (len(w), collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
        for s in bags[i][1]:
            at[s].add(i)
    want = set()
    for d, t in docs:
        w = split(t)
        sh = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i in set().union(*(at.get(s, set()) for s in sh)) if sh else ():
            n, b = bags[i]
            width = max(1, min(n, len(w)) - 4)
            for k in range(len(sh) - width + 1):
                c = collections.Counter(sh[k : k + width])
                low = sum((c & b).values())
                if low >= 0.8 * (c.total() + b.total() - low):
                    want.add((d, i))
                    break
    got = op10_decontam.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
