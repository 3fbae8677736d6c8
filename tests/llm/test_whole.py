"""Whole jobs: what bounds once left out."""

import numpy as np

from dealframe.llm import op1_quality, op4_embed_dedup, op6_langid, op8_chat, op10_decontam


def test_embeddings_at_many_cells(spark, monkeypatch):
    """Pairs at the threshold, with about a cell for every four vectors, and a few vectors of another length."""
    monkeypatch.setattr(op4_embed_dedup, "CELL_ROWS", 4)
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a, z = unit(rng.normal(size=(300, 64))), rng.normal(size=(300, 64))
    z = unit(z - (z * a).sum(1, keepdims=True) * a)
    cos = rng.uniform(0.9001, 0.92, size=(300, 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos * cos) * z])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0, 0.0]), (1001, [1.0, 0.1]), (1002, [0.0, 1.0])]
    got = {r["vec_id"]: r["n_links"] for r in op4_embed_dedup.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    assert link.sum() >= 600
    assert [got[i] for i in range(600)] == link.sum(1).tolist()
    assert [got[i] for i in (1000, 1001, 1002)] == [1, 1, 0]


def test_short_items_within_longer_texts(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three"), (4, "four words are enough"), (5, "this one has five words")]
    docs = [(i, f"some text before {t}, and after") for i, t in items] + [(i + 10, t) for i, t in items] + [(20, "beta and gamma, one or two or three"), (21, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op10_decontam.hits(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["similarity"], r["first_word"]) for r in got) == [(i, i, 1.0, 3) for i in range(1, 6)] + [(i + 10, i, 1.0, 0) for i in range(1, 6)]


def test_every_language_is_learned(spark):
    rows = [(i, "".join(chr(0x4E00 + 8 * (i % 205) + j) for j in range(6)), f"l{i % 205:03d}") for i in range(205 * 6)]
    docs = spark.createDataFrame([*rows, (9999, "none", None)], "doc_id long, text string, lang string")
    model = op6_langid.train(docs, 3)
    assert model.langs == sorted({x for _, _, x in rows})


def test_crf_gradient_is_that_of_its_objective():
    rng = np.random.default_rng(8)
    s = op1_quality.lines_of(["A good line of words.\nAnother one follows here.\n", "#### $$$ !!!\n| | |", "", "one"], [1, 0, 1, 0])
    w, trans = rng.normal(size=op1_quality.WIDTH) * 0.3, rng.normal(size=(2, 2)) * 0.3
    _, gw, gt = op1_quality.objective(s, w, trans)
    for p, g in ((w, gw), (trans, gt)):
        for at in np.ndindex(p.shape):
            keep, h = p[at], 1e-5
            p[at] = keep + h
            up = op1_quality.objective(s, w, trans)[0]
            p[at] = keep - h
            down = op1_quality.objective(s, w, trans)[0]
            p[at] = keep
            assert g[at] == np.float64(g[at]) and abs((up - down) / (2 * h) - g[at]) < 1e-6


def test_crf_transitions_matter():
    """A line that tells little by itself goes with the lines around it, through the chain alone."""
    emit = np.array([2.0, -0.5, 2.0, -2.0, -0.5, -2.0])
    first = np.array([0, 3, 6])
    alone, _, _ = op1_quality.marginals(emit, first, np.zeros((2, 2)))
    chained, _, _ = op1_quality.marginals(emit, first, np.array([[1.5, -1.5], [-1.5, 1.5]]))
    assert (alone[1] < 0.5) and (chained[1] > 0.5) and (chained[4] < alone[4] < 0.5)
    texts = ["good words stand here.\nx\nmore good words stand here."] * 20 + ["$$$ ### !!!\nx\n### $$$ !!!"] * 20
    m = op1_quality.fit(texts, [1] * 20 + [0] * 20)
    assert m.trans[0, 0] + m.trans[1, 1] > m.trans[0, 1] + m.trans[1, 0] + 0.5


def test_training_rows_are_bounded_and_keep_their_own_label(spark):
    rows = [(1, f"text {i}", "en") for i in range(50)] + [(1, f"texto {i}", "es") for i in range(50)] + [(2, "nulle", None), (2, "deux", "fr")] + [(3, "same", "en")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op6_langid.sample(docs, 10, 10_000).collect()
    assert len(got) <= 30 and {r["lang"] for r in got} == {"en", "es", "fr"}
    assert all((r["text"].startswith("texto")) == (r["lang"] == "es") for r in got) and ("nulle" not in {r["text"] for r in got})
    assert len(op6_langid.sample(docs, 10, 1).collect()) == 3
    many = spark.createDataFrame([(5, f"line {i}") for i in range(500)] + [(6, "b"), (7, "c" * 99)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (7, 0)], "doc_id long, quality int")
    seen = []
    keep, op1_quality.fit = op1_quality.fit, lambda t, y, **k: seen.append((t, y))
    try:
        op1_quality.train(many, labels, 10)
        op1_quality.train(many, labels, 10, 3)
    finally:
        op1_quality.fit = keep
    assert all(len(t) <= 2 and len(t) == len(y) and "c" * 99 not in t for t, y in seen) and sum(map(len, seen[1][0])) <= 3


def test_reply_cycles_end(spark):
    rows = [("t", 1, 2), ("t", 2, 1), ("t", 3, 1), ("t", 4, None), ("t", 5, 4), ("u", 7, 7), ("v", 8, 99), ("w", 1, None)] + [("x", i, i - 1 if i else 30) for i in range(31)]
    df = spark.createDataFrame([(t, i, p, "user", f"m{i}", 0.0, 1) for t, i, p in rows], "tree string, id long, parent long, role string, text string, score double, rank int")
    got = {(r["tree"], r["leaf"]): [x["text"] for x in r["turns"]] for r in op8_chat.branches(df).collect()}
    assert got == {("t", 5): ["m4", "m5"], ("v", 8): ["m8"], ("w", 1): ["m1"]}


def test_turns_are_numbered_whatever_their_ranges(spark):
    rows = [(1, i // 2, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)] + [(None, i, None, None) for i in range(40)] + [(2, 0, "a", "b")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = op8_chat.from_turns(df.withColumn("id", df.turn)).collect()
    for none, conv, n in ((False, 1, 300), (True, 0, 40), (False, 2, 3)):
        mine = sorted((r for r in got if r["tree"]["none"] == none and r["tree"]["conv_id"] == conv), key=lambda r: r["id"])
        assert [r["id"] for r in mine] == list(range(1, n + 1)) and [r["parent"] for r in mine] == [None, *range(1, n)]
        if conv == 1:
            assert [r["text"] for r in mine] == [t for _, _, _, t in sorted(rows[:300], key=lambda x: x[1:])]


def test_hot_vectors_and_the_share_of_visits(spark, monkeypatch):
    monkeypatch.setattr(op4_embed_dedup, "HOT", 3)
    rows = [(i, [1.0, 0.0, -0.0]) for i in range(10)] + [(20, [0.0, 1.0, 0.0]), (21, [0.0, 1.0, 0.0]), (22, [0.0, 0.0, 2.0]), (23, [1.0, 0.001, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op4_embed_dedup.neighbours(df).collect()}
    assert got == {**{i: (10, 0, i == 0) for i in range(10)}, 20: (1, 20, True), 21: (1, 20, False), 22: (0, 22, True), 23: (10, 0, False)}


def test_every_window_finds_no_more_and_the_blocks_prune(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    (index,) = op10_decontam.Index.by_length([i for i, _ in items], [t for _, t in items], 5, 0.8)
    words = op10_decontam.word_reader()
    looked = passed = found = 0
    for _, t in docs:
        for _, _, data, offs in op10_decontam.blocks(op10_decontam.normal(op10_decontam.pa.array([t], op10_decontam.pa.large_string()))):
            st, en, _ = words.spans(data, offs)
            h = words.hashes(data, st, en)[:1500]
            got = index.search(h)
            assert got == index.search(h, every=True)
            found += len(got)
            s = op10_decontam.shingles(h, 5)
            for n, g in index.groups.items():
                if len(s) >= n:
                    prints = op10_decontam.fingerprints(s, n - 4)
                    looked += len(prints) * len(g.items)
                    passed += sum(len(w) for w, _ in g.survivors(prints))
    assert found and looked > 100_000 and passed < 0.01 * looked


def test_passes_of_a_large_benchmark_agree(spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(8 + i % 5))) for i in range(40)]
    docs = spark.createDataFrame([(i, f"a b c {t} d e", i) for i, t in items] + [(99, None, 0)], "doc_id long, text string, similarity int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, rows, size = (sorted(tuple(r) for r in op10_decontam.hits(docs, bench, **k).collect()) for k in ({}, {"items_max": 7}, {"items_bytes": 300}))
    assert one == rows == size and [r[:2] for r in one] == [(i, i) for i, _ in items]


def test_fingerprints_of_windows_with_repeated_shingles():
    rng = np.random.default_rng(1)
    for kinds in (2, 9, 400):
        s = rng.integers(1, 1 << 63, kinds, dtype=np.uint64)[rng.integers(0, kinds, 300)]
        for width in (1, 7, 60, 300):
            want = [op10_decontam.fingerprint(*op10_decontam.bag(s[i : i + width])) for i in range(300 - width + 1)]
            assert (op10_decontam.fingerprints(s, width) == np.array(want)).all()


def test_items_with_repeated_words_are_found():
    """Items with a word said many times, against windows whose weighted similarity is just above the threshold."""
    rng = np.random.default_rng(6)
    hit = tried = 0
    for n in range(300):
        plain, again = int(rng.integers(60, 200)), int(rng.integers(5, 40))
        item = [f"w{n}_{i}" for i in range(plain)] + [f"r{n}"] * again
        text = list(item)
        index = op10_decontam.Index([1], [" ".join(item)], 5, 0.8)
        want = index.bags[0]
        # Words change from the end until the similarity would fall below the threshold.
        read = lambda words: op10_decontam.shingles(index.words.hashes(*(lambda d, o: (d, *index.words.spans(d, o)[:2]))(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))), 5)
        for i in range(len(text) - 1, -1, -1):
            new = text[:i] + [f"o{n}"] + text[i + 1 :]
            if op10_decontam.similarity(op10_decontam.bag(read(new)), want) < 0.8:
                break
            text = new
        s = op10_decontam.similarity(op10_decontam.bag(read(text)), want)
        if 0.8 <= s <= 0.82:
            tried += 1
            words = np.frombuffer(" ".join(text).encode(), np.uint8)
            st, en, _ = index.words.spans(words, np.array([0, len(words)]))
            hit += bool(index.search(index.words.hashes(words, st, en)))
    assert tried > 150 and hit >= 0.99 * tried
