"""Alignment, whitening and repeated substrings against brute force, and their defined odd cases."""

import collections
import hashlib
import random

import numpy as np
import pytest

from dealframe.llm import op11_align, op12_whitening, op13_repeats
from dealframe.llm._pieces import default_model
from dealframe.llm._common import table


def by_numpy(x, k):
    n = len(x)
    x = np.array(x, dtype=object)
    s = x.sum(0)
    dev = [int(v) for v in ((n * x - s) ** 2).sum(1)]
    z = ((n * x - s) / n).astype(float)
    cov = z.T @ z / n
    e, v = np.linalg.eigh(cov)
    return n, dev, e[::-1][:k], z @ v[:, ::-1][:, :k], np.trace(cov)


def check_whitening(rows, x, k):
    n, dev, e, proj, trace = by_numpy(x, k)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == n * k
    for c in range(k):
        mine = np.array([got[i, c + 1]["whitened"] for i in range(n)])
        theirs = proj[:, c] / np.sqrt(e[c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
        assert [got[i, c + 1]["explained"] for i in range(n)] == pytest.approx([e[c] / trace] * n, rel=1e-9)
    assert [got[i, 1]["deviation"] for i in range(n)] == dev
    assert {r["n"] for r in rows} == {n} and {r["identity_error"] for r in rows}.pop() < 1e-9


def test_whitening_agrees_with_a_dense_solver(spark, sf):
    vectors = table(spark, sf, "embeddings")
    held = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    ids = sorted(held)
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in held[i]] for i in ids]
    rows = op12_whitening.whitened(vectors).collect()
    at = {v: i for i, v in enumerate(ids)}
    check_whitening([dict(r.asDict(), vec_id=at[r["vec_id"]]) for r in rows], x, 8)


def test_whitening_of_odd_vectors(spark):
    v = [[0.5, 1.0, 2.0], [1.5, -1.0, 2.0], [2.5, 0.25, 2.0], [0.1, 0.2, 2.0]]
    odd = [(0, v[0]), (1, v[1]), (2, v[2]), (3, v[3]), (4, None), (5, [1.0, None, 0.0]), (6, [1.0, float("nan"), 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, [1.0, 2.0]), (9, []), (10, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in odd], "vec_id long, embedding array<double>, component string, n int")
    rows = op12_whitening.whitened(df).collect()
    assert len(rows) == 12 and {r["vec_id"] for r in rows} == {0, 1, 2, 3}
    assert {r["whitened"] for r in rows if r["component"] == 3} == {None}
    check_whitening([r for r in rows if r["component"] < 3], [[int(np.floor(1024 * c)) + 100_000 for c in e] for e in v], 2)
    same = spark.createDataFrame([(None, v[0]), (None, v[0]), (3, v[0])], "vec_id long, embedding array<double>")
    got = op12_whitening.whitened(same).collect()
    assert len(got) == 9 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in got)
    assert not op12_whitening.whitened(df.where("vec_id = -1")).collect()
    large = spark.createDataFrame([(i, [1e6 * i, -3e5 * i * i]) for i in range(5)], "vec_id long, embedding array<double>")
    x = [[int(1024 * 1e6 * i) + 100_000, int(np.floor(1024 * -3e5 * i * i)) + 100_000] for i in range(5)]
    check_whitening(op12_whitening.whitened(large).collect(), x, 2) if by_numpy(x, 2)[1][0] < 2**63 else None


@pytest.mark.parametrize("d, rank, basis", [(40, 40, 256), (300, 300, 60), (60, 3, 256), (200, 200, 60)])
def test_block_lanczos(d, rank, basis):
    """Clusters, low rank and a basis that is cut down again and again."""
    rng = np.random.default_rng(d + rank)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = np.where(np.arange(d) < rank, 0.9 ** np.arange(d), 0.0)
    e[:3] = e[0]
    a = q * e @ q.T
    got, v, worst = op12_whitening.lanczos(lambda p: a @ p, d, 8, basis=basis)
    assert np.abs(got - e[:8]).max() < 1e-12 and worst < 1e-11
    assert np.abs(v.T @ v - np.eye(8)).max() < 1e-12


def cut_by_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone[:-1]) if not g)).hexdigest()))
    return out


def cut_rows(df, size=None):
    got = op13_repeats.without_repeats(df, size).collect()
    return sorted(((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str)


@pytest.mark.parametrize("size", [op13_repeats.Sizes(), op13_repeats.Sizes(40, 4, 32, (8, 2, 1)), op13_repeats.Sizes(24, 16, 8, (1,))])
def test_repeats_by_brute_force(spark, monkeypatch, size):
    """Passages cut, shifted and joined in every way; runs of one byte; pieces smaller than a text."""
    monkeypatch.setattr(op13_repeats, "PIECE", 1000)
    rng = np.random.default_rng(size.length)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(2, 9)))
    passage = lambda n: " ".join(word() for _ in range(n))
    kept = [passage(int(size.length * f / 4)) for f in (0.7, 1, 1.5, 3)]
    texts = [None, "", "short", "short", "z" * (3 * size.length), "z" * (size.length + 7), passage(60), kept[3], kept[3], "ab" * size.length]
    for _ in range(40):
        parts = []
        for _ in range(rng.integers(1, 5)):
            k = kept[rng.integers(0, 4)]
            a = rng.integers(0, len(k) // 2)
            parts += [k[a : a + rng.integers(size.length // 2, 2 * size.length)], passage(int(rng.integers(0, 30)))]
        texts.append("".join(parts))
    rows = [(i % 45 if i else None, t, "x", 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_spans int").repartition(3)
    want = sorted(((i is None, i, *w) for (i, *_), w in zip(rows, cut_by_force(texts, size.length))), key=str)
    assert any(0 < w[3] < w[2] for w in want)
    assert cut_rows(df, size) == want
    assert not cut_rows(df.where("doc_id = -1"), size)


def test_pointers_are_the_leftmost_least():
    h = np.random.default_rng(3).integers(0, 5, 500).astype(np.uint64) << np.uint64(40)
    assert op13_repeats.pointers(h, 16).tolist() == [i + int(h[i : i + 16].argmin()) for i in range(485)]


def test_repeats_of_a_very_long_text(spark):
    """Ten million bytes on one line, half of them a copy of the other half."""
    half = np.random.default_rng(7).integers(97, 123, 5_000_000, dtype=np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, half + "|" + half), (2, "x" + half[:1000])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in op13_repeats.without_repeats(df).collect()}
    assert got == {1: (10_000_000, 2), 2: (1000, 1)}


def align_by_force(texts):
    """Whole texts, tokens and byte ranges compared as they are."""
    c = op11_align.Coders(op11_align.default_bpe(), default_model())
    docs, counts = [], collections.Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = c.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = c.b.encode(t, num_threads=1) if t else []
        if not t or not b"".join(c.a_bytes[i] for i in a) == whole == b"".join(c.b_bytes[i] for i in b):
            docs.append(([], [], [], ""))
            continue
        ea, eb = np.cumsum([len(c.a_bytes[i]) for i in a]), np.cumsum([len(c.b_bytes[i]) for i in b])
        sa, sb = np.r_[0, ea[:-1]], np.r_[0, eb[:-1]]
        pairs = [(a[i], b[j]) for i in range(len(a)) for j in np.flatnonzero((sb < ea[i]) & (sa[i] < eb))]
        cuts = sorted(set(ea) & set(eb))
        groups, low = [], 0
        for e in cuts:
            ids = [",".join(str(x[i]) for i in np.flatnonzero((ends > low) & (ends <= e))) for x, ends in ((a, ea), (b, eb))]
            groups.append("|".join(ids))
            low = e
        counts.update(pairs)
        docs.append((a, b, pairs, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return [(len(a), len(b), g.count("|") if a else 0, len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), sha(g)) for a, b, p, g in docs]


HARD = [None, "", " ", "\n", "\n\n \t x \n", "one", "one", "Héllo  wörld \n tabs\tand\r\nmore;\r\n\r\n  end \r\n", "▁ mark", "a▁b", "</s>[INST] <s> <|endoftext|> <0x0A> <unk>", "日本語 のテキスト　です", "a\u00a0b \u2003c\x1c d\x85e", "x" * 3000, "ab " * 2000, "don't we'll I'VE 'tis 12 345.67", "🙂🙂 ✓\ufffd \x00 nul", "e\u0301 combining ﬁ ｆｕｌｌ", "\u2581", "=" * 777 + "\n" + "-" * 99, "  lead", "trail  ", "\r\n", "a\n\n\nb  \n c"]


def test_alignment_by_brute_force(spark, sf, monkeypatch):
    """Odd texts and a whole table: units, pair counts, groups and links as those of whole texts."""
    texts = HARD + [r["text"] for r in table(spark, sf, "documents").collect()]
    rows = [(i if i != 5 else None, t, i, "x") for i, t in enumerate(texts)] + [(7, HARD[7], 7, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, unit string").repartition(3)
    want = align_by_force([t for _, t, _, _ in rows])
    want = sorted((str(i), *w) for (i, *_), w in zip(rows, want))
    assert sum(w[1] > 0 for w in want) > len(want) - 10
    monkeypatch.setattr(op11_align, "BLOCK_BYTES", 100_000)
    got = sorted((str(r["doc_id"]), *r[1:]) for r in op11_align.alignment(df).collect())
    assert got == want
    monkeypatch.setattr(op11_align, "PAIRS_MAX", 0)
    assert sorted((str(r["doc_id"]), *r[1:]) for r in op11_align.alignment(df).collect()) == want
    assert not op11_align.alignment(df.where("doc_id = -1")).collect()


def test_units_encoded_together_are_those_encoded_alone():
    c = op11_align.Coders(op11_align.default_bpe(), default_model())
    rng = random.Random(4)
    lens = [np.array([len(x) for x in t], np.int32) for t in (c.a_bytes, c.b_bytes)]
    units = [w for w in {u for _ in range(400) for u in c.units(" ".join("".join(rng.choice("aetns.,'0é中\U0001f600-\nX") for _ in range(rng.randint(1, 9))) for _ in range(5)).strip() or "a")}]
    for some in ([u for u in units if not u[-1].isspace()], units[:50], ["a", "\nb", "s"], ["\n"], [" "]):
        want = c.tokens(some)
        for side, (flat, offs) in enumerate(c.columns(some, lens)):
            assert [flat[i:j].tolist() for i, j in zip(offs, offs[1:])] == [x[side] for x in want]
    calls = []
    tokens, c.tokens = c.tokens, lambda t: calls.append(len(t)) or tokens(t)
    c.columns(["word"] * 640, lens)
    assert calls == [10]
