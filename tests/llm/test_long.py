"""Texts of very many lines: the chain in links and the features in pieces give what a plain walk gives."""

import time

import numpy as np
import pytest

from dealframe.llm import op1_quality as Q


def plain(emit, first, trans):
    """Forward-backward of each text, a line at a time."""
    good, pairs, logz = [], np.zeros((2, 2)), 0.0
    t = np.exp(trans)
    for a, b in zip(first[:-1], first[1:], strict=True):
        e = np.exp(np.stack([np.zeros(b - a), emit[a:b]], 1))
        fw, bw, scale = [e[0]], [np.ones(2)], 0.0
        for x in e[1:]:
            scale += np.log(fw[-1].sum())
            fw[-1] = fw[-1] / fw[-1].sum()
            fw.append((fw[-1] @ t) * x)
        for x in e[:0:-1]:
            v = t @ (x * bw[-1])
            bw.append(v / v.sum())
        bw = bw[::-1]
        logz += scale + np.log(fw[-1].sum())
        for i in range(1, b - a):
            j = fw[i - 1][:, None] * t * (e[i] * bw[i])[None]
            pairs += j / j.sum()
        post = np.array(fw) * np.array(bw)
        good.append(post[:, 1] / post.sum(1))
    return np.concatenate(good), pairs, logz


@pytest.mark.parametrize("chain", [1, 2, 5, 1024])
def test_links_change_nothing(monkeypatch, chain):
    monkeypatch.setattr(Q, "CHAIN", chain)
    rng = np.random.default_rng(4)
    size = np.array([1, 5, 23, 2, 11, 10, 1, 40])
    first = np.concatenate([[0], np.cumsum(size)])
    emit, trans = rng.normal(0, 3, size.sum()), rng.normal(0, 1, (2, 2))
    got, want = Q.marginals(emit, first, trans), plain(emit, first, trans)
    for g, w in zip(got, want, strict=True):
        assert np.allclose(g, w, atol=1e-10)


@pytest.mark.parametrize("most", [(1, 1), (40, 3), (1 << 20, 1 << 16)])
def test_pieces_change_nothing(monkeypatch, most):
    monkeypatch.setattr(Q, "PIECE_BYTES", most[0])
    monkeypatch.setattr(Q, "PIECE_LINES", most[1])
    rng = np.random.default_rng(5)
    model = Q.QualityModel(rng.normal(0, 1, Q.WIDTH), rng.normal(0, 1, (2, 2)), (2.0, 0.1))
    feats = Q.LineFeatures()
    words = ["a", "Bb", "é!", "12", "...", "|", "a a", "", "x y z w"]
    for n in (1, 2, 7, 60):
        text = "\n".join(" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(n)).encode()
        data = np.frombuffer(text, np.uint8)
        whole = model.documents(*feats(data, np.array([0, len(data)])))
        assert np.allclose(model.document(feats, data), whole, atol=1e-12)


def test_millions_of_lines_and_one_long_line(spark):
    model = Q.QualityModel(np.full(Q.WIDTH, 0.1), np.array([[0.5, -0.5], [-0.5, 0.5]]), (2.0, 0.0))
    texts = [(1, "a\n" * 2_000_000), (2, "word " * 2_000_000), (3, "\n" * 3_000_000), (4, "a\n" * 50)]
    began = time.time()
    got = {r["doc_id"]: r["score"] for r in Q.with_quality(spark.createDataFrame(texts, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert set(got) == {1, 2, 3, 4} and all(0 < v < 1 for v in got.values())
    assert abs(got[1] - got[4]) < 0.05
    assert time.time() - began < 60
