"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi pass.

The automaton holds all pieces. One pass over a segment visits every piece that
ends at each position (the automaton follows its output links, longest first) and
relaxes the best score there; back pointers give the pieces. A character that is
no piece costs the lowest score less a penalty and becomes its UTF-8 byte pieces.
Scores are those of the model file, read as unigram log-scores; on equal scores
the longer last piece wins. Texts are cut where no piece can cross (before runs of
space marks, around line breaks), so whole texts are encoded in bounded memory and
segments that recur are looked up.

Defined cases: null and empty texts have no ids and decode to empty text; a space
mark U+2581 in a text is encoded in bytes and comes back as itself; decoding an
encoding gives the text, character for character; repeated rows are encoded each;
other columns are ignored unless kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dealframe.llm._common import append_columns, table
from dealframe.llm._pieces import Pieces, load, original, segments

#: Bytes of segments and their ids remembered by a task at most; when full the memory starts anew.
MEMORY_BYTES = 64_000_000


class Encoder:
    def __init__(self, vocab: Pieces) -> None:
        import ahocorasick

        self.vocab, self.known, self.used = vocab, {}, 0
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in vocab.normal.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.singles = {p for p in vocab.normal if len(p) == 1}

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best path of s."""
        if not self.singles.issuperset(s):
            return self._with_unknown(s)
        low = float("-inf")
        best, start, piece = [0.0] + [low] * len(s), [0] * (len(s) + 1), [0] * (len(s) + 1)
        for end, (n, i, score) in self.automaton.iter(s):
            end += 1
            value = best[end - n] + score
            if value > best[end]:
                best[end], start[end], piece[end] = value, end - n, i
        out, p = [], len(s)
        while p:
            out.append(piece[p])
            p = start[p]
        return out[::-1]

    def _with_unknown(self, s: str) -> list[int]:
        """The same with unknown steps over characters that are no piece."""
        unk, low = self.vocab.unk_score, float("-inf")
        best, back = [0.0] + [low] * len(s), [(0, -1)] * (len(s) + 1)
        done = 0

        def settle(upto: int) -> None:
            # After the pieces that end there, before any that starts there.
            for p in range(done, upto):
                if s[p] not in self.singles and best[p] + unk > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + unk, (p, -1)

        for end, (n, i, score) in self.automaton.iter(s):
            if end > done:
                settle(end)
                done = end
            value = best[end + 1 - n] + score
            if value > best[end + 1]:
                best[end + 1], back[end + 1] = value, (end + 1 - n, i)
        settle(len(s))
        out, p = [], len(s)
        while p:
            p0, i = back[p]
            if i >= 0:
                out.append(i)
            else:
                out += [self.vocab.byte_ids[b] for b in reversed(s[p0:p].encode("utf-8", "surrogatepass"))]
            p = p0
        return out[::-1]

    def segment(self, s: str) -> bytes:
        ids: list[int] = []
        for run, known in original(s):
            ids += self.viterbi(run) if known else [self.vocab.byte_ids[b] for b in run.encode()]
        return np.asarray(ids, np.int32).tobytes()

    def encode(self, text: str | None) -> bytes:
        """int32 ids of a whole text."""
        known, out = self.known, []
        for s in segments(text or "", self.vocab):
            ids = known.get(s)
            if ids is None:
                ids = self.segment(s)
                size = 4 * len(s) + len(ids) + 150
                if self.used + size > MEMORY_BYTES:
                    known.clear()
                    self.used = 0
                if size <= MEMORY_BYTES // 64:
                    known[s] = ids
                    self.used += size
            out.append(ids)
        return b"".join(out)


def decode(ids: list[int], vocab: Pieces) -> str:
    """The text of an encoding; the mark put before the text is taken off."""
    return b"".join(map(vocab.texts.__getitem__, ids))[1:].decode("utf-8", "replace")


def with_ids(docs: DataFrame, vocab: Pieces, keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """``keep`` (default: all columns) and the ids of the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(vars(vocab))

    def make():
        enc = Encoder(Pieces(**held.value))

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            got = [enc.encode(x.as_py()) for x in b.column("text")]
            offs = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in got], out=offs[1:])
            return [pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(got), np.int32)))]

        return batch

    return append_columns(docs, docs.columns if keep is None else keep, [(out, T.ArrayType(T.IntegerType()))], make)


def with_text(tokens: DataFrame, vocab: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the decoded text of ``ids`` (null ids: empty)."""
    held = tokens.sparkSession.sparkContext.broadcast(vars(vocab))

    def make():
        vocab = Pieces(**held.value)
        return lambda b: [pa.array([decode(x.as_py() or [], vocab) for x in b.column(ids)], pa.string())]

    return append_columns(tokens, tokens.columns, [(out, T.StringType())], make)


def encoded(docs: DataFrame, vocab: Pieces) -> DataFrame:
    """(doc_id, n_tokens, ids, n_chars_decoded, round_trip) of every row, coded and decoded in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(vars(vocab))

    def make():
        vocab = Pieces(**held.value)
        enc = Encoder(vocab)

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            got, chars, same = [], [], []
            for x in b.column("text"):
                text = x.as_py() or ""
                got.append(enc.encode(text))
                back = decode(np.frombuffer(got[-1], np.int32).tolist(), vocab)
                chars.append(len(back))
                same.append(back == text)
            sizes = np.array([len(x) // 4 for x in got], np.int64)
            offs = np.zeros(len(got) + 1, np.int32)
            np.cumsum(sizes, out=offs[1:])
            ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(got), np.int32)))
            return [pa.array(sizes), ids, pa.array(chars, pa.int64()), pa.array(same)]

        return batch

    new = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("n_chars_decoded", T.LongType()), ("round_trip", T.BooleanType())]
    return append_columns(docs.select("doc_id", "text"), ["doc_id"], new, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), load())
