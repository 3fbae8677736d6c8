"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a block of texts are walked as a trie (in sorted order,
keeping the stack of the current path, with the state of an automaton over all pieces
that names those which end there). Counts stored at terminals serve later blocks too. The unigram forward score of a node, with
the tokens on its best path, depends on its prefix alone and is computed once for
all pre-tokens below it; the count at a terminal is stored and summed over each
text. Pre-tokens and scores are those of the SentencePiece operator, so a count is
the length of its encoding.

Defined cases: null and empty texts count 0; unknown characters count their UTF-8
bytes; on equal scores the longer last piece wins; repeated rows are counted each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dealframe.llm._common import append_columns, table
from dealframe.llm._pieces import LITERAL, SPACE, Pieces, load, segments

#: Characters of a block of texts whose distinct pre-tokens share one trie; a longer text is a block alone.
BLOCK_CHARS = 4_000_000
#: Bytes of pre-tokens and counts that a worker remembers at most.
MEMORY_BYTES = 96_000_000


def _steps(token: str) -> list[str]:
    """Characters of a pre-token; a kept-apart character is one step that no piece covers."""
    if LITERAL not in token:
        return list(token)
    out, i = [], 0
    while i < len(token):
        n = 2 if token[i] == LITERAL else 1
        out.append(token[i : i + n])
        i += n
    return out


class Suffixes:
    """The pieces that end at a place, by an automaton over all pieces whose state a trie node carries.

    goto: edges by character; fail: the longest proper suffix that is a node; ends: the
    (length, score) of the pieces that are suffixes of the node, longest first.
    """

    def __init__(self, normal: dict[str, tuple[int, float]]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        own: list[tuple[int, float] | None] = [None]
        for piece, (_, score) in normal.items():
            at = 0
            for c in piece:
                to = self.goto[at].get(c)
                if to is None:
                    to = self.goto[at][c] = len(self.goto)
                    self.goto.append({})
                    own.append(None)
                at = to
            own[at] = (len(piece), score)
        self.fail = [0] * len(self.goto)
        self.ends: list[tuple[tuple[int, float], ...]] = [()] * len(self.goto)
        todo = [0]
        for at in todo:
            for c, to in self.goto[at].items():
                up = self.fail[at]
                while at and c not in self.goto[up] and up:
                    up = self.fail[up]
                self.fail[to] = self.goto[up].get(c, 0) if at else 0
                rest = self.ends[self.fail[to]]
                self.ends[to] = (own[to], *rest) if own[to] else rest
                todo.append(to)

    def step(self, at: int, c: str) -> int:
        goto = self.goto
        while c not in goto[at]:
            if not at:
                return 0
            at = self.fail[at]
        return goto[at][c]


def terminal_counts(tokens: set[str], vocab: Pieces, suffixes: Suffixes | None = None) -> dict[str, int]:
    """Tokens on the best path of each distinct pre-token.

    The stack holds one entry a character of the current path: the best score there, its
    tokens, and the automaton's state; a pre-token starts from what it shares with the last.
    """
    suffixes = suffixes or Suffixes(vocab.normal)
    normal, unk, low = vocab.normal, vocab.unk_score, float("-inf")
    goto, fail, ends = suffixes.goto, suffixes.fail, suffixes.ends
    out: dict[str, int] = {}
    last: str | list[str] = ""
    best, count, state = [0.0], [0], [0]
    for token, steps in sorted(((t, _steps(t) if LITERAL in t else t) for t in tokens), key=lambda x: list(x[1])):
        n = 0
        for a, b in zip(last, steps, strict=False):
            if a != b:
                break
            n += 1
        del best[n + 1 :], count[n + 1 :], state[n + 1 :]
        at = state[n]
        for c in steps[n:] if n else steps:
            n += 1
            while c not in goto[at]:
                if not at:
                    break
                at = fail[at]
            at = goto[at].get(c, 0)
            top, on = low, 0
            for k, score in ends[at]:
                value = best[n - k] + score
                if value > top:
                    top, on = value, count[n - k] + 1
            if c not in normal and best[n - 1] + unk > top:
                raw = {LITERAL + "1": SPACE, LITERAL + "0": LITERAL}.get(c, c)
                top, on = best[n - 1] + unk, count[n - 1] + len(raw.encode("utf-8", "surrogatepass"))
            best.append(top)
            count.append(on)
            state.append(at)
        last = steps
        out[token] = count[-1]
    return out


#: Automata, and counts of pre-tokens seen before, of this worker; tasks share them.
_KNOWN: dict[str, tuple[Suffixes, dict[str, int], list[int]]] = {}


def _known(name: str, vocab: Pieces) -> tuple[Suffixes, dict[str, int], list[int]]:
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = Suffixes(vocab.normal), {}, [0]
    return _KNOWN[name]


def counts_of(tokens: set[str], name: str, vocab: Pieces) -> dict[str, int]:
    """Counts of pre-tokens, those seen before from memory; memory is bounded in bytes and starts anew when full."""
    suffixes, memory, used = _known(name, vocab)
    new = tokens - memory.keys()
    size = sum(map(len, new)) + 120 * len(new)
    if used[0] + size > MEMORY_BYTES:
        memory.clear()
        used[0], new = 0, tokens
        size = sum(map(len, new)) + 120 * len(new)
    found = terminal_counts(new, vocab, suffixes)
    if size > MEMORY_BYTES:
        return found
    memory.update(found)
    used[0] += size
    return memory


def with_counts(docs: DataFrame, vocab: Pieces, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns), n_pretokens and n_tokens of the whole text."""
    held, name = docs.sparkSession.sparkContext.broadcast(vars(vocab)), uuid.uuid4().hex

    def make():
        vocab = Pieces(**held.value)

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            pre, tok = [], []
            rows, size = [], 0

            def flush() -> None:
                counts = counts_of(set().union(*rows), name, vocab)
                for r in rows:
                    pre.append(len(r))
                    tok.append(sum(map(counts.__getitem__, r)))

            for x in b.column("text"):
                text = x.as_py() or ""
                rows.append(segments(text, vocab))
                size += len(text)
                if size >= BLOCK_CHARS:
                    flush()
                    rows, size = [], 0
            if rows:
                flush()
            return [pa.array(pre, pa.int64()), pa.array(tok, pa.int64())]

        return batch

    return append_columns(docs, docs.columns if keep is None else keep, [("n_pretokens", T.LongType()), ("n_tokens", T.LongType())], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), load(), ["doc_id"])
