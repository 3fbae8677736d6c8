"""Cross-tokenizer alignment, relational: tokens exploded with their places, cumulative lengths, equal ends, running cuts.

A token's end is the windowed running sum of its byte length. Tokens of both sides meet
by equal (key, end), as one grouping, which is the full outer equi-join of two sides
that hold each end once. An end on both sides is a cut; the running count of cuts is
the group. Between two neighbouring ends of either side lies one token of A and one of
B, the next to end of each, so every such piece is a link and every link such a piece:
links come from the same window in linear time, where a range join within groups would
be quadratic in a group without cuts.

The relational part needs each distinct *unit* of text once: a unit is a run of white
space and what follows it, cut only before a space or line break that follows another
character. No token crosses such a place: the byte-level pre-tokenizer breaks between
other characters and white space, and no piece of B holds a space after another
character, or a line break. Where a vocabulary breaks this (``Coders.cuttable``), the
text is one unit. Counts of id pairs weigh each unit by its occurrences in the
corpus; per-unit results meet the documents in blocks of about BLOCK_BYTES of text:
each block gets the units that it holds, and sums and joins them in text order. Pair
counts are broadcast up to PAIRS_MAX rows and joined by a shuffle beyond.

Defined cases: null and empty texts, and texts that either vocabulary doesn't give back
byte by byte (such as those with U+2581), have no tokens: zeros and an empty
groups_sha256. Special tokens' strings are plain text. Null and repeated doc_ids stay,
a row each, and count as often as they stand; other columns are ignored; ties for the
highest count of a B id are all best; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealframe.llm._common import Scratch, Written, bound_batches, parts, table
from dealframe.llm._pieces import SPACE, default_model

#: Bytes of text in a block of documents, about; rows of pair counts that are broadcast at most; distinct units held by a task.
BLOCK_BYTES, PAIRS_MAX, HELD = 16_000_000, 1_000_000, 600_000
#: Units encoded at a time.
JOINED = 64
PACKED = {"compression": "zstd"}
STATS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", groups_sha256 string"

_ODD = re.compile(r"\s\s|[^\S \n]")
_UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")


def default_bpe() -> str:
    """Path of the public byte-level BPE file on this machine (a parameter everywhere else)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Coders:
    """Both tokenizers of a task, and the bytes of their tokens."""

    def __init__(self, bpe: str, model: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        kept = [not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)) for i in range(len(pieces))]
        self.mark = self.b.piece_to_id(SPACE)
        used = [p for i, p in enumerate(pieces) if kept[i] and not self.b.is_byte(i)]
        self.exact = self.a.normalizer is None and type(self.a.pre_tokenizer).__name__ == "ByteLevel"
        self.falls_back = any(self.b.is_byte(i) for i in range(len(pieces)))
        self.cuttable = self.exact and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in used)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        letters = byte_letters()
        return [bytes(letters[c] for c in (self.a.id_to_token(i) or "") if c in letters) for i in range(self.a.get_vocab_size())]

    @cached_property
    def b_bytes(self) -> list[bytes]:
        """Control pieces stand for nothing."""
        piece = lambda i: self.b.id_to_piece(i)
        text = lambda i: bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace(SPACE, " ").encode()
        return [b"" if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i) else text(i) for i in range(self.b.get_piece_size())]

    def tokens(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides for units as ``units`` writes them."""
        whole = [u if u[0] in " \n" else " " + u for u in units]
        fast = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a = [e.ids for e in fast(whole, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in whole], num_threads=1)
        # A lone space is B's mark; the mark that B puts before a line break is not part of it.
        b = [([self.mark] if u == " " else x) if u[0] == " " else x[1:] for u, x in zip(whole, b, strict=True)]
        return list(zip(a, b, strict=True))

    def columns(self, units: list[str], lens: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side all ids of the units, and the bounds of each unit's.

        Units that end in no white space are encoded JOINED at a time, as they may stand in
        a text, and taken apart where their bytes end; if a token crossed such a place, one by one.
        """
        whole = [u if u[0] in " \n" else " " + u for u in units]
        if self.cuttable and self.falls_back and self.plain and not any(u[-1].isspace() for u in whole):
            texts = ["".join(whole[i : i + JOINED]) for i in range(0, len(whole), JOINED)]
            bounds = np.cumsum([len(u.encode()) for u in whole])
            out = []
            for ids, n in zip(zip(*self.tokens(texts), strict=True), lens, strict=True):
                flat = np.fromiter((i for x in ids for i in x), np.int32)
                ends = np.cumsum(n[flat])
                at = np.searchsorted(ends, bounds, "right")
                if not len(ends) or ends[-1] != bounds[-1] or (at == 0).any() or (ends[at - 1] != bounds).any():
                    break
                out.append((flat, np.r_[0, at]))
            if len(out) == 2:
                return out
        found = self.tokens(units)
        return [(np.fromiter((i for x in found for i in x[side]), np.int32), np.r_[0, np.cumsum([len(x[side]) for x in found])]) for side in (0, 1)]

    def _kept(self, text: str) -> bool:
        return self.b.normalize(text) == SPACE + text.replace(" ", SPACE)

    @cached_property
    def plain(self) -> bool:
        """Whether B's normaliser changes no character and no run of spaces; if so, no text is normalised to see that."""
        every = "".join(chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000 and chr(i) != SPACE)
        return self._kept(every) and self._kept("  a  b  ")

    def lossless(self, text: str) -> bool:
        """Whether both sides give back a space and the text."""
        if self.exact and self.falls_back:
            return SPACE not in text and (self.plain or self._kept(text))
        a, b = self.tokens([" " + text])[0]
        whole = (" " + text).encode()
        return b"".join(self.a_bytes[i] for i in a) == whole == b"".join(self.b_bytes[i] for i in b)

    def units(self, text: str) -> list[str]:
        """The units of a space and the text, each without its leading space where no space or line break follows that."""
        if not self.cuttable:
            return [" " + text]
        if _ODD.search(text) or text[0].isspace() or text[-1].isspace():
            return [u[1:] if u[0] == " " and u[1:2] not in ("", " ", "\n") else u for u in _UNIT.findall(" " + text)]
        lines = text.split("\n")
        out = lines[0].split(" ")
        for line in lines[1:]:
            words = line.split(" ")
            words[0] = "\n" + words[0]
            out += words
        return out


def _counted(docs: DataFrame, blocks: int, files: tuple[str, str]) -> DataFrame:
    """(block, unit, n) of docs (block, text), summed a block at a time; a block of more than HELD units may have one in several rows."""

    def flush(held):
        for k, c in held.items():
            rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k, np.int32)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["block", "unit", "n"])
            for i in range(0, rows.num_rows, 20_000):
                yield rows.slice(i, 20_000)

    def run(batches):
        coders, held = Coders(*files), {}
        for b in batches:
            for block, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if (text := text.as_py()) and coders.lossless(text):
                    held.setdefault(block, Counter()).update(coders.units(text))
            if sum(map(len, held.values())) > HELD:
                yield from flush(held)
                held = {}
        yield from flush(held)

    # A block's documents meet in a task, which counts them whole: its units aren't shuffled from every task.
    return docs.select("block", "text").repartition(blocks, "block").mapInArrow(run, "block int, unit string, n long")


def _tokenized(units: DataFrame, files: tuple[str, str]) -> DataFrame:
    """(unit, n, a_ids, a_lens, b_ids, b_lens) of units (unit, n)."""

    def run(batches):
        coders = Coders(*files)
        lens = [np.array([len(x) for x in t], np.int32) for t in (coders.a_bytes, coders.b_bytes)]
        for b in batches:
            units = np.array(b.column(0).to_pylist(), object)
            spaced = np.array([u[-1].isspace() for u in units], bool)
            for some in (np.flatnonzero(~spaced), np.flatnonzero(spaced)):
                if not len(some):
                    continue
                out = []
                for (flat, offs), n in zip(coders.columns(units[some].tolist(), lens), lens, strict=True):
                    offs = pa.array(offs.astype(np.int32))
                    out += [pa.ListArray.from_arrays(offs, pa.array(flat)), pa.ListArray.from_arrays(offs, pa.array(n[flat]))]
                part = b.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *out], names=["unit", "n", "a_ids", "a_lens", "b_ids", "b_lens"])

    kinds = ", ".join(f"{c} array<int>" for c in ("a_ids", "a_lens", "b_ids", "b_lens"))
    return units.mapInArrow(run, f"unit string, n long, {kinds}")


def links(tokens: DataFrame, partitions: int) -> DataFrame:
    """(key, n, end, ga, a_end, b_end, a, b): a row for each link of tokens (key, n, a_ids, a_lens, b_ids, b_lens).

    a and b: the linked ids; a_end and b_end: the id of the token that ends here, if
    one does; ga: the group, counted from the last one.
    """

    def places(side: str) -> Column:
        return F.transform(F.arrays_zip(f"{side}_ids", f"{side}_lens"), lambda t, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), t[f"{side}_ids"].alias("id"), t[f"{side}_lens"].alias("len")))

    dealt = tokens.repartition(partitions, "key")
    each = dealt.select("key", "n", F.inline(F.concat(places("a"), places("b"))))
    ends = each.withColumn("end", F.sum("len").over(Window.partitionBy("key", "side").orderBy("pos")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id"))).alias(f"{side}_end")
    met = ends.groupBy("key", "n", "end").agg(of("a"), of("b"))
    back = Window.partitionBy("key").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a_end").isNotNull() & F.col("b_end").isNotNull()).cast("int")
    return met.withColumns({"ga": F.sum(cut).over(back), "a": F.last("a_end", True).over(back), "b": F.last("b_end", True).over(back)})


def _pairs(found: DataFrame) -> DataFrame:
    """(a, b, count, best) of each linked pair of ids."""
    counts = found.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = F.max("count").over(Window.partitionBy("b"))
    return counts.withColumn("best", (F.col("count") == top).cast("int"))


def _groups_text(rows: Column) -> Column:
    """`a1,a2|b1;a3|b2` of (end, a_end, b_end) in order."""
    put = lambda held, x: F.when(x.isNull(), held).otherwise(F.concat(held, F.when(held == "", "").otherwise(","), x.cast("string")))

    def step(s, r):
        a, b = put(s["a"], r["a_end"]), put(s["b"], r["b_end"])
        whole = F.concat(s["done"], F.when(s["done"] == "", "").otherwise(";"), a, F.lit("|"), b)
        cut = r["a_end"].isNotNull() & r["b_end"].isNotNull()
        empty = F.lit("")
        return F.when(cut, F.struct(whole.alias("done"), empty.alias("a"), empty.alias("b"))).otherwise(F.struct(s["done"].alias("done"), a.alias("a"), b.alias("b")))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("a"), F.lit("").alias("b"))
    return F.aggregate(rows, start, step, lambda s: s["done"])


def aligned(tokens: DataFrame) -> Written:
    """(key, STATS, groups) of each key of tokens (key, n, a_ids, a_lens, b_ids, b_lens); n: how often it stands in the corpus."""
    found = Written(links(tokens, parts(tokens.sparkSession)), **PACKED)
    counts = Written(_pairs(found.df))
    pairs = F.broadcast(counts.df) if counts.df.count() <= PAIRS_MAX else counts.df
    ends = F.array_sort(F.collect_list(F.struct("end", "a_end", "b_end")))
    sums = [F.count("a_end"), F.count("b_end"), F.max("ga"), F.count("*"), F.sum("best"), F.sum("count")]
    out = found.df.join(pairs, ["a", "b"]).groupBy("key").agg(*(s.cast("long").alias(c) for s, c in zip(sums, STATS, strict=True)), ends.alias("ends"))
    out = Written(out.select("key", *STATS, _groups_text(F.col("ends")).alias("groups")), **PACKED)
    found.drop()
    counts.drop()
    return out


def _strings(column: pa.Array) -> list[str]:
    """What to_pylist gives, several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _summed(rows: DataFrame, files: tuple[str, str]) -> DataFrame:
    """SCHEMA from rows (block, kind, doc_id, text, stats, groups) in order: the units of a block before its documents."""

    def run(batches):
        coders, block, at, groups, stats, sums = Coders(*files), None, {}, [], [], None
        kinds = [pa.int64()] * (1 + len(STATS)) + [pa.string()]
        for b in batches:
            blocks, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(blocks)], strict=True):
                part = b.slice(i, j - i)
                if blocks[i] != block:
                    block, at, groups, stats, sums = blocks[i], {}, [], [], None
                if not kind[i]:
                    at.update(zip(_strings(part.column(3)), range(len(groups), len(groups) + j - i), strict=True))
                    groups += _strings(part.column(5))
                    stats.append(part.column(4).flatten().to_numpy().reshape(-1, len(STATS)))
                    continue
                if sums is None:
                    sums = np.concatenate(stats) if stats else np.zeros((0, len(STATS)), np.int64)
                found, digest = np.zeros((j - i, len(STATS)), np.int64), []
                for k, text in enumerate(part.column(3)):
                    # A unit of a text that isn't given back stands in no other text either.
                    where = list(map(at.get, coders.units(text))) if (text := text.as_py()) else []
                    if where and None not in where:
                        found[k] = sums[where].sum(0)
                        digest.append(hashlib.sha256(";".join(map(groups.__getitem__, where)).encode()).hexdigest())
                    else:
                        digest.append("")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([part.column(2), *found.T, digest], kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def alignment(docs: DataFrame, bpe: str | None = None, model: str | None = None) -> DataFrame:
    """The columns of SCHEMA for each row of docs (doc_id, text)."""
    spark, tmp, files = docs.sparkSession, Scratch(), (bpe or default_bpe(), model or default_model())
    bound_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"))
    # Each table goes, and its shuffle files with it, as soon as the next is written.
    held = Written(_counted(docs, n, files), **PACKED)
    tmp.settle(spark)
    units = held.df.groupBy("unit").agg(F.sum("n").alias("n"))
    # Keys are settled by being written.
    tokens = Written(_tokenized(units, files).select(F.monotonically_increasing_id().alias("key"), "*"), **PACKED)
    tmp.settle(spark)
    done = aligned(tokens.df.drop("unit"))
    tmp.settle(spark)
    known = Written(tokens.df.select("key", "unit").join(done.df, "key").select("unit", F.array(*STATS).alias("stats"), "groups"), **PACKED)
    tokens.drop()
    done.drop()
    tmp.settle(spark)
    given = held.df.join(known.df, "unit").select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("unit").alias("text"), "stats", "groups")
    given = tmp.keep(given, **PACKED)
    known.drop()
    held.drop()
    tmp.settle(spark)
    asked = docs.select("block", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("array<long>").alias("stats"), F.lit(None).cast("string").alias("groups"))
    rows = given.unionByName(asked).repartition(n, "block").sortWithinPartitions("block", "kind")
    return tmp.result(_summed(rows, files))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
