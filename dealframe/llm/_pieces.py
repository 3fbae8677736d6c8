"""A SentencePiece vocabulary as a scored piece list, and how texts are cut before segmentation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPACE = "▁"
UNK_PENALTY = 10.0


def default_model() -> str:
    """Path of the public SentencePiece file on this machine (a parameter everywhere else)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """Normal pieces with scores, byte pieces, and the score of an unknown character."""

    normal: dict[str, tuple[int, float]]
    byte_ids: list[int]
    texts: list[bytes]
    unk_score: float
    cuttable: bool
    longest: int
    used: set[str] = field(default_factory=set)


def load(path: str | None = None) -> Pieces:
    """Read on the driver; executors get the (fixed-size) vocabulary with the task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    normal, byte_ids, texts = {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            texts.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append(b"")
        else:
            normal[piece] = (i, sp.get_score(i))
            texts.append(piece.replace(SPACE, " ").encode())
    chars = {c for p in normal for c in p}
    return Pieces(
        normal,
        byte_ids,
        texts,
        min(s for _, s in normal.values()) - UNK_PENALTY,
        # Pieces hold the space mark at their start only: a best path never crosses into a mark.
        not any(SPACE in p.lstrip(SPACE) for p in normal),
        max(map(len, normal)),
        chars,
    )


LITERAL = ""


def segments(text: str, vocab: Pieces) -> list[str]:
    """Pieces of text that no vocabulary piece crosses; joined they are the marked text.

    A mark starts each segment but the first part after a line break. A mark that
    stands in the text itself is kept apart as a private character, so that it is
    encoded in bytes and comes back.
    """
    if not text:
        return []
    if SPACE in text or LITERAL in text:
        text = text.replace(LITERAL, LITERAL + "0").replace(SPACE, LITERAL + "1")
    out = []
    parts = text.split(" ")
    if "" in parts or not vocab.cuttable:
        marked = SPACE + text.replace(" ", SPACE)
        parts = re.findall(f"{SPACE}+[^{SPACE}]*", marked) if vocab.cuttable else [marked]
    else:
        parts = [SPACE + p for p in parts]
    if "\n" not in text or "\n" in vocab.used:
        return parts
    for p in parts:
        if "\n" in p:
            lines = p.split("\n")
            out.append(lines[0])
            for x in lines[1:]:
                out.append("\n")
                if x:
                    out.append(x)
        else:
            out.append(p)
    return out


def original(segment: str) -> list[tuple[str, bool]]:
    """(characters, known) runs of a segment, with kept-apart characters as they stood in the text."""
    if LITERAL not in segment:
        return [(segment, True)]
    out, i = [], 0
    while i < len(segment):
        j = segment.find(LITERAL, i)
        if j < 0:
            out.append((segment[i:], True))
            break
        if j > i:
            out.append((segment[i:j], True))
        out.append((SPACE if segment[j + 1] == "1" else LITERAL, False))
        i = j + 2
    return out
