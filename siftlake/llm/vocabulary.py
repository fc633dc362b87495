"""The pieces of a SentencePiece model file, and how text becomes the lattice's words.

A word here is a run that no piece crosses the edge of. It starts at each space that follows another character, because no
piece holds a space after another character (checked on loading), and wherever two neighbouring characters are of
different families: characters that stand side by side in some piece are of one family, all others are alone. Cutting
there leaves the best segmentation as it is, and words are fewer and shorter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

SPACE = "▁"
#: Default model: a parameter of every function that needs one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0


def families(pieces: list[str]) -> list[str]:
    """The characters of each family of more than one, sorted."""
    of: dict[str, str] = {}

    def root(c: str) -> str:
        while of.setdefault(c, c) != c:
            of[c] = of[of[c]]
            c = of[c]
        return c

    for piece in pieces:
        body = piece.lstrip(SPACE)
        for a, b in zip(body, body[1:], strict=False):
            of[root(a)] = root(b)
    found = defaultdict(list)
    for c in of:
        found[root(c)].append(c)
    return sorted("".join(sorted(f)) for f in found.values())


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, int, float], ...]  # (piece, id, score) of pieces that text can match
    all_pieces: tuple[str, ...]
    unknown: int
    bytes_from: dict[int, int] = field(hash=False)  # byte -> id, empty without byte fallback
    dummy_prefix: bool = True
    longest: int = 16
    merges: bool = False  # the file's own kind is BPE
    families: tuple[str, ...] = ()

    @property
    def unknown_score(self) -> float:
        return min(s for _, _, s in self.pieces) - UNKNOWN_PENALTY


def load(path: str = MODEL) -> Vocabulary:
    """Reads a model on the driver; raises if its normaliser or its pieces are of a kind that isn't supported."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only models with the identity normaliser are supported")
    kinds = pb.ModelProto.SentencePiece
    pieces = tuple((p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL)
    if bad := [p for p, _, _ in pieces if SPACE in p.lstrip(SPACE)]:
        raise ValueError(f"pieces hold a space after another character: {bad[:3]}")
    found = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    return Vocabulary(
        pieces, tuple(p.piece for p in model.pieces), next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), found if model.trainer_spec.byte_fallback else {},
        n.add_dummy_prefix, max(len(p) for p, _, _ in pieces), model.trainer_spec.model_type == 2, tuple(families([p for p, _, _ in pieces])),
    )


class Cutter:
    """Cuts texts into runs that start at spaces, and those into words."""

    def __init__(self, vocab: Vocabulary):
        self.prefix = SPACE if vocab.dummy_prefix else ""
        each = "".join(f"[{''.join(map(re.escape, f))}]+|" for f in vocab.families)
        self.words = re.compile(f"{SPACE}*(?:{each}[^{SPACE}])|{SPACE}+").findall
        self.spaced = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        letters = {c for c in map(chr, range(128)) if c.isalpha()}
        self.plain = any(letters <= set(f) for f in vocab.families)

    def runs(self, text: str | None) -> list[str]:
        """Spaces written as SPACE; a text of no characters has none."""
        if not text:
            return []
        if self.prefix and not (text[0] == " " or text[-1] == " " or "  " in text or SPACE in text):
            return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")  # each space starts a run
        return self.spaced(self.prefix + text.replace(" ", SPACE))

    def cut(self, run: str) -> list[str]:
        """The words of a run."""
        body = run[1:] if run[:1] == SPACE else run
        return [run] if self.plain and body.isascii() and body.isalpha() else self.words(run)


def words(text: str | None, vocab: Vocabulary) -> list[str]:
    """The words of a text."""
    cutter = Cutter(vocab)
    return [w for run in cutter.runs(text) for w in cutter.cut(run)]
