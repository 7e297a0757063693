"""The vocabulary of a sentencepiece BPE model as plain tables.

The installed library reads the model file; nothing is trained. Supported are models without text
normalisation, with a dummy prefix and byte fallback, whose pieces hold the space mark only at
their start. A model that breaks one of these is refused.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed value: what stands for a space inside pieces.
MARK = "▁"
_PROBE = "  ﬁ Ǻ a b  "


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """``ident``: piece to id, only pieces that merges can make; ``rank``: id to merge rank, 0 first."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        if sp.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
            raise ValueError("the model normalises text; only identity with a dummy prefix is supported")
        self.size = size
        self.text = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) or MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("unused pieces, or pieces with an inner space mark, are not supported")
        self.ident = {self.text[i]: i for i in plain}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {i: order[sp.get_score(i)] for i in plain}
        self.byte = {int(self.text[i][3:-1], 16): i for i in range(size) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.bytes = [b""] * size
        for i in plain:
            self.bytes[i] = self.text[i].replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.unknown = sp.unk_id()
        self.bytes[self.unknown] = " ⁇ ".encode()
        inner = {c for p in self.ident if len(p) > 1 for c in p}
        #: A run of marks merges from the left into blocks of the longest mark piece.
        run = max(len(p) for p in self.ident if not p.strip(MARK))
        #: A line feed, where no piece joins it to another character.
        self.feed = "\n" if "\n" not in inner else ""
        # No piece spans a non-mark and a following mark: each match is on its own.
        feed = f"|{self.feed}+[^{MARK}{self.feed}]*" if self.feed else ""
        self.word = re.compile(f"{MARK}{{{run}}}(?={MARK})|{MARK}{{1,{run}}}[^{MARK}{self.feed}]*" + feed)

    def words(self, text: str) -> list[str]:
        """The parts of the marked text that merges never join, each without its first mark.

        A part that starts with a line feed has no mark. A text without runs of spaces is split at
        its spaces, which gives the same parts as the pattern.
        """
        if not text:
            return []
        if self.feed and not (text[0] == " " or "  " in text or MARK in text):
            return text.replace(self.feed, " " + self.feed).split(" ") if text[0] != self.feed else ["", *text.replace(self.feed, " " + self.feed)[1:].split(" ")]
        return [w.removeprefix(MARK) for w in self.word.findall(MARK + text.replace(" ", MARK))]

    def marked(self, word: str) -> str:
        return word if self.feed and word.startswith(self.feed) else MARK + word


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)
