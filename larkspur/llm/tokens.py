"""Token ids by a `tokenizers` file, with the ids of frequent words remembered.

A text is cut where the tokenizer itself always cuts, so the ids of a text are the
concatenated ids of its cuts, and those of a cut seen before need no second encoding.
A text with white space that a cut could part, or with a special token's string, is encoded whole.
"""

from __future__ import annotations

import gc
import os
import sys
from array import array

#: Cuts in one generation of a Python worker's memory: when the young one is full it becomes the old one.
MEMO_ENTRIES = 500_000
#: Marks that, after letters, are a piece of their own.
ENDS = frozenset(".,;:!?")


class Encoder(dict):
    """Encodes whole texts to little-endian unsigned 32-bit ids; as a dict, the ids of cuts.

    kind "byte": a byte-level vocabulary whose pieces carry their leading space; cuts stand
    before a single space or a newline between two visible characters. The first cut of a text,
    which no space precedes, has a memory of its own.
    kind "word": lower case, white space is dropped, so every space and newline is a cut.
    special_as_text: special tokens' strings in a text are ordinary text; else they give the
    special tokens' ids, as the library does by default.
    """

    def __init__(self, path: str, kind: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = () if special_as_text else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        self.byte = kind == "byte"
        self.old: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        # The character that stands for each byte in a byte-level vocabulary.
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: plain.pre_tokenize_str(chr(i))[0][0] for i in range(32, 127)}
        self.letters |= {i: "".join(plain.pre_tokenize_str(chr(i))[0][0]) for i in range(192, 256)}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, text: str) -> bytes:
        """Ids of a text without parting white space. One word of Latin letters is one piece, so the model sees it directly."""
        word = text[1:] if text[:1] == " " else text
        if word.isalpha() and max(word) < "Ā" and (word.isascii() or min(c for c in word if c > "\x7f") >= "À"):
            return array("I", [t.id for t in self.model.tokenize((text if self.byte else text.lower()).translate(self.letters))]).tobytes()
        return self._whole(text)

    def _opening(self, cut: str) -> bytes:
        """Ids of a text's first cut, before its first space or newline."""
        ids = self.first.get(cut)
        if ids is None:
            if cut and not cut.isprintable() or cut != cut.strip():
                raise KeyError(cut)
            ids = self._piece(cut) if cut else b""
            if len(self.first) > MEMO_ENTRIES:
                self.first.clear()
            self.first[cut] = ids
        return ids

    def __missing__(self, cut: str) -> bytes:
        ids = self.old.get(cut)
        if ids is None:
            if self.byte:
                text = cut[1:] if cut[:1] == "\n" else cut
                if not text or text[0].isspace() or text[-1].isspace() or not text.isprintable():
                    raise KeyError(cut)
                text = cut if cut[0] == "\n" else " " + cut
            else:
                text = cut
            if cut[-1:] in ENDS and cut[:-1].isalpha() and cut.isascii():
                ids = self[cut[:-1]] + self._piece(cut[-1])
            else:
                ids = self._piece(text) if text else b""
        self[cut] = ids
        return ids

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._whole(text)
        try:
            if self.byte:
                cuts = text.replace("\n", " \n").split(" ")
                if text[0] == "\n":  # the cut before it is empty
                    return b"".join(map(self.__getitem__, cuts[1:]))
                return self._opening(cuts[0]) + b"".join(map(self.__getitem__, cuts[1:]))
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        except KeyError:
            return self._whole(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none) as bytes of unsigned 32-bit integers."""
        if len(self) > MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        on = gc.isenabled()
        gc.disable()  # nothing here makes cycles
        try:
            return [self._encode(t or "") for t in texts]
        finally:
            if on:
                gc.enable()


def encoder(path: str, kind: str, special_as_text: bool = False) -> Encoder:
    """The Encoder of this Python worker, kept from task to task."""
    held = sys.__dict__.setdefault("_larkspur_encoders", {})
    if (path, kind, special_as_text) not in held:
        held[path, kind, special_as_text] = Encoder(path, kind, special_as_text)
    return held[path, kind, special_as_text]


def forget() -> None:
    """Free the encoders of this Python worker. Operators that need none call it, as an idle memory of cuts takes hundreds of MB."""
    sys.__dict__.pop("_larkspur_encoders", None)
