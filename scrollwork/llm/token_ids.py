"""Token ids of whole texts, with the tokenizers library, by cached chunks.

Both vocabularies used here split a text at white space before any merge, so a text's ids are the ids of its
chunks, one after the other. Chunks repeat (words of a language do), so each is encoded once and looked up after
that; the cache is dropped when it reaches its bound. The cuts are exact:

* ``leading_space`` (byte-level): a cut stands before a single space between two characters that are no white
  space. The splitter starts a new piece there in any case, and the space belongs to the piece on the right.
* otherwise (white space dropped): a cut stands at every ASCII white space character.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE_RUN = re.compile(r"\s\s")
SPACES = re.compile("[\t\n\x0b\x0c\r]")
BLOCK_CHARS = 1 << 20
#: bytes of UTF-8, read as Latin-1, that a byte-level vocabulary writes as other characters
BYTE_CHARS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


class ChunkEncoder:
    """``encode(texts)`` gives one uint32 array of ids per text.

    The cache has two generations. When the younger one holds ``max_chars`` characters it becomes the older one, and what is
    looked up again moves on from there, so frequent chunks stay and memory is bounded.
    """

    def __init__(self, path: str, leading_space: bool, max_chars: int = 11_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.leading_space, self.max_chars = leading_space, max_chars
        #: chunks without and with a space before them
        self.young: list[dict[str, bytes]] = [{}, {}]
        self.old: list[dict[str, bytes]] = [{}, {}]
        self.chars = 0

    def _look(self, chunks: list[str], spaced: bool) -> list[bytes]:
        young = self.young[spaced]
        found = list(map(young.get, chunks))
        missing = [i for i, v in enumerate(found) if v is None]
        if not missing:
            return found
        old, new = self.old[spaced], []
        for w in {chunks[i] for i in missing}:
            v = old.get(w)
            if v is None:
                new.append(w)
            else:
                young[w] = v
                self.chars += len(w) + 8
        for w, ids in zip(new, self._ids(new, spaced)):
            young[w] = ids
            self.chars += len(w) + 8
        for i in missing:
            found[i] = young[chunks[i]]
        return found

    def _ids(self, new: list[str], spaced: bool) -> list[bytes]:
        """Ids of new chunks. The splitter leaves a run of ASCII letters whole (a byte-level one, which has no normaliser, a run
        of Latin letters too) and parts it from punctuation behind it, so such chunks go to the library's merge model at once;
        all others pass through the whole tokenizer."""
        prefix = " " if spaced and self.leading_space else ""
        merge, young, plain, out, rest = self.tokenizer.model.tokenize, self.young[spaced], self.young[False], [], []
        head = "\u0120" if prefix else ""
        for k, w in enumerate(new):
            word = w.rstrip(".,!?;:")
            if not (word.isalpha() and (word.isascii() or self.leading_space and max(word) < "\u0250")):
                out.append(b"")
                rest.append(k)
                continue
            ids = young.get(word)
            if ids is None:
                if not self.leading_space:
                    piece = word.lower()
                else:
                    piece = head + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS))
                ids = array("I", [t.id for t in merge(piece)]).tobytes()
            if len(word) < len(w):
                mark = w[len(word) :]
                ids += plain.get(mark) or self._look([mark], False)[0]
            out.append(ids)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([prefix + new[k] for k in rest], add_special_tokens=False)):
            out[k] = array("I", e.ids).tobytes()
        return out

    def _blocks(self, text: str):
        at = 0
        while len(text) - at > BLOCK_CHARS and (m := SAFE_CUT.search(text, at + BLOCK_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _encode_block(self, block: str) -> bytes:
        if not self.leading_space:
            return b"".join(self._look(SPACES.sub(" ", block).split(" "), True))
        if SPACE_RUN.search(block):
            first, *rest = SAFE_CUT.split(block)
            return b"".join(self._look([first], False) + self._look(rest, True))
        lines = [line.split(" ") for line in block.split("\n")]
        heads = self._look([x[0] for x in lines], False)
        tails = self._look([w for x in lines for w in x[1:]], True)
        newline = self._look(["\n"], False)[0]
        out, at = [], 0
        for head, x in zip(heads, lines):
            out.append(newline)
            out.append(head)
            out.append(b"".join(tails[at : at + len(x) - 1]))
            at += len(x) - 1
        return b"".join(out[1:])

    def encode(self, texts: list[str]):
        """Yields the ids of each text."""
        for text in texts:
            out: list[bytes] = []
            for block in self._blocks(text):
                if self.chars > self.max_chars:
                    self.old, self.young, self.chars = self.young, [{}, {}], 0
                out.append(self._encode_block(block))
            yield np.frombuffer(b"".join(out), "<u4")


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, leading_space: bool) -> ChunkEncoder:
    """One encoder per Python worker, so that the cache outlives a task."""
    key = (path, leading_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, leading_space)
    return _ENCODERS[key]
