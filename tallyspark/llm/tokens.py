"""Token ids of whole texts by the tokenizers library, once per distinct word and worker.

A byte-level BPE vocabulary first splits a text with a fixed pattern and then
encodes every part on its own, so the ids of a text are those of its parts. Words
repeat far more often than texts; each distinct one is encoded once. Texts or
vocabularies for which that does not hold are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterable

import regex

# Fixed value: the split pattern of this kind of vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space inside or at the end of a run of white space: the text cannot be cut before it.
UNSAFE = r"\s (?:\s|\Z)"

MAX_WORDS = 300_000
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: itself where it prints,
    else one from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Memory(dict):
    """Ids by string, computed on first use and kept while there is room."""

    def __init__(self, compute: Callable[[str], bytes], room: int):
        super().__init__()
        self.compute, self.room = compute, room

    def __missing__(self, key: str) -> bytes:
        ids = self.compute(key)
        if len(self) < self.room:
            self[key] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    At most ``max_words`` pieces and a fifth as many other parts are remembered; what comes
    later is encoded again each time, so memory stays bounded for any corpus. With ``plain``
    the strings of special tokens inside a text are text like any other.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        # The file is not parsed a second time: as Python objects a vocabulary is many times its size.
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.model, pre = self.whole.model, self.whole.pre_tokenizer
        self.by_word = (
            isinstance(pre, ByteLevel)
            and pre.use_regex
            and not pre.add_prefix_space
            and self.whole.normalizer is None
            and isinstance(self.model, BPE)
        )
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values() if not (plain and t.special)]
        self.split, self.unsafe = regex.compile(SPLIT).findall, re.compile(UNSAFE).search
        self.letters = byte_letters()
        self.parts = _Memory(self._part, max_words // 5)
        self.pieces = _Memory(self._piece, max_words)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text."""
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        if not self.by_word or self.unsafe(text) or any(a in text for a in self.added):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        # Every piece but the first stands for itself with a space before it.
        first, *rest = text.split(" ")
        return self._split(first) + b"".join(map(self.pieces.__getitem__, rest))

    def _split(self, text: str) -> bytes:
        return self._joined(self.split(text))

    def _joined(self, found: list[str]) -> bytes:
        # A part that starts with a space is a piece like any other.
        return b"".join([self.pieces[p[1:]] if p[0] == " " and len(p) > 1 else self.parts[p] for p in found])

    def _piece(self, word: str) -> bytes:
        found = [" " + word] if word.isalpha() else self.split(" " + word)
        return self._part(found[0]) if len(found) == 1 else self._joined(found)

    def _part(self, part: str) -> bytes:
        letters = part.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


def kept(key: object, make: Callable[[], object]) -> object:
    """What this worker process has under ``key``, made on first use.

    Functions arrive in a worker by value and anew for each task; what serves several
    tasks hangs on a module of its own.
    """
    module = sys.modules.setdefault("_tally_encoders", types.ModuleType("_tally_encoders"))
    found = getattr(module, "by_key", None)
    if found is None:
        found = module.by_key = {}
    if key not in found:
        found[key] = make()
    return found[key]


def encoder(path: str, plain: bool = False) -> Encoder:
    """The encoder of this worker process for a vocabulary."""
    return kept((path, plain), lambda: Encoder(path, plain=plain))
