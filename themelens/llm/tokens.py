"""Token ids of whole texts, with the words' ids remembered between texts.

A byte-level tokenizer cuts a text before it merges, and always before a single space between two characters that are
not white space. Text between such cuts has the same ids wherever it stands, so it is encoded once and remembered.
New words go to the tokenizer many at a time; the ids of each begin with the only token that has its space.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections import defaultdict, deque
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np

TOKENIZER = "byte_bpe_50k.json"

#: Words that a Python worker remembers (about 230 bytes each), and the characters up to which a word is remembered.
REMEMBERED = 1_200_000
LONGEST = 64

#: New words that are encoded as one text.
TOGETHER = 256

#: A space as byte-level vocabularies write it.
SPACE = "\u0120"

_CUT = re.compile(r"(?<=\S) (?=\S)")


def location(tokenizer: str) -> str:
    """``tokenizer`` itself if it is a path, else the public file of that name on this machine."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def clean(word: str) -> bool:
    """Whether no white space stands at the word's edges, so that the spaces around it are single ones."""
    return word[:1].isspace() is word[-1:].isspace() is False and word != ""


def all_clean(words: list[str]) -> bool:
    """Whether every word is clean. Only words with white space in them are looked at one by one."""
    return all(map(clean, set(words).difference(" ".join(words).split())))


class Encoder:
    def __init__(self, tokenizer: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(location(tokenizer))
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id's token begins with a space
        self.opens[[own for token, own in vocabulary.items() if token.startswith(SPACE)]] = True
        # Of clean words only. Inside a batch a new word has a place that its ids are put into afterwards.
        self.known: defaultdict[str, bytes | bytearray] = defaultdict(bytearray)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each clean word after a space."""
        whole = [word for word in words if " " not in word]
        data = b"".join(self._ids([" " + " ".join(whole[k : k + TOGETHER]) for k in range(0, len(whole), TOGETHER)]))
        starts = np.flatnonzero(self.opens[np.frombuffer(data, np.uint32)]) * 4
        if len(starts) != len(whole):  # not a byte-level vocabulary
            return self._ids([" " + word for word in words])
        own = [data[a:b] for a, b in pairwise([*starts.tolist(), len(data)])]
        if len(whole) == len(words):
            return own
        own, others = iter(own), iter(self._ids([" " + word for word in words if " " in word]))
        return [next(others if " " in word else own) for word in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        # A batch makes many small objects and no cycles; collections would only walk through them.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        except BaseException:
            self.known.clear()  # places may be empty
            raise
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        known, find = self.known, self.known.__getitem__
        if len(known) > REMEMBERED:
            known.clear()
        before = len(known)
        edges: defaultdict[str, bytearray] = defaultdict(bytearray)
        heads, rests = [], []
        for text in texts:
            head, *words = text.split(" ")
            size = len(known)
            found = list(map(find, words))
            new = list(islice(reversed(known), len(known) - size))
            if not all_clean(new) or (words and not clean(head)):  # a space beside other white space
                for word in new:
                    del known[word]
                head, *words = _CUT.split(text)
                last = [words.pop()] if words and not clean(words[-1]) else []
                found = [*map(find, words), *map(edges.__getitem__, last)]
            heads.append(head)
            rests.append(found)
        new = list(islice(reversed(known), len(known) - before))
        places = list(islice(reversed(known.values()), len(known) - before))
        ids = self._ids_of(new)
        deque(map(bytearray.extend, places, ids), 0)
        known.update(zip(new, ids, strict=True))
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        for place, own in zip(edges.values(), self._ids([" " + word for word in edges]), strict=True):
            place.extend(own)
        return [head + b"".join(rest) for head, rest in zip(self._ids(heads), rests, strict=True)]


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    """This process's encoder; workers that Spark uses again keep what it remembers."""
    return Encoder(tokenizer)


def end_of(token: int) -> bytes:
    return np.array([token], "<u4").tobytes()
