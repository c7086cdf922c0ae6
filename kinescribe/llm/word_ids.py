"""Token ids of whole texts, with a bounded cache of what the tokenizer gives for each run between white space."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Runs whose ids are remembered unless ``WordIds.remembered`` is set; the cache starts anew when it is full.
REMEMBERED = 1 << 19
#: Bytes of a text split at a time.
PART = 1 << 20

#: Other runs than plain words given to the tokenizer in one text.
TOGETHER = 1 << 9

_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: A full stop or comma at the end of such a run is a pre-token of its own.
_MARKED = re.compile(rb"[^\x80-\xff]*[a-z0-9][.,]")

#: How byte-level tokenizers write bytes without a printable character of their own: as characters from 256 on.
_BYTES = {b: chr(256 + i) for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def _one_word(run: bytes) -> str | None:
    """What the model sees of a run that is one pre-token by any Unicode tables: Latin letters only. None for other runs."""
    word = run.decode()
    if not word.isalpha():
        return None
    if word.isascii():
        return word.lower()
    # Below U+0180 letters have one lower-case letter each (but for U+0130) and are composed already.
    if max(word) >= chr(0x180) or chr(0x130) in word:
        return None
    return word.lower().encode().decode("latin-1").translate(_BYTES)


class WordIds:
    """Ids by a tokenizer whose pre-tokens never hold white space, and which folds case and white space.

    That holds for ``word_bpe_49k.json``: white space becomes a blank, which no pre-token contains. The ids of a text
    are then those of its runs, one after the other. Ids are kept as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.remembered = REMEMBERED
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _learn(self, runs: list[bytes]) -> None:
        """Put runs, each given once, into the cache."""
        cache = self.cache
        if len(cache) + 2 * len(runs) > self.remembered:
            cache.clear()
        marked = [r for r in runs if _MARKED.fullmatch(r)]
        if marked:
            bare = {r[:-1] for r in marked}.union(r[-1:] for r in marked).union(set(runs).difference(marked))
            runs = [r for r in bare if r not in cache]
        tokenize, packed, other = self.tokenizer.model.tokenize, self.packed, []
        for run in runs:
            word = _one_word(run)
            if word is None:
                other.append(run)
            else:
                cache[run] = b"".join([packed[t.id] for t in tokenize(word)])
        for at in range(0, len(other), TOGETHER):
            part = other[at : at + TOGETHER]
            words = [r.decode() for r in part]
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in words)])
            # A token lies in the run in which it starts.
            places = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            edges = (np.searchsorted(places, starts) * 4).tolist()
            ids = np.array(found.ids, "<u4").tobytes()
            for run, a, b in zip(part, edges, edges[1:]):
                cache[run] = ids[a:b]
        for run in marked:
            cache[run] = cache[run[:-1]] + cache[run[-1:]]

    def ids(self, text: str | None) -> bytes:
        """Ids of a text; null as empty."""
        out = []
        for part in _parts((text or "").encode()):
            if b"<|" not in part:
                # Strings of added tokens are told apart by case; all other text is folded anyway.
                part = part.lower()
            runs = part.split()
            found = list(map(self.cache.get, runs))
            if None in found:
                self._learn(list({r for r, ids in zip(runs, found) if ids is None}))
                if None in (found := list(map(self.cache.get, runs))):
                    # The cache was full and has been emptied.
                    self._learn(list(set(runs)))
                    found = [self.cache[r] for r in runs]
            out += found
        return b"".join(out)


def _parts(data: bytes) -> Iterator[bytes]:
    """The bytes in parts that end before white space."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + PART)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> frozenset[int]:
    """Ids of tokens that consist of full stops, question and exclamation marks, perhaps with a closing quote."""
    ends = re.compile(r"""[.!?]+["')\]]*(</w>)?""")
    return frozenset(i for token, i in word_ids(path).tokenizer.get_vocab().items() if ends.fullmatch(token))
