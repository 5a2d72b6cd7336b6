"""Fast exact encoding with the lower-casing word BPE.

That tokenizer splits at white space before anything else, so a text's ids are
its words' ids, one word after the other. A worker keeps the ids of words it has
met; a word it has not met is cut into pre-tokens that the model encodes. This
holds for texts of Latin-1 characters; any other text goes through the whole
tokenizer.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from scorelane.llm.common import kept_by_worker

#: Words whose ids a worker keeps (some 200 bytes each); beyond these, words are encoded each time.
KEPT_WORDS = 400_000

# The tokenizer's own way to cut words, for lower-case Latin-1 characters.
_PRE_TOKEN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"|[a-zªµºß-öø-ÿ]+"
    r"|[0-9²³¹¼-¾]"
    r"|[^\s0-9a-zªµºß-öø-ÿ²³¹¼-¾]+"
)
_OTHER = re.compile(r"[^\t-\r -~\xa1-\xff]|<\|")


class WordEncoder(dict):
    """Words to their ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kept = kept
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}

    def __missing__(self, word: str) -> bytes:
        ids = [
            token.id
            for part in _PRE_TOKEN.findall(word)
            for token in self.model.tokenize(part if part.isascii() else part.translate(self.letters))
        ]
        found = np.array(ids, "<u4").tobytes()
        if len(self) < self.kept:
            self[word] = found
        return found

    def words(self, text: str) -> list[str] | None:
        """The words of a text whose ids are those of its words, or None."""
        return None if _OTHER.search(text) else text.lower().split()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words = self.words(text)
        return self.whole(text) if words is None else b"".join(map(self.__getitem__, words))


def worker_encoder(path: str, kept: int = KEPT_WORDS) -> WordEncoder:
    """The encoder of this Python worker."""
    return kept_by_worker(("encoder", path, kept), lambda: WordEncoder(path, kept))
