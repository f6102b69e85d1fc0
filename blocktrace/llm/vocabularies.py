"""Vocabularies of public tokenizers, opened once in each Python worker."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

#: White-space characters in a row that tiktoken is spared: its pattern search fails at some number of them
#: between 100,000 and a million.
LONG_RUN = 10_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_vocabulary(path: str):
    """Byte-level BPE. Strings of special tokens are ordinary text.

    The rank file holds the vocabulary of the JSON file of the same name, and
    its ids are the same (see the tests); this library encodes it faster.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteVocabulary:
    """Ids of the library `tokenizers` at its default settings, from the faster library wherever that can give them.

    A text is cut at the strings of added tokens, which become their ids, as `tokenizers` does. What lies between is
    encoded with the rank file beside the JSON file; parts with very long runs of white space go to `tokenizers`.
    """

    def __init__(self, path: str, added_tokens: bool):
        from tokenizers import Tokenizer

        self.fast = byte_vocabulary(path.removesuffix(".json") + ".tiktoken")
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = not added_tokens
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"] if added_tokens else []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: added tokens that are not plain strings")
        self.added = {t["content"]: t["id"] for t in added}
        self.cuts = re.compile("|".join(f"({re.escape(c)})" for c in sorted(self.added, key=len, reverse=True)))

    def encode(self, text: str) -> list[int]:
        if not any(content in text for content in self.added):
            return self._plain(text)
        ids: list[int] = []
        for part in filter(None, self.cuts.split(text)):
            if part in self.added:
                ids.append(self.added[part])
            else:
                ids += self._plain(part)
        return ids

    def _plain(self, text: str) -> list[int]:
        # A run of twice the length holds one of these stretches whole.
        if any(text[i:i + LONG_RUN].isspace() for i in range(0, len(text) - LONG_RUN + 1, LONG_RUN)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=4)
def json_vocabulary(path: str, added_tokens: bool) -> ByteVocabulary:
    return ByteVocabulary(path, added_tokens)


@lru_cache(maxsize=2)
def piece_vocabulary(path: str):
    """Pieces with byte fallback."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
