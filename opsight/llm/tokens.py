"""Public byte-level vocabularies: token ids of whole texts."""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from opsight.llm.prefix_counts import LATE_LEAD, late_characters


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """Special tokens are ordinary text. Files come from the installed package, so every executor has them."""
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def token_ids(path: str, text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint32)
    return np.array(encoder(path).encode_ordinary(text), np.uint32)


@functools.cache
def _library(path: str) -> tuple[Tokenizer, list[str]]:
    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def library_ids(path: str, rank_path: str, text: str | None) -> np.ndarray:
    """Ids of a text as the `tokenizers` file at `path` gives them.

    Its rank file encodes faster and gives the same ids, but for texts that spell a special token, and for letters that
    one of the two libraries does not know yet; these go to the library itself.
    """
    if not text:
        return np.empty(0, np.uint32)
    tokenizer, special = _library(path)
    late = not text.isascii() and np.frombuffer(text.encode(), np.uint8).max() >= LATE_LEAD and late_characters().search(text)
    if late or any(s in text for s in special):
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    return token_ids(rank_path, text)
