"""Token ids of whole texts by a public byte-level vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

# The special token of the vocabulary, and its id.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=2)
def byte_level_encoding(name: str = "byte_bpe_50k"):
    """The vocabulary's encoding, loaded once in a worker.

    Read from the file of ranks, whose library is several times as fast as that of the
    vocabulary's JSON file; tests hold both to the same ids.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens={END_OF_TEXT: END_OF_TEXT_ID},
    )


def token_ids(text: str, name: str = "byte_bpe_50k") -> np.ndarray:
    """Ids of one text; the special token's string in it is the special token."""
    return byte_level_encoding(name).encode_to_numpy(text, allowed_special="all")
