"""Public byte-level tokenizers; each worker process loads a vocabulary file once."""

from __future__ import annotations

import base64
from functools import lru_cache


def tokenizer_file(name: str) -> str:
    """Place of a vocabulary file; every machine of the cluster has the package installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _loaded(path: str, special: tuple):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path),
                             special_tokens=dict(special))


def encoding_of(path: str, special: dict[str, int] | None = None):
    """The encoder of a ranks file, with tokens of its own that a text may name."""
    return _loaded(path, tuple(sorted((special or {}).items())))
