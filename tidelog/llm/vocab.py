"""Loading of public vocabularies in a process, once each. Files are read where they lie."""

from __future__ import annotations

import functools
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core


def public(name: str) -> str:
    """The place of one of the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(8)
def tokenizer(path: str):
    """The library's tokenizer for a file, without truncation or padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found
