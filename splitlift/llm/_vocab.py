"""Where the public vocabulary files are (a parameter of every operator)."""

from __future__ import annotations


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a file of the installed ``public_tokenizers``, read on the driver."""
    import public_tokenizers
    return public_tokenizers.path(name)


def splitting_pattern() -> str:
    """The pattern that splits text before the merges of the rank files."""
    import public_tokenizers
    return public_tokenizers.PATTERN
