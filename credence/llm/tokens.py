"""Reading public tokenizer files."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import cache

import tiktoken


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its public rule:
    printable Latin-1 characters stand for themselves, the others follow from code point 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def json_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file, with its added tokens as special tokens.

    The file's ids are its merge order, so its vocabulary is a rank table.
    """
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    odd = [t["content"] for t in held["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
    if odd:
        raise ValueError(f"Added tokens that take in what is next to them are not supported: {odd}")
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    of = byte_characters()
    ranks = {bytes(of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=pattern(), mergeable_ranks=ranks, special_tokens=special)


def json_encoder(path: str, added_tokens: bool = True) -> Callable[[str], list[int]]:
    """Text to ids, as the tokenizers library gives them without template tokens.

    `added_tokens`: their strings in a text are these tokens, as the library has it by
    default; without, ordinary text, as with its `encode_special_tokens`.
    """
    encoding = json_encoding(path)
    if not added_tokens:
        return encoding.encode_ordinary
    return lambda text: encoding.encode(text, allowed_special="all", disallowed_special=())
