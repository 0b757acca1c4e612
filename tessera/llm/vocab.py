"""The public byte-level vocabulary: ranks, pre-token pattern and a per-worker encoder."""
import json
import re
from functools import lru_cache

import numpy as np

# The pre-token pattern and the special token of the published vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
# The same rule where a text has only ASCII and Latin letters, for the faster standard module.
LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+", re.ASCII)
ODD = re.compile(rf"[^\t-\r -~{LATIN}]")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file: itself if printable, else 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load(path: str) -> tuple[list[bytes], dict[bytes, int], int]:
    """Bytes of each id, rank of each mergeable byte string, id of the special token."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters, vocab = byte_letters(), file["model"]["vocab"]
    special = next(t["id"] for t in file["added_tokens"] if t["content"] == SPECIAL)
    table = [b""] * (max(special, *vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = SPECIAL.encode() if i == special else bytes(letters[c] for c in token)
    table[special] = SPECIAL.encode()
    return table, {t: i for i, t in enumerate(table) if i != special}, special


@lru_cache(maxsize=2)
def merge_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id of each byte; sorted keys left << 20 | right of the merges, and the ids they give.

    A merged token's id grows with its place in the list of merges, so ids serve as ranks.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    of_byte = np.zeros(256, np.int64)
    for c, b in letters.items():
        of_byte[b] = vocab[c]
    keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
    ids = np.array([vocab[a + b] for a, b in pairs], np.int64)
    assert (np.diff(ids) > 0).all()
    order = np.argsort(keys)
    return of_byte, keys[order], ids[order]


@lru_cache(maxsize=1)
def splitter():
    import regex
    return regex.compile(PATTERN)


def pretokens(text: str) -> list[str]:
    """The words that merges never cross; ``text`` holds no special token."""
    return splitter().findall(text) if ODD.search(text) else PLAIN.findall(text)


@lru_cache(maxsize=2)
def library_encoder(path: str):
    """tiktoken over the same ranks; ids equal those of the tokenizers file."""
    import tiktoken
    _, ranks, special = load(path)
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: special})


def encode_ids(text: str, path: str) -> np.ndarray:
    return library_encoder(path).encode_to_numpy(text, allowed_special="all")
