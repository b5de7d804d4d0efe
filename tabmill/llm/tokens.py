"""Token ids of a public byte-level BPE vocabulary. The vocabulary files stay where they are; their name is a parameter.

The ids are those that the vocabulary's tokenizers file gives by default: its added tokens are recognised in a text.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

VOCABULARY = "byte_bpe_50k"
END = 1
#: tiktoken's pattern keeps its way back through a run of white space, and fails at about 1,000,000; longer runs than this go to
#: the tokenizers file.
RUN = 500_000


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY):
    """A tiktoken encoder over the vocabulary's ranks, with the tokenizers file's added tokens, and a pattern that finds these.
    It gives the same ids as that file, several times faster."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    found = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return found, re.compile("|".join(map(re.escape, added)) or r"(?!)")


@lru_cache(maxsize=2)
def unlimited(name: str = VOCABULARY):
    """The tokenizers file's encoder: slower, but for any text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def encode(text: str | None, name: str = VOCABULARY) -> list[int]:
    """Ids of the text alone; none for null or empty."""
    if not text:
        return []
    if len(text) > RUN and any(m.end() - m.start() > RUN for m in re.finditer(r"\s+", text)):
        return unlimited(name).encode(text, add_special_tokens=False).ids
    found, added = encoder(name)
    return found.encode(text, allowed_special="all") if added.search(text) else found.encode_ordinary(text)
