"""Byte-level BPE encoding with the vocabulary of a tokenizers file.

Ids come from the merge ranks of the file itself, through the fast rank encoder of tiktoken; a text that holds the string of a
special token, where such strings count as the token, goes to the tokenizers library. In each batch one text is encoded by both, and
a difference ends the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

# Fixed value: how byte-level vocabularies split a text before they merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The text of a batch that is encoded twice has at most so many characters.
CHECKED_CHARS = 4_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others in turn from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteVocabulary:
    def __init__(self, model: bytes) -> None:
        import tiktoken
        import tokenizers

        spec = json.loads(model)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.bytes = {i: b for b, i in ranks.items()}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.library = tokenizers.Tokenizer.from_str(model.decode())

    def encode(self, texts: list[str], specials: bool = False) -> Iterator[list[int]]:
        """The ids of each text, without begin or end; ``specials``: strings of special tokens become these tokens."""
        self.library.encode_special_tokens = not specials
        checked = min((t for t in texts if 0 < len(t) <= CHECKED_CHARS), key=len, default=None)
        for text in texts:
            if specials and any(s in text for s in self.special):
                yield self.library.encode(text, add_special_tokens=False).ids
                continue
            ids = self.fast.encode_ordinary(text)
            if text is checked:
                if self.library.encode(text, add_special_tokens=False).ids != ids:
                    raise ValueError(f"the rank encoder and the tokenizers library differ on {text!r}")
                checked = None
            yield ids


_vocabularies: dict[bytes, ByteVocabulary] = {}


def byte_vocabulary(model: bytes) -> ByteVocabulary:
    """The vocabulary of these bytes; a worker builds it once."""
    if model not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[model] = ByteVocabulary(model)
    return _vocabularies[model]
