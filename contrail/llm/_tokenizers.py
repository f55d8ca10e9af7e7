"""Public tokenizers inside Spark tasks: ids and the bytes of tokens.

A path is either absolute, and then the same on all executors, or the name of a file of the installed package of public
tokenizers. Tokenizers are loaded once a task and never pickled.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Longest run of white space that goes to tiktoken, whose matcher keeps a stack as deep as the run.
WHITE_RUN = 2000
#: What byte-level tokenizers split texts by; fixed by their vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def located(path: str) -> str:
    if os.path.isabs(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class ByteTokens:
    """Byte-level BPE from a file of the library tokenizers. Where its merges are in the order of the ids, which is what
    tiktoken takes for granted, and it splits texts in the usual way, tiktoken makes the same ids several times as fast.
    With special, the strings of special tokens in a text become these tokens; else they are plain text."""

    def __init__(self, path: str = BYTE_BPE, special: bool = False):
        self.file, self.special, self._slow = located(path), special, None
        with open(self.file, encoding="utf-8") as f:
            data = json.load(f)
        letters, model = byte_letters(), data["model"]
        added = {t["content"]: t for t in data.get("added_tokens") or []}
        self.bytes = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in added.values())]))
        for token, i in model["vocab"].items():
            self.bytes[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        for token, t in added.items():
            self.bytes[t["id"]] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in added}
        merged = [model["vocab"].get(a + b, -1) for a, b in pairs]
        ordered = merged == sorted(set(merged)) and len(ranks) == 256 + len(pairs) and max(ranks.get(bytes([b]), 1 << 62) for b in range(256)) < min(merged, default=1 << 62)
        split = data.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not data.get("normalizer") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added.values())
        self._fast = None
        if ordered and usual and not any(model.get(k) for k in ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix")):
            import tiktoken

            self._fast = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={t: x["id"] for t, x in added.items()} if special else {})
        self._white = re.compile(r"\s{%d}" % WHITE_RUN)

    def ids(self, text: str) -> np.ndarray:
        """uint32 ids, without special tokens around them."""
        if self._fast and not (len(text) > WHITE_RUN and self._white.search(text)):
            return self._fast.encode_to_numpy(text, allowed_special="all" if self.special else set(), disallowed_special=())
        if not self._slow:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.file)
            self._slow.encode_special_tokens = not self.special
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


class PieceTokens:
    """A sentencepiece model; bytes of tokens are their pieces' with U+2581 as a space, or the byte of a byte token."""

    def __init__(self, path: str = PIECES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=located(path))
        of = self.model
        self.bytes = [
            bytes([int(of.id_to_piece(i)[1:-1], 16)]) if of.is_byte(i) else b"" if of.is_control(i) or of.is_unknown(i) else of.id_to_piece(i).replace("▁", " ").encode()
            for i in range(of.get_piece_size())
        ]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)
