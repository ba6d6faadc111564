"""Token ids and piece counts of a public tokenizer, cached by word inside a task."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex
from tokenizers import Tokenizer

# Entries of a task's caches; a full cache is emptied. Longer strings are not kept.
CACHE = 400_000
CACHE_CHARS = 64

# Characters for which Python's lower-casing, white space and character classes are those of the library and
# NFC changes nothing: printable ASCII, Latin-1 and Latin Extended-A letters and signs, common punctuation.
# A text with any other character takes the library's own path.
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r -~¡-įı-ňŊ-ž‐-‧‰-⁞€]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(extra)) for b in range(256)]


class WordTokens:
    """A byte-level BPE tokenizer whose words never span white space."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        kinds = lambda part, key: [x["type"] for x in (spec[part] or {}).get(key, [])]
        if kinds("normalizer", "normalizers") != ["NFC", "Replace", "Lowercase"] or kinds("pre_tokenizer", "pretokenizers") != ["Split", "ByteLevel"]:
            raise ValueError("not a lower-casing word tokenizer with byte letters")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(self.letters)}

    def plain(self, text: str) -> bool:
        """Whether splitting at white space and lower-casing gives the library's words."""
        return (text.isascii() and not re.search("[\x00-\x08\x0e-\x1f\x7f]", text) or not UNUSUAL.search(text)) and not (
            self.special and self.special.search(text)
        )

    def words_of(self, chunk: str) -> list[str]:
        """Words of lower-cased text without white space."""
        return self.word.findall(chunk)

    def slow_words(self, text: str) -> tuple[list[str], int]:
        """Words of any text by the library's own steps, and how many special tokens stand in it."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for part in parts[::2]:
            for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)) if part else []:
                out.append(bytes(self.byte[c] for c in piece).decode("utf-8", "surrogateescape"))
        return out, len(parts) // 2

    def word_ids(self, word: str) -> list[int]:
        raw = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogateescape")))
        return [t.id for t in self.tok.model.tokenize(raw)]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """The tokenizer of a file, read once per process and not once per task."""
    return WordTokens(path)


class Cache(dict):
    """``cache[key]`` computes a missing value; bounded in entries and key length."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value
