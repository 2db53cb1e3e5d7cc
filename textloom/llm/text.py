"""Text primitives shared by the operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a maximal run of letters and digits, compared in lower case.
WORD = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"[0-9]+")
#: Sentence ends: Latin marks before white space, ideographic marks anywhere, line breaks.
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def sentences(text: str | None) -> list[str]:
    return [s for s in SENTENCE_END.split(text) if s and not s.isspace()] if text else []


def fold(line: str) -> str:
    """The form in which lines are compared: lower case, one space per run of white space, digit runs as 0."""
    return DIGITS.sub("0", " ".join(line.lower().split()))


def hash64(value: str, seed: int = 0) -> int:
    """Signed 64-bit hash, the same in every process."""
    h = xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"), seed)
    return h - (1 << 64) if h >= 1 << 63 else h


class WordIds(dict):
    """word -> unsigned 64-bit hash, remembered up to a bound; a pure function of the word."""

    bound = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hashes(tokens: list[str], ids: WordIds) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, tokens), np.uint64, len(tokens))


#: Odd multipliers of the splitmix64 generator, fixed values.
MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an array of unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX_B
    h = (h ^ (h >> np.uint64(27))) * MIX_C
    return h ^ (h >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words; fewer words give none."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + ids[k : k + n] * MIX_A + np.uint64(k + 1))
    return out
