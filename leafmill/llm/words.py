"""Words and characters of texts, as the operators on repeated and leaked passages count them."""

from __future__ import annotations

import html
import unicodedata

import numpy as np
import regex
import xxhash

#: Scripts whose words are not parted by blanks.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_TAG = regex.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", regex.S)
_LINE_MARK = regex.compile(
    r"^[ \t]*(?:(?:>[ \t]?)+|\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S*[ \t]+(?:\[?[A-Z]{3,8}\]?:?[ \t]+)?|[-*+•・◦‣#|/;%]+[ \t]+"
    r"|\(?\d{1,4}[.):][ \t]+)+",
    regex.M,
)
_TOKEN = regex.compile(rf"[{UNSPACED}][\p{{M}}]*|[[\p{{L}}\p{{N}}\p{{M}}]--[{UNSPACED}]]+", regex.V1)
_ID: dict[str, int] = {}


def plain(text: str) -> str:
    """Text without tags and marks at line starts, in one width, composition and case."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _LINE_MARK.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def words(text: str | None) -> list[str]:
    """Words of a text, or characters where words aren't parted by blanks; none for null."""
    return _TOKEN.findall(plain(text)) if text else []


def word_ids(tokens: list[str]) -> np.ndarray:
    """A 64-bit number of each token, the same in every process."""
    if len(_ID) > 500_000:
        _ID.clear()
    for t in set(tokens).difference(_ID):
        _ID[t] = xxhash.xxh64_intdigest(t)
    return np.array([_ID[t] for t in tokens], np.uint64)


def shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """A signed 64-bit hash of each run of ``size`` tokens, by start."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)
