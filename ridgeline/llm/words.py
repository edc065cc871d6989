"""Words of texts as they compare: without case, accents, markup, punctuation and look-alike letters.

Texts are folded and split many at a time: a block of texts is one string, in which a mark stands after each text, so
that every step is one pass of a compiled pattern over some million characters.  Only runs of other than ASCII
characters are looked up one by one, and are kept.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Letters of other scripts, or with strokes, and the Latin letters that they look like.
LOOK_ALIKES = {
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x",
    "а": "a", "в": "b", "г": "r", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ь": "b",
    "І": "i", "і": "i", "Ј": "j", "ј": "j", "Ѕ": "s", "ѕ": "s", "Ԁ": "d", "ԁ": "d", "Ԍ": "g", "ԍ": "g", "Ԛ": "q", "ԛ": "q", "Ԝ": "w", "ԝ": "w",
    "Һ": "h", "һ": "h", "Ӏ": "l", "ӏ": "l", "Ѵ": "v", "ѵ": "v", "Ү": "y", "ү": "y",
    "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ϲ": "c", "ϳ": "j", "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ħ": "h", "Ħ": "h",
    "ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe",
}
_TABLE = str.maketrans(LOOK_ALIKES)
#: Mark that stands after a text; in texts it is a blank.
_END = "\x00"
_TAG = re.compile(r"</?[a-zA-Z][^<>\x00]{0,200}>|<!--[^\x00]{0,2000}?-->")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_HYPHENS, _APOSTROPHES, _QUOTES = "\u2010\u2011", "’ʼ", "“”"
#: Characters that are folded at once; a longer text is a block of its own.
BLOCK = 1 << 22
#: Kind of each byte of a folded block: 1 in a word, 2 apostrophe, 3 hyphen, 0 else.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_KIND[[39, 96]] = 2
_KIND[45] = 3
#: Bytes of a folded block that end a segment.
_CUTS = np.zeros(256, bool)
_CUTS[[0, *b'.!?;:\n"']] = True


@lru_cache(maxsize=1 << 16)
def _plain(run: str) -> str:
    run = unicodedata.normalize("NFKD", run)
    kept = "".join(c for c in run if unicodedata.category(c) not in ("Mn", "Cf", "Me")).translate(_TABLE)
    return "".join(c if c.isascii() else "-" if c in _HYPHENS else "'" if c in _APOSTROPHES else '"' if c in _QUOTES else c if c.isalnum() else " " for c in kept)


def _fold(text: str) -> str:
    """Lower-case text of letters; markup becomes blanks, invisible characters and accents vanish."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _OTHER.sub(lambda m: _plain(m.group()), text)
    return text.lower()


@dataclass(frozen=True)
class Words:
    """Words of a block of texts: ``terms[codes[k]]`` is word k; text t has those up to ``ends[t]``.

    ``shares`` says how much of a written word each is: 1, or 1/n in a word of n parts joined by hyphens.  ``cuts``
    holds the words up to the end of each segment that has words: a sentence, a line, or what colons and quotes part.
    """

    terms: list[str]
    codes: np.ndarray
    shares: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray


def _split(texts: list[str | None]) -> Words:
    joined = "\n\x00\n".join(["" if t is None else t.replace(_END, " ") if _END in t else t for t in texts]) + "\n\x00\n"
    buf = np.frombuffer(_fold(joined).encode("utf-8", "replace"), np.uint8)
    kind = _KIND[buf]
    at = np.flatnonzero(kind == 2)  # the block ends in a mark and a blank, so every other byte has one after it
    at = at[(kind[np.maximum(at - 1, 0)] == 1) & (kind[at + 1] == 1) & (at > 0)]
    if len(at):
        buf, kind = np.delete(buf, at), np.delete(kind, at)
    word = kind == 1
    edge = np.flatnonzero(np.diff(word, prepend=False))
    start, end = edge[::2], edge[1::2]
    bounds = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(buf[word])).dictionary_encode()
    tied = (kind[end] == 3) & word[end + 1] if len(end) else np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate(([True], ~tied[:-1]))) if len(start) else np.zeros(0, np.int64)
    parts = np.diff(np.append(first, len(start)))
    ends, cuts = np.searchsorted(start, np.flatnonzero(buf == 0)), np.searchsorted(start, np.flatnonzero(_CUTS[buf]))
    cuts = cuts[np.diff(cuts, prepend=0) > 0]
    return Words(found.dictionary.to_pylist(), np.asarray(found.indices), np.repeat(1 / np.maximum(parts, 1), parts), ends, cuts)


def split_words(texts: Sequence[str | None]) -> Iterator[tuple[int, Words]]:
    """(first text, words) of blocks of texts.  A null text has no words."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > BLOCK:
            yield start, _split(list(texts[start:k]))
            start, size = k, 0
        size += len(t or "") + 3
    if start < len(texts):
        yield start, _split(list(texts[start:]))


def words(text: str | None) -> list[str]:
    """Words of one text."""
    return [w.terms[k] for _, w in split_words([text]) for k in w.codes]


def word_shares(text: str | None) -> list[float]:
    """For each of ``words(text)`` its share of the written word."""
    return [float(x) for _, w in split_words([text]) for x in w.shares]
