"""Test items that occur, whole or in part, in a corpus.

A prefix-filtered set join on word shingles, in two scans of the corpus and without moving a document.

* The items are taken in blocks of bounded size (one block unless there are very many items); a block's words,
  shingles and postings are broadcast.  Parts of more than PIECE words are cut into overlapping pieces, of which one
  holds every excerpt that decides.
* The first scan counts for every item shingle the documents that hold it.  An edit of a word breaks the shingles
  around it, so of an item window with n edits ``agree`` shared shingles are among the rarest few: the window's prefix.
  Windows of several lengths are needed (see ``spans``).
* The second scan joins prefix shingles only.  Two of them, from different places of one item, must be met on nearly
  the same diagonal (place in the document less place in the item); around it the words of an item-sized window are
  aligned exactly, over all ways to chain equal words (``excerpts``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ridgeline.llm.words import Words, split_words
from ridgeline.session import cut_lineage

#: Words of a shingle, of an excerpt, and of an excerpt after at most one edit in EDIT words.
SHINGLE, WINDOW, EDIT = 3, 15, 6
#: Words of the items of one block; words of a piece of a long item part, and how far pieces are apart.
BLOCK_WORDS, PIECE, STRIDE = 1 << 19, 256, 128
#: Most edits of an excerpt.  A longer excerpt with more of them always holds one with fewer that is long enough.
MOST_EDITS = 18


def spans(window: int = WINDOW, edit: int = EDIT, agree: int = 2) -> list[tuple[int, int]]:
    """(words, prefix) of the item windows of which every excerpt fills one: it shares all but prefix - agree shingles.

    n edits need (EDIT - 1) n words found, so with the default figures: up to 2 edits leave a window of 15 words with 2
    of them, 3 edits one of 18 words with 3, 4 edits one of 24 words with 4, and an excerpt with more edits always has
    a window of 15 or 18 words in which as few shingles are broken.  18 words with 3 edits may have all 3 in every 15.
    """
    few = window // edit
    return [(max(window, n * edit), SHINGLE * n + agree) for n in (few, few + 1, few + 2)]


def excerpts(matches: Sequence[np.ndarray], edits: int, edit: int = EDIT) -> np.ndarray:
    """For each array of matches the most written words found in order with at most one edit in ``edit`` words.

    A match is an equal word of item and document: (words before it and through it in the item, then in the document),
    counted in written words.  Between two chained matches lie as many edits as the larger number of written words
    skipped on either side, rounded up.  The best chain ending at each match is kept for every number of edits up to
    ``edits``, so no chain is missed.  All arrays are worked on together, shorter ones filled up.
    """
    most = np.zeros(len(matches))
    order = np.argsort([len(m) for m in matches], kind="stable")
    start = 0
    while start < len(order):
        # a chunk's arrays are of similar length; its table of chains stays small
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * len(matches[order[stop]]) * (edits + 1) <= 400_000:
            stop += 1
        own, start = order[start:stop], stop
        n, size = len(own), max(len(matches[k]) for k in own)
        if not size:
            continue
        m = np.zeros((4, n, size))
        m[0], m[2] = -1e9, -1e9
        m[1], m[3] = 1e9, 1e9
        there = np.zeros((n, size), bool)
        for row, k in enumerate(own):
            m[:, row, : len(matches[k])] = matches[k].T
            there[row, : len(matches[k])] = True
        share = np.where(there, m[1] - m[0], 0).astype(np.float32)
        levels = np.arange(edits + 1)
        chains = np.full((n, size, 2 * (edits + 1)), -np.inf, np.float32)
        chains[:, 0, edits + 1 :] = share[:, 0, None]
        for p in range(1, size):
            skipped = np.maximum(m[0, :, p, None] - m[1, :, :p], m[2, :, p, None] - m[3, :, :p])
            before = np.minimum(m[0, :, p, None] - m[1, :, :p], m[2, :, p, None] - m[3, :, :p]) > -1e-6
            cost = np.where(before, np.minimum(np.ceil(skipped - 1e-6), edits + 1), edits + 1).astype(np.int64)
            near = np.flatnonzero((cost <= edits).any(0))
            best = 0.0
            if len(near):
                at = levels + (edits + 1) - cost[:, near, None]
                best = np.maximum(np.take_along_axis(chains[:, near], at, 2).max(1), 0)
            chains[:, p, edits + 1 :] = share[:, p, None] + best
        dense = np.where(there[:, :, None] & (levels * (edit - 1) <= chains[:, :, edits + 1 :] + 1e-4), chains[:, :, edits + 1 :], 0)
        most[own] = dense.max((1, 2))
    return most


def _match(item: np.ndarray, item_at: np.ndarray, doc: np.ndarray, doc_at: np.ndarray, edits: int, least: float) -> np.ndarray:
    """Equal words of an item and a window of a document, without those whose diagonal can't hold ``least`` words."""
    i, j = np.nonzero((item[:, None] == doc[None, :]) & (item >= 0)[:, None])
    if len(i):
        diagonal = j - i
        ordered = np.sort(diagonal)
        band = np.searchsorted(ordered, diagonal + 2 * edits, side="right") - np.searchsorted(ordered, diagonal - 2 * edits)
        i, j = i[band >= least], j[band >= least]
    return np.column_stack([item_at[i], item_at[i + 1], doc_at[j], doc_at[j + 1]])


def _until(shares: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(shares)))


@dataclass
class _Index:
    """Pieces of a block of items: their words as numbers of ``terms``, and the shingles' postings in order of shingle."""

    terms: dict[str, int]
    words: list[np.ndarray]
    places: list[np.ndarray]
    edits: np.ndarray
    shingles: np.ndarray
    first: np.ndarray
    piece: np.ndarray
    at: np.ndarray

    def codes(self, w: Words) -> np.ndarray:
        """The words' numbers, -1 for words of no item."""
        return np.array([self.terms.get(t, -1) for t in w.terms], np.int64)[w.codes] if len(w.codes) else np.zeros(0, np.int64)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Shingle at each word, -1 where a word is of no item; numbers of three words, so no two share one."""
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        n = len(self.terms)
        return np.where((a >= 0) & (b >= 0) & (c >= 0), (a * n + b) * n + c, -1)

    def hits(self, w: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place in it and shingle number of every item shingle in a block of texts."""
        if len(codes) < SHINGLE or not len(self.shingles):
            return (np.zeros(0, np.int64),) * 3
        keys = self.keys(codes)
        place = np.flatnonzero(keys >= 0)
        text = np.repeat(np.arange(len(w.ends)), np.diff(w.ends, prepend=0))[place]
        whole = place + SHINGLE <= w.ends[text]
        place, text = place[whole], text[whole]
        number = np.minimum(np.searchsorted(self.shingles, keys[place]), len(self.shingles) - 1)
        known = self.shingles[number] == keys[place]
        begin = np.concatenate(([0], w.ends[:-1]))
        return text[known], place[known] - begin[text[known]], number[known]


def _index(pieces: list[dict[str, object]], edit: int) -> _Index:
    terms: dict[str, int] = {}
    words = [np.array([terms.setdefault(t, len(terms)) for t in p["words"]], np.int64) for p in pieces]
    places = [_until(np.array(p["shares"], float)) for p in pieces]
    edits = np.array([min(MOST_EDITS, len(w) // (edit - 1)) for w in words], np.int64)
    out = _Index(terms, words, places, edits, *(np.zeros(0, np.int64),) * 4)
    sizes = np.array([max(0, len(w) - SHINGLE + 1) for w in words], np.int64)
    keys = np.concatenate([out.keys(w) for w in words if len(w) >= SHINGLE] or [np.zeros(0, np.int64)])
    order = np.argsort(keys, kind="stable")
    out.piece = np.repeat(np.arange(len(words)), sizes)[order]
    out.at = (np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
    out.shingles, first = np.unique(keys[order], return_index=True)
    out.first = np.append(first, len(keys))
    return out


def _needed(index: _Index, docs: np.ndarray, window: int, edit: int, agree: int) -> _Index:
    """The index with the postings of prefix shingles only; ``docs`` counts the documents of each shingle."""
    number = np.repeat(np.arange(len(index.shingles)), np.diff(index.first))
    by_piece = np.lexsort((index.at, index.piece))
    bounds = np.searchsorted(index.piece[by_piece], np.arange(len(index.words) + 1))
    kept = np.zeros(len(number), bool)
    for k in range(len(index.words)):
        own = by_piece[bounds[k] : bounds[k + 1]]
        if not len(own):
            continue
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((index.at[own], number[own], docs[number[own]]))] = np.arange(len(own))
        written = index.places[k]
        for words, prefix in spans(window, edit, agree):
            if written[-1] == len(own) + SHINGLE - 1:  # no hyphens: windows of as many words
                size = min(words - SHINGLE + 1, len(own))
                seen = sliding_window_view(rank, size)
                last = np.partition(seen, min(prefix, size) - 1, axis=1)[:, min(prefix, size) - 1]
                for n, limit in enumerate(last):
                    kept[own[n : n + size][seen[n] <= limit]] = True
            else:  # an edit of a hyphenated word breaks one shingle more for each hyphen
                for start in range(len(own)):
                    stop = int(np.searchsorted(written, written[start] + words - 1e-6))
                    stop = min(stop, len(own) + SHINGLE - 1)
                    size = max(1, stop - start - SHINGLE + 1)
                    seen = rank[start : start + size]
                    few = min(prefix + (stop - start - int(written[stop] - written[start])), len(seen))
                    kept[own[start : start + size][seen <= np.partition(seen, few - 1)[few - 1]]] = True
                    if start and stop == len(own) + SHINGLE - 1:
                        break
    number, piece, at = number[kept], index.piece[kept], index.at[kept]
    used, first = np.unique(number, return_index=True)
    return _Index(index.terms, index.words, index.places, index.edits, index.shingles[used], np.append(first, len(number)), piece, at)


def _found(index: _Index, w: Words, least: float, edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, piece and words of every piece that a text of the block holds."""
    codes = index.codes(w)
    text, place, number = index.hits(w, codes)
    times = index.first[number + 1] - index.first[number]
    posting = np.repeat(index.first[number] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    text, piece, at = np.repeat(text, times), index.piece[posting], index.at[posting]
    diagonal = np.repeat(place, times) - at
    order = np.lexsort((diagonal, piece, text))
    text, piece, at, diagonal = text[order], piece[order], at[order], diagonal[order]
    # of all pairs on near diagonals, some neighbours in this order have different places in the item
    near = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1]) & (at[1:] != at[:-1]) & (diagonal[1:] - diagonal[:-1] <= index.edits[piece[1:]])
    text, piece, diagonal = text[1:][near], piece[1:][near], diagonal[1:][near]
    lengths = np.array([len(x) for x in index.words], np.int64)
    width = np.maximum(lengths, 32)[piece] if len(piece) else np.zeros(0, np.int64)
    boxes = np.unique(np.column_stack([text, piece, diagonal // np.maximum(width, 1)]), axis=0)
    begin = np.concatenate(([0], w.ends[:-1]))
    written = _until(w.shares)
    matches = []
    for t, k, box in boxes.tolist():
        size, slack = max(int(lengths[k]), 32), int(index.edits[k])
        lo = begin[t] + max(box * size - slack, 0)
        hi = min(begin[t] + (box + 1) * size + int(lengths[k]) + slack, w.ends[t])
        matches.append(_match(index.words[k], index.places[k], codes[lo:hi], written[lo : hi + 1], slack, least))
    most = np.zeros(len(boxes))
    for slack in np.unique(index.edits[boxes[:, 1]]) if len(boxes) else []:
        own = np.flatnonzero(index.edits[boxes[:, 1]] == slack)
        most[own] = excerpts([matches[k] for k in own], int(slack), edit)
    good = most > least - 1e-3
    return boxes[good, 0], boxes[good, 1], most[good]


def leaks(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, parts: list[str],
    window: int = WINDOW, edit: int = EDIT, agree: int = 2, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, part, words): the items each document holds, with the written words found in order.

    ``parts`` are the item columns that count.  A pair is found if at least ``window - window // edit`` words of
    the part stand in the document, in order and with at most one edit in ``edit`` words; ``words`` is the most of an
    excerpt with up to MOST_EDITS edits (of one piece, in parts of more than PIECE words).  Null and empty texts hold
    nothing; a part of fewer words can't be held.  Repeated document or item ids give one row each; rows without an
    id are left out.
    """
    least = window - window // edit
    id_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    stacked = items.select(F.col(item_id).alias("item"), F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias("text")) for p in parts])).alias("p"))
    stacked = stacked.select("item", "p.part", "p.text").filter(F.col("item").isNotNull() & F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, list[str], list[float]]] = []
            for first, w in split_words(b.column("text").to_pylist()):
                for k, (lo, hi) in enumerate(zip([0, *w.ends[:-1]], w.ends, strict=True)):
                    for at in range(lo, max(lo + 1, hi - (PIECE - STRIDE)), STRIDE):
                        own = slice(at, min(hi, at + PIECE) if hi - lo > PIECE else hi)
                        if w.shares[own].sum() > least - 1e-6:
                            rows.append((first + k, [w.terms[c] for c in w.codes[own]], w.shares[own].tolist()))
                        if hi - lo <= PIECE:
                            break
            row = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("item").take(row), b.column("part").take(row), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["item", "part", "words", "shares"])

    pieces = cut_lineage(stacked.mapInArrow(cut, f"item {item_type.simpleString()}, part string, words array<string>, shares array<double>").dropDuplicates())
    size = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-size // block_words)
    block = F.pmod(F.xxhash64("item", "part", F.col("words")), F.lit(max(blocks, 1)))
    corpus = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).filter(F.col("doc").isNotNull() & F.col("text").isNotNull())
    out = corpus.sparkSession.createDataFrame([], f"doc {id_type.simpleString()}, item {item_type.simpleString()}, part string, words int")
    for k in range(blocks):
        found = _block_leaks(corpus, pieces.filter(block == k).collect(), to_arrow_type(item_type), out.schema.simpleString()[7:-1], window, edit, agree)
        out = out.unionByName(found) if k else found
    return out.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "part").agg(F.max("words").alias("words"))


def _block_leaks(corpus: DataFrame, pieces: list, item_type: pa.DataType, schema: str, window: int, edit: int, agree: int) -> DataFrame:
    context, least = corpus.sparkSession.sparkContext, window - window // edit
    own = [p.asDict() for p in pieces]
    index = _index(own, edit)
    every = context.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(len(every.value.shingles), np.int64)
        for b in batches:
            for _, w in split_words(b.column("text").to_pylist()):
                text, _, number = every.value.hits(w, every.value.codes(w))
                pairs = np.unique(text * len(docs) + number)
                docs += np.bincount(pairs % max(len(docs), 1), minlength=len(docs))
        some = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(docs[some])], names=["shingle", "docs"])

    docs = np.zeros(len(index.shingles), np.int64)
    for r in corpus.select("text").mapInArrow(count, "shingle bigint, docs bigint").groupBy("shingle").agg(F.sum("docs").alias("docs")).collect():
        docs[r["shingle"]] = r["docs"]
    needed = context.broadcast((_needed(index, docs, window, edit, agree), [p["item"] for p in own], [p["part"] for p in own]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, names, parts = needed.value
        for b in batches:
            for first, w in split_words(b.column("text").to_pylist()):
                text, piece, words = _found(prefixes, w, least, edit)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(pa.array(text + first)), pa.array([names[k] for k in piece], item_type), pa.array([parts[k] for k in piece], pa.string()), pa.array(np.floor(words + 1e-3).astype(np.int32))],
                    names=["doc", "item", "part", "words"],
                )

    return corpus.mapInArrow(search, schema)
