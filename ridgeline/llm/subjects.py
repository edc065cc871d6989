"""Subject areas of documents.

Documents are embedded by term weighting and a truncated singular value decomposition; subjects are seed centroids in
that space, refined by the documents nearest to them; a document's segments are assigned by cosine similarity.

* Terms: the most frequent words have a row each, all others share rows by hash, so no word is left out.
* Term weight: log frequency x inverse document frequency x information about the subject, which comes from the
  labelled table and the subjects' descriptions at first and from the assigned corpus in later rounds.
* Decomposition: subspace iteration; each pass adds up A'(A Q) over all documents, a matrix of vocabulary x rank.
* Centroids: one for each subject and language that has labels, then means of the documents assigned to them.
* Segments: a title or sentence counts for its nearest subject.  Words whose segments rarely agree with the rest of
  their document (figures of speech, remarks on other goods) make their segments void; that rate is counted over the
  whole corpus.

What reaches the driver is the model: vocabulary, basis and centroids, bounded by ``VOCABULARY``, ``SHARED`` and
``RANK``.  A pass runs in at most two tasks a core, so that what its tasks send stays small beside the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.words import Words, split_words, words
from ridgeline.session import cut_lineage

#: Most terms with a row of their own (the most frequent ones) and least documents of one; rows that all other terms
#: share by hash; rank of the decomposition.
VOCABULARY, LEAST_DOCUMENTS, SHARED, RANK = 1 << 16, 3, 1 << 8, 80
ROUNDS, REFINEMENTS = 3, 2
#: Passes of the subspace iteration in the first and in each later round, which starts from the basis before.
ITERATIONS = (3, 2)
#: A segment counts if its cosine and its most informative term reach these; a term is void below the third.
COSINE, INFORMATION, AGREEMENT = 0.25, 0.2, 0.35
#: A document's own similarity to a subject counts this much when its segments choose theirs; subjects after a
#: document's first need this many segments, for a single one is often a mention in passing.
CONTEXT, LEAST_SEGMENTS = 0.3, 2
#: Terms that tell less than this share of the subjects' entropy have weight 0.
LEAST_INFORMATION = 0.1
#: Assignments below this cosine don't enter centroids and term statistics.
CONFIDENT = 0.3
#: Rows of a block of sums, and documents that are multiplied at once.
_BLOCK, _DOCUMENTS = 64, 256


@dataclass
class _Model:
    """Numbers of the model; a term's row is its place in the vocabulary or, after that, its hash."""

    idf: np.ndarray
    information: np.ndarray
    basis: np.ndarray
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    void: np.ndarray | None = None

    @property
    def weight(self) -> np.ndarray:
        return (self.idf * self.information).astype(np.float32)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, Words]]:
    """(first document, words) of blocks of documents; the line break after the title ends a segment."""
    texts = [f"{a or ''}\n{b or ''}" for a, b in zip(batch.column("title").to_pylist(), batch.column("text").to_pylist(), strict=True)]
    return split_words(texts)


def _owners(ends: np.ndarray) -> np.ndarray:
    """Number of the list that holds each value, by the lists' ends."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each is there."""
    values = np.sort(values)
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return values[first], np.diff(first, append=len(values))


def _vocabulary(docs: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Row of each frequent term, and the number of documents of every row; a number is no term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, w in _documents(b):
                pairs, _ = _distinct(_owners(w.ends) * len(w.terms) + w.codes)
                n = np.bincount(pairs % max(len(w.terms), 1), minlength=len(w.terms))
                own = np.array([k for k, t in enumerate(w.terms) if not t.isdigit()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([w.terms[k] for k in own], pa.string()), pa.array(n[own].astype(np.int64))], names=["term", "n"])

    counted = docs.select("title", "text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    rows = counted.filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "term").limit(VOCABULARY).collect()
    terms = {r["term"]: k for k, r in enumerate(rows)}
    sizes = np.zeros(len(rows) + SHARED)
    sizes[: len(rows)] = [r["n"] for r in rows]
    rest = F.lit(True)
    if rows:
        n, last = rows[-1]["n"], rows[-1]["term"]
        rest = (F.col("n") < n) | ((F.col("n") == n) & (F.col("term") > last))
    for r in counted.filter(rest).groupBy(F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(SHARED)).alias("row")).agg(F.sum("n").alias("n")).collect():
        sizes[len(rows) + r["row"]] = r["n"]
    return terms, sizes


#: A row of the termed table: documents, and two packed record batches, of terms and of words.
_TERMS = "n int, weights binary, words binary"


def _packed(arrays: list[pa.Array], names: list[str]) -> bytes:
    batch = pa.RecordBatch.from_arrays(arrays, names=names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The documents of a batch of packed rows, or of a batch of documents, some hundred at once."""
    packed = [c for c in ("weights", "words") if c in batch.schema.names]
    if not packed:
        for k in range(0, batch.num_rows, _DOCUMENTS):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(k, _DOCUMENTS).columns], schema=batch.schema)
        return
    for k in range(batch.num_rows):
        parts = [pa.ipc.open_stream(batch.column(c)[k].as_buffer()).read_next_batch() for c in packed]
        yield pa.RecordBatch.from_arrays([c for part in parts for c in part.columns], names=[n for part in parts for n in part.schema.names])


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values, kind))


def _termed(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """Each document's id, lang, distinct terms with log frequencies, words' rows in order, and segments' ends.

    Some hundred documents are one row, packed, for every pass reads them as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for first, w in _documents(b):
                row = np.array([-1 if t.isdigit() else known[t] if t in known else len(known) + crc32(t.encode()) % SHARED for t in w.terms], np.int64)
                every = row[w.codes] if len(w.codes) else np.zeros(0, np.int64)
                width, n = len(known) + SHARED, len(w.ends)
                owner_of_cut = np.searchsorted(w.ends, w.cuts - 1, side="right")
                rows = []
                for lo in range(0, n, _DOCUMENTS):
                    hi = min(n, lo + _DOCUMENTS)
                    start, stop = (w.ends[lo - 1] if lo else 0), w.ends[hi - 1]
                    ids = every[start:stop]
                    kept = np.concatenate(([0], np.cumsum(ids >= 0)))
                    own_cuts = w.cuts[(owner_of_cut >= lo) & (owner_of_cut < hi)] - start
                    ids, last, cuts = ids[ids >= 0], kept[w.ends[lo:hi] - start], kept[own_cuts]
                    pairs, tf = _distinct(_owners(last) * width + ids)
                    until = np.searchsorted(pairs, np.arange(1, hi - lo + 1) * width)
                    cuts = cuts[np.diff(cuts, prepend=0) > 0]
                    owner = np.searchsorted(last, cuts - 1, side="right")
                    begin = np.concatenate(([0], last[:-1]))
                    weights = _packed([_lists(pairs % width, until, pa.int32()), _lists(np.log1p(tf), until, pa.float32())], ["terms", "tf"])
                    words_ = _packed(
                        [
                            pa.concat_arrays([b.column("id").slice(first + lo, hi - lo)]), pa.concat_arrays([b.column("lang").slice(first + lo, hi - lo)]),
                            _lists(ids, last, pa.int32()), _lists(cuts - begin[owner], np.searchsorted(owner, np.arange(hi - lo), side="right"), pa.int32()),
                        ],
                        ["id", "lang", "ids", "ends"],
                    )
                    rows.append((hi - lo, weights, words_))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["n", "weights", "words"])

    return cut_lineage(docs.mapInArrow(run, _TERMS))


def _labelled(table: DataFrame, labels: DataFrame, id_type: str) -> DataFrame:
    """The documents (id, lang, terms, tf, labels) that ``labels`` (id, labels) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _unpacked(b):
                yield part.select(["id", "lang", "terms", "tf"])

    rows = table.select("weights", "words").mapInArrow(run, f"id {id_type}, lang string, terms array<int>, tf array<float>")
    return cut_lineage(rows.join(labels, "id"))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and the row of each."""
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets)))


def _row_sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (first axis) by sorted ``row``."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(row):
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _weighted(batch: pa.RecordBatch, m: _Model) -> tuple[np.ndarray, np.ndarray]:
    """A batch's document-term matrix of unit rows, over the terms in it that have weight, and their numbers."""
    terms, doc = _rows(batch.column("terms"))
    tf, _ = _rows(batch.column("tf"))
    value = tf * m.weight[terms]
    keep = value > 0
    terms, doc, value = terms[keep], doc[keep], value[keep]
    norm = np.sqrt(np.bincount(doc, value.astype(float) ** 2, batch.num_rows))
    own, column = np.unique(terms, return_inverse=True)
    x = np.zeros((batch.num_rows, len(own)), np.float32)
    x[doc, column] = value / norm[doc]
    return x, own


def _embedded(batch: pa.RecordBatch, m: _Model) -> np.ndarray:
    x, own = _weighted(batch, m)
    e = x @ m.basis[own]
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9)


def _term_sums(terms: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    order = np.argsort(terms, kind="stable")
    if len(order):
        own = terms[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[starts]] += np.add.reduceat(values[order], starts, axis=0)


def _by_subject(sim: np.ndarray, m: _Model, subjects: int) -> np.ndarray:
    out = np.full((len(sim), subjects), -1.0, np.float32)
    for k, s in enumerate(m.owners):
        np.maximum(out[:, s], sim[:, k], out=out[:, s])
    return out


def _basis_step(batch: pa.RecordBatch, m: _Model, out: np.ndarray) -> None:
    x, own = _weighted(batch, m)
    out[own] += x.T @ (x @ m.basis[own])


def _label_mass(batch: pa.RecordBatch, m: _Model, out: np.ndarray) -> None:
    label, doc = _rows(batch.column("labels"))
    p = np.zeros((batch.num_rows, out.shape[1]), np.float32)
    p[doc, label] = 1
    p /= np.maximum(p.sum(1, keepdims=True), 1)
    terms, at = _rows(batch.column("terms"))
    _term_sums(terms, p[at], out)


def _seed_sums(batch: pa.RecordBatch, m: _Model, out: np.ndarray, slots: dict[tuple[str, int], int]) -> None:
    e = _embedded(batch, m)
    label, doc = _rows(batch.column("labels"))
    lang = batch.column("lang").to_pylist()
    share = 1 / np.maximum(np.bincount(doc, minlength=batch.num_rows), 1)
    for d, s in zip(doc, label, strict=True):
        if (k := slots.get((lang[d], int(s)))) is not None:
            out[k] += share[d] * e[d]


def _refined_sums(batch: pa.RecordBatch, m: _Model, out: np.ndarray, centroids: int, subjects: int) -> None:
    """Sums of the centroids' documents in the first rows and, if wanted, the subjects' mass of each term in the others."""
    e = _embedded(batch, m)
    sim = e @ m.centroids.T
    best, value = sim.argmax(1), sim.max(1)
    keep = value > CONFIDENT
    _term_sums(best[keep], e[keep] * value[keep, None], out[:centroids])
    if len(out) > centroids:
        own = _by_subject(sim, m, subjects)
        top = own.max(1, keepdims=True)
        p = np.exp(8 * (own - top))
        p = (p / p.sum(1, keepdims=True) * (top > CONFIDENT)).astype(np.float32)
        terms, at = _rows(batch.column("terms"))
        used, column = np.unique(terms, return_inverse=True)
        x = np.zeros((batch.num_rows, len(used)), np.float32)
        x[at, column] = 1
        out[centroids + used, :subjects] += x.T @ p


def _evidence(batch: pa.RecordBatch, m: _Model, subjects: int) -> tuple[np.ndarray, ...]:
    """Term and segment of each word; subject of each segment, -1 without evidence; cosine; its document."""
    ids, _ = _rows(batch.column("ids"))
    ends, doc_of_segment = _rows(batch.column("ends"))
    offsets = np.asarray(batch.column("ids").offsets)
    bounds = ends + (offsets[:-1] - offsets[0])[doc_of_segment]
    n = len(bounds)
    weight = m.weight
    segment = np.searchsorted(bounds, np.arange(len(ids)), side="right")
    told = np.flatnonzero(weight[ids] > 0)
    own, of = ids[told], segment[told]
    v = _row_sums(weight[own, None] * m.basis[own], of, n)
    strength = np.zeros((n, 1), np.float32)
    if len(own):
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        strength[of[starts], 0] = np.maximum.reduceat(m.information[own], starts)
    sim = _by_subject(v @ m.centroids.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9), m, subjects)
    whole = _by_subject(_embedded(batch, m) @ m.centroids.T, m, subjects).clip(0)
    nearest = (sim + CONTEXT * whole[doc_of_segment]).argmax(1) if n else np.zeros(0, np.int64)
    cosine = sim[np.arange(n), nearest]
    subject = np.where((cosine > COSINE) & (strength[:, 0] > INFORMATION), nearest, -1)
    return ids, segment, subject, cosine, doc_of_segment


def _agreement_sums(batch: pa.RecordBatch, m: _Model, out: np.ndarray, subjects: int) -> None:
    ids, segment, subject, _, doc = _evidence(batch, m, subjects)
    found = subject >= 0
    votes = np.bincount(doc[found] * subjects + subject[found], minlength=batch.num_rows * subjects).reshape(-1, subjects)
    several = found & (votes.sum(1)[doc] > 1)
    agrees = several & (votes[doc, np.maximum(subject, 0)] > 1)
    some = several[segment]
    pairs, _ = _distinct(segment[some] * len(m.idf) + ids[some])
    _term_sums(pairs % len(m.idf), np.column_stack([np.ones(len(pairs)), agrees[pairs // len(m.idf)]]), out)


def _summed(table: DataFrame, model: _Model, step, shape: tuple[int, int], columns: list[str], *args: object) -> np.ndarray:
    """Sum over all documents of what ``step`` adds to a matrix of ``shape``: by task, then by block of rows."""
    context = table.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, np.float64)
        for batch in batches:
            for part in _unpacked(batch):
                step(part, shared.value, out, *args)
        blocks = [k for k in range(0, shape[0], _BLOCK) if out[k : k + _BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([out[k : k + _BLOCK].astype(np.float32).tobytes() for k in blocks], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                x = np.frombuffer(sums.as_buffer(), np.float32)
                totals[block] = totals[block] + x if block in totals else x.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["block", "sums"])

    parts = table.select(*columns).coalesce(2 * context.defaultParallelism).mapInArrow(run, "block int, sums binary")
    out = np.zeros(shape)
    for r in parts.repartition("block").mapInArrow(add, "block int, sums binary").collect():
        x = np.frombuffer(r["sums"], np.float64).reshape(-1, shape[1])
        out[r["block"] : r["block"] + len(x)] = x
    shared.unpersist()
    return out


def _informative(mass: np.ndarray) -> np.ndarray:
    """Share of the subjects' entropy that a term removes, 0 below LEAST_INFORMATION: balanced subjects, shrunk to the uniform distribution."""
    size = mass.sum(0)
    balanced = mass / np.maximum(size, 1e-9) * size.sum() / len(size)
    posterior = (balanced + 1 / len(size)) / (balanced.sum(1, keepdims=True) + 1)
    told = (1 + (posterior * np.log(posterior)).sum(1) / np.log(len(size))).clip(0, 1)
    return np.where(told < LEAST_INFORMATION, 0, told).astype(np.float32)


def _units(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def subject_model(table: DataFrame, labelled: DataFrame, terms: dict[str, int], counts: np.ndarray, documents: int, subjects: list[str], descriptions: list[str], seed: int = 0) -> _Model:
    """The fitted model; ``table`` is what ``_termed`` returns, ``labelled`` its documents with ``labels``."""
    v, k = len(counts), len(subjects)
    rank = min(RANK, v)
    hints = [[terms[w] for w in words(d) if w in terms] for d in descriptions]
    m = _Model(np.log(max(documents, 1) / np.maximum(counts, 1)).clip(0).astype(np.float32), np.ones(v, np.float32), np.random.default_rng(seed).standard_normal((v, rank)).astype(np.float32))
    langs = [(r["lang"], r["s"]) for r in labelled.select("lang", F.explode("labels").alias("s")).distinct().collect()]
    slots = {x: i for i, x in enumerate(sorted(langs))}
    mass = _summed(labelled, m, _label_mass, (v, k), ["labels", "terms"])
    for s, own in enumerate(hints):
        mass[own, s] += 1
    for turn in range(ROUNDS):
        m.information = _informative(mass)
        for _ in range(ITERATIONS[min(turn, 1)]):
            m.basis = np.linalg.qr(_summed(table, m, _basis_step, (v, rank), ["weights"]))[0].astype(np.float32)
        seeds = _summed(labelled, m, _seed_sums, (max(len(slots), 1), rank), ["lang", "labels", "terms", "tf"], slots)[: len(slots)]
        owners = [s for _, s in sorted(slots)]
        for s in set(range(k)) - set(owners):
            own = hints[s]
            seeds = np.vstack([seeds, (m.weight[own, None] * m.basis[own]).sum(0)])
            owners.append(s)
        m.centroids, m.owners = _units(seeds), np.array(owners)
        for step in range(REFINEMENTS):
            # the last refinement also counts the terms of the subjects' documents for the next round
            n, counted = len(owners), step == REFINEMENTS - 1 and turn < ROUNDS - 1
            both = _summed(table, m, _refined_sums, (n + v * counted, max(rank, k)), ["weights"], n, k)
            sums, mass = both[:n, :rank], both[n:, :k] if counted else mass
            m.centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1, _units(sums), m.centroids).astype(np.float32)
    n, agreed = _summed(table, m, _agreement_sums, (v, 2), ["weights", "words"], k).T
    m.void = (agreed + 5 * 2 * AGREEMENT) / (n + 5) < AGREEMENT
    return m


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, subject, segments): at most ``most`` subjects of each document, with the segments that speak of them.

    ``docs`` has doc_id, title, text, lang; ``labels`` has doc_id, subject (compared without case and outer blanks;
    others than those of ``areas`` are ignored); ``areas`` has subject and description and is small.  Documents without
    evidence, with null or empty texts, or without a doc_id have no row; repeated doc_ids have a row for each copy's
    subjects.
    """
    known = areas.select(F.lower(F.trim("subject")).alias("subject"), F.coalesce("description", F.lit("")).alias("description")).dropna().orderBy("subject").collect()
    subjects = [r["subject"] for r in known]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    empty = docs.sparkSession.createDataFrame([], f"doc_id {id_type}, subject string, segments int")
    if not subjects:
        return empty
    codes = F.create_map(*[x for k, s in enumerate(subjects) for x in (F.lit(s), F.lit(k))])
    usable = labels.select(F.col("doc_id").alias("id"), codes[F.regexp_replace(F.lower("subject"), r"^\s+|\s+$", "")].alias("s")).dropna()
    own = usable.groupBy("id").agg(F.sort_array(F.collect_set("s")).alias("labels"))
    tongue = F.regexp_replace(F.lower(F.coalesce("lang", F.lit(""))), r"^\s+|\s+$", "")
    texts = docs.select(F.col("doc_id").alias("id"), F.when(tongue == "spa", "es").otherwise(tongue.substr(1, 2)).alias("lang"), "title", "text").filter(F.col("id").isNotNull())
    terms, counts = _vocabulary(texts)
    if not counts.any():
        return empty
    table = _termed(texts, terms)
    model = subject_model(table, _labelled(table, own, id_type), terms, counts, table.agg(F.sum("n")).first()[0] or 0, subjects, [r["description"] for r in known])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array(subjects, object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (part for batch in batches for part in _unpacked(batch)):
            ids, segment, subject, cosine, doc = _evidence(b, m, len(names))
            bad = np.zeros(len(subject), bool)
            bad[segment[m.void[ids]]] = True
            found = (subject >= 0) & ~bad
            votes, weight = np.zeros((2, b.num_rows, len(names)))
            np.add.at(votes, (doc[found], subject[found]), 1)
            np.add.at(weight, (doc[found], subject[found]), cosine[found])
            order = np.lexsort((-weight, -votes), axis=1)[:, :most] if b.num_rows else np.zeros((0, most), int)
            row = np.repeat(np.arange(b.num_rows), order.shape[1])
            pick = order.ravel()
            place = np.tile(np.arange(order.shape[1]), b.num_rows)
            keep = votes[row, pick] >= np.where(place > 0, LEAST_SEGMENTS, 1)
            row, pick = row[keep], pick[keep]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(names[pick], pa.string()), pa.array(votes[row, pick].astype(np.int32))], names=["doc_id", "subject", "segments"])

    return table.select("weights", "words").mapInArrow(assign, f"doc_id {id_type}, subject string, segments int")
