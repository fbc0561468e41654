"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences and an answer check."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelark.llm.batches import whole_text_batches
from tracelark.llm.words import word_hashes

SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long, n_words long, print long"
#: Terms are hashed to this many slots, which bounds the model's size whatever the benchmark's vocabulary.
SLOT_BITS = 16
#: Window lengths in words; an item is sought with the shortest that is not shorter than itself.
LENGTHS = (16, 32, 64, 128)
#: Documents are read in segments of so many words, each overlapping the next by the longest window and its margins.
SEGMENT = 8192
#: Punctuation parts words here, so that a paraphrase may change it.
_FOLD = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def term_hashes(text: str | None) -> np.ndarray:
    return word_hashes(text.encode().translate(_FOLD)) if text else np.zeros(0, np.uint64)


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def lcs_length(a: list[int], positions: dict[int, int]) -> int:
    """Longest common subsequence of ``a`` with the sequence that ``positions`` gives as bit masks by term."""
    row = full = 0
    for mask in positions.values():
        full |= mask
    row = full
    for term in a:
        if mask := positions.get(term):
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return (full & ~row).bit_count()


def bit_masks(terms: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, term in enumerate(terms):
        out[term] = out.get(term, 0) | 1 << i
    return out


def answer_of(text: str) -> str:
    """An item's answer: its last sentence of at least three words, else its last line or all of it."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if len(term_hashes(s)) >= 3]
    return sentences[-1] if sentences else text


class Latent(NamedTuple):
    """Weights by slot (0 where no benchmark term is) and right singular vectors: row of ``basis`` by slot, or -1."""

    weight: np.ndarray
    row: np.ndarray
    basis: np.ndarray

    def vector(self, hashes: np.ndarray) -> np.ndarray:
        slots = slots_of(hashes)
        slots = slots[self.row[slots] >= 0]
        return self.weight[slots] @ self.basis[self.row[slots]]


def document_counts(docs: DataFrame, row: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` each used slot occurs, and how many rows there are; over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(1):
                found = np.unique(slots_of(term_hashes(text.as_py())))
                seen[found[row[found] >= 0]] += 1
            n += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["slot", "n"])

    rows = docs.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(1 << SLOT_BITS), 0
    for r in rows:
        if r["slot"] < 0:
            total = r["n"]
        else:
            counts[r["slot"]] = r["n"]
    return counts, total


def randomised_svd(items: DataFrame, weight: np.ndarray, row: np.ndarray, rank: int, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """Right singular vectors (used slots x rank) of the items' normalised TF-IDF matrix.

    The matrix is never built: each round, tasks turn their items into a sum of a_i^T (a_i Q) by slot, Spark
    adds these up, and the driver orthonormalises a matrix of at most 2^SLOT_BITS x (rank + 8).
    """
    spark, used = items.sparkSession, int((row >= 0).sum())
    width = min(rank + 8, used)
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((used, width)))[0]

    def products(q: np.ndarray, gram: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast((q, weight, row))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, weight, row = shared.value
            total = np.zeros((q.shape[1] if gram else len(q), q.shape[1]))
            for batch in batches:
                for text in batch.column(1):
                    slots, tf = np.unique(slots_of(term_hashes(text.as_py())), return_counts=True)
                    if not len(slots):
                        continue
                    a = weight[slots] * tf
                    a = a / max(1e-12, np.sqrt(a @ a))
                    y = a @ q[row[slots]]
                    if gram:
                        total += np.outer(y, y)
                    else:
                        total[row[slots]] += np.outer(a, y)
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([v.tobytes() for v in total[at]], pa.binary())], ["at", "v"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            v = np.sum([np.frombuffer(x.as_py()) for x in table["v"]], axis=0)
            return pa.table({"at": [key[0].as_py()], "v": pa.array([v.tobytes()], pa.binary())})

        out = np.zeros((q.shape[1] if gram else used, q.shape[1]))
        for r in items.mapInArrow(run, "at long, v binary").groupBy("at").applyInArrow(add, "at long, v binary").collect():
            out[r["at"]] = np.frombuffer(r["v"])
        shared.unpersist()
        return out

    for _ in range(rounds):
        q = np.linalg.qr(products(q, False))[0]
    values, vectors = np.linalg.eigh(products(q, True))
    top = np.argsort(-values)[:rank]
    return q @ vectors[:, top[values[top] > 1e-9]]


class ItemIndex:
    """A block of benchmark items, by window length and then by weight, lightest first."""

    def __init__(self, items: list[tuple[int, str]], latent: Latent):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.ids, self.terms, self.masks, self.answers, self.bags = [], [], [], [], []
        sought: dict[int, list[int]] = {}
        for item_id, text in items:
            hashes = term_hashes(text)
            if len(hashes):
                length = next((n for n in LENGTHS if n >= len(hashes)), len(hashes))
                sought.setdefault(length, []).append(len(self.ids))
                self.ids.append(item_id)
                self.terms.append(hashes)
                self.masks.append(bit_masks(hashes.tolist()))
                self.answers.append(bit_masks(term_hashes(answer_of(text)).tolist()))
                self.bags.append({term: mask.bit_count() for term, mask in self.masks[-1].items()})
        for length, own in sought.items():
            weights = np.array([latent.weight[slots_of(self.terms[i])].sum() for i in own])
            order = np.argsort(weights, kind="stable")
            own = np.array(own)[order]
            vectors = np.array([latent.vector(self.terms[i]) for i in own])
            vectors /= np.maximum(1e-12, np.sqrt((vectors**2).sum(1)))[:, None]
            self.by_length[length] = (own, vectors.astype(np.float32).T.copy(), weights[order])
        self.longest = max(self.by_length, default=0)

    def covers(self, item: int, words: set[int], share: float) -> bool:
        """Whether ``words`` hold that share of the item's words at all, in any order."""
        bag = self.bags[item]
        return sum(bag[term] for term in bag.keys() & words) >= share * len(self.terms[item])


def windows_of(hashes: np.ndarray, edges: np.ndarray, latent: Latent, index: ItemIndex, cosine: float, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window length: it, and the items, segments, first words and cosines of windows near an item.

    ``hashes`` holds the words of many segments, segment k from ``edges[k]`` to ``edges[k + 1]``; no window crosses
    an edge. Vectors of windows are differences of running sums over the words. A window that holds ``share`` of an
    item's words has most of that share of its weight, so an item only meets windows of enough weight.
    """
    slots = slots_of(hashes)
    known = latent.row[slots] >= 0
    before = np.concatenate([[0], np.cumsum(known)])
    slots = slots[known]
    weight = latent.weight[slots]
    sums = np.concatenate([[0.0], np.cumsum(weight)])
    running = np.zeros((len(slots) + 1, latent.basis.shape[1]), np.float32)
    np.cumsum(latent.basis[latent.row[slots]] * weight[:, None].astype(np.float32), axis=0, out=running[1:])
    for length, (own, vectors, weights) in index.by_length.items():
        stride = max(1, length // 4)
        counts = -(-np.maximum(1, np.diff(edges) - length * 3 // 4) // stride)
        segment = np.repeat(np.arange(len(counts)), counts)
        starts = edges[segment] + stride * (np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts))
        a, b = before[starts], before[np.minimum(starts + length, edges[segment + 1])]
        heavy = (sums[b] - sums[a]) / (0.8 * share)
        some = np.flatnonzero(heavy >= weights[0])
        for few in np.array_split(some, -(-len(some) // 4096)) if len(some) else ():
            vector = running[b[few]] - running[a[few]]
            norm = np.maximum(1e-12, np.sqrt(np.einsum("wk,wk->w", vector, vector)))
            near = vector @ vectors
            w, j = np.nonzero(near >= cosine * norm[:, None])
            enough = weights[j] <= heavy[few[w]]
            w, j = w[enough], j[enough]
            yield length, own[j], segment[few[w]], starts[few[w]], near[w, j] / norm[w]


def leaks_of(docs: list[np.ndarray], latent: Latent, index: ItemIndex, cosine: float, share: float, answer: float) -> list[tuple[int, int, float, float, float, int, int]]:
    """The best verified window of each item in each of ``docs``: (document, item id, cosine, shares, place, size)."""
    margin = 2 * index.longest
    segments = [(d, at) for d, words in enumerate(docs) for at in range(0, max(1, len(words) - margin), SEGMENT) if len(words)]
    if not segments:
        return []
    parts = [docs[d][at : at + SEGMENT + margin] for d, at in segments]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    lists: dict[int, tuple[list[int], set[int]]] = {}
    held: dict[tuple[int, int], bool] = {}
    best: dict[tuple[int, int], tuple[float, float, float, int, int]] = {}
    for length, *found in windows_of(np.concatenate(parts), edges, latent, index, cosine, share):
        for item, k, start, near in zip(*(x.tolist() for x in found), strict=True):
            if k not in lists:
                lists[k] = (words := parts[k].tolist()), set(words)
            (words, every), (d, at) = lists[k], segments[k]
            if (item, k) not in held:
                held[item, k] = index.covers(item, every, share)
            if not held[item, k]:
                continue
            start -= int(edges[k])
            a, b = max(0, start - length // 2), min(start + length + length // 2, len(words))
            region = words[a:b]
            if not index.covers(item, set(region), share):
                continue
            got = lcs_length(region, index.masks[item]) / len(index.terms[item])
            if got < share or ((d, item) in best and best[d, item][0] >= got):
                continue
            answered = lcs_length(region, index.answers[item]) / max(1, sum(m.bit_count() for m in index.answers[item].values()))
            if answered >= answer:
                best[d, item] = (got, near, answered, at + a, b - a)
    return [(d, index.ids[i], near, got, answered, a, n) for (d, i), (got, near, answered, a, n) in sorted(best.items())]


def grouped_words(batch: pa.RecordBatch, words: int = 1 << 16) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids and term hashes of a batch's documents, so many at a time that they hold about ``words`` words."""
    ids: list[int | None] = []
    docs: list[np.ndarray] = []
    n = 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc_id)
        docs.append(term_hashes(text.as_py()))
        n += len(docs[-1])
        if n >= words:
            yield ids, docs
            ids, docs, n = [], [], 0
    yield ids, docs


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = 64,
    cosine: float = 0.65,
    lcs_share: float = 0.6,
    answer_share: float = 0.5,
    block_items: int = 10_000,
    space_items: int = 250,
) -> DataFrame:
    """Which ``docs`` (doc_id, text) hold which ``benchmark`` items (item_id, text), also as paraphrases.

    1. Inverse document frequencies of the benchmark's terms over all documents. 2. A randomised SVD of the
    TF-IDF passages of about ``space_items`` items each, distributed over the items: as the benchmark grows there are
    more latent spaces of ``rank`` dimensions, since one for all would hold ever less of an item. 3. Every document
    is read as overlapping windows; a window near an item in the item's latent space (``cosine``) is a candidate, so
    the space decides what is compared: few paraphrases are still lost. 4. The longest common subsequence of
    words must cover ``lcs_share`` of the item, and ``answer_share`` of its last sentence.

    Documents never leave their task. The index goes to the tasks in blocks of about ``block_items`` items, so its
    size doesn't grow with the benchmark; time does, with the number of spaces. Null and empty texts on either side
    hold nothing; repeated rows are
    reported once each, so are repeated items; null ids stay null; with an empty table on either side the result is
    empty. Other columns are ignored.

    Returns the columns of SCHEMA, a row per document and item; print is the xxhash64 of the document's text.
    """
    spark = docs.sparkSession
    whole_text_batches(spark)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(slots_of(np.concatenate([np.zeros(0, np.uint64), *(term_hashes(t.as_py()) for t in batch.column(1))])))
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["slot"])

    used = np.array(sorted(r["slot"] for r in items.mapInArrow(slots, "slot long").distinct().collect()), np.int64)
    if not len(used):
        return spark.createDataFrame([], SCHEMA)
    row = np.full(1 << SLOT_BITS, -1, np.int32)
    row[used] = np.arange(len(used))
    counts, total = document_counts(docs, row)
    weight = np.where(row >= 0, np.log((1.0 + total) / (1.0 + counts)) + 0.05, 0.0)

    size = min(space_items, block_items)
    spaces = max(1, -(-items.count() // size))
    each = max(1, block_items // size)
    out = None
    for first in range(0, spaces, each):
        indexes = []
        for k in range(first, min(first + each, spaces)):
            own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(spaces)) == k) if spaces > 1 else items
            listed = [(r["item_id"], r["text"]) for r in own.collect()]
            used = np.unique(slots_of(np.concatenate([np.zeros(0, np.uint64), *(term_hashes(t) for _, t in listed)])))
            if len(used):
                row = np.full(1 << SLOT_BITS, -1, np.int32)
                row[used] = np.arange(len(used))
                latent = Latent(weight, row, randomised_svd(own, weight, row, rank).astype(np.float32))
                indexes.append((latent, ItemIndex(listed, latent)))
        if not indexes:
            continue
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = shared.value
            for batch in batches:
                found: list[tuple] = []
                prints, at = batch.column(2).to_pylist(), 0
                for ids, some in grouped_words(batch):
                    for latent, index in indexes:
                        found += [(ids[d], *x, prints[at + d]) for d, *x in leaks_of(some, latent, index, cosine, lcs_share, answer_share)]
                    at += len(ids)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word", "n_words", "print"])

        part = docs.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all items of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).drop("print")
