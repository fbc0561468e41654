"""Ranked lexical search: an inverted index in pages of documents, searched by a hybrid of TAAT and DAAT."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelark.llm.batches import whole_text_batches
from tracelark.llm.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms are maximal matches of this, over text whose A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What each byte of UTF-8 becomes in a term; 0 parts terms.
_FOLDED = np.array([b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
#: A text above so many bytes is read in pieces.
PIECE = 4 << 20
#: Documents of a shard whose bounds are kept together.
PAGE = 512
INDEX = (
    "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<string>, dfs array<long>, docs binary, tfs binary, "
    "pages array<long>, page_docs binary, page_starts binary, page_tfs binary, page_lengths binary"
)
FOUND = "item_id long, doc_id long, score long"


def words_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The terms of texts that lie one after the other in ``raw``, and the number of the text of each."""
    folded = _FOLDED[raw]
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = np.concatenate([[0], ends[:-1]])
    begins = begins[begins < len(raw)]
    first[begins] = inside[begins]
    at = np.flatnonzero(first)
    starts = np.searchsorted(np.flatnonzero(inside), at)
    kept = folded[inside]
    offsets = np.append(starts, len(kept)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return np.searchsorted(ends, at, "right"), terms


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bytes of several texts at once as (number of the first, bytes, ends); a long text comes alone, in pieces."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        while high - low > PIECE:  # one long text
            cut = low + PIECE
            while cut < high and _FOLDED[data[cut]]:
                cut += 1
            yield i, data[low:cut], np.array([cut - low])
            low = cut
        yield i, data[low:high], (offsets[i + 1 : j + 1] - low if j > i + 1 else np.array([high - low]))
        i = j


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    changed = np.zeros(len(keys[0]), bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


class Shard:
    """Documents of one task gathered into one row of the index."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.held = 0
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list[int | None], texts: pa.Array) -> None:
        base = len(self.ids)
        self.ids.extend(ids)
        for first, raw, ends in _pieces(texts):
            owners, terms = words_of(raw, ends)
            if len(terms):
                coded = terms.dictionary_encode()
                keys, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | (owners + base + first), return_counts=True)
                self.parts.append((coded.dictionary, keys >> 32, keys & 0xFFFFFFFF, tfs))
                self.held += len(terms)

    def row(self) -> pa.RecordBatch:
        coded = pa.chunked_array([p[0] for p in self.parts]).combine_chunks().dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        shift = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        keys = np.concatenate([place[p[1] + s] << 32 | p[2] for p, s in zip(self.parts, shift, strict=False)])
        tf = np.concatenate([p[3] for p in self.parts])
        self.parts.clear()
        order = np.argsort(keys)
        keys, tf = keys[order], tf[order]
        whole = _runs(keys)  # a long text's pieces meet here
        term, doc, tf = keys[whole] >> 32, keys[whole] & 0xFFFFFFFF, np.add.reduceat(tf, whole)
        lengths = np.bincount(doc, tf, len(self.ids)).astype(np.int64)
        filled = np.flatnonzero(lengths)
        doc = (np.cumsum(lengths > 0) - 1)[doc]
        lengths = lengths[filled]
        page = _runs(term, doc // PAGE)
        row = {
            "n_docs": len(filled),
            "n_terms": int(tf.sum()),
            "ids": [self.ids[i] for i in filled.tolist()],
            "lengths": lengths,
            "terms": coded.dictionary,
            "dfs": np.bincount(term, minlength=len(coded.dictionary)),
            "docs": doc.astype("<u4").tobytes(),
            "tfs": tf.astype("<u4").tobytes(),
            "pages": np.bincount(term[page], minlength=len(coded.dictionary)),
            "page_docs": (doc[page] // PAGE).astype("<u4").tobytes(),
            "page_starts": page.astype("<u4").tobytes(),
            "page_tfs": np.maximum.reduceat(tf, page).astype("<u4").tobytes(),
            "page_lengths": np.minimum.reduceat(lengths[doc], page).astype("<u4").tobytes(),
        }
        kinds = {"array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "binary": pa.binary(), "long": pa.int64()}
        named = [c.split() for c in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([row[n]], kinds[k]) for n, k in named], schema=pa.schema([(n, kinds[k]) for n, k in named]))


def build_index(docs: DataFrame, shard_terms: int = 1 << 19) -> DataFrame:
    """The inverted index of ``docs`` (doc_id, text): a row for about each ``shard_terms`` terms of a task's documents.

    A row lists its documents' ids and lengths (in terms), its distinct terms with their document frequencies, postings
    (document, occurrences) term by term, and for each term and page of documents the largest occurrence and the least
    length, which bound every score there. No row is shuffled. Texts without terms, null ones too, aren't listed; a
    text of any length is read in pieces. A row is some MB: store it with ``written(..., most_rows=1)``, else a task holds
    as many as its share of ``docs`` gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            shard.add(batch.column(0).to_pylist(), batch.column(1))
            if shard.held >= shard_terms:
                yield shard.row()
                shard = Shard()
        if shard.held:
            yield shard.row()

    whole_text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of ``items`` (item_id, text)."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms).alias("term")).distinct()


def _weight(df: Column, n: int) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * df + 1).cast("double")))


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What occurrences in a document of measure ``m`` count, before the term's weight. Rises with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The best ``k`` documents of one item so far: higher scores first, then smaller ids, null last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, object)
        self.least = 1

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        self.scores, self.ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, np.array(ids, object)])
        order = sorted(range(len(self.scores)), key=lambda i: (-self.scores[i], self.ids[i] is None, self.ids[i]))[: self.k]
        self.scores, self.ids = self.scores[order], self.ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


class Lists:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict, n: int, total: int, vocabulary: pa.Array):
        self.ids = row["ids"]
        self.measure = self._measure(row["lengths"].to_numpy(zero_copy_only=False), n, total)
        self.docs, self.tfs = (np.frombuffer(row[c], "<u4") for c in ("docs", "tfs"))
        self.page_docs, self.page_starts, page_tfs, lengths = (np.frombuffer(row[f"page_{c}"], "<u4").astype(np.int64) for c in ("docs", "starts", "tfs", "lengths"))
        self.page_bounds = _impact(page_tfs, self._measure(lengths, n, total))
        self.dfs = row["dfs"].to_numpy(zero_copy_only=False)
        self.ends, self.page_ends = np.cumsum(self.dfs), np.cumsum(row["pages"].to_numpy(zero_copy_only=False))
        self.place = pc.fill_null(pc.index_in(vocabulary, row["terms"]), -1).to_numpy()
        self.n_pages = -(-len(self.measure) // PAGE)

    @staticmethod
    def _measure(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
        return 100 - 90 + (90 * lengths.astype(np.int64) * n) // total

    def scored(self, low: int, high: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        docs = self.docs[low:high]
        return docs, weight * _impact(self.tfs[low:high].astype(np.int64), self.measure[docs])

    def accumulate(self, short: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: documents of the short lists in order, each with its summed score."""
        parts = [self.scored(self.ends[t] - self.dfs[t], self.ends[t], w) for t, w in short]
        docs, scores = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(docs, kind="stable")
        docs, scores = docs[order], scores[order]
        first = _runs(docs)
        return docs[first], np.add.reduceat(scores, first)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, short_share: int) -> None:
        """Adds what this row holds for one item. ``terms`` are places in the vocabulary.

        Lists that hold at most one document of ``short_share`` are summed first and then stand beside the long lists as
        one more iterator, bounded in each page by its highest sum. Then document at a time: pages whose bounds don't
        reach the least of the best scores are skipped; in the others documents come from the iterators that can reach it
        only together, and are looked up in the rest as long as they may still reach it.
        """
        own = [(t, w) for t, w in zip(self.place[terms].tolist(), weights.tolist(), strict=True) if t >= 0]
        short = [x for x in own if self.dfs[x[0]] * short_share <= len(self.ids)]
        long = [x for x in own if self.dfs[x[0]] * short_share > len(self.ids)]
        if not own:
            return
        bounds = np.zeros((len(long) + bool(short), self.n_pages), np.int64)
        spans = np.zeros((*bounds.shape, 2), np.int64)
        for i, (t, w) in enumerate(long):
            a, b = self.page_ends[t - 1] if t else 0, self.page_ends[t]
            at = self.page_docs[a:b]
            bounds[i, at] = w * self.page_bounds[a:b]
            spans[i, at, 0], spans[i, at, 1] = self.page_starts[a:b], np.append(self.page_starts[a + 1 : b], self.ends[t])
        if short:
            docs, sums = self.accumulate(short)
            first = _runs(docs // PAGE)
            at = docs[first] // PAGE
            bounds[-1, at] = np.maximum.reduceat(sums, first)
            spans[-1, at, 0], spans[-1, at, 1] = first, np.append(first[1:], len(docs))
        reach = bounds.sum(0)
        for page in np.flatnonzero(reach >= best.least).tolist():
            if reach[page] < best.least:
                continue
            base, order = page * PAGE, np.argsort(bounds[:, page], kind="stable")
            left = np.cumsum(bounds[order, page])
            must = int(np.searchsorted(left, best.least))
            sums_here = np.zeros(PAGE, np.int64)
            for k in range(len(order) - 1, -1, -1):
                i = int(order[k])
                low, high = spans[i, page]
                if low == high:
                    continue
                if i < len(long):
                    t, w = long[i]
                    if k < must:
                        held = low + np.flatnonzero(open_[self.docs[low:high] - base])
                        d = self.docs[held]
                        s = w * _impact(self.tfs[held].astype(np.int64), self.measure[d])
                    else:
                        d, s = self.scored(low, high, w)
                else:
                    d, s = docs[low:high], sums[low:high]
                sums_here[d - base] += s
                if 0 < k <= must:
                    open_ = (sums_here > 0) & (sums_here + left[k - 1] >= best.least)
                    if not open_.any():
                        break
            found = np.flatnonzero(sums_here >= best.least)
            if len(found):
                best.add(sums_here[found], [self.ids[base + d] for d in found.tolist()])


def ranked(index: DataFrame, items: DataFrame, k: int = 10, short_share: int = 16, wave_terms: int = 1 << 18) -> DataFrame:
    """The ``k`` documents of ``index`` (a written table of ``build_index``) with the highest scores for each of ``items``.

    With N documents that hold a term, L terms in all, n in one document, df documents for a term and tf occurrences, a
    term weighs floor(1000 ln((2N + 2) / (2df + 1))); a document measures m = 10 + 90 n N div L; its score is the sum,
    over the item's distinct terms, of weight * (10^9 tf div (1000 tf + 8m)).

    Items are taken in waves of about ``wave_terms`` terms, by hash, whose weights (about 40 bytes each) go to all
    tasks; each wave reads the index once. A task keeps each item's best so far from row to row as the bound to beat,
    so the cluster moves ``k`` rows an item and task.

    Rows of one item_id are one item, whose terms are those of all of them; a null item_id is an item, null texts add
    nothing. Repeated documents are ranked each, equal scores by smaller doc_id, null last. Items that no document shares
    a term with, and empty tables, give no rows. Other columns are ignored.

    Returns item_id, rank (from 1), doc_id, score.
    """
    spark = index.sparkSession
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n, total = totals["n"] or 0, totals["l"] or 0
    asked = item_terms(items)
    listed = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    dfs = listed.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = written(asked.join(dfs, "term").select("item_id", "term", _weight(F.col("df"), n).alias("w")).where("w > 0"), "item-weights")
    waves = -(-weighed.count() // wave_terms)
    out = spark.createDataFrame([], FOUND)
    for wave in range(waves):
        rows = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(waves)) == wave).toArrow()
        coded = rows["term"].combine_chunks().dictionary_encode()
        place, weights, item_ids = coded.indices.to_numpy(), rows["w"].to_numpy(), rows["item_id"].to_pylist()
        at: dict[int | None, list[int]] = {}
        for i, item in enumerate(item_ids):
            at.setdefault(item, []).append(i)
        wanted = {item: (place[i], weights[i]) for item, i in at.items()}
        out = out.unionByName(index.mapInArrow(_searcher(wanted, coded.dictionary, n, total, k, short_share), FOUND))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _searcher(wanted: dict, vocabulary: pa.Array, n: int, total: int, k: int, short_share: int):
    terms = vocabulary.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, words = {item: Best(k) for item in wanted}, pa.array(terms, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                arrays = {c: row[c].values for c in ("lengths", "terms", "dfs", "pages")}
                rest = {c: row[c].as_py() for c in ("ids", "docs", "tfs", "page_docs", "page_starts", "page_tfs", "page_lengths")}
                lists = Lists(arrays | rest, n, total, words)
                for item, (place, weights) in wanted.items():
                    lists.search(place, weights, best[item], short_share)
        item_ids = [item for item, b in best.items() for _ in b.ids]
        ids, scores = [d for b in best.values() for d in b.ids.tolist()], [s for b in best.values() for s in b.scores.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (item_ids, ids, scores)], ["item_id", "doc_id", "score"])

    return run


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    index = written(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "inverted-index", most_rows=1)
    return ranked(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM (SELECT rid, doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
size AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, whole WHERE term IN (SELECT term FROM q) GROUP BY term),
scored AS (
  SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (rid), whole GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
