"""Packing: token sequences of fixed capacity, balanced by what attention over them costs."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelark.llm.batches import whole_text_batches

#: ids are little-endian unsigned 32-bit numbers.
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
END_OF_TEXT = "<|endoftext|>"
_encoders: dict[str, object] = {}


def encoder(name: str):
    """The public byte-level BPE called ``name`` (``byte_bpe_50k``), kept by each worker.

    tiktoken reads the same vocabulary as the tokenizers library's file and gives the same ids, several times
    faster (a test holds them against each other). As there, the end-of-text string is its own id.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        special = {END_OF_TEXT: len(ranks)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[name]


def token_ids(coder, text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    ids = coder.encode(text, allowed_special="all") if END_OF_TEXT in text else coder.encode_ordinary(text)
    return np.asarray(ids, np.uint32)


def capacities(tokens: int, capacity: int) -> list[int]:
    """Sequence sizes that hold exactly ``tokens``: full ones, then the rest as powers of two, which need no padding."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for one window of documents.

    Whole capacities of long documents take sequences of their own. What remains goes, longest first, each to
    the sequence of the lowest cost that has room; a piece that doesn't fit whole fills that sequence and goes
    on in the next. Every sequence ends exactly full.
    """
    pieces, rests, used = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, used, 0))
            used += 1
        if n % capacity:
            rests.append((n % capacity, d, n - n % capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    sizes = capacities(sum(r[0] for r in rests), capacity)
    full = [size == capacity for size in sizes]
    filled = [0] * len(sizes)
    # Short tail sequences come last, when no full-size one has room.
    queue = [(not full[s], 0.0, s) for s in range(len(sizes))]
    heapq.heapify(queue)
    for n, d, start in rests:
        while n:
            tail, load, s = heapq.heappop(queue)
            take = min(n, sizes[s] - filled[s])
            pieces.append((d, start, take, used + s, filled[s]))
            filled[s] += take
            start, n = start + take, n - take
            if filled[s] < sizes[s]:
                heapq.heappush(queue, (tail, load + cost(take, linear, quadratic), s))
    return pieces


def pack_documents(
    docs: DataFrame,
    capacity: int = 1024,
    tokenizer: str = "byte_bpe_50k",
    window_tokens: int = 1 << 21,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its token ids followed by id 0; a null or empty text is that id alone. Documents are cut
    freely, and each id lies in exactly one piece. Packing is local to a window of about ``window_tokens``
    tokens within a partition: nothing is shuffled, memory doesn't depend on the input, a very long document
    only makes its own window longer, and a task that runs again gives the same sequences. Each window's
    sequences are exactly full: ``capacity``, or a power of two for its last few.

    Repeated rows are packed once each; a null doc_id stays null; an empty table gives no pieces; other
    columns are ignored. Returns the columns of SCHEMA, a row per piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        context = TaskContext.get()
        next_sequence = (context.partitionId() if context else 0) << 40
        owners: list[int | None] = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            pieces = assign([len(x) for x in held], capacity, linear, quadratic)
            columns = [
                pa.array([owners[p[0]] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([len(held[p[0]]) for p in pieces], pa.int64()),
                pa.array([next_sequence + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([held[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in pieces], pa.binary()),
            ]
            next_sequence += max(p[3] for p in pieces) + 1
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(coder, text.as_py()), np.uint32(0))
                owners.append(doc_id)
                held.append(ids)
                tokens += len(ids)
                if tokens >= window_tokens:
                    yield flush()
                    owners, held, tokens = [], [], 0
        if held:
            yield flush()

    whole_text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens; the ids of each piece as a CRC-32."""
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
