"""Language identification: a blended-spectrum string kernel, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelark.llm.batches import whole_text_batches

#: Code 0 stands for any run of non-letters, 1 to 26 for a to z, 27 to 63 for other letters by a hash.
CODES = 64
#: Presence slots of trigrams, then bigrams, then single letters.
BOUNDS = (0, CODES**3, CODES**3 + CODES**2, CODES**3 + CODES**2 + CODES)
_letter_codes: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """The code of every code point, after lower-casing; made once in each worker."""
    if not _letter_codes:
        points = np.arange(0x110000)
        table = np.where(np.fromiter((chr(i).isalpha() for i in points), bool, 0x110000), 27 + points * 2654435761 % (1 << 32) % 37, 0).astype(np.uint8)
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _letter_codes.append(table)
    return _letter_codes[0]


def grams(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Sorted presence slots of a whole text's n-grams of 1 to 3 letters; nothing for a text without letters.

    ``seen`` is a scratch array of BOUNDS[-1] bools, all false before and after.
    """
    if not text:
        return np.zeros(0, np.int32)
    c = letter_codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    c = np.concatenate([[0], c, [0]]).astype(np.int32)
    c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]
    if len(c) < 2:
        return np.zeros(0, np.int32)
    two = c[:-1] * CODES + c[1:]
    seen[two[:-1] * CODES + c[2:]] = True
    seen[BOUNDS[1] + two] = True
    seen[BOUNDS[2] + c] = True
    seen[BOUNDS[2]] = False
    found = np.flatnonzero(seen).astype(np.int32)
    seen[found] = False
    return found


def norms(found: np.ndarray) -> np.ndarray:
    """For each slot of one text, 1 / sqrt(how many n-grams of that length the text has)."""
    at = np.searchsorted(found, BOUNDS)
    return np.concatenate([np.full(n, 1 / np.sqrt(max(1, n))) for n in np.diff(at)]).astype(np.float32)


class KernelModel(NamedTuple):
    languages: list[str]
    column: np.ndarray  # presence slot -> row of landmarks, or -1
    landmarks: np.ndarray  # slots x landmarks, normalised
    weights: np.ndarray  # landmarks x languages, with the intercept in the last row

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.kernel(texts) @ self.weights[:-1] + self.weights[-1]

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Presence kernels of a batch of texts with all landmarks, by one matrix product."""
        x = np.zeros((len(texts), len(self.landmarks)), np.float32)
        for i, found in enumerate(texts):
            at = self.column[found]
            x[i, at[at >= 0]] = norms(found)[at >= 0]
        return x @ self.landmarks


def fit_kernel(languages: list[str], texts: list[np.ndarray], landmarks: int, ridge: float) -> KernelModel | None:
    """From a sample's languages and presence slots. Landmarks are dealt evenly to the languages, in sample order."""
    names = sorted(set(languages))
    if not names:
        return None
    share = max(1, landmarks // len(names))
    chosen = [i for name in names for i in [i for i, x in enumerate(languages) if x == name][:share]]
    slots = np.unique(np.concatenate([texts[i] for i in chosen]))
    column = np.full(BOUNDS[-1], -1, np.int32)
    column[slots] = np.arange(len(slots))
    marks = np.zeros((len(slots), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[column[texts[i]], j] = norms(texts[i]) / 3
    bare = KernelModel(names, column, marks, np.zeros((len(chosen) + 1, len(names)), np.float32))
    k = np.concatenate([bare.kernel(texts[i : i + 256]) for i in range(0, len(texts), 256)]).astype(np.float64)
    among = k[chosen]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    large = values > 1e-6 * values.max()
    root = vectors[:, large] / np.sqrt(values[large])
    phi = np.column_stack([k @ root, np.ones(len(k))])
    y = np.array([[float(x == name) for name in names] for x in languages])
    penalty = ridge * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(phi.T @ phi + penalty, phi.T @ y)
    return bare._replace(weights=np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def held_out() -> Column:
    """Whether crc32 of the doc_id's text leaves 1 by 3; such rows, and those without an id, are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, per_language: int = 400, landmarks: int = 64, ridge: float = 0.1, batch: int = 256, sample_rows: int = 40_000) -> DataFrame:
    """Predict the language of every whole text of ``docs`` (doc_id, text, lang).

    Learns from at most ``per_language`` documents of each known lang that are not held out, fewer where that would be
    more than ``sample_rows`` in all (but one of each lang), chosen by a hash of the id; the sample's n-grams, not its
    texts, go to the driver. Scoring reads text alone.

    Texts that are null, empty or without letters get ``und`` and score 0.0; so does every text if nothing can be
    learnt. Repeated rows get the same answer each and are learnt from once, as are rows of one id and lang; ties between languages go to the first by name. Texts of
    any length are read whole, as a set of n-grams. An empty table gives an empty result and other columns are ignored. Returns doc_id, held_out, lang_pred, score (0 to 1).
    """
    spark = docs.sparkSession
    whole_text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))).orderBy(*order)
    turn = Window.partitionBy("lang").orderBy(*order)
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    languages = known.select(F.approx_count_distinct("lang").alias("n")).first()["n"]
    per_language = max(1, min(per_language, sample_rows // max(1, languages)))
    # First within 64 shares of a language, so that no task sees all of a frequent one.
    known = known.withColumn("turn", F.row_number().over(shares)).where(F.col("turn") <= per_language)
    sample = known.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_language).select("doc_id", "lang").distinct()

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BOUNDS[-1], bool)
        for b in batches:
            found = pa.array([grams(text.as_py(), seen).tobytes() for text in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), found], ["doc_id", "lang", "grams"])

    texts = docs.join(F.broadcast(sample), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang")
    rows = texts.mapInArrow(presence, "doc_id long, lang string, grams binary").where("length(grams) > 0")
    rows = rows.groupBy("doc_id", "lang").agg(F.min("grams").alias("grams")).collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"], bytes(r["grams"])))
    model = fit_kernel([r["lang"] for r in rows], [np.frombuffer(r["grams"], np.int32) for r in rows], landmarks, ridge)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, np.zeros(BOUNDS[-1], bool)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                found = [grams(text.as_py(), seen) for text in b.column(2)]
                some = [i for i, x in enumerate(found) if len(x)] if model else []
                names, marks = ["und"] * len(found), [0.0] * len(found)
                if some:
                    out = model.scores([found[i] for i in some])
                    for i, j, x in zip(some, out.argmax(1).tolist(), np.clip(out.max(1), 0, 1).tolist(), strict=True):
                        names[i], marks[i] = model.languages[j], x
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(marks, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document, by a model learnt from the lang column of those not held out."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
