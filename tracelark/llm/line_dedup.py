"""Line dedup: repeated runs of lines, found as content-defined chunks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.llm.bloom import blocks_for, bloom_words, might_contain, with_hits
from tracelark.llm.storage import Scratch, written

#: What a line that counts as blank is made of.
SPACE = " \t\x0b\x0c\r"


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns so that they are computed once a row, even where a lambda reads them for each element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def chunked(docs: DataFrame, divisor: int, chunkings: int, min_lines: int, min_bytes: int) -> DataFrame:
    """Adds lines and chunks (at: first line from 1, size: number of lines, hash) to rows with ``text``.

    Each line that isn't blank is hashed. A rolling hash over ``min_lines`` of these hashes is taken from every line on.
    Its remainder by ``divisor`` names the one of ``divisor`` chunkings in which a boundary stands before that line; a chunk
    lasts from a boundary for ``min_lines`` lines, the blank ones between them too. Boundaries depend on the chunk's own
    lines alone, so what is inserted elsewhere moves none. The first ``chunkings`` chunkings are used: a run of exactly
    ``min_lines`` lines is a chunk in one chunking only, so all are needed to find each; of a run of n lines one chunking
    finds one place in about ``divisor``. Chunks of fewer than ``min_bytes`` bytes, line ends apart, are none.
    """
    lines = _settled(docs, lines=F.split("text", "\n"))
    each = F.transform("lines", lambda line, i: F.struct((i + 1).alias("at"), F.xxhash64(line).alias("hash"), F.octet_length(line).alias("bytes"), (F.btrim(line, F.lit(SPACE)) == "").alias("blank")))
    told = _settled(lines, told=F.filter(each, lambda x: ~x["blank"]))
    starts = F.when(F.size("told") >= min_lines, F.sequence(F.lit(0), F.size("told") - min_lines)).otherwise(F.array().cast("array<int>"))

    def chunk(i: Column) -> Column:
        own = [F.get("told", i + k) for k in range(min_lines)]
        size = own[-1]["at"] - own[0]["at"] + 1
        return F.struct(own[0]["at"].alias("at"), size.alias("size"), F.xxhash64(*(o["hash"] for o in own)).alias("hash"), sum((o["bytes"] for o in own), F.lit(0)).alias("bytes"))

    chunks = F.filter(F.transform(starts, chunk), lambda c: (c["bytes"] >= min_bytes) & (F.pmod(c["hash"], F.lit(divisor)) < chunkings))
    return _settled(told, chunks=chunks).drop("told")


def _code(at: Column, size: Column) -> Column:
    """A chunk's place as one long, so that sets of places are sets of numbers."""
    return at.cast("bigint") * (1 << 31) + size


def repeated_chunks(docs: DataFrame, divisor: int, chunkings: int, min_lines: int, min_bytes: int, scratch: Scratch, often_places: int = 1000, shares: int = 64) -> DataFrame:
    """Every occurrence but the first of a chunk that stands in more than one place.

    Returns doc_id, print (of the text) and code (the place). First means by doc_id, then print and line. Equal hashes
    alone decide nothing: occurrences are grouped by the bytes of the chunk's lines, blank ones left out. Chunks of
    ``often_places`` places are dealt to ``shares`` tasks.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("print"), "text").where("text is not null")
    marked = chunked(texts, divisor, chunkings, min_lines, min_bytes)
    counts = marked.select(F.explode(F.transform("chunks", lambda c: c["hash"])).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    repeated = scratch.written(counts.where("n > 1"), "line-dedup-hashes")
    blocks = blocks_for(repeated.count())
    words = bloom_words(repeated.select("key"), blocks).scalar()
    often = repeated.where(F.col("n") >= often_places).select("key")
    often_blocks = blocks_for(often.count())
    often_words = bloom_words(often, often_blocks).scalar()
    seen = marked.withColumn("words", words)
    possible = F.filter("chunks", lambda c: might_contain(F.col("words"), c["hash"], blocks))

    def own_lines(c: Column) -> Column:
        return F.filter(F.slice("lines", c["at"], c["size"]), lambda line: F.btrim(line, F.lit(SPACE)) != "")

    found = F.transform(possible, lambda c: F.struct(_code(c["at"], c["size"]).alias("code"), c["hash"].alias("hash"), F.array_join(own_lines(c), "\n").alias("bytes")))
    places = scratch.written(seen.select("doc_id", "print", F.inline(found)), "line-dedup-chunks")
    # Map-side minima come first, so a chunk that very many documents share is a row for each task here.
    firsts = places.groupBy("hash", "bytes").agg(F.min(F.struct("doc_id", "print", "code")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Chunks of very many places meet their first one in several shares, dealt by place.
    hot = might_contain(often_words, F.col("hash"), often_blocks)
    share = F.when(hot, F.pmod(F.xxhash64("doc_id", "print", "code"), F.lit(shares)).cast("int")).otherwise(F.lit(0))
    every = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0))))
    firsts = firsts.select("hash", "bytes", "first", every.alias("share"))
    again = places.withColumn("share", share).join(firsts, ["hash", "bytes", "share"])
    return again.where(~(F.struct("doc_id", "print", "code").eqNullSafe(F.col("first")))).select("doc_id", "print", "code")


def dedup_lines(docs: DataFrame, divisor: int = 4, chunkings: int | None = None, min_lines: int = 2, min_bytes: int = 16) -> DataFrame:
    """Remove globally repeated multi-line chunks from ``docs``, keeping the first place of each.

    Blank lines (white space alone) don't count: lines are neighbours if only blank ones stand between them. With all
    ``chunkings``, the default, a line goes exactly if it lies in a run of ``min_lines`` neighbours of ``min_bytes`` or more
    bytes that also begins at an earlier place (by doc_id, then line) of ``docs`` as they came; the two may overlap. Blank
    lines go only inside such a run, so paragraph breaks and lone brackets stay. With fewer chunkings, only runs that
    their boundaries open are found, at their share of the cost. Either way some place keeps each line.

    Adds n_lines, n_removed (lines) to the columns of ``docs`` and shortens text; n_chars follows if there is
    such a column. Only documents that may hold a repeat (by a Bloom filter of bounded size) are shuffled; all
    others stream through.

    A null text stays null with 0 lines; an empty one is one empty line and stays. A text of any length is split in one
    row. Repeated rows with one doc_id and text are one place and stay alike, other texts of that id are places of their
    own; a null doc_id sorts first. Clashing column names (n_lines, n_removed) are replaced. An empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_removed")
    kept_columns = docs.columns
    scratch = Scratch(docs.sparkSession)
    chunkings = divisor if chunkings is None else chunkings
    repeats = written(repeated_chunks(docs, divisor, chunkings, min_lines, min_bytes, scratch), "line-dedup-repeats")
    scratch.drop()
    by_doc = repeats.groupBy(F.col("doc_id").alias("_doc"), F.col("print").alias("_print")).agg(F.collect_set("code").alias("_codes"))
    blocks = blocks_for(by_doc.count())
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    tested = with_hits(docs, repeats.select(key.alias("key")).distinct(), blocks, key, "_hit")
    tested = tested.withColumn("_hit", F.col("_hit") & F.col("text").isNotNull())
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    calm = tested.where(~F.col("_hit")).select(*kept_columns, n_lines.alias("n_lines"), F.lit(0).alias("n_removed"))
    joined = tested.where("_hit").join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_print")), "left")
    return _numbered(calm.unionByName(_without_chunks(joined, kept_columns)), docs)


def _numbered(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` with n_chars of its text, if ``docs`` has such a column."""
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _without_chunks(joined: DataFrame, kept_columns: list[str]) -> DataFrame:
    """Rows without the lines of the chunks in ``_codes``."""
    codes = F.coalesce("_codes", F.array().cast("array<bigint>"))
    gone = F.flatten(F.transform(codes, lambda c: F.transform(F.sequence(F.lit(0), (F.pmod(c, F.lit(1 << 31)) - 1).cast("int")), lambda k: F.floor(c / (1 << 31)).cast("int") + k)))
    lines = _settled(joined, lines=F.split("text", "\n"))
    left = _settled(lines, _kept=F.array_except(F.sequence(F.lit(1), F.size("lines")), gone))
    columns = {c: F.col(c) for c in kept_columns} | {"text": F.array_join(F.transform("_kept", lambda i: F.get("lines", i - 1)), "\n")}
    return left.select(*(c.alias(n) for n, c in columns.items()), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("_kept")).alias("n_removed"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without repeated runs of two or more lines; the text that is left as its SHA-256."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))
