"""Document fingerprints: SimHash of 128 bits, and all pairs within a Hamming radius. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelark.llm.bloom import blocks_for, bloom_words, might_contain
from tracelark.llm.storage import Scratch, written

BITS, HALF = 128, 32
#: Two counters of 32 bits in one long: of bit k and of bit k + 32.
LANES = (1 << HALF) | 1


def term_hashes(text: Column) -> Column:
    """A hash for each word of ``text`` (parted by white space, lower-cased) and for each two neighbours, with repeats."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def with_pairs(hashes: Column) -> Column:
        pairs = F.greatest(F.size(hashes) - 1, F.lit(0))
        return F.concat(hashes, F.zip_with(F.slice(hashes, 1, pairs), F.slice(hashes, 2, pairs), lambda a, b: F.xxhash64(a, b)))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), with_pairs)[0]  # the lambda's hashes are computed once


def simhash(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The fingerprint of each row of ``texts``, whose ``keys`` are its own, as columns high and low (64 bits each).

    Each term's hash votes on every bit, for or against, as often as the term occurs. Bits with more votes for than
    against are 1. Votes for bits k and k + 32 are summed as the halves of one long, so a row of terms costs
    64 additions, summed where the text is before anything is shuffled.
    """
    terms = texts.select(*keys, F.explode_outer(term_hashes(F.col(text))).alias("_a")).withColumn("_b", F.when(F.col("_a").isNotNull(), F.xxhash64("_a", F.lit(1))))
    votes = [F.sum(F.shiftright(F.col(c), k).bitwiseAND(F.lit(LANES))).alias(f"{c}{k}") for c in ("_a", "_b") for k in range(HALF)]
    counted = terms.groupBy(*keys).agg(F.count("_a").alias("_n"), *votes)

    def half(c: str) -> Column:
        # Without terms the sums are null, and so no bit is set.
        low = [F.when(2 * F.col(f"{c}{k}").bitwiseAND(F.lit((1 << HALF) - 1)) > F.col("_n"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(HALF)]
        high = [F.when(2 * F.shiftrightunsigned(F.col(f"{c}{k}"), HALF) > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), k + HALF)).otherwise(F.lit(0).cast("long")) for k in range(HALF)]
        return reduce(lambda a, b: a.bitwiseOR(b), low + high)

    return counted.select(*keys, half("_a").alias("high"), half("_b").alias("low"))


def as_hex(high: Column, low: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (high, low))))


def distance(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    """In how many bits two fingerprints differ."""
    return F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))


def likeness(*fingerprints: Column) -> Column:
    return 1 - distance(*fingerprints) / F.lit(float(BITS))


def _tables(radius: int, blocks: int) -> list[tuple[int, int]]:
    """Masks (high, low), each of ``blocks - radius`` blocks of bits: two fingerprints within ``radius`` agree under one at least."""
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        out.append(tuple(m - (1 << 64) if m >> 63 else m for m in (mask >> 64, mask & ((1 << 64) - 1))))
    return out


def blocks_wanted(fingerprints: int, radius: int, most_tables: int = 64) -> int:
    """The fewest blocks whose tables' keys have bits enough for so many fingerprints to be apart by chance."""
    blocks = radius + 1
    while BITS * (blocks - radius) // blocks < fingerprints.bit_length() and comb(blocks + 1, radius) <= most_tables:
        blocks += 1
    return blocks


def within_radius(fingerprints: DataFrame, radius: int = 4) -> DataFrame:
    """All pairs of different ``fingerprints`` (high, low) that differ in at most ``radius`` bits.

    Bits are cut into blocks. At most ``radius`` blocks differ within a pair, so some table, keyed by the others, has both
    under one key. A pair is verified where it meets and counts at the first such table, so candidates are never
    written. Exact; only the number of tables depends on the number of fingerprints. Equal fingerprints are one.

    Returns high, low, other_high, other_low with (high, low) the smaller, and distance.
    """
    apart = fingerprints.select("high", "low").distinct()
    tables = _tables(radius, blocks_wanted(apart.count(), radius))
    rows = F.array(*(F.struct(F.lit(t).alias("place"), F.col("high").bitwiseAND(F.lit(h)).alias("a"), F.col("low").bitwiseAND(F.lit(m)).alias("b")) for t, (h, m) in enumerate(tables)))
    keyed = apart.select("high", "low", F.inline(rows))
    other = keyed.select("place", "a", "b", F.col("high").alias("other_high"), F.col("low").alias("other_low"))
    x, y = F.col("high").bitwiseXOR(F.col("other_high")), F.col("low").bitwiseXOR(F.col("other_low"))
    agreed = [(x.bitwiseAND(F.lit(h)) == 0) & (y.bitwiseAND(F.lit(m)) == 0) for h, m in tables]
    first = F.coalesce(*(F.when(ok, F.lit(t)) for t, ok in enumerate(agreed)))
    smaller = (F.col("high") < F.col("other_high")) | ((F.col("high") == F.col("other_high")) & (F.col("low") < F.col("other_low")))
    pair = distance(F.col("high"), F.col("low"), F.col("other_high"), F.col("other_low"))
    met = keyed.join(other, ["place", "a", "b"]).where(smaller & (pair <= radius) & (first == F.col("place")))
    return met.select("high", "low", "other_high", "other_low", pair.alias("distance"))


def link_counts(fingerprints: DataFrame, radius: int = 4) -> DataFrame:
    """``fingerprints`` (high, low; a row for each document) by class: documents of equal fingerprints, and links: documents of
    others within ``radius``. Columns high, low, documents, links."""
    classes = written(fingerprints.groupBy("high", "low").agg(F.count("*").alias("documents")), "fingerprint-classes")
    pairs = written(within_radius(classes, radius), "fingerprint-pairs")
    there = pairs.select("high", "low", F.col("other_high").alias("h"), F.col("other_low").alias("l"))
    back = pairs.select(F.col("other_high").alias("high"), F.col("other_low").alias("low"), F.col("high").alias("h"), F.col("low").alias("l"))
    sizes = classes.select(F.col("high").alias("h"), F.col("low").alias("l"), F.col("documents").alias("k"))
    links = there.unionByName(back).join(sizes, ["h", "l"]).groupBy("high", "low").agg(F.sum("k").alias("links"))
    return classes.join(links, ["high", "low"], "left").select("high", "low", "documents", F.coalesce("links", F.lit(0)).alias("links"))


KEY = ["none", "id", "print"]
NEXT = [f"next_{c}" for c in KEY]


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key free of nulls: a null doc_id is 0 and ``none``; rows of one id are apart by their texts' hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))


def _once(rows: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` without repeats. Only those that may be repeated, by a Bloom filter, are grouped, where they are first."""
    repeated = scratch.written(places.where("n > 1").select(F.xxhash64(*KEY).alias("key")), "repeated")
    blocks = blocks_for(repeated.count())
    tested = rows.withColumn("_again", might_contain(bloom_words(repeated, blocks).scalar(), F.xxhash64(*KEY), blocks))
    return tested.where("not _again").select(*rows.columns).unionByName(tested.where("_again").select(*rows.columns).distinct())


def next_documents(places: DataFrame, scratch: Scratch) -> DataFrame:
    """``places`` (none, id, print, n_chars) with the key of the next one: by descending id, null last, then hash; the first follows the last.

    Places are dealt by ranges and written with their range's number; only the first place of each range crosses to the
    range before.
    """
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("none"), F.col("id").desc(), F.col("print")]
    dealt = scratch.written(places.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()), "ranges")
    firsts = dealt.groupBy("part").agg(F.min(F.struct("none", F.negative("id").alias("down"), "print", "id")).alias("first"))
    around = Window.orderBy("part")
    wrapped = F.first("first").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    behind = firsts.select("part", F.coalesce(F.lead("first").over(around), wrapped).alias("behind"))  # a row a range
    inside = dealt.withColumn("inside", F.lead(F.struct(*KEY)).over(Window.partitionBy("part").orderBy(*order)))
    then = F.coalesce(F.col("inside"), F.struct("behind.none", "behind.id", "behind.print"))
    return inside.join(F.broadcast(behind), "part").select(*KEY, "n_chars", *(then[c].alias(f"next_{c}") for c in KEY))


def edited_fingerprints(docs: DataFrame, radius: int = 4) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and of their edited texts, and how alike they are.

    The edited text has the last half (of the code points, rounded down) replaced by the first as many, or all, of the next
    document, by descending doc_id, null last; after the last comes the first. Places of documents are found on keys alone;
    then only the part of a text that is asked for goes to the document before it.

    Null texts are empty; a text without words has a fingerprint of zeros. Rows with the same id and text are one document,
    with one row in the result; texts of one id stand by their hashes. Texts of any length are split in one row. Other
    columns are ignored; an empty table gives an empty one.

    Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (32 hexadecimal digits), near_edited and
    near_next (the share of equal bits with the edited text and the next document), documents (with this fingerprint) and
    links (documents of other fingerprints within ``radius`` bits).
    """
    scratch = Scratch(docs.sparkSession)
    rows = _keyed(docs)
    places = scratch.written(rows.groupBy(*KEY, F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("n")), "places")
    asked = scratch.written(next_documents(places.drop("n"), scratch), "next-documents")
    texts = _once(rows, places, scratch)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    wanted = asked.select(*(F.col(c).alias(f"own_{c}") for c in KEY), *(F.col(f"next_{c}").alias(c) for c in KEY), half.alias("half"))
    heads = texts.join(wanted, KEY).select(*(F.col(f"own_{c}").alias(c) for c in KEY), F.substring("text", F.lit(1), F.col("half")).alias("head"), "half")
    kept = F.substring("text", F.lit(1), F.length("text") - F.col("half"))
    both = texts.join(heads, KEY).select(*KEY, "text", F.concat(kept, "head").alias("edited"))
    own = F.struct(F.lit(False).alias("is_edited"), F.length("text").cast("long").alias("n_chars"), F.lit(None).cast("string").alias("sha"), F.col("text").alias("said"))
    other = F.struct(F.lit(True).alias("is_edited"), F.lit(None).cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("said"))
    prints = written(simhash(both.select(*KEY, F.inline(F.array(own, other))), [*KEY, "is_edited", "n_chars", "sha"], "said"), "fingerprints")
    own = prints.where("not is_edited").select(*KEY, "n_chars", "high", "low")
    changed = prints.where("is_edited").select(*KEY, F.col("sha").alias("edited_sha256"), F.col("high").alias("e_high"), F.col("low").alias("e_low"))
    then = own.select(*(F.col(c).alias(f"next_{c}") for c in KEY), F.col("high").alias("n_high"), F.col("low").alias("n_low"))
    asked = written(asked.select(*KEY, *NEXT), "followers")
    scratch.drop()
    joined = own.join(changed, KEY).join(asked, KEY).join(then, NEXT).join(link_counts(own, radius), ["high", "low"])
    fingerprint, e, n = ([F.col(f"{p}high"), F.col(f"{p}low")] for p in ("", "e_", "n_"))
    return joined.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_hex(*fingerprint).alias("fingerprint"),
        as_hex(*e).alias("edited_fingerprint"),
        likeness(*fingerprint, *e).alias("near_edited"),
        likeness(*fingerprint, *n).alias("near_next"),
        "documents",
        "links",
    )


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
