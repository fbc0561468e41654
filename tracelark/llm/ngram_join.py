"""N-gram Jaccard join: a grouped prefix join over word shingles, exact at any size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.llm.batches import whole_text_batches
from tracelark.llm.bloom import blocks_for, with_hits
from tracelark.llm.components import connected
from tracelark.llm.storage import Scratch, written
from tracelark.llm.words import mix, shingle_hashes, word_hashes

#: Tokens are shingle hashes cut to 48 bits; sets are counted before the cut.
TOKEN_BITS = 48
#: A task hands on what it has gathered at so many documents at most: they are numbered in two bytes.
FLUSH_DOCS = 60_000
COMMON = np.uint32(0xFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that one task's Python worker holds at once where blocks of a range of tokens meet (about 50 bytes each).
PART_TOKENS = 1 << 21
#: A task cuts what it has gathered into so many rows at most. More ranges than that are reached in levels.
FAN = 512

SPREAD = "part int, rid long, doc_id long, print long, n long, fp long, common binary, tokens binary, owners binary, counts binary"
RETURNED = "part int, rid long, doc_id long, print long, n long, fp long, common binary, rids binary, tokens binary, freqs binary"
CANDIDATES = "doc_id long, print long, rid long, n long, fp long, uniq long, tokens array<long>"


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number, byte position by byte position, which compresses well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(planes: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(planes) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(planes, np.uint8).reshape(size, -1).T
    return out.reshape(-1).view("<u8")


def _rising(values: np.ndarray, size: int) -> bytes:
    return _planes(np.diff(values, prepend=values.dtype.type(0)), size)


def _risen(planes: bytes, size: int) -> np.ndarray:
    return np.cumsum(_numbers(planes, size), dtype=np.uint64)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _doc_part(rids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(rids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _token_part(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The range of each token: ``parts`` ranges of about equal width, in order. ``parts`` is below 2^24."""
    high, low = tokens >> np.uint64(TOKEN_BITS // 2), tokens & np.uint64((1 << TOKEN_BITS // 2) - 1)
    whole = high * np.uint64(parts) + (low * np.uint64(parts) >> np.uint64(TOKEN_BITS // 2))
    return (whole >> np.uint64(TOKEN_BITS // 2)).astype(np.int64)


def _widths(parts: int) -> list[int]:
    """How many ranges a row holds at each level, down to one; each level cuts a row into ``FAN`` at most."""
    widths = [1]
    while -(-parts // widths[0]) > FAN:
        widths.insert(0, widths[0] * FAN)
    return widths


def _arrow_schema(names: list[str]) -> pa.Schema:
    kinds = {"part": pa.int32(), **dict.fromkeys(("rid", "doc_id", "print", "n", "fp"), pa.int64())}
    return pa.schema([(c, kinds.get(c, pa.binary())) for c in names])


def _table(names: list[str], rows: dict[str, list]) -> pa.RecordBatch:
    n, schema = max(len(v) for v in rows.values()), _arrow_schema(names)
    return pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


_SPREAD, _RETURNED = ([c.split()[0] for c in s.split(", ")] for s in (SPREAD, RETURNED))


class _Flush:
    """Documents gathered by one task, handed on as blocks of sorted tokens by range of the token."""

    def __init__(self, base: int, parts: int, width: int, tokens: int, common_docs: int):
        self.base, self.parts, self.width, self.tokens, self.common_docs, self.held = base, parts, width, tokens, common_docs, 0
        self.ids: list[int | None] = []
        self.texts: list[int | None] = []
        self.sizes: list[int] = []
        self.prints: list[int] = []
        self.sets: list[np.ndarray] = []
        self.owners: list[int] = []
        self.seen: set[tuple[int, int]] = set()

    def add(self, doc_id: int | None, text: int | None, shingles: np.ndarray) -> None:
        n = len(shingles)
        fp = int(mix(np.bitwise_xor.reduce(mix(shingles), keepdims=True) * _ODD + shingles.sum(keepdims=True))[0]) if n else 0
        if n and (fp, n) not in self.seen:  # further copies in this flush bring no postings
            self.seen.add((fp, n))
            self.sets.append(np.unique(shingles >> np.uint64(64 - TOKEN_BITS)))
            self.owners.append(len(self.ids))
            self.held += n
        self.ids.append(doc_id)
        self.texts.append(text)
        self.sizes.append(n)
        self.prints.append(fp - (1 << 64) if fp >> 63 else fp)

    def full(self) -> bool:
        return self.held >= self.tokens or len(self.ids) >= FLUSH_DOCS

    def batches(self) -> Iterator[pa.RecordBatch]:
        common_of: dict[int, bytes] = {}
        if self.sets:
            tokens = np.concatenate(self.sets)
            owners = np.repeat(np.array(self.owners, np.uint64), [len(s) for s in self.sets])
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            starts = _starts(tokens)
            often = np.diff(starts) >= self.common_docs
            common, counts = tokens[starts[:-1][often]], np.diff(starts)[often].astype(np.uint64)
            if len(common):
                held = np.repeat(often, np.diff(starts))
                ct, co = tokens[held], owners[held]
                by_doc = np.argsort(co, kind="stable")
                ct, co = ct[by_doc], co[by_doc]
                for a, b in zip((s := _starts(co))[:-1], s[1:], strict=True):
                    common_of[int(co[a])] = ct[a:b].astype("<u8").tobytes()
                tokens, owners = tokens[~held], owners[~held]
            own, shared = (_token_part(t, self.parts) // self.width for t in (tokens, common))
            held = np.union1d(own, shared)  # only ranges that hold a token
            cuts = (np.searchsorted(own, held), np.searchsorted(own, held, "right"), np.searchsorted(shared, held), np.searchsorted(shared, held, "right"))
            rows: dict[str, list] = {k: [] for k in ("part", "rid", "tokens", "owners", "common", "counts")}
            for part, a, b, c, d in zip(held.tolist(), *cuts, strict=True):
                rows["part"].append(part)
                rows["rid"].append(self.base)
                rows["tokens"].append(_rising(tokens[a:b], 6))
                rows["owners"].append(_planes(owners[a:b], 2))
                rows["common"].append(_rising(common[c:d], 6))
                rows["counts"].append(_planes(counts[c:d], 4))
            if rows["part"]:
                yield _table(_SPREAD, rows)
        rids = self.base + np.arange(len(self.ids))
        yield _table(
            _SPREAD,
            {
                "part": (_doc_part(rids, self.parts) // self.width).tolist(),
                "rid": rids.tolist(),
                "doc_id": self.ids,
                "print": self.texts,
                "n": self.sizes,
                "fp": self.prints,
                "common": [common_of.get(i) for i in range(len(self.ids))],
            },
        )


def _spread(docs: DataFrame, size: int, parts: int, flush_tokens: int, common_docs: int) -> DataFrame:
    width = _widths(parts)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        flush = _Flush((context.partitionId() if context else 0) << 40, parts, width, flush_tokens, common_docs)
        for batch in batches:
            for doc_id, text, seen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = word_hashes((text.as_py() or "").encode())
                flush.add(doc_id, seen, shingle_hashes(words, size))
                if flush.full():
                    yield from flush.batches()
                    flush = _Flush(flush.base + len(flush.ids), parts, width, flush_tokens, common_docs)
        if flush.ids:
            yield from flush.batches()

    return docs.mapInArrow(run, SPREAD)


class _Regroup:
    """Blocks that came for wide ranges, gathered and handed on as fewer, fuller blocks for narrower ones."""

    def __init__(self, parts: int, width: int, tokens: int, by_token: bool):
        self.parts, self.width, self.tokens, self.by_token, self.held = parts, width, tokens, by_token, 0
        self.names = _SPREAD if by_token else _RETURNED
        self.blocks: list[dict] = []

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.filter(pc.is_valid(batch["n"]))
            if docs.num_rows:
                part = pa.array(_doc_part(docs["rid"].to_numpy(), self.parts) // self.width, pa.int32())
                yield docs.set_column(0, pa.field("part", pa.int32()), part)
            for block in batch.filter(pc.is_null(batch["n"])).to_pylist():
                self.blocks.append(block)
                self.held += (len(block["tokens"]) + len(block["common"] or b"")) // 6
                if self.held >= self.tokens:
                    yield from self.flush()
        yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.blocks:
            yield _table(self.names, self._by_token() if self.by_token else self._by_doc())
        self.blocks, self.held = [], 0

    def _by_token(self) -> dict[str, list]:
        tokens = np.concatenate([_risen(b["tokens"], 6) for b in self.blocks])
        rids = np.concatenate([_owners(b) for b in self.blocks])
        common, counts = np.concatenate([_risen(b["common"], 6) for b in self.blocks]), np.concatenate([_numbers(b["counts"], 4) for b in self.blocks])
        order, order_common = np.argsort(tokens, kind="stable"), np.argsort(common, kind="stable")
        tokens, rids, common, counts = tokens[order], rids[order], common[order_common], counts[order_common]
        own, shared = (_token_part(t, self.parts) // self.width for t in (tokens, common))
        held = np.union1d(own, shared)
        cuts = (np.searchsorted(own, held), np.searchsorted(own, held, "right"), np.searchsorted(shared, held), np.searchsorted(shared, held, "right"))
        rows: dict[str, list] = {k: [] for k in ("part", "tokens", "owners", "common", "counts")}
        for part, a, b, c, d in zip(held.tolist(), *cuts, strict=True):
            rows["part"].append(part)
            rows["tokens"].append(_rising(tokens[a:b], 6))
            rows["owners"].append(_planes(rids[a:b], 8))
            rows["common"].append(_rising(common[c:d], 6))
            rows["counts"].append(_planes(counts[c:d], 4))
        return rows

    def _by_doc(self) -> dict[str, list]:
        rids = np.concatenate([_risen(b["rids"], 8) for b in self.blocks])
        tokens, freqs = np.concatenate([_numbers(b["tokens"], 6) for b in self.blocks]), np.concatenate([_numbers(b["freqs"], 4) for b in self.blocks])
        return _by_doc(rids, tokens, freqs, self.parts, self.width, self.blocks[0]["rid"])


def _owners(block: dict) -> np.ndarray:
    """Documents of a block's tokens: numbered from the block's own first one, or in full once blocks were gathered."""
    return _numbers(block["owners"], 8) if block["rid"] is None else _numbers(block["owners"], 2) + np.uint64(block["rid"])


def _by_doc(rids: np.ndarray, tokens: np.ndarray, freqs: np.ndarray, parts: int, width: int, source: int) -> dict[str, list]:
    """Rows of ``RETURNED`` for the shares of documents that ``rids`` lie in. ``source`` only spreads them over tasks."""
    part = _doc_part(rids, parts) // width
    order = np.lexsort((rids, part))
    rids, tokens, freqs, part = rids[order], tokens[order], freqs[order], part[order]
    rows: dict[str, list] = {k: [] for k in ("part", "rid", "rids", "tokens", "freqs")}
    starts = _starts(part).tolist()
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        rows["part"].append(int(part[a]))
        rows["rid"].append(source)
        rows["rids"].append(_rising(rids[a:b], 8))
        rows["tokens"].append(_planes(tokens[a:b], 6))
        rows["freqs"].append(_planes(freqs[a:b], 4))
    return rows


def _levelled(blocks: DataFrame, parts: int, tokens: int, by_token: bool) -> DataFrame:
    """Blocks cut level by level until each is of one range. A wide range is dealt to many tasks, by where a block came from."""
    for width in _widths(parts)[1:]:
        wide = -(-parts // (width * FAN))
        shares = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // wide)
        dealt = blocks.repartition("part", F.pmod(F.xxhash64("rid"), F.lit(shares)))
        blocks = dealt.mapInArrow(lambda batches, w=width: _Regroup(parts, w, tokens, by_token).run(batches), SPREAD if by_token else RETURNED)
    return blocks


def _count_and_return(parts: int):
    """For one range of tokens: drops tokens of a single document and returns the others, with their frequency, by document."""
    width = _widths(parts)[0]

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        docs = table.filter(pc.is_valid(table["n"]))
        if docs.num_rows:
            for b in docs.select(["part", "rid", "doc_id", "print", "n", "fp", "common"]).combine_chunks().to_batches():
                b = b.set_column(0, "part", pa.array(b["part"].to_numpy() // width, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(b.num_rows, pa.binary())] * 3], schema=_arrow_schema(_RETURNED))
        blocks = table.filter(pc.is_null(table["n"])).to_pylist()
        if not blocks:
            return
        tokens = np.concatenate([_risen(b["tokens"], 6) for b in blocks])
        rids = np.concatenate([_owners(b) for b in blocks])
        source, common = blocks[0]["part"], np.unique(np.concatenate([_risen(b["common"], 6) for b in blocks]))
        del blocks, table, docs
        order = np.argsort(tokens, kind="stable")
        tokens, rids = tokens[order], rids[order]
        starts = _starts(tokens)
        freqs = np.minimum(np.diff(starts), int(COMMON) - 1).astype(np.uint32)
        if len(common) and len(tokens):
            distinct = tokens[starts[:-1]]
            at = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
            freqs[common[at] == distinct] = COMMON
        each = np.repeat(freqs, np.diff(starts))
        keep = each >= 2
        tokens, rids, each = tokens[keep], rids[keep], each[keep]
        if len(rids):
            yield _table(_RETURNED, _by_doc(rids, tokens, each.astype(np.uint64), parts, width, source))

    return lambda table: pa.Table.from_batches(run(table), _arrow_schema(_RETURNED))


def _assemble(percent: int):
    """For one share of the documents: each one's tokens that others hold, rarest first, if its prefix reaches them."""
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "print", "rid", "n", "fp", "uniq")), ("tokens", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        docs = table.filter(pc.is_valid(table["n"]))
        blocks = table.filter(pc.is_null(table["n"])).select(["rids", "tokens", "freqs"]).to_pylist()
        rid, n = docs["rid"].to_numpy(), docs["n"].to_numpy()
        local = [(i, np.frombuffer(c.as_py(), "<u8")) for i, c in enumerate(docs["common"]) if c.is_valid]
        none = np.zeros(0, np.uint64)
        rids = np.concatenate([none, *(_risen(b["rids"], 8) for b in blocks), *(np.full(len(c), rid[i], np.uint64) for i, c in local)])
        tokens = np.concatenate([none, *(_numbers(b["tokens"], 6) for b in blocks), *(c for _, c in local)])
        freqs = np.concatenate([none, *(_numbers(b["freqs"], 4) for b in blocks), *(np.full(len(c), COMMON, np.uint64) for _, c in local)])
        order = np.lexsort((tokens, freqs, rids))
        rids, tokens = rids[order], tokens[order].astype(np.int64)
        first, last = np.searchsorted(rids, rid.astype(np.uint64)), np.searchsorted(rids, rid.astype(np.uint64), "right")
        uniq = n - (last - first)
        reached = (last > first) & (uniq < prefix_size(n, percent))
        sets = [tokens[a:b] if ok else None for a, b, ok in zip(first, last, reached, strict=True)]
        columns = [*(docs[c].combine_chunks() for c in ("doc_id", "print", "rid", "n", "fp")), pa.array(uniq, pa.int64())]
        for at in range(0, len(sets), 2000):
            few = [c.slice(at, 2000) for c in columns]
            yield pa.RecordBatch.from_arrays([*few, pa.array(sets[at : at + 2000], pa.list_(pa.int64()))], schema=schema)

    return lambda table: pa.Table.from_batches(run(table), schema)


def prefix_size(n, percent: int):
    """How many of a set's first tokens must hold one that any partner's prefix holds too."""
    return n - (percent * n + 99) // 100 + 1


def _scale(percent: int) -> int:
    return 2 * (100 + percent)


def _may_link(percent: int) -> Column:
    """Length and positional filters for two groups at the first token that both hold.

    Sets link where ``s`` of both plus ``_scale`` times the tokens they share is 0 or more. A group has ``left`` tokens from
    there on. No token before it is in both, so they can't share more than either has left. At a later common token the
    bound may fail, but each linking pair passes at its first.
    """
    n, b_n = F.col("n"), F.col("b_n")
    return (100 * F.least(n, b_n) >= percent * F.greatest(n, b_n)) & (F.col("s") + F.col("b_s") + _scale(percent) * F.least("left", "b_left") >= 0)


def _right(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("token", *(F.col(c).alias(f"b_{c}") for c in columns))


class _Families:
    """Which sets are known to be connected: a table of fp, gid and root, replaced after each round of comparisons."""

    def __init__(self, scratch: Scratch, sets: DataFrame, members: DataFrame, percent: int):
        self.scratch, self.sets, self.percent, self.measured, self.linked, self.pairs = scratch, sets, percent, 0, 0, []
        self.placed = scratch.written(members.select("fp", "gid", F.col("fp").alias("root")), "placed")

    def ungroup(self) -> None:
        """From now on each set is a group of its own."""
        self.placed = self.placed.withColumn("gid", F.col("fp"))

    def still_open(self, postings: DataFrame) -> DataFrame:
        """Postings of tokens whose groups aren't all connected, with the least and greatest root of each group."""
        spans = self.placed.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        spanned = postings.join(spans, "gid")
        tokens = spanned.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("token")
        tokens = self.scratch.written(tokens, "open-tokens")
        return self.scratch.written(spanned.join(tokens, "token", "left_semi"), "open-postings")

    def split_groups(self) -> DataFrame:
        """Members (gid, fp, root) of groups that aren't connected within."""
        spans = self.placed.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        return self.scratch.written(self.placed.join(spans.where("low <> high").select("gid"), "gid", "left_semi"), "split-groups")

    def compare(self, pairs: DataFrame) -> None:
        """Verifies ``pairs`` (a, b) of sets that no known links connect, and joins what links. ``a`` may repeat very often."""
        a = self.placed.select(F.col("fp").alias("a"), F.col("root").alias("a_root"))
        b = self.placed.select(F.col("fp").alias("b"), F.col("root").alias("b_root"))
        pairs, self.measured = self.scratch.counted(pairs.distinct().join(a, "a").join(b, "b").where("a_root <> b_root"), "candidate-pairs")
        self.linked = 0
        if not self.measured:
            return
        own = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("fp")), "candidate-sets")
        a = own.select(F.col("fp").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
        b = own.select(F.col("fp").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
        both, either = F.size(F.array_intersect("a_tokens", "b_tokens")), F.col("a_n") + F.col("b_n")
        found = pairs.join(a, "a").join(b, "b").where(100 * both >= self.percent * (either - both))
        found, self.linked = self.scratch.counted(found.select("a", "b", "a_root", "b_root", (both / (either - both)).alias("similarity")), "links")
        if not self.linked:
            return
        self.pairs.append(found.select(F.least("a", "b").alias("class_id"), F.greatest("a", "b").alias("other_class_id"), "similarity"))
        labels = connected(found.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), self.scratch)
        if labels is not None:
            up = labels.select(F.col("node").alias("root"), F.col("root").alias("to"))
            moved = self.placed.join(up, "root", "left").select("fp", "gid", F.coalesce("to", "root").alias("root"))
            self.placed = self.scratch.written(moved, "placed")

    def sets_of(self, wanted: DataFrame, name: str) -> DataFrame:
        """Sets whose fp is in ``wanted``, and a few more: those that a Bloom filter lets through, so few tokens are shuffled."""
        wanted, count = self.scratch.counted(wanted.select(F.col("fp").alias("key")).distinct(), name)
        blocks = blocks_for(count)
        return with_hits(self.sets, wanted, blocks, F.col("fp"), "hit").where("hit").drop("hit")

    def rounds(self, postings: DataFrame, share: float) -> None:
        """Rounds with pivots as long as ``share`` of the compared pairs link."""
        k = 0
        while not k or self.linked > 0 and self.linked >= share * self.measured:
            _pivot_round(self, postings, k)
            k += 1


def _pivot_round(families: _Families, postings: DataFrame, k: int) -> None:
    """Compares each group of an open token with one pivot for the token, and groups' members with one of them.

    So a round costs one comparison a posting at most. The first takes the set of least ``own``, later ones any.
    """
    scratch, filters = families.scratch, _may_link(families.percent)
    left = families.still_open(postings)
    own = F.lit(0.0) if k else F.col("own")
    rank = F.struct(own.alias("own"), F.xxhash64("gid", "token", F.lit(k)).alias("r"), "gid", "n", "left", "s")
    pivots = left.groupBy("token").agg(F.min(rank).alias("p")).select("token", *(F.col(f"p.{c}").alias(f"b_{c}") for c in ("gid", "n", "left", "s")))
    pivots = scratch.written(pivots, "pivots")
    stars = left.join(pivots, "token").where((F.col("gid") != F.col("b_gid")) & filters).select("gid", F.col("b_gid").alias("a")).distinct()
    pairs = stars.join(families.placed.select("gid", F.col("fp").alias("b")), "gid").select("a", "b")
    inside = families.split_groups().select("gid", "fp")
    heads = scratch.written(inside.groupBy("gid").agg(F.min(F.struct(F.xxhash64("fp", F.lit(k)).alias("r"), "fp")).alias("p")), "heads")
    within = inside.join(heads, "gid").select(F.col("p.fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    families.compare(pairs.unionByName(within))


def _possible(families: _Families, postings: DataFrame) -> DataFrame:
    """Open postings, without those that not even the best partner in their list could link with."""
    scratch = families.scratch
    best = scratch.written(postings.groupBy("token").agg(F.max("s").alias("best")), "best")
    return scratch.written(postings.join(best, "token").where(F.col("s") + F.col("best") + _scale(families.percent) * F.col("left") >= 0).drop("best"), "possible-postings")


def _banded(postings: DataFrame, percent: int) -> DataFrame:
    """Lists cut into overlapping bands of size: sizes of linking sets differ by ``100 / percent`` at most."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.01 * 100 / percent)))
    return postings.withColumn("band", F.explode(F.array(band, band - 1))).withColumn("token", F.xxhash64("token", "band")).drop("band")


def _across(families: _Families, left: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in ``left`` (open postings) that may link and that the rounds have left unconnected.

    Of two postings one is outside the list's largest family, so a connected family isn't compared with itself.
    """
    scratch, percent = families.scratch, families.percent
    main = left.groupBy("token", "low").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "low")).alias("m"))
    main = scratch.written(main.select("token", F.col("m.low").alias("main")), "main-families")
    sided = scratch.written(left.join(main, "token").withColumn("inner", (F.col("low") == F.col("main")) & (F.col("high") == F.col("main"))), "sided-postings")
    pairs = sided.where("not inner").join(_right(sided, "gid", "n", "left", "s", "low", "high", "inner"), "token")
    apart = ~((F.col("low") == F.col("high")) & (F.col("b_low") == F.col("b_high")) & (F.col("low") == F.col("b_low")))
    once = F.col("b_inner") | (F.col("gid") < F.col("b_gid"))
    groups = pairs.where(once & (F.col("gid") != F.col("b_gid")) & apart & _may_link(percent)).select("gid", "b_gid").distinct()
    groups = scratch.written(groups, "group-pairs")
    a = families.placed.select("gid", F.col("fp").alias("a"), F.col("root").alias("a_root"))
    b = families.placed.select(F.col("gid").alias("b_gid"), F.col("fp").alias("b"), F.col("root").alias("b_root"))
    across = groups.join(b, "b_gid").join(a, "gid").where("a_root <> b_root").select(F.col("b").alias("a"), F.col("a").alias("b"))
    inside = families.split_groups()
    x, y = (inside.select("gid", F.col("fp").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    return across.unionByName(x.join(y, "gid").where("a < b and a_root <> b_root").select("a", "b"))


def _differences(families: _Families, long: DataFrame) -> DataFrame:
    """Postings of what the sets of long lists have more and less than one set of the list, its centre.

    Two sets share (rest - d) / 2 of each and what their ``d`` differences from a centre have in common. So those that
    can link without a common difference link with the set nearest to the centre, which is compared here; all others
    have a common one among their first, by how many sets have it. What a family has in common is gone from the lists.
    """
    scratch, percent, scale = families.scratch, families.percent, _scale(families.percent)
    centres = scratch.written(long.groupBy("token").agg(F.min(F.struct("own", "gid")).alias("c")).select("token", F.col("c.gid").alias("centre")), "centres")
    assigned = long.join(centres, "token").select("gid", "centre").distinct()
    assigned = scratch.written(assigned.join(families.placed.select("gid", "fp"), "gid").select("fp", "centre").distinct(), "assigned")
    own = families.sets_of(assigned.select(F.explode(F.array("fp", "centre")).alias("fp")), "assigned-sets").select("fp", "n", "tokens")
    both = assigned.join(own, "fp").join(own.select(F.col("fp").alias("centre"), F.col("tokens").alias("c_tokens")), "centre")
    less = F.transform(F.array_except("c_tokens", "tokens"), lambda t: -t - 1)
    both = both.select("centre", "fp", "n", F.size("tokens").alias("rest"), F.concat(F.array_except("tokens", "c_tokens"), less).alias("items"))
    s = (100 + percent) * (F.col("rest") - F.size("items")) - 2 * percent * F.col("n")
    deltas = scratch.written(both.select("centre", "fp", "n", s.cast("long").alias("s"), "items"), "differences")
    near = scratch.written(deltas.groupBy("centre").agg(F.max(F.struct("s", "fp")).alias("b")).select("centre", F.col("b.s").alias("best"), F.col("b.fp").alias("a")), "nearest")
    known = deltas.join(near, "centre")
    certain = known.where((F.col("s") + F.col("best") >= 0) & (F.col("fp") != F.col("a"))).select("a", F.col("fp").alias("b"))
    families.ungroup()
    families.compare(certain)
    items = known.select("centre", "fp", "n", "s", "best", F.size("items").alias("d"), F.explode("items").alias("item"))
    items = items.withColumn("token", F.xxhash64("centre", "item")).drop("item")
    often = scratch.written(items.groupBy("token").agg(F.count("*").alias("k")), "difference-counts")
    listed = F.array_sort(F.collect_list(F.struct("k", "token")))
    ranked = items.join(often, "token").groupBy("centre", "fp").agg(*(F.first(c).alias(c) for c in ("n", "s", "best", "d")), listed.alias("listed"))
    least = F.greatest(F.lit(1), F.ceil(-(F.col("s") + F.col("best")) / scale))
    first = ranked.withColumn("size", (F.col("d") - least + 1).cast("int")).where("size > 0").select("fp", "n", "s", "d", F.posexplode(F.slice("listed", F.lit(1), F.col("size"))).alias("at", "x"))
    first = first.where("x.k > 1")
    return scratch.written(first.select(F.col("x.token").alias("token"), F.col("fp").alias("gid"), "n", (F.col("d") - F.col("at")).alias("left"), "s", (-F.col("s")).cast("double").alias("own")), "difference-postings")


def _distinct_sets(scratch: Scratch, held: DataFrame) -> DataFrame:
    """Of rows with equal sets (fp, n) the one of the least rid.

    Two Bloom filters, of the rows that stay and of those that go, tell nearly all rows apart where they are read; only
    rows that both may hold are shuffled, as their tokens are the bulk of what is stored.
    """
    ranked = held.select("fp", "n", "rid")
    least = ranked.groupBy("fp", "n").agg(F.min("rid").alias("least"))
    alike = ranked.join(least, ["fp", "n"])
    alike, count = scratch.counted(alike.select("rid", (F.col("rid") == F.col("least")).alias("stays")), "copies")
    blocks = blocks_for(count)
    told = held.select("rid", "fp", "n", "uniq", "tokens")
    for name, which in (("stay", "stays"), ("go", "not stays")):
        told = with_hits(told, alike.where(which).select(F.col("rid").alias("key")), blocks, F.col("rid"), name)
    unsure = told.where("go and stay").join(alike.where("not stays").select("rid"), "rid", "left_anti")
    return told.where("not go").unionByName(unsure).select("fp", "n", "uniq", "tokens")


def _first_of_alike(scratch: Scratch, postings: DataFrame) -> DataFrame:
    """Postings of tokens that several groups hold; of tokens that the very same groups hold, only those of the first.

    Tokens stand in one order in all sets, so the first token that two groups share is the first of those with its list of
    groups: no pair is lost. Lists are alike if their least group and the xor of their groups' 64-bit hashes are. Among
    tokens of one list the first has the least place (``at``) in any of its groups, so also the least of all.
    """
    lists = postings.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("gid")).alias("h"), F.min("gid").alias("gid"), F.min("at").alias("at"))
    firsts = lists.where("k > 1").groupBy("k", "h", "gid").agg(F.min(F.struct("at", "token")).alias("f")).select(F.col("f.token").alias("token"))
    firsts, count = scratch.counted(firsts, "first-tokens")
    blocks = blocks_for(count)
    likely = with_hits(postings, firsts.select(F.col("token").alias("key")), blocks, F.col("token"), "hit").where("hit")
    return scratch.written(likely.drop("at", "hit").join(firsts, "token", "left_semi"), "postings")


def link_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of ``link_classes``, without the pairs."""
    return link_classes(docs, **settings)[0]


def link_classes(docs: DataFrame, size: int = 5, percent: int = 75, flush_tokens: int = 1 << 18, common_docs: int = 256, long_list: int = 8, round_share: float = 0.1, part_tokens: int = PART_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Components of ``docs`` (doc_id, text) under Jaccard similarity of word shingles of at least ``percent`` %.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct shingles of ``size`` words,
    fewer words count as one shingle, and a text without words has an empty set and no links.

    1. Shingle hashes of all documents meet by ranges of the hash, as sorted blocks of about ``flush_tokens`` of a
       task's tokens; there are so many ranges that about ``part_tokens`` meet in each. A task never cuts what it holds into
       more than ``FAN`` blocks: where there are more ranges, blocks of wide ones are gathered and cut again, level by
       level, so blocks stay as full at any number of ranges. Tokens of one document can't
       link and stop there; the others go back with their document frequency, which gives one global order. A token
       that ``common_docs`` documents of one block hold is common: only its count is sent, its documents keep it
       themselves, and common tokens come last in the order. So a token of very many documents burdens no task.
    2. A document whose prefix holds no returned token is done. Equal sets are one node from here on, and nodes
       of equal size and equal prefix are one group. Of tokens that the same groups hold only the first counts from here on.
    3. Groups that share a prefix token are paired, under length and positional filters, if no known links connect
       them. First only with one pivot for each token (linear in the postings), again with other pivots as long as
       ``round_share`` of the compared pairs link; then all that are left. Where a token still has ``long_list``
       groups, sets are joined in the same way by their differences from one of them instead. So a large family of near
       copies costs a few comparisons for each member, and no link between different components is missed.
    4. Group pairs are expanded to members and verified on whole sets.

    ``docs`` must be replayable (a table scan). Null and empty texts have n_shingles 0 and link with nothing. Each row
    is a document of its own: repeated rows are copies, rows with the same id and different texts have the components
    that their own texts reach, and null ids are kept, as documents that come last. A text of any length is hashed a
    megabyte at a time. Other columns are ignored; an empty table gives an empty result.

    Shingles are 64-bit hashes, sets of equal size are equal if their 64-bit prints are (of 10^9 different sets, some
    pair is taken for equal with odds of 1 in 37), and overlaps are counted on 48 bits of the hash (two sets of 1,000
    shingles share a false one with odds of 1 in 280 million).

    Returns two tables. Documents: doc_id, n_shingles, component_id (the smallest doc_id that links reach), class_id (equal
    sets have equal ones; null for an empty set), component_size (rows), print (xxhash64 of the text) and is_first: whether
    the row has the id and the text that stand first in its component, by doc_id, nulls last, and print. Pairs of classes
    that were compared and link: class_id, other_class_id (the larger) and similarity. They connect each component; pairs
    of classes that others connect already aren't all among them.
    """
    spark = docs.sparkSession
    whole_text_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("print"))
    # A group of blocks is held whole by its task's Python worker, so the input's size sets how many there are.
    about = (docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0) // 5
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-about // part_tokens), 1)
    spread = _levelled(_spread(docs, size, parts, flush_tokens, common_docs), parts, part_tokens, by_token=True)
    returned = _levelled(spread.groupBy("part").applyInArrow(_count_and_return(parts), RETURNED), parts, part_tokens, by_token=False)
    gathered = Scratch(spark)
    every = gathered.written(returned.groupBy("part").applyInArrow(_assemble(percent), CANDIDATES), "shingle-sets")

    sets = scratch.written(_distinct_sets(scratch, every.where("tokens is not null")), "distinct-sets")
    every = written(every.select("doc_id", "print", "n", "fp"), "documents")
    gathered.drop()
    prefix = F.slice("tokens", 1, (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - F.col("uniq")).cast("int"))
    cut = sets.select("fp", "n", "uniq", prefix.alias("prefix"))
    keyed = cut.select("fp", "n", "uniq", F.xxhash64("prefix").alias("h1"), F.hash("prefix").alias("h2"))
    heads = scratch.written(keyed.groupBy("n", "uniq", "h1", "h2").agg(F.min("fp").alias("gid")), "heads")
    members = scratch.written(keyed.join(heads, ["n", "uniq", "h1", "h2"]).select("fp", "gid"), "groups")
    leaders = cut.join(members.where("fp = gid").select("fp"), "fp")
    rest = F.col("n") - F.col("uniq")
    at = leaders.select(F.col("fp").alias("gid"), "n", rest.alias("rest"), F.posexplode("prefix").alias("at", "token"))
    own, s = 1 - F.col("rest") / F.col("n"), -2 * percent * F.col("n")
    postings = at.select("token", "gid", "n", (F.col("rest") - F.col("at")).alias("left"), s.alias("s"), own.alias("own"), "at")
    postings = _first_of_alike(scratch, scratch.written(postings, "all-postings"))

    families = _Families(scratch, sets, members, percent)
    families.rounds(postings, round_share)
    possible = _possible(families, _banded(families.still_open(postings), percent))
    sizes, long = scratch.counted(possible.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= long_list).select("token"), "long-lists")
    families.compare(_across(families, possible.join(sizes, "token", "left_anti")))
    if long:
        differences = _differences(families, possible.join(sizes, "token", "left_semi"))
        families.rounds(differences, round_share)
        families.compare(_across(families, _possible(families, families.still_open(differences))))
    labels = written(families.placed.where("fp <> root").select("fp", "root"), "components")
    none = spark.createDataFrame([], "class_id long, other_class_id long, similarity double")
    pairs = written(reduce(DataFrame.unionByName, families.pairs, none).distinct(), "class-pairs")
    scratch.drop()
    return _answer(every, labels), pairs


def _answer(every: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document; the first (doc_id, print) of each component comes from map-side minima."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    keyed = every.where("n > 0").join(labels, "fp", "left").withColumn("key", F.coalesce("root", "fp"))
    # Written, so that the join below has plain shuffles on both sides, which Spark splits where one key is hot.
    least = keyed.groupBy("key").agg(F.min(place).alias("least"), F.count("*").alias("k")).where("k > 1")
    least = written(least.select("key", "least", "k"), "component-ids")
    joined = keyed.join(least, "key", "left")
    first = F.col("least").isNull() | place.eqNullSafe(F.col("least"))
    linked = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"), F.col("fp").alias("class_id"), F.coalesce("k", F.lit(1)).cast("long").alias("component_size"), "print", first.alias("is_first"))
    nothing = every.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("component_size"), "print", F.lit(True).alias("is_first"))
    return linked.unionByName(nothing)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All documents by five-word shingles and a similarity of 0.75."""
    linked = link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return linked.select("doc_id", "n_shingles", "component_id", "class_id")
