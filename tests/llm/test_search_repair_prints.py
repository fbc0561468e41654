"""Ranked search, conversation repair and fingerprints, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelark.llm import conversation_repair as repair
from tracelark.llm import fingerprints, ranked_search

ODD = [None, "", " \n ", "?!", "one", "one", "One, two-ONE", "é1É", "x" * 30_000, "one " * 20_000]


def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_ranking(docs, items, k=10):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    dfs = Counter(t for _, c, _ in counts for t in c)
    out = set()
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    for item, terms in wanted.items():
        scores = []
        for d, c, size in counts:
            m = 10 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * dfs[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out |= {(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])}
    return out


def ranked_rows(df):
    return {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()}


@pytest.mark.parametrize(("shard_terms", "short_share", "wave_terms"), [(1 << 19, 16, 1 << 18), (3000, 4, 60), (500, 10**6, 20), (3000, 0, 1 << 18)])
def test_ranking_equals_brute_force(spark, tmp_path, shard_terms, short_share, wave_terms):
    """Whatever the shards and waves hold, and whether all lists are summed first, some or none."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = list(ODD) + [rng.choice([" ", ". ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60))) for _ in range(400)]
    texts += [texts[50]] * 30
    docs = [(None if i % 97 == 0 else i // 2, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 12)))) for i in range(25)] + [(1, "w3 extra"), (None, "w1 w2"), (90, None), (91, "nowhere"), (92, "ONE x")]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    path = f"file://{tmp_path}/index"
    ranked_search.build_index(table, shard_terms).write.parquet(path)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_rows(ranked_search.ranked(spark.read.parquet(path), asked, short_share=short_share, wave_terms=wave_terms))
    assert got == brute_ranking(docs, items)


def test_stored_index_is_written_and_read_row_by_row(spark, tmp_path, monkeypatch):
    """However many shards a task's documents give, a row group holds one, or tasks hold all of theirs at once."""
    seen, build, rank = [], ranked_search.build_index, ranked_search.ranked
    monkeypatch.setattr(ranked_search, "build_index", lambda docs: build(docs, 100))
    monkeypatch.setattr(ranked_search, "ranked", lambda index, items: seen.append(index) or rank(index, items))
    docs = [(i, f"alpha w{i % 7} " * 20) for i in range(200)]
    items = [(1, "alpha w3"), (2, "w5")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = ranked_rows(ranked_search.op11_ranked_search(spark, f"file://{tmp_path}"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_ranking(docs, items)
    footers = [pq.ParquetFile(re.sub("^file:/+", "/", f)).metadata for f in seen[0].inputFiles()]
    assert max(m.num_rows for m in footers) > 10
    groups = [m.row_group(g) for m in footers for g in range(m.num_row_groups)]
    assert all(g.num_rows == 1 for g in groups)
    assert not any(g.column(c).is_stats_set for g in groups for c in range(g.num_columns))  # a task keeps them until it closes the file


def test_ranking_of_empty_tables(spark, tmp_path):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    ranked_search.build_index(none).write.parquet(f"file://{tmp_path}/index")
    assert ranked_rows(ranked_search.ranked(spark.read.parquet(f"file://{tmp_path}/index"), items)) == set()
    assert ranked_rows(ranked_search.ranked(ranked_search.build_index(items.withColumnRenamed("item_id", "doc_id")), items.limit(0))) == set()


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 64)
    rng = random.Random(1)
    texts = [" ".join("ab" * rng.randrange(1, 30) for _ in range(rng.randrange(40))) for _ in range(30)] + ["x" * 500, "", "é" * 100 + " b"]
    shard = ranked_search.Shard()
    shard.add(list(range(len(texts))), pa.array(texts))
    row = {k: v[0] for k, v in shard.row().to_pydict().items()}
    docs, tfs = (np.frombuffer(row[c], "<u4") for c in ("docs", "tfs"))
    ends = np.cumsum(row["dfs"])
    got = {(row["ids"][d], t): int(n) for t, df, end in zip(row["terms"], row["dfs"], ends, strict=True) for d, n in zip(docs[end - df : end], tfs[end - df : end], strict=True)}
    assert got == {(i, t): n for i, x in enumerate(texts) for t, n in Counter(terms_of(x)).items()}


def test_pages_below_the_bound_are_skipped(monkeypatch):
    """After a few strong documents, most of the long lists' pages are never scored."""
    monkeypatch.setattr(ranked_search, "PAGE", 16)
    shard = ranked_search.Shard()
    texts = ["rare common"] * 12 + ["common " + "pad " * 30] * 2000
    shard.add(list(range(len(texts))), pa.array(texts))
    row = shard.row()
    lists = ranked_search.Lists({c: row[c][0].values if c in ("lengths", "terms", "dfs", "pages") else row[c][0].as_py() for c in row.schema.names}, len(texts), int(row["n_terms"][0].as_py()), pa.array(["rare", "common"]))
    scored = []
    monkeypatch.setattr(ranked_search.Lists, "scored", lambda self, a, b, w, f=ranked_search.Lists.scored: scored.append(b - a) or f(self, a, b, w))
    best = ranked_search.Best(10)
    lists.search(np.array([0, 1]), np.array([5000, 10]), best, 16)
    assert best.ids.tolist() == list(range(10)) and sum(scored) < 100


def brute_repair(rows):
    """Every way of editing, by recursion; of the cheapest the ASCII-least."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        said = text.strip(repair.SPACE)
        kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    accepts = re.compile(r"(s?(ua)+)?")

    @lru_cache(None)
    def best(i, state, added):
        """From turn i on, with what stands there so far told by its last initial ('' at first)."""
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            ways.append((lambda c, a, t: (c + 2, "D" + a, t))(*best(i + 1, state, 0)))
            _, role, text = rows[i]
            if kinds[i] in ("", "truncated"):
                stay = 5 * (kinds[i] == "truncated")
                for edit, to, cost in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    if follows(state, to[:1]):
                        c, a, t = best(i + 1, to[:1], 0)
                        ways.append((c + cost + stay, edit + a, (f"{to}:{text}", *t)))
        for to in ("user", "assistant"):
            if added < 3 and follows(state, to[0]):
                c, a, t = best(i, to[0], added + 1)
                ways.append((c + 5, "I" + a, (f"{to}:", *t)))
        return min(ways, default=(10**9, "", ()))

    def follows(state, initial):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[state].find(initial) >= 0 and initial != ""

    cost, audit, turns = best(0, "", 0)
    assert accepts.fullmatch("".join(t[:1] for t in turns))
    numbers = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    counts = tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


@pytest.mark.parametrize("settings", [{}, {"block_rows": 2, "often": 2}, {"block_rows": 1}])
def test_repair_equals_every_way_of_editing(spark, settings):
    rng, data, talks = random.Random(5), [], {}
    for talk in range(120):
        talks[talk] = []
        for _ in range(rng.randrange(0, 11)):
            turn = (rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", "usher"]), rng.choice(["Hi.", "ok", "  ", "", "done! ", "what?", "A b", "x.\n"]))
            talks[talk] += [turn] * rng.choice([1, 1, 1, 1, 2, 3])
        data += [(talk or None, *r, 7) for r in talks[talk]]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, cost int").repartition(5)
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r["conv_id"] or 0: tuple(r[c] for c in fields) for r in repair.report(repair.repair(table, **settings)).collect()}
    assert got == {talk: brute_repair(rows) for talk, rows in talks.items() if rows}


def test_repair_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.report(repair.repair(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, None, None), (1, None, "user", "x" * 200_000 + "."), (2, 1, "user", "a."), (2, 1, "user", "a.")]
    got = {r["conv_id"]: (r["blank"], r["duplicate"], r["audit"], r["gaps"]) for r in repair.report(repair.repair(spark.createDataFrame(rows, schema), block_bytes=1000)).collect()}
    assert got == {1: (1, 0, "DD", 0), 2: (0, 1, "DD", 0)}


def test_walks_keep_vectors_at_roots_only(monkeypatch):
    """A long block: the same edits with and without checkpoints, and at most two roots' worth of vectors at once."""
    rng = random.Random(9)
    n = 4000
    codes, runs = bytes(rng.choice([0, 1, 2, 3, 5, 6, 8]) for _ in range(n)), [1] * n
    (audit, state), = repair.tight_edits(codes, runs, list(repair.AT_END))
    vectors = [list(repair.AT_END)]
    for i in range(n - 1, -1, -1):
        vectors.append(repair._before(vectors[-1], codes[i], runs[i]))
    plain = []
    end = repair._walk(codes, runs, 0, n, vectors, repair.NOTHING, plain)
    assert "".join(plain) == audit[: len("".join(plain))] and state in (repair.NOTHING, repair.ASSISTANT)
    assert set(audit[len("".join(plain)) :]) <= {"I"} and end in range(4)
    costs = repair.block_costs(codes, runs)
    assert min(costs[b] + repair.AT_END[b] for b in range(4)) == vectors[-1][repair.NOTHING]


def little(value, size=8):
    return value.to_bytes(size, "little")


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    hashes += [xxhash.xxh64_intdigest(little(b), seed=xxhash.xxh64_intdigest(little(a), seed=42)) for a, b in zip(hashes, hashes[1:])]
    whole = [h << 64 | xxhash.xxh64_intdigest(little(1, 4), seed=xxhash.xxh64_intdigest(little(h), seed=42)) for h in hashes]
    return f"{sum(1 << k for k in range(128) if 2 * sum(h >> k & 1 for h in whole) > len(whole)):032x}"


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünïcode", "日本語", "🙂🙂"]
    texts = [None, "", " \n", "one", "One", "x" * 20_000] + [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 80))) for _ in range(50)]
    for _ in range(20):  # near copies
        words = rng.choice(texts[6:56]).split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    docs = [(i * 3 if i else None, t) for i, t in enumerate(texts)] + [(9, "another text of nine"), (12, texts[4]), (12, texts[4])]
    table = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, n_chars int").repartition(4)
    got = {(r["doc_id"], r["fingerprint"], r["n_chars"]): r for r in fingerprints.edited_fingerprints(table, radius=6).collect()}
    order = sorted({(d is None, -(d or 0), ((xxhash.xxh64_intdigest((t or "").encode(), seed=42) + (1 << 63)) % (1 << 64)), t or "", d) for d, t in docs})
    assert len(got) == len(order)
    prints = [brute_print(x[3]) for x in order]
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for i, (_, _, _, text, doc_id) in enumerate(order):
        j, half = (i + 1) % len(order), len(text) // 2
        edited = text[: len(text) - half] + order[j][3][:half]
        r = got[doc_id, prints[i], len(text)]
        assert (r["edited_sha256"], r["edited_fingerprint"]) == (hashlib.sha256(edited.encode()).hexdigest(), brute_print(edited))
        assert (r["near_edited"], r["near_next"]) == (1 - far(prints[i], brute_print(edited)) / 128, 1 - far(prints[i], prints[j]) / 128)
        assert r["documents"] == prints.count(prints[i]) and r["links"] == sum(0 < far(prints[i], p) <= 6 for p in prints)
    assert fingerprints.edited_fingerprints(table.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "blocks"), [(0, 1), (3, 4), (3, 6), (7, 8)])
def test_all_pairs_within_the_radius_are_found(spark, monkeypatch, radius, blocks):
    monkeypatch.setattr(fingerprints, "blocks_wanted", lambda *_: blocks)
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(30)]
    for _ in range(150):
        prints.append(rng.choice(prints) ^ sum(1 << rng.randrange(128) for _ in range(rng.randrange(3))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p >> 64), signed(p & ((1 << 64) - 1))) for p in prints]
    found = fingerprints.within_radius(spark.createDataFrame(rows + rows[:5], "high long, low long"), radius).collect()
    got = [(r["high"], r["low"], r["other_high"], r["other_low"], r["distance"]) for r in found]
    distinct = sorted(set(rows))
    bits = lambda a, b: bin((a[0] ^ b[0]) & ((1 << 64) - 1)).count("1") + bin((a[1] ^ b[1]) & ((1 << 64) - 1)).count("1")
    assert sorted(got) == [(*a, *b, bits(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if bits(a, b) <= radius]


def test_edits_keep_fingerprints_near(spark):
    """Of texts with half replaced, nearly all are nearer to themselves than to the next text."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(2000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=120))) for i in range(200)]
    out = fingerprints.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    assert out.where("near_edited > near_next").count() >= 190
    assert out.agg(F.avg("near_edited")).first()[0] > 0.62
