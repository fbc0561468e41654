"""Near duplicates, line dedup, decontamination and the pipeline, against brute force."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelark.llm import components, decontaminate, line_dedup, ngram_join

ODD = [None, "", " \n ", "one", "one", "Two words", "two words", "x" * 50_000, "a b c d e"]


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts, percent=75):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def families(seed, n=40):
    """Families of near copies with one to many edits, chains, a passage that all share, and plain texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))]
        if rng.random() < 0.3:
            at = rng.randrange(len(base))
            base[at:at] = passage
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            copy = list(rng.choice([base, out[-1]]))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            out.append(copy)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("seed", "round_share", "long_list"), [(1, 0.1, 8), (2, 0.0, 2), (1, 2.0, 1000)])
def test_join_equals_brute_force(spark, seed, round_share, long_list):
    """Whether many rounds with pivots come first, or one, and what counts as a long list, is only a matter of speed."""
    texts = dict(enumerate(ODD + families(seed)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, component_id string").repartition(3, "doc_id")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(docs, flush_tokens=2000, round_share=round_share, long_list=long_list, part_tokens=1500).collect()}
    assert out == brute_components(texts)


def test_join_in_levels_equals_brute_force(spark, monkeypatch):
    """Ranges that are cut in three levels, with tokens that are common in some blocks."""
    monkeypatch.setattr(ngram_join, "FAN", 3)
    texts = dict(enumerate(ODD + families(5)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    found, pairs = ngram_join.link_classes(docs, flush_tokens=900, common_docs=4, part_tokens=800)
    assert len(ngram_join._widths(-(-sum(map(len, filter(None, texts.values()))) // 4000))) >= 3
    rows = found.collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts)
    # The pairs are links, and they alone connect the classes of each component.
    text_of = {r["class_id"]: texts[r["doc_id"]] for r in rows if r["class_id"] is not None}
    linked = [(r["class_id"], r["other_class_id"], r["similarity"]) for r in pairs.collect()]
    for a, b, similarity in linked:
        x, y = shingles(text_of[a]), shingles(text_of[b])
        assert similarity == len(x & y) / len(x | y) >= 0.75
    root = {c: c for c in text_of}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b, _ in linked:
        root[find(a)] = find(b)
    by_component = {}
    for r in rows:
        if r["class_id"] is not None:
            by_component.setdefault(r["component_id"], set()).add(find(r["class_id"]))
    assert all(len(roots) == 1 for roots in by_component.values())


def test_blocks_are_as_full_at_any_number_of_ranges():
    """Rows of the block step for one gathering of documents, and for the second level behind it."""
    rng = np.random.default_rng(3)
    rows, seconds = [], []
    for parts in (1_000, 10_000, 100_000):
        widths = ngram_join._widths(parts)
        flush = ngram_join._Flush(0, parts, widths[0], 1 << 18, 256)
        while not flush.full():
            flush.add(len(flush.ids), 0, np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * 2))
        began = time.perf_counter()
        blocks = pa.Table.from_batches(list(flush.batches()))
        seconds.append(time.perf_counter() - began)
        blocks = blocks.filter(pc.is_null(blocks["n"]))
        rows.append(blocks.num_rows)
        finer = ngram_join._Regroup(parts, widths[1], 1 << 17, True)
        cut = pa.Table.from_batches(list(finer.run(blocks.filter(pc.equal(blocks["part"], 1)).to_batches()))).to_pylist()
        held = [(t, r) for b in cut for t, r in zip(ngram_join._risen(b["tokens"], 6).tolist(), ngram_join._owners(b).tolist(), strict=True)]
        for b in cut:
            assert set(ngram_join._token_part(ngram_join._risen(b["tokens"], 6), parts).tolist()) == {b["part"]}
        want = [(int(t), i) for s, i in zip(flush.sets, flush.owners, strict=True) for t in s if ngram_join._token_part(np.array([t]), parts)[0] // widths[0] == 1]
        assert sorted(held) == sorted(want)
    assert max(rows) <= ngram_join.FAN and max(seconds) < 5 * min(seconds) + 0.2, (rows, seconds)


def test_join_with_common_tokens_and_other_thresholds(spark):
    """What counts as common is only a matter of speed; here many a token does, but not in every block."""
    texts = dict(enumerate(families(3)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(docs, percent=50, flush_tokens=3000, common_docs=3, long_list=2).collect()}
    assert out == brute_components(texts, 50)


def test_join_keeps_one_posting_list_of_those_with_the_same_groups(spark, monkeypatch):
    """Near copies share long runs of tokens that no other has: of these one token's postings are enough."""
    texts, written, counts = {}, ngram_join.Scratch.written, {}
    for k in range(0, 60, 2):
        words = [f"w{k}x{i}" for i in range(200)]
        texts[k] = " ".join(words)
        texts[k + 1] = " ".join([*words, "more"])

    def noted(self, df, name):
        out = written(self, df, name)
        counts[name] = out.count() if name == "postings" else None
        return out

    monkeypatch.setattr(ngram_join.Scratch, "written", noted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(docs).collect()}
    assert out == brute_components(texts)
    assert counts["postings"] == 60


def test_first_tokens_of_alike_lists(spark):
    rows = [(1, 10, 4), (1, 11, 6), (2, 10, 3), (2, 11, 5), (3, 10, 7), (3, 12, 0), (4, 12, 1), (5, 10, 1), (5, 11, 2), (5, 12, 3)]
    scratch = ngram_join.Scratch(spark)
    out = ngram_join._first_of_alike(scratch, spark.createDataFrame(rows, "token long, gid long, at int")).collect()
    assert sorted(map(tuple, out)) == [(2, 10), (2, 11), (3, 10), (3, 12), (5, 10), (5, 11), (5, 12)]
    scratch.drop()


def test_distinct_sets_keep_the_least_row_of_each(spark):
    rows = [(fp, n, rid, 0, [fp]) for rid, (fp, n) in enumerate([(1, 5), (2, 5), (1, 5), (1, 6), (2, 5), (1, 5), (3, 5)])]
    scratch = ngram_join.Scratch(spark)
    held = spark.createDataFrame(rows, "fp long, n long, rid long, uniq long, tokens array<long>")
    out = ngram_join._distinct_sets(scratch, held).collect()
    assert sorted((r["fp"], r["n"]) for r in out) == [(1, 5), (1, 6), (2, 5), (3, 5)]
    scratch.drop()


def test_join_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (2, None), (None, None)]
    out = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["is_first"], r["component_size"]) for r in out) == [(0, False, 3), (0, True, 1), (2, True, 1), (4, True, 3), (4, True, 3)]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == sorted([(None, 3, 4), (4, 3, 4), (4, 3, 4), (2, 0, 2), (None, 0, None)], key=str)
    assert ngram_join.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_takes_each_row_as_a_document(spark):
    """Rows of one id with different texts, the greatest and least ids there are, and null ids alone."""
    a, b, c = ("a b c d e f g h", "h g f e d c b a", "x y z x y z z y")
    low = -(1 << 63)
    rows = [(3, a), (5, a), (5, b), (7, b), (low, c), (None, c), (None, "q r s t u v"), (None, "q r s t u v")]
    out = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r["doc_id"], r["component_id"], r["is_first"]) for r in out), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (low, low, True), (None, low, False), (None, None, True), (None, None, True)], key=str)


def test_join_compares_a_few_pairs_for_each_member_of_a_family(spark, monkeypatch):
    """Near copies of a text that isn't there, with 2 to 6 edits in 60 words and so hardly any links."""
    measured, compare = [], ngram_join._Families.compare

    def counted(self, pairs):
        compare(self, pairs)
        measured[-1] += self.measured

    monkeypatch.setattr(ngram_join._Families, "compare", counted)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    for n in (150, 300, 600):
        texts = {}
        for i in range(n):
            copy = list(base)
            for _ in range(rng.randint(2, 6)):
                copy[rng.randrange(60)] = f"e{rng.randrange(200)}"
            texts[i] = " ".join(copy)
        measured.append(0)
        out = ngram_join.link_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute_components(texts)
    assert measured[1] <= 3 * measured[0] and measured[2] <= 3 * measured[1] and measured[2] <= 4 * 600, measured


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 130)] + [(-5, 60), (200, 200)]
    out = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {out[i] for i in range(61)} == {-5}
    assert {out[i] for i in range(100, 130)} == {100}
    assert components.connected(spark.createDataFrame([], "a long, b long")) is None


def brute_runs(docs, size=2, min_bytes=16):
    """Without chunks or hashes: lines that aren't blank go if a run of ``size`` of them also begins at an earlier place."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs.items()):
        lines = None if text is None else text.split("\n")
        told = [i for i, x in enumerate(lines or []) if x.strip(" \t\v\f\r")]
        gone = set()
        for k in range(len(told) - size + 1):
            at = told[k : k + size]
            run = tuple(lines[i] for i in at)
            if sum(len(x.encode()) for x in run) >= min_bytes:
                if run in seen:
                    gone.update(range(at[0], at[-1] + 1))
                seen.add(run)
        out[doc_id] = None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def planted_runs(size=2):
    """Texts with runs of ``size`` to 8 lines between lines of their own, some with blank lines between."""
    rng = random.Random(8)
    passages = [[f"a line {p} {i}" for i in range(n)] for p, n in enumerate([*range(size, 9)] * 3)]
    texts = list(ODD) + ["\n\n\n", "\n".join(["the same line"] * 40), "\n".join(["a", "b"] * 20), "b\na", "a line 0 0"]
    for i in range(150):
        lines = [f"own {i} {k}" for k in range(rng.randrange(6))]
        at = rng.randrange(len(lines) + 1)
        run = list(passages[i % len(passages)])
        if rng.random() < 0.3:
            run.insert(1, rng.choice(["", "  \t"]))
        lines[at:at] = run
        texts.append("\n".join(lines))
    return passages, dict(enumerate(texts))


@pytest.mark.parametrize(("size", "min_bytes"), [(2, 16), (2, 0), (3, 16)])
def test_every_repeated_run_of_lines_goes(spark, size, min_bytes):
    passages, docs = planted_runs(size)
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in docs.items()], "doc_id long, text string, n_chars int, n_removed string").repartition(3)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(table, min_lines=size, min_bytes=min_bytes).collect()}
    want = brute_runs(docs, size, min_bytes)
    assert {i: r["text"] for i, r in out.items()} == want
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0
    for i, text in docs.items():  # every planted run but its first place is gone, whatever its length and neighbours
        if text is None:
            assert (out[i]["n_lines"], out[i]["n_removed"], out[i]["n_chars"]) == (0, 0, None)
        else:
            assert out[i]["n_lines"] == len(text.split("\n")) and out[i]["n_chars"] == len(want[i])
            assert i < len(docs) - 150 + len(passages) or "line" not in out[i]["text"]


def test_fewer_chunkings_find_a_share_of_the_runs(spark):
    """Boundaries are chosen by the rolling hash: each chunking has its own, and together they have all."""
    _, docs = planted_runs()
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    removed = [line_dedup.dedup_lines(table, divisor=4, chunkings=n).agg(F.sum("n_removed")).first()[0] for n in (1, 2, 4)]
    assert 0 < removed[0] < removed[1] < removed[2]


def test_paragraph_breaks_and_brackets_stay(spark):
    texts = ["gamma three\n\n\ndelta four", "alpha one\n\n\nbeta two", "y = 2\n}\n\nbar", "x = 1\n}\n\nfoo", "}\n}\n", "}\n}"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in line_dedup.dedup_lines(table).orderBy("doc_id").collect()] == texts


def test_line_dedup_keeps_copies_of_one_id_alike(spark):
    text = "\n".join(f"line number {i}" for i in range(12))
    rows = [(None, text), (1, text), (1, text), (2, text)]
    out = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [t for d, t in out if d is None] == [text]
    ones = [t for d, t in out if d == 1]
    assert len(out) == 4 and ones[0] == ones[1] != text


def test_line_dedup_keeps_texts_of_one_id_apart(spark):
    """A repeat in one text takes nothing from another text of the same id, or of no id."""
    rows = [(0, "a\nb"), (None, "c\nd"), (None, "e\nf"), (1, "a\nb\ng"), (1, "h\ni\nj"), (None, "a\nb")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=0).collect()
    want = [(None, "a\nb"), (None, "c\nd"), (None, "e\nf"), (0, ""), (1, "g"), (1, "h\ni\nj")]
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(want, key=str)


def test_lcs():
    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs_length(a, decontaminate.bit_masks(b)) == table[-1][-1]


def test_decontamination_finds_passages_and_paraphrases(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "st", "lm")]
    words = lambda n: [rng.choice(["the", "and", "of"]) if rng.random() < 0.3 else rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(n)]
    items = [" ".join(words(rng.randrange(14, 60))) for _ in range(30)]
    docs, planted = list(ODD), {}
    for i in range(60):
        text, item = words(rng.randrange(10, 300)), i % 30
        if i < 45:
            piece = items[item].split()
            for _ in range(len(piece) // 6 if i >= 30 else 0):  # paraphrases: one word in six is another
                piece[rng.randrange(len(piece))] = rng.choice(vocabulary)
            at = rng.randrange(len(text))
            text[at:at] = [p.upper() + "," for p in piece] if i % 2 else piece
            planted[len(docs)] = item
        docs.append(" ".join(text))
    long = words(30_000)
    long[20_000:20_000] = items[3].split()
    planted[len(docs)] = 3
    docs.append(" ".join(long))
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    for block in (10_000, 8):
        found = decontaminate.find_leaks(table, bench, block_items=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == set(planted.items())
    assert decontaminate.find_leaks(table.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(table, bench.limit(0)).count() == 0


def test_decontamination_finds_whole_items_of_a_large_benchmark(spark):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"v{int(rng.paretovariate(0.4)) % 3000}" for _ in range(n)]
    items = [words(rng.randrange(15, 56)) for _ in range(1500)]
    docs = []
    for i in range(300):
        text = words(200)
        text[100:100] = items[i]
        docs.append((i, " ".join(text)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(table, bench).collect()}
    assert {(i, i) for i in range(300)} <= found


def test_pipeline_takes_out_what_it_should(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "st", "lm") for d in ("", "a", "is")]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    items = [sentence(30) for _ in range(5)]
    good = ["\n".join(sentence(12) for _ in range(6)) for _ in range(120)]
    junk = [" ".join(w.upper() + "!!" for w in g.split()) for g in good[:60]]
    near = [good[0].replace(good[0].split()[20], "changed", 1), good[1] + " more"]
    leaks = [good[2] + "\n" + items[0], sentence(40) + " " + items[1]]
    texts = good + junk + near + leaks + [None, ""]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(i, 0, 0) for i in range(120, 180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    kept = {r[0] for r in out.select("doc_id").distinct().collect()}
    assert set(range(120)) <= kept  # clean documents stay
    assert not kept & set(range(120, 180))
    assert not kept & {182, 183}
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    """Documents with null and repeated ids, two texts of one id, repeated rows, null, empty and very long texts, and columns
    of any name; and the tables beside them."""
    rng = random.Random(31)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in ("n", "r", "st", "lm", "t", "")]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    good = ["\n".join(sentence(14) for _ in range(5)) for _ in range(80)]
    junk = [" ".join(w.upper() + "!!" for w in g.split()) for g in good[:40]]
    item = sentence(30)
    rows = [(i, t) for i, t in enumerate(good + junk)]
    rows += [(None, good[3]), (None, sentence(60)), (5, good[5]), (5, good[5]), (7, sentence(70)), (None, None), (500, None), (501, ""), (502, sentence(40) + "\n" + item), (503, " ".join([sentence(50)] * 400))]
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 9.0, "x", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, print string, predicted int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, good


STAGE_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def left(stage, spark, docs, folder):
    out = stage(spark, docs, folder)
    assert out.columns == STAGE_COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_quality_stage_with_odd_rows(spark, odd_corpus):
    folder, rows, good = odd_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = left(corpus_pipeline.quality_stage, spark, docs, folder)
    of = lambda t: [d for d, x in kept if x == t]
    assert all(i in of(t) for i, t in enumerate(good)) and of(good[5]) == [5, 5, 5] and set(of(good[3])) == {3, None}
    assert not {d for d, _ in kept} & set(range(80, 120))
    assert left(corpus_pipeline.quality_stage, spark, docs.limit(0), folder) == []


def test_line_stage_with_odd_rows(spark, odd_corpus):
    """What leaves is what the rule leaves of each text; a copy of which nothing is left goes."""
    folder, rows, good = odd_corpus
    kept = left(corpus_pipeline.line_stage, spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    # The null id comes first and keeps its lines, so row 3 loses all; rows of one id and text are one place.
    assert (None, good[3]) in kept and not any(d == 3 for d, _ in kept)
    assert [x for x in kept if x[0] == 5] == [(5, good[5])] * 3
    assert (500, None) in kept and (501, "") in kept and len([x for x in kept if x[0] == 7]) == 2
    assert len(kept) == len(rows) - 1
    assert left(corpus_pipeline.line_stage, spark, spark.read.parquet(f"{folder}/documents.parquet").limit(0), folder) == []


def test_parted_plans_its_filter_once_for_each_side(spark):
    """Named in a scalar subquery, the filter was planned again for each of its words and wherever the condition went."""
    docs = spark.createDataFrame([(k, f"text {k}", "en", "web", 6) for k in range(9)], "doc_id long, text string, lang string, source string, n_chars int")
    named = docs.where("doc_id % 3 = 0").select("doc_id", F.xxhash64("text").alias("print"))
    without, with_ = corpus_pipeline._parted(docs, named)
    assert sorted(r["doc_id"] for r in without.collect()) == [1, 2, 4, 5, 7, 8]
    assert sorted(r["doc_id"] for r in with_.collect()) == [0, 3, 6]
    plan = with_._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("bit_or(") == 8 and "subquery" not in plan.lower()


def test_near_duplicate_stage_with_odd_rows(spark, odd_corpus):
    folder, rows, good = odd_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = left(corpus_pipeline.near_duplicate_stage, spark, docs, folder)
    want = list(rows)
    want.remove((None, good[3]))  # the row with an id stays
    want.remove((5, good[5]))
    want.remove((5, good[5]))
    assert kept == sorted(want, key=str)
    assert left(corpus_pipeline.near_duplicate_stage, spark, docs.limit(0), folder) == []


def test_decontamination_and_packing_stages_with_odd_rows(spark, odd_corpus, tmp_path):
    folder, rows, _ = odd_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = left(corpus_pipeline.decontamination_stage, spark, docs, folder)
    assert kept == sorted((r for r in rows if r[0] != 502), key=str)
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert left(corpus_pipeline.decontamination_stage, spark, docs, f"file://{tmp_path}") == sorted(rows, key=str)
    pieces = corpus_pipeline.packing_stage(spark, docs, folder)
    packed = pieces.groupBy("doc_id").agg(F.count_if(F.col("start") == 0).alias("texts"), F.sum("length").alias("n"))
    got = {r["doc_id"]: r["texts"] for r in packed.collect()}
    assert got == {d: [r[0] for r in rows].count(d) for d in {r[0] for r in rows}}
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), folder).count() == 0
