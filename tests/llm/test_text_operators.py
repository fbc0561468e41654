"""Quality, language, licenses, packing, chat, URLs, search: edge cases and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelark.llm import chat_format, language, license_scan, packing, quality, topk_search, url_filter
from tracelark.llm.words import shingle_hashes, word_hashes

ODD = [None, "", " \n\t ", "word", "é" * 5, "x" * 300_000, "a b " * 20_000, "same text", "same text", "\x00\x1c\u2028 nul"]


def docs_of(spark, texts, **more):
    rows = [(None if i == 3 else i, t, *(v[i] for v in more.values()), "clash") for i, t in enumerate(texts)]
    kinds = "".join(f"{k} string, " for k in more)
    return spark.createDataFrame(rows, f"doc_id long, text string, {kinds}score string")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_word_hashes_follow_the_definition():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "\x1c", "\u00a0", "z"]) for _ in range(rng.randrange(40)))
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        got = word_hashes(text.encode())
        assert len(got) == len(words)
        for a, b in zip(words, got, strict=True):
            assert word_hashes(a)[0] == b
        chunked = word_hashes(text.encode(), chunk=7)
        assert (chunked == got).all()
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(shingle_hashes(got)) == len(want)


def test_quality_learns_and_handles_odd_texts(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "and", "house", "river", "tree."]) + rng.choice(["", "s"]) for _ in range(60)) for _ in range(150)]
    junk = [" ".join(w.upper() + "!!" for w in g.split()) for g in good[:50]] + [" | ".join(g.split()) for g in good[50:100]]
    texts = ODD + good + junk
    docs = docs_of(spark, texts)
    labels = [(i, 1) for i in range(len(ODD), len(ODD) + 150)] + [(i, 0) for i in range(len(ODD) + 150, len(texts))]
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), labels[0]], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.score_quality(docs, marks).collect()}
    assert len(out) == len(texts)
    wrong = [i for i, q in labels if out[i]["held_out"] and out[i]["predicted"] != q]
    assert len(wrong) <= 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.values())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(empty_docs(spark), marks).count() == 0


def test_compiled_rules_equal_a_plain_reading(spark):
    rules = quality.tree_rules("Tree\n  If (feature 0 <= 2.5)\n   If (feature 2 <= 0.5)\n    Predict: 0.0\n   Else (feature 2 > 0.5)\n    Predict: 1.0\n  Else (feature 0 > 2.5)\n   Predict: 1.0\n")
    first, third = quality.STATISTICS[0], quality.STATISTICS[2]
    assert [r.bounds for r in rules] == [((first, "<=", 2.5),), ((first, "<=", 2.5), (third, "<=", 0.5)), ((first, "<=", 2.5), (third, ">", 0.5)), ((first, ">", 2.5),)]
    model = quality.RuleEnsemble(-1.0, tuple(r._replace(weight=w) for r, w in zip(rules, (0.5, 1.5, -2.0, 3.0), strict=True)))
    df = spark.createDataFrame([(1.0, 0.1), (1.0, 0.9), (9.0, 0.1)], f"{first} double, {third} double")
    got = [r[0] for r in df.select(model.score()).collect()]
    assert np.allclose(got, [1 / (1 + np.exp(-x)) for x in (1.0, -2.5, 2.0)])


def test_language(spark):
    rng = random.Random(3)
    parts = {"en": ["th", "ing", "er", "and"], "fr": ["eau", "ère", "que", "ç"], "de": ["sch", "ung", "ü", "keit"]}
    texts, langs = list(ODD), [None] * len(ODD)
    for lang, bits in parts.items():
        for _ in range(40):
            texts.append(" ".join(rng.choice(bits) + rng.choice(bits) for _ in range(12)))
            langs.append(lang)
    rows = language.identify(docs_of(spark, texts, lang=langs)).collect()
    out = {r["doc_id"]: r for r in rows}
    assert all(out[i]["lang_pred"] == langs[i] for i in range(len(ODD), len(texts)))
    assert [(out[i]["lang_pred"], out[i]["score"]) for i in (0, 1, 2)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.identify(empty_docs(spark)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs_of(spark, ODD, lang=[None] * len(ODD))).collect()} == {"und"}


def test_kernel_equals_its_definition():
    texts = ["The quick, brown fox", "jumps über den Zaun!", "fox"]
    seen = np.zeros(language.BOUNDS[-1], bool)
    found = [language.grams(t, seen) for t in texts]
    assert not seen.any()
    model = language.fit_kernel(["a", "b", "b"], found, 4, 0.1)
    k = model.kernel(found)

    def sets(t):
        s = re.sub(r"[^a-zü]+", " ", f" {t.lower()} ")
        return [{s[i : i + n] for i in range(len(s) - n + 1)} - ({" "} if n == 1 else set()) for n in (1, 2, 3)]

    order = [0, 1, 2]
    want = [[sum(len(x & y) / np.sqrt(len(x) * len(y)) for x, y in zip(sets(a), sets(texts[j]), strict=True)) / 3 for j in order] for a in texts]
    assert np.allclose(k, want, atol=1e-5)


def brute_license(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.encode().split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), words


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(4)
    filler = ["the", "license", "under", "mit", "apache", "version", "2", "cc", "by", "nc", "x", "é", "licensed"]
    texts = ODD + [" ".join(rng.choice(filler) for _ in range(rng.randrange(120))) for _ in range(150)]
    texts += ["cc by nc cc by nc", "Under THE mit-license_x", "Licensed under the GNU General Public License, version 3.", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation file"]
    notices = [t for t, _ in license_scan.TEMPLATES]
    texts += [f"intro {n} outro" for n in notices] + [" ".join(rng.sample(n.split(), len(n.split()))) for n in notices]
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = out[None if i == 3 else i]
        n, n_base, first, last, base, words = brute_license(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, n_base, first, last, base)
        want, best = set(base.split(",")) - {""}, 1.0 if base else 0.0
        for t, label in license_scan.TEMPLATES:
            listed, tokens = t.encode().split(), set(t.encode().split())
            half = 24
            while half < len(listed):
                half *= 2
            for at in range(0, max(1, len(words)), half):
                share = len(tokens & set(words[at : at + 2 * half])) / len(tokens)
                lengths = {(-1, j): 0 for j in range(-1, len(listed))}
                for i_, word in enumerate(words[at : at + 2 * half] if share >= 0.9 and len(listed) < 12 else []):
                    lengths[i_, -1] = 0
                    for j, other in enumerate(listed):
                        lengths[i_, j] = lengths[i_ - 1, j - 1] + 1 if word == other else max(lengths[i_ - 1, j], lengths[i_, j - 1])
                if share >= 0.9 and (len(listed) >= 12 or max(lengths.values()) >= 0.9 * len(listed)):
                    want.add(label)
                    best = max(best, share)
        assert r["labels"] == ",".join(sorted(want)), i
        assert r["score"] == pytest.approx(best)
    assert out[texts.index("Licensed under the GNU General Public License, version 3.")]["labels"] == "gpl-3"
    for (notice, label), at in zip(license_scan.TEMPLATES, range(len(texts) - 2 * len(notices), len(texts)), strict=False):
        assert label in out[at]["labels"].split(",")
    assert license_scan.scan_licenses(empty_docs(spark)).count() == 0


def test_packing_is_a_partition_of_all_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, "a <|endoftext|> b", "Ünïcode ’quotes’ it's\r\n  x", *(" ".join(f"w{i}" for i in range(n)) for n in (1, 200, 511, 700, 2000))]
    rows = packing.pack_documents(docs_of(spark, texts), window_tokens=20_000).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        want = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[None if i == 3 else i], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in mine]).tolist()
        assert ids == want
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)]).tolist()[:-1]
        assert {r["doc_tokens"] for r in mine} == {len(want)}
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0, *(r["length"] for r in own)]).tolist()
        assert [r["offset"] for r in own] == ends[:-1]
        assert ends[-1] <= 1024 and ends[-1] & (ends[-1] - 1) == 0  # nothing to pad
    assert packing.pack_documents(empty_docs(spark)).count() == 0


def test_long_templates_match_at_any_offset(spark):
    words = [f"t{i}" for i in range(200)]
    texts = [" ".join([f"o{i}" for i in range(at)] + words[:n] + ["end"] * 90) for at in (0, 1, 23, 24, 100, 255, 256, 257, 511, 700) for n in (200, 180, 179)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = license_scan.scan_licenses(docs, templates=[(" ".join(words), "long"), ("o3 o4 o5", "short"), ("", "none")]).collect()
    assert {r["doc_id"] for r in out if "long" in r["labels"]} == {i for i in range(len(texts)) if i % 3 < 2}
    assert {r["doc_id"] for r in out if "short" in r["labels"]} == {i for i in range(len(texts)) if i // 3 > 1}


def test_packing_balances_costs():
    rng = random.Random(5)
    pieces = packing.assign([rng.randrange(1, 1024) for _ in range(400)], 1024)
    cost = {k: sum(packing.cost(p[2], 1.0, 1 / 1024) for p in own) for k, own in groupby(sorted(pieces, key=lambda p: p[3]), key=lambda p: p[3])}
    full = [c for k, c in cost.items() if sum(p[2] for p in pieces if p[3] == k) == 1024]
    assert max(full) / min(full) < 2.5


TRAP = "\\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    nasty = [TRAP, "\\", "\\0\\1\\2", "<", "#", "</turn>\n", "### user\n", "\\<\\", "é\U0001f600", "", None, "\n\n"]
    rows = [(c, t, r, x) for c, (r1, x) in enumerate((r, x) for r in ("user", "assistant", None, "ro\nle#") for x in nasty) for t, r in ((0, r1), (1, "assistant"))]
    table = spark.createDataFrame([*rows, (5, 0, "user", "twice"), (5, 0, "user", "twice"), (None, None, None, None)], "conv_id int, turn int, role string, text string")
    out = chat_format.read_back(chat_format.render(chat_format.fold_events(chat_format.turns_as_events(table)))).collect()
    got = {r["conv_id"]: r for r in out}
    for c, own in groupby(rows, key=lambda r: r[0]):
        if c == 5:
            assert [t["text"] for t in got[5]["turns"]].count("twice") == 2
            continue
        turns = [(r or "", x or "") for _, _, r, x in own]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]


def test_chat_folds_streams(spark):
    log = [
        (1, 0, 0, "start", "user", "hi"), (1, 5, 1, "delta", None, "lo"), (1, 3, 1, "start", "assistant", "hel"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "good "), (1, 8, 1, "delta", None, "day"),
        (1, 9, 0, "edit", None, "hey"), (1, 10, 2, "start", "user", "bye"), (1, 11, 2, "retract", None, None), (1, 12, 3, "odd", "x", "y"), (2, 0, 0, "delta", None, "only"),
    ]
    events = spark.createDataFrame(log, "conv_id int, seq int, message int, kind string, role string, text string")
    out = chat_format.fold_events(events).orderBy("conv_id", "message").collect()
    assert [tuple(r) for r in out] == [(1, 0, "user", "hey"), (1, 1, "assistant", "good day"), (1, 3, "", ""), (2, 0, "", "only")]
    whole = chat_format.render(chat_format.fold_events(events).where("conv_id = 1")).first()
    span = whole["loss_spans"][0]
    assert whole["formatted"][span["start"] - 1 : span["start"] - 1 + span["length"]] == "good day"
    assert chat_format.render(chat_format.fold_events(events.limit(0))).count() == 0


def brute_url(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host and one_form(host, path) in {one_form(*x) for x in listed} else "allow"


def one_form(host, path):
    """The same page by another spelling: user, default port, dots at the end, no path, small percent codes."""
    host = re.sub(r":(80|443|)$", "", host.partition("@")[2] or host).rstrip(".")
    return host, re.sub("%[0-9a-fA-F]{2}", lambda m: m[0].upper(), path) or "/"


def test_urls_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["net.", "net:80", "me@a.net:443", "net:8080", "org", "example.org", "a.b.example.org", "EXAMPLE.org", "xexample.org", "com", "www.com", "net", "a.net", "", "org.", "é.com"]
    paths = ["/%c3%a9", "/%C3%A9", "/%zz%4", "", "/", "/es/", "/es", "/en/1", "/en/17/x", "/fr/a", "/de/", "/DE/", "/fr"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=://x', '#f', '/?a#b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://?x", "a://b://c", "http://net/" + "p" * 5000]
    pages = spark.createDataFrame([(None if i % 50 == 0 else i, u, "h") for i, u in enumerate(urls)] + [(7, urls[7], "h")], "page_id long, url string, verdict string")
    listed = {("net", "/%C3%a9"), ("net:443", "/%zz%4"), ("net", "/es/"), ("a.net", ""), ("net", "/" + "p" * 5000), ("org", "")}
    table = spark.createDataFrame([*listed, ("net", "/es/"), (None, "/")], "host string, path string")
    out = url_filter.judge_urls(pages, url_filter.RULES, table)
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in out.collect())
    want = sorted((str(r["page_id"]), *(str(x) if k == 2 else x for k, x in enumerate(brute_url(r["url"], url_filter.RULES, listed)))) for r in pages.collect())
    assert got == want
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES, table).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, [], table.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("cell_rows", [40, 100_000])
def test_top_k_equals_brute_force(spark, cell_rows):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(300)]  # many equal vectors, and ties
    odd = [(2000, None), (2001, []), (2050, []), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (None, [1.0] * 8), (2005, [0.0] * 8), (2006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd], "vec_id long, embedding array<double>, rank string")
    rows = topk_search.quantised(df)
    assert rows.count() == 1004
    queries = rows.where(F.col("vec_id") % 50 == 0)
    got = {}
    for r in topk_search.top_k(rows, queries.unionByName(queries), 10, tree_rows=150, block_rows=7, cell_rows=cell_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    table = {r["vec_id"]: np.array(r["v"]) for r in rows.collect()}
    for q, mine in got.items():
        scored = sorted((-int(table[q] @ v), i) for i, v in table.items() if i != q and len(v) == len(table[q]))[:10]
        assert sorted(mine) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert len(got) == queries.count()
    assert topk_search.top_k(rows.limit(0), queries).count() == 0
    assert topk_search.top_k(rows, queries.limit(0)).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 3
    rows = np.floor(1024 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.05)).astype(np.int64)
    tree = topk_search.MTree(np.arange(4000), rows)
    best = sorted((-int(rows[0] @ v), i) for i, v in enumerate(rows) if i)[:10]
    for least in (-np.inf, float(-best[-1][0])):
        ids, scores = tree.search(0, rows[0], 10, least)
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == best


def test_most_queries_are_not_sent_to_most_cells(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 16)) * 3
    rows = np.floor(1024 * (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.05)).astype(np.int64)
    cells = topk_search.Cells(rows[:60].tolist())
    cell, far = cells.nearest(rows.astype(np.float64))
    radius = {c: float(far[cell == c].max()) for c in np.unique(cell).tolist()}
    square = {c: float((rows[cell == c] ** 2).sum(1).max()) for c in radius}
    asked = []
    for q in range(0, 3000, 50):
        scores = rows @ rows[q]
        least = int(np.sort(np.delete(scores, q))[-10])
        asked.append((q, rows[q].tolist(), 16, int(cell[q]), least))
        there = set(cells.within(rows[q].astype(np.float64), least, radius, square).tolist())
        assert there >= set(cell[scores >= least].tolist())
    frame = spark.createDataFrame(asked, "vec_id long, v array<long>, dim int, home int, least long")
    assert topk_search._other_cells(frame, cells, radius, square).count() < 0.1 * len(asked) * len(radius)


def test_sha_of_turns_is_that_of_the_contract(spark):
    table = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id int, turn int, role string, text string")
    out = chat_format.read_back(chat_format.render(chat_format.fold_events(chat_format.turns_as_events(table)))).first()
    text = "".join(f"{t['role']}\n{t['text']}\n" for t in out["turns"])
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256(f"user\n{TRAP}\nassistant\n{TRAP}\n".encode()).hexdigest()
