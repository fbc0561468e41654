"""License scans: an exact containment join of text blocks with license templates, beside literal phrase places."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelark.llm.batches import whole_text_batches

#: The phrases whose places are counted, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Opening words of public license texts and notices, then whole notices.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "zlib",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        "bsl-1",
    ),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl-3"),
    ("to the extent possible under law the author s has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "cc0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<start:long,template:int,containment:double>>"
#: Letters A-Z become small; every other byte of a delimiter becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame, tokens: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each of the templates' tokens occurs, over all of ``docs``; as long as the templates are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column(1):
                for token in tokens.intersection(words_of(text.as_py())):
                    seen[token] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    counted = _texts(docs).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in counted.collect()}


#: Templates of fewer words must stand in their own order too: a few common words in any order say little.
ORDERED_BELOW = 12


def in_order(template: list[bytes], block: list[bytes]) -> int:
    """How many words of ``template`` stand in ``block`` in its order: their longest common subsequence."""
    row = [0] * (len(template) + 1)
    for word in block:
        before = 0
        for j, other in enumerate(template, 1):
            before, row[j] = row[j], before + 1 if word == other else max(row[j], row[j - 1])
    return row[-1]


class TemplateIndex:
    """Templates as token sets in global order (rarest first), reachable by the tokens of their prefixes.

    They are met in blocks of twice ``half`` words, each ``half`` words after the last, so that a span of ``half`` words
    lies whole in some block; no template may be longer.
    """

    def __init__(self, templates: Sequence[tuple[str, str]], counts: dict[bytes, int], threshold: float, half: int):
        self.half = half
        self.rank = {t: (counts.get(t, 0), t) for text, _ in templates for t in words_of(text)}
        self.sets, self.need, self.by_token = [], [], defaultdict(list)
        self.words = [words_of(text) for text, _ in templates]
        self.threshold = threshold
        for k, (text, _) in enumerate(templates):
            ordered = sorted(set(words_of(text)), key=self.rank.__getitem__)
            need = math.ceil(threshold * len(ordered) - 1e-9)
            self.sets.append(frozenset(ordered))
            self.need.append(need)
            for position, token in enumerate(ordered[: len(ordered) - need + 1]):
                self.by_token[token].append((k, position))
        self.prefix = frozenset(self.by_token)

    def candidates(self, block: set[bytes]) -> set[int]:
        """Templates that share a prefix token with ``block`` and that length and position leave possible."""
        found = set()
        shared = sorted(block.intersection(self.rank), key=self.rank.__getitem__)
        for at, token in enumerate(shared):
            for k, position in self.by_token.get(token, ()):
                # From here on, neither side can share more than what follows; earlier tokens were met before.
                most = min(len(self.sets[k]) - position, len(shared) - at)
                if k not in found and len(shared) >= self.need[k] and most + min(position, at) >= self.need[k]:
                    found.add(k)
        return found


    def holds(self, k: int, words: list[bytes]) -> bool:
        """Whether a block that contains enough of a template's words has them in its order, where it is short."""
        own = self.words[k]
        return len(own) >= ORDERED_BELOW or in_order(own, [w for w in words if w in self.sets[k]]) >= math.ceil(self.threshold * len(own) - 1e-9)


def scan_licenses(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.9,
    half_words: int = 24,
) -> DataFrame:
    """Scan every whole text of ``docs`` (doc_id, text) for phrases and for license templates.

    Phrases: all places where the words stand consecutively. Templates: a text is read as overlapping blocks, each half a
    block after the last, and a block matches a template if it contains ``threshold`` of the template's distinct words;
    templates of fewer than ``ORDERED_BELOW`` words must also stand in their own order, as a subsequence of that share.
    Half a block has ``half_words`` words, doubled for longer templates until they fit, so a text block of a template's
    length is in some block wherever it stands; templates without words match nothing. The join is exact: tokens are in one global order by how many
    documents hold them, so a matching block must hold a token of the template's prefix; only blocks around such
    tokens are looked at, length and positional bounds come next, and the rest is verified on the sets. Templates
    are a parameter of a few dozen lines, so they go to the tasks whole, and a document never leaves its task.

    Score is 1.0 with a base label, else the highest containment that reached the threshold, else 0.0. A null or
    empty text has no words, no places and no labels (empty strings). A text of any length is split into words in one row. Repeated rows are scanned once each, null
    ids stay null, an empty table gives an empty result and other columns are ignored.

    Returns the columns of SCHEMA; ``blocks`` lists each matching block's first word, template and containment.
    """
    whole_text_batches(docs.sparkSession)
    every = frozenset(t for text, _ in templates for t in words_of(text))
    counts, by_half = token_counts(docs, every), defaultdict(list)
    for k, (text, _) in enumerate(templates):
        if size := len(words_of(text)):
            by_half[half_words << max(0, math.ceil(math.log2(size / half_words)))].append(k)
    indexes = [(keys, TemplateIndex([templates[k] for k in keys], counts, threshold, half)) for half, keys in sorted(by_half.items())]
    wanted = [(b" " + b" ".join(words_of(text)) + b" ", label) for text, label in phrases]
    names = [label for _, label in templates]

    def scan(text: str | None) -> tuple:
        words = words_of(text)
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in wanted:
            at, last, word = line.find(phrase), 0, 0
            while at >= 0:
                word, last = word + line.count(b" ", last, at), at
                places.append(word)
                base.add(label)
                at = line.find(phrase, at + 1)
        blocks = []
        for keys, index in indexes:
            if index.prefix.isdisjoint(words):
                continue
            half = index.half
            near = {b for i, w in enumerate(words) if w in index.prefix for b in (i // half - 1, i // half) if b >= 0}
            for b in sorted(near):
                block = set(words[b * half : b * half + 2 * half])
                for k in sorted(index.candidates(block)):
                    both = len(index.sets[k] & block)
                    if both >= index.need[k] and index.holds(k, words[b * half : b * half + 2 * half]):
                        blocks.append({"start": b * half, "template": keys[k], "containment": both / len(index.sets[k])})
        labels = base | {names[x["template"]] for x in blocks}
        score = 1.0 if base else max((x["containment"] for x in blocks), default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("template", pa.int32()), ("containment", pa.float64())]))]
    fields = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *fields])

    return _texts(docs).mapInArrow(run, SCHEMA)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, by the base phrases and by all templates."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("blocks")
