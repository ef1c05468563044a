import itertools
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from locuspark.llm import packing as P
from locuspark.llm.queries import tokenizer_folder

TEXTS = ["", None, "a  b", "  x\n\n y\t\tz  ", "don't we'll 'tis", "ab12 ３４ 日本語 text…", "x <|endoftext|> y", "😀 hi", "a\r\n\r\n b", " ", "é ́ ²½ Ⅷ", "\x1c\x1d a \x1f b\x85c", "​ x﻿ z", "One. Two! Three? Four.\n" * 40, "word " * 3000, "y" * 5000]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.join(tokenizer_folder(), "byte_bpe_50k.json"))


def test_ids_equal_the_library(reference):
    texts = [t or "" for t in TEXTS]
    got = P.Tokens(tokenizer_folder())(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == reference.encode(t, add_special_tokens=False).ids


def cost(cuts, points, pen, size):
    at, total = 0, 0.0
    for c in cuts:
        total += P.padding(c - at, size) + pen[points.index(c)]
        at = c
    return total


def test_cuts_are_the_cheapest():
    rng = random.Random(6)
    for _ in range(60):
        size = 16
        points = sorted(rng.sample(range(1, 40), 9))
        points = [p for p, q in zip(points, [0, *points], strict=False) if p - q <= size] if all(b - a <= size for a, b in zip([0, *points], points, strict=False)) else None
        if not points:
            continue
        pen = [float(rng.choice([0, 2, 24])) for _ in points]
        got = P.best_cuts(np.array(points), np.array(pen), size)
        best = None
        for n in range(len(points)):
            for some in itertools.combinations(points[:-1], n):
                cuts = [*some, points[-1]]
                if all(b - a <= size for a, b in zip([0, *cuts], cuts, strict=False)):
                    c = cost(cuts, points, pen, size)
                    best = c if best is None else min(best, c)
        assert got[-1] == points[-1] and abs(cost(got, points, pen, size) - best) < 1e-9


def test_round_trip(spark, reference, monkeypatch):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").coalesce(2)
    got = P.pack(df, tokenizer_folder()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and r["length"] == len(r["ids"])
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t, _ in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        n = 2 if i == 3 else 1
        assert all(r["doc_tokens"] == len(ids) for r in by_doc[i])
        spans = sorted((r["start"], r["length"]) for r in by_doc[i])
        covered = sorted(p for s, k in spans for p in range(s, s + k))
        assert covered == sorted(list(range(len(ids))) * n)
        assert all(r["ids"] == ids[r["start"] : r["start"] + r["length"]] for r in by_doc[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= P.SIZE


def test_blocks_do_not_matter_for_the_tokens(spark, monkeypatch):
    df = spark.createDataFrame([(i, "Some words here. " * (20 + 7 * i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    whole = P.pack(df, tokenizer_folder()).groupBy("doc_id").sum("length").collect()
    assert len(whole) == 40
    assert P.pack(df.limit(0), tokenizer_folder()).count() == 0
