"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from folioforge.llm import variants


def plain_distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def told(counts, least=3):
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in counts if plain_distance_one(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return counts


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_one_edit():
    draw = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randrange(6))) for _ in "ab")
        assert variants.one_edit(a, b) == plain_distance_one(a, b), (a, b)


@pytest.mark.parametrize("seed", range(4))
def test_scan(seed):
    """All near pairs of dense words, long ones among them, each once."""
    draw = random.Random(seed)
    words = sorted({"".join(draw.choice("abé" if seed % 2 else "abcde") for _ in range(draw.randrange(4, 9))) for _ in range(400)} | {"x" * k for k in range(30, 50)} | {"y" * 45 + c + "z" * 45 for c in ("", "a", "b", "ab")})
    both = [(k, side) for k in range(len(words)) for side in (0, 1)]
    got = [(int(a), int(b)) for x, y in variants._scan(words, both, both) for a, b in zip(x, y)]
    want = [(a, b) for a in range(len(words)) for b in range(len(words)) if plain_distance_one(words[a], words[b])]
    assert sorted(got) == want


def corpus():
    draw = random.Random(2)
    base = ["".join(draw.choice("abcdeéÀ÷") for _ in range(draw.randrange(5, 9))) for _ in range(60)]
    docs = []
    for k in range(400):
        words = []
        for _ in range(draw.randrange(60)):
            w = list(draw.choice(base[: 1 + int(60 * draw.random() ** 2)]))
            if draw.random() < 0.3:
                w[draw.randrange(len(w))] = draw.choice(["", "a", "b", "É", "Z"])
            words.append("".join(w))
        docs.append((k, draw.choice([" ", "-", "1", "\n", "ā"]).join(words)))
    return docs + [(None, "abcdef abcdef abcdeg " * 9), (7, None), (8, ""), (9, "9 ?"), (10, "q" * 50_000), (10, "q" * 50_000), (11, "q" * 50_000), (12, ("q" * 49_999 + " ") * 9), (13, "mmmmmm " * 40 + "mmmmmn " * 16 + "mmmmnn " * 5)]


def test_query(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = variants.op13_variants(spark, str(tmp_path))
    want = told(plain_counts(docs))
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == want
    assert len(want) > 300 and max(sum(a[0] == b[2] for b in want) for a in want) > 10 and any(r[2] != r[1] and r[1] for r in want)


@pytest.mark.parametrize("shard", [10, 100])
def test_hot_buckets(spark, shard):
    """Words that share their outer letters, over many parts."""
    draw = random.Random(3)
    counts = Counter({"ab" + "".join(draw.choice("xyz") for _ in range(draw.randrange(1, 6))) + "cd": draw.randrange(1, 40) for _ in range(300)})
    rows = [(w, n, 1) for w, n in counts.items()] + [("abxcd", 5, 1), (None, 9, 1)]
    counts["abxcd"] += 5
    got = variants.variants(spark.createDataFrame(rows, "word string, n long, root int"), shard=shard)
    assert sorted(map(tuple, got.collect())) == told(counts)


def test_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    for frame in (docs, docs.limit(0)):
        got = variants.variants(variants.count_words(frame))
        assert got.columns == COLUMNS and got.count() == 0
