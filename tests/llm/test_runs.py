"""Runs against brute force, and how many letters are compared."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from folioforge.llm import runs

ODD = [(None, "a b " * 20), (1, None), (2, ""), (3, " \n\t "), (4, "é🙂 日本 " * 12), (5, "x"), (6, "x " * 23), (7, "x " * 24), (7, "x " * 24)]


def plain_runs(w, least, times):
    """Each period, each maximal stretch; the least period of a stretch wins."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            k = i
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            if k + p - i >= max(least, times * p, 2 * p):
                found.setdefault((i, k + p), (i, k + p - i, p))
            i = max(k, i) + 1
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def strings(seed):
    draw = random.Random(seed)
    for _ in range(150):
        n, size = draw.randrange(90), draw.choice([1, 2, 2, 3, 8])
        w = [draw.randrange(1, size + 1) for _ in range(n)]
        if draw.random() < 0.6 and n:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randrange(2, 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w
    a, b = [1], [1, 2]
    while len(b) < 400:
        a, b = b, b + a
    yield b
    yield b * 3
    yield [1] * 200
    yield [1 + bin(k).count("1") % 2 for k in range(256)]
    yield ([1] * 7 + [2]) * 20 + [1] * 3 + ([1] * 7 + [2]) * 9


@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 2), (5, 3)])
def test_runs(least, times):
    for w in strings(least):
        assert runs.find_runs(w, least, times) == plain_runs(w, least, times), w


def test_lyndon_arrays():
    for w in strings(9):
        want = [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) for i in range(len(w))]
        assert runs.lyndon(w, lambda *_: None) == want, w


def test_comparisons_are_linear():
    draw, n = random.Random(4), 1 << 15
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    ruler = [1 + ((k & -k).bit_length()) for k in range(1, n)]
    block = [draw.randrange(1, 3) for _ in range(n // 8)]
    many = [[1] * n, b, b[::-1], ruler, ruler[::-1], [9 - x % 9 for x in ruler], block * 8, ([1] * 100 + [2]) * (n // 101), [2, 1] * (n // 2), [x for k in range(1, 250) for x in [1] * k + [2]], [x for k in range(250, 1, -1) for x in [1] * k + [2]], [1 + bin(k).count("1") % 2 for k in range(n)]]
    for w in many:
        top = max(w) + 1
        for v in (w, [top - x for x in w]):
            cost = []
            runs.lyndon(v, lambda *_: None, cost)
            assert cost[0] < 4 * len(v), (cost, len(v), v[:20])


def by_force(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 24, 3)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    sha = lambda x: hashlib.sha256(x).hexdigest()
    tail = (sha("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *tail)


def test_query(spark, tmp_path):
    draw = random.Random(11)
    rows = [*ODD]
    for k in range(100, 500):
        w = [draw.choice("abcdefghijklmnop") + draw.choice(["", "x"]) for _ in range(draw.randrange(200))]
        if k % 5 == 0:
            w[draw.randrange(len(w) + 1) :] = draw.choices(["a", "b", "c"], k=draw.randrange(1, 9)) * draw.randrange(3, 12)
        rows.append((k, draw.choice([" ", "  ", "\n"]).join(w)))
    rows.append((1000, " ".join(draw.choice("ab") for _ in range(3000))))
    spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], "doc_id long, text string, runs int, carried string, searched string").write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op11_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, got.collect()), key=key)
    assert got == sorted((by_force(i, t) for i, t in rows), key=key) and sum(r[1] > 0 for r in got) > 50


def test_frames(spark):
    docs = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in ODD], "node long, text string, runs int, carried string, searched string")
    got = runs.collapse_runs(docs)
    assert got.columns == ["node", "text", "carried", "searched", "n_words", "runs", "strongest", "collapsed"]
    told = {r.node: r for r in got.collect()}
    assert told[4].collapsed == "é🙂 日本" and told[4].runs == [(0, 24, 2)] and told[None].collapsed == "a b" and told[1].collapsed == "" and told[6].runs == [] and told[7].strongest == (0, 24, 1)
    assert got.count() == len(ODD) and runs.collapse_runs(docs.limit(0)).count() == 0
    long = spark.createDataFrame([("w " * 200_000 + "v",)], "text string")
    assert runs.collapse_runs(long).first().runs == [(0, 200_000, 1)]
