"""Near-duplicate operators against brute force, and on awkward tables."""

import hashlib
import random

import numpy as np
import pytest

from folioforge.llm import embeddings, simhash, substrings
from folioforge.llm.common import components

DOCS = "doc_id long, text string, fp string, k1 int, places int, n int"


def words(draw, n):
    return " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(draw.randrange(400)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], DOCS)


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(1)
    nodes = list(range(300))
    pairs = [(i, i + 1) for i in range(100, 180)] + [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
    want = {n: r for n, r in joined(pairs, nodes).items() if any(n in p for p in pairs if p[0] != p[1])}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(2)
    rows = [(i, words(draw, draw.choice([0, 1, 2, 3, 40, 200]))) for i in range(120)]
    for i in range(120, 200):
        text = rows[draw.randrange(60)][1].split()
        for _ in range(draw.randrange(4)):
            if text:
                text[draw.randrange(len(text))] = "new" + str(draw.randrange(9))
        rows.append((i, " ".join(text)))
    return [*rows, (200, None), (201, ""), (202, " \n "), (203, "One"), (203, "One"), (204, "é " * 3000)]


@pytest.mark.parametrize("group", [simhash.GROUP, 2])
def test_simhash(spark, corpus, group, monkeypatch):
    monkeypatch.setattr(simhash.links, "__kwdefaults__", simhash.links.__kwdefaults__ | {"group": group})
    got = simhash.simhash(frame(spark, corpus)).collect()
    prints = [(i, simhash.fingerprint(None if t is None else t.encode())) for i, t in corpus]
    assert sorted((r.doc_id, r.fp % (1 << 64)) for r in got) == sorted(prints)
    pairs = [(a, b) for k, (a, x) in enumerate(prints) for b, y in prints[k + 1 :] if bin(x ^ y).count("1") <= 3]
    want = joined(pairs, {i for i, _ in prints})
    assert {r.doc_id: r.component_id for r in got} == want


def test_simhash_fingerprint():
    import xxhash

    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(b"") == 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"c d e")]
    assert simhash.fingerprint(b"a\tB c\x0bd  e") == sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > 3)


def test_keep_one(spark):
    draw = random.Random(3)
    base, far = words(draw, 200), words(draw, 200)
    near = base.replace(base.split()[50], "changed", 1)
    rows = [(5, base), (3, near), (9, base), (7, far), (7, far), (None, far), (8, None)]
    kept = sorted((r.doc_id is None, r.doc_id) for r in simhash.keep_one(frame(spark, rows)).collect())
    assert kept == [(False, 3), (False, 7), (False, 8), (True, None)]
    assert simhash.keep_one(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, rows)).columns == [c.split()[0] for c in DOCS.split(", ")]


@pytest.mark.parametrize("block, crowded", [(simhash.BLOCK, simhash.CROWDED), (8, simhash.CROWDED), (8, 0)])
def test_similar(spark, monkeypatch, block, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    draw = random.Random(6)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    rows = []
    for k in range(160):  # lone pairs around the threshold
        text = words(draw, draw.choice([12, 60, 300])).split()
        rows.append(" ".join(text))
        for at in draw.sample(range(len(text)), max(1, len(text) * (1 + k % 4) // 90)):
            text[at] = f"other{draw.randrange(10**6)}"
        rows.append(" ".join(text))
    boiler = words(draw, 120)  # a template whose documents share most shingles, of which few pairs are similar
    for _ in range(30):
        tail = words(draw, 60)
        rows += [f"{boiler} {tail}"] + [f"{boiler} {tail} {words(draw, 12)}"] * (draw.randrange(2))
    rows += [f"{boiler} {words(draw, 3)}" for _ in range(30)] + ["", " "]
    sets = [shingles(t) for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, list(enumerate(rows))), block=block).collect()}
    assert got == joined(pairs, range(len(rows)))


def test_similar_new_keys(spark, monkeypatch):
    """Long documents that all share a line get few new keys, and their sets are not taken apart."""
    draw = random.Random(8)
    line = next(t for t in iter(lambda: words(draw, 12), None) if simhash.shingle_set(t.encode(), 5)[0] < 2**64 // 2000)  # one of its shingles is a key of each
    rows = []
    for _ in range(20):
        text = words(draw, 1500).split()
        rows.append(f"{line} {' '.join(text)}")
        text[draw.randrange(1500)] = "changed"
        rows.append(f"{line} {' '.join(text)}")
    seen, real = [], simhash.stash

    def stash(df):
        out = real(df)
        seen.append((out.columns, out.count(), df._jdf.queryExecution().analyzed().toString()))
        return out

    monkeypatch.setattr(simhash, "stash", stash)
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, list(enumerate(rows))), block=8).collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}
    assert any("anew" in columns for columns, _, _ in seen) and not any("explode(shingles" in plan for _, _, plan in seen)
    assert max(n for columns, n, _ in seen if "key" in columns) <= 100 * len(rows)  # whole prefixes: 300


def rows_made(spark, since, node):
    """Output rows of the plan nodes that begin so, over all executions from one on."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for e in (executions.apply(k) for k in range(executions.size())):
        if e.executionId() < since:
            continue
        nodes, values = store.planGraph(e.executionId()).allNodes(), store.executionMetrics(e.executionId()).toSeq()
        values = {p._1(): p._2() for p in (values.apply(k) for k in range(values.size()))}
        for n in (nodes.apply(k) for k in range(nodes.size())):
            if n.desc().replace("SortMerge", "").replace("BroadcastHash", "").startswith(node):
                total += sum(int(values.get(m.accumulatorId(), "0").replace(",", "")) for m in (n.metrics().apply(k) for k in range(n.metrics().size())) if m.name() == "number of output rows")
    return total


def test_similar_crowded_rows(spark):
    """Near copies by the group: rows joined on shingles grow with the keys of documents, not with all their crowded shingles, and each shingle is looked at once."""
    draw = random.Random(9)
    text, made = words(draw, 200).split(), []
    for n in (40, 80):
        rows = [" ".join([*text[:k], f"other{k}", *text[k + 1 :]]) for k in range(n)]
        store = spark._jsparkSession.sharedState().statusStore()
        since = store.executionsCount()
        since = store.executionsList().apply(since - 1).executionId() + 1 if since else 0
        got = simhash.similar(frame(spark, list(enumerate(rows))), block=8).collect()
        assert {r.component_id for r in got} == {0} and len(got) == n
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        made.append((rows_made(spark, since, "Join [key"), rows_made(spark, since, "Generate explode(keys")))
    for n, (joined_, exploded) in zip((40, 80), made):
        assert 0 < joined_ <= 80 * n and 0 < exploded <= 400 * n, made


def test_similar_one_python_step(spark, monkeypatch):
    """Looking for crowded shingles needs one Python worker a task: what is looked at again is stored before."""
    draw = random.Random(9)
    text, looks, real = words(draw, 200).split(), [], simhash.stash

    def stash(df):
        if "at" in df.columns:
            looks.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return real(df)

    monkeypatch.setattr(simhash, "stash", stash)
    sets = [simhash.shingle_set(" ".join([*text[:k], f"other{k}", *text[k + 1 :]]).encode(), 5).view(np.int64).tolist() for k in range(40)]
    hot = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    got = {r.key for r in simhash._crowded(hot, spark.createDataFrame([(sets[0][0],)], "key long"), 0.8, 8).collect()}
    assert all(sum(key in own for own in sets) > 8 for key in got) and len(got) > 20
    assert len(looks) > 2 and set(looks) == {1}


def removed(texts, width):
    split = [(t or "").split(" ") if t else [] for t in texts]
    split = [[w for w in s if w] for s in split]
    seen = {}
    for d, s in enumerate(split):
        for i in range(len(s) - width + 1):
            seen.setdefault(tuple(s[i : i + width]), []).append((d, i))
    gone = [set() for _ in split]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + width))
    return [([w for k, w in enumerate(s) if k not in g], len(g)) for s, g in zip(split, gone)]


@pytest.mark.parametrize(("width", "start"), [(35, None), (35, 18), (8, 2), (9, 4), (5, 5)])
def test_substrings(spark, width, start):
    draw = random.Random(width)
    shared = [words(draw, n) for n in (width - 1, width, width + 1, 3 * width)]
    texts = [" ".join(draw.choice([words(draw, draw.randrange(30)), draw.choice(shared)]) for _ in range(draw.randrange(6))) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", "same " * 200, words(draw, 4000)]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    got = substrings.substring_dedup(frame(spark, rows), target=width, start=start)
    assert got.columns == ["doc_id", "fp", "k1", "places", "n", "text", "n_words", "n_removed"]
    digest = lambda n, text: (n, hashlib.sha256(" ".join(text.split()).encode()).hexdigest())
    assert sorted(digest(r.n_removed, r.text) for r in got.collect()) == sorted(digest(n, " ".join(k)) for k, n in removed(texts, width))


def test_substrings_long_text(monkeypatch):
    """Texts of more words than places fit beside hashes choose the same parts as others."""
    import pyarrow as pa

    draw = random.Random(18)
    words_ = substrings.Words(pa.RecordBatch.from_pydict({"text": [words(draw, 500), "same " * 80, words(draw, 36)]}))
    starts = words_.windows(35)
    for width in (9, 18, 35):
        monkeypatch.undo()
        want, _ = substrings._chosen(words_, starts, 35, width)
        monkeypatch.setattr(substrings, "PLACES", 1)
        h = words_.hashes(words_.windows(width), width)
        got = substrings._chosen_long(h, words_.windows(width), starts, 35 - width + 1, len(words_.start))
        assert (got == want).all()


def test_substrings_worker_memory(monkeypatch):
    """A worker takes little for a full batch and keeps little afterwards, also of one long text; the hashes are those of each text alone."""
    import tracemalloc

    import pyarrow as pa

    draw = random.Random(20)
    texts = [words(draw, 1500) for _ in range(400)]
    batch = lambda own: pa.RecordBatch.from_pydict({"text": own, "k1": list(range(len(own))), "k2": [0] * len(own)})
    first = substrings._first_level(35, 9)
    monkeypatch.setattr(substrings, "_POWERS", {})
    whole = batch(texts)
    assert whole.nbytes > 3_000_000
    tracemalloc.start()
    try:
        out = [b for b in first(iter([whole]))]
        assert tracemalloc.get_traced_memory()[1] < 40_000_000
        long = " ".join(texts)
        for width in (18, 35):
            for _ in substrings._next_level(35, width // 2, width)(iter([pa.RecordBatch.from_pydict({"text": [long], "k1": [0], "k2": [0], "places": [[0, 1]], "copied": pa.array([None], pa.list_(pa.struct([("k2", pa.int64()), ("copies", pa.int64())])))})])):
                pass
        assert tracemalloc.get_traced_memory()[0] < 20_000_000
    finally:
        tracemalloc.stop()
    parts = {(r["k1"], r["pos"], r["h"]) for b in out for r in b.to_pylist()}
    assert parts == {(k, r["pos"], r["h"]) for k, t in enumerate(texts) for b in first(iter([batch([t])])) for r in b.to_pylist()}
    one, other = (substrings.Words(batch([t])) for t in (long, texts[0]))
    for which in (0, 1):
        assert (one.hashes(np.arange(900), 35, which) == other.hashes(np.arange(900), 35, which)).all()


def test_substrings_same_polynomial(spark):
    """A Thue-Morse word and its complement agree under every polynomial modulo 2 ** 64; they are different words."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    rest = " ".join(f"w{k}" for k in range(34))
    rows = list(enumerate([f"{one} {rest}", f"{one.translate(str.maketrans('ab', 'ba'))} {rest}", f"x {rest} {one}", f"y {rest} {one}"]))
    got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 35, 3: 35}


def test_substrings_copied_and_single(spark):
    """A window that one text shares only with a text that has copies, through three levels."""
    draw = random.Random(19)
    shared = words(draw, 40)
    copied = f"{words(draw, 9)} {shared} {words(draw, 9)}"
    texts = [copied, copied, f"{words(draw, 20)} {shared} {words(draw, 20)}", words(draw, 60)]
    got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {0: 58, 1: 58, 2: 40, 3: 0}


def test_substrings_empty(spark):
    assert substrings.substring_dedup(frame(spark, [])).count() == 0


def test_embeddings(spark):
    draw = np.random.default_rng(4)
    centers = draw.standard_normal((30, 16))
    rows = [centers[k % 30] + draw.standard_normal(16) * (0.05 if k % 3 else 2) for k in range(600)]
    rows = [np.asarray(r, dtype=np.float32) for r in rows] + [np.asarray(rows[0], dtype=np.float32)] * 5
    x = np.array(rows, dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    data = [(i, r.tolist(), 1) for i, r in enumerate(rows)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [], 1), (904, [1.0, None], 1), (None, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (905, [2.0, 4.0], 1)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, node int")).collect()}
    links = np.array([got[i].n_links for i in range(len(rows))])
    assert (links == near.sum(axis=1)).all()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904))
    assert got[905].n_links == 2 and got[905].component_id == 905 and not got[None].kept
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_doubles(spark):
    data = [(1, [1.0, 0.0]), (2, [1e-60, 1e-61]), (3, [1e60, 0.0]), (4, [0.0, 1e300]), (5, [1e-300, 1e-300]), (6, None), (7, [float("inf"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_embeddings_lone_pairs(spark):
    assert embeddings.passes_for(50, 0.9, 64) == embeddings.PASSES and embeddings.passes_for(3_000_000, 0.9, 64) > 70
    draw = np.random.default_rng(7)
    x, off = draw.standard_normal((2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    y = 0.902 * x + np.sqrt(1 - 0.902**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    data = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>"), window=1)
    assert got.where("vec_id >= 1000 and component_id = vec_id - 1000 and n_links = 1").count() >= 990
