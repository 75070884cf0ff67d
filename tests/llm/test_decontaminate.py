"""Benchmark decontamination against brute force, and the index against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest

from folioforge.llm import decontaminate, fmindex

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fold(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_force(docs, items, width=10):
    windows = {}
    for item, text in items:
        ws = fold(text)
        k = min(width, len(ws))
        for i in range(len(ws) - k + 1) if ws else ():
            windows.setdefault(tuple(ws[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        ws, hit, found = fold(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(ws) - k + 1):
                if own := windows.get(tuple(ws[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_index(seed):
    draw = random.Random(seed)
    texts = [[draw.randrange(1, 4 if seed % 2 else 30) for _ in range(draw.randrange(40))] for _ in range(30)]
    texts += texts[:5] + [[1] * 70, [1, 2] * 40]
    letters = sorted({x for t in texts for x in t})
    symbols = np.array([y for t in texts for y in [*(letters.index(x) + 1 for x in t), 0]])
    order = fmindex.suffix_order(symbols).tolist()
    ends = np.cumsum(symbols == 0)
    key = lambda i: [(0, int(ends[k])) if symbols[k] == 0 else (1, int(symbols[k])) for k in range(i, int(np.flatnonzero(symbols[i:] == 0)[0]) + i + 1)]
    assert order == sorted(range(len(symbols)), key=key)
    index = fmindex.FMIndex(symbols)
    phrases = []
    for _ in range(200):
        k = draw.randrange(1, 6)
        at = draw.randrange(len(symbols) - k)
        phrases.append(symbols[at : at + k].tolist() if draw.random() < 0.7 else [draw.randrange(1, len(letters) + 1) for _ in range(k)])
    flush = np.array([[0] * (6 - len(p)) + p for p in phrases])
    lo, hi = index.search(flush, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, lo.tolist(), hi.tolist()):
        want = [i for i in range(len(symbols)) if symbols[i : i + len(p)].tolist() == p] if 0 not in p else []
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def corpus(seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(["a", "B", "é", "7", "日"]) for _ in range(draw.randrange(1, 3)))
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(k, text(draw.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(40)] + [(3, text(20)), (None, text(15)), (50, None), (51, "same " * 30)]
    full = [t for _, t in items if t and len(fold(t)) > 9]
    docs = [(k, text(draw.randrange(60)) + draw.choice(["", " " + draw.choice(full), " " + draw.choice(full).upper()]) + " " + text(draw.randrange(9))) for k in range(150)]
    docs += [(900, None), (901, ""), (902, "..."), (None, full[0]), (5, full[1]), (5, full[1]), (903, "same " * 5000), (904, " ".join([full[2], text(3000), full[3]]))]
    return docs, items


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("block_words", [10**6, 300])
def test_query(spark, tmp_path, monkeypatch, block_words):
    docs, items = corpus()
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 1 << 20 if block_words > 300 else 500)  # texts are cut as well
    monkeypatch.setattr(decontaminate.decontaminate, "__kwdefaults__", decontaminate.decontaminate.__kwdefaults__ | {"block_words": block_words})
    spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, carried string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontaminate.op12_decontamination(spark, str(tmp_path))
    key = lambda r: (r[0] is None, r)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect()), key=key) == sorted(by_force(docs, items), key=key)


def test_spans_and_columns(spark):
    items = spark.createDataFrame([("q1", "one two three four five six seven eight nine ten eleven"), ("q2", "Ünï cödé")], "item_id string, text string")
    text = "🙂 é, ONE two; three four five six seven eight nine ten?! ünï cödé end"
    docs = spark.createDataFrame([(7, text, 1, 2, 3), (8, None, 1, 2, 3)], "node long, text string, spans int, carried int, state int")
    rows = {r.node: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert [text[s.start : s.end] for s in rows[7].spans] == ["ONE two; three four five six seven eight nine ten"] and rows[7]["items"] == ["q1"]
    assert rows[7].carried == 2 and rows[7].state == 3 and rows[8].spans == [] and rows[8].n_words == 0
    text = text.replace("ünï", "Ünï")  # only A-Z are folded
    rows = decontaminate.decontaminate(docs.limit(0), items)
    assert rows.count() == 0 and rows.columns == ["node", "text", "carried", "state", "n_words", "n_hit", "items", "spans"]
    none = decontaminate.decontaminate(docs, items.limit(0)).collect()
    assert {r.n_hit for r in none} == {0} and {r.n_words for r in none} == {0, 15}
    again = decontaminate.decontaminate(spark.createDataFrame([(text,)], "text string"), items).first()
    assert [text[s.start : s.end] for s in again.spans] == ["ONE two; three four five six seven eight nine ten?! Ünï cödé"] and again["items"] == ["q1", "q2"]
