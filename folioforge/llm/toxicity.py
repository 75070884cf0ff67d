"""Toxic spans by a linear-chain conditional random field; its marginals add up to document scores."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_map, stash, table, unstash

#: The model is fitted on at most so many labelled rows of each label, drawn by a hash of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000
#: And, of the rows of each label in that order, on those within so many characters, which bounds what the driver holds.
SAMPLE_CHARS = 6_000_000
#: Slots of the hashed feature weights: the size of what each task receives, whatever the corpus.
SLOTS = 1 << 18
#: Distinct words whose scores a Python worker remembers.
MEMO = 200_000
_PUNCTUATION = ".,;:!?\"'()[]{}<>#$%&*|/\\-_=+~`^@"
_BUCKETS = 4


def features(word: str) -> list[int]:
    """Slots of a word's features: itself, its first four and five letters, its last four."""
    w = word.strip(_PUNCTUATION).lower()
    crc, parts = zlib.crc32, ("w" + w, "a" + w[:4], "b" + w[:5], "z" + w[-4:])
    return [crc(p.encode("utf-8", "replace")) % SLOTS for p in parts]


class Chains:
    """Token sequences laid out by position, so that one step serves all sequences that are long enough."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        steps = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(steps), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[self.order] = np.arange(len(lengths))
        first = np.concatenate([[0], np.cumsum(lengths)])
        position = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
        #: Place of each token, in the order of the texts, in the layout by position.
        self.place = self.at[position] + np.repeat(rank, lengths) if steps else np.zeros(0, dtype=np.int64)

    def forward_backward(self, odds: np.ndarray, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal of state 1 for each token, with the forward and backward ratios; odds and results by position."""
        r, b = np.empty_like(odds), np.ones_like(odds)
        steps, at, active = len(self.active), self.at, self.active
        if steps:
            r[: at[1]] = odds[: at[1]] * start
        (a00, a01), (a10, a11) = move
        for t in range(1, steps):
            before = r[at[t - 1] : at[t - 1] + active[t]]
            r[at[t] : at[t + 1]] = odds[at[t] : at[t + 1]] * (a01 + a11 * before) / (a00 + a10 * before)
        for t in range(steps - 2, -1, -1):
            n = active[t + 1]
            x = odds[at[t + 1] : at[t + 2]] * b[at[t + 1] : at[t + 2]]
            b[at[t] : at[t] + n] = (a10 + a11 * x) / (a00 + a01 * x)
        x = r * b
        return x / (1 + x), r, b


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, dtype=np.float32))
    bias: float = -6.0
    start: float = 1.0
    move: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    #: Of the document score: intercept, then one for each summary.
    document: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0, 0, 0]))

    def odds(self, word: str) -> float:
        w = self._listed()
        a, b, c, d = features(word)
        return math.exp(min(30.0, max(-30.0, self.bias + w[a] + w[b] + w[c] + w[d])))

    def _listed(self) -> list[float]:
        """The weights as a list, which is faster to look up one by one."""
        if "_list" not in self.__dict__:
            self._list = self.weights.tolist()
        return self._list

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_list"}


def _summaries(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text: the largest marginal, the log of their sum, and their share of the words."""
    first = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros((len(lengths), 3))
    full = np.flatnonzero(lengths)
    if len(full):
        out[full, 0] = np.maximum.reduceat(marginals, first[full])
        total = np.add.reduceat(marginals, first[full])
        out[full, 1] = np.log1p(total)
        out[full, 2] = np.sqrt(total / lengths[full])
    return out


def _document_score(weights: np.ndarray, summaries: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + summaries @ weights[1:], -30, 30)))


def _tag_words(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Words that mark toxic texts: so many more toxic texts hold them (or their first five letters) that chance is out."""
    seen = (Counter(), Counter())
    for words, y in zip(texts, toxic):
        kinds = set()
        for w in set(words):
            w = w.strip(_PUNCTUATION).lower()
            if w:
                kinds.add(w)
                if len(w) > 5:
                    kinds.add(w[:5] + "*")
        seen[int(y)].update(kinds)
    rate = min(0.9, max(0.02, toxic.mean()))
    return {k for k, n in seen[1].items() if n >= 3 and n * np.log(1 / rate) - seen[0][k] * np.log(1 / (1 - rate)) - 8 * seen[0][k] * rate > 13}


def _apart(split: list[list[str]]) -> list[int]:
    """Places of the texts that share less than a third of their passages with those before them.

    A passage is eight words, taken where the first one's hash says so. Near
    copies of one text would make each of its words look like a mark.
    """
    seen: set[int] = set()
    out = []
    for i, words in enumerate(split):
        own = {zlib.crc32(" ".join(words[k : k + 8]).encode("utf-8", "replace")) for k in range(len(words) - 7) if zlib.crc32(words[k].encode("utf-8", "replace")) % 8 == 0}
        if 3 * len(own & seen) <= len(own):
            out.append(i)
        seen |= own
    return out


def fit(texts: list[str], toxic: list[int], rounds: int = 40, rate: float | None = None) -> Model:
    """Tokens of toxic texts that mark them are labelled 1, all others 0; the CRF is fitted to these labels by gradient ascent.

    rate is the share of toxic rows among all labelled ones, if the sample's differs.
    Without texts of both labels the model stays neutral: every score is the same, below 0.5.
    """
    model = Model()
    kept = {t: y for t, y in zip(texts, toxic)}  # copies count once
    words: dict[str, str] = {}  # each word is held once, however often it stands in the texts
    split = [[words.setdefault(w, w) for w in t.split()] for t in kept]
    apart = _apart(split)
    split, y = [split[i] for i in apart], np.array(list(kept.values()), dtype=bool)[apart]
    del kept, words
    if not y.any() or y.all():
        return model
    marks = _tag_words(split, y)
    types: dict[str, int] = {}
    flat = np.concatenate([np.array([types.setdefault(w, len(types)) for w in words], dtype=np.int32) for words in split])
    lengths = np.array([len(words) for words in split])
    del split
    slots = np.array([features(w) for w in types], dtype=np.int32).reshape(-1, _BUCKETS)
    marked = np.array([(w := x.strip(_PUNCTUATION).lower()) in marks or w[:5] + "*" in marks for x in types], dtype=bool)
    del marks
    labels = marked[flat] & np.repeat(y, lengths)

    # chains of at most 256 words: the fit needs no longer reach
    first = np.concatenate([[0], np.cumsum(lengths)])
    cut = np.concatenate([np.arange(a, b, 256) for a, b in zip(first, first[1:])]) if len(flat) else np.zeros(0, dtype=np.int64)
    chains = Chains(np.diff(np.concatenate([cut, [len(flat)]])))
    target = np.empty(len(flat), dtype=bool)
    target[chains.place] = labels
    kind = np.empty(len(flat), dtype=np.int32)
    kind[chains.place] = flat
    n, at, active = len(flat), chains.at, chains.active
    none = [np.zeros(0, dtype=np.int32)]
    later = np.concatenate(none + [np.arange(at[t + 1], at[t + 2], dtype=np.int32) for t in range(len(active) - 1)])
    earlier = np.concatenate(none + [np.arange(at[t], at[t] + active[t + 1], dtype=np.int32) for t in range(len(active) - 1)])
    pairs = np.array([[np.sum((target[earlier] == a) & (target[later] == c)) for c in (0, 1)] for a in (0, 1)], dtype=float)
    w, bias, move = np.zeros(SLOTS), np.log((labels.sum() + 1) / (n + 1)), np.zeros((2, 2))
    gw, gb, gm = np.full(SLOTS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        odds = np.exp(np.clip(bias + w[slots].sum(axis=1), -30, 30))[kind]
        p, r, b = chains.forward_backward(odds, 1.0, np.exp(move))
        step = target - p
        by_type = np.bincount(kind, weights=step, minlength=len(types))
        grad = np.bincount(slots.ravel(), weights=np.repeat(by_type, _BUCKETS), minlength=SLOTS) - 0.05 * w
        (m00, m01), (m10, m11) = np.exp(move)
        before, after = r[earlier], odds[later] * b[later]
        whole = m00 + m01 * after + before * (m10 + m11 * after)
        expected = np.array([[np.sum(m00 / whole), np.sum(m01 * after / whole)], [np.sum(m10 * before / whole), np.sum(m11 * before * after / whole)]])
        pull = pairs - expected - 0.05 * move
        gw += grad**2
        w += 0.7 * grad / np.sqrt(gw)
        gb += step.sum() ** 2
        bias += 0.7 * step.sum() / np.sqrt(gb)
        gm += pull**2
        move += 0.2 * pull / np.sqrt(gm)
    w[np.abs(w) < 0.02] = 0
    model.weights, model.bias, model.move = w.astype(np.float32), float(bias), np.exp(move)

    whole = Chains(lengths)
    by_type = np.exp(np.clip(bias + model.weights[slots].sum(axis=1), -30, 30)) if len(types) else np.zeros(0)
    odds = np.empty(n)
    odds[whole.place] = by_type[flat]
    p, _, _ = whole.forward_backward(odds, 1.0, model.move)
    x = np.column_stack([np.ones(len(y)), _summaries(p[whole.place], lengths)])
    beta, share = np.zeros(4), y.mean()
    rate = share if rate is None else min(max(rate, 1e-4), 1 - 1e-4)
    weight = np.where(y, rate / share, (1 - rate) / (1 - share))
    for _ in range(30):
        s = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * s * (1 - s))[:, None]).T @ x + 0.1 * np.eye(4)
        beta += np.clip(np.linalg.solve(hessian, x.T @ (weight * (y - s)) - 0.1 * beta), -4, 4)
    model.document = beta
    return model


class _Memo(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = self.model.odds(word)
        return out


def tag(model: Model, texts: list[str], memo: _Memo | None = None) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores of texts, and for each the spans (start, end, marginal) of its toxic words."""
    memo = _Memo(model) if memo is None else memo
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    total = int(lengths.sum())
    flat = np.fromiter(chain.from_iterable(map(memo.__getitem__, words) for words in split), dtype=np.float64, count=total)
    chains = Chains(lengths)
    odds = np.empty(total)
    odds[chains.place] = flat
    p = chains.forward_backward(odds, model.start, model.move)[0][chains.place] if total else flat
    first = np.concatenate([[0], np.cumsum(lengths)])
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    hot = np.flatnonzero(p >= 0.5)
    for i in np.unique(np.searchsorted(first, hot, side="right") - 1):
        at, own = 0, set(hot[(hot >= first[i]) & (hot < first[i + 1])].tolist())
        for k, word in enumerate(split[i], int(first[i])):
            at = texts[i].index(word, at)
            if k in own:
                spans[i].append((at, at + len(word), float(p[k])))
            at += len(word)
    return _document_score(model.document, _summaries(p, lengths)), spans


def _scores(model: Model, with_spans: bool, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(model)
        for batch in batches:
            scores, spans = tag(model, [t or "" for t in batch.column("text").to_pylist()], memo)
            out = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            names = ["score", "predicted"]
            if with_spans:
                out.append(pa.array([[{"start": a, "end": b, "p": p} for a, b, p in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out], names=[*columns, *names])

    return run


def held_out():
    """Whether a row takes no part in learning. A null doc_id, which no label can name, is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most sample_toxic and sample_clean labelled rows that are not held out, with their whole texts.

    They are drawn by a hash of doc_id. A text longer than a fiftieth of
    sample_chars comes after all shorter ones; the rows of a label whose texts
    end beyond sample_chars, in this order, are left out. Of several texts of
    one doc_id the one with the least hash counts, and repeated labels count
    once. Rows whose label, doc_id or text is null teach nothing; without rows
    of both labels the model is neutral.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out()).distinct()
    drawn = [usable.where(f"toxic = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, sample_toxic), (0, sample_clean))]
    ids = drawn[0].unionByName(drawn[1])  # at most sample_toxic + sample_clean rows, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    drawn = stash(texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    order = [F.length("text") > sample_chars // 50, F.xxhash64("doc_id"), F.col("doc_id")]
    within = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over the sample
    rows = drawn.withColumn("chars", F.sum(F.length("text")).over(within)).where(F.col("chars") <= sample_chars).orderBy("toxic", *order).select("text", "toxic").collect()
    unstash(drawn)
    share = usable.agg(F.avg("toxic")).first()[0]
    return fit([r.text for r in rows], [r.toxic for r in rows], rate=share)


def toxicity(docs: DataFrame, model: Model, *, spans: bool = True) -> DataFrame:
    """Score docs (doc_id, text, any others): the columns of docs except score, predicted and spans, plus these three.

    score is 0 to 1, predicted is 1 from 0.5 on, spans lists start, end
    (code points) and marginal of each word tagged toxic. Null, empty and blank
    texts have no words and get the model's score for that. Texts of any length
    are one chain. Repeated rows each get a row; an empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted", "spans")]
    docs = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    more = ", spans array<struct<start:int,end:int,p:double>>" if spans else ""
    return arrow_map(docs, _scores(model, spans, keep), f"{fields}, score double, predicted int{more}")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, and the offsets of their toxic words as start:end, joined by commas.

    Null, empty and blank texts get the score of a text without words; a null
    doc_id is not held out; repeated rows each stay; long texts count whole; no
    rows give none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    places = F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.array_join(places, ",").alias("spans"))
