"""Keyed state of arriving captures: who asks for an address, where its best answer lies, what a bundle has so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioforge.functions.urls import skip_before_fetch, resolve
from folioforge.operators.extract import raw_links
from folioforge.sources.captures import classified

#: Answers are copied to so many keys, so that bundles that ask for one popular address are told by as many tasks.
SALTS = 16
#: Rows of one frame that leaves a processor.
ROWS = 10_000

#: An address and, of one who asks, the bundle and when its main page was named (null for other references); of an answer, the file, when it came, and whether it is good.
EVENTS = "address string, salt int, bundle_id long, named long, file string, taken long, good boolean"
ANSWERED = "bundle_id long, address string, named long, file string, taken long, good boolean"
TOUCHED = "bundle_id long, main_url string, address string, file string, taken long, good boolean"


def _frames(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    names, held = [c.split()[0] for c in schema.split(", ")], []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


def _known(x) -> bool:
    return x is not None and x == x


class Addresses(StatefulProcessor):
    """For each address (and salt): its best answer and the bundles that ask for it.

    A good answer goes before a failure, then the later one, then the one whose
    file comes later by name, in whatever order they arrive. When a better one
    comes, all who ask are told; one who newly asks is told alone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.asking = handle.getMapState("asking", "bundle_id long", "named long")
        self.best = handle.getValueState("best", "good boolean, taken long, file string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.best.get()) if self.best.exists() else None
        best, new = before, set()
        for frame in rows:
            for bundle, named, file, taken, good in zip(frame["bundle_id"], frame["named"], frame["file"], frame["taken"], frame["good"]):
                if _known(file):
                    answer = (bool(good), int(taken), file)
                    best = answer if best is None or answer > best else best
                else:
                    one = (int(bundle),)
                    named = int(named) if _known(named) else None
                    if not self.asking.containsKey(one) or (named is not None and (old := self.asking.getValue(one)[0]) is None or named is not None and named > old):
                        self.asking.updateValue(one, (named,))
                        new.add(one[0])
        if best is None:
            return
        if best != before:
            self.best.update(best)
            told = ((int(k[0]), key[0], v[0], best[2], best[1], best[0]) for k, v in self.asking.iterator())
        else:
            told = ((k, key[0], self.asking.getValue((k,))[0], best[2], best[1], best[0]) for k in sorted(new))
        yield from _frames(told, ANSWERED)

    def close(self) -> None:
        pass


class Bundles(StatefulProcessor):
    """For each bundle: the answers to what it asks. When one is new or better, all it has leaves, if its main page is among it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answers = handle.getMapState("answers", "address string", "file string, taken long, good boolean")
        self.main = handle.getValueState("main", "named long, address string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        main = tuple(self.main.get()) if self.main.exists() else None
        for frame in rows:
            for address, named, file, taken, good in zip(frame["address"], frame["named"], frame["file"], frame["taken"], frame["good"]):
                self.answers.updateValue((address,), (file, int(taken), bool(good)))
                if _known(named) and (main is None or (int(named), address) > main):
                    main = (int(named), address)
        if main is not None:
            self.main.update(main)
            yield from _frames(((int(key[0]), main[1], k[0], v[0], int(v[1]), bool(v[2])) for k, v in self.answers.iterator()), TOUCHED)

    def close(self) -> None:
        pass


def events(stream: DataFrame, salts: int = SALTS) -> DataFrame:
    """What a stream of captures with their file says: answers, and which bundle asks for which addresses.

    A row with role main names a bundle's page; the bundle asks for it and for
    the links of its article that are not skipped unread. Rows without an
    address say nothing.
    """
    taken = F.coalesce(F.unix_micros("ingested"), F.lit(0)).alias("taken")
    some = stream.where("requested_url is not null")
    answers = some.select(
        F.col("requested_url").alias("address"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("bundle_id"),
        F.lit(None).cast("long").alias("named"), "file", taken, F.col("fail_reason").isNull().alias("good"),
    )
    mains = some.where("role = 'main' and bundle_id is not null")
    pages = classified(mains).where("cls.kind = 'html'").select("bundle_id", "final_url", F.explode(raw_links("article_html")).alias("a"))
    linked = pages.select("bundle_id", "final_url", resolve("final_url", "a.href").alias("address")).where("address is not null").where(~skip_before_fetch("final_url", "address"))
    own = mains.select("bundle_id", F.col("requested_url").alias("address"), taken).withColumnRenamed("taken", "named")
    asks = own.unionByName(linked.select("bundle_id", "address", F.lit(None).cast("long").alias("named")))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("file", "string"), ("taken", "long"), ("good", "boolean"))]
    return answers.unionByName(asks.select("address", F.pmod(F.xxhash64("bundle_id"), F.lit(salts)).cast("int").alias("salt"), "bundle_id", "named", *none))


def touched(stream: DataFrame, salts: int = SALTS) -> DataFrame:
    """Bundles that a batch of captures makes or changes, with all the answers each has: TOUCHED.

    Two steps of keyed state, by address and by bundle. Each batch costs its own
    rows and the state of the keys that it touches; bodies stay in their files.
    """
    told = events(stream, salts).groupBy("address", "salt").transformWithStateInPandas(Addresses(), ANSWERED, "Append", "None")
    return told.groupBy("bundle_id").transformWithStateInPandas(Bundles(), TOUCHED, "Append", "None")
