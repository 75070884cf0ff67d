"""Balanced removal by table: tags as rows, depth as a running sum. For pages too long for one row's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.chrome import FURNITURE, MOST, Element
from folioforge.storage import stored

_B = r"(?![A-Za-z0-9_])"


def _value(attrs: Column, name: str) -> Column:
    """The value of the first attribute of that name in quotes, or else bare; null if there is none."""
    start = rf"(?is)(?<![A-Za-z0-9_]){name}\s*=\s*"
    quoted, bare = rf"{start}(?:\"([^\"]*)\"|'([^']*)')", rf"{start}([^\s>]+)"
    return F.when(attrs.rlike(quoted), F.concat(F.regexp_extract(attrs, quoted, 1), F.regexp_extract(attrs, quoted, 2))).when(attrs.rlike(bare), F.regexp_extract(attrs, bare, 1))


def _fits(element: Element, attrs: Column) -> Column:
    if element.attribute is None:
        return F.lit(True)
    value = F.coalesce(_value(attrs, element.attribute), F.lit(""))
    if element.words:
        return F.arrays_overlap(F.split(F.lower(F.trim(value)), r"\s+"), F.array(*map(F.lit, sorted(element.words))))
    return (value != "") & value.rlike(f"(?i){element.pattern}")


def tags(pages: DataFrame, keys: list[str], html: str, name: str) -> DataFrame:
    """The tags of that name, one row each: keys, start and end in code points, attrs, and whether it opens or closes, as 1 or -1."""
    # anchored to the match before: without it, what follows the last tag would be read anew from each place
    pattern = rf"(?is)\G(.*?)(<(/?){name}{_B}([^>]*)>)"
    part = lambda k: F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(k))
    both = F.arrays_zip(F.transform(part(1), F.length).alias("before"), F.transform(part(2), F.length).alias("size"), part(3).alias("slash"), part(4).alias("attrs"))
    rows = pages.select(*keys, F.posexplode(both).alias("n", "t"))
    upto = F.sum(F.col("t.before") + F.col("t.size")).over(Window.partitionBy(*keys).orderBy("n"))
    return rows.select(*keys, (upto - F.col("t.size")).alias("start"), upto.alias("end"), "t.attrs", F.when(F.col("t.slash") == "", 1).otherwise(-1).alias("step"))


def cuts(pages: DataFrame, keys: list[str], html: str, elements: tuple[Element, ...] = FURNITURE) -> DataFrame:
    """The stretches that without() cuts from each page: keys, start, end. Those of a later element may hold those of an earlier one."""
    held: DataFrame | None = None
    by_place = Window.partitionBy(*keys).orderBy("start")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_place.rowsBetween(Window.unboundedPreceding, 0)
    for element in elements:
        rows = tags(pages, keys, html, element.tag)
        if held is not None:
            # tags within a cut are gone; a cut begins with a tag, which it covers as well
            gone = held.select(*keys, "start", "end", F.lit(None).cast("string").alias("attrs"), F.lit(0).alias("step"))
            first = Window.partitionBy(*keys).orderBy("start", F.abs("step")).rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.unionByName(gone).withColumn("_upto", F.max(F.when(F.col("step") == 0, F.col("end"))).over(first)).where((F.col("step") != 0) & (F.coalesce("_upto", F.lit(-1)) <= F.col("start"))).drop("_upto")
        depth = F.sum("step").over(so_far)
        level = rows.withColumn("_level", F.when(F.col("step") == 1, depth - 1).otherwise(depth))
        # an element ends with the next tag that brings the depth back to what it was before it
        same = Window.partitionBy(*keys, "_level").orderBy("start")
        closed = level.withColumn("_close", F.when((F.col("step") == 1) & (F.lead("step").over(same) == -1), F.lead("end").over(same)))
        fit = closed.withColumn("_fits", (F.col("step") == 1) & _fits(element, F.col("attrs")))
        top = fit.withColumn("_top", F.col("_fits") & (F.coalesce(F.max(F.when(F.col("_fits"), F.col("_close"))).over(before), F.lit(-1)) <= F.col("start")))
        # the first that never closes ends the cutting, as does a number of cuts
        told = top.withColumn("_broken", F.sum((F.col("_top") & F.col("_close").isNull()).cast("int")).over(so_far)).withColumn("_n", F.sum(F.col("_top").cast("int")).over(so_far))
        new = told.where(F.col("_top") & (F.col("_broken") == 0) & (F.col("_n") <= MOST)).select(*keys, "start", F.col("_close").alias("end"))
        new = stored(new)  # each element's tags are read against all cuts so far
        held = new if held is None else held.unionByName(new)
    return held


def without_by_table(pages: DataFrame, keys: list[str], html: str = "html", elements: tuple[Element, ...] = FURNITURE) -> DataFrame:
    """pages with html as chrome.without() leaves it; keys tell the pages apart.

    A page's tags are spread over rows, counted by windows; what comes back to
    it is the list of its cuts, at most MOST for each element. Null stays null.
    The cuts of each element are stored, in as many steps.
    """
    found = cuts(pages.select(*keys, html), keys, html, elements)
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("less")))).alias("_cuts"))
    joined = pages.join(listed, keys, "left")
    # what is kept ends where a cut begins that goes on beyond all before it, and goes on where that ends
    step = lambda state, cut: F.when(
        -cut["less"] > state["at"],
        F.struct((-cut["less"]).alias("at"), F.concat(state["kept"], F.array(F.struct(state["at"].alias("a"), F.greatest(cut["start"], state["at"]).alias("b")))).alias("kept")),
    ).otherwise(state)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("kept"))
    kept = F.aggregate("_cuts", start, step)
    text = F.concat(F.array_join(F.transform(kept["kept"], lambda k: F.substring(F.col(html), k["a"] + 1, k["b"] - k["a"])), ""), F.substring(F.col(html), kept["at"] + 1, F.length(html)))
    return joined.withColumn(html, F.when(F.col("_cuts").isNull(), F.col(html)).otherwise(text)).select(*pages.columns)
