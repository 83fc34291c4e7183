"""Bounded samples of labelled rows for the models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import cut

#: Rows of a label that has long texts alone.
LONG_ROWS = 20


def _drawn(rows: DataFrame, per_label: int, long_rows: int) -> tuple[DataFrame | None, dict]:
    """The ``per_label`` rows of each label that come first by a hash of the row, and all counts by label.

    ``rows`` has ``doc_id, label``, a flag ``long`` and a hash ``draw`` below 1; equal rows count once.
    Rows that are long are drawn, ``long_rows`` of them, only for a label that has no others.  A share of
    each label is taken first, so that about two times the drawn rows are put in order.
    """
    rows = rows.where("label is not null")
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("long"), 0).otherwise(1)).alias("short")).collect()  # one row for each label
    if not found:
        return None, {}
    few = []
    for r in found:
        want = per_label if r["short"] else long_rows
        few.append((r["label"], not r["short"], min(1.0, (2 * want + 100) / (r["short"] or r["n"])), want))
    few = rows.sparkSession.createDataFrame(few, f"label {rows.schema['label'].dataType.simpleString()}, long boolean, share double, want int")
    part = rows.join(F.broadcast(few), ["label", "long"]).where("draw < share").dropDuplicates(["label", "doc_id", "draw"])  # one row for each label
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "doc_id"))
    return part.withColumn("_place", place).where("_place <= want").drop("_place", "want", "share", "long", "draw"), {r["label"]: r["n"] for r in found}


def labelled_sample(docs: DataFrame, per_label: int, longest: int, labels: DataFrame | None = None, long_rows: int = LONG_ROWS) -> tuple[list[str], list, dict]:
    """(texts, labels, counts of all rows by label) of at most ``per_label`` rows of each label.

    ``docs`` has ``doc_id, text`` and, unless ``labels`` (``doc_id, label``, one row an id) is given,
    ``label``.  Rows whose text is null take no part.  Texts of over ``longest`` characters are drawn,
    ``long_rows`` at most, only for a label that has no shorter ones.  Every label that is left is
    learned.  The draw depends on ids and texts alone, not on partitioning.
    """
    uniform = lambda *c: F.pmod(F.xxhash64(*c, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.where("text is not null").withColumn("long", F.length("text") > longest)
    if labels is None:
        drawn, counts = _drawn(rows.select("doc_id", "label", "long", "text", uniform("doc_id", "text").alias("draw")), per_label, long_rows)
    else:
        own = rows.groupBy("doc_id").agg(F.min("long").alias("long"))
        ids, counts = _drawn(cut(labels.join(own, "doc_id").withColumn("draw", uniform("doc_id"))), per_label, long_rows)
        if counts:
            # at most per_label ids of each label are broadcast; of an id's texts a short one is taken
            texts = rows.join(F.broadcast(cut(ids)), "doc_id").groupBy("doc_id", "label")
            drawn = texts.agg(F.min_by("text", F.struct("long", F.xxhash64("text"))).alias("text"))
    if not counts:
        return [], [], {}
    found = drawn.select("text", "label").collect()  # at most per_label rows of each label
    found.sort(key=lambda r: (r["label"], r["text"]))
    return [r["text"] for r in found], [r["label"] for r in found], counts
