"""Spans that do not overlap: of each sentence the set of greatest weight. Off unless asked for.

Weighted interval scheduling: from the last start to the first, the best total from a start on is that of the next
start, or the span's weight and the best total from its stop on. Both passes are folds over the sentence's array of
spans; the first keeps the totals of the last ``width`` places only, as no span is longer. Sentences whose spans do not
overlap need neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squared_width(span: Column) -> Column:
    """Longer spans outweigh the shorter ones in their place."""
    return (span["stop"] - span["start"]) * (span["stop"] - span["start"])


def without_overlaps(spans: DataFrame, weight: Callable[[Column], Column] = squared_width, id_col: str = "doc_id") -> DataFrame:
    """The spans (id, sent_idx, start, stop, ...) that are kept, with all their columns.

    ``weight`` is a whole number of a span, at least 0. Of equal totals the one that takes the earlier span stays; of
    spans with one start, as of several matchers, the one of greatest weight counts, then the shortest, then the
    first. Spans without width are dropped. A sentence's spans meet in one row, as its words do.
    """
    kind = spans.schema
    matcher = F.col("matcher_idx") if "matcher_idx" in spans.columns else F.lit(0)
    span = F.struct(*spans.columns)
    keys = F.struct("start", (-F.col("w")).alias("w"), "stop", matcher.alias("m"))
    weighed = spans.where("stop > start").select(id_col, "sent_idx", span.alias("span"), "start", "stop", *(["matcher_idx"] if "matcher_idx" in spans.columns else []), weight(span).cast("long").alias("w"))
    order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    rows = F.collect_list(F.struct(keys.alias("key"), "span"))
    plain = not any(kind_ in kind.simpleString() for kind_ in ("map<", "variant"))  # what has an order needs no lambda
    listed = weighed.groupBy(id_col, "sent_idx").agg((F.sort_array(rows) if plain else F.array_sort(rows, order)).alias("s"), F.max(F.col("stop") - F.col("start")).alias("width"))
    first = F.filter("s", lambda x, k: (k == 0) | (F.get("s", k - 1)["key"]["start"] != x["key"]["start"]))
    # where no span reaches the next one's start, all are kept
    key = F.col("s")["key"]
    met = F.exists(F.zip_with(key["stop"], F.slice(key["start"], F.lit(2), F.size("s")), lambda a, b: a > b), lambda x: x)
    calm = F.forall(key["w"], lambda w: w <= 0) & ~F.coalesce(met, F.lit(False))
    held = listed.withColumn("calm", F.coalesce(calm, F.lit(False)))
    ready = held.select(id_col, "sent_idx", "width", "calm", F.when(F.col("calm"), F.col("s")).otherwise(first).alias("s"))

    # from the last start to the first: totals of the next starts, nearest first, and whether each span is taken
    begin = F.struct(F.array().cast("array<struct<place:int,best:bigint>>").alias("next"), F.array().cast("array<boolean>").alias("takes"))

    def back(a: Column, x: Column) -> Column:
        key = x["key"]
        behind = F.get(F.filter(a["next"], lambda p: p["place"] >= key["stop"]), 0)["best"]
        totals = F.struct((F.coalesce(behind, F.lit(0)) - key["w"]).alias("take"), F.coalesce(F.get(a["next"], 0)["best"], F.lit(0)).alias("skip"))

        def add(t: Column) -> Column:
            here = F.array(F.struct(key["start"].alias("place"), F.greatest(t["take"], t["skip"]).alias("best")))
            return F.struct(F.slice(F.concat(here, a["next"]), F.lit(1), F.col("width")).alias("next"), F.concat(F.array(t["take"] >= t["skip"]), a["takes"]).alias("takes"))

        return F.transform(F.array(totals), add)[0]

    takes = F.when(~F.col("calm"), F.aggregate(F.reverse("s"), begin, back, lambda a: a["takes"]))
    taken = ready.select(id_col, "sent_idx", "calm", F.col("s").alias("all"), F.when(~F.col("calm"), F.arrays_zip("s", takes.alias("take"))).alias("s"))

    # and forward: each taken span behind the last kept one
    none = F.struct(F.lit(0).alias("at"), F.array().cast(T.ArrayType(kind)).alias("kept"))
    keep = lambda a, x: F.when(x["take"] & (x["s"]["key"]["start"] >= a["at"]), F.struct(x["s"]["key"]["stop"].alias("at"), F.concat(a["kept"], F.array(x["s"]["span"])).alias("kept"))).otherwise(a)
    chosen = F.when(F.col("calm"), F.col("all")["span"]).otherwise(F.aggregate("s", none, keep, lambda a: a["kept"]))
    return taken.select(F.explode_outer(chosen).alias("span")).select("span.*")
