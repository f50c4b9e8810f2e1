"""Knowledge bases: query string -> responses, checked when they are loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checked(kb: DataFrame) -> DataFrame:
    """(query, responses) without null responses, and without queries that have none.

    Raises ValueError if the columns or the mandatory field ``concept_id`` are missing. A query that stands
    in two rows, and a response without a concept_id, stop the job that reads them: of two rows there is no
    first one. Nothing is run here.
    """
    kinds = dict(kb.dtypes)
    field = kb.schema["responses"].dataType if "responses" in kinds else None
    if "query" not in kinds or not isinstance(field, T.ArrayType) or not isinstance(field.elementType, T.StructType) or "concept_id" not in field.elementType.names:
        raise ValueError("a knowledge base has columns query and responses, an array of structs with a field concept_id")
    rows = kb.where(F.col("query").isNotNull()).select("query", F.filter("responses", lambda r: r.isNotNull()).alias("responses")).where(F.size("responses") > 0)
    once = rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.first("responses").alias("responses"))
    fault = lambda text: F.raise_error(F.concat(F.lit("knowledge base: "), F.lit(text), F.col("query"))).cast(field)
    no_id = F.exists("responses", lambda r: r["concept_id"].isNull())
    return once.select("query", F.when(F.col("n") > 1, fault("two rows of ")).when(no_id, fault("no concept_id in a response to ")).otherwise(F.col("responses")).alias("responses"))


#: A knowledge base made on the driver is sent to all executors if it holds at most so many bytes of text.
BROADCAST_BYTES = 8 << 20


def _kind_of(values: list) -> str:
    """The type of a response's field; values of several types become text."""
    kinds = {type(v) for v in values if v is not None}
    for python, name in ((bool, "boolean"), (int, "long"), (float, "double")):
        if kinds == {python}:
            return name
    return "double" if kinds == {int, float} else "string"


def from_dict(spark: SparkSession, entries: dict[str, list[dict]], response: str | None = None) -> DataFrame:
    """A knowledge base from a dict: query -> responses; empty responses are left out.

    Responses are kept whole: their fields are those that occur, typed by their values, if ``response`` does not
    name them.
    """
    held = {q: [r for r in rs or () if r] for q, rs in entries.items()}
    for q, rs in held.items():
        if any(r.get("concept_id") is None for r in rs):
            raise ValueError(f"a response to {q!r} has no concept_id")
    fields: dict[str, list] = {"concept_id": []}
    for rs in held.values():
        for r in rs:
            for k, v in r.items():
                fields.setdefault(k, []).append(v)
    if response is None:
        kinds = {k: _kind_of(v) for k, v in fields.items()}
        response = "struct<" + ", ".join(f"`{k}`:{kind}" for k, kind in kinds.items()) + ">"
        fit = lambda k, v: v if v is None else str(v) if kinds[k] == "string" else float(v) if kinds[k] == "double" else v
    else:
        fit = lambda k, v: v
    names = T._parse_datatype_string(response).names
    rows = [(q, [tuple(fit(n, r.get(n)) for n in names) for r in rs]) for q, rs in held.items() if rs]
    kb = spark.createDataFrame(rows, f"query string, responses array<{response}>")
    size = sum(len(q.encode()) + sum(len(str(v)) for r in rs for v in r) for q, rs in rows)
    return kb.hint("broadcast") if size <= BROADCAST_BYTES else kb


def from_ngrams(texts: DataFrame, size: int, id_col: str, text_col: str = "text") -> DataFrame:
    """Every lower-cased window of at most ``size`` words of the texts, answering with the texts' ids."""
    from lexispan.operators.corpus import split_sentences
    from lexispan.operators.match import windows

    found = windows(split_sentences(texts, id_col, text_col), size, F.lower, id_col).select("query", id_col).distinct()
    return found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("concept_id")))).alias("responses"))
