"""Knowledge bases that are Python functions: sentences pass in Arrow batches, and their hits come back.

The function is asked where the sentence stands; its answers are kept for the rest of the partition, so a
query is asked once there. Texts are read and split once, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexispan.operators.match import kept_words

#: So many answers are kept; then keeping starts anew.
KEPT_ANSWERS = 1_000_000


def asked_hits(sentences: DataFrame, query_method: Callable[[str], Iterable[dict] | None], size: int = 4, pre_filter: Callable[..., Column] | None = None, response: str = "struct<concept_id:string>", id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, start, stop, responses) of the windows that ``query_method`` answers."""

    rows = sentences.select(id_col, "sent_idx", kept_words(sentences, pre_filter).alias("kept"))
    fields = T._parse_datatype_string(response).fields
    texts = {f.name for f in fields if isinstance(f.dataType, T.StringType)}
    kind = to_arrow_type(T.ArrayType(T.StructType(fields)))

    def fit(r: dict) -> dict:
        return {k: str(v) if k in texts and v is not None else v for k, v in r.items()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[str, list] = {}
        for batch in batches:
            at, starts, stops, which, found_ones, places = [], [], [], [], [], {}
            for row, kept in enumerate(batch.column("kept").to_pylist()):
                n = len(kept or ())
                for start in range(n):
                    query = ""
                    for stop in range(start + 1, min(start + size, n) + 1):
                        word = kept[stop - 1]
                        if word:
                            query = f"{query} {word}" if query else word
                        found = answers.get(query)
                        if found is None:
                            if len(answers) >= KEPT_ANSWERS:
                                answers.clear()
                            found = answers[query] = [fit(r) for r in (query_method(query) or []) if r]
                        if found:
                            place = places.get(query)
                            if place is None:
                                place = places[query] = len(found_ones)
                                found_ones.append(found)
                            at.append(row)
                            starts.append(start)
                            stops.append(stop)
                            which.append(place)
            rows_ = pa.array(at, pa.int32())
            responses = pa.array(found_ones, kind).take(pa.array(which, pa.int32()))
            columns = [batch.column(0).take(rows_), batch.column(1).take(rows_), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), responses]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = T.StructType([*rows.schema.fields[:2], T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("responses", T.ArrayType(T.StructType(fields)))])
    names = out.names
    return rows.mapInArrow(ask, out)
