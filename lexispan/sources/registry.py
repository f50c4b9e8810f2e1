"""Knowledge bases that stay on disk: checked once, laid out for lookups, with versions.

Under ``root/NAME/v=K/`` stand ``entries`` (query, responses), in buckets by query; ``prefixes``, a trie by
levels: every beginning of a query that ends at a space, with the responses where it is a query
itself; ``filter``, Bloom filters of queries and of prefixes for knowledge bases that are too large to broadcast; and
``about``, the sizes, written last. Loading reads ``about`` only and runs no aggregate.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.sources.knowledge import BROADCAST_BYTES, checked
from lexispan.sources.shared import shared_dir

#: Bits of a Bloom filter for each prefix, its block's words of 64 bits, and the most blocks (38 MB, sent to all executors).
BITS, WORDS, BLOCKS = 16, 4, 1 << 19


@dataclass(frozen=True)
class KnowledgeBase:
    """A registered knowledge base; its frames read tables, nothing is run."""

    name: str
    version: int
    entries: DataFrame
    prefixes: DataFrame
    filter: DataFrame | None
    about: dict

    @property
    def small(self) -> bool:
        """Its prefix table may be sent to all executors: by its size in bytes, counted when it was registered."""
        return self.about["bytes"] <= BROADCAST_BYTES


def prefix_table(entries: DataFrame) -> DataFrame:
    """(prefix, more, responses): beginnings of queries that end at a space, and the queries; ``more`` where a longer
    query follows, responses of queries only. The empty prefix is always there."""
    parts = F.split("query", " ", -1)
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), " ").alias("prefix"), (k < F.size(parts)).alias("more")))
    cuts = entries.select(F.explode_outer(cut).alias("c")).select("c.prefix", "c.more", F.lit(None).cast(entries.schema["responses"].dataType).alias("responses"))
    both = cuts.unionByName(entries.select(F.col("query").alias("prefix"), F.lit(False).alias("more"), "responses"))
    nothing = entries.sparkSession.range(1).select(F.lit("").alias("prefix"), F.lit(True).alias("more"), F.lit(None).cast(entries.schema["responses"].dataType).alias("responses"))
    both = both.unionByName(nothing)
    return both.groupBy("prefix").agg(F.bool_or("more").alias("more"), F.first("responses", ignorenulls=True).alias("responses"))


def bits_hash(key: Column) -> Column:
    """Of its lowest bits, six for each word of a block tell which bit the key sets there."""
    return F.xxhash64(key, F.lit("bits"))


def _bits(h: Column) -> list[Column]:
    return [F.shiftright(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int") for k in range(WORDS)]


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_blocks(prefixes: DataFrame, blocks: int) -> DataFrame:
    """(block, p0.., q0..): blocks of a Bloom filter of the prefixes that longer queries follow (p) and of the queries (q)."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), at) for at in _bits(bits_hash(F.col("prefix")))]
    is_query = F.col("responses").isNotNull()
    marks = [F.coalesce(F.bit_or(F.when(test, x)), F.lit(0).cast("long")).alias(f"{kind}{k}") for kind, test in (("p", F.col("more")), ("q", is_query)) for k, x in enumerate(bits)]
    return prefixes.groupBy(block_of(F.col("prefix"), blocks).alias("block")).agg(*marks)


def in_filter(h: Column, kind: str, column: Callable[[str], Column]) -> Column:
    """Whether the key of a ``bits_hash`` may be in the filter; ``column`` gives the block's words by their names."""
    set_ = [F.call_function("shiftright", column(f"{kind}{k}"), b) for k, b in enumerate(_bits(h))]
    return reduce(lambda a, b: a.bitwiseAND(b), set_).bitwiseAND(F.lit(1).cast("long")) == 1


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files at a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files, names = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        names.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()


class Registry:
    """Knowledge bases under a root folder; names are not case-sensitive, registering a name again adds a version."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/knowledge").rstrip("/")

    def _name(self, name: str | None) -> str:
        if not name:
            raise ValueError("the name of a knowledge base is needed")
        if "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"{name} cannot be the name of a knowledge base")
        return name.upper()

    def versions(self, name: str | None) -> dict[int, dict]:
        """What is known of each version of a knowledge base."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self._name(name)}/v=*/about")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where):
            return {}
        rows = self.spark.read.text(where.toString()).collect()  # one line for each version
        found = [json.loads(r["value"]) for r in rows]
        return {x["version"]: x for x in sorted(found, key=lambda x: x["version"])}

    def register(self, name: str, kb: DataFrame, buckets: int | None = None, bloom: bool | None = None, fingerprint: str | None = None) -> KnowledgeBase:
        """Checks ``kb`` (query, responses) and writes its tables; a faulty one raises and gets no version.

        ``bloom``: whether to make filters; by default where the knowledge base is too large to broadcast.
        """
        name = self._name(name)
        version = max(self.versions(name), default=0) + 1
        base = f"{self.root}/{name}/v={version}"
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        about = {"name": name, "version": version, "buckets": buckets, "schema": kb.schema["responses"].dataType.simpleString() if "responses" in kb.columns else None, "blocks": 0, "fingerprint": fingerprint}
        checked(kb).repartition(buckets, "query").write.format("parquet").bucketBy(buckets, "query").sortBy("query").option("path", f"{base}/entries").mode("overwrite").saveAsTable(self._table(about))
        seen = Observation()
        size = F.octet_length("prefix") + F.coalesce(F.octet_length(F.to_json("responses")), F.lit(0))
        table = prefix_table(self._entries(about)).observe(seen, F.count(F.lit(1)).alias("prefixes"), F.count("responses").alias("queries"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))
        table.write.mode("overwrite").parquet(f"{base}/prefixes")
        about |= seen.get
        if bloom or bloom is None and about["bytes"] > BROADCAST_BYTES:
            about["blocks"] = min(BLOCKS, max(1, -(-about["prefixes"] * BITS // (64 * WORDS))))
            bloom_blocks(self._prefixes(about), about["blocks"]).write.mode("overwrite").parquet(f"{base}/filter")
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/about")
        return self._held(about)

    def ensure(self, name: str, fingerprint: str, build: Callable[[], DataFrame], **more) -> KnowledgeBase:
        """The last version, if it was made from a source of this fingerprint; else ``build()`` is registered."""
        found = self.versions(name)
        if found and found[max(found)].get("fingerprint") == fingerprint and (not more.get("bloom") or found[max(found)]["blocks"]):
            return self._held(found[max(found)])
        return self.register(name, build(), fingerprint=fingerprint, **more)

    def load(self, name: str | None, version: int | None = None) -> KnowledgeBase:
        """A version of a knowledge base, by default the last."""
        found = self.versions(name)
        if not found or version is not None and version not in found:
            raise ValueError(f"unknown knowledge base {self._name(name)}" + (f", version {version}" if version else ""))
        return self._held(found[version or max(found)])

    def _path(self, about: dict, part: str) -> str:
        return f"{self.root}/{about['name']}/v={about['version']}/{part}"

    def _table(self, about: dict) -> str:
        return "lexispan_" + hashlib.sha256(self._path(about, "entries").encode()).hexdigest()[:24]

    def _entries(self, about: dict) -> DataFrame:
        """The table of entries, declared with its buckets where this session does not know it yet."""
        table, path = self._table(about), self._path(about, "entries").replace("'", "\\'")
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} (query STRING, responses {about['schema']}) USING parquet CLUSTERED BY (query) SORTED BY (query) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def _prefixes(self, about: dict) -> DataFrame:
        kind = T._parse_datatype_string(about["schema"])
        return self.spark.read.schema(T.StructType([T.StructField("prefix", T.StringType()), T.StructField("more", T.BooleanType()), T.StructField("responses", kind)])).parquet(self._path(about, "prefixes"))

    def _held(self, about: dict) -> KnowledgeBase:
        words = ", ".join(f"{kind}{k} long" for kind in "pq" for k in range(WORDS))
        blooms = self.spark.read.schema(f"block int, {words}").parquet(self._path(about, "filter")) if about["blocks"] else None
        return KnowledgeBase(about["name"], about["version"], self._entries(about), self._prefixes(about), blooms, about)
