"""Operator 1: Merkle fixity audit of two replicas of a WARC collection.

Leaves are SHA-256 digests of records; a node of the lowest level covers one range of an archive's
offsets, a node above it covers ``fanout`` neighbours. Trees are built level by level for both
replicas; then roots are compared, and only the children of nodes that differ are looked at, down to
the records of the ranges that differ.

Nodes are keyed by ranges of offsets, not by ordinals, so no archive has to be numbered by one task,
and each group has at most ``fanout`` members or one range's records, however large an archive is.

Defined cases: a null payload counts as empty; rows without archive or offset have no place in a tree
and are left out; records at one place are compared as a multiset; columns other than the three named
are not read; an empty replica leaves every record of the other one missing or extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import Scratch, require

NODE = ("archive", "node")


def warc_record(kind: str, uri: Column, record_id: Column, body: Column) -> Column:
    """The bytes of one WARC record, as a string."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:record:"), record_id.cast("string"), F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def record_digests(df: DataFrame, archive: str, offset: str, payload: str) -> DataFrame:
    """(archive, offset, length, sha256) of each record."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = require(df, archive, offset, payload).where(F.col(archive).isNotNull() & F.col(offset).isNotNull())
    return rows.select(F.col(archive).cast("string").alias("archive"), F.col(offset).cast("long").alias("offset"), F.octet_length(data).cast("long").alias("length"), F.sha2(data, 256).alias("sha256"))


def _joined(fields: list[str]) -> Column:
    """One digest over the group's members in order; each is written with its place, so gaps show."""
    items = F.array_sort(F.collect_list(F.struct(*fields)))
    return F.sha2(F.array_join(F.transform(items, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), "\n"), 256)


def range_nodes(digests: DataFrame, range_bytes: int) -> DataFrame:
    """The lowest level: (archive, node, hash), a node for each range of offsets that has records."""
    return digests.groupBy("archive", F.floor(F.col("offset") / range_bytes).cast("long").alias("node")).agg(_joined(["offset", "length", "sha256"]).alias("hash"))


def parent_nodes(level: DataFrame, fanout: int) -> DataFrame:
    return level.groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(_joined(["node", "hash"]).alias("hash")).withColumnRenamed("parent", "node")


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that one side lacks."""
    a, b = a.withColumnRenamed("hash", "hash_a"), b.withColumnRenamed("hash", "hash_b")
    return a.join(b, list(NODE), "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(*NODE)


def fixity_audit(primary: DataFrame, replica: DataFrame, archive: str = "archive", offset: str = "offset", payload: str = "payload", range_bytes: int = 1 << 16, fanout: int = 16) -> DataFrame:
    """(archive, offset, status, primary_length, replica_length, primary_sha256, replica_sha256).

    One row for each place whose records differ; status is ``corrupt``, ``missing`` (from the
    replica) or ``extra`` (in the replica). Several records at one place: digests joined by commas.
    """
    return audit_digests(*[record_digests(x, archive, offset, payload) for x in (primary, replica)], range_bytes, fanout)


def audit_digests(primary: DataFrame, replica: DataFrame, range_bytes: int = 1 << 16, fanout: int = 16) -> DataFrame:
    """The audit of replicas whose records are digested already: (archive, offset, length, sha256)."""
    scratch = Scratch(primary.sparkSession, "fixity")
    leaves = [scratch.save(x.select("archive", "offset", "length", "sha256"), f"leaves{k}") for k, x in enumerate((primary, replica))]
    levels = [[scratch.save(range_nodes(x, range_bytes), f"level0-{k}") for k, x in enumerate(leaves)]]
    top = max(x.agg(F.max(F.abs("node"))).first()[0] or 0 for x in levels[0])
    while top > 0:
        top //= fanout
        levels.append([scratch.save(parent_nodes(x, fanout), f"level{len(levels)}-{k}") for k, x in enumerate(levels[-1])])
    suspects = _differing(*levels[-1])
    for level in reversed(levels[:-1]):
        under = suspects.withColumnRenamed("node", "parent")
        below = [x.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(under, ["archive", "parent"], "left_semi").drop("parent") for x in level]
        suspects = _differing(*below)
    sides = []
    for k, (x, name) in enumerate(zip(leaves, ("primary", "replica"))):
        near = x.withColumn("node", F.floor(F.col("offset") / range_bytes).cast("long")).join(suspects, list(NODE), "left_semi")
        held = F.array_sort(F.collect_list(F.struct("sha256", "length")))
        sides.append(near.groupBy("archive", "offset").agg(F.sum("length").alias(f"{name}_length"), F.array_join(F.transform(held, lambda r: r["sha256"]), ",").alias(f"{name}_sha256")))
    both = sides[0].join(sides[1], ["archive", "offset"], "full_outer").where(~F.col("primary_sha256").eqNullSafe(F.col("replica_sha256")))
    status = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("primary_sha256").isNull(), "extra").otherwise("corrupt")
    return both.select("archive", "offset", status.alias("status"), "primary_length", "replica_length", "primary_sha256", "replica_sha256")
