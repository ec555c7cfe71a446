"""Publication by requests: each request counts once, and a version is there whole or not at all.

Layout below a base folder: ``data/<id>`` holds a version's entities, words and the requests
that it took in; ``manifests/<number>`` names the ``data`` folder of a version. A manifest is written last, as a file that
can be created once, so readers, who follow the highest sound manifest, never meet half a version,
and of two publishers with one number a single one wins.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from .dictionary import rebuild_words
from .publish import upsert, violations
from .quality import gate


class Version(NamedTuple):
    number: int
    entities: DataFrame
    words: DataFrame


class Published(NamedTuple):
    """What a publication did: the number of the current version, whether it is new, and the violations that stopped it."""

    number: int
    written: bool
    violations: DataFrame | None


def _manifest_names(spark: SparkSession, base: str) -> list[str]:
    return [n for n in store.names(spark, f"{base}/manifests") if n.isdigit()]


def _lineage(spark: SparkSession, base: str, names: list[str] | None = None) -> list[dict]:
    """The sound manifests that lead to the current version, newest first. One that a publisher left unfinished, or that
    another overtook, is none of them."""
    found = {}
    for name in _manifest_names(spark, base) if names is None else names:
        try:
            found[int(name)] = json.loads(store.read_small(spark, f"{base}/manifests/{name}") or "") | {"number": int(name)}
        except ValueError:
            continue
    line, at = [], max(found, default=0)
    while at:
        line.append(found[at])
        at = found[at]["parent"]
    return line


def read_version(spark: SparkSession, base: str, number: int | None = None) -> Version | None:
    """The version of ``number``, or the current one; None if there is none."""
    for m in _lineage(spark, base):
        if number in (None, m["number"]):
            data = f"{base}/data/{m['data']}"
            return Version(m["number"], spark.read.parquet(f"{data}/entities"), spark.read.parquet(f"{data}/entity_words"))
    return None


def requests(spark: SparkSession, base: str) -> DataFrame:
    """request_id, number: every request that a version took in."""
    parts = [spark.read.parquet(f"{base}/data/{m['data']}/requests").withColumn("number", F.lit(m["number"])) for m in _lineage(spark, base)]
    out = spark.createDataFrame([], "request_id string, number int")
    for p in parts:
        out = out.unionByName(p)
    return out


def publish_requests(spark: SparkSession, base: str, changes: DataFrame) -> Published:
    """Takes ``changes`` (request_id, op upsert or delete, seq, then the columns of an entity table) into a new version below ``base``.

    Changes of requests that a version has taken in are left out, so that sending one again does nothing; a null or
    blank request_id is an error. The words of changed entities are made anew, those of the others stay. Any
    violation of severity error stops all of it. A publisher that stops on its way leaves
    files that no manifest names; one that another overtakes raises and may be sent again.
    """
    if not changes.where(F.trim(F.coalesce("request_id", F.lit(""))) == "").isEmpty():
        raise ValueError("a write needs a request_id")
    now = read_version(spark, base)
    known = requests(spark, base).select("request_id")
    fresh = changes.join(known.hint("merge"), "request_id", "left_anti")
    data = f"{base}/data/{uuid.uuid4().hex}"
    fresh.write.parquet(f"{data}/changes")  # read several times below
    fresh = spark.read.parquet(f"{data}/changes")
    if fresh.isEmpty():
        return Published(now.number if now else 0, False, None)
    columns = [c for c in changes.columns if c not in ("request_id", "op", "seq")]
    current = now.entities if now else changes.select(*columns).limit(0)
    upsert(current, fresh.drop("request_id")).write.parquet(f"{data}/entities")
    after = spark.read.parquet(f"{data}/entities")
    ids = fresh.select("entity_id").distinct()
    rebuild_words(after, ids, now.words if now else None).write.parquet(f"{data}/entity_words")
    found = violations(after, spark.read.parquet(f"{data}/entity_words"))
    if not gate(found):
        return Published(now.number if now else 0, False, found)
    fresh.select("request_id").distinct().write.parquet(f"{data}/requests")
    # one look at the manifests settles both the number and that nothing came between: whoever comes later meets this number
    names, parent, late = _manifest_names(spark, base), now.number if now else 0, "another publication came first; send the request again"
    if [m["number"] for m in _lineage(spark, base, names)[:1]] != [parent] * bool(parent):
        raise RuntimeError(late)
    number = max(map(int, names), default=0) + 1
    made = store.create_once(spark, f"{base}/manifests/{number:012d}", json.dumps({"data": data.rsplit("/", 1)[1], "parent": parent}))
    if not made or number not in [m["number"] for m in _lineage(spark, base)]:  # a later one may have met a half-written manifest
        raise RuntimeError(late)
    return Published(number, True, found)
