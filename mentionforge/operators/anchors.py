"""The index that texts and dictionary keys meet on: an anchor of each key, and a sieve of all anchors."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

#: Length of an anchor.
GRAM = 6
#: What is sent to every task at most: rows, and bytes as JSON text; above either, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bits of the sieve: so many for an anchor, and so many at least and at most (4 MB); a fuller sieve lets more through, nothing is lost.
BITS_EACH, BITS_LEAST, BITS_MOST = 16, 1 << 10, 1 << 25
ROWS = "_k string, off int, gram string"


def anchors(words: DataFrame, key: str, gram: int = GRAM) -> DataFrame:
    """_k, off, gram: for each distinct key its piece of ``gram`` characters that fewest keys share,
    and where it stands in the key; a shorter key is its own anchor."""
    keys = words.select(F.col(key).alias("_k")).where(F.length(key) > 0).distinct()
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("_k") - gram))
    pieces = keys.select("_k", F.explode(places).alias("off")).withColumn("gram", F.substring("_k", F.col("off") + 1, F.lit(gram)))
    common = pieces.groupBy("gram").agg(F.count("*").alias("_n"))
    best = pieces.join(common.hint("merge"), "gram").groupBy("_k").agg(F.min_by(F.struct("off", "gram"), F.struct("_n", "off")).alias("_a"))
    return best.select("_k", "_a.off", "_a.gram")


def _probes(gram: Column, bits: int) -> list[Column]:
    """The two bits of an anchor."""
    h = F.xxhash64(gram)
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]


def sieve(rows: DataFrame, bits: int) -> DataFrame:
    """One row, sieve: the bits of all anchors of ``rows``, as ``bits`` / 64 numbers."""
    words = rows.select(F.explode(F.array(*_probes(F.col("gram"), bits))).alias("b"))
    words = words.groupBy(F.expr("b div 64").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    every = rows.sparkSession.range(bits // 64).join(words.hint("merge"), "id", "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda w: w["v"]).alias("sieve"))


@dataclass(frozen=True)
class AnchorIndex:
    """Anchors (_k, off, gram) of all keys, written out; the ``lengths`` that anchors have; ``small``: they are shown to be
    few enough for every task; else the ``sieve`` of ``bits`` bits, written out too; how many characters of a key stand ``before``
    its anchor and from it on (``after``) at most, if known."""

    rows: DataFrame
    sieve: DataFrame | None
    lengths: list[int]
    small: bool
    bits: int
    before: int | None = None
    after: int | None = None

    def around(self, most: int) -> tuple[int, int]:
        """How many characters before a piece, and from it on, hold all keys with that anchor; at most so many, and ``most`` if it isn't known."""
        return tuple(most if n is None else min(most, n) for n in (self.before, self.after))

    def fits(self, most: int) -> bool:
        """Whether keys are whole in ``around``, or pieces meet them beside their texts."""
        return self.small or (self.before is not None and max(self.before, self.after) <= most)

    def may_hold(self, gram: Column) -> Column:
        """False only for pieces that are no anchor."""
        held = self.sieve.scalar()
        probe = lambda b: F.getbit(F.element_at(held, (F.floor(b / 64) + 1).cast("int")), (b % 64).cast("int")) == 1
        first, second = _probes(gram, self.bits)
        return probe(first) & probe(second)

    def meet(self, pieces: DataFrame, pack: Callable[[DataFrame], DataFrame] = lambda kept: kept) -> DataFrame:
        """Joins ``pieces`` (gram and others) with the anchors they equal. Anchors that are shown to be few go to every task;
        else pieces shuffle, those alone that the sieve lets through, as ``pack`` makes them."""
        if self.small:
            return pieces.join(self.rows.hint("broadcast"), "gram")
        return pack(pieces.where(self.may_hold(F.col("gram")))).join(self.rows.hint("merge"), "gram")


def sieved(pieces: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``pieces`` whose ``key`` is among the distinct ``keys`` (that column alone). Few keys go to every task; else pieces shuffle, those alone
    that a sieve of all keys lets through."""
    rows = keys.select(F.lit("").alias("_k"), F.lit(0).alias("off"), F.col(key).alias("gram"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("gram"))))).first()
    if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
        return pieces.join(keys.hint("broadcast"), key, "left_semi")
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (BITS_EACH * n).bit_length()))
    path = store.folder(keys.sparkSession, "key-sieve")
    sieve(rows, bits).write.parquet(path)
    held = AnchorIndex(rows, keys.sparkSession.read.schema("sieve array<long>").parquet(path), [], False, bits)
    return pieces.where(held.may_hold(F.col(key))).join(keys.hint("merge"), key, "left_semi")


def build_index(words: DataFrame, key: str, path: str | None = None, gram: int = GRAM, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> AnchorIndex:
    """The index of the keys in the column ``key``, written to ``path`` (a new folder), or to one that all executors share.
    Anchors beyond ``most_rows`` or ``most_bytes`` aren't broadcast.

    A table without keys, null and empty ones included, has an empty index, which meets nothing.
    """
    return _opened(words.sparkSession, _build(words, key, path or store.folder(words.sparkSession, "anchors"), gram, most_rows, most_bytes))


def _build(words: DataFrame, key: str, path: str, gram: int, most_rows: int, most_bytes: int) -> dict:
    """Writes the index; what is to be known of it."""
    spark = words.sparkSession
    anchors(words, key, gram).write.parquet(f"{path}/rows")
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    # at most ``gram`` rows
    by_length = rows.groupBy(F.length("gram").alias("l")).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size"), F.max("off").alias("before"), F.max(F.length("_k") - F.col("off")).alias("after")).collect()
    n, size = sum(r.n for r in by_length), sum(r["size"] for r in by_length)
    small = n <= most_rows and size <= most_bytes
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (BITS_EACH * n).bit_length()))
    if not small:
        sieve(rows, bits).write.parquet(f"{path}/sieve")
    return {"path": path, "lengths": sorted(r.l for r in by_length), "small": small, "bits": bits, "before": max((r.before for r in by_length), default=0), "after": max((r.after for r in by_length), default=0)}


def _opened(spark: SparkSession, said: dict) -> AnchorIndex:
    rows = spark.read.schema(ROWS).parquet(f"{said['path']}/rows")
    held = None if said["small"] else spark.read.schema("sieve array<long>").parquet(f"{said['path']}/sieve")
    return AnchorIndex(rows, held, said["lengths"], said["small"], said["bits"], said.get("before"), said.get("after"))


def index_once(words: DataFrame, key: str, base: str, version: str, gram: int = GRAM, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> AnchorIndex:
    """The index of a version of ``words``: that which stands under ``base``, or one that is built there now.

    Each attempt writes a folder of its own; a small file, created once and last, says which one counts.
    A build that was killed, or came second, is never read.
    """
    spark = words.sparkSession
    name = f"{base}/{version.encode().hex()}-{gram}.json"
    if not store.exists(spark, name):
        said = _build(words, key, f"{base}/{store.unique()}", gram, most_rows, most_bytes)
        store.create_once(spark, name, json.dumps(said))
    return _opened(spark, json.loads(store.read_small(spark, name)))
