"""MinHash near-dedup: HyperMinHash registers, banded, estimated, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .storage import as_row, discard, save

WORDS, PERCENT = 5, 85
REGISTERS, MANTISSA_BITS = 128, 10
BANDS, BAND_ROWS = 25, 5
#: Rows and shingles of a side, about, that a task compares where a bucket still holds several components.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Rows of a block that get their registers, or come out of Arrow, at once.
ROWS = 128
EMPTY = 0xFFFF


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each row's set, as sorted distinct 64-bit hashes of its word shingles."""
    starts, ends, rows = A.words(data, offsets)
    sums = A.prefix_sums(A.word_values(data, starts, ends, A.SYMBOLS_LOWER))
    grams = A.grams_hash(sums, width)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= width:
            h = np.sort(grams[a : b - width + 1])
            yield h[np.append(True, h[1:] != h[:-1])]
        elif b > a:
            yield A.spans_hash(sums, np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, A.U)


def donors(tries: int) -> np.ndarray:
    """For each register, the registers it asks in turn when it is empty; the same for every row."""
    at = np.arange(tries * REGISTERS, dtype=A.U).reshape(tries, REGISTERS)
    return (A.mix(at + A.U(12345)) % A.U(REGISTERS)).astype(np.int64)


DONORS = donors(512)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of each set: one hash deals elements to buckets, and a bucket
    keeps its least hash as leading zeros and the mantissa bits after them. Empty buckets
    copy a filled one chosen by a fixed rule, so that registers agree as sets overlap."""
    out = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    sizes = np.array([len(s) for s in sets])
    if sizes.sum():
        h = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), sizes)
        shift = A.U(64 - int(np.log2(REGISTERS)))
        bucket = (h >> shift).astype(np.int64)
        place = row * REGISTERS + bucket
        first = np.append(True, place[1:] != place[:-1])  # sets are sorted: the first of a bucket is its least
        least = (h[first] & ((A.U(1) << shift) - A.U(1))).astype(np.float64) + 1
        mantissa, exponent = np.frexp(least)
        value = ((int(shift) + 1 - exponent) << MANTISSA_BITS) | np.minimum((mantissa * 2 - 1) * (1 << MANTISSA_BITS), (1 << MANTISSA_BITS) - 1).astype(np.int64)
        out.reshape(-1)[place[first]] = value
        filled = out != EMPTY
        rest_row, rest = np.nonzero(~filled & (sizes > 0)[:, None])
        for t in range(len(DONORS) * 8):
            if not len(rest):
                break
            asked = (DONORS[t % len(DONORS)][rest] + t // len(DONORS)) % REGISTERS
            got = filled[rest_row, asked]
            out[rest_row[got], rest[got]] = out[rest_row[got], asked[got]]
            rest_row, rest = rest_row[~got], rest[~got]
    return out


def sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.text_buffers(batch.column("text"))
            for lo, hi in A.slices(offsets):
                sets = list(shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width))
                reg = registers(sets)
                sums = np.array([[s.sum(dtype=A.U), A.mix(s).sum(dtype=A.U)] for s in sets], A.U).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([r.tobytes() for r in reg], pa.binary())],
                    names=["doc_id", "n", "s1", "s2", "reg"],
                )

    return run


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node): BANDS keys for each node, a hash of BAND_ROWS compressed registers each."""
    for batch in batches:
        reg = matrix(batch.column("reg"))
        for at in range(0, len(reg), 4096):
            part = reg[at : at + 4096, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(A.U)
            key = np.broadcast_to(A.mix(np.arange(1, BANDS + 1, dtype=A.U) * A.SYMBOLS[3]), part.shape[:2]).copy()
            for k in range(BAND_ROWS):
                key = A.mix(key ^ (part[:, :, k] + A.SYMBOLS[k]))
            node = np.repeat(batch.column("node").to_numpy()[at : at + 4096], BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node)], names=["key", "node"])


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(A.text_buffers(column)[0].tobytes(), np.uint16).reshape(-1, REGISTERS)


def zero_counts(n: np.ndarray) -> np.ndarray:
    """Chance of each leading-zero count for a register over sets of n elements."""
    load = np.maximum(n / REGISTERS, 1 / 8)[:, None]
    k = np.arange(57)
    return np.exp(-load * 0.5 ** (k + 1)) - np.exp(-load * 0.5**k)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimate from equal registers, less the collisions that unrelated sets of these sizes give."""
    return corrected((a == b).mean(axis=1), (zero_counts(na) * zero_counts(nb)).sum(axis=1))


def corrected(same: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The share of equal registers less that by chance; zeros: how likely two registers have equal leading zeros."""
    chance = zeros / (1 << MANTISSA_BITS)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def floor(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Estimates under this, five standard errors below the threshold, aren't verified."""
    t = percent / 100
    return t - 5 * np.sqrt(t * (1 - t) * (1 / REGISTERS + 2 / np.maximum(na, nb)))


def likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (estimate(matrix(batch.column("ra")), matrix(batch.column("rb")), na, nb) >= floor(na, nb, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def across(percent: int):
    """Links between the components of askers and residents of each block, one for each pair of components: pairs whose
    corrected estimate is near the threshold are confirmed on their full sets. Rows arrive sorted by block."""

    def linked(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: not r[0])  # askers first
        sets = [np.frombuffer(r[3], A.U) for r in rows]
        node, comp = ([r[k] for r in rows] for k in (1, 2))
        first = sum(r[0] for r in rows)
        reg = np.concatenate([registers(sets[lo : lo + ROWS]) for lo in range(0, len(sets), ROWS)] or [registers(sets)])
        n, comps = np.array([len(s) for s in sets]), np.array(comp)
        zeros = zero_counts(n)
        links: dict[tuple[int, int], tuple[int, int]] = {}
        for k in range(first):
            other = first + np.flatnonzero((comps[first:] != comp[k]) & (100 * np.minimum(n[first:], n[k]) >= percent * np.maximum(n[first:], n[k])))
            if not len(other):
                continue
            likeness = corrected((reg[other] == reg[k]).mean(axis=1), zeros[other] @ zeros[k])
            for j in other[likeness >= floor(np.full(len(other), n[k]), n[other], percent)].tolist():
                pair = (min(comp[k], comp[j]), max(comp[k], comp[j]))
                if pair not in links and enough(sets[k], sets[j], percent):
                    links[pair] = (node[k], node[j])
        return list(links.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            found = []
            for lo in range(0, batch.num_rows, ROWS):
                columns = [batch.column(c).slice(lo, ROWS).to_pylist() for c in ("key", "i", "j", "asks", "node", "comp", "set")]
                for key, i, j, *row in zip(*columns, strict=True):
                    if (key, i, j) != at:
                        found += linked(held)
                        held, at = [], (key, i, j)
                    held.append(tuple(row))
            yield pairs(found)
        yield pairs(linked(held))

    return run


def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, share ``percent`` of all their elements."""
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def overlap(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [enough(np.frombuffer(a.as_py(), A.U), np.frombuffer(b.as_py(), A.U), percent) for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.text_buffers(batch.column("text"))
            for lo, hi in A.slices(offsets):
                sets = list(shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width))
                keep = [int(s.sum(dtype=A.U).view(np.int64)) == want for s, want in zip(sets, batch.column("s1").slice(lo, hi - lo).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"]).filter(pa.array(keep, pa.bool_()))

    return run


def group_near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Two rows are linked when 100 * shared >= percent * all of their distinct
    ``width``-word shingles (fewer words: the whole sequence as one); links are
    confirmed on full sets. component_id is the smallest doc_id reachable, kept
    says that it is the row's own. A row without words (null, empty) has an empty
    set and is linked with nothing; a null doc_id is linked with nothing, its
    component_id is null and it is kept; repeated rows have equal results; an
    empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = save(texts.mapInArrow(sketch(width), "doc_id long, n long, s1 long, s2 long, reg binary"), "near-rows")
    # equal sets are one node
    nodes = rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.first("reg").alias("reg"))
    nodes = save(nodes, "near-nodes")
    keys = nodes.select("node", "reg").mapInArrow(bands, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = save(keys.join(shared.hint("merge"), "key"), "near-buckets")

    some = live.select("node").distinct()
    live_nodes = save(nodes.join(some.hint("merge"), "node", "left_semi"), "near-live")
    wanted = live_nodes.select("node", "s1")
    sets = save(texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("node")).select("node", "s1", "text").mapInArrow(full_sets(width), "node long, set binary").dropDuplicates(["node", "set"]), "near-sets")

    def side(table: DataFrame, to: str, **columns: str) -> DataFrame:
        return table.select(F.col("node").alias(to), *(F.col(c).alias(n) for n, c in columns.items()))

    def verified(pairs: DataFrame) -> DataFrame:
        with_sets = pairs.join(side(sets, "a", sa="set").hint("merge"), "a").join(side(sets, "b", sb="set").hint("merge"), "b")
        return save(with_sets.mapInArrow(overlap(percent), "a long, b long"), "near-verified")

    # three leaders a bucket, by fixed random orders: every other member is compared with them
    order = [F.xxhash64("node", F.lit(k)) for k in range(3)]
    leaders = live.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("node", o) for o in order))).alias("leaders"))
    stars = live.join(leaders.hint("merge"), "key").select("node", F.explode("leaders").alias("l")).where("node <> l")
    stars = save(stars.select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct(), "near-stars")
    with_reg = stars.join(side(live_nodes, "a", ra="reg", na="n").hint("merge"), "a").join(side(live_nodes, "b", rb="reg", nb="n").hint("merge"), "b")
    links = verified(with_reg.mapInArrow(likely(percent), "a long, b long"))
    found = components(links)

    # buckets that still hold several components: their rows are compared across components
    placed = live.join(found.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    placed = save(placed.join(live_nodes.select("node", "n").hint("merge"), "node"), "near-placed")
    per_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    mixed = per_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("m").alias("m"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("largest")).where("comps > 1")
    # every pair across components has a side outside the largest one: those rows ask, all others are asked
    blocks = lambda rows: f"cast(1 + ({rows} - 1) div {BLOCK} as int)"
    mixed = mixed.select("key", "largest", F.expr(blocks("c - most")).alias("asking"), F.expr(f"greatest({blocks('c')}, cast(1 + (m - 1) div {BLOCK_SHINGLES} as int))").alias("asked"))
    left = placed.drop("n").join(mixed.hint("merge"), "key")
    place = lambda parts: F.expr(f"cast(pmod(xxhash64(node), {parts}) as int)")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    askers = left.where("comp <> largest").withColumn("i", place("asking")).withColumn("j", every("asked")).withColumn("asks", F.lit(True))
    residents = left.withColumn("i", every("asking")).withColumn("j", place("asked")).withColumn("asks", F.lit(False))
    met = askers.unionByName(residents).select("key", "i", "j", "asks", "node", "comp").join(sets.hint("merge"), "node")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = save(met.mapInArrow(across(percent), "a long, b long").distinct(), "near-across")
    if not more.isEmpty():
        first, found = found, components(links.unionByName(more))
        discard(first)
    discard(live, live_nodes, sets, stars, links, placed, more)

    node_of = nodes.select("s1", "s2", "n", "node").join(found.hint("merge"), "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component"))
    out = rows.drop("reg").join(node_of.hint("merge"), ["s1", "s2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``group_near_duplicates`` keeps, one for each repeated doc_id and text.

    Rows without words (null, empty) are linked with nothing and stay, as do rows
    without an id. Of a group the smallest doc_id stays; if that id stands at
    several rows, each of its texts does. An empty table gives an empty one. Other
    columns, whatever their names, pass through.
    """
    kept = group_near_duplicates(docs, width, percent).where("kept").select("doc_id").distinct()
    rows = as_row(docs)
    rows = rows.join(kept.hint("merge"), F.col("row.doc_id").eqNullSafe(kept["doc_id"]), "left_semi")
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).dropDuplicates(["doc_id", "text"])
    return rows.select("row.*")
