"""Operator 9: best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``CAPACITY`` tokens (only longer documents are
cut).  Full pieces are sequences of their own.  The others are dealt by hash to
groups of bounded size; several islands evolve packings of each group.  An
individual is a list of bins; crossover injects the well-filled bins of one
parent into the other, removes the bins that hold a duplicate, exchanges pieces
of the other bins for longer displaced ones that fit, and places what is then
displaced by best fit, longest first.  Generations go on until ``PATIENCE`` of them
save no bin, or the lower bound is met.  After an epoch each group's best
packing migrates to all its islands.  At the end of an epoch the badly filled
bins are dealt by hash, each whole, to as many new groups of the same size as they
need and may be opened there, so that what is left over stays a vanishing share of
all sequences.

The table of pieces is written before packing: island tasks see lengths and ids
only, and a lost executor costs the tasks it ran.

Defined cases: a null or empty text is one piece of one token (the separator);
very long texts are cut into whole pieces; repeated rows (same doc_id) are packed
each, told apart by a row number; a null doc_id stays null; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import slices, store
from gleaner.llm.wordbpe import encoder, ended, vocabulary_text

CAPACITY, SEPARATOR = 2048, 0
GROUP, ISLANDS, EPOCHS = 8_000, 2, 2
POPULATION, PATIENCE, KEEP_FILL = 4, 10, 0.998
BATCH_BYTES = 4e6


# --- tokens ---------------------------------------------------------------------

def pieces(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32: every document's pieces, in order."""
    start_task = encoder(docs.sparkSession, spec)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()),
                        ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        bpe = start_task()
        for batch in slices(batches, BATCH_BYTES):
            ids, size = bpe.encode(batch.column("text"))
            flat, size = ended(ids, size, SEPARATOR)
            n_pieces = -(-size // CAPACITY)
            doc = np.repeat(np.arange(len(size)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * CAPACITY
            length = np.minimum(CAPACITY, size[doc] - start)
            whole = memoryview(flat.astype("<u4")).cast("B")
            at = 4 * ((np.cumsum(size) - size)[doc] + start)
            crc = [zlib.crc32(whole[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            index = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(index), batch.column("row").take(index),
                 *(pa.array(c, f.type) for c, f in zip((piece, start, length, crc), list(schema)[2:]))], schema=schema)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return keyed.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


# --- one island -------------------------------------------------------------------

def best_fit(lengths: np.ndarray, order, room: list[int], bins: list[list[int]]) -> None:
    """Place items, in ``order``, each into the fullest open bin that takes it.

    Open bins are found through a bit set of the free rooms that occur."""
    by_room: dict[int, list[int]] = {}
    have = 0
    for b, r in enumerate(room):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            have |= 1 << r
    size = lengths.tolist()
    for i in order:
        n = size[i]
        fits = have >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            open_bins = by_room[r]
            b = open_bins.pop()
            if not open_bins:
                have ^= 1 << r
            bins[b].append(i)
            r -= n
        else:
            b, r = len(bins), CAPACITY - n
            bins.append([i])
            room.append(0)
        room[b] = r
        if r > 0:
            at = by_room.setdefault(r, [])
            if not at:
                have |= 1 << r
            at.append(b)


def cost(room: list[int], bins: list) -> tuple:
    """Fewer bins are better; then more emptiness gathered in few bins."""
    free = np.array(room, float)
    return len(bins), -float((free ** 2).sum())


def exchange(lengths: np.ndarray, loose: list[int], room: list[int], bins: list[list[int]]) -> list[int]:
    """Fill bins by giving a piece for a longer loose one, the largest gain first; the
    pieces that are loose then."""
    size = lengths.tolist()
    spare: dict[int, list[int]] = {}
    have = 0                                    # bit set of the loose lengths
    for i in loose:
        spare.setdefault(size[i], []).append(i)
        have |= 1 << size[i]
    for b, x in enumerate(bins):
        r = room[b]
        while r > 0:
            gain, k = max(((have >> (size[i] + 1) & ((1 << r) - 1)).bit_length(), k) for k, i in enumerate(x))
            if not gain:
                break
            n, i = size[x[k]] + gain, x[k]
            x[k] = spare[n].pop()
            if not spare[n]:
                del spare[n]
                have ^= 1 << n
            spare.setdefault(size[i], []).append(i)
            have |= 1 << size[i]
            r -= gain
        room[b] = r
    return [i for at in spare.values() for i in at]


def cross(lengths: np.ndarray, a: tuple, b: tuple, rng) -> tuple:
    """Child of two packings: some well-filled bins of ``a``, the bins of ``b``
    that share nothing with them, filled by exchange, and the displaced pieces by
    best fit."""
    (bins_a, room_a), (bins_b, room_b) = a, b
    order = np.argsort(np.array(room_a), kind="stable")
    good = order[: max(1, len(order) // 2)]
    picked = good[rng.random(len(good)) < 0.5]
    taken = np.zeros(len(lengths), bool)
    bins, room = [], []
    for k in picked:
        taken[bins_a[k]] = True
        bins.append(list(bins_a[k]))
        room.append(room_a[k])
    loose = []
    worst = np.quantile(room_b, 0.97) if len(room_b) > 1 else CAPACITY
    for x, r in zip(bins_b, room_b):
        hit = taken[x]
        if hit.any() or r > 0 and r >= worst:
            loose += [i for i, t in zip(x, hit) if not t]
        else:
            bins.append(list(x))
            room.append(r)
    loose = exchange(lengths, loose, room, bins)
    loose.sort(key=lambda i: (-lengths[i], i))
    best_fit(lengths, loose, room, bins)
    return bins, room


def evolve(lengths: np.ndarray, seed: int, elite: list[tuple] | None = None) -> tuple:
    """The best packing (bins, room) that one island finds."""
    rng = np.random.default_rng(seed)
    n = len(lengths)
    people = list(elite or [])
    while len(people) < POPULATION:
        order = np.argsort(-lengths, kind="stable") if not people else np.argsort(
            -lengths * (1 + 0.1 * rng.random(n) * (len(people) > 0)), kind="stable")
        bins, room = [], []
        best_fit(lengths, order.tolist(), room, bins)
        people.append((bins, room))
    lowest = -(-int(lengths.sum()) // CAPACITY)
    people.sort(key=lambda p: cost(p[1], p[0]))
    idle = 0
    while idle < PATIENCE and len(people[0][0]) > lowest:
        fewest = len(people[0][0])
        i, j = rng.choice(len(people), 2, replace=False)
        people.append(cross(lengths, people[i], people[j], rng))
        people.sort(key=lambda p: cost(p[1], p[0]))
        people = people[:POPULATION]
        idle = 0 if len(people[0][0]) < fewest else idle + 1
    return people[0]


# --- the archipelago ----------------------------------------------------------------

_ISLAND = "grp long, island int, n_bins long, free double, doc_row long, piece int, length long, bin long, room long"


def _run_islands(items: DataFrame, seed: int) -> DataFrame:
    """One epoch: every (group, island) packs the group's items; ``bin`` is the
    migrated elite's bin, null in the first epoch."""
    def island(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_row", "piece"], ignore_index=True)
        lengths = df["length"].to_numpy(np.int64)
        elite = None
        if df["bin"].notna().all():
            codes, _ = pd.factorize(df["bin"])
            order = np.argsort(codes, kind="stable")
            bins = [x.tolist() for x in np.split(order, np.cumsum(np.bincount(codes))[:-1])]
            elite = [(bins, [CAPACITY - int(lengths[b].sum()) for b in bins])]
        bins, room = evolve(lengths, int(key[0]) * 1009 + int(key[1]) * 31 + seed, elite)
        at = np.zeros(len(df), np.int64)
        left = np.zeros(len(df), np.int64)
        for k, b in enumerate(bins):
            at[b], left[b] = k, room[k]
        return df.assign(bin=at, room=left, n_bins=len(bins), free=cost(room, bins)[1])[
            [f.split()[0] for f in _ISLAND.split(", ")]]

    spread = items.withColumn("island", F.explode(F.array([F.lit(i) for i in range(ISLANDS)])))
    done = spread.groupBy("grp", "island").applyInPandas(island, _ISLAND)
    return done


def _epoch(items: DataFrame, seed: int) -> DataFrame:
    """Run the islands and keep each group's elite: (grp, doc_row, piece, length, bin, room)."""
    done = store(_run_islands(items, seed), "islands")
    best = (done.groupBy("grp").agg(F.min(F.struct("n_bins", "free", "island")).alias("m"))
            .select("grp", F.col("m.island").alias("island")))
    return done.join(best, ["grp", "island"]).drop("island", "n_bins", "free")


def pack(items: DataFrame) -> DataFrame:
    """(doc_row, piece, sequence_id) for items (doc_row, piece, length < CAPACITY)."""
    total = items.count()
    n_groups = max(1, -(-total // GROUP))
    left = items.select("doc_row", "piece", "length", F.lit(None).cast("long").alias("bin"),
                        F.pmod(F.xxhash64("doc_row", "piece"), F.lit(n_groups)).alias("grp"))
    done = None
    for epoch in range(EPOCHS):
        packed = store(_epoch(left, epoch), "packed")
        # ids of bins: no group has more bins than the largest has
        stride = (packed.agg(F.max("bin")).first()[0] or 0) + 1
        number = F.col("grp") * F.lit(stride) + F.col("bin")
        full = packed if epoch == EPOCHS - 1 else packed.where(F.col("room") <= (1 - KEEP_FILL) * CAPACITY)
        ids = full.select("doc_row", "piece", (F.lit(epoch) + EPOCHS * number).alias("sequence_id"))
        done = ids if done is None else done.unionByName(ids)
        if epoch == EPOCHS - 1:
            break
        rest = packed.where(F.col("room") > (1 - KEEP_FILL) * CAPACITY)
        n_rest = rest.count()
        n_next = max(1, -(-n_rest // GROUP))
        # an opened bin moves whole, as part of the elite of its next group; dealt bin
        # by bin, the next groups stay near GROUP pieces
        left = rest.select("doc_row", "piece", "length", number.alias("bin"),
                           F.pmod(F.xxhash64("grp", "bin"), F.lit(n_next)).alias("grp"))
    return done


def pack_documents(docs: DataFrame, spec: str) -> DataFrame:
    """Every piece with its sequence and place."""
    table = store(pieces(docs, spec), "pieces")
    small = table.where(F.col("length") < CAPACITY).select(F.col("row").alias("doc_row"), "piece", "length")
    placed = pack(small)
    joined = table.where(F.col("length") < CAPACITY).join(
        placed, (table["row"] == placed["doc_row"]) & (table["piece"] == placed["piece"])).select(
        "doc_id", "row", table["piece"], "start", "length", "ids_crc32", F.col("sequence_id"))
    from pyspark.sql import Window

    # a sequence holds at most CAPACITY pieces, whatever the corpus
    before = Window.partitionBy("sequence_id").orderBy("row", "piece").rowsBetween(Window.unboundedPreceding, -1)
    small_out = joined.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    full_out = (table.where(F.col("length") == CAPACITY)
                .withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return small_out.select(*cols).unionByName(full_out.select(*cols))


def op9_pack_grouping_ga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(table_path(sf_dir, "documents")), vocabulary_text())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences of what is left."""
    return pack_documents(docs, vocabulary_text())
