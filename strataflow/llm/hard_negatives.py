"""Hard negatives by integer inner product, from candidate blocks in Hilbert order with zone maps.

Candidates are sorted along a Hilbert curve and written as Parquet blocks; each block carries the least
and greatest value of every dimension. Interval arithmetic on a box of neighbouring anchors and a
block's zone map bounds every score between them, so only blocks that can reach an anchor's window are
read for it. Anchors stay in a task in groups of bounded size while blocks stream past them, best first.
"""

from __future__ import annotations

import itertools
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialise

BLOCK = 1024  # rows of a candidate block
GROUP = 16_384  # anchors a task holds, about
BOX = 128  # neighbouring anchors that share a box
LANE = 4096  # blocks that stream past a group in one task, about
BITS, CURVE = 4, 64  # bits of a coordinate on the curve; dimensions on it, those of the largest spread
EXACT = 1 << 50  # scores up to here are exact, and leave room for a place in the block
LOW = -(1 << 62)
ANCHORS_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # hundredths of the positive's score


# ---- The curve ----------------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place of each row of cell coordinates (below 2^bits) on the Hilbert curve; bytes in curve order.

    Coordinates become the curve's transposed index by undoing excess rotations bit by bit and a final
    Gray code; the index is read across dimensions, highest bits first.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for high in (1 << b for b in range(bits - 1, 0, -1)):
        low = np.uint32(high - 1)
        for i in range(n):
            flip = (x[i] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for high in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & high, np.uint32(high - 1), np.uint32(0))
    x ^= turn
    index = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).reshape(bits * n, -1)
    return [row.tobytes() for row in np.packbits(index.astype(np.uint8).T, axis=1)]


# ---- Blocks -------------------------------------------------------------------------------------

BLOCKS = "block long, n int, ids binary, labels binary, vecs binary, lo binary, hi binary"
ANCHORS = "anchor long, vec_id long, label int, vec binary, key binary, reach long"


def _matrix(raw, dims: int, dtype) -> np.ndarray:
    return np.frombuffer(raw, dtype).reshape(-1, dims)


def _valid(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` (moved on where the rule says so), ``x``: rows that take part."""
    fine = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("int")
    moved = F.when(vec_id % SHIFT_EVERY == 0, ((label.cast("long") + 1) % LABELS).cast("int")).otherwise(label)
    kept = embeddings.filter(vec_id.isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & fine)
    return kept.select(vec_id.alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Scaled integer components as doubles, a row each; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _spread(rows: DataFrame):
    """Per dimension: sum, sum of squares and greatest size of its components; and the number of rows."""

    def partial(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, list] = {}
        for batch in batches:
            column = batch["x"]
            sizes = np.diff(column.offsets.to_numpy())
            x = _padded(column, int(sizes.max(initial=0)))
            for d in range(x.shape[1]):
                c = x[:, d]
                s = sums.setdefault(d, [0.0, 0.0, 0.0])
                sums[d] = [s[0] + c.sum(), s[1] + (c * c).sum(), max(s[2], np.abs(c).max())]
            s = sums.setdefault(-1, [0.0, 0.0, 0.0])
            s[0] += batch.num_rows
        if sums:
            cols = [list(sums), *([v[i] for v in sums.values()] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.float64()] * 3))], ["d", "a", "b", "c"])

    seen = rows.select("x").mapInArrow(partial, "d int, a double, b double, c double")
    return seen.groupBy("d").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("c").alias("c")).orderBy("d").collect()


class Layout:
    """How vectors are stored, and where the curve's cells lie."""

    def __init__(self, stats):
        self.rows = int(stats[0]["a"]) if stats else 0
        per = [s for s in stats if s["d"] >= 0]
        self.dims = len(per)
        top = max((s["c"] for s in per), default=0.0)
        if max(1, self.dims) * top * top >= EXACT:
            raise ValueError("scores of these vectors can exceed 2^50")
        self.stored = "<i2" if top < 1 << 15 else "<i4"
        # Sums of products up to 2^24 are exact in single precision.
        self.inner = np.float32 if max(1, self.dims) * top * top < 1 << 24 else np.float64
        n = max(1, self.rows)
        self.mean = np.array([s["a"] / n for s in per])
        self.sd = np.sqrt(np.maximum([s["b"] / n - (s["a"] / n) ** 2 for s in per], 0))
        self.curve = np.argsort(-self.sd, kind="stable")[:CURVE]

    def keys(self, x: np.ndarray) -> list[bytes]:
        if not self.dims:
            return [b""] * len(x)
        scale = (1 << BITS) / 4 / np.maximum(self.sd, 1e-9)  # two deviations on each side
        cells = np.clip((x - self.mean) * scale + (1 << BITS) / 2, 0, (1 << BITS) - 1)
        return hilbert_keys(cells[:, self.curve].astype(np.uint32))


def candidate_blocks(rows: DataFrame, layout: Layout, block: int = BLOCK) -> DataFrame:
    """One row per block: numbers, labels, vectors (rows by vec_id), zone map. Written once, in curve order."""
    dims, stored = layout.dims, layout.stored

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = _padded(batch["x"], dims)
            vecs = [v.tobytes() for v in x.astype(stored)]
            cols = [pa.array(layout.keys(x), pa.binary()), batch["vec_id"], batch["label"], pa.array(vecs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "vec_id", "label", "vec"])

    order = ("key", "vec_id", "label", "vec")
    placed = rows.mapInArrow(keyed, "key binary, vec_id long, label int, vec binary")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]):
        number = itertools.count(TaskContext.get().partitionId() << 24)
        held: list[pa.RecordBatch] = []

        def packed(rows: pa.Table):
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            vecs = _matrix(b"".join(rows["vec"].to_pylist()), dims, stored) if dims else np.zeros((len(ids), 0), stored)
            by = np.argsort(ids, kind="stable")
            vecs = vecs[by]
            raw = [ids[by].astype("<i8"), labels[by].astype("<i4"), vecs, vecs.min(0), vecs.max(0)]
            cols = [pa.array([next(number)], pa.int64()), pa.array([len(ids)], pa.int32())]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array([r.tobytes()], pa.binary()) for r in raw)], ["block", "n", "ids", "labels", "vecs", "lo", "hi"])

        waiting = 0
        for batch in batches:
            held.append(batch.select(["vec_id", "label", "vec"]))
            waiting += batch.num_rows
            while waiting >= block:
                rows = pa.Table.from_batches(held)
                yield packed(rows.slice(0, block))
                held = rows.slice(block).to_batches()
                waiting -= block
        if waiting:
            yield packed(pa.Table.from_batches(held))

    return materialise(placed.mapInArrow(cut, BLOCKS), "blocks")


# ---- Anchors ------------------------------------------------------------------------------------


def _top(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """Rows of the k best of each group: higher scores first, then smaller ids. With their ranks from 0."""
    by = np.lexsort((ids, -score, group))
    g = group[by]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    best = rank < k
    return by[best], rank[best]


def anchors_of(blocks: DataFrame, layout: Layout, every: int = ANCHORS_EVERY, positives: int = POSITIVES) -> DataFrame:
    """Anchors, with ``reach``: the score of the last positive within the anchor's own block, below which none counts."""
    dims, stored, inner = layout.dims, layout.stored, layout.inner

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for b in batch.to_pylist():
                ids, labels = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i4")
                vecs = np.frombuffer(b["vecs"], stored).reshape(len(ids), dims)
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                score = (vecs[at].astype(inner) @ vecs.T.astype(inner)).astype(np.int64)
                score[(labels[at][:, None] != labels) | (at[:, None] == np.arange(len(ids)))] = LOW
                reach = np.sort(score, 1)[:, -positives] if len(ids) >= positives else np.full(len(at), LOW)
                x = vecs[at]
                cols = [b["block"] * BLOCK + at, ids[at], labels[at]]
                cols = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))]
                cols += [pa.array([v.tobytes() for v in x], pa.binary()), pa.array(layout.keys(x.astype(float)), pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(reach, pa.int64())], [f.split()[0] for f in ANCHORS.split(", ")])

    return materialise(blocks.mapInArrow(rows, ANCHORS), "anchors")


GROUPS = "grp int, box int, anchors binary, labels binary, vecs binary, least binary, most binary, lo binary, hi binary, low long, high long"


def _boxes(anchors: DataFrame, layout: Layout, windows: int, groups: int) -> DataFrame:
    """Anchors with ``least`` and ``most`` (arrays of ``windows`` scores), packed into boxes along the curve."""
    dims, stored = layout.dims, layout.stored
    dealt = anchors.repartitionByRange(groups, "key", "anchor").sortWithinPartitions("key", "anchor")

    def rows(batches: Iterator[pa.RecordBatch]):
        number, group = itertools.count(), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, BOX):
                part = batch.slice(at, BOX)
                n = part.num_rows
                vecs = np.frombuffer(b"".join(part["vec"].to_pylist()), stored).reshape(n, dims)
                least, most = (np.array(part[c].to_pylist(), np.int64).reshape(n, windows) for c in ("least", "most"))
                open_ = least <= most
                low = int(least[open_].min()) if open_.any() else -LOW
                high = int(most[open_].max()) if open_.any() else LOW
                raw = [part["anchor"].to_numpy().astype("<i8"), part["label"].to_numpy().astype("<i4"), vecs, least, most, vecs.min(0), vecs.max(0)]
                cols = [pa.array([group], pa.int32()), pa.array([next(number)], pa.int32()), *(pa.array([r.tobytes()], pa.binary()) for r in raw)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([low], pa.int64()), pa.array([high], pa.int64())], [f.split()[0] for f in GROUPS.split(", ")])

    packed = dealt.select("anchor", "label", "vec", "least", "most").mapInArrow(rows, GROUPS)
    return materialise(packed, "boxes")


# ---- Search -------------------------------------------------------------------------------------


def _bounds(layout: Layout):
    """Interval arithmetic: least and greatest inner product of a box of anchors and a block."""
    stored, dims = layout.stored, layout.dims

    @F.arrow_udf("struct<low: double, high: double>")
    def bounds(alo: pa.Array, ahi: pa.Array, blo: pa.Array, bhi: pa.Array) -> pa.Array:
        low, high = np.zeros(len(alo)), np.zeros(len(alo))
        for at in range(0, len(alo), 4096):
            a, b, c, d = (
                np.frombuffer(b"".join(p.slice(at, 4096).to_pylist()), stored).reshape(-1, dims).astype(float) if dims else np.zeros((len(p.slice(at, 4096)), 0))
                for p in (alo, ahi, blo, bhi)
            )
            each = np.stack([a * c, a * d, b * c, b * d])
            low[at : at + 4096], high[at : at + 4096] = each.min(0).sum(1), each.max(0).sum(1)
        return pa.StructArray.from_arrays([pa.array(low), pa.array(high)], ["low", "high"])

    return bounds


def wanted_blocks(boxes: DataFrame, blocks: DataFrame, layout: Layout) -> DataFrame:
    """``grp``, ``block``, ``best`` (greatest bound): blocks that some window of the group's boxes can reach.

    Only boxes and zone maps meet here, all of them: dealt over a grid of shelves, none read twice.
    """
    spark = boxes.sparkSession
    shelves = int(spark.conf.get("spark.sql.shuffle.partitions"))
    box = boxes.select("grp", "lo", "hi", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))).alias("shelf"))
    zone = blocks.select("block", F.col("lo").alias("zlo"), F.col("hi").alias("zhi"), F.pmod(F.xxhash64("block"), F.lit(shelves)).cast("int").alias("shelf"))
    met = box.join(zone, "shelf").select("grp", "block", "low", "high", _bounds(layout)("lo", "hi", "zlo", "zhi").alias("b"))
    met = met.filter((F.col("b.high") >= F.col("low")) & (F.col("b.low") <= F.col("high")))
    return met.groupBy("grp", "block").agg(F.max("b.high").alias("best"))


FOUND = "anchor long, window int, vec_id long, label int, score long"


class _Group:
    """The anchors of a group and the best rows of each of their windows so far."""

    def __init__(self, boxes: list[dict], layout: Layout, windows: int, k: int, same: bool):
        cat = lambda name, t: np.concatenate([np.frombuffer(b[name], t) for b in boxes])
        self.keys, self.labels = cat("anchors", "<i8"), cat("labels", "<i4")
        n = len(self.keys)
        self.vecs = cat("vecs", layout.stored).reshape(n, layout.dims)
        self.least, self.most = (cat(c, "<i8").reshape(n, windows).copy() for c in ("least", "most"))
        self.score = np.full((n, windows, k), LOW)
        self.ids = np.zeros((n, windows, k), np.int64)
        self.their = np.zeros((n, windows, k), np.int32)
        self.k, self.same, self.layout, self.windows = k, same, layout, windows

    def read(self, b: dict) -> None:
        dims, inner = self.layout.dims, self.layout.inner
        ids, labels = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i4")
        vecs = np.frombuffer(b["vecs"], self.layout.stored).reshape(len(ids), dims).T.astype(inner)
        lo, hi = (np.frombuffer(b[c], self.layout.stored).astype(float) for c in ("lo", "hi"))
        for at in range(0, len(self.keys), 512):
            part = slice(at, at + 512)
            a = self.vecs[part].astype(float)
            ends = a * lo, a * hi
            above, below = np.maximum(*ends).sum(1), np.minimum(*ends).sum(1)
            floor = np.maximum(self.least[part], self.score[part, :, -1])
            reach = ((above[:, None] >= floor) & (below[:, None] <= self.most[part])).any(1)
            which = at + np.flatnonzero(reach)
            if len(which):
                score = (self.vecs[which].astype(inner) @ vecs).astype(np.int64)
                alike = self.labels[which][:, None] == labels
                if self.same:
                    home = self.keys[which] // BLOCK == b["block"]
                    alike[np.flatnonzero(home), self.keys[which][home] % BLOCK] = False
                self._merge(which, score, alike if self.same else ~alike, ids, labels)

    def _merge(self, which, score, allowed, ids, labels) -> None:
        for w in range(self.windows):
            worst, last = self.score[which, w, -1][:, None], self.ids[which, w, -1][:, None]
            fits = allowed & (score >= self.least[which, w][:, None]) & (score <= self.most[which, w][:, None])
            fits &= (score > worst) | ((score == worst) & (ids < last))
            r, c = np.nonzero(fits)
            if not len(r):
                continue
            rows = np.unique(r)
            own = which[rows]
            known = self.score[own, w] > LOW
            at = np.repeat(rows, known.sum(1))
            group = np.concatenate([at, r])
            s = np.concatenate([self.score[own, w][known], score[r, c]])
            i = np.concatenate([self.ids[own, w][known], ids[c]])
            t = np.concatenate([self.their[own, w][known], labels[c]])
            best, rank = _top(group, s, i, self.k)
            to = which[group[best]]
            self.score[to, w, rank], self.ids[to, w, rank], self.their[to, w, rank] = s[best], i[best], t[best]

    def rows(self) -> pa.RecordBatch:
        n, w, k = np.nonzero(self.score > LOW)
        cols = [self.keys[n], w, self.ids[n, w, k], self.their[n, w, k], self.score[n, w, k]]
        types = pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in FOUND.split(", ")])


def search(anchors: DataFrame, blocks: DataFrame, layout: Layout, windows: int, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of every anchor and window: score between ``least`` and ``most``, label the ``same`` or another.

    Best is by higher score, then smaller vec_id. A task holds a group of anchors with their best rows
    so far, and passes the wanted blocks of its lane by, the most promising first; what it has found
    raises the windows' floors, and blocks below every floor are passed over unread.
    """
    spark = anchors.sparkSession
    groups = max(1, -(-anchors.count() // GROUP))
    boxes = _boxes(anchors, layout, windows, groups)
    cores = spark.sparkContext.defaultParallelism
    lanes = max(1, -(-blocks.count() // LANE), -(-2 * cores // groups))
    lane = F.pmod(F.xxhash64(F.col("block"), F.lit(1)), F.lit(lanes)).cast("int")
    wanted = materialise(wanted_blocks(boxes, blocks, layout).withColumn("lane", lane), "wanted")
    held = boxes.join(wanted.select("grp", "lane").distinct(), "grp").select(
        "grp", "lane", F.lit(float("inf")).alias("best"), "box", F.lit(0).cast("long").alias("block"),
        F.col("anchors").alias("ids"), "labels", "vecs", "least", "most", "lo", "hi",
    )
    none = F.lit(None).cast("binary")
    passing = blocks.join(wanted, "block").select(
        "grp", "lane", "best", F.lit(-1).alias("box"), "block", "ids", "labels", "vecs", none.alias("least"), none.alias("most"), "lo", "hi"
    )

    def rows(batches: Iterator[pa.RecordBatch]):
        key, boxes_, group = None, [], None
        for batch in batches:
            for r in itertools.chain.from_iterable(batch.slice(i, 64).to_pylist() for i in range(0, batch.num_rows, 64)):
                if (r["grp"], r["lane"]) != key:
                    if group:
                        yield group.rows()
                    key, boxes_, group = (r["grp"], r["lane"]), [], None
                if r["box"] >= 0:
                    boxes_.append({**r, "anchors": r["ids"]})
                    continue
                group = group or _Group(boxes_, layout, windows, k, same)
                group.read(r)
        if group:
            yield group.rows()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups * lanes)
    dealt = held.unionByName(passing).repartition(parts, "grp", "lane")
    found = dealt.sortWithinPartitions("grp", "lane", F.desc("best"), F.desc("box"), "block").mapInArrow(rows, FOUND)
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = ANCHORS_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows whose vec_id is divisible by ``every``; their positives the best other rows of
    the same label; the negatives of each positive the best rows of other labels whose score lies
    between 30 and 90 hundredths of the positive's. Exact: bounds only spare reading.

    Rows with a null label, a null vector, a null, NaN or infinite component, or without a vec_id take no
    part. Shorter vectors count as ending in zeros; an empty vector scores 0 with all. Repeated rows are
    rows of their own, so an anchor's copy can be its positive. A positive with a negative score has an empty window.
    Other columns do not count. An empty table gives an empty table. Vectors whose scores can exceed 2^50 fail the job.
    """
    rows = _valid(embeddings)
    layout = Layout(_spread(rows))
    blocks = candidate_blocks(rows, layout)
    anchors = anchors_of(blocks, layout, every, positives)
    own = anchors.withColumns({"least": F.array("reach"), "most": F.array(F.lit(EXACT))})
    near = materialise(search(own, blocks, layout, 1, positives, True), "positives")
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    # From ceil(30 s / 100) to floor(90 s / 100), in whole numbers; least above most: closed.
    ends = [
        F.expr(f"transform(p, p -> if(p.score < 0, 1L, ({LEAST} * p.score + 99) div 100))"),
        F.expr(f"transform(p, p -> if(p.score < 0, 0L, ({MOST} * p.score) div 100))"),
    ]
    missing = [F.array_repeat(F.lit(v).cast("long"), positives) for v in (1, 0)]
    closed = [F.slice(F.concat(e, m), 1, positives) for e, m in zip(ends, missing)]
    windows = anchors.join(listed, "anchor").withColumns({"least": closed[0], "most": closed[1]})
    windows = materialise(windows, "windows")
    far = search(windows.drop("p"), blocks, layout, positives, negatives, False)
    named = windows.select(F.col("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("window", "p"))
    return far.join(named, ["anchor", "window"]).select(
        "anchor_id",
        F.col("p.vec_id").alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
