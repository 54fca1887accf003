"""MinHash near-duplicates: BagMinHash signatures of weighted shingle sets, banded and verified.

Texts are multisets of five-word shingles; two texts are linked if their multiset overlap, the sum
of the lower counts over the sum of the higher ones, is 0.8 or more. Classes are the connected
components of the links; a class is named by its lowest doc_id.

Signatures. The weight axis of a shingle is discretised into unit levels, grouped in dyadic blocks
[1, 2), [2, 4), [4, 8), ... Each block of a shingle has a Poisson process over time with its width
as rate, whose points have a level inside the block and a component of the signature, all drawn
from the hash of (shingle, block, number of the point). A text with weight w uses the points of
levels up to w: whole blocks as they are, the last one thinned by level. Component i of the
signature is its earliest point, and two texts agree there with the probability of their weighted
Jaccard similarity. Points are drawn in order of time up to a horizon where all components are
surely filled, which is moved on for the texts where they aren't.

Candidates. Copies of a text are one text from the start. Texts that agree in a band (ROWS
components) are a bucket; buckets with the same members are one bucket, told by their size and two
64-bit sums over their members' hashes. Buckets may be of any size and no pair of one is ever a row:

1. All texts of a bucket meet its leader, the member that shares most with others (the sum of its
   buckets' sizes). Links join classes. From then on the buckets of one leader, 40 at most, are one
   bucket with each of their texts once, without the leader; it is done where its texts are of one
   class.
2. While an open bucket has more than BLOCK bytes of text, the texts outside its largest class are
   led by one of them, drawn by hash, which meets all texts of the bucket: as long as such a round
   takes a tenth of the texts outside the largest classes into others.
3. In the buckets that are still open, the texts outside the largest class meet all texts of the
   bucket. A bucket is cut into blocks of about BLOCK bytes; each pair of blocks is a cell, and a
   text travels once for each of its cells. A cell counts the overlaps over inverted lists of its
   shingles, and returns a forest of its links: a row for a text at most.

So no link between texts of one bucket is lost: of two classes, one is met in whole by the other.
Every meeting is verified exactly. A pair of overlap 0.8 shares a band with probability
1 - (1 - 0.8^ROWS)^BANDS, over 0.99999.

Null and empty texts, and texts without words, are linked to their exact copies only. classes():
rows with a null doc_id have no class and no row; repeated rows (and different texts with one
doc_id) share the row of their id: classes that meet in an id are one. keep_one() judges texts, so
that of two texts with one doc_id neither is lost for the other: a class of texts keeps the text
with the lowest doc_id, then the lowest digest; of repeated rows, the first by their values as
JSON; rows with a null doc_id are kept but for copies among them. Long texts are cut nowhere; a
text longer than BLOCK is a cell's block of its own. Extra columns of any name are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, staged
from .pieces import sliced
from .words import mix, shingles, words_of

N, THRESHOLD = 5, 0.8
ROWS, BANDS = 6, 40
BLOCK = 4 << 20  # bytes of text of a block of a bucket
CHUNK = 1 << 20  # terms and pairs of a cell that are summed at once
_UNIT = 1.0 / (1 << 53)


def multisets(ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of all distinct shingles, in order of row and shingle."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return row[first], hashes[first], np.diff(np.append(first, len(row)))


def signatures(ends: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash: for each text, `size` 64-bit values (texts without shingles: all ones)."""
    texts = len(ends) - 1
    row, shingle, weight = multisets(ends, hashes)
    # The blocks of each shingle: block b has levels 2^b to 2^(b+1) - 1, cut off at the weight.
    blocks = np.frexp(weight.astype(np.float64))[1].astype(np.int64)
    of = np.repeat(np.arange(len(row)), blocks)
    block = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    rate = np.left_shift(1, block).astype(np.float64)
    share = np.minimum(1.0, (weight[of] + 1 - rate) / rate)
    seed = mix(shingle[of] * np.uint64(3) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row = row[of]
    mass = np.bincount(row, rate * share, minlength=texts)
    best = np.full(texts * size, np.inf)
    horizon = size * (np.log(size) + 3.0) / np.maximum(mass, 1)
    time = np.zeros(len(row))
    count = np.zeros(len(row), np.uint64)
    todo = mass > 0
    pending = np.full(len(row), np.nan)  # the next point, if it lies beyond the horizon
    while todo.any():
        live = np.flatnonzero(todo[row])
        while len(live):
            fresh = np.isnan(pending[live])
            draw = mix(seed[live] + count[live] * np.uint64(0xD1342543DE82EF95))
            step = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT) / rate[live]
            at = np.where(fresh, time[live] + step, pending[live])
            inside = at <= horizon[row[live]]
            pending[live] = np.where(inside, np.nan, at)
            live, at, draw = live[inside], at[inside], draw[inside]
            time[live] = at
            count[live] += np.uint64(1)
            place = mix(draw)
            level = (place >> np.uint64(11)).astype(np.float64) * _UNIT
            ok = level < share[live]
            part = (mix(place) % np.uint64(size)).astype(np.int64)
            np.minimum.at(best, row[live[ok]] * size + part[ok], at[ok])
        full = np.isfinite(best.reshape(texts, size)).all(axis=1)
        todo &= ~full
        horizon = np.where(todo, horizon * 2, horizon)
    return best.view(np.uint64).reshape(texts, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    key = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
    key = np.repeat(key, len(signature), axis=0)
    for r in range(rows):
        key = mix(key * np.uint64(3) + signature[:, r::rows][:, :bands])
    return key


def _sketched(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) as (doc_id, digest, bytes, bands); bands is empty for texts without words.

    One pass over the texts without a shuffle; copies are sketched too, and left out by digest later."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in sliced(batch.column(1), 2 << 20):
                ends, hashes = shingles(*words_of(batch.column(1).slice(i, j - i)), N)
                some = np.diff(ends) > 0
                keys = band_keys(signatures(ends, hashes, ROWS * BANDS)[some], BANDS, ROWS)
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                size = pc.binary_length(batch.column(1).slice(i, j - i)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), size, lists], ["doc_id", "digest", "bytes", "bands"])

    return batched(rows.select("doc_id", "text", F.sha2("text", 256).alias("digest"))).mapInArrow(sketch, "doc_id long, digest string, bytes long, bands array<long>")


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The multiset overlap of each pair of texts (the lower counts over the higher ones)."""
    n = len(a)
    ends, hashes = shingles(*words_of(pa.concat_arrays([a.cast(pa.string()), b.cast(pa.string())])), N)
    row, shingle, weight = multisets(ends, hashes)
    total = np.bincount(row, weight, minlength=2 * n)
    pair = row % n if n else row
    order = np.lexsort((shingle, pair))
    pair, shingle, weight = pair[order], shingle[order], weight[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1]))
    both = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), minlength=n)
    return both / np.maximum(total[:n] + total[n:] - both, 1)


def forest(cell: np.ndarray, out: np.ndarray, label: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each row a lower or equal row that it is linked with by way of rows of its cell.

    cell: non-decreasing numbers; out: the rows that meet all rows of their cell; label: the first
    row of the cell with the same class. Overlaps are summed over the inverted lists of the cell's
    shingles, for at most CHUNK terms and pairs at once."""
    n = len(cell)
    row, shingle, weight = multisets(ends, hashes)
    total = np.bincount(row, weight, minlength=n)
    order = np.lexsort((shingle, cell[row]))
    key_cell, key = cell[row][order], shingle[order]
    new = np.ones(len(order), bool)
    new[1:] = (key_cell[1:] != key_cell[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    list_row, list_weight = row[order], weight[order]
    cell_at = np.searchsorted(cell, cell, "left")
    cell_size = np.searchsorted(cell, cell, "right") - cell_at
    use = np.flatnonzero(out[row] & (size[group] > 1))
    rows = np.flatnonzero(out)
    label = label.copy()
    slots = np.cumsum(cell_size[rows])
    at = 0
    while at < len(rows):
        base = slots[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(slots, base + CHUNK, "right")))
        some, width = rows[at:to], int(slots[to - 1] - base)
        place = np.zeros(n, np.int64)  # of a row's first pair, less the first row of its cell
        place[some] = slots[at:to] - cell_size[some] - base - cell_at[some]
        both = np.zeros(width)
        mine = use[np.searchsorted(row[use], some[0], "left") : np.searchsorted(row[use], some[-1], "right")]
        terms = np.cumsum(size[group[mine]])
        i = 0
        while i < len(mine):
            j = max(i + 1, int(np.searchsorted(terms, (terms[i - 1] if i else 0) + CHUNK, "right")))
            of = np.repeat(mine[i:j], size[group[mine[i:j]]])
            begin = first[group[mine[i:j]]]
            lens = size[group[mine[i:j]]]
            term = np.arange(len(of)) + np.repeat(begin - (np.cumsum(lens) - lens), lens)
            both += np.bincount(place[row[of]] + list_row[term], np.minimum(weight[of], list_weight[term]), minlength=width)
            i = j
        x = np.repeat(some, cell_size[some])
        y = np.arange(width) - np.repeat(place[some], cell_size[some])
        linked = both / np.maximum(total[x] + total[y] - both, 1) >= THRESHOLD
        x, y = x[linked], y[linked]
        while True:
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, np.maximum(a, b), low)
            while (label[label] != label).any():
                label = label[label]
        at = to
    return label


def _cells(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Whole cells (by columns c1 and c2, which come sorted), joined up to about `limit` bytes of text."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        c1, c2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        starts = np.flatnonzero((c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])) + 1
        read = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        for k, start in enumerate(starts):
            upto = read[(starts[k + 1] if k + 1 < len(starts) else len(read)) - 1]
            if upto - (read[at - 1] if at else 0) >= limit or k + 1 == len(starts):
                yield batch.slice(at, start - at)
                at = start
        held = batch.slice(at)
    if held is not None:
        yield held


def _met(meetings: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) found in cells. meetings: (c1, c2, id, root, out), where rows with c1 and c2 alike
    are a cell; texts: (id, text)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cells(batches, 1 << 20):
            c1, c2, id_, root = (part.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            cell = np.concatenate([[0], np.cumsum((c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))])
            order = np.lexsort((root, cell))
            same = np.concatenate([[False], (cell[order][1:] == cell[order][:-1]) & (root[order][1:] == root[order][:-1])])
            label = np.empty(len(cell), np.int64)
            label[order] = np.minimum.reduceat(order, np.flatnonzero(~same))[np.cumsum(~same) - 1]
            ends, hashes = shingles(*words_of(part.column(5)), N)
            found = forest(cell, part.column(4).to_numpy(zero_copy_only=False), label, ends, hashes)
            own = np.arange(len(cell))
            moved = np.flatnonzero((label == own) & (found != own))
            yield pa.RecordBatch.from_arrays([pa.array(id_[moved]), pa.array(id_[found[moved]])], ["a", "b"])

    rows = meetings.join(texts, "id").select("c1", "c2", "id", "root", "out", "text")
    return batched(rows.repartition("c1", "c2").sortWithinPartitions("c1", "c2")).mapInArrow(meet, "a long, b long")


def _blocks(bytes_: str, block: int) -> Column:
    return F.ceil(F.greatest(F.col(bytes_), F.lit(1)) / F.lit(block)).cast("int")


def _block_of(blocks: str, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(blocks)).cast("int")


def _led(pairs: DataFrame) -> DataFrame:
    """(leader, id, bytes): each text once for each leader, but the leader itself."""
    return staged(pairs.where("id <> leader").groupBy("leader", "id").agg(F.max("bytes").alias("bytes")), "led")


def _stars(led: DataFrame, block: int) -> DataFrame:
    """Meetings of (leader, id, bytes): the leader goes to every block of those it leads."""
    leaders = led.groupBy("leader").agg(F.sum("bytes").alias("bytes")).withColumn("n", _blocks("bytes", block))
    rows = led.join(leaders.select("leader", "n"), "leader").select(F.col("leader").alias("c1"), _block_of("n", 1).cast("long").alias("c2"), "id", F.lit(False).alias("out"))
    heads = leaders.select(F.col("leader").alias("c1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("c2"), F.col("leader").alias("id"), F.lit(True).alias("out"))
    return rows.unionByName(heads).withColumn("root", F.col("id"))


def _rest(opened: DataFrame, block: int) -> DataFrame:
    """Meetings of the texts outside the largest class with all texts of their bucket. A bucket of one
    block is one cell, in which each text is once; otherwise its texts are there for each block
    of texts outside the largest class, and these for each block of texts."""
    rows = opened.withColumns({"n": _blocks("all", block), "m": _blocks("outs", block)}).withColumns({"i": _block_of("m", 2), "j": _block_of("n", 3)})
    cell = lambda i, j, out: F.struct(F.shiftleft(i.cast("long"), 32).bitwiseOR(j.cast("long")).alias("c2"), out.alias("out"))
    all_ = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: cell(i, F.col("j"), F.lit(False)))
    outs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: cell(F.col("i"), j, F.lit(True)))
    where = F.when(F.col("n") == 1, F.array(cell(F.lit(0), F.lit(0), F.col("out")))).when(F.col("out"), F.concat(all_, outs)).otherwise(all_)
    return rows.select(F.col("key").alias("c1"), "id", "root", F.explode(where).alias("c")).select("c1", "c.c2", "id", "root", "c.out")


def _open(active: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of the buckets that have several classes: (key, id, bytes, root, out, all, outs), where
    out tells the texts outside the largest class, and all and outs are the bytes of all texts of
    the bucket and of these."""
    named = active.join(roots, "id", "left").select("key", "id", "bytes", F.coalesce("root", "id").alias("root"))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).groupBy("key")
    mixed = sizes.agg(F.max_by(F.struct("root", "b"), F.struct("n", "root")).alias("most"), F.sum("b").alias("all"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    rows = named.join(mixed.drop("classes"), "key")
    return staged(rows.select("key", "id", "bytes", "root", (F.col("root") != F.col("most.root")).alias("out"), "all", (F.col("all") - F.col("most.b")).alias("outs")), "open")


def _joined(roots: DataFrame, meetings: DataFrame, texts: DataFrame) -> tuple[DataFrame, bool]:
    """roots after the links of the meetings, and whether there were any."""
    found = staged(_met(meetings, texts), "links")
    some = not found.isEmpty()
    return (_merged(roots, found) if some else roots), some


def links(members: DataFrame, texts_of, block: int | None = None) -> DataFrame:
    """(id, root) of the texts that are linked to another: every two texts with a shared band (key) and
    an overlap of THRESHOLD or more have the same root, the lowest id they are connected with.
    members: (key, id, bytes), bytes of the text; texts_of(ids): the texts (id, text) of a table of ids."""
    block = block or BLOCK
    sums = (F.sum(F.xxhash64("id").cast("decimal(20,0)")).cast("string").alias("s"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("x"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *sums).where("n > 1")
    buckets = shared.groupBy("n", "s", "x").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times"))
    active = staged(members.join(buckets.select("key", (F.col("n") * F.col("times")).alias("near")), "key"), "buckets")
    texts = staged(texts_of(active.select("id").distinct()), "texts")
    score = active.groupBy("id").agg(F.sum("near").alias("score"))
    scored = active.join(score, "id").groupBy("key").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("leader"))
    led = _led(active.join(scored, "key"))
    roots = components(staged(_met(_stars(led, block), texts), "links"))
    # A leader has met all texts of its buckets: what else can be linked is two of the texts it leads.
    active = led.withColumnRenamed("leader", "key")
    round_, before = 0, None
    while True:
        opened = _open(active, roots)
        outs = opened.where("out").count()
        if not outs:
            return roots
        large = opened.where(F.col("all") > block)
        if before is not None and outs > 0.9 * before or large.isEmpty():
            return _joined(roots, _rest(opened, block), texts)[0]
        before, round_ = outs, round_ + 1
        drawn = large.where("out").groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(round_))).alias("leader"))
        roots, some = _joined(roots, _stars(_led(large.join(drawn, "key")), block), texts)
        if not some:
            return _joined(roots, _rest(opened, block), texts)[0]
        active = opened.select("key", "id", "bytes")


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots after more links: the classes they join, by the links between classes alone."""
    ids = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = staged(roots.join(ids.join(roots, "id", "left_anti").withColumn("root", F.col("id")), ["id", "root"], "full_outer"), "roots")
    of = lambda c: named.select(F.col("id").alias(c), F.col("root").alias(f"r_{c}"))
    between = found.join(of("a"), "a").join(of("b"), "b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))
    moved = components(between).select(F.col("id").alias("root"), F.col("root").alias("to"))
    return staged(named.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root")), "roots")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id of the edges: root is the lowest id of its connected component.

    Rounds of hooking to the lowest neighbour and jumping: large-star and small-star steps, each
    written to the shared folder, until every id hangs on one id that hangs on none."""
    edges = staged(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e")).select("e.*")
        if ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 0 AND hangs + holds > 1").isEmpty():
            break
        # Large star: every larger neighbour of u hangs on the lowest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: all smaller neighbours of u, and u, hang on the lowest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = staged(small, "edges")
    hung = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return staged(hung.unionByName(hung.select(F.col("root").alias("id"), "root").distinct()), "roots")


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(member, reps, roots): which texts each doc_id has (doc_id, id, digest, n rows), what a text's number
    is (id, low: its lowest doc_id), and the linked texts' roots (id, root)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    rows = staged(_sketched(texts), "sketches")
    # A text is named by a number of its own, which is staged with its lowest doc_id: several texts may
    # have one lowest doc_id, and all steps must mean the same text by a number.
    one = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    reps = staged(one.withColumn("id", F.monotonically_increasing_id()), "texts")
    members = reps.select("id", "bytes", F.explode("bands").alias("key"))

    def texts_of(ids: DataFrame) -> DataFrame:
        some = reps.join(ids, "id", "left_semi")
        all_ = texts.join(some.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("digest", F.sha2("text", 256))
        return all_.join(some.select("id", "digest", F.col("low").alias("doc_id")), ["doc_id", "digest"]).select("id", "text").dropDuplicates(["id"])

    member = staged(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).join(reps.select("digest", "id"), "digest"), "members")
    return member, reps, links(members, texts_of)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the lowest doc_id of its class) and is_kept (whether it is that one), one
    row per doc_id."""
    member, reps, roots = _texts(docs)
    # One doc_id with several texts: they are linked by the id itself.
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("doc_id", "a")
    by_id = staged(member.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "by_id")
    if not by_id.isEmpty():
        roots = _merged(roots, by_id)
    # A class has the lowest doc_id of its texts.
    named = reps.join(roots, "id", "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("class_id"))
    out = member.join(named.join(lowest, "root").select("id", "class_id"), "id").select("doc_id", "class_id")
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).withColumn("is_kept", F.col("doc_id") == F.col("class_id"))


def _first_of(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each key, the first by its values as JSON. rows: (*keys, row: a struct of all columns)."""
    first = rows.groupBy(*keys).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class of texts, with all its columns."""
    member, reps, roots = _texts(docs)
    named = member.join(roots, "id", "left").select("doc_id", "digest", "n", F.coalesce("root", "id").alias("root"))
    winner = named.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("w"))
    judged = staged(named.join(winner, "root").select("doc_id", "digest", "n", ((F.col("doc_id") == F.col("w.doc_id")) & (F.col("digest") == F.col("w.digest"))).alias("stays")), "judged")
    key = {"key": F.col("row.doc_id").cast("long"), "sum": F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256)}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    known = rows.where("row.doc_id IS NOT NULL").withColumns(key)
    gone, again = (judged.where(x).select(F.col("doc_id").alias("key"), F.col("digest").alias("sum")) for x in ("NOT stays", "stays AND n > 1"))
    kept = known.join(gone, ["key", "sum"], "left_anti")
    plain = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if again.isEmpty():
        out = kept.select(*plain)
    else:
        out = kept.join(again, ["key", "sum"], "left_anti").select(*plain).unionByName(_first_of(kept.join(again, ["key", "sum"], "left_semi"), ["key", "sum"], docs.columns))
    nameless = rows.where("row.doc_id IS NULL")
    if nameless.isEmpty():
        return out
    return out.unionByName(_first_of(nameless.withColumn("sum", key["sum"]), ["sum"], docs.columns))
