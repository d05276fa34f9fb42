"""N-gram Jaccard join by chosen paths: all texts whose sets of word shingles have a similarity of `threshold` or more.

Texts with equal shingle sets are one class, represented by their smallest id. In each of several runs every
class is split by sampled shared tokens: a path takes a token of the set when the token's hash for this path
is small, so that a similar pair is expected to follow more than one path together. Buckets of up to
`LEAF` classes are compared by brute force; larger ones are split again by tokens that few of their members have, so
a passage in many texts does not hold them together. Members that consist mostly of what many of the bucket have
(near copies, above all) cannot be split so: they are compared in pairs of blocks, spread over tasks, and no
pair is left out. The number of runs follows from the target recall. A pair that meets in several buckets is
compared in the first one that both share.

A 32-value minwise sketch rejects what is far from similar; sizes and sets decide the rest exactly. Texts
are sent only for classes that have a partner in their sketch, pairs never leave a task: a task gives, for each class,
the number of its links and one link of a spanning forest.

Null and empty texts have no shingle and are copies of each other; a text of fewer words than a shingle is one
shingle. Rows that share an id are one document (their classes are taken together); rows with a null id are
given back without a class. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.llm.components import components
from lodebook.session import materialize, ship_package

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
EAGER = 1.6  # expected number of common paths of a pair at the threshold, per token taken
POOL = 8.0  # tokens of each run that are kept for further splits
LEAF, BLOCK, DEPTH = 256, 1000, 4
PORTION = 1000  # members of a large bucket that are counted together
COMMON = 0.3  # share of a bucket's members from which a token is no good for splitting it
HEAVY = 0.6  # share of such tokens from which a member is compared with all others like it
TAKEN = 3.0  # other tokens that a member follows further
SKETCH = 32
SMALL = 24  # rows of a group up to which many groups are compared at once
SKETCH_LEAST = 0.5  # share of equal sketch values below which a pair at the threshold is practically excluded
_MULTIPLY = arrays.mix(np.arange(101, 101 + SKETCH, dtype=np.uint64)) | np.uint64(1)
_RUN_SEED = arrays.mix(np.arange(901, 1001, dtype=np.uint64))


def runs_for(recall: float, eager: float = EAGER, splits: int = 3) -> int:
    """Runs after which a pair at the threshold has met with the wanted probability, even after some splits."""
    survive = 1.0
    for _ in range(splits):
        survive = 1 - math.exp(-eager * survive)
    return math.ceil(math.log(1 - recall) / math.log(1 - survive))


PROFILE = ("doc_id long, d1 long, d2 long, size int, sketch binary, "
           "pool array<struct<run:int,token:long,first:boolean>>")
_POOL_TYPE = pa.struct([("run", pa.int32()), ("token", pa.int64()), ("first", pa.bool_())])


def _profile(texts: pa.Array, runs: int, threshold: float) -> list[pa.Array]:
    d1s, d2s, sizes, sketches, pools = [], [], [], [], []
    for _, _, data, offsets in arrays.blocks(arrays.lowered(texts)):
        keys, bounds = arrays.shingle_sets(data, offsets, WORDS)
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        count = len(n)
        d1, d2 = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
        sketch = np.zeros((count, SKETCH), np.uint16)
        owner = np.repeat(np.arange(count), n)
        run_parts, doc_parts, token_parts, first_parts = [], [], [], []
        if len(full):
            at = bounds[:-1][full]
            d1[full] = np.add.reduceat(arrays.mix(keys), at)
            d2[full] = np.add.reduceat(arrays.mix(keys ^ np.uint64(0x5DEECE66D)), at)
            for k in range(SKETCH):
                sketch[full, k] = np.minimum.reduceat(keys * _MULTIPLY[k], at) >> np.uint64(48)
            share = np.minimum(1.0, POOL / np.maximum(n, 1))[owner]
            eager = np.minimum(1.0, EAGER / (threshold * np.maximum(n, 1)))[owner]
            for r in range(runs):
                u = arrays.mix(keys ^ _RUN_SEED[r]) * 2.0**-64
                chosen = np.flatnonzero(u < share)
                run_parts.append(np.full(len(chosen), r, np.int32))
                doc_parts.append(owner[chosen])
                token_parts.append(keys[chosen])
                first_parts.append(u[chosen] < eager[chosen])
            docs = np.concatenate(doc_parts)
            order = np.argsort(docs, kind="stable")
            cuts = np.searchsorted(docs[order], np.arange(count + 1))
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(run_parts)[order]), pa.array(np.concatenate(token_parts)[order].astype(np.int64)),
                 pa.array(np.concatenate(first_parts)[order])], fields=list(_POOL_TYPE))
        else:
            cuts, flat = np.zeros(count + 1, np.int64), pa.array([], _POOL_TYPE)
        pools.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), flat))
        d1s.append(d1.view(np.int64))
        d2s.append(d2.view(np.int64))
        sizes.append(n.astype(np.int32))
        sketches.append(pa.array([row.tobytes() for row in sketch], pa.binary()))
    if not sizes:
        return [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(_POOL_TYPE))]
    return [pa.array(np.concatenate(d1s)), pa.array(np.concatenate(d2s)), pa.array(np.concatenate(sizes)),
            pa.concat_arrays(sketches), pa.concat_arrays(pools)]


def profiles(docs: DataFrame, runs: int, threshold: float) -> DataFrame:
    """Digest of the shingle set, its size, sketch and sampled tokens of every row; no shuffle."""
    names = [c.split()[0] for c in PROFILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays(
                    [arrays.column(part, "doc_id"), *_profile(arrays.column(part, "text"), runs, threshold)], names)

    return docs.mapInArrow(run, PROFILE)


def common_tokens(own: DataFrame) -> DataFrame:
    """(bucket, common): the tokens that at least COMMON of the members of a bucket (bucket, rep, n, tokens) have.

    A bucket is dealt by hash into portions of about PORTION members. Each task counts all tokens of its portions and gives
    those that reach two thirds of the share there; what falls short in a portion cannot reach it in the bucket, but for
    chances beyond six standard deviations. So few rows leave the tasks however many members share a passage.
    """
    portions = F.ceil(F.col("n") / PORTION)
    dealt = _dealt(own.select("bucket", F.pmod(F.xxhash64("rep", F.lit(11)), portions).cast("int").alias("low"),
                              F.lit(0).alias("high"), "rep", "n", "tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, low, high, n, tokens in _groups(batches, ["bucket", "low", "high", "n", "tokens"]):
            bucket, low, high, n = (c.to_numpy() for c in (bucket, low, high, n))
            bounds = _bounds(bucket, low, high)
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            owner = np.repeat(group, np.diff(tokens.offsets.to_numpy()))
            values = tokens.flatten().to_numpy()
            order = np.lexsort((values, owner))
            owner, values = owner[order], values[order]
            if not len(owner):
                continue
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])]))
            counts = np.diff(np.append(first, len(owner)))
            good = counts >= COMMON * 2 / 3 * np.diff(bounds)[owner[first]]
            at = bounds[:-1][owner[first][good]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[at]), pa.array(values[first][good]), pa.array(counts[good].astype(np.int64)), pa.array(n[at])],
                ["bucket", "token", "c", "n"])

    counted = dealt.mapInArrow(count, "bucket long, token long, c long, n long").groupBy("bucket", "token").agg(
        F.sum("c").alias("c"), F.first("n").alias("n"))
    return (counted.where(F.col("c") >= COMMON * F.col("n")).groupBy("bucket")
            .agg(F.collect_list("token").alias("common")))


def leaf_buckets(classes: DataFrame, leaf: int = LEAF, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """(bucket, rep, blocks): buckets of at least two classes; blocks is 1, or more for a group compared in blocks."""
    frontier = (classes.select("rep", F.explode(F.filter("pool", lambda t: t["first"])).alias("t"))
                .select(F.xxhash64("t.run", "t.token").alias("bucket"), F.col("t.run").alias("run"), "rep").distinct())
    leaves: list[DataFrame] = []
    for level in range(1, depth + 1):
        sizes = frontier.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("bucket", "b")
        counted = materialize(frontier.join(sizes, F.col("bucket") == F.col("b")).select("bucket", "run", "rep", "n"),
                              f"paths-{level}")
        last = level == depth
        small = F.col("n") <= leaf
        leaves.append(counted.where(small).select("bucket", "rep", F.lit(1).alias("blocks")))
        large = counted.where(~small)
        if last:
            leaves.append(large.select("bucket", "rep", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
        if last or large.isEmpty():
            break
        if level == 1:
            # Tokens of one passage make buckets of nearly the same members: in each run a member goes on from one of them.
            large = large.groupBy("run", "rep").agg(F.min_by(F.struct("bucket", "n"), F.xxhash64("bucket", F.lit(9))).alias("b")).select(
                "b.bucket", "run", "rep", "b.n")
        own = large.join(classes.select("rep", "pool"), "rep").select(
            "bucket", "run", "rep", "n", F.transform(F.filter("pool", lambda t: t["run"] == F.col("run")),
                                                     lambda t: t["token"]).alias("tokens"))
        # Tokens of many members do not split their bucket.
        common = common_tokens(own)
        # Written, so that this join ends its stage and a bucket of very many members can be split.
        rest = materialize(
            own.join(common, "bucket", "left")
            .withColumn("rest", F.array_except("tokens", F.coalesce("common", F.array().cast("array<bigint>"))))
            .select("bucket", "run", "rep", "rest", (F.size("rest") <= (1 - HEAVY) * F.size("tokens")).alias("heavy")), f"rest-{level}")
        # Members that have little besides them may be similar by them alone: all such pairs are compared.
        heavy = rest.where("heavy").select("bucket", "rep")
        many = heavy.groupBy(F.col("bucket").alias("b")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n"))
        leaves.append(heavy.join(many.where("n > 1"), F.col("bucket") == F.col("b"))
                      .select(F.xxhash64("bucket", F.lit("heavy")).alias("bucket"), "rep", "blocks"))

        def chosen(token: Column) -> Column:
            draw = F.pmod(F.xxhash64(F.col("bucket"), token, F.lit(5)), F.lit(1_000_000))
            return draw * F.size("rest") < int(TAKEN * 1_000_000)

        frontier = (rest.select("bucket", "run", "rep", F.explode(F.filter("rest", chosen)).alias("token"))
                    .select(F.xxhash64("bucket", "token").alias("bucket"), "run", "rep").distinct())
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    return found


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], most_bytes: int = 1 << 25) -> Iterator[list[np.ndarray]]:
    """Whole groups of sorted rows (by bucket, low, high), several small ones together, as arrays of objects or numbers."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(rows: pa.Table, final: bool) -> tuple[pa.Table, pa.Table]:
        if final or not rows.num_rows:
            return rows, rows.slice(rows.num_rows)
        keys = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        return rows.slice(0, first), rows.slice(first)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            ready, rest = cut(pa.Table.from_batches(held), False)
            if ready.num_rows:
                yield [ready.column(c).combine_chunks() for c in columns]
            held, size = rest.to_batches(), 0
    if held:
        ready, _ = cut(pa.Table.from_batches(held), True)
        if ready.num_rows:
            yield [ready.column(c).combine_chunks() for c in columns]


def _bounds(bucket: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
    return np.concatenate([[0], change, [len(bucket)]])


class _Members:
    """Rows of whole groups: what decides which pairs are to be compared."""

    def __init__(self, columns: list[pa.Array], threshold: float):
        bucket, low, high, block, rep, size, sketch, leaves = columns[:8]
        self.bucket = bucket.to_numpy()
        self.low, self.high, self.block = low.to_numpy(), high.to_numpy(), block.to_numpy()
        self.rep, self.size = rep.to_numpy(), size.to_numpy()
        self.sketch = np.frombuffer(b"".join(sketch.to_pylist()), np.uint16).reshape(-1, SKETCH)
        sizes = np.diff(leaves.offsets.to_numpy())
        flat = leaves.flatten().to_numpy()
        # Sorted lists, padded with values that no other row has.
        self.leaves = np.full((len(sizes), max(1, int(sizes.max()))), 0, np.int64)
        self.count = sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.leaves[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        self.threshold = threshold

    def pairs(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one group that may be similar and belong to this bucket and pair of blocks."""
        a_all, b_all = [], []
        blocks = self.block[first:last]
        crossing = self.low[first] != self.high[first]
        for a in range(first, last - 1):
            rest = slice(a + 1, last)
            good = np.minimum(self.size[rest], self.size[a]) >= self.threshold * np.maximum(self.size[rest], self.size[a])
            good &= self.rep[rest] != self.rep[a]
            if crossing:
                good &= blocks[a + 1 - first:] != self.block[a]
            at = np.flatnonzero(good) + a + 1
            if len(at):
                near = (self.sketch[at] == self.sketch[a]).sum(1) >= SKETCH_LEAST * SKETCH
                at = at[near]
            if len(at):
                at = at[self._first_common(a, at) == self.bucket[a]]
            if len(at):
                a_all.append(np.full(len(at), a))
                b_all.append(at)
        if not a_all:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(a_all), np.concatenate(b_all)

    def all_pairs(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for all groups of at most `SMALL` rows at once."""
        sizes = np.diff(bounds)
        end = np.repeat(bounds[1:], sizes)
        rows = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, SMALL):
            rows = rows[rows + step < end[rows]]
            if not len(rows):
                break
            a, b = rows, rows + step
            good = np.minimum(self.size[a], self.size[b]) >= self.threshold * np.maximum(self.size[a], self.size[b])
            good &= self.rep[a] != self.rep[b]
            good &= (self.low[a] == self.high[a]) | (self.block[a] != self.block[b])
            a, b = a[good], b[good]
            near = (self.sketch[a] == self.sketch[b]).sum(1) >= SKETCH_LEAST * SKETCH
            a, b = a[near], b[near]
            first = np.array([self._first_common(x, np.array([y]))[0] for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
            own = first == self.bucket[a]
            a_all.append(a[own])
            b_all.append(b[own])
        return np.concatenate(a_all), np.concatenate(b_all)

    def _first_common(self, a: int, others: np.ndarray) -> np.ndarray:
        """The smallest bucket that row a shares with each of the others."""
        own = self.leaves[a, :self.count[a]]
        lists = self.leaves[others]
        inside = np.isin(lists, own) & (np.arange(lists.shape[1]) < self.count[others][:, None])
        return np.where(inside, lists, np.iinfo(np.int64).max).min(1)


MEMBER = ["bucket", "low", "high", "block", "rep", "size", "sketch", "leaves"]
MEMBER_SCHEMA = "bucket long, low int, high int, block int, rep long, size int, sketch binary, leaves array<long>"


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "rep")


def candidates(members: DataFrame, threshold: float) -> DataFrame:
    """The rows of `members` that have a possible partner in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, MEMBER):
            m = _Members(columns, threshold)
            bounds = _bounds(m.bucket, m.low, m.high)
            active = np.zeros(len(m.rep), bool)
            a, b = m.all_pairs(bounds)
            active[a] = active[b] = True
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if last - first > SMALL:
                    a, b = m.pairs(first, last)
                    active[a] = active[b] = True
            if active.any():
                keep = pa.array(np.flatnonzero(active))
                yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns], MEMBER)

    return _dealt(members.select(*MEMBER)).mapInArrow(run, MEMBER_SCHEMA)


def _similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(a) > 4 * len(sets):
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        both = np.zeros((len(sets), len(sets)), np.float32)
        row = np.repeat(np.arange(len(sets)), sizes)
        for at in range(0, len(every), 4096):  # in slices, so that the matrix stays small
            good = (place >= at) & (place < at + 4096)
            part = np.zeros((len(sets), min(4096, len(every) - at)), np.float32)
            part[row[good], place[good] - at] = 1
            both += part @ part.T
        common = both[a, b].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    return common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep, other, links): per group and class its links to others of the group, and one link of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, [*MEMBER, "text"]):
            m = _Members(columns, threshold)
            texts = columns[-1]
            bounds = _bounds(m.bucket, m.low, m.high)
            reps: list[int] = []
            others: list[int] = []
            counts: list[int] = []
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if last - first < 2:
                    continue
                a, b = m.pairs(first, last)
                if not len(a):
                    continue
                sets = []
                for _, _, data, offsets in arrays.blocks(arrays.lowered(texts.slice(first, last - first))):
                    keys, cuts = arrays.shingle_sets(data, offsets, WORDS)
                    sets += [keys[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                good = _similar(sets, a - first, b - first, threshold)
                a, b = a[good], b[good]
                links = np.bincount(a - first, minlength=last - first) + np.bincount(b - first, minlength=last - first)
                root = list(range(last - first))

                def find(x: int, root: list[int] = root) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for x, y in zip((a - first).tolist(), (b - first).tolist(), strict=True):
                    x, y = find(x), find(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                for k in np.flatnonzero(links).tolist():
                    reps.append(int(m.rep[first + k]))
                    others.append(int(m.rep[first + find(k)]))
                    counts.append(int(links[k]))
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(others, pa.int64()), pa.array(counts, pa.int64())],
                                                 ["rep", "other", "links"])

    return _dealt(rows.select(*MEMBER, "text")).mapInArrow(run, "rep long, other long, links long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id, set_id and n_links.

    set_id is the smallest id with the same shingle set, n_links the number of other sets whose similarity to it
    reaches the threshold, class_id the smallest id of all that such links connect.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(profiles(texts, runs_for(recall), threshold), "join-profiles")
    known = rows.where(F.col("doc_id").isNotNull())
    classes = materialize(
        known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("size", "sketch", "pool"), "doc_id").alias("s"))
        .select("d1", "d2", "rep", "s.size", "s.sketch", "s.pool"), "join-classes")
    nodes = classes.where("size > 0")
    leaves = leaf_buckets(nodes).distinct()
    lists = leaves.groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("bucket", "blocks"))).alias("places"))
    blocks = F.col("p.blocks")
    # Rows that share an id would have two lists; one of them is enough.
    block = F.pmod(F.xxhash64("rep", F.lit(3)), blocks.cast("long")).cast("int")
    member = (nodes.select("rep", "size", "sketch", "d1", "d2").join(lists, "rep")
              .select("rep", "size", "sketch", F.transform("places", lambda p: p["bucket"]).alias("leaves"),
                      F.explode("places").alias("p"))
              .select("rep", "size", "sketch", "leaves", F.col("p.bucket").alias("bucket"), block.alias("block"),
                      F.explode(F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))).alias("k"))
              .withColumns({"low": F.least("block", "k"), "high": F.greatest("block", "k")}))
    active = materialize(candidates(member, threshold), "join-candidates")
    with_text = active.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    links = materialize(verified(with_text, threshold), "join-links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    labels = components(links.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    sets = (classes.select("d1", "d2", "rep").join(counts, "rep", "left")
            .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .select("d1", "d2", F.col("rep").alias("set_id"), F.coalesce("label", "rep").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))
    found = known.select("doc_id", "d1", "d2").join(sets, ["d1", "d2"]).select("doc_id", "class_id", "set_id", "n_links")
    unknown = rows.where(F.col("doc_id").isNull()).select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("set_id"),
        F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(unknown)
