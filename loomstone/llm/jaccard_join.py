"""N-gram Jaccard join: set relations let an index join skip blocks of its lists and whole answers.

Two sets are linked when their Jaccard similarity, shared / united, is that of the call's Likeness or
more: three words and 0.9 unless said otherwise. Every set is ordered
by how many documents hold its tokens, rarest first; two linked sets share a token of their prefixes,
which index lists collect. Sizes, and a token's positions in both sets, bound what two sets can share:

* index-level skipping: a list's entries stand by size, position and component, and those that agree in
  them are a block. Whether two blocks can hold a linked pair is settled once, by size and position,
  and the rest are skipped without looking at their entries;
* answer-level skipping: sets that are known to be connected answer for each other. Equal sets are
  one node. Close neighbours in the lists are verified first, which joins near copies in a number of
  comparisons that grows with their number and not its square. After that blocks of one component are
  skipped together, and all pairs of different components are looked at.

A pair is verified in three steps that lose nothing. Parity sketches differ in no more bits than the
sets in elements: folded to 256 bits they settle most pairs that are not linked before these leave a
list, in full size most of the others, and what is left is counted exactly. A list of more than LIST_BLOCK entries is dealt over many tasks, every two
of its blocks to one. Tokens are 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import shared, textkit
from loomstone.llm.components import components

SHINGLE = 3
#: Frequencies are counted in this many classes of hashes, whatever the corpus.
CLASSES = 1 << 16
SKETCH_BITS = 256
#: Entries of a list that one task holds against each other.
LIST_BLOCK = 512
#: Places that the first pass looks ahead in a list.
REACH = 2
#: Pairs of entries whose sketches are held in memory at a time.
EXPANDED = 1 << 16
BROADCAST_BYTES = 24 << 20
#: Rows that hold whole sets or texts go to Python in batches of so many.
WIDE_ROWS = 256


class Likeness(NamedTuple):
    """When two texts are linked: the words of a shingle and the least similarity, as a ratio of whole numbers."""

    shingle: int = SHINGLE
    numerator: int = 9
    denominator: int = 10

    def prefix_size(self, n: int) -> int:
        return n - -(-self.numerator * n // self.denominator) + 1

    def least_shared(self, sizes: np.ndarray) -> np.ndarray:
        """The shared tokens that a link needs, such as ceil(9 (a + b) / 19), of the sum of two sizes."""
        return -(-self.numerator * sizes // (self.numerator + self.denominator))


#: op6's contract.
CLOSE = Likeness()


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per text): the distinct n-word shingles of each lower-cased text; with fewer words, all words as one."""
    data, offsets = textkit.utf8(column)
    data = textkit.LOWER[data]
    starts, ends, counts = textkit.runs(data, offsets, textkit.NOT_WHITE)
    words = textkit.hashes(data, starts, ends)
    found, each = textkit.grams(words, counts, n)
    begins, at = np.cumsum(counts) - counts, np.cumsum(each) - each
    out = []
    sizes = np.zeros(len(counts), dtype=np.int64)
    for i, (b, c, a, e) in enumerate(zip(begins.tolist(), counts.tolist(), at.tolist(), each.tolist())):
        if not c:
            continue
        own = np.unique(found[a : a + e]) if e else textkit.grams(words[b : b + c], np.array([c]), c)[0] + np.uint64(c)
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.empty(0, np.uint64), sizes


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each class of hashes, whether the set has an odd number of them; twice as many classes as tokens and more, and a power of two."""
    bits = max(SKETCH_BITS, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((textkit.mix(hashes) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int = SKETCH_BITS // 64) -> np.ndarray:
    """The sketch for fewer classes."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _class_counts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES, dtype=np.int64)
    for batch in textkit.slices(batches, "text"):
        hashes, _ = shingle_sets(batch.column("text"), n)
        total += np.bincount((hashes & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["class", "n"])


def _ordered(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Tokens as numbers whose order is rarest class first; a bijection of the hashes."""
    return (rank[(hashes & np.uint64(CLASSES - 1)).astype(np.int64)] << np.uint64(48)) | (hashes >> np.uint64(16))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(textkit.utf8(column)[0].tobytes(), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)


def _spans(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that agree in all columns begin."""
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def _ends(key: np.ndarray) -> np.ndarray:
    """For each row the place after its run of equal keys."""
    starts = _spans(key)
    return np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)]))


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)


def neighbours(key: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, component: np.ndarray, like: Likeness) -> np.ndarray:
    """Pairs of entries at most REACH places apart in a list that may link; entries stand by list and size.

    What precedes the token in both sets counts as shared too, since pairs are taken from any list.
    """
    n, place = n.astype(np.int64), place.astype(np.int64)
    end, i, found = _ends(key), np.arange(len(key)), []
    for d in range(1, REACH + 1):
        i = i[i + d < end[i]]
        i = i[like.denominator * n[i] >= like.numerator * n[i + d]]
        j = i + d
        most = np.minimum(n[i] - place[i], n[j] - place[j]) + np.minimum(place[i], place[j])
        ok = (component[i] != component[j]) & (most >= like.least_shared(n[i] + n[j]))
        found.append(np.sort(np.stack([node[i[ok]], node[j[ok]]]), axis=0))
    return _distinct(found)


def block_pairs(key: np.ndarray, side: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, component: np.ndarray, sketch: np.ndarray, like: Likeness) -> tuple[np.ndarray, int]:
    """(pairs that may link and aren't of one component, entries held against each other for them).

    Entries stand by list, size, place, component and side. Those that agree in all five are a block, and
    what tells two entries apart tells two blocks apart: a block is skipped as a whole when its size is
    too large, when too few tokens follow its place for the two to share what they need, when its
    component is the other's, so that one answers for all, or when both are of one side (of a list that is
    dealt over tasks; -1 meets all). Only blocks that are left are opened, EXPANDED pairs at a time.

    In the list of the first token that a pair shares, what follows in both sets holds all it needs: a
    linked pair passes there, so lists of later tokens need not give it again.
    """
    n, place = n.astype(np.int64), place.astype(np.int64)
    starts = _spans(key, n, place, component, side)
    sizes = np.diff(np.r_[starts, len(key)])
    length, at, of, by = n[starts], place[starts], component[starts], side[starts]
    end, i = _ends(key[starts]), np.arange(len(starts))
    found, held, d = [], 0, 0
    while len(i):
        d += 1
        i = i[i + d < end[i]]
        i = i[like.denominator * length[i] >= like.numerator * length[i + d]]
        j = i + d
        least = like.least_shared(length[i] + length[j])
        ok = (np.minimum(length[i] - at[i], length[j] - at[j]) >= least) & (of[i] != of[j]) & ((by[i] != by[j]) | (by[i] < 0))
        left, right, least = i[ok], j[ok], least[ok]
        each = sizes[left] * sizes[right]
        total = np.cumsum(each)
        held += int(total[-1]) if len(total) else 0
        begin = 0
        while begin < len(each):
            before = total[begin] - each[begin]
            stop = max(begin + 1, int(np.searchsorted(total, before + EXPANDED, "right")))
            which = np.repeat(np.arange(begin, stop), each[begin:stop])
            step = textkit.spread(np.zeros(stop - begin, np.int64), each[begin:stop])
            a, b = starts[left[which]] + step // sizes[right[which]], starts[right[which]] + step % sizes[right[which]]
            near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= n[a] + n[b] - 2 * least[which]
            if near.any():
                found.append(np.sort(np.stack([node[a[near]], node[b[near]]]), axis=0))
            begin = stop
    return _distinct(found), held


_PARTNERS = "a long, partners array<long>"


def _partners(pairs: np.ndarray) -> pa.RecordBatch:
    """Sorted distinct pairs as one row for each first entry."""
    starts = np.flatnonzero(np.r_[True, pairs[0, 1:] != pairs[0, :-1]])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, pairs.shape[1]].astype(np.int32)), pa.array(pairs[1]))
    return pa.RecordBatch.from_arrays([pa.array(pairs[0, starts]), lists], names=["a", "partners"])


def distinct_pairs(found: DataFrame) -> DataFrame:
    """(a, b) once each. Two sets that are alike meet in many lists, so their pairs are folded by entry before they become rows."""
    return found.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners")).select("a", F.explode("partners").alias("b"))


def _near_pairs(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Pairs of close neighbours in lists that come in order; those that a batch's end parts are left to the later pass."""
    for batch in batches:
        token, node, n, place, component = (batch.column(c).to_numpy() for c in ("token", "id", "n", "place", "component"))
        pairs = neighbours(token, node, n, place, component, like)
        if pairs.shape[1]:
            yield _partners(pairs)


def _all_pairs(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """All pairs within lists that come in order, each list or pair of blocks together."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def settle(table: pa.RecordBatch) -> pa.RecordBatch | None:
        key = textkit.mix(table.column("token").to_numpy().view(np.uint64)) ^ textkit.mix(table.column("pair").to_numpy().astype(np.uint64) + np.uint64(1))
        pairs, _ = block_pairs(key, *(table.column(c).to_numpy() for c in ("side", "id", "n", "place", "component")), _sketches(table.column("fold")), like)
        return _partners(pairs) if pairs.shape[1] else None

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < 30_000:
            continue
        table = joined()
        token, pair = table.column("token").to_numpy(), table.column("pair").to_numpy()
        last = (token == token[-1]) & (pair == pair[-1])
        tail = int(np.argmax(last))  # the last run may go on
        held, rows = [table.slice(tail)], table.num_rows - tail
        if tail and (out := settle(table.slice(0, tail))) is not None:
            yield out
    if held and (out := settle(joined())) is not None:
        yield out


def _only_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token stands more than once; at a partition's ends, where that isn't known, all."""
    held: pa.RecordBatch | None = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token = batch.column("token").to_numpy()
        twice = np.zeros(len(token), dtype=bool)
        same = token[1:] == token[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        if first:
            twice[token == token[0]] = True
            first = False
        tail = int(np.searchsorted(token, token[-1]))  # the last run waits for the next batch
        held = batch.slice(tail)
        if twice[:tail].any():
            yield batch.slice(0, tail).filter(pa.array(twice[:tail]))
    if held is not None:
        yield held


class _Join:
    """The state of one join: nodes, index lists and links found so far."""

    def __init__(self, spark: SparkSession, documents: DataFrame, like: Likeness) -> None:
        self.spark = spark
        self.documents = documents
        self.like = like
        self.parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        classes = documents.select("text").mapInArrow(lambda it: _class_counts(it, like.shingle), "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(CLASSES, dtype=np.int64)
        for r in classes:
            counts[r["class"]] = r["n"]
        rank = np.empty(CLASSES, dtype=np.uint64)
        rank[np.argsort(counts, kind="stable")] = np.arange(CLASSES, dtype=np.uint64)
        self.rank = spark.sparkContext.broadcast(rank)  # 512 KB, whatever the corpus
        self._read_documents()

    def _read_documents(self) -> None:
        rank, like = self.rank, self.like

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in textkit.slices(batches, "text"):
                hashes, sizes = shingle_sets(batch.column("text"), like.shingle)
                ends = np.cumsum(sizes)
                name, prefix, sketch, fold = [], [], [], []
                for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                    own = hashes[a:b]
                    if not len(own):
                        name.append(None)
                        prefix.append(None)
                        sketch.append(None)
                        fold.append(None)
                        continue
                    spread = textkit.mix(own)
                    name.append(np.array([spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(textkit.mix(spread + np.uint64(1)))], dtype=np.uint64).tobytes())
                    prefix.append(np.sort(_ordered(own, rank.value))[: like.prefix_size(len(own))].view(np.int64).tobytes())
                    odd = parity_sketch(own)
                    sketch.append(odd.tobytes())
                    fold.append(folded(odd).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dk"), pa.array(sizes), pa.array(name, pa.binary()), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary()), pa.array(fold, pa.binary())], names=["doc_id", "dk", "n", "name", "prefix", "sketch", "fold"])

        kind = self.documents.schema["doc_id"].dataType.simpleString()
        fields = f"doc_id {kind}, dk long, n long, name binary, prefix binary, sketch binary, fold binary"
        described = self.documents.select("doc_id", "text", F.xxhash64("text").alias("dk")).mapInArrow(describe, fields)
        with shared.rows_per_batch(self.spark, 4 * WIDE_ROWS):
            self.described = shared.written(self.spark, described, "sets")
        of_set = self.described.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("least_id"), F.min("dk").alias("dk"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("fold").alias("fold"))
        self.nodes = shared.written(self.spark, of_set.withColumn("id", F.monotonically_increasing_id()), "nodes")

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = textkit.utf8(batch.column("prefix"))
                each = np.diff(offsets) // 8
                token = np.ascontiguousarray(raw).view(np.int64)
                place = textkit.spread(np.zeros(len(each), np.int64), each)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(batch.column("id").to_numpy(), each)), pa.array(np.repeat(batch.column("n").to_numpy(), each).astype(np.int32)), pa.array(place.astype(np.int32))], names=["token", "id", "n", "place"])

        fields = "token long, id long, n int, place int"
        entries = self.nodes.select("id", "n", "prefix").mapInArrow(lists, fields)
        ordered = entries.repartitionByRange(self.parts, "token", "n", "id").sortWithinPartitions("token", "n", "id")
        self.lists = shared.written(self.spark, ordered.mapInArrow(_only_shared, fields), "lists")
        self.links = self.labels = None

    def labelled(self, *more: str) -> DataFrame:
        """The lists with each node's component so far, and other columns of the nodes."""
        of_node = self.nodes.select("id", *more)
        if self.labels is None:
            marked = of_node.withColumn("component", F.col("id"))
        else:
            marked = of_node.join(self.labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if not more and self.labels is None:
            return self.lists.withColumn("component", F.col("id"))
        return self.lists.join(marked, "id")

    def join_neighbours(self) -> None:
        """Verify close neighbours of each list as it was written, by size."""
        like = self.like
        candidates = distinct_pairs(self.labelled().select("token", "id", "n", "place", "component").mapInArrow(lambda it: _near_pairs(it, like), _PARTNERS))
        self.verify(candidates)

    def join_rest(self) -> None:
        """Verify all pairs of list entries of different components."""
        like = self.like
        large = self.lists.groupBy("token").agg(F.count("*").alias("size")).filter(F.col("size") > LIST_BLOCK)
        rows = self.labelled("fold").join(large, "token", "left")
        blocks = F.ceil(F.col("size") / LIST_BLOCK).cast("int")
        mine = F.pmod(F.xxhash64(F.lit(2), "id"), blocks).cast("int")
        # Every two blocks of a large list meet in one task, and each block with itself.
        meets = F.when(F.col("size").isNotNull(), F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct((F.least(mine, j) * blocks + F.greatest(mine, j)).alias("pair"), F.when(j != mine, mine).otherwise(F.lit(-1)).alias("side"))))
        alone = F.array(F.struct(F.lit(0).alias("pair"), F.lit(-1).alias("side")))
        dealt = rows.select("token", "id", "n", "place", "component", "fold", F.explode(F.coalesce(meets, alone)).alias("m")).select("token", "m.pair", "m.side", "id", "n", "place", "component", "fold")
        grouped = dealt.repartition(self.parts, "token", "pair").sortWithinPartitions("token", "pair", "n", "place", "component", "side")
        self.verify(distinct_pairs(grouped.mapInArrow(lambda it: _all_pairs(it, like), _PARTNERS)))

    def _sized(self, left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
        return left.join(F.broadcast(right) if shared.stored_bytes(self.spark, right) <= BROADCAST_BYTES else right, key, how)

    def verify(self, pairs: DataFrame) -> None:
        """Count what pairs (a, b) share, keep those that are linked and label the components anew."""
        spark, like = self.spark, self.like
        side = lambda s: self.nodes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
        sketched = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda it: _within_sketch(it, like), "a long, b long")
        likely = shared.written(spark, sketched, "likely")
        ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
        wanted = shared.written(spark, ends.join(self.nodes.select("id", "dk"), "id").select("id", "dk"), "wanted")
        texts = self._sized(self.documents.select(F.xxhash64("text").alias("dk"), "text"), wanted, "dk").select("id", "text")
        # One exchange by id folds copies and serves both sides of the join.
        sets = texts.mapInArrow(lambda it: _set_rows(it, like.shingle), "id long, tokens binary").dropDuplicates(["id"])
        side = lambda s: sets.select(F.col("id").alias(s), F.col("tokens").alias(f"t{s}"))
        linked = likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda it: _linked(it, like), "a long, b long")
        with shared.rows_per_batch(spark, WIDE_ROWS):
            links = shared.written(spark, linked, "linked")
        self.links = links if self.links is None else self.links.unionByName(links)
        self.labels = components(spark, self.links)


def _within_sketch(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))):
            x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            words = min(len(x), len(y))
            apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
            keep.append(apart <= na + nb - 2 * int(like.least_shared(na + nb)))
        if any(keep):
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _set_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in textkit.slices(batches, "text"):
        hashes, sizes = shingle_sets(batch.column("text"), n)
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([hashes[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())], pa.binary())], names=["id", "tokens"])


def _linked(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
            x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(like.denominator * common >= like.numerator * (len(x) + len(y) - common))
        if any(keep):
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _joined(spark: SparkSession, documents: DataFrame, like: Likeness) -> _Join:
    shared.ship(spark)
    join = _Join(spark, documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), like)
    join.join_neighbours()
    join.join_rest()
    return join


def linked_groups(spark: SparkSession, documents: DataFrame, like: Likeness = CLOSE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `documents` (doc_id, text).

    component_id is the least doc_id that links reach, the row's own included; a null id counts only
    where no other is reached. A text without words, or null, is linked with nothing. Equal rows are
    rows of their own, with one component.
    """
    join = _joined(spark, documents, like)
    labelled = join.nodes.select("id", "name", "least_id").join(join.labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = shared.written(spark, labelled.join(least, "component").select("name", "component_id"), "components")
    rows = join._sized(join.described.select("doc_id", "n", "name"), named, "name", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(spark: SparkSession, documents: DataFrame, like: Likeness = CLOSE) -> DataFrame:
    """`documents` with one row of each linked group: of those with the least id any one with the least text hash.

    Rows are told apart, not ids: equal rows are one group, rows that share an id may be of several, and a
    null id comes after all others. Texts without words are linked with nothing and stay.
    """
    join = _joined(spark, documents, like)
    labelled = join.nodes.select("id", "name").join(join.labels, "id", "left").select("name", F.coalesce("component", "id").alias("component"))
    rows = join.described.filter("n > 0").select("doc_id", "dk", "name").join(labelled, "name")
    copies = shared.written(spark, rows.groupBy("component", "doc_id", "dk").agg(F.count("*").alias("copies")), "copies")
    first = copies.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "dk")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("dk") == F.col("first.dk"))
    judged = copies.join(first, "component").withColumn("stays", stays).filter(~F.col("stays") | (F.col("copies") > 1))
    # Rows that are neither dropped nor repeated, most of them, meet this table and go on as they are.
    judged = shared.written(spark, judged.select(F.col("doc_id").alias("__id"), F.col("dk").alias("__dk"), F.col("stays").alias("__stays")), "judged")
    small = shared.stored_bytes(spark, judged) <= BROADCAST_BYTES
    keyed = documents.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    marked = keyed.join(F.broadcast(judged) if small else judged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__dk")), "left")
    repeated = marked.filter("__stays").dropDuplicates(["doc_id", "__key"])
    return marked.filter("__stays is null").unionByName(repeated).drop("__key", "__id", "__dk", "__stays")
