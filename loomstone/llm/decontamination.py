"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edits.

Texts and items are words; a character of a script without spaces is a word of its own. A random walk
embeds a string of words: at each step it writes the word it stands on and steps on or stays, as a
shared random function of step and word says. Strings within few edits then agree at many steps
(Chakraborty, Goldenberg and Koucky, 2016). Windows of an item's size are embedded by several walks, a
few sampled steps of a walk make a bucket key, and a window that shares a bucket with an item is
aligned with it exactly: the least word edit distance between the item and any stretch of the text
around the window. Only steps at which most walks still stand in the string are sampled, and a key
with a step past the end meets nothing, so unrelated windows share no bucket.

A window within k edits of an item of n words shares n // (k + 1) words in a row with it, at places
that differ by k at most. So only windows that such a run aligns with an item's place are embedded;
none that could match is left out by that. Windows are told apart by text, start and size, not by
item, so a run that many items share gives one window and not one for each of them. An item that
allows for no edit, of fewer than five words at the usual similarity, is its own run.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomstone.llm import shared, textkit

SIMILARITY = 0.8
#: Walks, tables for each walk and steps sampled for a table. `measured_rates` gives a recall of 0.95 and more for pairs at the threshold.
WALKS, TABLES, SAMPLED = 16, 4, 2
#: Words of items that one pass over the texts takes; more items take more passes.
BLOCK_WORDS = 1_000_000
#: Windows that are embedded at once, and pairs of window and item that are aligned at once.
_WINDOWS, _PAIRS = 2_000, 50_000
_SEED = 0x2545F4914F6CDD1D


@dataclass
class Items:
    """A block of items, ready to be looked for."""

    ids: list
    words: list[np.ndarray]
    edits: np.ndarray
    #: For each length of run: sorted hashes of the runs, with the size of an item that holds it and its place there, once each.
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: For each length, items without edits: sorted hashes of the whole item, and the item.
    exact: dict[int, tuple[np.ndarray, np.ndarray]]
    #: For each size of the others: the items, their words as a matrix, and for each table their sorted keys and order.
    sizes: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, words per text, starts, ends) of the lower-cased letter and digit runs."""
    data, offsets = textkit.utf8(pc.utf8_lower(column))
    starts, ends, counts = textkit.runs(data, offsets, textkit.ALNUM, textkit.unspaced(data))
    return textkit.hashes(data, starts, ends), counts, starts, ends


def steps_of(n: int) -> int:
    """How many steps of a walk over n words are sampled from; it moves on every second step, so ends after 2 n."""
    return n + n // 2


@lru_cache(maxsize=4096)
def sampled_steps(n: int) -> np.ndarray:
    """(walk, table, sample): the steps that make the bucket keys of strings of n words."""
    most = steps_of(n)
    out = np.empty((WALKS, TABLES, min(SAMPLED, most)), dtype=np.int64)
    for walk in range(WALKS):
        draw = np.random.default_rng([walk, n])
        for table in range(TABLES):
            out[walk, table] = draw.choice(most, size=out.shape[2], replace=False)
    return out


def embed(rows: np.ndarray, sizes: np.ndarray, steps: int) -> np.ndarray:
    """(row, walk, step): the words that each walk writes; 0 past a row's size, and rows are 0 there."""
    m = len(rows)
    padded = np.concatenate([rows, np.zeros((m, 1), np.uint64)], axis=1)
    every, last = np.arange(m)[:, None], sizes[:, None]
    at = np.zeros((m, WALKS), dtype=np.int64)
    walks = np.arange(WALKS, dtype=np.uint64) * np.uint64(100_003)
    out = np.empty((steps, m, WALKS), dtype=np.uint64)
    for j in range(steps):
        word = padded[every, at]
        out[j] = word
        step = textkit.mix(word + (walks + np.uint64(j + 1)) * np.uint64(_SEED)) & np.uint64(1)
        at = np.minimum(at + step.astype(np.int64), last)
    return out.transpose(1, 2, 0)


def bucket_keys(seen: np.ndarray, n: int) -> np.ndarray:
    """(row, table): the keys of embedded strings of n words; 0 is no bucket."""
    picked = seen[:, np.arange(WALKS)[:, None, None], sampled_steps(n)]
    key = np.broadcast_to((np.arange(WALKS * TABLES, dtype=np.uint64) + np.uint64(1)).reshape(WALKS, TABLES), picked.shape[:3])
    for k in range(picked.shape[3]):
        key = textkit.mix(key + picked[..., k])
    return np.where((picked == 0).any(axis=3), np.uint64(0), key).reshape(len(seen), -1)


def prepare(ids: list, words: list[np.ndarray], similarity: float = SIMILARITY) -> Items:
    edits = np.array([math.floor(round((1 - similarity) * len(w), 9)) for w in words], dtype=np.int64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    runs, exact, sizes = {}, {}, {}
    run_of = size // (edits + 1)
    for q in np.unique(run_of[edits > 0]).tolist():
        some = np.flatnonzero((run_of == q) & (edits > 0))
        hashed, each = textkit.grams(np.concatenate([words[i] for i in some]), size[some], q)
        entry = np.stack([hashed, np.repeat(size[some], each).astype(np.uint64), textkit.spread(np.zeros(len(some), np.int64), each).astype(np.uint64)])
        hashed, n, place = np.unique(entry, axis=1)
        runs[q] = hashed, n.astype(np.int64), place.astype(np.int64)
    for n in np.unique(size[edits == 0]).tolist():
        some = np.flatnonzero((size == n) & (edits == 0))
        hashed = textkit.grams(np.concatenate([words[i] for i in some]), size[some], n)[0]
        order = np.argsort(hashed, kind="stable")
        exact[n] = hashed[order], some[order]
    for n in np.unique(size[edits > 0]).tolist():
        some = np.flatnonzero((size == n) & (edits > 0))
        rows = np.stack([words[i] for i in some])
        keys = np.concatenate([bucket_keys(embed(part, np.full(len(part), n), steps_of(n)), n) for part in np.array_split(rows, -(-len(rows) // _WINDOWS))])
        order = [np.argsort(column, kind="stable") for column in keys.T]
        sizes[n] = some, rows, [(column[o], o) for column, o in zip(keys.T, order)]
    return Items(ids, words, edits, runs, exact, sizes)


def _expand(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of wanted, index of sorted key) of every pair of equals."""
    low, high = np.searchsorted(sorted_keys, wanted), np.searchsorted(sorted_keys, wanted, "right")
    size = high - low
    return np.repeat(np.arange(len(wanted)), size), textkit.spread(low, size)


def infix_distance(items: np.ndarray, regions: np.ndarray, from_start: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(least edits, end) of each row of items against any stretch of its region, or against prefixes of it; the first end of equals."""
    m, width = regions.shape
    steps = np.arange(width + 1, dtype=np.int32)
    cost = np.tile(steps, (m, 1)) if from_start else np.zeros((m, width + 1), dtype=np.int32)
    for i in range(items.shape[1]):
        take = np.empty_like(cost)
        take[:, 0] = i + 1
        take[:, 1:] = np.minimum(cost[:, :-1] + (regions != items[:, i : i + 1]), cost[:, 1:] + 1)
        cost = np.minimum.accumulate(take - steps, axis=1) + steps
    end = cost.argmin(axis=1)
    return cost[np.arange(m), end], end


def _run_hits(hashed: np.ndarray, counts: np.ndarray, q: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, run hash) of the runs of q words of the texts that are among the sorted `keys`."""
    grams, each = textkit.grams(hashed, counts, q)
    # A small table of low bits spares most places the search.
    low = np.zeros(1 << 16, dtype=bool)
    low[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    some = np.flatnonzero(low[(grams & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, grams[some]), len(keys) - 1)
    some = some[keys[at] == grams[some]]
    ends = np.cumsum(each)
    text = np.searchsorted(ends, some, side="right")
    return text, some - (ends - each)[text], grams[some]


def _stretches(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """`width` words from the `first` of each text on, as rows; 0 past its end."""
    at = (begins[text] + first)[:, None] + np.arange(width)
    return np.where(at < ends[text][:, None], words[np.minimum(at, len(words) - 1)], np.uint64(0))


def find(hashed: np.ndarray, counts: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, edits) of the best match of each text and item that match; the leftmost of equals."""
    ends = np.cumsum(counts)
    begins = ends - counts
    found: list[np.ndarray] = []
    for n, (keys, item) in items.exact.items():
        text, place, run = _run_hits(hashed, counts, n, keys)
        first = np.unique(np.stack([text.astype(np.uint64), run]), axis=1, return_index=True)[1]  # the leftmost stands first
        hit, entry = _expand(keys, run[first])
        found.append(np.stack([text[first][hit], item[entry], np.zeros(len(hit), np.int64), place[first][hit], np.full(len(hit), n)]))
    windows = [np.empty((3, 0), np.int64)]
    for q, (keys, n, place) in items.runs.items():
        text, at, run = _run_hits(hashed, counts, q, keys)
        hit, entry = _expand(keys, run)
        windows.append(np.unique(np.stack([text[hit], np.maximum(at[hit] - place[entry], 0), n[entry]]), axis=1))
    text, start, size = np.concatenate(windows, axis=1)
    spare = np.zeros(max(items.sizes, default=0) + 1, dtype=np.int64)
    for n, (members, _, _) in items.sizes.items():
        spare[n] = items.edits[members[0]]
    text, start, size = (x[counts[text] - start >= size - spare[size]] for x in (text, start, size))
    order = np.argsort(size, kind="stable")
    for c in range(0, len(order), _WINDOWS):  # windows of like size together
        part = order[c : c + _WINDOWS]
        widest = int(size[part[-1]])
        rows = _stretches(hashed, begins, ends, start[part], text[part], widest)
        rows[np.arange(widest) >= size[part][:, None]] = 0
        seen = embed(rows, size[part], steps_of(widest))
        for n in np.unique(size[part]).tolist():
            mine = np.flatnonzero(size[part] == n)
            members, words, tables = items.sizes[n]
            keys = bucket_keys(seen[mine], n)
            most = max(1, (1 << 24) // len(members))
            for d in range(0, len(mine), most):
                rows_of = part[mine[d : d + most]]
                met = np.zeros((len(rows_of), len(members)), dtype=bool)
                for key, (sorted_keys, owner) in zip(keys[d : d + most].T, tables):
                    row, entry = _expand(sorted_keys, key)
                    live = key[row] != 0
                    met[row[live], owner[entry[live]]] = True
                window, member = np.nonzero(met)
                k = int(items.edits[members[0]])
                for e in range(0, len(window), _PAIRS):
                    w, i = rows_of[window[e : e + _PAIRS]], member[e : e + _PAIRS]
                    best = _aligned(hashed, begins, ends, text[w], start[w], words[i], n, k)
                    found.append(np.stack([text[w], members[i], *best])[:, best[0] <= k])
    if not found:
        return []
    every = np.concatenate(found, axis=1)
    every = every[:, np.lexsort(every[::-1])]
    once = np.r_[True, (every[:2, 1:] != every[:2, :-1]).any(axis=0)] if every.shape[1] else np.empty(0, bool)
    return [(t, i, begin, length, distance) for t, i, distance, begin, length in every[:, once].T.tolist()]


def _aligned(hashed: np.ndarray, begins: np.ndarray, ends: np.ndarray, text: np.ndarray, start: np.ndarray, items: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, first word, words) of the best stretch around each window against its item; more than k edits may be any number above."""
    first = np.maximum(start - 2 * k, 0)
    region = _stretches(hashed, begins, ends, first, text, n + 4 * k)
    # Of an item's words k at most may lack; that settles most pairs that share a phrase and no more.
    lack = np.zeros(len(region), dtype=np.int64)
    for i in range(n):
        lack += ~(region == items[:, i : i + 1]).any(axis=1)
    edits, begin, length = np.full(len(region), k + 1), np.zeros(len(region), np.int64), np.zeros(len(region), np.int64)
    likely = np.flatnonzero(lack <= k)
    distance, end = infix_distance(items[likely], region[likely])
    good, distance, end = likely[distance <= k], distance[distance <= k], end[distance <= k]
    # The stretch's start: the same alignment read backwards from its end.
    at = end[:, None] - 1 - np.arange(n + k)
    back = np.where(at >= 0, region[good[:, None], np.maximum(at, 0)], np.uint64(0))
    length[good] = infix_distance(items[good][:, ::-1], back, from_start=True)[1]
    edits[good] = distance
    begin[good] = first[good] + end - length[good]
    return edits, begin, length


def item_blocks(spark: SparkSession, benchmark: DataFrame, similarity: float, block_words: int | None = None) -> Iterator[Items]:
    """The items in blocks of bounded size. Texts without words, and all but one of the rows with equal id and words, are left out."""
    kind = benchmark.schema["item_id"].dataType

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, "text"):
            hashed, counts, _, _ = tokens(batch.column("text"))
            bounds = pa.py_buffer(np.r_[0, np.cumsum(counts) * 8].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, bounds, pa.py_buffer(hashed.tobytes())])], names=["item_id", "words"])

    listed = shared.only(benchmark, "item_id", "text").filter(F.col("text").isNotNull()).mapInArrow(worded, f"item_id {kind.simpleString()}, words binary")
    listed = shared.written(spark, listed.filter(F.octet_length("words") > 0).dropDuplicates(["item_id", "words"]), "items")
    ids: list = []
    words: list[np.ndarray] = []
    held = 0
    for row in listed.toLocalIterator():
        ids.append(row["item_id"])
        words.append(np.frombuffer(row["words"], dtype=np.uint64))
        held += len(words[-1])
        if held >= (block_words or BLOCK_WORDS):
            yield prepare(ids, words, similarity)
            ids, words, held = [], [], 0
    if ids:
        yield prepare(ids, words, similarity)


def _leaks_of(cast: Broadcast, fields: pa.DataType) -> Callable:
    def leaks(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = cast.value
        for column in columns:
            out: list[list[dict]] = []
            for part in textkit.slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
                hashed, counts, _, _ = tokens(part.column(0))
                rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for t, i, begin, length, distance in find(hashed, counts, items):
                    rows[t].append({"item_id": items.ids[i], "first_word": begin, "n_words": length, "edits": distance})
                out += rows
            yield pa.array(out, pa.list_(fields))

    leaks.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return leaks


def leak_columns(spark: SparkSession, benchmark: DataFrame, text: Column, similarity: float = SIMILARITY) -> Iterator[Column]:
    """For each block of items a column array<struct<item_id, first_word, n_words, edits>> of the text's matches."""
    shared.ship(spark)
    kind = benchmark.schema["item_id"].dataType
    fields = pa.struct([("item_id", to_arrow_type(kind)), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())])
    for block in item_blocks(spark, benchmark, similarity):
        cast = spark.sparkContext.broadcast(block)  # bounded by BLOCK_WORDS
        yield F.arrow_udf(_leaks_of(cast, fields), f"array<struct<item_id {kind.simpleString()}, first_word long, n_words long, edits long>>")(text)


def leaked(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, first_word, n_words, edits.

    Held means that some stretch of the document's words is within (1 - similarity) * words of the
    item; an item of fewer than five words has to stand as it is. Case and punctuation don't count.
    Null and empty texts hold nothing, and an item without words stands nowhere; repeated documents
    have rows of their own, and repeated items one; no items give no rows.
    """
    texts = shared.only(documents, "doc_id", "text")
    items = shared.only(benchmark, "item_id", "text")
    out = None
    for found in leak_columns(spark, items, F.col("text"), similarity):
        rows = texts.select("doc_id", F.explode(found).alias("leak")).select("doc_id", "leak.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        kinds = ", ".join(f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((texts, "doc_id"), (items, "item_id")))
        out = spark.createDataFrame([], f"{kinds}, first_word long, n_words long, edits long")
    return out


def clean_documents(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`documents` without those that hold an item."""
    clean = F.lit(True)
    for found in leak_columns(spark, shared.only(benchmark, "item_id", "text"), F.col("text"), similarity):
        clean = clean & (F.size(found) == 0)
    return documents.filter(clean)


def measured_rates(n_words: int, edits: int, pairs: int = 500, seed: int = 0) -> tuple[float, float]:
    """The share of random pairs at that many word edits that meet in some bucket, window aligned at its start, and that of unrelated pairs."""
    rng = np.random.default_rng(seed)
    items = rng.integers(1, 2**63, (pairs, n_words), dtype=np.uint64)
    near, far = [], rng.integers(1, 2**63, (pairs, n_words), dtype=np.uint64)
    for item in items:
        other = list(item)
        for _ in range(edits):
            kind, at = rng.integers(3), int(rng.integers(len(other)))
            if kind == 0:
                other[at] = rng.integers(1, 2**63, dtype=np.uint64)
            elif kind == 1:
                del other[at]
            else:
                other.insert(at, rng.integers(1, 2**63, dtype=np.uint64))
        near.append((other + list(rng.integers(1, 2**63, n_words, dtype=np.uint64)))[:n_words])
    mine, *others = (bucket_keys(embed(rows, np.full(pairs, n_words), steps_of(n_words)), n_words) for rows in (items, np.array(near, dtype=np.uint64), far))
    recall, passed = (float(((mine == x) & (mine != 0)).any(axis=1).mean()) for x in others)
    return recall, passed
