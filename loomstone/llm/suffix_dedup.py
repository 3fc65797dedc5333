"""Suffix-array dedup: every byte covered by a 200-byte string that also starts elsewhere is removed.

A suffix array over all bytes would hold almost only suffixes that repeat nothing, so a first pass
drops those without loss. Every window of SPAN bytes owns an anchor: its GRAM-byte substring of least
hash, the leftmost of equals. Equal windows own equal anchors at equal places, so a window whose
anchor's substring stands nowhere else is not repeated. Neighbouring windows with one anchor go as one
row, with a hash of the bytes they span.

1. Anchors are range-partitioned by their leading bytes with splitters from sampled documents, and
   each bucket sorts its rows by multikey quicksort. Equal spans are repeated as a whole. Spans that
   share an anchor but differ are cut into their windows.
2. Those windows, suffixes of the texts, are range-partitioned in the same way by their leading eight
   bytes, and each bucket sorts them by multikey quicksort, leading bytes first. Neighbours that agree
   in all SPAN bytes are repeated.
3. A text's repeated windows, as intervals, are merged and cut out.

With `keep_first`, runs are sorted by text and place too, and the first window of each run isn't
marked. Whatever is cut then has an equal place before it in that order, and so a place that stays.

A splitter never parts equal leading bytes, so no run of equal suffixes crosses a boundary and the
last suffix of a bucket differs from the first of the next. What is common to many texts is folded
before it is sent: a mapper settles spans and windows that it has seen itself and sends one of each,
and equal texts are found by their count and sent once a mapper. Strings beyond the leading bytes are
compared by 64-bit hashes of the whole string, and texts are named by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import shared, textkit

SPAN = 200
GRAM = 125
#: Documents that a sample for splitters takes, about.
SAMPLED = 2_000
#: Text bytes that a mapper folds at a time.
FOLD_BYTES = 4 << 20
#: Table size up to which the marks are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 24 << 20
_PLACE = np.uint64(0xFFFFFF)
_CHUNK = 1 << 23


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Indices that sort rows by the first column, ties by the second and so on.

    Only rows that are still tied are sorted by the next column, as multikey quicksort does with the
    next character of strings that agree so far.
    """
    order = np.argsort(columns[0], kind="quicksort")
    group = np.zeros(len(order), dtype=np.int64)
    for previous, column in zip(columns, columns[1:]):
        value = previous[order]
        group[1:] = np.cumsum((group[1:] != group[:-1]) | (value[1:] != value[:-1]))
        tied = np.zeros(len(order), dtype=bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        order[at] = rows[np.lexsort((column[rows], group[at]))]
    return order


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in sorted columns."""
    first = np.zeros(len(columns[0]), dtype=bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a big-endian number."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k].astype(np.uint64)
    return out


class _Hashes:
    """Hashes of any substring of a buffer, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.multiply(textkit._SYMBOL[data], textkit.powers(textkit._BASE, n), out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)
        self.back = textkit.powers(textkit._INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def windows(self, n: int, size: int) -> np.ndarray:
        return (self.sums[size:n + 1] - self.sums[: n + 1 - size]) * self.back[: n + 1 - size]


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, key, span hash) of each anchor with its run of windows.

    The key is three leading bytes of the anchor and 40 bits of its hash. Windows don't cross texts;
    a text of fewer than `span` bytes has none. The buffer is at most 2**24 bytes.
    """
    n, width = len(data), span - gram + 1
    begins, ends = offsets[:-1], offsets[1:]
    long = ends - begins >= span
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    if n < span or not long.any():
        return none
    hashes = _Hashes(data)
    grams = textkit.mix(hashes.windows(n, gram))
    marked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.full((-(-len(marked) // width) + 1) * width, np.uint64(2**64 - 1))
    blocks[: len(marked)] = marked
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - span + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    start = textkit.spread(begins[long], ends[long] - begins[long] - span + 1)
    place = (least[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(_runs(place) | np.r_[True, start[1:] != start[:-1] + 1])
    last = np.r_[first[1:], len(start)] - 1
    at, low, high = place[first], start[first], start[last]
    key = (leading(data, at) & ~np.uint64((1 << 40) - 1)) | (grams[at] >> np.uint64(24))
    shape = (at - low).astype(np.uint64) * np.uint64(1 << 20) + (high - low).astype(np.uint64)
    return at, low, high, key, textkit.mix(hashes.of(low, high + span) + textkit.mix(shape))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text key of each part, where the part begins in its text); very long texts come in overlapping parts."""
    data, offsets = textkit.utf8(batch.column("text"))
    keys = batch.column("dk").to_numpy(zero_copy_only=False)
    if len(data) <= _CHUNK:
        yield data, offsets, keys, np.zeros(len(keys), np.int64)
        return
    for i in range(len(keys)):
        for start in range(0, max(1, int(offsets[i + 1] - offsets[i]) - SPAN + 1), _CHUNK - SPAN + 1):
            part = data[offsets[i] + start : min(offsets[i + 1], offsets[i] + start + _CHUNK)]
            yield part, np.array([0, len(part)]), keys[i : i + 1], np.array([start])


def merged(low: np.ndarray, high: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals [low, high) of each group, as (low, high, group) in order; touching ones become one."""
    if not len(low):
        return low, high, group
    order = np.lexsort((low, group))
    low, high, group = low[order], high[order], group[order]
    number = np.cumsum(_runs(group))
    reach = int(high.max()) + 1
    top = np.maximum.accumulate(high + number * reach) - number * reach
    first = np.ones(len(low), dtype=bool)
    first[1:] = (group[1:] != group[:-1]) | (low[1:] > top[:-1])
    starts = np.flatnonzero(first)
    return low[starts], top[np.r_[starts[1:], len(low)] - 1], group[starts]


#: Rows between the stages. kind 0: an interval of `dk` that is settled; 1: a row to compare; 2: as 1, and its run is known to be mixed; 3: tells a run that it is mixed.
_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("dk", pa.int64()), ("low", pa.int32()), ("n", pa.int32())])
_ROW_SQL = "bucket int, kind tinyint, a long, b long, dk long, low int, n int"


def _rows(parts: Iterable[tuple]) -> pa.RecordBatch | None:
    """One batch of (bucket, kind, a, b, dk, low, n); scalars stand for whole columns."""
    columns: list[list[np.ndarray]] = [[] for _ in _ROW]
    for part in parts:
        size = max(len(x) for x in part if isinstance(x, np.ndarray))
        for c, x in zip(columns, part):
            c.append(x if isinstance(x, np.ndarray) else np.full(size, x))
    if not columns[0] or not sum(map(len, columns[0])):
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x.view(np.int64) if x.dtype == np.uint64 else x for x in c]).astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _ROW)], schema=_ROW)


def _bucket(key: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    return np.searchsorted(splitters, key, side="right").astype(np.int32)


def _spread_bucket(key: np.ndarray, parts: int) -> np.ndarray:
    return (textkit.mix(key.view(np.uint64) if key.dtype == np.int64 else key) % np.uint64(parts)).astype(np.int32)


def _settled(dk: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int) -> tuple:
    low, high, dk = merged(low, high, dk)
    return _spread_bucket(dk, parts), 0, 0, 0, dk, low, high - low


def _map_anchors(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, parts: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def fold() -> Iterator[pa.RecordBatch]:
        key, span, dk, low, n = (np.concatenate(c) for c in zip(*held))
        order = multikey_order([key, span, dk, low] if keep_first else [key, span])
        key, span, dk, low, n = key[order], span[order], dk[order], low[order], n[order]
        new_key, new_span = _runs(key), _runs(key, span)
        starts = np.flatnonzero(new_span)
        count = np.diff(np.r_[starts, len(key)])
        many = np.repeat(count > 1, count)
        if keep_first:
            many[starts] = False
        spans = np.bincount(np.cumsum(new_key)[starts] - 1)  # distinct spans of each key
        mixed = (spans > 1)[np.cumsum(new_key)[starts] - 1]
        out = []
        if many.any():
            out.append(_settled(dk[many], low[many].astype(np.int64), (low + n)[many].astype(np.int64) + SPAN - 1, parts))
        # n below 0 marks a span that is settled already; one row stands for all of it.
        sent = np.where((count > 1) & (not keep_first), -n[starts], n[starts])
        one = ~mixed
        out.append((_bucket(key[starts][one], splitters), 1, key[starts][one], span[starts][one], dk[starts][one], low[starts][one], sent[one]))
        if mixed.any():
            out.append((_spread_bucket(span[starts][mixed], parts), 2, key[starts][mixed], span[starts][mixed], dk[starts][mixed], low[starts][mixed], sent[mixed]))
            told = np.flatnonzero(mixed & new_key[starts])
            out.append((_bucket(key[starts][told], splitters), 3, key[starts][told], span[starts][told], 0, 0, 0))
        if (batch := _rows(out)) is not None:
            yield batch
        held.clear()

    for batch in textkit.slices(batches, "text"):
        fresh = [i for i, k in enumerate(batch.column("dk").to_pylist()) if not (k in seen or seen.add(k))]
        batch = batch.take(pa.array(fresh, pa.int64()))
        for data, offsets, dk, base in _pieces(batch):
            at, low, high, key, span = anchors(data, offsets)
            if len(at):
                doc = np.searchsorted(offsets, low, side="right") - 1
                held.append((key, span, dk[doc], low - offsets[doc] + base[doc], high - low + 1))
            size += len(data)
        if size >= FOLD_BYTES and held:
            yield from fold()
            size = 0
    if held:
        yield from fold()


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    table = pa.Table.from_batches(list(batches), _ROW)
    if not table.num_rows:
        return None
    return {name: table.column(name).to_numpy() for name in _ROW.names}


def _compare_anchors(batches: Iterator[pa.RecordBatch], keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Settled intervals as kind 0; spans to cut into windows as kind 1."""
    rows = _columns(batches)
    if rows is None:
        return
    out = []
    done = rows["kind"] == 0
    out.append((0, 0, 0, 0, rows["dk"][done], rows["low"][done].astype(np.int64), rows["n"][done]))
    at = np.flatnonzero(~done)
    # Rows of a run that is known to be mixed were dealt by their span and come apart from the others.
    alone = rows["kind"][at] == 2
    for part, known in ((at[~alone], False), (at[alone], True)):
        key, span = rows["a"][part].view(np.uint64), rows["b"][part].view(np.uint64)
        order = multikey_order([key, span, rows["kind"][part] == 3, rows["dk"][part], rows["low"][part]] if keep_first else [key, span])
        part, key, span = part[order], key[order], span[order]
        kind, n, dk, low = (rows[c][part] for c in ("kind", "n", "dk", "low"))
        starts = np.flatnonzero(_runs(key, span))
        if not len(starts):
            continue
        real = (kind != 3).astype(np.int64)
        total = np.add.reduceat(np.where(n < 0, 2, real), starts)
        length = np.diff(np.r_[starts, len(part)])
        repeated = np.repeat(total > 1, length) & (n > 0) & (kind != 3)
        if keep_first:
            repeated &= (dk != np.repeat(dk[starts], length)) | (low != np.repeat(low[starts], length))
        out.append((0, 0, 0, 0, dk[repeated], low[repeated].astype(np.int64), n[repeated] + SPAN - 1))
        if known:
            mixed = np.ones(len(starts), dtype=bool)
        else:
            run = np.cumsum(_runs(key))[starts] - 1
            told = np.bincount(run, np.add.reduceat((kind == 3).astype(float), starts)) > 0
            mixed = ((np.bincount(run) > 1) | told)[run]
        # The first real row of each span stands for it.
        place = np.where(kind != 3, np.arange(len(part)), len(part))
        first = np.minimum.reduceat(place, starts)[mixed]
        first = first[first < len(part)]
        out.append((0, 1, 0, 0, dk[first], low[first].astype(np.int64), np.abs(n[first])))
    if (batch := _rows(o for o in out if len(o[4]))) is not None:
        yield batch


def _map_windows(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, parts: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def fold() -> Iterator[pa.RecordBatch]:
        lead, full, dk, low = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = multikey_order([lead, full, dk, low])
        lead, full, dk, low = lead[order], full[order], dk[order], low[order]
        once = _runs(lead, full, dk, low)  # a text that came twice has its windows once
        lead, full, dk, low = lead[once], full[once], dk[once], low[once]
        starts = np.flatnonzero(_runs(lead, full))
        count = np.diff(np.r_[starts, len(lead)])
        many = np.repeat(count > 1, count)
        if keep_first:
            many[starts] = False
        out = []
        if many.any():
            out.append(_settled(dk[many], low[many], low[many] + SPAN, parts))
        out.append((_bucket(lead[starts], splitters), 1, lead[starts], full[starts], dk[starts], low[starts], np.where((count > 1) & (not keep_first), -1, 1)))
        if (batch := _rows(out)) is not None:
            yield batch

    seen: set[int] = set()
    for batch in textkit.slices(batches, "text"):
        fresh = [i for i, k in enumerate(batch.column("dk").to_pylist()) if not (k in seen or seen.add(k))]
        batch = batch.take(pa.array(fresh, pa.int64()))
        blobs = batch.column("spans").to_pylist()
        spans: dict[int, np.ndarray] = {k: np.frombuffer(s, dtype="<i4").reshape(-1, 2).astype(np.int64) for k, s in zip(batch.column("dk").to_pylist(), blobs)}
        for data, offsets, dk, base in _pieces(batch):
            if len(data) < SPAN:
                continue
            hashes = _Hashes(data)
            for i, k in enumerate(dk.tolist()):
                inside = spans[k]
                begin, end = inside[:, 0] - base[i], inside[:, 0] + inside[:, 1] - base[i]
                begin, end = np.maximum(begin, 0), np.minimum(end, offsets[i + 1] - offsets[i] - SPAN + 1)
                ok = end > begin
                if ok.any():
                    start = textkit.spread(begin[ok], (end - begin)[ok])
                    at = start + offsets[i]
                    held.append((leading(data, at), textkit.mix(hashes.of(at, at + SPAN)), np.full(len(at), k, np.int64), start + base[i]))
                    size += len(at)
        if size >= 400_000 and held:
            yield from fold()
            size = 0
    if held:
        yield from fold()


def _compare_windows(batches: Iterator[pa.RecordBatch], keep_first: bool) -> Iterator[pa.RecordBatch]:
    rows = _columns(batches)
    if rows is None:
        return
    done = rows["kind"] == 0
    at = np.flatnonzero(~done)
    lead, full = rows["a"][at].view(np.uint64), rows["b"][at].view(np.uint64)
    order = multikey_order([lead, full, rows["dk"][at], rows["low"][at]] if keep_first else [lead, full])
    at, lead, full = at[order], lead[order], full[order]
    out = [(0, 0, 0, 0, rows["dk"][done], rows["low"][done].astype(np.int64), rows["n"][done])]
    if len(at):
        starts = np.flatnonzero(_runs(lead, full))
        # A text whose copies came from two mappers has its windows twice; that is one place.
        dk, low, n = rows["dk"][at], rows["low"][at].astype(np.int64), rows["n"][at]
        length = np.diff(np.r_[starts, len(at)])
        group = np.repeat(np.arange(len(starts)), length)
        other = (dk != dk[starts][group]) | (low != low[starts][group])
        repeated = np.bincount(group, other | (n < 0), minlength=len(starts)) > 0
        hit = other if keep_first else repeated[group] & (n > 0)
        low, high, dk = merged(low[hit], low[hit] + SPAN, dk[hit])
        out.append((0, 0, 0, 0, dk, low, high - low))
    if (batch := _rows(o for o in out if len(o[4]))) is not None:
        yield batch


_MARK_SQL = "dk long, spans binary"


def _gather(batches: Iterator[pa.RecordBatch], join: bool) -> Iterator[pa.RecordBatch]:
    """(dk, spans): each text's intervals as pairs of low and length; merged, or as they are."""
    table = pa.Table.from_batches(list(batches), pa.schema([("dk", pa.int64()), ("low", pa.int32()), ("n", pa.int32())]))
    if not table.num_rows:
        return
    dk, low, n = (table.column(c).to_numpy().astype(np.int64) for c in ("dk", "low", "n"))
    if join:
        low, high, dk = merged(low, low + n, dk)
        n = high - low
    else:
        order = np.lexsort((low, dk))
        dk, low, n = dk[order], low[order], n[order]
        once = _runs(dk, low, n)
        dk, low, n = dk[once], low[once], n[once]
    starts = np.flatnonzero(_runs(dk))
    raw = pa.py_buffer(np.stack([low, n], axis=1).astype("<i4").tobytes())
    offsets = pa.py_buffer((np.r_[starts, len(dk)] * 8).astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(dk[starts]), pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, offsets, raw])], names=["dk", "spans"])


def _sized_join(spark: SparkSession, left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Broadcast the written table `right` if its files are small, else shuffle."""
    if shared.stored_bytes(spark, right) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, key, how)


def marks(spark: SparkSession, texts: DataFrame, keep_first: bool = False) -> DataFrame:
    """(dk, spans, whole): of each text that repeats something, the bytes to remove; whole marks a text that stands twice.

    With `keep_first`, one place of each repeated string isn't marked, and no text is marked as a whole.

    `texts` has dk, a 64-bit hash of the text, and text, not null.
    """
    shared.ship(spark)
    long = texts.filter(F.octet_length("text") >= SPAN)
    rows = texts.agg(F.count("*")).first()[0]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    step = max(1, rows // SAMPLED)
    sampled = long.filter(F.pmod(F.xxhash64(F.lit(3), "dk"), F.lit(step)) == 0) if step > 1 else long

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, "text"):
            for data, offsets, _, _ in _pieces(batch):
                at, _, _, key, _ = anchors(data, offsets)
                if len(at):
                    pick = slice(None, None, max(1, len(at) // 2000))
                    yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), pa.array(leading(data, at[pick]).view(np.int64))], names=["key", "lead"])

    drawn = sampled.select("dk", "text").mapInArrow(sample, "key long, lead long").collect()
    splitters = []
    for c in range(2):
        values = np.sort(np.array([r[c] for r in drawn], dtype=np.int64).view(np.uint64))
        splitters.append(np.unique(values[(np.arange(1, parts) * len(values)) // parts]) if len(values) else np.empty(0, np.uint64))
    by_key, by_lead = splitters

    spans = long.select("dk", "text").mapInArrow(lambda it: _map_anchors(it, by_key, parts, keep_first), _ROW_SQL).repartitionById(parts, F.col("bucket")).mapInArrow(lambda it: _compare_anchors(it, keep_first), _ROW_SQL)
    spans = shared.written(spark, spans.select("kind", "dk", "low", "n"), "spans")
    gather = lambda df, join: df.select("dk", "low", "n").repartition(parts, "dk").mapInArrow(lambda it: _gather(it, join), _MARK_SQL)
    open_spans = shared.written(spark, gather(spans.filter("kind = 1"), False), "open")
    with_open = _sized_join(spark, long.select("dk", "text"), open_spans, "dk", "inner")
    windows = with_open.mapInArrow(lambda it: _map_windows(it, by_lead, parts, keep_first), _ROW_SQL).repartitionById(parts, F.col("bucket")).mapInArrow(lambda it: _compare_windows(it, keep_first), _ROW_SQL)
    covered = gather(spans.filter("kind = 0").select("dk", "low", "n").unionByName(windows.select("dk", "low", "n")), True)
    if keep_first:
        return shared.written(spark, covered.withColumn("whole", F.lit(False)), "marks")
    twice = long.groupBy("dk").agg(F.count("*").alias("copies")).filter("copies > 1").select("dk", F.lit(True).alias("whole"))
    return shared.written(spark, covered.join(twice, "dk", "full_outer").select("dk", "spans", F.coalesce("whole", F.lit(False)).alias("whole")), "marks")


def remove_repeats(spark: SparkSession, documents: DataFrame, text: str = "text", as_text: bool = False, keep_first: bool = False) -> DataFrame:
    """`documents` with n_bytes, n_removed, n_spans, kept (the bytes that stay) in place of the text.

    With `as_text`, kept is a string, without the pieces of characters that a cut went through.
    With `keep_first`, one place of each repeated string stays, that of the text of least hash, and equal
    texts count as one text: they stay, or are cut, alike.

    A null text counts as empty; equal texts of SPAN bytes or more are removed as wholes, shorter texts
    stay as they are. Rows aren't dropped, so repeated rows and null keys stay rows of their own.
    """
    others = [c for c in documents.columns if c != text]
    named = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("dk", F.xxhash64("text"))
    found = marks(spark, named.select("dk", "text"), keep_first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, "text"):
            data, offsets = textkit.utf8(batch.column("text"))
            whole, spans = batch.column("whole").to_pylist(), batch.column("spans").to_pylist()
            size, removed, runs, kept = [], [], [], []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                if whole[i]:
                    drop, count, rest = len(raw), 1, b""
                elif spans[i]:
                    pairs = np.frombuffer(spans[i], dtype="<i4").reshape(-1, 2).tolist()
                    drop, count = sum(n for _, n in pairs), len(pairs)
                    edges = [0, *(x for low, n in pairs for x in (low, low + n)), len(raw)]
                    parts = [raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])]
                    rest = b"".join(p.decode("utf-8", "ignore").encode() for p in parts) if as_text else b"".join(parts)
                else:
                    drop, count, rest = 0, 0, raw.tobytes()
                size.append(len(raw))
                removed.append(drop)
                runs.append(count)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(f"c{i}") for i in range(len(others))] + [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string() if as_text else pa.binary())], names=[f"c{i}" for i in range(len(others))] + ["n_bytes", "n_removed", "n_spans", "kept"])

    joined = _sized_join(spark, named, found, "dk", "left")
    fields = ", ".join(f"c{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    out = joined.mapInArrow(cut, f"{fields}{', ' if fields else ''}n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), "n_bytes", "n_removed", "n_spans", "kept")


def dedup_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The op1 contract: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(spark, shared.only(documents, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
