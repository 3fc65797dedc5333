"""URL filters: a sorted array of 64-bit xxhash digests, memory-mapped and probed by binary search.

The filter is one file: sorted digests, then the offsets of the full strings, then the strings. Each
executor fetches it once and maps it, so that its workers share the pages. A page's keys are looked
up all at once with a vectorised binary search; a digest that is found is confirmed against the
stored string, so that a collision never decides.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import shared

#: The rules of the op5 contract as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Default blocklist, a parameter: advertising, gambling, pharmacy, spam and adult hosts. A subdomain is blocked with its host.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_HOSTS = [f"{name}.example.{zone}" for name in BLOCKED_NAMES for zone in ("com", "net", "org")]
_HEAD = 16


def build_file(path: str, entries: Iterable[str]) -> None:
    """Write the sorted digest array of distinct strings to a file."""
    raw = [e.encode() for e in set(entries)]
    digests = np.array([xxhash.xxh64_intdigest(r) for r in raw], dtype=np.uint64)
    order = np.lexsort((np.array([len(r) for r in raw], dtype=np.int64), digests))
    offsets = np.zeros(len(raw) + 1, dtype=np.uint64)
    offsets[1:] = np.cumsum([len(raw[i]) for i in order])
    with open(path, "wb") as f:
        f.write(np.array([len(raw), 0], dtype=np.uint64).tobytes())
        f.write(digests[order].tobytes())
        f.write(offsets.tobytes())
        for i in order:
            f.write(raw[i])


class DigestArray:
    """A mapped file of `build_file`."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self._map, np.uint64, 1)[0])
        self.digests = np.frombuffer(self._map, np.uint64, n, _HEAD)
        self.offsets = np.frombuffer(self._map, np.uint64, n + 1, _HEAD + 8 * n)
        self._text = _HEAD + 8 * n + 8 * (n + 1)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The entry number of each key, or -1."""
        want = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        at = np.searchsorted(self.digests, want)
        out = np.full(len(keys), -1, dtype=np.int64)
        for k in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, max(len(self.digests) - 1, 0))] == want)) if len(self.digests) else ():
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == want[k]:  # entries whose digests collide stand together
                if self._map[self._text + int(self.offsets[i]) : self._text + int(self.offsets[i + 1])] == keys[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def entry(self, i: int) -> str:
        return self._map[self._text + int(self.offsets[i]) : self._text + int(self.offsets[i + 1])].decode()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both are empty for a null URL or one without ://."""
    rest = F.expr("substring(__url, instr(__url, '://') + 3)")
    cut = F.regexp_extract(rest, "(?s)^([^/?#]*)(.*)$", 1)
    tail = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    known = F.col("__url").contains("://")
    lower = F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(""), F.when(known, tail).otherwise("")


def suffixes(host: str) -> list[str]:
    """The host and its parents, longest first."""
    out = [host]
    while "." in host:
        host = host.split(".", 1)[1]
        out.append(host)
    return out


_open: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    if name not in _open:
        _open.clear()
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: Iterable[str], url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    A rule fits a host and its subdomains if the path starts with the rule's; the longest that fits
    decides (of two equally long ones, that with the longer host). Else a page is blocked if its
    host or a parent of it is in the blocklist, and allowed otherwise. A null or odd URL has an empty
    host and path, no rule, and is allowed. The list may have millions of entries: it is built and
    sent once as a file, and its size is its strings plus 16 bytes each.
    """
    shared.ship(spark)
    verdicts = {f"{h}{p}": v for h, p, v in rules}
    name = f"url-filter-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(prefix="loomstone-"), name)
    build_file(local, [f"rule {h}{p}" for h, p, _ in rules] + [f"host {h}" for h in blocked_hosts])
    spark.sparkContext.addFile(local)
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _mapped(name)
        for frame in frames:
            keys: list[bytes] = []
            owner: list[int] = []
            what: list[tuple[str, str]] = []
            for row, (host, path) in enumerate(zip(frame["host"], frame["path"])):
                if not host:
                    continue
                for parent in suffixes(host):
                    keys.append(f"host {parent}".encode())
                    owner.append(row)
                    what.append(("", parent))
                    for n in lengths:
                        if len(path) >= n:
                            keys.append(f"rule {parent}{path[:n]}".encode())
                            owner.append(row)
                            what.append((parent, path[:n]))
            found = index.find(keys)
            rule: list[str | None] = [None] * len(frame)
            best = [(-1, -1)] * len(frame)
            blocked = [False] * len(frame)
            for k in np.flatnonzero(found >= 0):
                row, (host, path) = owner[k], what[k]
                if not host:
                    blocked[row] = True
                elif (rank := (len(host) + len(path), len(host))) > best[row]:
                    best[row], rule[row] = rank, host + path
            yield pd.DataFrame({"n": frame["n"], "rule": rule, "verdict": [verdicts[r] if r is not None else "block" if b else "allow" for r, b in zip(rule, blocked)]})

    @F.pandas_udf("struct<rule string, verdict string>")
    def verdict(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        frames = (pd.DataFrame({"n": range(len(h)), "host": h.to_numpy(), "path": p.to_numpy()}) for h, p in parts)
        for out in judge(frames):
            yield out[["rule", "verdict"]]

    host, path = host_and_path(F.col("__url"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, F.col(f"`{url}`").alias("__url")).withColumn("host", host).withColumn("path", path).drop("__url")
    return split.withColumn("__v", verdict("host", "path")).select("*", "__v.rule", "__v.verdict").drop("__v")


def oracle_sql() -> str:
    """The op5 query as DuckDB SQL."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    hosts = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), rules(rhost, rpath, action) AS (VALUES {rules}),
blocked(bhost) AS (VALUES {hosts}),
fits AS (
  SELECT page_id, rhost || rpath AS rule, action,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule,
  CASE WHEN f.rule IS NOT NULL THEN f.action
       WHEN EXISTS (SELECT 1 FROM blocked WHERE p.host = bhost OR ends_with(p.host, '.' || bhost)) THEN 'block' ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE place = 1) f ON f.page_id = p.page_id
"""
