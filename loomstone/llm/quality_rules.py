"""Quality rules: a learned decision list of threshold conjunctions, run as one Spark CASE expression.

Sequential covering learns rules for the bad class from labelled statistics. A rule grows by the
threshold test of most information gain until it covers no good row of the growing part, is pruned
back to the prefix that does best on the pruning part, and is kept while it is precise there; the
rows that it covers are set aside and the next rule is learned. Statistics and rules are DataFrame
expressions only; the driver sees a bounded sample of labelled statistics and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit may use, at most: those whose ids hash lowest.
SAMPLE_ROWS = 20_000
WINDOW = 8
_WHITE = " \t\n\x0b\f\r"
#: Fixed value: the symbols that the op2 contract counts.
SYMBOLS = "#*$%&|<>"
FEATURES = ["words", "mean_word", "symbol_share", "repeat_share", "duplicate_line_share", "distinct_word_share", "digit_share", "capital_share"]


def _stripped(column: Column, characters: str) -> Column:
    return F.char_length(F.translate(column, characters, ""))


def statistics(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and, for the whole of each text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of FEATURES.

    A null or empty text has no words and zero everywhere. Windows are compared by 64-bit hashes
    within one text.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in keep]
    split = documents.select(*kept, body.alias("__text")).select(
        *kept,
        "__text",
        F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda line: F.translate(line, _WHITE, "") != "").alias("__lines"),
    )
    counted = split.select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        _stripped(F.col("__text"), _WHITE).cast("long").alias("word_chars"),
        (F.char_length("__text") - _stripped(F.col("__text"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        (F.char_length("__text") - _stripped(F.col("__text"), "0123456789")).alias("__digits"),
        (F.char_length("__text") - _stripped(F.col("__text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("__capitals"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    shown = counted.withColumn("__distinct", F.size(F.array_distinct("__hashes"))).withColumn("__windows", windows).drop("__hashes")
    # Only a text with an equal pair of windows needs them in order.
    pairs = F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = shown.withColumn("__pairs", pairs).drop("__windows")
    positions = F.sort_array(
        F.transform(
            F.filter("__pairs", lambda x, k: F.coalesce(F.get("__pairs", k + 1)["h"] == x["h"], F.lit(False)) | ((k > 0) & F.coalesce(F.get("__pairs", k - 1)["h"] == x["h"], F.lit(False)))),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        "__positions",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
    )["n"]
    full = twice.withColumn("__positions", positions).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__pairs", "__positions")
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    ratios = {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "duplicate_line_share": F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
        "distinct_word_share": F.col("__distinct") / words,
        "digit_share": F.col("__digits") / chars,
        "capital_share": F.col("__capitals") / chars,
    }
    return full.withColumns(ratios).drop("__n_lines", "__distinct", "__digits", "__capitals")


@dataclass(frozen=True)
class Test:
    """One threshold test: feature <= limit, or feature > limit."""

    feature: str
    below: bool
    limit: float

    def rows(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] <= self.limit if self.below else table[self.feature] > self.limit

    def column(self) -> Column:
        return F.col(f"`{self.feature}`") <= self.limit if self.below else F.col(f"`{self.feature}`") > self.limit


def _best_test(table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most_limits: int) -> tuple[float, Test | None]:
    """The test with most information gain over `rows`."""
    found: tuple[float, Test | None] = (0.0, None)
    inside = np.flatnonzero(rows)
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    if not p or not n:
        return found
    before = np.log2(p / (p + n))
    for feature in FEATURES:
        order = inside[np.argsort(table[feature][inside], kind="stable")]
        values = table[feature][order]
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if len(cuts) > most_limits:
            cuts = cuts[np.linspace(0, len(cuts) - 1, most_limits).astype(int)]
        if not len(cuts):
            continue
        hits = np.cumsum(bad[order])[cuts].astype(float)
        size = (cuts + 1).astype(float)
        for below in (True, False):
            ps, total = (hits, size) if below else (p - hits, p + n - size)
            gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1e-9) / total) - before), 0)
            k = int(gain.argmax())
            if gain[k] > found[0] + 1e-12:
                found = (float(gain[k]), Test(feature, below, float((values[cuts[k]] + values[cuts[k] + 1]) / 2)))
    return found


def learn(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 0, precision: float = 0.9, least_covered: int = 3, most_rules: int = 24, most_tests: int = 4, most_limits: int = 512) -> list[list[Test]]:
    """An ordered list of conjunctions that pick out bad rows; a row that none fits is good."""
    n = len(bad)
    part = np.random.default_rng(seed).permutation(n) % 3 == 0
    left = np.ones(n, dtype=bool)
    rules: list[list[Test]] = []

    def rows_of(tests: list[Test], among: np.ndarray) -> np.ndarray:
        for t in tests:
            among = among & t.rows(table)
        return among

    while len(rules) < most_rules and (left & bad).sum() >= least_covered:
        grow, prune = left & ~part, left & part
        tests: list[Test] = []
        while len(tests) < most_tests:
            _, test = _best_test(table, bad, rows_of(tests, grow), most_limits)
            if test is None:
                break
            tests.append(test)
        if not tests:
            break

        def worth(k: int) -> tuple[float, int]:
            at = rows_of(tests[:k], prune)
            hit, miss = int((at & bad).sum()), int((at & ~bad).sum())
            return ((hit - miss) / (hit + miss) if hit + miss else -1.0, -k)

        tests = tests[: max(range(1, len(tests) + 1), key=worth)]
        at = rows_of(tests, left)
        hit, all_rows = int((at & bad).sum()), int(at.sum())
        checked = rows_of(tests, prune)
        precise = not checked.any() or (checked & bad).sum() >= precision * checked.sum()
        if hit < least_covered or hit < precision * all_rows or not precise:
            break
        rules.append(tests)
        left &= ~at
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The decision list as one ordered conditional: false where a rule fits, else true."""
    out = F.lit(True)
    for tests in reversed(rules):
        fits = tests[0].column()
        for t in tests[1:]:
            fits = fits & t.column()
        out = F.when(fits, F.lit(False)).otherwise(out)
    return out


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Test]]:
    """Learn from at most `sample_rows` labelled documents; of a document labelled twice, the lower quality counts. No labels: no rules."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality", F.xxhash64(F.lit(5), "doc_id").alias("draw"))
    sample = usable.orderBy("draw", "doc_id", "quality").limit(sample_rows).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = statistics(texts, ["doc_id", "quality"]).select("doc_id", "quality", *FEATURES).collect()
    rows.sort(key=lambda r: tuple(r))
    table = {f: np.array([r[f] for r in rows], dtype=float) for f in FEATURES}
    return learn(table, np.array([r["quality"] == 0 for r in rows], dtype=bool))


def judge_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The op2 contract: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rules = fit(documents, labels)
    stats = statistics(documents, ["doc_id"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
