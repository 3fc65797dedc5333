"""The pipeline's near-copy stage: five words and 0.8, against plain Python."""

import random

import corpus_pipeline
import numpy as np
import pytest
from loomstone.llm import jaccard_join, textkit


def shingles(text, n):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def alike(a, b, n):
    x, y = shingles(a, n), shingles(b, n)
    return len(x & y) / len(x | y) if x | y else 0.0


def plain_groups(texts, n, least):
    group = {d: d for d in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if group[a] != group[b] and alike(texts[a], texts[b], n) >= least:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


def edited(words, places, rng):
    words = list(words)
    for p in places:
        words[p] = f"v{rng.randrange(10**6)}"
    return words


def made():
    """Copies with 0 to 8 % of their words edited, in texts of 1 to 300 words."""
    rng = random.Random(11)
    texts, d = {}, 0
    for size in (1, 3, 4, 5, 6, 20, 60, 150, 250, 300):
        for _ in range(2):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, max(1, size // 50), max(1, size // 40), max(1, size // 25), max(1, size // 12)):
                texts[d] = " ".join(edited(words, rng.sample(range(size), min(size, edits)), rng))
                d += 1
    return texts


def test_groups_of_five_words(spark):
    texts = made()
    want = plain_groups(texts, 5, 0.8)
    assert want != plain_groups(texts, 3, 0.9)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = jaccard_join.linked_groups(spark, rows, jaccard_join.Likeness(5, 8, 10)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(shingles(t, 5)) for d, t in texts.items()}
    assert {r.doc_id: r.component_id for r in jaccard_join.linked_groups(spark, rows).collect()} == plain_groups(texts, 3, 0.9)


def test_stage_joins_at_five_words(spark):
    """A copy with 2 % of its words edited, under 0.9 at three words, goes; one below 0.8 at five stays."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(248)]
    rows = [(1, words), (2, edited(words, range(20, 248, 50), rng)), (3, edited(words, range(5, 248, 20), rng))]
    texts = {d: " ".join(w) for d, w in rows}
    assert alike(texts[1], texts[2], 3) < 0.9 and alike(texts[1], texts[2], 5) >= 0.8 and alike(texts[1], texts[3], 5) < 0.8 and alike(texts[2], texts[3], 5) < 0.8
    table = [(d, t, "en", "src", len(t)) for d, t in texts.items()]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, "").collect()} == {1, 3}


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_one_row_of_each_group_survives(spark, tmp_path):
    """Rows that repeat, share an id or have none: one row of each group stays, whole, through the cut of repeats."""
    a, b, c, d, e, f = (prose(k) for k in range(6))
    rows = [
        (1, a), (1, a), (1, a),  # equal rows
        (2, b), (2, c), (3, c + " tail"),  # one id, two texts; a copy of one of them
        (0, b),  # the copy of the other with the lesser id
        (None, d), (None, d),  # equal rows without an id
        (None, e), (7, e),  # an id comes before none
        (8, f),
        (9, None), (9, None), (9, ""),  # linked with nothing
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    corpus_pipeline.join_near_copies(spark, docs, "").write.parquet(f"{tmp_path}/kept")
    got = spark.read.parquet(f"{tmp_path}/kept")
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    want = [(1, a), (0, b), (2, c), (None, d), (7, e), (8, f), (9, ""), (9, ""), (9, "")]
    assert sorted(key(r) for r in got.collect()) == sorted(key(r) for r in want)
    after = corpus_pipeline.remove_repeats(spark, got, "")
    assert sorted(key(r) for r in after.collect()) == sorted(key(r) for r in want)


def test_equal_rows_survive_all_stages(spark, tmp_path):
    spark.createDataFrame([(1, "no such passage stands in any of these texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew potions near a river of glass and stone " * 2
    other = "two rows of one id may hold texts that have nothing to do with each other and then both of them are wanted in what comes out of here"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(1, text), (1, text), (1, other), (None, other + " again"), (None, other + " again")]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len([r for r in got if r.doc_id == 1 and r.start == 0]) == 2


def _entries(seed, like, copies):
    """Index lists of random sets over few tokens, with near copies, as the join orders them; and the sets."""
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(40):
        base = set(rng.choice(400, size=int(rng.integers(5, 60)), replace=False).tolist())
        for _ in range(int(rng.integers(1, copies + 1))):
            sets.append(base - set(rng.choice(sorted(base), size=int(rng.integers(0, 3))).tolist()))
    sets = sorted({tuple(sorted(s)) for s in sets})
    component = rng.integers(0, len(sets) // 2, size=len(sets)) if copies > 1 else np.arange(len(sets))
    rows = [(t, len(s), place, int(component[i]), int(i % 3) - 1, i) for i, s in enumerate(sets) for place, t in enumerate(s[: like.prefix_size(len(s))])]
    key, n, place, of, side, node = (np.array(c, dtype=np.int64) for c in zip(*sorted(rows)))
    fold = [jaccard_join.folded(jaccard_join.parity_sketch(textkit.mix(np.array(s, dtype=np.uint64)))) for s in sets]
    return sets, component, (key, side, node, n, place, of, np.stack(fold)[node])


@pytest.mark.parametrize("like", [jaccard_join.CLOSE, jaccard_join.Likeness(5, 8, 10), jaccard_join.Likeness(3, 5, 10)])
@pytest.mark.parametrize("seed", range(4))
def test_blocks_lose_no_linked_pair(like, seed):
    """Every linked pair of different components and sides is given, whatever is skipped, and however few pairs are opened at a time."""
    for copies in (1, 6):
        sets, component, entries = _entries(seed, like, copies)
        got, _ = jaccard_join.block_pairs(*entries, like)
        got = set(map(tuple, got.T.tolist()))
        side = [i % 3 - 1 for i in range(len(sets))]
        linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if like.denominator * len(set(sets[i]) & set(sets[j])) >= like.numerator * len(set(sets[i]) | set(sets[j]))}
        wanted = {(i, j) for i, j in linked if component[i] != component[j] and (side[i] != side[j] or side[i] < 0)}
        assert wanted <= got and (wanted or copies == 1) and all(component[i] != component[j] for i, j in got)
        assert not [p for p in got if side[p[0]] == side[p[1]] and side[p[0]] >= 0]


def test_blocks_are_skipped():
    """A list of 3,000 entries of one size: what can't link by position, or is of one component, is never opened."""
    like, n = jaccard_join.CLOSE, 100
    node = np.arange(3000)
    key, size, side = np.zeros(3000, np.int64), np.full(3000, n), np.full(3000, -1)
    sketch = np.zeros((3000, jaccard_join.SKETCH_BITS // 64), np.uint64)
    late = np.full(3000, 8)  # of 100 tokens 92 follow; 95 would have to be shared
    pairs, held = jaccard_join.block_pairs(key, side, node, size, late, node, sketch, like)
    assert pairs.shape[1] == 0 and held == 0
    known = np.repeat([3, 7], 1500)
    pairs, held = jaccard_join.block_pairs(key, side, node, size, np.zeros(3000, np.int64), known, sketch, like)
    assert held == 1500 * 1500 == pairs.shape[1]  # and not the 4,498,500 of all
