"""Each corpus query against a plain-Python counterpart, over the smallest tables and made-up ones."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from loomstone.llm import decontamination, html_extract, jaccard_join, language_id, license_scan, packing, quality_rules, queries, sharding, suffix_dedup, textkit, url_filter

SF = "/root/testdata/sf0.001"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# --- suffix dedup


def plain_removed(raws, span):
    seen = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                hit[i : i + span] = True
        out.append(hit)
    return out


def check_removed(rows, texts):
    raws = [(t or "").encode() for t in texts]
    for i, (r, hit) in enumerate(zip(raws, plain_removed(raws, suffix_dedup.SPAN))):
        kept = np.frombuffer(r, np.uint8)[~hit].tobytes()
        runs = int((hit & ~np.r_[False, hit[:-1]]).sum()) if len(r) else 0
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(r), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()), i


def test_suffix_dedup_of_table(spark, texts):
    rows = {r.doc_id: r for r in queries.op1_suffix_dedup(spark, SF).collect()}
    ids = sorted(texts)
    check_removed([rows[i] for i in ids], [texts[i] for i in ids])


def test_suffix_dedup_of_edges(spark):
    """Passages of 199, 200 and 201 bytes, overlaps, periods, edits near the edges, several partners."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh éß") for _ in range(n))
    base, other = word(700), word(500)
    texts = [base, "x" + base[:199] + "y", "x" + base[100:301] + "y", word(80) + base[250:460] + word(90), other + base[:230] + other, "ab" * 300, "a" * 450, word(199), word(199) * 1, None, ""]
    texts += [base[:k] + "#" + base[k + 1 :] for k in (0, 1, 199, 200, 201, 350, 699)]
    texts += [other[:300], other[100:], other[100:300] + base[-205:], "q" * 200, "z" * 199, "é" * 150]
    shuffled = list(enumerate(texts))
    rng.shuffle(shuffled)
    docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in suffix_dedup.dedup_documents(spark, docs).collect()}
    check_removed([rows[i] for i in range(len(texts))], texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), max_size=40))
def test_multikey_order(rows):
    columns = [np.array([r[c] for r in rows], dtype=np.uint64) for c in range(3)]
    if rows:
        order = suffix_dedup.multikey_order(columns)
        assert [rows[i] for i in order] == sorted(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 9), st.integers(0, 2)), max_size=30))
def test_merged(rows):
    low, n, group = (np.array([r[c] for r in rows], dtype=np.int64) for c in range(3))
    got = defaultdict(set)
    for a, b, g in zip(*suffix_dedup.merged(low, low + n, group)):
        assert not got[g] & set(range(a, b)) and a - 1 not in got[g]
        got[g] |= set(range(a, b))
    want = defaultdict(set)
    for a, k, g in rows:
        want[g] |= set(range(a, a + k))
    assert {g: s for g, s in got.items() if s} == want


def test_pieces_of_long_texts_share_no_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1000)
    raw = bytes(random.Random(1).randrange(97, 123) for _ in range(3500))
    batch = pa.RecordBatch.from_arrays([pa.array([5], pa.int64()), pa.array([raw.decode()])], names=["dk", "text"])
    starts = []
    for data, _, _, base in suffix_dedup._pieces(batch):
        starts += range(int(base[0]), int(base[0]) + len(data) - suffix_dedup.SPAN + 1)
    assert starts == list(range(3500 - suffix_dedup.SPAN + 1))


# --- quality


def test_quality_statistics(spark, texts):
    made = {-1: "a b c d e f g h " * 3 + "x\ny\n\ny\n y\n", -2: "one two three four five six seven eight nine one two three four five six seven eight", -3: "#$*\x0b|<>&% \n\n# \n"}
    docs = spark.createDataFrame(list((texts | made).items()), "doc_id long, text string")
    for r in quality_rules.statistics(docs, ["doc_id"]).collect():
        t = (texts | made)[r.doc_id]
        words, lines = WHITE.findall(t), [x for x in t.split("\n") if WHITE.search(x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_rules_learn_and_spare_the_good():
    rng = np.random.default_rng(0)
    table = {f: rng.random(3000) for f in quality_rules.FEATURES}
    bad = (table["symbol_share"] > 0.8) | ((table["repeat_share"] > 0.6) & (table["mean_word"] < 0.3))
    rules = quality_rules.learn(table, bad)
    hit = np.zeros(3000, dtype=bool)
    for tests in rules:
        fits = np.ones(3000, dtype=bool)
        for t in tests:
            fits &= t.rows(table)
        hit |= fits
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * (~bad).sum()
    assert quality_rules.learn(table, np.zeros(3000, dtype=bool)) == []


def test_quality_verdicts_follow_labels(spark):
    kept = {r.doc_id: r.kept for r in queries.op2_quality_rules(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [kept[d] for d, q in labels.items() if q == 1]
    poor = [kept[d] for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.9 * len(good) and sum(poor) <= 0.2 * len(poor)


# --- sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**62))
def test_permutation(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, seed, back=True).tolist() == list(range(n))


def test_sharding_of_table(spark, texts):
    rows = queries.op3_sharding(spark, SF).collect()
    again = queries.op3_sharding(spark, SF).collect()
    assert sorted(rows) == sorted(again)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    # The place follows from the row number alone.
    at = {d: i for i, d in enumerate(sorted(texts))}
    numbers = sharding.permute(np.array([at[r.doc_id] for r in rows]), len(rows))
    assert [(r.shard, r.slot) for r in rows] == [(int(p) % 8, int(p) // 8) for p in numbers]


# --- decontamination


@pytest.mark.parametrize("n, edits", [(5, 1), (13, 2), (25, 5), (40, 8), (59, 11), (120, 24), (300, 60)])
def test_bucket_recall(n, edits):
    recall, unrelated = decontamination.measured_rates(n, edits)
    assert recall >= 0.95 and unrelated <= 0.01


def plain_infix(item, text):
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        take = [i]
        for j, x in enumerate(text, 1):
            take.append(min(cost[j - 1] + (x != w), cost[j] + 1, take[-1] + 1))
        cost = take
    return min(cost)


def test_infix_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item = rng.integers(1, 5, rng.integers(1, 8)).astype(np.uint64)
        rows = rng.integers(1, 5, (3, rng.integers(1, 14))).astype(np.uint64)
        got, _ = decontamination.infix_distance(np.tile(item, (3, 1)), rows)
        assert got.tolist() == [plain_infix(item.tolist(), r.tolist()) for r in rows]


def leaks(benchmark, text, words=10**6):
    """(item, first word, words, edits) of one text, by blocks of so many words."""
    hashed, counts, _, _ = decontamination.tokens(pa.array([text], pa.string()))
    items = [(i, decontamination.tokens(pa.array([t], pa.string()))[0]) for i, t in benchmark]
    out, block = [], []
    for k, (i, w) in enumerate(items):
        block.append((i, w))
        if sum(len(x) for _, x in block) >= words or k == len(items) - 1:
            ready = decontamination.prepare([i for i, _ in block], [w for _, w in block])
            out += [(ready.ids[i], *rest) for _, i, *rest in decontamination.find(hashed, counts, ready)]
            block = []
    return sorted(out)


def test_short_items_stand_as_they_are():
    benchmark = [(1, "fox"), (2, "brown fox"), (3, "brown cat"), (4, "the quick brown fox"), (5, "日本語"), (6, "12.")]
    got = leaks(benchmark, "See the quick, BROWN fox; fox 今日本語を. 123")
    assert got == [(1, 4, 1, 0), (2, 3, 2, 0), (4, 1, 4, 0), (5, 7, 3, 0)]


def test_scripts_without_spaces_are_words_of_a_character():
    said = "吾輩は猫である名前はまだ無いどこで生れたか見当がつかぬ"
    assert leaks([(1, said)], "前文" + said[:10] + "の" + said[11:] + "後文") == [(1, 2, len(said), 1)]


def test_a_phrase_that_all_items_share():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, f"what is {word()} {word()} {word()}") for i in range(2000)]
    text = " ".join(f"what is {word()}" for _ in range(700)) + " " + items[7][1] + " and " + items[9][1].replace("what", "how")
    began = time.perf_counter()
    got = leaks(items, text)
    assert [i for i, *_ in got] == [7, 9] and time.perf_counter() - began < 20


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    twice = bench.unionByName(bench)
    want = sorted(map(tuple, decontamination.leaked(spark, docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 2500)
    assert sorted(map(tuple, decontamination.leaked(spark, docs, twice).collect())) == want and want


def test_leaks_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randrange(3, 45))] for i in range(25)}
    texts = {}
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            passage = list(items[rng.randrange(25)])
            for _ in range(rng.randrange(0, max(1, len(passage) // 4))):
                at = rng.randrange(len(passage))
                kind = rng.randrange(3)
                if kind == 0:
                    passage[at] = rng.choice(vocabulary)
                elif kind == 1 and len(passage) > 1:
                    del passage[at]
                else:
                    passage.insert(at, rng.choice(vocabulary))
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        texts[d] = " ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", ".", ","]) for w in words)
    want = {}
    for d, t in texts.items():
        words = re.findall(r"[a-z0-9]+", t.lower())
        for i, item in items.items():
            k = plain_infix(item, words)
            if k <= math.floor(round(0.2 * len(item), 9)):
                want[d, i] = k
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaked(spark, docs, bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) > 60
    for key, r in got.items():
        words = re.findall(r"[a-z0-9]+", texts[key[0]].lower())[r.first_word : r.first_word + r.n_words]
        assert r.edits >= want[key] and plain_infix(items[key[1]], words) <= r.edits
    assert sum(got[k].edits == want[k] for k in got) >= 0.98 * len(got)


# --- URL filter


def test_digest_array(tmp_path):
    entries = [f"host h{i}.example" for i in range(500)] + ["é", ""]
    path = str(tmp_path / "f.bin")
    url_filter.build_file(path, entries)
    index = url_filter.DigestArray(path)
    assert (np.diff(index.digests.astype(object)) >= 0).all()
    found = index.find([e.encode() for e in entries] + [b"host h", b"other"])
    assert [index.entry(int(k)) for k in found[:-2]] == entries and found[-2:].tolist() == [-1, -1]


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b))
    path = str(tmp_path / "f.bin")
    url_filter.build_file(path, ["aa", "bb", "c"])
    index = url_filter.DigestArray(path)
    assert [index.entry(int(k)) if k >= 0 else None for k in index.find([b"bb", b"aa", b"cc", b"c"])] == ["bb", "aa", None, "c"]


# --- Jaccard join


def plain_groups(texts, n=3, percent=90):
    sets = {}
    for d, t in texts.items():
        w = WHITE.findall((t or "").translate(LOWER))
        sets[d] = set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard_of_table(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_jaccard_join(spark, SF).collect()}
    assert got == plain_groups(texts)


def test_jaccard_of_chains_and_near_misses(spark):
    """Groups around the threshold: chains whose ends aren't linked, copies with few and with many edits, short texts."""
    rng = random.Random(4)
    texts, d = {}, 0
    for size in (1, 2, 3, 4, 12, 30, 60, 200):
        for _ in range(3):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(14):
                texts[d] = " ".join(words).upper() if rng.random() < 0.3 else "\n".join(words)
                d += 1
                words = list(words)
                for _ in range(rng.choice([0, 1, 1, 2, max(1, size // 20)])):
                    words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    shared = " ".join(f"s{i}" for i in range(40))
    for _ in range(30):  # a passage that many texts share makes none of them alike
        texts[d] = shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))
        d += 1
    items = list(texts.items())
    rng.shuffle(items)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_groups(spark, spark.createDataFrame(items, "doc_id long, text string").repartition(4)).collect()}
    want = plain_groups(texts)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 50


def test_jaccard_of_lists_in_blocks(spark, texts, monkeypatch):
    """Lists that are dealt over tasks in blocks give the same groups."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "REACH", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_jaccard_join(spark, SF).collect()}
    assert got == plain_groups(texts)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=120), st.sets(st.integers(0, 400), max_size=120))
def test_parity_sketch_never_exceeds_the_difference(a, b):
    if a and b:
        x, y = (jaccard_join.parity_sketch(textkit.mix(np.array(sorted(s), dtype=np.uint64))) for s in (a, b))
        for words in {4, min(len(x), len(y))}:
            apart = np.bitwise_count(jaccard_join.folded(x, words) ^ jaccard_join.folded(y, words)).sum()
            assert int(apart) <= len(a ^ b)


# --- HTML


def test_html_of_table(spark):
    rows = {r.page_id: r for r in queries.op7_html_extract(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        parts = [html_extract.html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(" ".join(x.split()) for x in parts if x.split())
        assert (rows[p.page_id].text, rows[p.page_id].n_chars) == (want, len(want))


ARTICLE = " ".join(f"Sentence number {i} of the report tells of rivers and bridges." for i in range(12))


@pytest.mark.parametrize(
    "page",
    [
        "<body><header><h2>Site</h2></header><nav><a href=1>Home</a><a href=2>News</a></nav><div id=main><h1>Title</h1><p>{a}</p><p>{a}</p></div><aside>Ads here</aside><footer>(c)</footer></body>",
        "<body><div class='cookie-notice'>We use cookies and other things to make this site work for you and us.</div><main><section><h1>Title</h1><p>{a}</p></section><section><p>{a}</p></section></main><section class=comments><p>First! {a}</p></section></body>",
        "<body><table><tr><td><ul><li><a href=1>one link</a><li><a href=2>two link</a></ul><td><h1>Title</h1><p>{a}<p>{a}</table><form><input><select><option>x</select>Send</form>",
        "<body><div><div><a href=x>Next page of the site</a> <a href=y>Another page of the site</a></div><div><h1>Title</h1><div>{a}</div><div>{a}</div></div></div><script>document.write('<p>no</p>')</script><noscript>no</noscript></body>",
    ],
)
def test_html_shapes(page):
    assert html_extract.main_text(page.replace("{a}", ARTICLE)) == "\n\n".join(["Title", ARTICLE, ARTICLE])


# --- licenses


def test_license_base(spark, texts):
    words_of = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    made = {-1: "MIT\nLicense, the General  Public License; apache-license mit licenses", -2: "general public public license", -3: "İMIT license é mit license"}
    every = texts | made
    rows = license_scan.scan(spark.createDataFrame(list(every.items()), "doc_id long, text string"), ["doc_id"]).collect()
    for r in rows:
        words = words_of.findall(every[r.doc_id].translate(LOWER))
        places = [(i, label) for i in range(len(words)) for phrase, label in license_scan.PHRASES.items() if tuple(words[i : i + len(phrase)]) == phrase]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_join_is_exact(spark):
    """Random blocks and templates against every pair."""
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(30)]
    templates = [(f"l{i}", "line", " ".join(rng.sample(vocabulary, rng.randrange(1, 9)))) for i in range(12)]
    texts = {d: "\n".join(" ".join(rng.choices(vocabulary + ["zz", "yy"], k=rng.randrange(0, 12))) for _ in range(rng.randrange(0, 5))) for d in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan.scan(docs, ["doc_id"], templates, {"line": 0.7}).collect()}
    for d, t in texts.items():
        found = {}
        for block in t.split("\n"):
            for label, _, wording in templates:
                tokens = set(wording.split())
                part = len(tokens & set(block.split())) / len(tokens)
                if part >= 0.7 - 1e-12:
                    found[label] = max(found.get(label, 0), part)
        assert got[d] == (",".join(sorted(found)), round(max(found.values(), default=0), 9)), d


# --- language


def plain_likelihood(word, model, column):
    text = "▁" + word
    best = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            k = model.pieces.get(text[s:e])
            if k is None and s == e - 1:
                k = len(model.pieces)
            if k is not None:
                best[e] = np.logaddexp(best[e], best[s] + model.log_p[k, column])
    return best[-1]


def test_segmentations_are_summed(spark):
    model = language_id.fit(spark, spark.read.parquet(f"{SF}/documents.parquet"), per_language=20)
    # Runs that the vocabulary lacks, and any script, however long: no sum underflows, so languages stay apart.
    unknown = "".join(random.Random(3).choice("漢字仮名交じり文") for _ in range(250))
    words = ["the", "haus", "ç", "zzzzqqq", "a" * 40, "漢字", "q" * 48, "ж" * 200, "xq" * 300, unknown, ""]
    scores = language_id.word_scores(words, model)
    assert all(len(set(scores[i].tolist())) == len(model.languages) for i in range(len(words)))
    for i, w in enumerate(words):
        for c in range(len(model.languages)):
            assert scores[i, c] == pytest.approx(plain_likelihood(w, model, c), rel=1e-9)
    # Probabilities of all pieces sum to one in each language.
    assert np.exp(model.log_p).sum(axis=0) == pytest.approx(np.ones(len(model.languages)))


def test_em_raises_the_likelihood():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "▁ab"])}
    counts = {"x": {"abab": 5.0, "ba": 3.0, "aab": 2.0}}
    values = []
    for rounds in (1, 3, 8):
        model = language_id.fit_words(counts, pieces, rounds, prior=1e-6)
        values.append(sum(n * language_id.word_scores([w], model)[0, 0] for w, n in counts["x"].items()))
    assert values[0] <= values[1] + 1e-9 <= values[2] + 1e-6


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    held = [(rows[d.doc_id].lang_pred, d.lang) for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    assert sum(a == b for a, b in held) >= 0.98 * len(held)


# --- packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(["<|endoftext|> x", "don't STOP", " \n\t", "Ⅷ ﬁ ß", " a b"]), min_size=1, max_size=6))
def test_chunks_give_the_tokenizers_ids(parts):
    tokens = packing.ChunkTokenizer.opened(public_tokenizers.path("word_bpe_49k.json"))
    ids, lengths = tokens.encode(pa.array(parts))
    at = 0
    for text, n in zip(parts, lengths):
        assert ids[at : at + n].tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
        at += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 300) | st.sampled_from([31, 32, 33, 63, 64, 65, 127, 128]), max_size=120), st.sampled_from([64, 100]))
def test_bins_hold_every_token_once(sizes, capacity):
    packer = packing.Packer(capacity)
    for i, n in enumerate(sizes):
        packer.put(packing.Text(i, n, 0, np.arange(n, dtype="<u4").tobytes()))
    packer.close()
    covered, rows = defaultdict(list), defaultdict(list)
    for p in packer.pieces:
        covered[p.text.doc].append((p.start, p.length))
        rows[p.sequence].append((p.offset, p.length))
        assert p.text.crc(p.start, p.length) == zlib.crc32(np.arange(p.start, p.start + p.length, dtype="<u4").tobytes())
    for i, n in enumerate(sizes):
        assert [s for s, _ in sorted(covered[i])] == [0, *np.cumsum([m for _, m in sorted(covered[i])])[:-1]] and sum(m for _, m in covered[i]) == n
    for row in rows.values():
        size = sum(m for _, m in row)
        assert [o for o, _ in sorted(row)] == [0, *np.cumsum([m for _, m in sorted(row)])[:-1]]
        assert size == capacity or size < capacity and size & (size - 1) == 0
    assert not packer.rooms and not packer.held and not packer.room


def test_texts_that_fit_stay_whole():
    """Classes of 1 / k, k texts to a bin; what is cut is about one text a bin."""
    rng = random.Random(5)
    packer, sizes = packing.Packer(), [min(20_000, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(20_000)]
    for i, n in enumerate(sizes):
        packer.put(packing.Text(i, n, 0, b""))
        assert len(packer.held) <= 200 and len(packer.open) <= 2 * 64
    packer.close()
    sequences = {p.sequence for p in packer.pieces}
    assert len(packer.pieces) <= len(sizes) + 1.3 * len(sequences)
    pieces = Counter(p.text.doc for p in packer.pieces)
    assert sum(n == 1 for n in pieces.values()) >= 0.9 * sum(n <= 4096 for n in sizes)
    bins = packing.Packer(60)
    for i in range(9):
        bins.put(packing.Text(i, 18, 0, b""))
    assert [(p.sequence, p.offset) for p in sorted((p for ps in bins.held.values() for p in ps), key=lambda p: p.text.doc)] == [(i // 3, i % 3 * 18) for i in range(9)]


def check_packing(rows, texts):
    tokenizer = packing.ChunkTokenizer.opened(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array(tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda r: r.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0  # nothing to pad


def test_packing_of_table(spark, texts):
    rows = queries.op10_packing(spark, SF).collect()
    check_packing(rows, texts)
    full = sum(r.doc_tokens // 4096 for r in rows if r.start == 0)
    assert len(rows) <= len(texts) + full + 1.3 * len({r.sequence_id for r in rows})


def plain_first_kept(spark, texts, span=suffix_dedup.SPAN):
    """Each text without the bytes of strings that stand in a text of lesser hash, or before in the same one."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    key = {r.i: r.h for r in frame.selectExpr("i", "xxhash64(t) AS h").collect()}
    seen, out = set(), {}
    for i in sorted(key, key=key.get):
        raw, hit = texts[i].encode(), [False] * len(texts[i].encode())
        for k in range(len(raw) - span + 1):
            if raw[k : k + span] in seen:
                hit[k : k + span] = [True] * span
            seen.add(raw[k : k + span])
        cuts = [k for k in range(len(raw) + 1) if k in (0, len(raw)) or hit[k] != hit[k - 1]]
        out[i] = "".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(cuts, cuts[1:]) if not hit[a])
    return [out[i] for i in range(len(texts))]


def test_one_place_of_each_repeat_stays(spark):
    """Passages within and across texts, texts that lie in others, and runs of one character."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    passage = [" ".join(word() for _ in range(n)) for n in (60, 45, 90)]
    own = lambda: " ".join(word() for _ in range(rng.randint(0, 80)))
    texts = [own() + "".join(rng.choice(passage) + own() for _ in range(rng.randint(0, 4))) for _ in range(40)]
    texts += [passage[0], passage[2] + passage[1], "a" * 700, "b" + "a" * 450, "ab" * 300, "", "short"]
    texts = list(dict.fromkeys(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(spark, frame, as_text=True, keep_first=True).collect()}
    assert [got[i] for i in range(len(texts))] == plain_first_kept(spark, texts)
    assert all(any(p[:100] in k for k in got.values()) for p in passage)


def test_pipeline_takes_effect(spark, texts):
    """Of the documents that the last stage packs: no near copies, no repeats, no benchmark items; clean ones stay whole."""
    step = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, SF).collect(), step.schema)
        kept.append({r.doc_id: r.text for r in step.collect()})
    first, second, third, last = kept
    # The stage joins on five words and 0.8; three words and 0.9 are the rule of the op6 query alone.
    assert set(second) == {d for d, (_, c) in plain_groups(first, 5, 80).items() if d == c}
    ids = sorted(second)
    for d, rest in zip(ids, plain_first_kept(spark, [second[d] for d in ids])):
        assert third.get(d, "") == rest
    assert set(last) <= set(third) and all(last[d] == third[d] for d in last)
    check_packing(corpus_pipeline.run(spark, SF).collect(), last)
