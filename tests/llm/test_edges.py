"""Every corpus operator over awkward rows: null and empty cells, very long texts, ties, repeats, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomstone.llm import decontamination, html_extract, jaccard_join, language_id, license_scan, packing, quality_rules, sharding, suffix_dedup, url_filter

SAY = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew potions near a river of glass and stone "
ROWS = [
    (1, SAY * 4, "en"),
    (1, SAY * 4, "en"),
    (1, SAY * 4, "en"),
    (2, SAY * 4 + "tail", "en"),
    (3, None, None),
    (4, "", "de"),
    (5, " \t\n ", "de"),
    (None, "der schnelle braune fuchs springt heute nicht mehr", "de"),
    (6, "x" * 300_000, None),
    (7, "words " * 60_000, "en"),
    (8, "é漢字\U0001f600 \u00a0 \u0085 ﬁn", "fr"),
    (9, "12 34 %% ##", "en"),
    (None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dk long, part int, n int, bucket int, __p string, leaks int, row_number int, name string, `a.b` int"


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "src", None if r[1] is None else len(r[1]), 1, 2, 3, 4, "p", 5, 6, "n", 7) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark).limit(0)


def test_suffix_dedup(spark, docs, none):
    got = suffix_dedup.dedup_documents(spark, docs).collect()
    assert len(got) == len(ROWS)
    by = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got)
    assert by.count((len(SAY) * 4, len(SAY) * 4, 1)) == 3 and by.count((0, 0, 0)) == 3
    assert (300_000, 300_000, 1) in by and (360_000, 360_000, 1) in by
    assert suffix_dedup.dedup_documents(spark, none).count() == 0
    wide = suffix_dedup.remove_repeats(spark, docs)
    assert set(docs.columns) - {"text"} <= set(wide.columns)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 0), (9, 0)], "doc_id long, quality int")
    got = quality_rules.judge_documents(docs, labels).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[7].n_words == 60_000 and by[7].n_repeat_words == 60_000 and by[7].base_failed
    assert by[9].n_symbols == 4 and by[6].n_words == 1 and by[6].word_chars == 300_000
    assert quality_rules.judge_documents(none, labels.limit(0)).count() == 0


def test_sharding(spark, docs, none):
    got = sharding.shard_documents(spark, docs, 4).collect()
    sizes = [0] * 4
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
        sizes[s] = len(slots)
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    assert sharding.shard_documents(spark, none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, SAY), (2, None), (3, ""), (4, "the lazy"), (1, SAY), (None, SAY.upper())], "item_id long, text string")
    got = decontamination.leaked(spark, docs, items).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(1, 0), (1, 0), (1, 0), (1, 1), (1, 1), (1, 1), (1, 4), (1, 4), (1, 4), (2, 0), (2, 1), (2, 4)]
    assert all(r.edits == 0 and r.first_word == (6 if r.item_id == 4 else 0) for r in got)
    assert decontamination.leaked(spark, none, items).count() == 0
    assert decontamination.leaked(spark, docs, items.limit(0)).count() == 0
    kept = decontamination.clean_documents(spark, docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4


def test_url_filter(spark):
    urls = [None, "", "nope", "http://", "https://A.Example.org/es/x?y", "http://x.example.org/en/12#f", "ftp://ads-track.example.com", "http://sub.ADS-TRACK.example.com/fr/1", "http://org", "http://org/", "a://b://c/d", "http://" + "a." * 3000 + "com/de/", "http://example.com?x=/fr/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(spark, pages, url_filter.RULES, url_filter.BLOCKED_HOSTS).collect()}
    assert len(got) == len(urls)
    assert [got[i].verdict for i in range(13)] == ["allow", "allow", "allow", "allow", "block", "block", "block", "allow", "allow", "allow", "allow", "block", "allow"]
    assert [got[i].rule for i in (4, 5, 6, 7, 8, 9, 11, 12)] == ["example.org/es/", "example.org/en/1", None, "com/fr/", None, "org/", "com/de/", None]
    assert (got[10].host, got[10].path) == ("b:", "//c/d") and (got[0].host, got[0].path) == ("", "")
    assert url_filter.filter_urls(spark, pages.limit(0), url_filter.RULES, []).count() == 0


def test_jaccard(spark, docs, none):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard_join.linked_groups(spark, docs).collect())
    by = [(d, n) for d, n, _ in got]
    assert len(got) == len(ROWS) and by.count((3, 0)) == 1 and (6, 1) in by and (7, 1) in by
    assert [c for d, _, c in got if d == 1] == [1, 1, 1] and [c for d, _, c in got if d == 4] == [4]
    assert jaccard_join.linked_groups(spark, none).count() == 0
    assert jaccard_join.one_of_each(spark, docs).columns == docs.columns


def test_html(spark):
    sources = [None, "", "plain only", "<p>a<p>b", "<", "<html><body></body></html>", "<div>" * 5000 + "deep" + "</div>" * 5000, "<p>" + "long " * 100_000, "<!-- x", "<script>var a='<p>no</p>'", "<p>&lt;b&gt; &amp; &#233;&nbsp;x</p>", "<p class='a\"b'>q</p></div></body>"]
    pages = spark.createDataFrame([(i, "u", s, "t", 9) for i, s in enumerate(sources)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark, pages).collect()}
    assert got[0] == got[1] == got[5] == ("", 0) and got[2][0] == "plain only" and got[3][0] == "a\n\nb"
    assert got[6][0] == "deep" and got[7][1] == 499_999 and got[8][0] == got[9][0] == "" and got[10][0] == "<b> & é x" and got[11][0] == "q"
    assert html_extract.extract(spark, pages.limit(0)).count() == 0


def test_licenses(spark, docs, none):
    got = license_scan.scan(docs, ["doc_id"]).collect()
    assert len(got) == len(ROWS) and all(r.n_base == 0 and r.labels == "" and r.score == 0 and r.first_word is None for r in got)
    assert license_scan.scan(none, ["doc_id"]).count() == 0
    assert license_scan.scan(docs, ["doc_id"], templates=[]).count() == len(ROWS)


def test_language(spark, docs, none):
    got = language_id.identify_documents(spark, docs).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {3, 4, 5, 9} <= und and 1 not in und
    assert not [r for r in got if r.doc_id is None and r.held_out]
    assert language_id.identify_documents(spark, none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_documents(spark, unlabelled).collect()} == {"und"}


def test_packing(spark, docs, none):
    got = packing.pack(spark, docs).collect()
    assert {r.doc_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert sum(r.start == 0 for r in got) == len(ROWS)
    assert packing.pack(spark, none).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, "no such passage stands in any of these texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, none):
        step = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/{table.count()}-{k}")
            step = spark.read.parquet(f"{tmp_path}/{table.count()}-{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert step.columns == corpus_pipeline.COLUMNS, name
