"""Column functions against literal examples and plain-Python counterparts."""

import pytest
from pyspark.sql import functions as F

from loomstone.functions import jsontext, redact, text, timeparse


def _one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [("  a  b \r\n", "a b"), ("é\u0085x", "é x"), ("", ""), ("   ", "")])
def test_one_spaced(spark, raw, want):
    assert _one(spark, text.one_spaced, raw) == want


@pytest.mark.parametrize("n, want", [(280, 280), (281, 283)])
def test_excerpt_length(spark, n, want):
    assert len(_one(spark, text.excerpt, "\U0001f600" * n)) == want


def test_excerpt_of_nothing(spark):
    assert _one(spark, text.excerpt, "  ") is None and _one(spark, text.excerpt, None) is None


@pytest.mark.parametrize("most, want", [(10, "abcdefg..."), (3, "..."), (2, ".."), (0, ""), (26, "abcdefghijklmnopqrstuvwxyz")])
def test_truncated(spark, most, want):
    assert _one(spark, lambda c: text.truncated(c, most), "abcdefghijklmnopqrstuvwxyz") == want


def _plain_bytes(value, most):
    if len(value.encode()) <= most:
        return value
    if most <= 3:
        return "." * most
    out = ""
    for c in value:
        if len((out + c).encode()) > most - 3:
            break
        out += c
    return out + "..."


@pytest.mark.parametrize("most", range(0, 16))
def test_truncated_bytes(spark, most):
    for value in ("aééé漢字\U0001f600z", "plain ascii text", "é"):
        assert _one(spark, lambda c: text.truncated_bytes(c, most), value) == _plain_bytes(value, most)


def test_key_values(spark):
    got = spark.sql("SELECT array('a=1', 'b=', '=c', 'a=2', 'd=x=y', 'e') AS t").select(text.key_values(F.col("t")).alias("m")).first()["m"]
    assert got == {"a": "2", "d": "x=y"}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1770274803", 1770274803000),
        ("1770274803000", 1770274803000),
        ("1770274803000000", 1770274803000),
        ("1770274803000000000", 1770274803000),
        (" 2026-02-05T07:00:03Z ", 1770274803000),
        ("2026-02-05T08:00:03.5+01:00", 1770274803500),
        ("2026-02-05", None),
        ("2026-02-05T07:00:03", None),
        ("-5", None),
        ("1969-12-31T23:59:59Z", None),
        ("2026-13-05T07:00:03Z", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_ms(spark, raw, want):
    assert _one(spark, timeparse.parse_ms, raw) == want


def test_format_and_buckets(spark):
    ms = 1770274803007
    assert _one(spark, timeparse.format_ms, ms, "long") == "2026-02-05T07:00:03.007Z"
    assert _one(spark, timeparse.day_bucket, ms, "long") == "2026-02-05"
    assert _one(spark, timeparse.hour_bucket, ms, "long") == "2026-02-05T07:00:00Z"
    assert _one(spark, timeparse.rfc3339_seconds, "2026-02-05T07:00:03.9Z") == 1770274803


def test_durations(spark):
    rows = spark.createDataFrame([(5, 1, 9, 3), (None, 10, 30, 3), (None, 30, 10, 3), (None, 30, 10, None)], "e long, s long, t long, g long")
    got = [r["d"] and (r["d"].duration_ms, r["d"].source, r["d"].quality) for r in rows.select(timeparse.duration(F.col("e"), F.col("s"), F.col("t"), F.col("g")).alias("d")).collect()]
    assert got == [(5, "explicit", "high"), (20, "paired", "medium"), (3, "heuristic", "low"), None]


@pytest.mark.parametrize(
    "raw, want, classes",
    [
        ("Authorization: Bearer abcdefgh12345", "Authorization: Bearer [REDACTED]", ["bearer_token"]),
        ("key sk-abcdefgh12 end", "key [REDACTED] end", ["api_token"]),
        ("password = hunter22;", "password = [REDACTED];", ["secret_assignment"]),
        ("GET /x?api_key=abc&y=1", "GET /x?api_key=[REDACTED]", ["secret_assignment"]),
        ("GET /x?access_token=abc&y=1", "GET /x?access_token=[REDACTED]&y=1", ["url_query_token"]),
        ("write to me@site.org", "write to [REDACTED]", ["email"]),
        ("call 030-123 45678 now", "call [REDACTED] now", ["phone"]),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[REDACTED]", ["private_key_pem"]),
        ("a\x00b", "[REDACTED]", ["binary_blob"]),
        ("\x01" * 4 + "a" * 16, "[REDACTED]", ["binary_blob"]),
        ("plain\ttext\n", "plain\ttext\n", []),
    ],
)
def test_redaction(spark, raw, want, classes):
    got = _one(spark, redact.redaction, raw)
    assert (got.text, got.classes, got.pii_redacted) == (want, classes, bool(classes))
    value, found, _ = redact.redact_value({"k": [raw]})
    assert value == {"k": [want]} and sorted(found) == classes


def test_redact_then_cut(spark):
    got = _one(spark, lambda c: redact.redaction(c, 12), "me@site.org and a long tail")
    assert (got.text, got.truncated) == ("[REDACTED...", True)


@pytest.mark.parametrize(
    "raw, want",
    [
        ('" a "', "a"),
        ('["a", 1, {"text": "b"}, null]', "a\nb"),
        ('{"content": "", "message": {"body": "m"}, "text": " "}', "m"),
        ('{"zeta": "z", "alpha": "a", "id": "no", "role": "no"}', "a\nz"),
        ("12", None),
        ("not json", None),
    ],
)
def test_extract_text(spark, raw, want):
    assert _one(spark, jsontext.extract_text, raw) == want


def test_block_text(spark):
    blocks = '[{"type":"text","text":"A"},{"type":"tool_use","input":{"text":"no"}},{"type":"thinking","thinking":"B"},"C"]'
    assert _one(spark, jsontext.extract_blocks, blocks) == "A\nB\nC"


def test_scalars_of_json(spark):
    row = spark.createDataFrame([('{"a":" x ","n":5,"b":true,"e":"","z":null,"o":{"k":[1]}}',)], "j string").select(F.parse_json("j").alias("v"))
    v = F.col("v")
    got = row.select(
        jsontext.string_at(v, "a"), jsontext.string_at(v, "n"), jsontext.scalar_at(v, "n"), jsontext.scalar_at(v, "b"), jsontext.scalar_at(v, "o"), jsontext.first_string(v, "e", "z", "a"), jsontext.json_at(v, "o"), jsontext.json_at(v, "z"), jsontext.first_present_string(v, "n", "a")
    ).first()
    assert tuple(got) == ("x", None, "5", "true", None, "x", '{"k":[1]}', None, None)
