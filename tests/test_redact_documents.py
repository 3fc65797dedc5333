"""The redaction of whole tables against plain Python: texts in any script, PEM keys and null texts as well."""

import hashlib
import re

import pytest

from loomstone.plans import registry

T = "[REDACTED]"
CLASSES = [
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", re.S, T),
    (r"\bbearer\s+[A-Za-z0-9._=\-]{8,}", re.I, f"Bearer {T}"),
    (r"\b(?:sk-[A-Za-z0-9]{8,}|ghp_[A-Za-z0-9]{8,}|xox[baprs]-[A-Za-z0-9\-]{8,})\b", 0, T),
    (r"\b(password|passwd|secret|api[_\-]?key|token)\b(\s*[:=]\s*)([^\s,;\"']+)", re.I, rf"\1\2{T}"),
    (r"([?&](?:access_token|token|api_key)=)([^&\s]+)", re.I, rf"\1{T}"),
    (r"\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b", re.I, T),
    (r"\b\+?\d[\d\-\(\) ]{8,}\d\b", 0, T),
]
KEY = "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----"
MADE = {
    1: "Écrivez à marie@exemple.fr à midi.",
    2: f"clé :\n{KEY}\nfin",
    3: f"{KEY} and {KEY}",
    4: "-----BEGIN PRIVATE KEY-----\nnever ended",
    5: "für Jürgen: password=geheimniß, Tel. 0301 234-5678",
    6: "电话 13912345678 结束",
    7: None,
    8: "",
    9: "nur ASCII, bearer abcdefgh12",
    10: "\x01\x02\x03\x04" * 8,
    11: "écoute\x00",
}
WANT = {1: f"Écrivez à {T} à midi.", 2: f"clé :\n{T}\nfin", 3: f"{T} and {T}", 4: MADE[4], 5: f"für Jürgen: password={T}, Tel. {T}", 6: f"电话 {T} 结束", 7: None, 8: "", 9: f"nur ASCII, Bearer {T}", 10: T, 11: T}


def plain(text):
    if text is None:
        return None
    control = sum(1 for c in text if (c < " " or "\x7f" <= c <= "\x9f") and c not in "\n\r\t")
    if "\x00" in text or len(text) >= 16 and control * 5 >= len(text):
        text = T
    for pattern, flags, new in CLASSES:
        text = re.sub(pattern, new, text, flags=flags)
    return text


def digest(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


def test_made_rows(spark, tmp_path):
    assert {k: plain(v) for k, v in MADE.items()} == WANT
    spark.createDataFrame(list(MADE.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["redact_documents"](spark, str(tmp_path)).collect()
    assert len(got) == len(MADE) and {r.doc_id: r.digest for r in got} == {k: digest(v) for k, v in WANT.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    texts = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    got = registry.queries()["redact_documents"](spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(texts)
    assert sorted((r.doc_id, r.digest or "") for r in got) == sorted((r.doc_id, digest(plain(r.text)) or "") for r in texts)
    assert any(r.text and not r.text.isascii() for r in texts)
