import base64
import hashlib
import random
import re

import pytest

from passagework.llm import secrets
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(text):
    """The base kinds by one plain pass of each pattern over the whole text."""
    out = []
    for kind, pattern, group, least in (
            ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             1, 6), ("access", "(AKIA[A-Z0-9]+)", 1, 20), ("hex", "([0-9a-f]+)", 1, 24)):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text, flags)
                if len(m[group]) >= least]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[0], order.index(s[2])))


TEXTS = ["", "plain words only", 'Password = "hunter22"', "api_key: 12345", "APIKEY='a.b.c.d'",
         "xtoken=" + "a1" * 12 + " secret:" + "0" * 24, "AKIA" + "Q" * 16 + "x", "AKIA" + "Q" * 15,
         "toſken secret", "ſecret=abcdef1", "é" * 5 + " passwd:  'zzzzzz", "f" * 23 + "g" + "e" * 24,
         "token=token=abcdef", "pass " * 50_000 + "secret=abcdefg", "AKIAAKIA" + "7" * 20 + "/" + "abc" * 9]


@pytest.mark.parametrize("text", TEXTS)
def test_base_kinds(text):
    assert [s for s in secrets.find(text) if s[2] != "random"] == brute(text)


def test_random_keys_are_found_and_names_are_not():
    rng = random.Random(5)
    keys = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(300)]
    keys += [base64.b32encode(rng.randbytes(25)).decode() for _ in range(300)]
    hits = sum(any(s[2] == "random" for s in secrets.find(f"see {key} here")) for key in keys)
    assert hits >= 0.95 * len(keys)
    names = ["VeryLongIdentifierInSomeProgram", "2024-01-01_report_of_the_year", "A" * 40, "AB" * 20,
             "12345678901234567890123", "path/to/some/file_with_a_name", "abcdefghijklmnopqrstuvwxyz",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "-" * 50, "Donaudampfschifffahrtsgesellschaft"]
    for name in names:
        assert secrets.find(name) == [], name


def test_more_candidates_need_more_evidence():
    assert secrets.discoveries([8.0]) == [True]
    assert secrets.discoveries([8.0] + [None] * 99) == [False] * 100
    assert secrets.discoveries([]) == []


def test_query_agrees_with_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_secret_scans"][0](spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        base = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in base)
                                                     for k in ("assign", "access", "hex")]
        assert [x for x in r.spans.split(",") if not x.startswith("random")] == joined.split(",")


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x password=abcdefgh y", "c"), (3, "x password=abcdefgh y", "c"),
            (4, "clean text", None), (None, "AKIA" + "Z" * 20, "found")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    assert [r.text for r in got.collect()] == [None, "", "x [SECRET] y", "x [SECRET] y", "clean text", "[SECRET]"]
    assert secrets.redact(docs.limit(0)).count() == 0 == secrets.scan(docs.limit(0)).count()
    assert [r.found for r in secrets.scan(docs).collect()][:2] == [[], []]


def test_long_and_repeated_spans():
    text = "secret=abcdefgh " * 3000
    assert len(secrets.find(text)) == 3000
    assert secrets.mask(text, "#") == "# " * 3000
