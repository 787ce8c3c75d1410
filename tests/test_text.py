"""Cleaning and sections: tables of literal input and output, and properties of random texts."""

import random
import re

import pytest

from passagework.functions import text as tx

NBSP, ZWSP, IDEO = "\u00a0", "\u200b", "\u3000"

NORMALIZED = [("ﬃ", "ffi"), ("ﬁn", "fin"), ("½", "1⁄2"), ("e\u0301", "é"), (f"a{NBSP}b", "a b"), ("…", "..."),
              ("Ⅳ", "IV"), ("①", "1"), (IDEO, " "), ("\u1e9b\u0323", "ṩ"), ("plain", "plain"), ("", "")]
REPAIRED = [("ﬁ ﬂ ﬀ ﬃ ﬄ", "fi fl ff ffi ffl"), ("‘a’ “b”", "'a' \"b\""), ("1–2—3", "1-2-3"),
            ("wait…", "wait..."), (f"x{NBSP}y{ZWSP}z", "x yz"), ("……", "......"), ("é", "é")]
UNFURNISHED = [("page 3", ""), ("a\nPage 1 of 9\nb", "a\nb"), ("  PAGE  12  OF 3 ", ""), ("page", "page"),
               ("page 3 a", "page 3 a"), ("page x", "page x"), ("12", ""), (" 7 \nx", "x"), ("٣", ""), ("1 2", "1 2"),
               ("- 12 -", ""), ("-12-", ""), ("- 12", "- 12"), ("-- 12 --", "-- 12 --"), ("© 2024 Me", ""),
               ("a © b", "a © b"), ("Confidential", ""), (" CONFIDENTIAL \t", ""), ("confidential!", "confidential!"),
               ("a\n\nb", "a\n\nb"), ("", ""), ("page 3\n", ""), ("3\n4", "")]
SPACED = [("a  b", "a b"), ("a \t b", "a b"), ("\ta", " a"), ("a  \nb", "a\nb"), ("a\n\n\nb", "a\n\nb"),
          ("a\n\n\n\n\nb", "a\n\nb"), ("a\n \n\nb", "a\n\n\nb"), (f"a{NBSP} b", f"a{NBSP} b"), (f"a{NBSP}\nb", "a\nb"),
          ("a\r\nb", "a\nb"), ("  ", ""), ("a\n", "a\n"), ("", "")]
UNCONTROLLED = [("a\x07b", "ab"), ("a\x00", "a"), ("a\tb\nc\rd", "a\tb\nc\rd"), ("\x0b\x0c", ""), ("\x1c\x1fx", "x"),
                ("\x7f\x85\x9f", ""), (NBSP, NBSP), ("é", "é")]
STRIPPED = [("  a ", "a"), ("\n\ta b\r\n", "a b"), (f"{NBSP}{IDEO}a\x85", "a"), ("\x1c\x1fa", "a"), (f"{ZWSP}a", f"{ZWSP}a"), (" ", "")]
NO_URLS = [("see http://x.y/z?q=1 now", "see  now"), ("https://é.org", ""), ("xhttp://a b", "x b"), ("http:// a", "http:// a"),
           ("ftp://a.b", "ftp://a.b"), ("HTTP://a.b", "HTTP://a.b"), ("http://a\nb", "\nb")]
NO_EMAILS = [("to a.b@ex.org, ok", "to  ok"), ("@", "@"), ("x@", "x@"), ("@y.z", "@y.z"), ("u@v", "u@v"), ("u@v.", "u@v."),
             ("a@b.c@d.e", ""), ("(me@x.y)", ""), ("a@.b", "a@.b"), ("a @b.c", "a @b.c"), ("é@ü.de", "")]
PUNCTUATED = [("....", "..."), ("...", "..."), ("a......b", "a...b"), ("----", "---"), ("---", "---"), ("-----.-----", "---.---"),
              ("!!!!!", "!!!!!"), ("… …", "… …")]
CLEANED = [("Page 3\n\n\n\nA  ﬁne  day.  \n- 4 -\nEnd\x07", "A fine day.\nEnd"), ("© all\n12\nconfidential", ""),
           (f"{NBSP}“Hi”{ZWSP} — there…{NBSP}", '"Hi" - there...'), ("a\n \n\nb", "a\n\n\nb"), ("", ""), ("\x0bpage\t9", "")]
PREPARED = [("Mail a@b.c, see https://x.y ok.....", "Mail see ok..."), ("a ---- b", "a --- b"), ("  http://x  ", ""),
            ("a\n\n\n\nhttp://x\n\nb", "a\n\nb"), ("", "")]


@pytest.mark.parametrize(("function", "cases"), [
    (tx.normalize_unicode, NORMALIZED), (tx.fix_encoding, REPAIRED), (tx.drop_furniture_lines, UNFURNISHED),
    (tx.normalize_whitespace, SPACED), (tx.strip_control, UNCONTROLLED), (tx.strip, STRIPPED), (tx.strip_urls, NO_URLS),
    (tx.strip_emails, NO_EMAILS), (tx.collapse_punctuation, PUNCTUATED), (tx.clean_text, CLEANED),
    (tx.clean_for_embedding, PREPARED)])
def test_by_example(column, function, cases):
    got = column(function, [text for text, _ in cases])
    assert [(t, g) for (t, _), g in zip(cases, got, strict=True)] == cases


ALPHABET = ["a", "B", "7", "٣", " ", "  ", "\t", "\n", "\n\n", "\n\n\n\n", "\r", "\x0b", "\x0c",
            "\x1c", "\x1f", "\x85", NBSP, IDEO, "\x07", "\x00", "\x9f", "-", "-----",
            ".", ".....", "page 3", "Page 1 of 9", "of 2", "©", "CONFIDENTIAL", "confidential ",
            "http://x.y/z?q=1", "https://é.org", "a.b@ex.org,", "@", "x@", "@y.z", "u@v.", "ﬃ",
            "’", "“", "—", "…", ZWSP, "é", "e\u0301"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(1, 14))) for _ in range(3000)]


@pytest.mark.parametrize("function", [
    tx.normalize_unicode, tx.fix_encoding, tx.drop_furniture_lines, tx.strip_control, tx.strip, tx.strip_urls,
    tx.collapse_punctuation])
def test_a_second_pass_changes_nothing(column, texts, function):
    once = column(function, texts)
    assert column(function, once) == once


def test_what_cleaned_texts_never_hold(column, texts):
    for text in column(tx.clean_text, texts):
        assert text == text.strip() and not re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", text)
        assert not set(text) & {"ﬃ", "’", "“", "—", "…", NBSP, ZWSP} and "\t" not in text
    for text in column(tx.clean_for_embedding, texts):
        assert "http://x" not in text and "a.b@ex" not in text and "...." not in text and "----" not in text
        assert not any(line != line.rstrip() for line in text.split("\n"))


def test_lines_without_a_sign_of_dirt_stay(column, texts):
    plain = [t for t in texts if re.fullmatch("[aB.é]+", t) and "...." not in t]
    assert plain and column(tx.clean_for_embedding, column(tx.clean_text, plain)) == plain


def test_null_becomes_empty(column):
    assert column(tx.clean_text, [None]) == [""]
    assert column(tx.is_blank, [None, "", " 　\n", "x"]) == [True, True, True, False]


def test_long_runs_take_linear_time(column):
    """Texts on which a backtracking pattern would take hours."""
    n = 300_000
    cases = {
        "x" * n: "x" * n, "\x0b" * n + "x": "x", "@" * n: "@" * n, "." * n + "@": "...@",
        "a@b" * n: "a@b" * n, " " * n + "1x": "1x", "page " * n: ("page " * n).strip(),
        "a@b.c" * n + " d": "d", "http://" + "y" * n + " z": "z",
    }
    got = column(lambda c: tx.clean_for_embedding(tx.clean_text(c)), list(cases))
    assert [g == want for g, want in zip(got, cases.values())] == [True] * len(cases)


SECTIONED = [
    ("", []), ("  \n \n", []), ("just text", [("Introduction", "just text")]),
    ("1. Soil\nclay\nsand", [("1. Soil", "clay\nsand")]),
    ("before\n2 Water\nafter", [("Introduction", "before"), ("2 Water", "after")]),
    ("USDA\nII.\nrules", [("II.", "rules")]),
    ("USDA\nrules", [("USDA", "rules")]),
    ("V.x\nfive", [("V.x", "five")]), ("XI. Ten\n\n one \ntwo", [("XI. Ten", "one\ntwo")]),
    ("A farmer plants\nrice", [("A farmer plants", "rice")]), ("Rice\nis food", [("Introduction", "Rice\nis food")]),
    ("12\nx", [("12", "x")]), ("1\nx", [("Introduction", "1\nx")]), ("US\nx", [("Introduction", "US\nx")]),
    ("9" * 99 + "\nx", [("9" * 99, "x")]), ("9" * 100 + "\nx", [("Introduction", "9" * 100 + "\nx")]),
    ("1. One\n2. Two\ntext", [("2. Two", "text")]), ("text\n1. Last", [("Introduction", "text")]),
    ("٣٤\nx", [("٣٤", "x")])]


def test_sections_by_example(spark):
    from passagework.operators.cleaning import extract_sections

    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SECTIONED)], "doc_id long, text string")
    got = {}
    for r in extract_sections(frame).orderBy("doc_id", "section_no").collect():
        assert r.section_no == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.heading, r.content))
    assert [(t, got.get(i, [])) for i, (t, _) in enumerate(SECTIONED)] == SECTIONED


def test_sections_lose_no_line_of_text(spark):
    from passagework.operators.cleaning import extract_sections

    rng = random.Random(3)
    body = ["plain text", "indented", "é", "Rice", "of 12", "x. y"]
    docs = ["\n".join(rng.choices([*body, "1. Soil", "", "  ", "A farmer plants"], k=rng.randint(0, 9))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    lines = {}
    for r in extract_sections(frame).orderBy("doc_id", "section_no").collect():
        lines.setdefault(r.doc_id, []).extend(r.content.split("\n"))
        assert r.heading in ("Introduction", "1. Soil", "A farmer plants")
    for i, doc in enumerate(docs):
        assert lines.get(i, []) == [x for x in doc.split("\n") if x in body]
