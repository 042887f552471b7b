import random
import unicodedata

import pytest

from barloom.llm import canonical as C
from tests.conftest import rows

SAME = [
    ("ＡＢＣ１２３，％", "ABC123,%"), ("café", "café"), ("a​b­c﻿", "abc"), ("x y　z w\tv", "x y z w v"), ("a‐b‑c–d", "a-b-c-d"),
    ("сору раѕtе", "copy paste"), ("ﬁne ﬂow ﬀ", "fine flow ff"), ("⼀⼤⻅", "一大见"), ("한", "한"), ("が", "が"), ("line\r\nend", "line\nend"), ("e‍́", "é"), ("ВЕТА", "BETA"), ("Κ́x", "Ḱx"), ("1️⃣"[0] + "️", "1"),
]
DIFFERENT = [("R²", "R2"), ("für", "fur"), ("Abc", "abc"), ("①", "1"), ("a b", "ab"), ("l0", "lO"), ("“a”", '"a"'), ("ß", "β")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_looks(a, b):
    assert C.canonical(a) == C.canonical(b) == b


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different_looks(a, b):
    assert C.canonical(a) != C.canonical(b)


def test_real_words_keep_their_script():
    for t in ("Привет, мир", "Ελληνικά λόγια", "тест сору", "đường phố", "größere Lücke", "가나다 라마", "中文，测试。".replace("，", ",")):
        assert C.canonical(t) == unicodedata.normalize("NFC", t) or t == "тест сору"
    assert C.canonical("тeст") == "тест"  # a Latin e among Cyrillic letters
    assert C.canonical("тест сору") == "тест copy"


def test_stable_text_is_returned_as_it_is():
    t = "plain text, ünïcödé 中文 " * 50
    assert C.canonical(t) is t


def test_splicing_equals_whole_text_normalization_and_is_idempotent():
    rng = random.Random(1)
    pool = list("abcXYZ019 .,-\n") + list("аеосрВЕК éüñ ß中文がカ") + ["́", "̈", "​", "­", " ", "　", "Ａ", "ｂ", "，", "ﬁ", "²", "‐", "ᄀ", "ᅡ", "ᆨ", "⼀", "σ", "β", "゙"]
    for _ in range(1500):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        whole = C.whole(t)
        assert C.canonical(t) == whole, repr(t)
        assert C.canonical(whole) == whole, repr(t)


def test_long_text():
    t = ("слово text ﬁ " * 40_000)
    assert C.canonical(t) == "слово text fi " * 40_000


def brute(docs):
    docs = [(i, t) for i, t in docs if t and i is not None]
    return sorted({(min(i, j), max(i, j)) for i, t in docs for j, u in docs if i < j and t != u and C.canonical(t) == C.canonical(u)})


def test_pairs(spark):
    docs = [(1, "abc"), (2, "аbс"), (3, "abc"), (4, "a​bc"), (5, None), (6, ""), (7, "x y"), (8, "x y"), (9, "R²"), (10, "R2"), (11, "​"), (12, "‌"), (None, "abc")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as canonical_text", "1 as __c")
    assert rows(C.lookalike_pairs(C.lookalike_classes(df))) == [tuple(p) for p in sorted(brute(docs), key=lambda r: tuple((False, str(x)) for x in r))]
    assert rows(C.lookalike_classes(df.limit(0))) == []
    classes = {r.doc_id: tuple(r)[1:] for r in C.lookalike_classes(df).collect()}
    assert classes[1] == classes[3] == (1, 1, 3, 4) and classes[2] == (1, 2, 3, 4) and classes[4] == (1, 4, 3, 4)
    assert set(classes) == {1, 2, 3, 4, 7, 8, 11, 12} or set(classes) == {1, 2, 3, 4, 11, 12}
    got = {r.doc_id: r.canonical_text for r in C.canonical_documents(df.where("doc_id is not null")).collect()}
    assert got[2] == "abc" and got[5] is None and got[6] == "" and got[11] == "" and got[9] == "R²"


def test_line_end_at_the_end_of_a_text(spark):
    texts = ["abc\r\n", "abc\r", "abc\n", "a\nb\r\n", "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.c for r in df.select("i", C.canonical_text("t").alias("c")).orderBy("i").collect()] == [C.canonical(t) for t in texts]
    assert C.canonical("abc\r\n") == "abc\n"


def test_every_letter_of_the_table_comes_to_its_latin_twin():
    for c, latin in C.LOOKALIKES.items():
        for word in (f"{c}zq", f"N{c}", f"{c}{c}R", f"fd{c}"):
            plain = word.replace(c, latin)
            assert C.canonical(word) == plain == C.canonical(plain), (c, latin, word)
    for word, plain in (("αlpha", "alpha"), ("ρort", "port"), ("ιota", "iota"), ("γes", "yes"), ("սser", "user"), ("ϲode", "code"), ("уoυ", "you"), ("жode", "жode"), ("երկոց", "երկոց"), ("հո", "hn"), ("κόσμος", "κόσμος")):
        assert C.canonical(word) == plain


def test_a_file_of_the_public_table_adds_letters(tmp_path):
    path = tmp_path / "confusables.txt"
    path.write_text("\ufeff# table\n0585 ;\t006F ;\tMA\t# there already\n0564 ; 0031 ; MA\n006D ;\t0072 006E ;\tMA\n13E8 ;\t0034 ;\tMA\n\n", encoding="utf-8")
    assert C.lookalikes(str(path)) == C.LOOKALIKES
    path.write_text("03BA ;\t006B ;\tMA\n03BA ;\t0078 ;\tMA\n", encoding="utf-8")
    C.lookalikes.cache_clear()
    assert C.lookalikes(str(path))["κ"] in ("k", "x")


def test_stable_characters_by_the_quick_check():
    plain, run, _, joining = C.tables()
    for c in ("\u0301", "\u3099", "\u1161", "\u11a8", "\u093c", "\u09be"):
        assert c in joining and run.fullmatch(c)
    for c in ("中", "가", "a", "é", "\u093f"):  # is_normalized says yes, and nothing joins
        assert not run.fullmatch(c)
    for code in (0xFF21, 0x2126, 0xF900, 0xFB01, 0x1D400):
        assert plain[code] and not unicodedata.is_normalized("NFKC", chr(code))
