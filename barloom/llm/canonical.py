"""One consistent form for texts that look the same but are written with other characters."""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.clean import quoted
from barloom.session import stage_table

#: Single letters that look like a Latin letter, by script, from the public table of confusable characters. One letter of a script
#: for each Latin one. A file in the format of that table, named by BARLOOM_CONFUSABLES, adds the rest of it.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V",
    # Greek
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ϝ": "F",
    # Armenian
    "ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u", "ա": "w", "Լ": "L", "Օ": "O", "Տ": "S", "Ս": "U",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꮟ": "b", "Ꮒ": "h", "Ꭵ": "i", "Ꭹ": "y",
    # Coptic
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # phonetic letters and small capitals
    "ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")

#: Radicals that have no decomposition of their own and the ideographs they stand for, from the public table of equivalent ideographs.
RADICALS = {
    "⺁": "厂", "⺇": "几", "⺉": "刂", "⺋": "㔾", "⺌": "小", "⺍": "小", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺒": "巳", "⺓": "幺", "⺕": "彐", "⺖": "忄", "⺗": "心", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺝": "月", "⺞": "歺", "⺟": "母", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺳": "网", "⺶": "羊", "⺷": "羊", "⺸": "羊", "⺹": "耂", "⺺": "肀", "⺻": "聿", "⺼": "肉", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻕": "阜", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀",
}

#: Kinds of hyphen, and blanks other than the plain one (line ends aside).
HYPHENS = "‐‑‒–−­"[:5] + "﹘﹣－"
BLANKS = "\t               　"

#: Compatibility decompositions that change how a text looks are left alone.
SHOWN = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")


#: Latin letters, and those of the scripts and kinds that have twins of them.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"
FOREIGN = "Ͱ-ϿЀ-ԯɐ-ʯ\u0531-\u0587\u13a0-\u13fd\u1d00-\u1d22\u2c80-\u2cf3\ua4d0-\ua4fd\ua731"
#: A word of these letters and their marks.
WORD = re.compile(f"[{LATIN}{FOREIGN}][{LATIN}{FOREIGN}\u0300-\u036f]*")


@functools.cache
def lookalikes(path: str | None = os.environ.get("BARLOOM_CONFUSABLES")) -> dict[str, str]:
    """The fixed letters, and from a file in the public table's format (code; prototype; type) single letters of these scripts that look like a Latin one.

    Of several letters of a script for one Latin letter only the first holds, so that each can be told from its Latin twin and back.
    """
    found = dict(LOOKALIKES)
    there = {(_script(c), latin) for c, latin in found.items()}
    if path:
        with open(path, encoding="utf-8-sig") as file:
            for line in file:
                parts = [x.strip() for x in line.split("#", 1)[0].split(";")]
                if len(parts) < 2 or " " in parts[0] or " " in parts[1]:
                    continue
                c, latin = (chr(int(x, 16)) for x in parts[:2])
                if latin.isascii() and latin.isalpha() and _script(c) in SCRIPTS[1:] and (_script(c), latin) not in there:
                    there.add((_script(c), latin))
                    found[c] = latin
    return found


def _assigned() -> Iterator[str]:
    """Characters that have properties of their own; large blocks of ideographs and syllables, all of them stable, are passed over."""
    for low, high in ((0x80, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x17000), (0x1B000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
        for code in range(low, high):
            if unicodedata.category(chr(code)) not in ("Cs", "Cn", "Co"):
                yield chr(code)


@functools.cache
def tables() -> tuple[dict[int, str], re.Pattern, re.Pattern, frozenset[str]]:
    """Per-character replacements, runs of unstable characters, the letters that go with a run, and the characters that join to one before.

    By the quick-check properties of normalization, from the interpreter's Unicode data. No: the character alone is not normalized, and is
    replaced unless that would show. Maybe: it may combine with the character before it, being the second of a canonical pair or a joining
    Hangul letter. Characters of a combining class may have to change places. Besides these, a character is unstable if it is invisible,
    a blank or hyphen of another kind, or of a script with twins of Latin letters.
    """
    plain: dict[int, str] = {ord(c): "-" for c in HYPHENS} | {ord(c): " " for c in BLANKS} | {ord(c): i for c, i in RADICALS.items()}
    plain |= {0x0D: ""}
    joining = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    alike = lookalikes()  # a letter with a twin is judged with its word
    for c in _assigned():
        code, how = ord(c), unicodedata.decomposition(c)
        if unicodedata.category(c) == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D):
            plain[code] = ""
            continue
        if how and not how.startswith("<") and " " in how and unicodedata.is_normalized("NFC", c):
            joining.add(chr(int(how.split()[1], 16)))
        if unicodedata.combining(c):
            joining.add(c)
        if code in plain or c in alike or unicodedata.is_normalized("NFKC", c):
            continue
        if not unicodedata.is_normalized("NFC", c):
            plain[code] = unicodedata.normalize("NFC", c)
        # spacing accents would fall into a blank and a combining mark
        elif how.startswith("<") and not how.startswith(SHOWN) and not how.startswith("<compat> 0020") and code not in (0xA8, 0xAF, 0xB4, 0xB8):
            plain[code] = unicodedata.normalize("NFKC", c)

    def charset(chars) -> str:
        codes = sorted({ord(c) for c in chars})
        parts, start = [], None
        for i, x in enumerate(codes):
            start = x if start is None else start
            if i + 1 == len(codes) or codes[i + 1] != x + 1:
                parts.append(re.escape(chr(start)) + ("-" + re.escape(chr(x)) if x > start else ""))
                start = None
        return "".join(parts)

    odd = charset([*map(chr, plain), *joining]) + FOREIGN
    run = re.compile(f"[{odd}]+")
    # letters of the scripts that have twins: a word of them is judged whole
    letters = re.compile(f"[{LATIN}{odd}]*")
    return plain, run, letters, frozenset(joining)




@functools.cache
def _script(c: str) -> str:
    name = unicodedata.name(c, "").split(" ", 1)[0]
    return name if name in SCRIPTS else ""


@functools.cache
def _groups() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Letter to the Latin one of its group of alike letters, and from that back to the alphabet of each script."""
    alike = lookalikes()
    to_latin = dict(alike) | {v: v for v in alike.values()}
    back: dict[str, dict[str, str]] = {}
    for c, latin in alike.items():
        script = _script(c)
        # rare letters of Cyrillic and Greek are no reason to take a word for one of that script
        if script and script != "LATIN" and (script not in ("CYRILLIC", "GREEK") or "А" <= c <= "я" or c in "ѕіјЅІЈ" or "Α" <= c <= "ω"):
            back.setdefault(script, {}).setdefault(latin, c)
    return to_latin, back


def _one_script(match: re.Match) -> str:
    """A word in one script: that of its letters without a twin, if they agree and its alphabet has a twin of every other letter; else Latin.

    Twins of a letter are replaced, other letters stay: so all spellings of a word that look alike come to the same. A letter outside the
    table turns no Latin letter unless the whole word can be of its script.
    """
    word = match.group()
    if word.isascii():
        return word
    parts = unicodedata.normalize("NFD", word)
    to_latin, back = _groups()
    own = {_script(c) for c in parts if c not in to_latin} - {""}
    into = back.get(own.pop(), {}) if len(own) == 1 else {}
    if into and not all(to_latin[c] in into for c in parts if c in to_latin):
        into = {}
    parts = "".join(into.get(to_latin[c], to_latin[c]) if c in to_latin else c for c in parts)
    return unicodedata.normalize("NFC", parts)


def whole(text: str) -> str:
    """The rules applied to all of a text; canonical() comes to the same by segments."""
    composed = unicodedata.normalize("NFC", text.translate(tables()[0]))
    return unicodedata.normalize("NFC", WORD.sub(_one_script, composed))


@functools.lru_cache(maxsize=1 << 16)
def _segment(text: str) -> str:
    return whole(text)


def canonical(text: str) -> str:
    """The consistent form of a text: stable stretches are kept as they are, unstable ones are normalized with their boundary and spliced in.

    A segment is a run of unstable characters, the character before it if the run holds a mark that may join it, and the letters of
    the words it touches.
    """
    if text.isascii() and "\t" not in text and "\r" not in text:
        return text
    _, run, letters, joining = tables()
    parts, done = [], 0
    for found in run.finditer(text):
        start, end = found.span()
        if end <= done:
            continue
        start = max(start, done)
        if start > done and not joining.isdisjoint(found.group()):
            start -= 1
        while start > done and letters.fullmatch(text[start - 1]):
            start -= 1
        end = letters.match(text, end).end()
        parts += [text[done:start], _segment(text[start:end])]
        done = end
    if not done:
        return text
    return "".join(parts) + text[done:]


def canonical_text(c: Column | str, *, quick: str = r"^[\n\x20-\x7e\x{4E00}-\x{9FFF}\x{3001}\x{3002}\x{3041}-\x{3096}\x{30A1}-\x{30FA}]*\z") -> Column:
    """Column of consistent forms. Texts of characters that are never unstable stay in the JVM; null stays null."""
    c = F.col(c) if isinstance(c, str) else c

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else canonical(t))

    return F.when(c.rlike(quick), c).otherwise(run(F.when(~c.rlike(quick), c)))


def canonical_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``canonical_text``: one form for texts that look the same.

    Line ends are CR-free; kinds of blank, hyphen, width, invisible characters, compositions and letters with a twin in another script
    are unified; case, accents, superscripts, circled and squared forms stay. Null stays null, empty stays empty; a text may become
    empty. An existing column named ``canonical_text`` is replaced. Repeated rows are kept.
    """
    return docs.withColumn("canonical_text", canonical_text(quoted(text)))


def lookalike_classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document whose text is not empty and looks like another, unequal text: id, ``class_id``, ``variant_id``, ``n_variants``, ``n_documents``.

    class_id is the least id among all texts that look the same, variant_id the least id among those equal in characters, so that the
    variants of a class are its links and exact copies are never paired, however many there are. Rows carry digests of both forms; one
    aggregation makes variants, a second one classes. Null and empty texts and null ids are left out; a text may become empty and looks
    like others that do.
    """
    classed = canonical_documents(docs.select(quoted(row_id).alias("__id"), quoted(text).alias("__t")).where("__id is not null and __t <> ''"), "__t")
    # digests are made once and used twice
    classed = stage_table(classed.select("__id", F.md5(F.col("canonical_text").cast("binary")).alias("__c"), F.md5(F.col("__t").cast("binary")).alias("__x")), "looks")
    variants = classed.groupBy("__c", "__x").agg(F.min("__id").alias("__v"), F.count(F.lit(1)).alias("__n"))
    several = variants.groupBy("__c").agg(F.min("__v").alias("class_id"), F.count(F.lit(1)).alias("n_variants"), F.sum("__n").alias("n_documents")).where("n_variants > 1")
    live = variants.join(several.withColumnRenamed("__c", "__k"), F.col("__c") == F.col("__k")).select(F.col("__c").alias("__lc"), F.col("__x").alias("__lx"), "class_id", F.col("__v").alias("variant_id"), "n_variants", "n_documents")
    members = classed.join(live, (F.col("__c") == F.col("__lc")) & (F.col("__x") == F.col("__lx")))
    return members.select(F.col("__id").alias(row_id), "class_id", "variant_id", "n_variants", "n_documents")


def lookalike_pairs(classes: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """(``<id>_a``, ``<id>_b``), a < b: all pairs of documents of a class that are no copies of each other, for uses that ask for them one by one."""
    a = classes.select(F.col("class_id").alias("__ca"), F.col("variant_id").alias("__va"), quoted(row_id).alias(f"{row_id}_a"))
    b = classes.select(F.col("class_id").alias("__cb"), F.col("variant_id").alias("__vb"), quoted(row_id).alias(f"{row_id}_b"))
    met = a.join(b, (F.col("__ca") == F.col("__cb")) & (F.col("__va") != F.col("__vb")) & (F.col(f"{row_id}_a") < F.col(f"{row_id}_b")))
    return met.select(f"{row_id}_a", f"{row_id}_b")
