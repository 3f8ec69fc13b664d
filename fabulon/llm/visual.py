"""Visually identical text with different characters (problem 4).

A transducer compiled once from Unicode data rewrites a text in one pass.  It reads words that hold at least one
character outside plain text, cuts them into grapheme clusters and replaces their parts by the longest entries of a trie
for widths, accents (letters with any of their marks, in any order, and the syllables of Hangul), spaces, joined letters,
numerals, invisible characters and look-alikes.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from .arrowio import flat_map, table
from .encoding import ChainModel, chapter_model, repair

# Letters that look alike across scripts, each with its Latin twin.
LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТУХԌԚԜҮаеѕіјорсухԁһԛԝӏүΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρυκ":
    "ABESIJKMHOPCTYXGQWYaesijopcyxdhqwlyABEZHIKMNOPTYXovlapuk",
    # Armenian, Cherokee and phonetic letters
    "օոսհզյՕՍՏ": "onuhqjOUS", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ": "ABCDEGHJKLMPRSTVWZ", "ɡɑ": "ga",
}
# Accented letters of other scripts that look like accented Latin ones.
LOOK_ALIKE_ACCENTS = {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ά": "á", "ό": "ó", "ί": "í", "ύ": "ú", "ѐ": "è", "Ѐ": "È", "Ά": "Á", "Έ": "É", "Ό": "Ó", "ӓ": "ä", "Ӓ": "Ä", "ӧ": "ö", "Ӧ": "Ö"}

_LETTER = re.compile(r"[^\W\d_]")


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L" if ch.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if ch.isalpha() else ""
    if 0x400 <= o < 0x530:
        return "C" if ch.isalpha() else ""
    if 0x530 <= o < 0x590 or 0x13A0 <= o < 0x1400 or ch in "ɡɑ":
        return "A" if o < 0x590 and o >= 0x530 else "K" if o >= 0x13A0 else "I"
    return "O" if ch.isalpha() else ""


def _compile() -> tuple[dict[str, str], dict[str, str], dict]:
    """(mapping valid anywhere, look-alikes valid inside words of mixed script, trie of the mapping and of all sequences
    that one character stands for); raises on conflicts."""
    plain: dict[str, str] = {}

    def put(src: str, dst: str) -> None:
        if src != dst and plain.setdefault(src, dst) != dst:
            raise ValueError(f"conflict for {src!r}: {plain[src]!r} and {dst!r}")

    for o in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000:
            continue
        ch = chr(o)
        cat, dec = ud.category(ch), ud.decomposition(ch)
        kind = dec.partition(">")[0][1:] if dec.startswith("<") else ""
        if cat == "Zs":
            put(ch, " ")
        elif cat in ("Zl", "Zp") or o == 0x85:
            put(ch, "\n")
        elif cat == "Cf" and not 0x600 <= o < 0x8E3 and not 0xE0020 <= o < 0xE0080:
            put(ch, "")
        elif o in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= o < 0xFE10:
            put(ch, "")
        elif kind in ("wide", "narrow"):
            put(ch, ud.normalize("NFKC", ch))
        elif kind == "compat" and (0x2160 <= o < 0x2180 or 0xFB00 <= o < 0xFB07 or o in (0x132, 0x133) or 0x1C4 <= o < 0x1F4):
            put(ch, ud.normalize("NFKC", ch))
        elif kind == "circle" and cat == "No" or 0x2474 <= o < 0x249C:
            put(ch, ud.normalize("NFKC", ch))
        elif kind == "font" and cat in ("Lu", "Ll", "Nd"):
            put(ch, ud.normalize("NFKC", ch))
        elif dec and not kind and ud.normalize("NFC", ch) != ch:
            put(ch, ud.normalize("NFC", ch))
    put("\t", " ")
    put("\r\n", "\n")
    put("\r", "\n")
    put("\v", "\n")
    put("\f", "\n")
    twins: dict[str, str] = {}
    for src, dst in LOOK_ALIKES.items():
        if len(src) != len(dst):
            raise ValueError("look-alike lists differ in length")
        twins |= dict(zip(src, dst))
    twins |= LOOK_ALIKE_ACCENTS
    for src, dst in [*plain.items(), *twins.items()]:
        if any(ch in plain or (src in twins and ch in twins) for ch in dst):
            raise ValueError(f"{src!r} maps to {dst!r}, which is mapped again")
    trie: dict = {}

    def grow(src: str, dst: str) -> None:
        node = trie
        for ch in src:
            node = node.setdefault(ch, {})
        if node.setdefault("", dst) != dst:
            raise ValueError(f"conflict for {src!r}: {node['']!r} and {dst!r}")

    for src, dst in plain.items():
        grow(src, dst)
    for o in (*range(0xC0, 0xD800), *range(0xF900, sys.maxunicode + 1)):
        ch = chr(o)
        if 0xAC00 <= o < 0xD7A4 or (ud.decomposition(ch) and not ud.decomposition(ch).startswith("<")):
            if ud.normalize("NFC", ch) == ch:
                whole = ud.normalize("NFD", ch)
                # spelled out, and as a composed beginning with its last part
                for src in {whole, ud.normalize("NFC", whole[:-1]) + whole[-1]}:
                    grow(src, ch)
    return plain, twins, trie


_PLAIN, _TWINS, _TRIE = _compile()
_BACK = {v: k for k, v in reversed(_TWINS.items()) if _script(k) == "C"}


def _char_class(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"{re.escape(chr(chars[i]))}-{re.escape(chr(chars[j]))}" if j > i else re.escape(chr(chars[i])))
        i = j + 1
    return "".join(out)


_MARKS = _char_class([o for o in range(0x300, 0x10000) if not 0xD800 <= o < 0xE000 and ud.category(chr(o))[0] == "M"])
_HIDDEN = _char_class(sorted(ord(c) for c, d in _PLAIN.items() if d == "" and len(c) == 1))
_KEYS = _char_class(sorted({ord(c) for c in _PLAIN if len(c) == 1 and _PLAIN[c] != ""}))
_JOINABLE = "Ͱ-֏Ꭰ-Ᏽἀ-῿ɡɑ"
#: A word: letters, digits, marks and invisible characters.  Only words with something to look at are taken apart.
_WORD = re.compile(rf"[^\W_](?:[\w{_MARKS}{_HIDDEN}])*|[{_HIDDEN}]+(?:[\w{_MARKS}{_HIDDEN}])*|\r\n|[{_KEYS}]")
_ODD_ASCII = re.compile(r"[\r\t\v\f]")
_ODD = re.compile(rf"[{_MARKS}{_HIDDEN}{_KEYS}{_JOINABLE}\r\t\v\f]")
_CLUSTER = regex.compile(r"\X")
_ROMAN = re.compile(r"[IVXLCDM]+\Z")
_MARK_RUN = re.compile(f"[{_MARKS}]{{2,}}")
_INVISIBLE = re.compile(f"[{_HIDDEN}]")
_INDIC = re.compile(r"[ऀ-෿؀-ۿ]")


@lru_cache(maxsize=None)
def _spelled(ch: str) -> str:
    """The plain form of a character, as a letter and its marks."""
    return "".join(_spelled(part) if part != ch else part for part in (_PLAIN.get(ch) or _parts(ch)))


def _parts(ch: str) -> str:
    o = ord(ch) - 0xAC00
    if 0 <= o < 11172:  # a syllable of Hangul
        return chr(0x1100 + o // 588) + chr(0x1161 + o % 588 // 28) + (chr(0x11A7 + o % 28) if o % 28 else "")
    spelling = ud.decomposition(ch)
    return "".join(chr(int(x, 16)) for x in spelling.split()) if spelling and spelling[0] != "<" else ch


def _longest(chars: str, i: int) -> tuple[str, int]:
    """What the longest entry that begins at ``i`` stands for, and where it ends; a character without entry is itself."""
    node, hit, end = _TRIE.get(chars[i]), chars[i], i + 1
    k = i + 1
    while node is not None:
        if "" in node:
            hit, end = node[""], k
        if k >= len(chars):
            break
        node = node.get(chars[k])
        k += 1
    return hit, end


def _rewrite_cluster(cluster: str) -> str:
    """One pass over the cluster: its marks in order of their class, longest entries first; then marks that still combine
    with the letter before them past others of another class."""
    hit, end = _longest(cluster, 0)
    if end == len(cluster):
        return hit
    # spelled out, with the marks behind each letter in order of their class
    cluster = "".join(map(_spelled, cluster))
    cluster = _MARK_RUN.sub(lambda m: "".join(sorted(m.group(), key=ud.combining)), cluster)
    out, i = [], 0
    while i < len(cluster):
        hit, i = _longest(cluster, i)
        out.append(hit)
    if len(out) < 2:
        return out[0]
    # what the first pass has made may go together again
    text, kept, last = out[0], [], 0
    for part in out[1:]:
        for ch in part:
            kind = ud.combining(ch)
            pair = _TRIE.get(text[-1:], {}).get(ch, {}).get("") if text and (last < kind or not kept) else None
            if pair is not None:
                text = text[:-1] + pair
            elif kind:
                kept.append(ch)
                last = kind
            else:
                text, kept, last = text + "".join(kept) + ch, [], 0
    return text + "".join(kept)


def _rewrite_word(word: str) -> str:
    if word.isascii() and word.isalnum():
        return word
    keep_joiners = bool(_INDIC.search(word))
    out = []
    for cluster in _CLUSTER.findall(word):
        if keep_joiners and ("\u200c" in cluster or "\u200d" in cluster):
            out += [part if part in "\u200c\u200d" else _rewrite_cluster(part) for part in re.split("([\u200c\u200d])", cluster) if part]
        else:
            visible = _INVISIBLE.sub("", cluster)
            if visible:
                out.append(_rewrite_cluster(visible))
    text = "".join(out)
    scripts = {s for ch in text if (s := _script(ch))}
    if scripts <= {"L"} or "O" in scripts:
        return text
    letters = [ch for ch in text if _script(ch)]
    latin = all(_script(ch) == "L" or ch in _TWINS for ch in letters)
    if len(scripts) > 1:
        if latin:
            return "".join(_TWINS.get(ch, ch) for ch in text)
        if "L" in scripts and all(_script(ch) == "C" or ch in _BACK for ch in letters):
            return "".join(_BACK.get(ch, ch) for ch in text)
        return text
    if latin and all(ch.isupper() for ch in letters) and _ROMAN.match(mapped := "".join(_TWINS[ch] for ch in letters)):
        # a numeral written wholly in look-alikes
        return "".join(_TWINS.get(ch, ch) for ch in text) if len(mapped) > 1 or len(text) == 1 else text
    return text


def normalize(text: str | None) -> str | None:
    """The one consistent form of ``text``; null stays null."""
    if not text or (_ODD_ASCII if text.isascii() else _ODD).search(text) is None:
        return text

    def rewrite(m: re.Match) -> str:
        # a joiner between two pictures makes one of them
        if m.group() == "\u200d" and ud.category(text[m.end() : m.end() + 1] or " ") == "So":
            return m.group()
        return _rewrite_word(m.group())

    return _WORD.sub(rewrite, text)


def normalize_fields(
    df: DataFrame, key: str, fields: list[str], model: ChainModel | None = None, may_be_garbled: tuple[str, ...] = ("text", "title")
) -> DataFrame:
    """One row (key, field, affected, garbled, normal) per non-null field.

    ``normal`` is the consistent form, ``affected`` whether it differs and the value holds a letter; values
    garbled by a wrong encoding (judged by ``model`` in the fields ``may_be_garbled``) are normalised too but never count
    as affected.
    Nulls give no row, empty texts come out empty; other columns are ignored.  One narrow stage without a shuffle.
    """
    key_type = df.schema[key].dataType.simpleString()
    picked = df.select(df[key].alias("k"), *[df[f].alias(f"f{i}") for i, f in enumerate(fields)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(k, *values):
        out = []
        for field, value in zip(fields, values):
            if value is not None:
                normal = normalize(value)
                differs = normal != value and _LETTER.search(value) is not None
                judged = differs and field in may_be_garbled and shared.value is not None
                bad = judged and repair(value, shared.value) is not None
                out.append((k, field, differs and not bad, bad, normal))
        return out

    return flat_map(picked, rows, f"{key} {key_type}, field string, affected boolean, garbled boolean, normal string")


def p4_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = chapter_model(spark, sf_dir)
    return normalize_fields(table(spark, sf_dir, "chapters"), "chapter_id", ["text", "heading"], model)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_normalized(spark, sf_dir).where("affected").select("chapter_id", "field")
