"""What a reader sees: characters that look the same, and characters without ink.

Compatibility forms come from the Unicode database by rule (width, style, ligatures, kinds of blank); only
look-alike letters of other scripts are stated as a table.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

# Look-alike letters, foreign letter(s) first, the Latin letter they look like second.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ԍ": "g", "ғ": "f",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Ԍ": "G", "Ү": "Y",
}
GREEK = {
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "ϲ": "c", "ϳ": "j", "υ": "u", "κ": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
OTHER = {"ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ʟ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ԝ": "w", "Օ": "O", "Տ": "S", "Լ": "L", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z"}
HYPHENS = "‐‑﹣－˗֊"
LINE_ENDS = {" ": "\n", " ": "\n", "\x85": "\n", "\v": "\n"}
SEEN_FORMS = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")

LATIN_OF = CYRILLIC | GREEK | OTHER
CYRILLIC_OF = {latin: c for c, latin in CYRILLIC.items() if c not in "ӏѵԍғӀѴԌҮ"}
#: Cyrillic letters without a Latin twin: a word with one of them is Cyrillic.
ONLY_CYRILLIC = frozenset(chr(c) for c in range(0x0400, 0x0530)) - CYRILLIC.keys()

BLANKS = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Zs")
#: No ink: format characters, variation selectors, fillers, the grapheme joiner.
IGNORABLE = (frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") | {"͏", "ᅟ", "ᅠ", "ㅤ", "ﾠ", "឴", "឵"} | {chr(c) for c in (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))}) - {chr(c) for c in (*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2)}


@cache
def _form(ch: str) -> str:
    """One character without width, style or ligature, decomposed; blanks, hyphens and line ends in one kind."""
    if ch in IGNORABLE:
        return ""
    if ch in BLANKS or ch == "\t":
        return " "
    if ch in HYPHENS:
        return "-"
    if ch in LINE_ENDS:
        return LINE_ENDS[ch]
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0].startswith("<"):
        if parts[0] not in SEEN_FORMS or (parts[1] == "0020" and len(parts) > 2):
            return ch
        parts = parts[1:]
    if parts:
        return "".join(_form(chr(int(p, 16))) for p in parts)
    return unicodedata.normalize("NFD", ch)


class _Forms(dict):
    """A table for ``str.translate`` that fills itself."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _form(chr(code))
        return out


_FORMS = _Forms()
_RETURNS = re.compile("\r\n?")


def plain_form(text: str) -> str:
    """``text`` without differences of width, style, composition, blank, hyphen or ink; scripts stay."""
    if "\r" in text:
        text = _RETURNS.sub("\n", text)
    if text.isascii() and "\t" not in text and "\v" not in text:
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(_FORMS)))


_TO_LATIN = str.maketrans(LATIN_OF)
_TO_CYRILLIC = str.maketrans(CYRILLIC_OF)


def table_spelling(token: str) -> str:
    """One spelling for all tokens that look like ``token``: Cyrillic if a letter has no Latin twin, else Latin."""
    latin = unicodedata.normalize("NFD", token).translate(_TO_LATIN)
    if not latin.isascii() and not ONLY_CYRILLIC.isdisjoint(latin):
        latin = latin.translate(_TO_CYRILLIC)
    return unicodedata.normalize("NFC", latin)


def twins(ch: str) -> tuple[str, ...]:
    """The characters that look like ``ch``, itself included."""
    latin = LATIN_OF.get(ch, ch)
    return (latin, *_SAME.get(latin, ()))


_SAME: dict[str, tuple[str, ...]] = {}
for _foreign, _latin in LATIN_OF.items():
    _SAME[_latin] = (*_SAME.get(_latin, ()), _foreign)
