"""Words of a text whatever its letter case, markup, escapes or character forms."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝвкмнтгёАВЕКМНОРСТУХІЈЅαεικνορτυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijshdqwbkmhtreABEKMHOPCTYXIJSaeiknoptuxyABEZHIKMNOPTYX",
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]{0,14})(?:\s[^<>]{0,200})?/?>")
_BLOCK = frozenset("br p div li ul ol td tr th table h1 h2 h3 h4 h5 h6 pre hr blockquote".split())
_HEX = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\U([0-9a-fA-F]{8})")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\[nrtvf]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[a-z0-9]+")
_CHAR = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E, 0x200E, 0x200F)}


def _char(m: re.Match) -> str:
    code = int(m[1] or m[2] or m[3], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else " "


def _percent(m: re.Match) -> str:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def _tag(m: re.Match) -> str:
    return " " if m[2].lower() in _BLOCK else ""


def plain(text: str) -> str:
    """Lower-case text without markup, escapes, invisible characters and odd letter forms."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", _HEX.sub(_char, text))
    if "%" in text:
        text = _PERCENT.sub(_percent, text)
    if "<" in text:
        text = _TAG.sub(_tag, text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_CHAR)
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOKALIKES)
    if "-\n" in text or "-\r" in text or "- " in text:
        text = _BROKEN.sub("", text)
    for mark in "*_~`":
        if mark in text:
            text = text.replace(mark, "")
    return text.lower()


def words(text: str | None) -> list[str]:
    """The words (runs of letters and digits) of ``plain(text)``; none for NULL."""
    return _WORD.findall(plain(text)) if text else []
