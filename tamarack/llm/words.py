"""Words of texts however they are set: markup, invisible characters, hyphens, case and accents aside."""

from __future__ import annotations

import html
import re
import unicodedata

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_ESCAPE = re.compile(r"\\[nrt]|\\u[0-9a-fA-F]{4}")
_HYPHEN = re.compile(r"(?<=[^\W_])[-‐‑‒–](?:\n[ \t]*)?(?=[^\W_])")
_MOJIBAKE = re.compile("[ÂÃâÐÑ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,2}")
_WORD = re.compile(r"[一-鿿]|(?:(?![一-鿿])[^\W_])+")


def _decode(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m[0]


def plain(text: str) -> str:
    """A text without tags, entities and invisible characters, in one case and without accents; doubly encoded letters are mended."""
    if "Ã" in text or "â" in text or "Â" in text:
        text = _MOJIBAKE.sub(_decode, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _HYPHEN.sub("", text).casefold()


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))
