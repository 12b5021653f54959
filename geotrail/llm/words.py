"""Texts as sequences of words that spelling, layout and markup do not change."""

from __future__ import annotations

import html
import re
import unicodedata

#: Tags within a line; they may stand inside a word. Any other tag ends a line.
INLINE_TAGS = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split())

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:[^<>]*)>|<!--.*?-->", re.S)
#: A hyphen between letters at a line's end, with the marks of quoting that may begin the next line.
_DIVIDED = re.compile(r"[-\u00ad\u2010\u2011\u00ac](?<=[^\W\d_].)[ \t\u00a0]*(?:\r\n|\n|\r|\u2028|\u0085)[ \t\u00a0>|*#]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
#: Marks of emphasis and code may stand inside a word as well.
_EMPHASIS = re.compile(r"(?<=\w)(?:\*{1,3}|`|~~|__)(?=\w)")


class _Marks(dict):
    """Which characters stay: accents and invisible ones go."""

    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code))
        self[code] = found = None if kind[0] == "M" or kind == "Cf" else code
        return found


_KEPT = _Marks()


def _tag(match: re.Match) -> str:
    return "" if match[2] and match[2].lower() in INLINE_TAGS else "\n"


def _accentless(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).casefold()
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", text).translate(_KEPT)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, with case, accents, character width, punctuation, spacing, line breaks, invisible
    characters, quoting and markup made equal; a word divided at a line's end is one word."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(_tag, text)
    if "&" in text:
        unescaped = html.unescape(text)
        text = _TAG.sub(_tag, unescaped) if "<" in unescaped and unescaped != text else unescaped
    text = _DIVIDED.sub("", text)
    if "*" in text or "`" in text or "~~" in text or "__" in text:
        text = _EMPHASIS.sub("", text)
    return _WORD.findall(_accentless(text))
