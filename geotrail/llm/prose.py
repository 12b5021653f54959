"""Running prose in texts: lines of machine output, markup and quotations are set apart, the rest is cut into sentences."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np

from geotrail.llm.words import _DIVIDED, _TAG, _tag

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset("dr mr mrs ms prof st sr sra vs no nr approx min max ca etc fig e.g i.e a.m p.m z.b d.h u.a usw bzw p.ej ej ee.uu".split())

_BULLET = re.compile(r"^\s*(?:[-*•‣·–—+]|\d{1,3}[.)])\s+")
_QUOTED = re.compile(r"^\s*(?:>|\|)")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿々〆]")
#: Signs of program output in a token: braces, operators, escapes, keyed values, bracketed numbers, hashes.
_CODE = re.compile(r'[{}=\\|<>^]|":|&&|\(\)|://')
_HEX = re.compile(r"(?=[a-fA-F]*\d)[0-9a-fA-F]{12,}")
_ROW = re.compile(r"(.)\1{5,}")
_RUNS = re.compile(r"[!-~]+|[^!-~]+")
_UNBROKEN = 40
#: What lets a line, or a text, hold such signs: every sign above, and every long run below, has a match here.
_SUSPECT = re.compile(r'[{}=\\|<>^\[]|":|&&|\(\)|://|[0-9a-fA-F]{12}')
_LONG = re.compile(r"(\S)\1{5}|[\x00-\x08\x0e-\x1b!-\x7f]{40}")
_OTHER = re.compile(r"[^\w\s]|[\d_]")
_SIGNS = bytes(c for c in range(256) if _OTHER.match(chr(c)))
_BREAKS = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_STOPS, _CLOSING = tuple(".!?…:。！？"), "\"'”’»)」』"
#: The end of a sentence, and the first letter after it.
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s+(\S?)|$)")
_START = re.compile(r"[.!?]\s+([^\W\d_])")
_CJK_END = re.compile(r"[。！？!?]+[」』）]*")


@dataclass
class Sentence:
    """Words of one sentence (of a text in Japanese, its letters) and its length in them."""

    words: list[str]
    cjk: bool
    letters: str = ""


def _prose_of(token: str) -> str:
    """A token, or what is left of it without the pieces that look like the output of a program; linear in its length."""
    out = []
    for run in [token] if token.isascii() else _RUNS.findall(token):
        if run.isascii():
            if len(run) >= _UNBROKEN or _CODE.search(run) or _HEX.search(run) or (run[0] == "[" and "]" in run and any(map(str.isdigit, run))):
                continue
        out.append(_ROW.sub(" ", run))
    return "".join(out)


def _plain(line: str) -> int:
    """Number of letters and spaces."""
    try:
        return len(line.encode("latin-1").translate(None, _SIGNS))
    except UnicodeEncodeError:
        return len(_OTHER.sub("", line))


def _long_runs(text: str) -> bool:
    """Whether a text holds six equal signs in a row or an unbroken ASCII run; what ``_LONG`` says, over whole arrays."""
    if len(text) < 6:
        return False
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = u[1:] == u[:-1]
    pairs = same[1:] & same[:-1]
    blank = (u <= 32) & ((u > 27) | ((u > 8) & (u < 14)))
    if (pairs[:-3] & pairs[2:-1] & same[4:] & ~blank[5:]).any():
        return True
    cuts = np.flatnonzero((u > 127) | blank)
    if not len(cuts):
        return len(u) >= _UNBROKEN
    return bool(cuts[0] >= _UNBROKEN or len(u) - 1 - cuts[-1] >= _UNBROKEN or (cuts[1:] - cuts[:-1]).max(initial=0) > _UNBROKEN)


def _odd(text: str) -> bool:
    """Whether a text may hold pieces of program output; never false where ``_prose_of`` would take any out."""
    return _SUSPECT.search(text) is not None or _long_runs(text)


def without_machine(line: str, odd: bool = True) -> str:
    """A line without the pieces that look like the output of a program; empty if little else is left.

    ``odd`` says that the text around may hold any.
    """
    odd = odd and (_SUSPECT.search(line) or _LONG.search(line))
    kept = " ".join(filter(None, map(_prose_of, line.split()))) if odd else line
    if _plain(kept) < 0.6 * (len(line) if len(kept) < 0.5 * len(line) else len(kept)):
        return ""
    return kept.strip()


def plain_words(low: str) -> list[str]:
    """The words of a text in lower case."""
    if low.isascii() and "'" not in low:
        return low.translate(_BREAKS).split()
    return _WORD.findall(low)


def _stops(line: str) -> bool:
    """Whether a line ends like a sentence."""
    return line.rstrip().rstrip(_CLOSING).endswith(_STOPS)


def _joined(lines: list[str]) -> list[str]:
    """Lines of one paragraph with those joined that were only broken to fit a width."""
    if len(lines) < 2:
        return lines
    width = max(map(len, lines))
    open_ = sum(not _stops(a) for a in lines[:-1])
    if not open_:
        return lines
    if _CJK.search(lines[0]):
        # Without spaces every line but the last is filled to the width.
        if all(len(a) >= width - 2 for a in lines[:-1]) and len({len(a) for a in lines[:-1]}) <= 3 and len(lines) > 2:
            return ["".join(lines)]
        return lines
    first = lambda s: len(s.split(None, 1)[0]) if s.split() else 0
    full = sum(len(a) + 1 + first(b) > width for a, b in zip(lines, lines[1:]))
    wrapped = full >= 0.9 * (len(lines) - 1) and 35 <= width <= 130
    out = [lines[0]]
    for line in lines[1:]:
        starts_low = line[:1].islower() and not out[-1].isupper()
        ends = _stops(out[-1])
        if wrapped or (starts_low and not ends and any(c.isupper() for c in out[-1])):
            out[-1] = f"{out[-1].rstrip()} {line.lstrip()}"
        else:
            out.append(line)
    return out


def _split(text: str) -> list[str]:
    out, at, cased = [], 0, None
    for m in _END.finditer(text):
        rest = m[1]
        if rest and text[m.start()] == ".":
            before = text[max(at, m.start() - 24) : m.start()].split()
            low = before[-1].lower().lstrip("(\"'“‘«") if before else ""
            if low in ABBREVIATIONS or (len(low) == 1 and low.isalpha()):
                continue
            if rest.islower():
                if cased is None:
                    starts = "".join(_START.findall(text))
                    cased = sum(map(str.isupper, starts)) >= 0.5 * len(starts)
                if cased:
                    continue
        out.append(text[at : m.end()])
        at = m.end()
    if text[at:].strip():
        out.append(text[at:])
    return out


def sentences(text: str | None) -> list[Sentence]:
    """The sentences of the running prose of a text, in order."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(_tag, text)
    text = _DIVIDED.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    odd = _odd(text)
    found: list[Sentence] = []
    paragraph: list[str] = []

    def flush():
        for block in _joined(paragraph):
            if not block.isascii() and len(_CJK.findall(block)) * 3 > len(block.replace(" ", "")):
                for s in _CJK_END.split(block.replace(" ", "")):
                    letters = "".join(c for c in s if c.isalnum())
                    if letters:
                        found.append(Sentence([], True, letters))
            else:
                for s in _split(block):
                    w = plain_words(s.casefold())
                    if w:
                        found.append(Sentence(w, False))
        paragraph.clear()

    for raw in text.split("\n"):
        line = raw.strip()
        if line and not _QUOTED.match(line):
            line = without_machine(line, odd)
        else:
            line = ""
        if not line:
            flush()
            continue
        if m := _BULLET.match(line):
            flush()
            line = line[m.end() :]
        paragraph.append(line)
    flush()
    return found
