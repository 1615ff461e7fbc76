"""The spoken words of a subtitle file.

Cue numbers, times and headers, mark-up, sound descriptions, speaker labels and adverts go;
lines that a caption repeats from the one before it (roll-up) count once; text that was decoded
with the wrong table is read again. What recognition did to single letters isn't undone here:
`skeleton` gives what such damage leaves of a word, and `spelled` a pattern of what it can become.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

#: A spoken word: as it stands, its skeleton, and what of that goes on in a stream of words.
Word = tuple[str, str, str]

#: Lone or wrapped signs a lost character leaves.
LOST = "�"

# -- text decoded with the wrong table --

#: What bytes 0x80..0xBF look like in the two usual single-byte tables.
_TAIL = {c: b for b in range(0x80, 0xC0) for c in {bytes([b]).decode("cp1252", "ignore") or chr(b), chr(b)}}
_BYTE = _TAIL | {bytes([b]).decode("cp1252"): b for b in range(0xC0, 0x100)}
_RUN = re.compile(r"[Â-ô](?:[\u0080-¿]|[{}])+".format("".join(re.escape(c) for c in _TAIL if ord(c) > 0xBF)))
_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
#: Western letters read through the Cyrillic table; the two that also stand in for Latin look-alikes excepted.
_CYRILLIC = {ord(bytes([b]).decode("cp1251")): bytes([b]).decode("cp1252") for b in range(0xA0, 0x100) if bytes([b]).decode("cp1251") not in "".join(map(chr, range(0xA0, 0x100)))}
_FOREIGN = re.compile(r"[Ё-ЏБ-НП-Яб-нп-џ]")
_ALIKE = {"\u0430": "a", "\u043e": "o", "\u0410": "A", "\u041e": "O"}


def _decoded(m: re.Match) -> str:
    run = m.group()
    try:
        return bytes(_BYTE[c] for c in run).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        pass
    out = []
    i = 0
    while i < len(run):  # piece by piece, where the run holds other signs as well
        for n in (4, 3, 2):
            try:
                out.append(bytes(_BYTE[c] for c in run[i : i + n]).decode("utf-8") if len(run) >= i + n else "")
                if out[-1]:
                    i += n
                    break
                out.pop()
            except (KeyError, UnicodeDecodeError):
                continue
        else:
            out.append(run[i])
            i += 1
    return "".join(out)


def repaired(text: str) -> str:
    """Text that was decoded with a wrong table, read again; other text unchanged."""
    if text.isascii():
        return text
    for _ in range(3):
        if not _RUN.search(text):
            break
        again = _RUNS.sub(_decoded, text)
        if again == text:
            break
        text = again
    if _FOREIGN.search(text):
        text = text.translate(_CYRILLIC)
    else:
        for look, letter in _ALIKE.items():
            text = text.replace(look, letter)
    return unicodedata.normalize("NFC", text).replace("﻿", "").replace("­", "").replace(" ", " ").replace(" ", " ")


# -- letters that recognition mistakes for each other --

#: A letter, and what it can turn into.
MISREAD = {"a": ("à",), "d": ("cl",), "e": ("c",), "h": ("li",), "i": ("1",), "l": ("i", "1"), "m": ("rn",), "o": ("0",), "s": ("5",), "t": ("f",), "u": ("ii",), "w": ("vv",)}
_KEEP = re.compile(r"[^bgjkpqrstvxyzfmnw5]")


def folded(word: str) -> str:
    """A word without regard to case; the sharp s is ss, as capitals have it."""
    return word.casefold()


def skeleton(word: str) -> str:
    """What no known damage changes in a folded word: its steady consonants, misread pairs taken together. May be empty.

    ss goes, since it can stand for a sharp s, which damage treats as it does any letter beyond ASCII.
    """
    return _KEEP.sub("", word.replace("5", "s").replace("ss", "")).replace("f", "t").replace("m", "rn").replace("w", "vv")


def piece(bones: str) -> str:
    """What of a skeleton stays the same when a word falls apart in two or runs into the next: all but s, whose pairs depend on the word's ends. May be empty."""
    return bones.replace("s", "")


def spelled(word: str) -> str:
    """A pattern of all that damage can make of a folded word."""
    parts = []
    for ch in re.findall("ss|.", word, re.S):
        if ch == "ss":
            one = "(?:" + "|".join(re.escape(w) for w in sorted({"s", LOST, *MISREAD["s"]})) + ")"
            parts.append(rf"(?:{one}{one}|[^\x00-\x7f]{{1,4}})")
            continue
        ways = {ch, LOST, *MISREAD.get(ch, ())}
        if not ch.isascii():
            base = unicodedata.normalize("NFD", ch)[0]
            ways |= {base, *MISREAD.get(base, ())}
        parts.append("(?:" + "|".join(re.escape(w) for w in sorted(ways)) + (r"|[^\x00-\x7f]{1,4})" if not ch.isascii() or ch in "aeioun" else ")"))
    return f"{LOST}*" + "".join(parts) + f"{LOST}*"


def _loose(text: str) -> str:
    return "".join("(?:" + "|".join(re.escape(w) for w in (c, LOST, *MISREAD.get(c, ()))) + ")" if c.isalpha() else re.escape(c) for c in text)


#: Words that common adverts are told by; others are learned from the corpus. A line is an advert if it has a site, or all words of one of the sets.
_ADVERT_WORDS = ("captions", "subtitles", "subtitle", "synced", "sync", "corrected", "by", "presents", "release", "downloaded", "from", "advertise", "product", "support", "vip", "rate", "get", "more")
_ADVERTS = ("captions by", "subtitles synced", "subtitles by", "synced by", "sync corrected", "corrected by", "presents release", "downloaded from", "advertise product", "support vip", "rate subtitle", "get more captions")
_SITE = re.compile(rf"(?:www\.|{_loose('www.')}|https?:|{_loose('.example')}\b|\.(?:com|org|net|tv|info)\b)")
_BIT = {w: 1 << i for i, w in enumerate(_ADVERT_WORDS)}
_IS_SITE = 1 << len(_ADVERT_WORDS)
_SETS = [sum(_BIT[w] for w in s.split()) for s in _ADVERTS]
_ADVERT_FORM = [(re.compile(_loose(w)), b) for w, b in _BIT.items()]

# -- structure --

_MARKUP = re.compile(r"<[^<>\n]*>|\{\\[^{}\n]*\}")
_SOUND = re.compile(r"\[[^\[\]\x1e]*\]|\([^()\x1e]*\)|\*[^*\n\x1e]+\*|#[^#\n\x1e]+#|♪[^♪\x1e]*♪|[♪♫]")
#: A line between two music signs that were lost; between question marks it can be French speech after a lost dash.
_SUNG = re.compile(r"^[ \t]*([-–—]?)[ \t]*([?�]) [^\n\x1e]* \2[ \t]*$", re.M)
_DASHED = re.compile(r"^[ \t]*\? ", re.M)
_SPACED, _ASKED = re.compile(r"\w [!:;][ \t]*$", re.M), re.compile(r"\w \?[ \t]*$", re.M)
_SPEAKER = re.compile(r"(?:^|(?<=[-–—>�] ))[ \t]*(?:[-–—>�]+[ \t]*)*([^\W_][\w.'’�-]*(?: [\w.'’�-]+){0,3}):(?=\s)", re.M)
_EDGE = re.compile(r"^[^\w�]+|[^\w�]+$")
_LETTER = re.compile(r"[^\W_]")


def _unsung(text: str) -> str:
    """Text without lines between two lost music signs.

    In a file that opens other lines with `? ` alone, as a lost dash, and elsewhere has spaces
    before its closing marks, as French has, a line from `? ` to ` ?` is a question and stays.
    """
    lines = [m for m in _SUNG.finditer(text) if m[2] == "?" and not m[1]]
    asked = False
    if lines:
        cues = _SUNG.sub("", text).split("\x1e")
        # A cue that opens with the sign and ends with it later can be a song over lines.
        asked = any(map(_DASHED.search, cues)) and any(_SPACED.search(c) or (_ASKED.search(c) and not _DASHED.search(c)) for c in cues)
    return _SUNG.sub(lambda m: m.group() if asked and m[2] == "?" and not m[1] else " ", text)


def _label(m: re.Match) -> str:
    name = m.group(1)
    letters = [c for c in name if c.isalpha()]
    return " " if letters and sum(c.isupper() for c in letters) >= 0.6 * len(letters) else m.group()


class _Words(dict):
    """Of each token as it stands in a line: (word, skeleton, its piece), or None where it is no word. Tokens that adverts may hold go to `hints` with their bits."""

    LIMIT = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.hints: dict[str, int] = {}

    def __missing__(self, raw: str) -> Word | None:
        low = folded(raw)
        bits = _IS_SITE if _SITE.search(low) else 0
        word = _EDGE.sub("", low).replace("'", "").replace("\u2019", "")
        if not bits and word:
            for form, bit in _ADVERT_FORM:
                if form.fullmatch(word):
                    bits |= bit
        if len(self) >= self.LIMIT:
            self.clear()
            self.hints.clear()
        if bits:
            self.hints[raw] = bits
        bones = skeleton(word)
        got = self[raw] = (word, bones, piece(bones)) if _LETTER.search(word) else None
        return got


_WORDS = _Words()


def _is_advert(bits: int) -> bool:
    return bits & _IS_SITE != 0 or any(bits & s == s for s in _SETS)


#: What tells openers of adverts from those of speech: cues of a file that count as its edges, cues that a file must have to be asked, and how often, in how many groups of files and with which share at the edges an opener occurs.
EDGE_CUES, ASKED_CUES = 2, 12
OFTEN, GROUPS, EDGE_SHARE = 50, 10, 0.6


def opener(words: list[Word]) -> str | None:
    """The skeletons of the first two words of a line; None where they tell too little."""
    if len(words) < 2:
        return None
    two = f"{words[0][1]} {words[1][1]}"
    return two if len(two) > 3 else None


class _Openers(dict):
    """The opener of two tokens."""

    LIMIT = 400_000

    def __missing__(self, two: tuple[str, str]) -> str | None:
        words = [w for w in map(_WORDS.__getitem__, two) if w]
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[two] = opener(words) if len(words) == 2 else None
        return got


_OPENERS = _Openers()
#: Two tokens that begin a line, the first with a letter, after other signs and mark-up.
_OPENING = re.compile(r"^(?:[^\w\n<{]|<[^<>\n]*>|\{[^{}\n]*\})*([^\W\d_]\S*)[ \t]+(\S+)", re.M)


def openers_of(text: str | None) -> list[tuple[str, bool]]:
    """(opener, whether at an edge of the file) of each line of a file with enough cues, as the text stands: wrong tables hardly touch two words."""
    if not text or text.count("-->") < ASKED_CUES:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    head, tail = 0, len(text)
    for _ in range(EDGE_CUES + 1):  # the times of the first cue that is no edge, and of the last
        head = text.find("-->", head) + 3
    for _ in range(EDGE_CUES):
        tail = text.rfind("-->", 0, tail)
    get = _OPENERS.__getitem__
    return [(o, m.start() < head or m.start() > tail) for m in _OPENING.finditer(text) if (o := get(m.groups())) is not None]


def _plain(text: str) -> str:
    text = repaired(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return unescape(text) if "&" in text else text


def _cues(text: str) -> list[str]:
    """The text of each cue, without its number and times."""
    parts = text.split("-->")
    out = []
    for i, part in enumerate(parts):
        if i:
            cut = part.find("\n")
            part = part[cut + 1 :] if cut >= 0 else ""
        elif len(parts) > 1:
            continue
        if i < len(parts) - 1:
            part = part[: max(part.rfind("\n"), 0)].rstrip()
            cut = part.rfind("\n")
            if part[cut + 1 :].strip().isdigit():
                part = part[: max(cut, 0)]
        out.append(part)
    return out


def _same(a: list[Word], b: list[Word]) -> bool:
    return len(a) == len(b) and all((x[1] == y[1] and (x[1] or x[0][:1] == y[0][:1])) for x, y in zip(a, b))


def spoken(text: str | None, adverts: frozenset[str] = frozenset()) -> list[Word]:
    """The spoken words in order; empty for null, empty and wordless texts. adverts: openers of lines that are none (`boilerplate.openers`).

    Words are folded (lower case, ss for the sharp s), without punctuation around them and apostrophes; a token without
    letter or digit is no word. A text without any cue time is taken as speech altogether.
    """
    if not text:
        return []
    text = "\n\x1e\n".join(_cues(_plain(text)))
    if "<" in text or "{" in text:
        text = _MARKUP.sub("", text)
    text = _unsung(_SOUND.sub(" ", text))
    if ":" in text:
        text = _SPEAKER.sub(_label, text)
    out: list[Word] = []
    before: list[list[Word]] = []
    look, hints = _WORDS.__getitem__, _WORDS.hints
    for cue in text.split("\x1e"):
        lines = []
        for line in cue.split("\n"):
            tokens = line.split()
            words = [w for w in map(look, tokens) if w]
            if not words:
                continue
            if not hints.keys().isdisjoint(tokens):
                bits = 0
                for t in tokens:
                    bits |= hints.get(t, 0)
                if _is_advert(bits):
                    continue
            if adverts and opener(words) in adverts:
                continue
            lines.append(words)
        if not lines:
            continue
        # The longest start of this cue that ends the one before has been said already.
        again = 0
        for k in range(min(len(before), len(lines)), 0, -1):
            if _same(before[-k], lines[0]) and all(map(_same, before[-k:], lines[:k])):
                again = k
                break
        for words in lines[again:]:
            out.extend(words)
        before = lines
    return out
