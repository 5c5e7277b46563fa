"""Problem 8: text that was decoded with the wrong character encoding.

Round-trip repair: a run of a text is encoded again under each candidate legacy encoding and strictly decoded as the encoding
that was intended (UTF-8; for whole lines also an East Asian or another single-byte one); the result is kept if its garbling cost
is lower, and the repair starts anew until nothing more is gained, so nested layers come off one by one. Escaped entities are one
more layer. The garbling cost of a run is the summed weight of its characters (``weight``): what rarely stands in sound text
(controls, replacement and private characters, letters of scripts that don't belong together) weighs most.

What is restored has to make words, whatever the language (``_fits``): the letters of a word are of one script, marks follow
letters, letters of rarer alphabets stand within words of their case. An encoding whose signs are themselves letters (Cyrillic,
Greek) has to explain a whole run; otherwise sound words of those scripts would be taken apart. Lines are given another
single-byte reading only if their words can't be sound (letters of two scripts, or signs, within words; words of nothing but
accented letters) and are sound afterwards. What can't be settled that way is left as it is.

A text is a case if a run of it can be repaired, or if it shows garbled characters that can't be (replacement characters,
C1 controls). Garbled characters that are printed as an example don't count: a run that fills a pair of sound quotation marks.

Defined cases: null and empty texts are sound; a text is repaired in whole, whatever its length; what can't be recovered stays
as it is.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..parallel import spread

# Candidate encodings (fixed names of Python's codecs).
SINGLE = ("cp1252", "latin_1", "mac_roman", "cp1250", "cp1251", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2", "iso8859_15", "cp1254", "cp1257", "cp1253")
DOUBLE = ("gb18030", "cp932", "big5", "cp949", "euc_jp")
#: Encodings of whole lines that were taken for a single-byte one.
INTENDED = ("cp932", "euc_jp", "gb18030", "cp949")
#: Single-byte encodings whose upper half holds another script's letters.
LETTERS = ("cp1251", "koi8_r", "cp866", "cp1253")
#: Encodings of other scripts that are taken for a Western one.
OTHER = ("cp1251", "koi8_r", "iso8859_5", "cp1253", "cp1255", "cp1256")
#: The ten commonest letters of texts in those scripts (fixed values).
USUAL_LETTERS = {"CYRILLIC": "оеаинтсрвл", "GREEK": "αοιετσνηυρ", "HEBREW": "יוהלאמרתבש", "ARABIC": "اليمنرتوبع"}
#: Single-byte encodings that are taken for another one.
LEGACY = ("koi8_r", "cp437", "cp850", "mac_roman", "cp1251", "cp866", "cp1253", "cp1250", "cp1257", "cp1252", "iso8859_2")
#: Encodings that Western texts are written in.
RIGHT = ("cp1252", "mac_roman", "cp850")
MAX_LAYERS = 16

_ASCII = frozenset(map(chr, range(128)))
# Letters and signs of sound Latin text beside ASCII (fixed values).
_EXPECTED = frozenset("äöüßÄÖÜẞéèàâêëîïôûùüÿçœæÉÈÀÂÊËÎÏÔÛÙÇŒÆáíóúñÁÍÓÚÑìòÌÒãõÃÕåøÅØ¿¡«»“”„‘’‚‹›…–—°±µμ²³¹½¼¾·×÷§©®™€£¥ªº′″%‰†‡•−ﬁﬂ\xa0\xad\u2009")
_FEW = frozenset("œŒšŠžŽŸčČćĆđĐłŁńŃęĘąĄśŚźŹżŻěĚřŘůŮőŐűŰğĞıİşŞăĂ")
# Living scripts, by the first word of their letters' names, and letters of Latin alphabets beyond U+017F (fixed values).
_LIVING = frozenset("LATIN GREEK CYRILLIC ARMENIAN GEORGIAN HEBREW ARABIC DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR KHMER ETHIOPIC HANGUL EAST".split())
_EAST = frozenset("CJK HIRAGANA KATAKANA KATAKANA-HIRAGANA FULLWIDTH HALFWIDTH IDEOGRAPHIC BOPOMOFO".split())
_LATER_LATIN = frozenset("ƠơƯưȘșȚțẞ")
# Scripts whose letters stand next to Latin ones without a space.
_MIXING = frozenset(("GREEK", "EAST", "HANGUL", "THAI", "LAO"))
_ENTITY = re.compile(r"&#?[A-Za-z0-9]+;")
# What UTF-8 becomes: two signs or more in a row, or one of an East Asian script.
_RUN = re.compile("[^\x00-\x7f]{2,}|[\u2e80-\uffdc]")
# Signs that every longer Japanese, Chinese or Korean line holds some of.
_USUAL = frozenset("のをはにがとでたしるいのれスンルト的是了在，이는다에의가을를은하고로")
_LOST = re.compile("[\ufffd\x80-\x9f]+")
# What is left of UTF-8 of which bytes were dropped: first bytes and signs of further ones, several times in a row.
_MORE = "\xa0-¿€‚ƒ„…†‡ˆ‰‹‘’“”•–—˜™›ŠŒŽšœžŸ"
_REMAINS = re.compile(f"(?:[Â-ï][{_MORE}]){{2,}}")
_HINT = re.compile(f"[{_MORE}](?<=[Â-ï].)(?=[Â-ï][{_MORE}])")  # the same from its second sign on, which is rarer than the first
_LOST_SIGNS = frozenset(map(chr, [0xFFFD, *range(0x80, 0xA0)]))
# Words that can't be sound: Latin and Cyrillic letters side by side, Greek letters or other signs between Latin ones, capitals
# between small letters.
_SIGNS = frozenset(map(chr, [0xFFFD, *range(0x80, 0xA0)]))
# Words that can't be sound: Latin and Cyrillic letters side by side, Greek letters or other signs between Latin ones.
_SIGNS = "²³¹¼½¾¿¸º»¶‡†‰‚„…÷×ⁿ√∞≈∆∂∑⌠⌡∩≡π¢£¥ªƒ§˙"
_GREEK, _CYRILLIC, _LATIN = "\u0370-\u03ff\u2504-\u254f\u2552-\u25ff", "\u0400-\u052f", "[A-Za-z]"
# The sign comes first in the pattern, so a search runs from sign to sign and not from letter to letter.
_ODD = re.compile(f"[{_CYRILLIC}{_GREEK}{_SIGNS}](?:(?<={_LATIN}[{_CYRILLIC}])|(?<=[{_CYRILLIC}])(?={_LATIN})|(?<={_LATIN}[{_GREEK}])(?={_LATIN})|(?<={_LATIN}[{_SIGNS}])(?=[a-z]))")
_CAPITAL = re.compile("[À-ÖØ-ÞŒŠŽŸ](?<=[a-z].)(?=[a-z])")
_STUCK = re.compile("[À-ÖØ-öø-ÿ](?=[0-9])|(?<=[0-9])[À-ÖØ-öø-ÿ]|[€£¥¢§©®™°±²³¹×÷…†‡‰•¿¡«»“”„\xa0](?<=[A-Za-z].)(?=[A-Za-z])")
_ACCENTED = re.compile("[À-ÖØ-öø-ÿ]{4,}")
_HIGH = re.compile("[^\x00-\x7f]{4}")
_ODD_SIGNS = frozenset(map(chr, (*range(0x370, 0x530), *range(0x2500, 0x2600)))) | frozenset(_SIGNS) | frozenset(map(chr, range(0xC0, 0xDF)))
_WESTERN = re.compile("[\x80-\u036f\u2010-\u22ff]").match
_QUOTES = {"“": "”", "„": "“”", "‘": "’", "«": "»", "»": "«", '"': '"', "'": "'", "「": "」", "『": "』", "‹": "›"}
_CLOSING = frozenset("".join(_QUOTES.values()))
MEMO = 200_000
_memo: dict[str, tuple[str, ...]] = {}


@cache
def _bytes(encoding: str) -> dict[str, int]:
    """Characters of a single-byte encoding's upper half; bytes it doesn't define stand for the C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@cache
def _pattern(encoding: str) -> tuple[re.Pattern, frozenset, frozenset]:
    """Runs that UTF-8 may have become under the encoding; the characters of its first and of its further bytes."""
    by = {b: c for c, b in _bytes(encoding).items()}
    chars = lambda lo, hi: "".join(by[b] for b in range(lo, hi + 1))
    cls = lambda s: "[" + re.escape(s) + "]"
    more = cls(chars(0x80, 0xBF))
    two, three, four = cls(chars(0xC2, 0xDF)), cls(chars(0xE0, 0xEF)), cls(chars(0xF0, 0xF4))
    return re.compile(f"(?:{two}{more}|{three}{more}{more}|{four}{more}{more}{more})+"), frozenset(chars(0xC2, 0xF4)), frozenset(chars(0x80, 0xBF))


@cache
def weight(c: str) -> float:
    """How much a character speaks for garbling."""
    o = ord(c)
    if o < 0x80:
        return 0.0
    if c == "�" or 0x80 <= o < 0xA0 or 0xE000 <= o < 0xF900:
        return 3.0
    if 0x3040 <= o < 0x3100 or 0x4E00 <= o < 0xA000 or 0x3000 <= o < 0x3020 or 0xFF01 <= o < 0xFF5F:
        return 0.6  # kana, Han and their punctuation: a sound text is full of them
    if 0xFF61 <= o < 0xFFA0:
        return 1.2
    if 0x2500 <= o < 0x25A0:
        return 1.5
    if c.isalpha() and (o < 0x250 or 0x370 <= o < 0x400):
        return 1.0
    if 0x2010 <= o < 0x2030 or c in "°±²³µ·½€™′″→≤≥−×§©®":
        return 1.0
    return 1.5


def cost(text: str) -> float:
    """Garbling cost."""
    return sum(map(weight, text))


@cache
def _script(c: str) -> str:
    """The script of a letter or mark; empty for other characters and for marks of any script."""
    if unicodedata.category(c)[0] not in "LM" or c in "ªºµ" or "\u2100" <= c < "\u2150":
        return ""
    name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    return "EAST" if name in _EAST else "" if name in ("COMBINING", "MODIFIER", "VARIATION") else name


@cache
def _common(c: str) -> bool:
    """Whether a decoded character is a usual one of Latin, Greek, Cyrillic or Japanese and Chinese writing."""
    o = ord(c)
    if o < 0x80:
        return o >= 0x20 or c in "\t\n\r"
    if 0x80 <= o < 0xA0 and o != 0x80:
        return True  # a layer may still be below
    if c in ("\ufeff", "\u200b"):
        return True
    if unicodedata.category(c) in ("Cn", "Co", "Cs", "Mn", "Mc", "Me"):
        return False
    return o < 0x100 or c in _FEW or o in (0x192, 0x2C6, 0x2DC) or 0x391 <= o < 0x3CA or 0x401 <= o < 0x460 or 0x2000 <= o < 0x2760 or 0x27E0 <= o < 0x2A00 or 0x3000 <= o < 0x3400 or 0x4E00 <= o < 0xA000 or 0xFB00 <= o < 0xFB07 or 0xFF00 <= o < 0xFFEF


@cache
def _plausible(c: str) -> bool:
    """Whether a decoded character may stand in sound text of any language in use."""
    if _common(c):
        return True
    kind, script = unicodedata.category(c), _script(c)
    if kind[0] == "M":
        return script in _LIVING or "\u0300" <= c < "\u0329" or "\ufe00" <= c < "\ufe10"
    if kind[0] == "L":
        return script in _LIVING and script != "EAST" and (script != "LATIN" or c < "\u0180" or c in _LATER_LATIN or "\u1ea0" <= c < "\u1efa")
    # Digits, punctuation and signs of those scripts, joiners, and pictures.
    if kind in ("Nd", "Po", "Pd", "Sc"):
        return unicodedata.name(c, "").split(" ")[0] in _LIVING
    return kind == "Cf" and "\u200b" <= c < "\u2070" or c >= "\U0001f000" and kind in ("So", "Sk")


def _gain(old: str, new: str) -> bool:
    return all(map(_plausible, new)) and cost(new) < cost(old)


def _fits(before: str, old: str, new: str, after: str) -> int:
    """Whether ``new`` in place of ``old`` makes words, between the characters before and after it: 0 no, 1 if its line holds more
    of the kind, 2 yes."""
    s = f"{before or ' '}{new}{after or ' '}"
    scripts = [_script(c) for c in s]
    for k in range(1, len(s)):
        a, b, mark = scripts[k - 1], scripts[k], unicodedata.category(s[k])[0] == "M"
        if mark and (unicodedata.category(s[k - 1])[0] not in "LM" or a and b and a != b):
            return 0
        if a and b and a != b and not ("LATIN" in (a, b) and ({a, b} & _MIXING) and (s[k - 1] < "\x80" or s[k] < "\x80")):
            return 0
    # Two letters of another script can be a word of it.
    if len(new) == 1 and len(old) == 2 and all(_script(c) in ("CYRILLIC", "GREEK") for c in old) and not (before + after).strip().isalpha():
        return 1 if scripts[1] else 2 if new < "\u0100" else 0  # no word has those two that stand for a Western sign
    for k in range(1, len(s) - 1):
        c = s[k]
        if _common(c) and c not in _FEW or not scripts[k] or scripts[k] == "EAST":
            continue
        near = [x for x, script in ((s[k - 1], scripts[k - 1]), (s[k + 1], scripts[k + 1])) if script == scripts[k] or script == "" and unicodedata.category(x)[0] == "M"]
        if not near and (scripts[k] == "LATIN" or len(old) < 3):  # a letter of a rarer alphabet stands in a word; Å² is a unit
            return 0 if old in ("Å²", "Å³") else 1
        if scripts[k] == "LATIN" and c.islower() and len(near) == 1 and near[0].isupper() and s[k - 1] == near[0] and k > 1:
            return 0
    return 2


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether the signs around a run fill a pair of quotation marks: an example, printed on purpose."""
    while start and text[start - 1] > "\x7f" and text[start - 1] not in _QUOTES:
        start -= 1
    while end < len(text) and text[end] > "\x7f" and text[end] not in _CLOSING:
        end += 1
    # The run itself may have swallowed the marks.
    if text[start] in _QUOTES and text[end - 1] in _QUOTES[text[start]] and end - start > 2:
        return True
    before, after = text[start - 1 : start], text[end : end + 1]
    return before in _QUOTES and after != "" and after in _QUOTES[before]


def _best(run: str) -> str | None:
    """The run with one layer undone by the candidate that gains most, one that explains all of the run before others; or None."""
    best, gained = None, (False, 0.0)
    signs = set(run)
    for e in SINGLE:
        pattern, leads, mores = _pattern(e)
        if signs.isdisjoint(leads) or signs.isdisjoint(mores):
            continue
        table = _bytes(e)

        def undo(m: re.Match) -> str:
            old = m.group()
            new = _decoded(bytes(map(table.__getitem__, old)), "utf-8")  # noqa: B023
            return new if new is not None and _gain(old, new) else old

        new = pattern.sub(undo, run)
        if new != run and cost(new) < cost(run):
            rest = pattern.sub("", run)
            left = sum(map(str.isalpha, rest))
            kept = [m for m in pattern.finditer(run) if undo(m) == m.group()]
            if e in LETTERS and (left or kept) or left > len(new) - len(rest) or kept and left:
                continue  # letters of a sound word, or of another encoding, among them
            best, gained = max((best, gained), (new, (not rest and not kept, cost(run) - cost(new))), key=lambda x: x[1])
    if best is None and max(run) >= "⺀":
        # Han signs among ASCII, without kana, weigh like strange letters.
        own = 2.0 * len(run) if not any("぀" <= c < "㄀" for c in run) else cost(run)
        for e in DOUBLE:
            try:
                new = run.encode(e).decode("utf-8")
            except UnicodeError:
                continue
            if all(map(_common, new)) and own - cost(new) > gained[1]:
                best, gained = new, (True, own - cost(new))
    return best


def _layers(run: str) -> tuple[str, ...]:
    """What the run becomes as one layer after the other is undone. Runs recur, so short ones are remembered."""
    if run in _memo:
        return _memo[run]
    out: list[str] = []
    while len(out) < MAX_LAYERS and (new := _best(out[-1] if out else run)) is not None:
        out.append(new)
    if len(_memo) >= MEMO:
        _memo.clear()
    if len(run) < 32:
        _memo[run] = tuple(out)
    return tuple(out)


def _kinds(s: str) -> set[str]:
    """Scripts of a string's letters; those of rarer Latin alphabets apart."""
    return {"RARE" if script == "LATIN" and (not _common(c) or c in _FEW) else script for c in s if (script := _script(c))}


def _runs(text: str) -> tuple[str, int]:
    """Undo as many layers of every run as leave words behind."""
    n = 0
    sure: dict[int, set[str]] = {}  # what was restored, by line
    rest = False

    def undo(m: re.Match) -> str:
        nonlocal n, rest
        run = m.group()
        layers = _layers(run)
        if not layers or _quoted(text, m.start(), m.end()):
            return run
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        for k in range(len(layers), 0, -1):
            new = layers[k - 1]
            fits = _fits(before, layers[k - 2] if k > 1 else run, new, after)
            if fits == 1:
                rest = True
                fits = 2 if _kinds(new) <= sure.get(text.rfind("\n", 0, m.start()), set()) else 0
            if fits:
                n += k
                sure.setdefault(text.rfind("\n", 0, m.start()), set()).update(_kinds(new))
                return new
        return run

    out = _RUN.sub(undo, text)
    if rest and sure:  # single letters that stand before the words that settle them
        n = 0
        out = _RUN.sub(undo, text)
    return out, n


def _legacy(text: str) -> tuple[str, int]:
    """Undo readings of one single-byte encoding as another in lines that hold several words which can't be sound, and then of the
    same encodings (or of any that restore a word of the text) in lines with one such word. A line is kept if every sign of it is then an expected one and no such word is
    left."""
    lines, fixed = text.split("\n"), 0
    pairs: dict[tuple[str, str], None] = {}
    rest = []
    for k, line in enumerate(lines):
        if line.isascii() or _FOREIGN.search(line):  # three letters of another script in a row are a word of that script
            continue
        capitals = len(_CAPITAL.findall(line))
        odd = len(_ODD.findall(line)) + capitals
        if odd >= 2 and sum(c > "\x7f" and c not in _EXPECTED for c in line) + capitals >= 2:
            for wrong in LEGACY:
                raw = _raw(line, wrong)
                right, new = next(((right, new) for right in RIGHT if raw is not None and (new := _sound(raw, wrong, right))), (None, None))
                if new:
                    lines[k], fixed = new, fixed + 1
                    pairs[wrong, right] = None
                    break
        elif odd:
            rest.append(k)
    for k in rest:
        for wrong, right in pairs or ((w, r) for w in LEGACY for r in RIGHT):
            raw = _raw(lines[k], wrong)
            new = None if raw is None else _sound(raw, wrong, right)
            # Without other lines to go by, one of the words has to stand elsewhere in the text as it is then.
            if new and (pairs or any(len(b) > 3 and re.search(rf"\b{re.escape(b)}\b", text) for a, b in zip(_WORD.findall(lines[k]), _WORD.findall(new), strict=False) if a != b)):
                lines[k], fixed = new, fixed + 1
                break
    return "\n".join(lines), fixed


def _sound(raw: bytes, wrong: str, right: str) -> str | None:
    """A line's bytes under another encoding, if that makes it sound."""
    new = _decoded(raw, right) if right != wrong else None
    if not new or not all(c < "\x80" or c in _EXPECTED for c in new) or _ODD.search(new) or _CAPITAL.search(new) or _STUCK.search(new):
        return None
    return new


_WORD = re.compile(r"\S*\w\S*")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f]{3}")


def _raw(line: str, encoding: str) -> bytes | None:
    """The line's bytes under a single-byte encoding, or None."""
    table = _bytes(encoding)
    try:
        return bytes(ord(c) if c < "\x80" else table[c] for c in line)
    except KeyError:
        return None


def _breaks(line: str) -> int:
    """Places in words where the script changes, or a capital follows a small letter."""
    return sum(a.isalpha() and b.isalpha() and (_script(a) != _script(b) or a.islower() and b.isupper()) for a, b in zip(line, line[1:]))


def _other_script(text: str) -> tuple[str, int]:
    """Undo a Western reading of lines in another script: their words are of nothing but accented letters."""
    out, fixed = [], 0
    for line in text.split("\n"):
        words = [] if line.isascii() else _ACCENTED.findall(line)
        if len(words) >= 2 and 2 * sum(map(len, words)) >= sum(map(str.isalpha, line)):
            for wrong in ("cp1252", "latin_1"):
                raw = _raw(line, wrong)
                if raw is None:
                    continue
                read = [n for n in (_decoded(raw, right) for right in OTHER) if n and all(map(_plausible, n)) and not any("\x80" <= c < "\xa0" for c in n) and not _breaks(n)]
                shares = sorted(((_usual(n), n) for n in read), reverse=True)
                if shares and shares[0][0] >= 0.5 and (len(shares) == 1 or shares[0][0] > shares[1][0]):
                    line, fixed = shares[0][1], fixed + 1
                    break
        out.append(line)
    return "\n".join(out), fixed


def _usual(line: str) -> float:
    """The share of common letters among those of the line's script."""
    letters = [c for c in line.lower() if c > "\x7f" and c.isalpha()]
    script = Counter(map(_script, letters)).most_common(1)[0][0] if letters else ""
    return sum(unicodedata.normalize("NFD", c)[0] in USUAL_LETTERS.get(script, "") for c in letters) / max(1, len(letters))


def _east(n: str | None, intended: str, written: str) -> bool:
    """Whether a decoded line reads as East Asian text; short lines without a usual sign only where the text around them is of the
    same writing (``written``: kana, hangul or neither)."""
    if not n:
        return False
    if intended == "cp949":
        return 2 * sum("가" <= c <= "힣" for c in n) >= sum(c > "\x7f" for c in n) and (written == "hangul" or not _USUAL.isdisjoint(n))
    if sum("぀" <= c < "ꀀ" for c in n) * 2 < len(n):
        return False
    if written == "kana" and intended in ("cp932", "euc_jp"):
        return all(c < "\x80" or "\u3000" <= c < "\u3100" or "一" <= c < "ꀀ" or "\uff00" <= c for c in n) or not _USUAL.isdisjoint(n)
    return not _USUAL.isdisjoint(n)


_KANA, _HANGUL = re.compile("[぀-ヿ]"), re.compile("[가-힣]")


def _lines(text: str) -> tuple[str, int]:
    """Undo a single-byte reading of lines of a double-byte encoding."""
    out, fixed, written = [], 0, None
    for line in text.split("\n"):
        high = 0 if line.isascii() else len(line) - len(line.encode("ascii", "ignore"))
        if high >= 4 and high * 4 >= len(line) and not any("぀" <= c < "ꀀ" or "가" <= c <= "힣" for c in line):
            if written is None:
                written = "kana" if _KANA.search(text) else "hangul" if _HANGUL.search(text) else ""
            for e in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251"):
                raw = _raw(line, e)
                if raw is None:
                    continue
                if _decoded(raw, "utf-8") is not None:
                    break  # a layer of UTF-8, undone run by run
                new = next((n for n, i in ((_decoded(raw, i), i) for i in INTENDED) if _east(n, i, written) and _gain(line, n)), None)
                if new:
                    line, fixed = new, fixed + 1
                    break
        out.append(line)
    return "\n".join(out), fixed


def _decoded(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def repair(text: str) -> tuple[str, int, int]:
    """The text as far as it can be restored, how many runs were restored (nested layers count each), and how many garbled
    characters remain."""
    if not text or text.isascii() and "&" not in text:
        return text, 0, 0
    fixed = 0
    for _ in range(MAX_LAYERS):
        signs = set(text) - _ASCII
        if not signs:
            break
        text, n = _lines(text) if not _LOST_SIGNS.isdisjoint(signs) else (text, 0)
        if not n:
            text, n = _runs(text)
        if not n and not _ODD_SIGNS.isdisjoint(signs) and (_ODD.search(text) or _CAPITAL.search(text)):
            text, n = _lines(text)
            if not n:
                text, n = _legacy(text)
        # A line of another encoding has many different signs, four of them in a row.
        if not n and sum(1 for c in signs if _WESTERN(c)) >= 6 and _HIGH.search(text):
            text, n = _lines(text)
            if not n:
                text, n = _other_script(text)
        if not n:
            break
        fixed += n
    if "&" in text and _ENTITY.search(text):
        plain = html.unescape(text)
        if plain != text and not (plain.isascii() or _ENTITY.search(plain)):
            inner, n, left = repair(plain)
            if n:
                return inner, fixed + n, left
    left = [] if _LOST_SIGNS.isdisjoint(text) else list(_LOST.finditer(text))
    if _HINT.search(text):
        left += _REMAINS.finditer(text)
    return text, fixed, sum(m.end() - m.start() for m in left if not _quoted(text, m.start(), m.end()))


def repaired(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is garbled, with the text as far as it can be restored, and the columns fixed_runs and
    garbled_left. Other columns stay as they are."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c not in ("fixed_runs", "garbled_left")]
    docs = docs.select(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField("fixed_runs", T.IntegerType()), T.StructField("garbled_left", T.IntegerType())])
    at = names.index(text)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, fixed, left = [], [], [], []
            for k, t in enumerate(b.column(at).to_pylist()):
                new, n, m = repair(t)
                if n or m:
                    rows.append(k)
                    texts.append(new)
                    fixed.append(n)
                    left.append(m)
            some = b.take(pa.array(rows, pa.int64()))
            cols = [*some.columns, pa.array(fixed, pa.int32()), pa.array(left, pa.int32())]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "fixed_runs", "garbled_left"])

    # Only texts with a character outside ASCII, or an entity, can be garbled: the rest never leaves the JVM.
    return spread(docs.where(F.col(text).rlike("[^\\x00-\\x7F]|&[#A-Za-z]"))).mapInArrow(go, schema)
