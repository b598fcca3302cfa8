"""One form for text that looks the same: characters, not words."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

#: Look-alike letters of other scripts and the Latin letter each looks like.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХЗԚԜѴ" "аеѕіјорсухһԁԛԝӏѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "αινορυγϲϳ" "ɑɡıꞵ",
        "ABESIJKMHOPCTYX3QWV" "aesijopcyxhdqwlv" "ABEZHIKMNOPTYX" "aivopuycj" "agiß",
        strict=True,
    )
)
#: Punctuation written in several ways, and the plain way.
PUNCTUATION = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "…": "..."}
#: Line ends other than the usual.
_LINE_ENDS = "\x85\u2028\u2029"
#: Compatibility forms that do not look like their plain form.
_OTHER_LOOK = ("<super>", "<sub>", "<fraction>", "<noBreak>", "<square>", "<circle>")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w{1,30});")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=None)
def is_unseen(ch: str) -> bool:
    """Whether a character leaves no mark: format characters, controls but for blanks and line ends, fillers, selectors."""
    kind = unicodedata.category(ch)
    if kind == "Cc":
        return ch not in "\t\n\v\f\r\x85"
    return kind == "Cf" or ch in "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0" or "\ufe00" <= ch <= "\ufe0f"


@lru_cache(maxsize=None)
def script(ch: str) -> str:
    """latin, cyrillic, greek, other for a letter; "" for what isn't one."""
    if not ch.isalpha():
        return ""
    if ch < "\u0250" or "\u1e00" <= ch <= "\u1eff":
        return "latin"
    if "\u0370" <= ch <= "\u03ff" or "\u1f00" <= ch <= "\u1fff":
        return "greek"
    if "\u0400" <= ch <= "\u052f":
        return "cyrillic"
    return "other"


@lru_cache(maxsize=None)
def _prototype(ch: str) -> str:
    """What one decomposed character becomes in a skeleton."""
    if is_unseen(ch):
        return ""
    if ch.isspace():
        return " "
    return LOOKALIKES.get(ch) or PUNCTUATION.get(ch) or ch


@lru_cache(maxsize=None)
def _stands_in(ch: str) -> bool:
    """Whether a single character is a stand-in wherever it stands: a blank of another kind, or a compatibility form of the same look."""
    if is_unseen(ch):
        return True
    if ch.isspace():
        return ch not in " \t\n\v\f\r" + _LINE_ENDS
    if ch in PUNCTUATION or ch < "\u0080":
        return False
    to = unicodedata.decomposition(ch)
    if to.startswith("<"):
        return not to.startswith(_OTHER_LOOK) and unicodedata.normalize("NFKC", ch) != ch
    return bool(to) and " " not in to  # a singleton, as the Kelvin sign


def skeleton(text: str, table: dict[str, str] | None = None) -> str:
    """The confusables skeleton: decompose, replace every character by its prototype, decompose again.

    Texts of the same look have equal skeletons: full-width forms, ligatures, decomposed accents, look-alike
    letters, unseen characters, blanks and quotes of other kinds. table gives prototypes beyond the few letters
    known here, those of ASCII too. A blank stays a blank: runs of blanks and line ends are left to whoever compares.
    """
    parts = unicodedata.normalize("NFKD", text)
    if table is None:
        return text if text.isascii() else unicodedata.normalize("NFKD", "".join(map(_prototype, parts)))
    return unicodedata.normalize("NFKD", "".join("" if is_unseen(ch) else " " if ch.isspace() else table.get(ch) or PUNCTUATION.get(ch) or ch for ch in parts))


def plainly(text: str, table: dict[str, str]) -> str:
    """text as its skeleton would be if it held nothing but plain characters: decomposed, with the prototypes of ASCII only."""
    return "".join(" " if ch in " \t\n\v\f\r" else table.get(ch, ch) if ch < "\x80" else ch for ch in unicodedata.normalize("NFD", text))


def standins(text: str, table: dict[str, str] | None = None) -> list[int]:
    """The places, from 0, of characters of text that stand in for a plain one of the same look or can't be seen.

    Look-alike letters count in a word that mixes scripts, and in a word wholly of look-alikes among words of
    another script; words written in their own script don't count, nor a Greek letter before a hyphen. table gives
    more look-alikes for words that mix scripts; Latin letters count in a word mostly of another script.
    A combining mark counts if it and the letter before it have one whole character for both.
    """
    if text.isascii():
        return [i for i, ch in enumerate(text) if is_unseen(ch)] if not text.isprintable() else []
    found = {i for i, ch in enumerate(text) if _stands_in(ch)}
    for i in range(1, len(text)):
        if unicodedata.combining(text[i]) and len(unicodedata.normalize("NFC", text[i - 1 : i + 1])) == 1:
            found.add(i)
    if any(script(ch) not in ("latin", "") for ch in text):
        # words are read without unseen characters, marks and compatibility forms
        seen = [(i, c) for i, ch in enumerate(text) if not is_unseen(ch) for c in unicodedata.normalize("NFKC", ch) if not unicodedata.combining(c)]
        plain = "".join(c for _, c in seen)
        words = [(m.start(), m.group(), {script(c) for c in m.group()} - {""}) for m in _WORD.finditer(plain)]
        lettered = [w for w in words if w[2]]
        for n, (at, word, scripts) in enumerate(lettered):
            if scripts == {"latin"}:
                continue
            if len(scripts) > 1 and "latin" in scripts:
                alike = [k for k, c in enumerate(word) if script(c) not in ("latin", "") and (c in LOOKALIKES or table and table.get(c, c).isascii())]
                if not alike:
                    foreign = sum(script(c) not in ("latin", "") for c in word)
                    alike = [k for k, c in enumerate(word) if script(c) == "latin" and c in _LATIN] if 2 * foreign > len(word) else []
                found |= {seen[at + k][0] for k in alike}
                continue
            alike = [k for k, c in enumerate(word) if c in LOOKALIKES and script(c) not in ("latin", "")]
            if not alike:
                continue
            if len(scripts) == 1:
                if len(alike) < sum(c.isalpha() for c in word):
                    continue
                after = plain[at + len(word) : at + len(word) + 1]
                if scripts == {"greek"} and (after in ("-", "‐", "‑") or len(word) == 1 and word.islower() and after != "."):
                    continue
                around = [lettered[k][2] for k in (n - 1, n + 1) if 0 <= k < len(lettered)]
                if not around or any(scripts & s for s in around):
                    continue
            found |= {seen[at + k][0] for k in alike}
    return sorted(found)


_LATIN = frozenset(LOOKALIKES.values())


def unescape(text: str) -> str:
    """text with HTML entities resolved, also those written twice over or in full-width characters."""
    if "\uff06" in text:
        text = re.sub(r"＆[^\s＆&]{1,12}[;；]", lambda m: unicodedata.normalize("NFKC", m.group()), text)
    for _ in range(3):
        if "&" not in text or not _ENTITY.search(text):
            break
        text = html.unescape(text)
    return text


def _settled(text: str) -> str:
    """text decomposed, without unseen characters, look-alike letters replaced only where they stand in for others.

    A skeleton replaces look-alikes in words of their own script too, where capital and small letters differ in
    what they look like; text to be compared without case mustn't.
    """
    if not LOOKALIKES.keys().isdisjoint(text):
        at = set(standins(text))
        text = "".join(LOOKALIKES.get(ch, ch) if i in at else ch for i, ch in enumerate(text))
    return "".join(map(_settled_one, unicodedata.normalize("NFKD", text)))


@lru_cache(maxsize=None)
def _settled_one(ch: str) -> str:
    return "" if is_unseen(ch) else " " if ch.isspace() else PUNCTUATION.get(ch) or ch


#: Text of ASCII, whole Latin letters and usual marks only: nothing in it stands in for anything else.
_SIMPLE = re.compile("[\\x00-\\x7f\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u0130\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e\\u2010-\\u2015\\u2018-\\u201f]*")
_MARKED = re.compile("[\\u2010-\\u2026\\u2212]")
_to_plain = lambda m: PUNCTUATION.get(m.group(), m.group())
_MARKS = re.compile("[\\u0300-\\u036f]+")


def plain(text: str) -> str:
    """Small letters of one form, with whole accented letters: what copies are compared by."""
    if text.isascii():
        return text.lower()
    if _SIMPLE.fullmatch(text):
        return unicodedata.normalize("NFC", _MARKED.sub(_to_plain, text).casefold())
    return unicodedata.normalize("NFC", _settled(text).casefold())


def fold(text: str) -> str:
    """plain without accents."""
    if text.isascii():
        return text.lower()
    if _SIMPLE.fullmatch(text):
        return _MARKS.sub("", unicodedata.normalize("NFKD", _MARKED.sub(_to_plain, text)).casefold())
    return "".join(map(_unmarked, _settled(text).casefold()))


@lru_cache(maxsize=None)
def _unmarked(ch: str) -> str:
    return "" if unicodedata.combining(ch) else ch


def stream(text: str) -> str:
    """Letters and digits of plain text in their sequence, nothing else."""
    return "".join(_WORD.findall(plain(unescape(text))))
