"""Several values packed in one field: a parsing expression grammar and the operator around it.

The grammar, its alternatives tried in the order written, going back on failure:

    value     <- listed / enclosed / sequence
    listed    <- '[' quoted (',' quoted)* ']' END
    enclosed  <- '[' sequence ']' END, where a separator stands inside and no bracket does
    sequence  <- piece (separator piece)*
    piece     <- quoted &(separator / END) / bracketed &(separator / END) / bare
    quoted    <- '"' ('""' / escape / [^"])* '"'
    bracketed <- '[' [^][]* ']' / '(' [^()]* ')' / '{' [^{}]* '}'
    bare      <- (!separator .)*

What counts as a separator depends on the kind of the field (`KINDS`): codes hold neither blanks nor
punctuation, messages hold commas, semicolons and bars of their own, names hold a comma between
surname and given name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may separate values, by kind of field.
_CODE_SEPARATOR = re.compile(r"[\s;|,/+&]+")
_MESSAGE_SEPARATOR = re.compile(r'\s*[\t\r\n]+\s*|\s*(?:[;|,]|\s/\s)\s*(?=$|["\[;|,]|\w+: )')
_NAME_SEPARATOR = re.compile(r"\s*[;|\t\r\n]\s*|\s+[/&+]\s+|\s+and\s+", re.IGNORECASE)
_COMMA = re.compile(r"\s*,\s*")
_QUOTED = re.compile(r'"((?:[^"\\]|""|\\.)*)"')
_BY_QUOTE = re.compile(r"\0\s*,\s*\S|,\s*\0")
_BRACKETED = re.compile(r"\[([^\[\]]*)\]|\(([^()]*)\)|\{([^{}]*)\}")
_ESCAPE = re.compile(r'\\(["\\/])')
_ENCLOSED = re.compile(r"\[([^\[\]]*)\]\s*$|\(([^()]*)\)\s*$|\{([^{}]*)\}\s*$")
_LISTED = re.compile(r'\s*\[\s*(?:"(?:[^"\\]|""|\\.)*"\s*(?:,\s*|(?=\])))+\]\s*$')
#: Words that mark a corporate author.
_BODY_WORDS = (
    "institute", "ministry", "agency", "council", "university", "department", "association", "office",
    "centre", "center", "society", "committee", "commission", "organisation", "organization", "foundation",
    "authority", "federation", "union", "board", "bureau", "academy", "college", "school", "group",
)
_BODY = re.compile(r"\b(?:" + "|".join(_BODY_WORDS) + r")\b", re.IGNORECASE)
_INITIALS = re.compile(r"(?:[^\W\d_]\.?[\s\-]?){1,4}$")
#: Initials, or one given name with initials, and perhaps a particle: never a whole name.
_GIVEN = re.compile(r"(?:[^\W\d_]{2,}\s+)?(?:[^\W\d_]\.[\s\-]?)+(?:\s*(?:van|von|de|der|den|da|dal|di|du|la|le|ten|ter|zu|zur))*$", re.IGNORECASE)
_DOTTED = re.compile(r"[^\W\d_]\.")
#: Particles that begin a surname.
_PARTICLES = frozenset("van von de der den da dal di du la le ten ter zu zur al el".split())

KINDS = ("codes", "messages", "names")


def _unquote(inner: str) -> str:
    return _ESCAPE.sub(r"\1", inner.replace('""', '"')).strip()


def _is_full(piece: str) -> bool:
    """Whether a piece between commas is a whole name: given name first, or a surname with bare initials after it."""
    words = piece.split()
    while len(words) > 1 and words[-1].lower() in _PARTICLES:
        words.pop()  # "S. G. von": given names and the particle of the surname before the comma
    if len(words) < 2 or _INITIALS.match(piece) and "." in piece:
        return False
    last = words[-1]
    if _DOTTED.search(last) and len(last.replace(".", "").replace("-", "")) <= 3:
        return False  # "Yevgenia H.": given names
    if _INITIALS.match(last) and last.isupper() and len(words[0]) > 2:
        return True  # "Shavedusvley G"
    return words[0].lower() not in _PARTICLES and len(last) > 2


def _split_commas(text: str) -> list[str]:
    """A run of names between stronger separators. Ordered alternatives at each comma: surname and given name; a whole name."""
    if "," not in text or _BODY.search(text):
        return [text]
    pieces = [p for p in _COMMA.split(text) if p]
    out: list[str] = []
    i = 0
    while i < len(pieces):
        if i + 1 == len(pieces):
            out.append(pieces[i])
            i += 1
        elif _GIVEN.match(pieces[i + 1]) or not _is_full(pieces[i]) and not _is_full(pieces[i + 1]):
            out.append(f"{pieces[i]}, {pieces[i + 1]}")
            i += 2
        else:
            out.append(pieces[i])
            i += 1
    return out


def _pieces(text: str, separator: re.Pattern, comma_too: bool) -> Iterator[tuple[str, str]]:
    """(kind, text) of each piece of a sequence; comma_too: commas separate as well."""
    at, end = 0, len(text)
    while at < end:
        while at < end and text[at].isspace() and text[at] not in "\t\r\n":
            at += 1
        found = None
        for kind, pattern in (("quoted", _QUOTED), ("bracketed", _BRACKETED)):
            m = pattern.match(text, at)
            if not m:
                continue
            after = m.end()
            sep = separator.match(text, after) or _COMMA.match(text, after)
            if text[after:].strip() and not sep:
                continue  # it closes inside a value: go back and take the next alternative
            inner = _unquote(m.group(1)) if kind == "quoted" else next(g for g in m.groups() if g is not None).strip()
            found = (kind, inner)
            at = sep.end() if sep else end
            break
        if found:
            yield found
            continue
        ends = (separator.search(text, at), _COMMA.search(text, at) if comma_too else None)
        sep = min((m for m in ends if m), key=lambda m: m.start(), default=None)
        bare = text[at : sep.start() if sep else end].strip()
        yield "stray" if '"' in bare else "bare", bare
        at = sep.end() if sep else end


@lru_cache(maxsize=20_000)
def parse_packed(text: str, kind: str) -> tuple[tuple[str, str], ...]:
    """(value, error flag) of each value packed in text, in order, empty ones dropped.

    The flag is "" or malformed_quote (a quote that never closes, or closes inside a value; the text is
    kept as it stands) or malformed_list (brackets around something that isn't a list of quoted values).
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of packed field: {kind}")
    text = text.strip()
    if not text:
        return ()
    if _LISTED.match(text):
        return tuple((v, "") for v in (_unquote(m) for m in _QUOTED.findall(text)) if v)
    flag = ""
    if text[0] == "[" and text[-1] == "]" and '"' in text:
        text, flag = text[1:-1].strip(), "malformed_list"
    parts_at = {"codes": _CODE_SEPARATOR, "messages": _MESSAGE_SEPARATOR, "names": _NAME_SEPARATOR}[kind]
    enclosed = _ENCLOSED.match(text)
    if enclosed and (inner := next(g for g in enclosed.groups() if g is not None).strip()) and parts_at.search(inner) and '"' not in inner:
        text = inner
    separator = parts_at
    if kind == "names" and _BODY.search(text) and not re.search(r"[;|\t\r\n\"]", text):
        return ((text, flag),) if text.strip(", ") else ()
    commas_separate = kind == "names" and '"' in text and bool(_BY_QUOTE.search(_QUOTED.sub("\0", text)))
    parts = list(_pieces(text, separator, commas_separate))
    out: list[tuple[str, str]] = []
    for k, value in parts:
        if k == "quoted":
            values = [value]
        elif kind == "names" and not commas_separate:
            values = _split_commas(value.strip(" ,"))
        elif kind == "codes":
            values = [value.strip("[](){}")]
        else:
            values = [value.strip(" ,")] if kind == "names" else [value]
        out += [(v, "malformed_quote" if k == "stray" else flag) for v in (x.strip() for x in values) if v]
    return tuple(out)


def split_packed(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row (key, field_name, pos, item, flag) for each value packed in the named fields.

    fields maps a column of df to its kind, one of `KINDS`. Positions count from 1 among the values that
    aren't empty. A null, empty or blank field gives no row; a field with one value gives one; a text of
    any length is parsed whole; equal rows each give their own. Columns of df not named play no part, so
    ones called pos or item do no harm. There is no shuffle: fields are unpivoted and parsed where they lie.
    """
    pairs = ", ".join(f"'{c}', '{k}', cast(`{c}` as string)" for c, k in fields.items())
    key_type = df.select(key).schema[0].dataType
    long = (
        df.select(key, *fields)
        .selectExpr(f"`{key}` as `{key}`", f"stack({len(fields)}, {pairs}) as (field_name, field_kind, field_text)")
        .where("trim(field_text) <> ''")
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, kinds, texts = (batch.column(i) for i in range(4))
            take, pos, items, flags = [], [], [], []
            for i, (kind, text) in enumerate(zip(kinds.to_pylist(), texts.to_pylist())):
                for n, (item, flag) in enumerate(parse_packed(text, kind), 1):
                    take.append(i)
                    pos.append(n)
                    items.append(item)
                    flags.append(flag)
            rows = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [keys.take(rows), names.take(rows), pa.array(pos, pa.int32()), pa.array(items, pa.string()), pa.array(flags, pa.string())],
                names=[key, "field_name", "pos", "item", "flag"],
            )

    return long.mapInArrow(parse, f"`{key}` {key_type.simpleString()}, field_name string, pos int, item string, flag string")


def packed_flag_counts(values: DataFrame) -> DataFrame:
    """(field_name, flag, n): how often each error flag occurs in the rows of split_packed."""
    name: Column = F.when(F.col("flag") == "", F.lit("none")).otherwise(F.col("flag"))
    return values.groupBy("field_name", name.alias("flag")).agg(F.count(F.lit(1)).alias("n"))
