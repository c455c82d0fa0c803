"""Text functions as column expressions; all run inside the JVM.

Lengths are UTF-8 bytes, and the word separators of densities are those of ASCII:
every other character counts as a separator there.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\r\f\x0B]+"
#: Common references, for the SQL twins.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))


def squeeze(text: Column) -> Column:
    """Tokens between ASCII white space, joined by one space."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def ascii_tokens(text: Column) -> Column:
    """Tokens between ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Words: runs of letters and digits of any script, no empty ones."""
    return F.filter(F.split(text, r"(?U)[\W_]+", -1), lambda t: t != "")


def separated(text: Column) -> Column:
    """Parts between runs of ASCII separators, empty ones included."""
    return F.split(text, r"[\W_]+", -1)


def has_word(text: Column) -> Column:
    """Whether there is a letter or digit of any script."""
    return text.rlike(r"[\p{L}\p{N}]")


def link_density(link_text: Column, text: Column) -> Column:
    return (F.size(separated(link_text)) / F.size(separated(text))).cast("double")


def text_density(text: Column) -> Column:
    """Parts per full line of 80 bytes; the last, partial line is left out."""
    lines = F.ceil(F.octet_length(text) / F.lit(80.0)).cast("int")
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), (lines - 1) * 80), "ISO-8859-1")
    return F.when(lines <= 1, F.size(separated(text)).cast("double")).otherwise(F.size(separated(head)) / (lines - 1).cast("double"))


#: Names of characters that HTML 4 has; those that count without a semicolon too, longer ones first.
NAMES = {name: chr(code) for name, code in html.entities.name2codepoint.items()}
SHORT = sorted((name for name in html.entities.html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
#: What numbers from 128 to 159 stand for: the characters of Windows-1252.
_LOW = {128 + i: bytes([128 + i]).decode("cp1252", "replace") for i in range(32) if i not in (1, 13, 15, 16, 29)}


def _numbered(digits: Column, base: int) -> Column:
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    code = F.conv(F.substring(digits, 1, 8), base, 10).cast("long")
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    low = F.create_map(*[F.lit(x) for pair in _LOW.items() for x in pair])
    wrong = (F.length(digits) > 8) | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(wrong, "\ufffd").when(code.between(128, 159), F.coalesce(F.element_at(low, code.cast("int")), plain)).otherwise(plain)


def unescape(text: Column) -> Column:
    """Character references by number or by a name of HTML 4, as browsers read them:
    some names count without a semicolon, at the start of a longer word too."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    short = F.create_map(*[F.lit(x) for n in SHORT for x in (n, html.entities.html5[n])])

    def one(part: Column) -> Column:
        hexadecimal, decimal = r"^#[xX]([0-9a-fA-F]+);?", "^#([0-9]+);?"
        name, start = r"^([A-Za-z][A-Za-z0-9]*);", f"^({'|'.join(SHORT)});?"
        cut = lambda pattern: F.regexp_replace(part, pattern, "")
        found = F.element_at(names, F.regexp_extract(part, name, 1))
        return (
            F.when(part.rlike(hexadecimal), F.concat(_numbered(F.regexp_extract(part, hexadecimal, 1), 16), cut(hexadecimal)))
            .when(part.rlike(decimal), F.concat(_numbered(F.regexp_extract(part, decimal, 1), 10), cut(decimal)))
            .when(found.isNotNull(), F.concat(found, cut(name)))
            .when(part.rlike(start), F.concat(F.element_at(short, F.regexp_extract(part, start, 1)), cut(start)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&", -1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), one)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


#: Latin-1 and Windows-1252 characters.
_BYTES = r"^[\x00-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]*$"
_LEAD = "[\u00c2-\u00f4][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"


def mended(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252, read again; other texts as they are.

    Only whole texts whose characters come from single bytes that are UTF-8.
    """
    raw = F.encode(F.translate(text, "".join(_LOW.values()), "".join(map(chr, _LOW))), "ISO-8859-1")
    return F.when(text.rlike(_LEAD) & text.rlike(_BYTES), F.coalesce(F.try_validate_utf8(raw), text)).otherwise(text)


def guess_encoding(raw: Column, default: str = "utf-8") -> Column:
    """The encoding that a page (binary or string) names, or ``default``.

    An XML declaration in the first 1024 bytes goes before a meta tag in the first
    2048 bytes or 5 % of the page, whichever is more. Statistical detection isn't
    offered: ``default='chardet'`` raises ValueError.
    """
    if default.lower() == "chardet":
        raise ValueError("statistical detection of encodings isn't supported")
    data = raw.cast("binary")
    head = F.decode(F.substring(data, F.lit(1), F.lit(1024)), "ISO-8859-1")
    reach = F.greatest(F.lit(2048), F.floor(F.octet_length(data) * 0.05)).cast("int")
    wide = F.decode(F.substring(data, F.lit(1), reach), "ISO-8859-1")
    xml = F.regexp_extract(head, r"""(?i)^<\?[^\n]*?encoding\s*?=\s*?['"]([^\n]*?)['"][^\n]*?\?>""", 1)
    meta = F.regexp_extract(wide, r"""(?i)<\s*meta[^>]+charset\s*?=\s*?['"]?([^>]*?)[ /;'">]""", 1)
    return F.coalesce(F.nullif(xml, F.lit("")), F.nullif(meta, F.lit("")), F.lit(default))


def to_text(column: Column, encoding: str = "UTF-8") -> Column:
    """Binary to string; strings stay."""
    return F.decode(column.cast("binary"), encoding)


def to_bytes(column: Column, encoding: str = "UTF-8") -> Column:
    return F.encode(column, encoding)


def to_text_list(column: Column, encoding: str = "UTF-8") -> Column:
    return F.transform(column, lambda x: to_text(x, encoding))


def to_bytes_list(column: Column, encoding: str = "UTF-8") -> Column:
    return F.transform(column, lambda x: to_bytes(x, encoding))


def to_text_map(column: Column, encoding: str = "UTF-8") -> Column:
    return F.transform_values(F.transform_keys(column, lambda k, _: to_text(k, encoding)), lambda _, v: to_text(v, encoding))


def to_bytes_map(column: Column, encoding: str = "UTF-8") -> Column:
    return F.transform_values(F.transform_keys(column, lambda k, _: to_bytes(k, encoding)), lambda _, v: to_bytes(v, encoding))


def squeeze_ends(column: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+\z", "")
