"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, URL
schemes, cue words of accounts, and digits. From an anchor a parser of that kind
expands to both sides and validates what it finds: e-mail addresses, web
addresses, IP addresses, phone numbers, card numbers (Luhn), IBANs (mod 97), US
social security numbers, and account numbers after a cue word. A cue ends its word,
but for a plural or a word for number (``_CUE_END``). It holds to the end of its
clause (at the end of a longer word, for 24 characters) or to the first number that
it is for; such a number has 6 to 34 digits and capitals, two digits at least. What
a parser has taken isn't parsed again.

Defined results
---------------
* One row per finding: doc_id, kind, start, end (character offsets, end
  exclusive), value. Findings of a text don't overlap; a longer reading from an
  earlier anchor wins.
* An e-mail address of more than 64 characters before its at-sign, or more than 254
  in all after them, is none; no part of it is reported.
* Null and empty texts give none. A document without an id gives rows with a null
  id; repeated rows give repeated findings. Other columns are ignored.
* Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import read_table

CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "passeport", "reisepass", "ssn", "routing", "policy no", "customer no", "kundennummer")
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_%+])?\Z")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_URL = re.compile(r"://[^\s<>\"'`{}|\\^\[\]]+")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\w]|\.\d)")
_SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})(?![\w-])")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}(?![\w])")
_PHONE = re.compile(r"\+?\(?\d{1,4}\)?(?:[ .-]{0,2}\(?\d{2,5}\)?){1,5}(?!\w)")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"\d(?:[ -]?[\dA-Z]){5,33}(?!\w)")
#: An account number that begins with letters; groups after the first have a digit.
_LETTERED = re.compile(r"[A-Z]+(?:-(?=\d))?[\dA-Z]+(?:[ -](?=[A-Z]*\d)[\dA-Z]+(?!\w))*(?!\w)")
_DATE = re.compile(r"(?:\d{4}[-.]\d\d[-.]\d\d|\d\d[-.]\d\d[-.]\d{4})(?!\d)")
#: Where a clause ends; after short forms a full stop doesn't end it.
_CLAUSE_END = re.compile(r"[;!?\n]|(?<!\b[Nn]o)(?<!\b[Nn]r)(?<!\b[Nn]um)(?<!\b[Aa]cct)(?<!\b[Rr]ef)(?<!\b[Tt]el)\.(?=\s|\Z)")
_CUE_END = re.compile(r"(?:s|nummer|number|num|no|nr|id)?(?![^\W\d_])", re.I)
#: A number so close to a cue belongs to it, whatever is between.
NEAR = 24
#: What numbers other than accounts a cue may stand for; one of these or an account uses it up.
_MEANT = {"ssn": "ssn", "iban": "iban", "account": "iban", "acct": "iban", "konto": "iban", "compte": "iban", "cuenta": "iban"}
#: Social security numbers that none is given, and dates: no phone numbers.
_OTHER = re.compile(r"(?:\d{3}-\d\d-\d{4}|\d{4}[-.]\d\d[-.]\d\d|\d\d[-.]\d\d[-.]\d{4})(?!\d)")
_WORD = re.compile(r"\w+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+'-")


def automaton():
    """The anchors; the value is their kind and length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for cue in CUES:
        for form in {cue, cue.title(), cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def heads(found: str) -> list[str]:
    """``found`` and what is left of it without its last groups of digits."""
    out = []
    while found:
        out.append(found)
        found = found[: max(found.rfind(c) for c in " .-(") + 1].rstrip(" .-(")
        if found.endswith(")") and found.count(")") > found.count("("):  # it closes what is around the number
            found = found[:-1]
    return out


def phone(found: str) -> bool:
    """Groups of digits that a phone number can have: 11 after +1, 8 to 15 after another sign, else 9 to 13 in three groups at least."""
    n, signed = sum(c.isdigit() for c in found), found[0] == "+"
    if found.count("(") != found.count(")"):
        return False
    if signed:
        return n == 11 if re.match(r"\+1\b", found) else 8 <= n <= 15
    return 9 <= n <= 13 and len(re.findall(r"\d+", found)) >= 3 and not _OTHER.match(found)


def email_at(text: str, at: int) -> tuple[int, int] | None:
    """The e-mail address whose at-sign is at ``at``."""
    start = at
    while start and text[start - 1] in _LOCAL_CHARS:
        start -= 1
    double = text.rfind("..", start, at)
    if double >= 0:
        start = double + 2
    while start < at and not text[start].isalnum():
        start += 1
    if at - start > 64:
        return None
    m = _DOMAIN.match(text, at + 1)
    if not m or not _LOCAL.match(text[start:at]) or m.end() - at > 254:
        return None
    return start, m.end()


def url_at(text: str, at: int) -> tuple[int, int] | None:
    """The web address whose ``://`` is at ``at``."""
    start = at
    while start and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    m = _URL.match(text, at) if start < at else None
    if not m:
        return None
    end = m.end()
    while text[end - 1] in ".,;:!?)*":
        end -= 1
    return (start, end) if end > at + 3 and text[at + 3].isalnum() else None


def account_at(text: str, at: int, least: int) -> tuple[str, int, int] | None:
    """The account number, from ``least`` on, whose first digit is at ``at``."""
    start = at
    while start > least and text[start - 1].isascii() and text[start - 1].isupper():
        start -= 1
    if start == at and at - 1 > least and text[at - 1] == "-" and text[at - 2].isascii() and text[at - 2].isupper():
        start -= 1
        while start > least and text[start - 1].isascii() and text[start - 1].isupper():
            start -= 1
    if start > least and (text[start - 1].isalnum() or text[start - 1] == "_"):
        return None
    if start == at:
        m = None if _DATE.match(text, at) else _ACCOUNT.match(text, at)
    else:
        m = _LETTERED.match(text, start)
        size = sum(c.isalnum() for c in m.group()) if m else 0
        if not 6 <= size <= 34 or sum(c.isdigit() for c in m.group()) < 2:
            m = None
    return ("account", start, m.end()) if m else None


def number_at(text: str, at: int, done: int, cued: int | None) -> tuple[str, int, int] | None:
    """Kind and place of a number whose first digit is at ``at``; cued: the end of the cue it follows, if any."""
    before = text[at - 1] if at else " "
    if before.isalnum() or before == "_":
        head = text[max(0, at - 2) : at]
        outer = text[at - 3] if at > 2 else " "
        if len(head) == 2 and head.isascii() and head.isupper() and not outer.isalnum() and at - 2 >= done:
            m = _IBAN.match(text, at - 2)
            while m and not iban(m.group()):  # a word in capitals may follow
                cut = m.group().rstrip().rfind(" ")
                m = _IBAN.match(text, at - 2, at - 2 + cut) if cut > 14 else None
            if m:
                return "iban", m.start(), m.end()
        return None if cued is None else account_at(text, at, max(done, cued))
    m = _IP.match(text, at)
    if m and before != "." and all(int(x) < 256 for x in m.groups()):
        return "ip", at, m.end()
    m = _SSN.match(text, at)
    if m and before != "-" and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
        return "ssn", at, m.end()
    m = _CARD.match(text, at)
    for part in reversed(heads(m.group())) if m else ():  # other numbers may follow
        digits = re.sub(r"\D", "", part)
        if len(digits) >= 13 and luhn(digits):
            return "card", at, at + len(part)
    start = at
    if start > done and text[start - 1] == "(":
        start -= 1
    if start > done and text[start - 1] == "+":
        start -= 1
    m = _PHONE.match(text, start)
    for part in heads(m.group()) if m else ():
        if phone(part):
            return "phone", start, start + len(part)
    return None if cued is None else account_at(text, at, max(done, cued))


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything found in a text, in order."""
    out: list[tuple[str, int, int]] = []
    done, passed, clause = 0, -1, -1
    cue, reach, meant = 0, -1, None  # where the last cue ends, how far it holds, the kind it may stand for
    for last, (kind, size) in anchors.iter(text):
        first = last - size + 1
        if first < done:
            continue
        if kind == "cue":
            if not _CUE_END.match(text, last + 1):
                continue
            cue, reach, meant = last + 1, last + 1 + NEAR, _MEANT.get(text[first : last + 1].lower())
            if not (first and text[first - 1].isalnum()):
                if clause < cue:
                    m = _CLAUSE_END.search(text, cue)
                    clause = m.start() if m else len(text)
                reach = max(reach, clause)
        elif kind == "digit":
            if first <= passed:
                continue
            got = number_at(text, first, done, cue if first <= reach else None)
            if got:
                out.append(got)
                done = got[2]
                if got[0] in ("account", meant):
                    reach = -1  # a cue is for one number
            else:
                passed = _WORD.match(text, first).end() - 1
        else:
            got = (email_at if kind == "at" else url_at)(text, first)
            if got and got[0] >= done:
                out.append(("email" if kind == "at" else "url", *got))
                done = got[1]
    return out


def findings(docs: DataFrame) -> DataFrame:
    """All findings in ``docs``; nothing is exchanged."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for b in batches:
            out = [(id_, kind, start, end, text[start:end]) for id_, text in zip(b["doc_id"], b["text"]) if text for kind, start, end in find(text, anchors)]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "start", "end", "value"]).astype({"doc_id": object, "start": "int64", "end": "int64"})

    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").filter("text IS NOT NULL AND text <> ''")
    made = source.mapInPandas(apply, "doc_id string, kind string, start long, end long, value string")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(read_table(spark, sf_dir, "documents"))
