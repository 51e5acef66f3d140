"""Masks and pseudonyms.

Which names a record holds and where new texts go are Column expressions; one Arrow-batched
pass gives the pseudonyms and swaps names and personal data in all of a record's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from msgloom.functions import fixed
from msgloom.functions.text import is_personal_name, plain_sender

_MASKS = {kind: mask for kind, _, mask in fixed.PERSONAL_DATA}
_KINDS = {kind: pattern for kind, pattern, _ in fixed.PERSONAL_DATA}
#: All kinds but e-mail, whose pattern read from left to right is quadratic on long runs of letters.
_DATA = "|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _KINDS.items() if kind != "email")
_BEFORE_EMAIL = [*_KINDS][: [*_KINDS].index("email")]
_LOCAL, _DOMAIN = (re.compile(p) for p in (_KINDS["email"].split("@")[0], "@" + _KINDS["email"].split("@")[1]))
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_POOLS = {"hangul": fixed.NAMES_HANGUL, "latin": fixed.NAMES_LATIN}


class Swap:
    """Replaces names and personal data in texts, in one pass from left to right, so that nothing is replaced twice.

    Of kinds of data that begin at one place the first in order wins, and data wins over a
    name unless it is one; of names the longest.
    """

    def __init__(self, given: dict[str, str] | None = None, protect_dates: bool = False) -> None:
        self.given, self.protect_dates = given or {}, protect_dates
        names = "|".join(map(re.escape, sorted(self.given, key=len, reverse=True)))
        self.pattern = compiled(f"{_DATA}|{names}" if names else _DATA)

    def one(self, m: re.Match) -> str:
        found = m.group()
        if found in self.given:
            return self.given[found]
        if self.protect_dates and m.lastgroup == "account" and _DATE.fullmatch(found):
            return found
        return _MASKS[m.lastgroup]

    def __call__(self, text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        emails = addresses(text) if "@" in text else iter(())
        mail, other = next(emails, None), self.pattern.search(text)
        while True:
            while mail and mail[1] <= at:  # nothing is left before its @
                mail = next(emails, None)
            if other and other.start() < at:
                other = self.pattern.search(text, at)
            start = max(mail[0], at) if mail else len(text)
            if other and (other.start() < start or other.start() == start and other.lastgroup in _BEFORE_EMAIL):
                out += [text[at : other.start()], self.one(other)]
                at = other.end()
            elif mail:
                found = text[start : mail[2]]
                out += [text[at:start], self.given.get(found, _MASKS["email"])]
                at = mail[2]
            else:
                return "".join([*out, text[at:]])


def addresses(text: str) -> Iterator[tuple[int, int, int]]:
    """Start, place of the @ and end of each e-mail address; it may begin anywhere before its @."""
    for run in _LOCAL.finditer(text):
        domain = _DOMAIN.match(text, run.end())
        if domain:
            yield run.start(), run.end(), domain.end()


@cache
def _data_pattern() -> re.Pattern:
    return re.compile(_DATA)


def compiled(pattern: str) -> re.Pattern:
    return _data_pattern() if pattern is _DATA else re.compile(pattern)


def masked(text: str, protect_dates: bool = False) -> str:
    return Swap(protect_dates=protect_dates)(text)


def mask_personal_data(text: Column, protect_dates: bool = False) -> Column:
    """Addresses, ids and numbers replaced by masks. ISO dates count as account numbers unless protected."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(Swap(protect_dates=protect_dates), na_action="ignore")

    return run(text)


def pseudonyms(names: list[str]) -> dict[str, str]:
    """A pseudonym for each name of a record: the pool's at the name's hash or the next that is free, else a numbered one; longest names choose first."""
    given: dict[str, str] = {}
    taken: set[str] = set()
    for name in sorted(dict.fromkeys(names), key=len, reverse=True):
        script = "hangul" if any("가" <= c <= "힣" for c in name) else "latin"
        pool = _POOLS[script]
        at = int.from_bytes(hashlib.md5(name.encode()).digest(), "big") % len(pool)
        round_trip = (pool[(at + k) % len(pool)] for k in range(len(pool)))
        given[name] = next((p for p in round_trip if p not in taken), f"{fixed.SPARE_NAMES[script]}{len(taken) + 1}")
        taken.add(given[name])
    return given


def first_pseudonym(name: Column) -> Column:
    """D25 in Column form, for a name that meets no other: md5 modulo the pool, folded from its 32-bit parts."""
    def pick(pool: tuple[str, ...]) -> Column:
        n = len(pool)
        rest = F.lit(0).cast("long")
        for k in range(4):
            part = F.conv(F.substring(F.md5(name.cast("binary")), 1 + 8 * k, 8), 16, 10).cast("long")
            rest = (rest * ((1 << 32) % n) + part) % n
        return F.element_at(F.array(*map(F.lit, pool)), (rest + 1).cast("int"))

    return F.when(name.rlike("[가-힣]"), pick(fixed.NAMES_HANGUL)).otherwise(pick(fixed.NAMES_LATIN))


_TEXTS = ArrayType(StringType())


@F.pandas_udf(StructType([StructField("given", _TEXTS), StructField("texts", _TEXTS)]))
def _renamed(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
    given = [pseudonyms(list(n)) for n in names]
    swapped = [list(map(Swap(g), t)) for g, t in zip(given, texts, strict=True)]
    return pd.DataFrame({"given": [[g[n] for n in own] for g, own in zip(given, names, strict=True)], "texts": swapped})


def anonymize(df: DataFrame) -> DataFrame:
    """Records (sender, message, thread_context, events) with the same pseudonym for a name throughout each.

    Names are the events' attendees and organisers and those senders that are persons; they
    are swapped in messages, titles, places and descriptions as well. Dates, times and
    recurrence are never touched; what is null stays null.
    """
    several = lambda values: F.coalesce(values, F.array().cast("array<string>"))
    guests = F.flatten(F.transform("events", lambda e: F.concat(several(e["attendees"]), F.array(e["organizer"]))))
    writers = F.concat(F.array("sender"), several(F.transform("thread_context", lambda t: t["sender"])))
    people = F.transform(F.filter(writers, is_personal_name), plain_sender)
    names = F.array_distinct(F.filter(F.concat(several(guests), people), lambda n: F.length(n) > 0))
    turns = several(F.transform("thread_context", lambda t: t["message"]))
    fields = ("title", "location", "description")
    said = several(F.flatten(F.transform("events", lambda e: F.array(*(e[f] for f in fields)))))
    rows = df.withColumns({"_names": names, "_turns": F.size(turns), "_texts": F.concat(F.array("message"), turns, said)})
    rows = rows.withColumn("_new", _renamed("_names", "_texts")).withColumn("_given", F.map_from_arrays("_names", "_new.given"))

    def known(name: Column) -> Column:
        return F.coalesce(F.try_element_at("_given", name), name)

    def text(at: Column) -> Column:
        return F.get("_new.texts", at)

    def turn(t: Column, k: Column) -> Column:
        sender = F.when(is_personal_name(t["sender"]), known(plain_sender(t["sender"]))).otherwise(t["sender"])
        return t.withField("message", text(k + 1)).withField("sender", sender)

    def event(e: Column, k: Column) -> Column:
        e = e.withField("organizer", known(e["organizer"])).withField("attendees", F.transform(e["attendees"], known))
        for n, f in enumerate(fields):
            e = e.withField(f, text(F.col("_turns") + 1 + len(fields) * k + n))
        return e

    person = plain_sender(F.col("sender"))
    new = {
        "sender": F.when(is_personal_name(F.col("sender")), F.replace("sender", person, known(person))).otherwise(F.col("sender")),
        "message": text(F.lit(0)),
        "thread_context": F.transform("thread_context", turn),
        "events": F.transform("events", event),
    }
    return rows.withColumns(new).select(*df.columns)
