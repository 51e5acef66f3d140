"""Text predicates and clean-ups as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgloom.functions import fixed
from msgloom.functions.tokens import let, number, received_date


def nothing() -> Column:
    return F.lit(None).cast("string")


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def unless_blank(text: Column) -> Column:
    return F.when(~blank(text), text)


# --- gates -------------------------------------------------------------------
def has_cue(text: Column) -> Column:
    """any word or number that may point to a schedule; also inside words, in any case."""
    return F.coalesce(text.rlike(f"(?i){fixed.CUES}"), F.lit(False))


def is_completed(text: Column) -> Column:
    """a notice of something already done."""
    return F.coalesce(text.rlike(fixed.COMPLETED), F.lit(False))


def is_payment(text: Column, received: Column) -> Column:
    """payment words, and the first time stamp in the text falls on the received day."""
    part = lambda k: number(text, fixed.PAYMENT_TIME, k)
    dated = (part(1) == F.year(received)) & (part(2) == F.month(received)) & (part(3) == F.dayofmonth(received))
    short = (part(4) == F.month(received)) & (part(5) == F.dayofmonth(received))
    same_day = F.when(part(1).isNotNull(), dated).otherwise(short)
    return F.coalesce(text.rlike(fixed.PAYMENT) & same_day, F.lit(False))


def is_payment_at(text: Column, received_at: Column) -> Column:
    return is_payment(text, received_date(received_at))


def has_surface_cue(message: Column, thread: Column, glue: str = " ") -> Column:
    """a date or time cue in the message or its thread; ``glue`` stands between the two."""
    said = F.concat(F.coalesce(message, F.lit("")), F.lit(glue), thread_text(thread))
    return said.rlike(fixed.SURFACE_CUES)


def thread_text(thread: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(thread, lambda t: F.coalesce(t["message"], F.lit(""))), " "), F.lit(""))


def said_text(message: Column, thread: Column) -> Column:
    """The message, then each turn of its thread after a blank."""
    turns = F.coalesce(F.array_join(F.transform(thread, lambda t: F.concat(F.lit(" "), F.coalesce(t["message"], F.lit("")))), ""), F.lit(""))
    return F.concat(F.coalesce(message, F.lit("")), turns)


def is_yes(text: Column) -> Column:
    """a flag written as true, "true" or "yes"; anything else, null included, is no."""
    return F.coalesce(F.lower(stripped(text)).isin("true", "yes"), F.lit(False))


# --- senders and titles ------------------------------------------------------
def plain_sender(sender: Column) -> Column:
    return stripped(F.replace(F.coalesce(sender, F.lit("")), F.lit(fixed.WEB_MARK), F.lit("")))


def is_machine_sender(sender: Column) -> Column:
    """A mail address, or a number of seven digits or more."""
    s = plain_sender(sender)
    return F.contains(s, F.lit("@")) | F.regexp_replace(s, r"[\s\-+()]", "").rlike(r"^\d{7,}$")


def split_sender(sender: Column) -> Column:
    """Struct of name and affiliation, the first two words of a display name."""
    words = F.split(plain_sender(sender), r"\s+")
    word = lambda k: unless_blank(F.try_element_at(words, F.lit(k)))
    return F.struct(word(1).alias("name"), word(2).alias("affiliation"))


def compose_title(base: Column, sender: Column, organizer: Column | None = None) -> Column:
    """The title with the person or organisation it comes from in brackets, unless it is in the title."""
    organizer = unless_blank(organizer) if organizer is not None else nothing()
    person = F.when(~blank(sender) & ~sender.isin(*fixed.SELF_NAMES) & ~is_machine_sender(sender), split_sender(sender))
    title = stripped(F.coalesce(F.nullif(base, F.lit("")), F.lit(fixed.DEFAULT_TITLE)))
    return let(_tagged_title, title=title, name=person["name"], affiliation=person["affiliation"], organizer=organizer)


def _tagged_title(title: Column, name: Column, affiliation: Column, organizer: Column) -> Column:
    bracket = lambda a, b: F.concat(a, F.lit("("), b, F.lit(")"))
    tag = (
        F.when(name.isNull(), organizer)
        .when(organizer.isNotNull() & ~F.contains(name, organizer), bracket(name, organizer))
        .when(organizer.isNotNull(), organizer)
        .when(affiliation.isNotNull(), bracket(name, affiliation))
        .otherwise(name)
    )
    tagged = lambda tag, title: F.when(tag.isNotNull() & ~F.contains(title, tag), F.concat(title, F.lit(" ["), tag, F.lit("]"))).otherwise(title)
    return let(tagged, tag=tag, title=title)


def drop_personlike_location(location: Column, attendees: Column) -> Column:
    """Null for a place that is part of an attendee's name or the other way round."""
    place = stripped(location)
    name_of = lambda a: stripped(F.coalesce(a, F.lit("")))
    person = F.exists(attendees, lambda a: (name_of(a) != "") & (F.contains(name_of(a), place) | F.contains(place, name_of(a))))
    return F.when(~F.coalesce((F.length(place) >= 2) & person, F.lit(False)), location)


# --- model output ------------------------------------------------------------
def json_block(output: Column) -> Column:
    """The JSON text of a model's answer: after a leading think block, the last code fence or the bare text."""
    text = stripped(output)
    text = stripped(F.regexp_replace(text, r"(?s)^<think>.*?</think>", ""))
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    open_fence = stripped(F.regexp_replace(text, r"^```[^\n]*\n?", ""))
    return F.coalesce(stripped(F.try_element_at(fences, F.lit(-1))), F.when(text.startswith("```"), open_fence).otherwise(text))


def parsed_output(output: Column, schema: str) -> Column:
    """The struct of the answer's JSON object; null where it does not parse."""
    block = json_block(output)
    return F.when(F.try_parse_json(block).isNotNull() & block.startswith("{"), F.from_json(block, schema))


# --- links, rosters, mail ----------------------------------------------------
def links(text: Column) -> Column:
    """Distinct web addresses in order, as structs of label and url."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"""https?://[^\s<>"')\]]+"""), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,!?)\]。]+$", "")))

    def label(url: Column) -> Column:
        low = F.lower(url)
        hosts = lambda keys: reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in keys))
        return reduce(lambda w, row: w.when(hosts(row[0]), row[1]), fixed.LINK_LABELS, F).otherwise(fixed.OTHER_LINK)

    return F.transform(found, lambda u: F.struct(label(u).alias("label"), u.alias("url")))


def with_links(description: Column, message: Column) -> Column:
    """The description followed by the message's links, a line each; null if there is nothing."""
    lines = F.array_join(F.transform(links(message), lambda x: F.concat(x["label"], F.lit(": "), x["url"])), "\n")
    return F.nullif(F.concat_ws("\n", unless_blank(description), F.nullif(lines, F.lit(""))), F.lit(""))


def roster(message: Column) -> Column:
    """Names of a numbered list, distinct, in order, without headings."""
    names = F.regexp_extract_all(message, F.lit(r"\d{1,2}\s*[.)]\s*([가-힣]{2,5}|[A-Za-z][A-Za-z ]{1,14})"), F.lit(1))
    clean = F.transform(names, stripped)
    return F.array_distinct(F.filter(clean, lambda n: (n != "") & ~n.isin(*fixed.ROSTER_STOP)))


def strip_html(html: Column) -> Column:
    """The text of a mail page: no scripts, styles, tags or entities, blanks joined, two line ends at most."""
    text = F.regexp_replace(html, r"(?s)<(script|style).*?</\1>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"&nbsp;|&amp;|&lt;|&gt;|&#\d+;", " ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_from(header: Column) -> Column:
    """The display name of a From header, else its address, else the header."""
    before = F.regexp_replace(stripped(F.substring_index(header, "<", 1)), r'^"+|"+$', "")
    address = stripped(F.substring_index(F.regexp_replace(header, r"(?s)^[^<]*<", ""), ">", 1))
    return F.coalesce(unless_blank(before), unless_blank(address), stripped(header))


def is_personal_name(name: Column) -> Column:
    """A Hangul name of two to four letters or up to three Latin words, and no organisation."""
    n = plain_sender(name)
    shape = n.rlike(r"^[가-힣]{2,4}$") | (n.rlike(r"^[A-Za-z]+(?:\s[A-Za-z]+){0,2}$") & (F.length(n) <= 20))
    return F.coalesce((F.length(n) >= 2) & ~n.rlike(f"(?i){fixed.ORGANISATION}") & shape, F.lit(False))


# --- grounding ---------------------------------------------------------------
def normal(text: Column) -> Column:
    """Without white space, in lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def names_online_tool(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(k)) for k in fixed.ONLINE_TOOLS))


def is_online_tool(place: Column) -> Column:
    """The place names a tool or is part of one's name."""
    return reduce(lambda a, b: a | b, (F.contains(place, F.lit(k)) | F.contains(F.lit(k), place) for k in fixed.ONLINE_TOOLS))


def location_grounded(location: Column, text: Column) -> Column:
    """The place is in the text (both normalised), or both speak of an online tool."""
    place, said = normal(location), normal(text)
    return (place != "") & (F.contains(said, place) | (is_online_tool(place) & names_online_tool(said)))


def is_physical(location: Column) -> Column:
    """A place one can go to: not blank and no online tool."""
    low = F.lower(stripped(location))
    online = reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in fixed.ONLINE_PLACES))
    return F.coalesce((low != "") & ~online, F.lit(False))


def user_block(channel: Column, received_at: Column, sender: Column, message: Column, thread: Column) -> Column:
    """The text a model is asked with; the thread block only if there are turns."""
    from msgloom.functions.tokens import with_weekday

    text = lambda c: F.coalesce(c, F.lit(""))
    line = lambda t: F.concat(F.lit("["), text(t["time"]), F.lit("] "), text(t["sender"]), F.lit(": "), text(t["message"]))
    turns = F.when(F.size(thread) > 0, F.concat(F.lit("<대화내역>\n"), F.array_join(F.transform(thread, line), "\n"), F.lit("\n</대화내역>")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<채널: "), text(channel), F.lit(">")),
        F.concat(F.lit("<수신시각: "), with_weekday(text(received_at)), F.lit(">")),
        F.concat(F.lit("<발신자: "), text(sender), F.lit(">")),
        turns,
        F.concat(F.lit("<메시지>\n"), text(message), F.lit("\n</메시지>")),
    )
