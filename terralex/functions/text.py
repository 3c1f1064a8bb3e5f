"""Column functions on text: normalisation, counting, dates, identity. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
#: Month names by language, in English.
MONTHS = {
    "januari": "January", "februari": "February", "maart": "March", "april": "April", "mei": "May", "juni": "June",
    "juli": "July", "augustus": "August", "september": "September", "oktober": "October", "november": "November", "december": "December",
    "januar": "January", "februar": "February", "märz": "March", "mai": "May", "august": "August", "dezember": "December",
    "gennaio": "January", "febbraio": "February", "marzo": "March", "aprile": "April", "maggio": "May", "giugno": "June",
    "luglio": "July", "agosto": "August", "settembre": "September", "ottobre": "October", "novembre": "November", "dicembre": "December",
}
WEEKDAYS = ["maandag", "dinsdag", "woensdag", "donderdag", "vrijdag", "zaterdag", "zondag", "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag", "lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato", "domenica"]
DATE_FORMATS = ["d MMMM yyyy", "MMMM d yyyy", "d MMM yyyy", "d-M-yyyy", "d/M/yyyy", "yyyy-MM-dd"]
#: A word's edge for any script, alike in Java and in RE2.
EDGE_LEFT, EDGE_RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normal_text(c: Column) -> Column:
    """No BOM, plain spaces and line feeds, single blanks, at most one empty line, trimmed."""
    c = F.regexp_replace(or_empty(c), "﻿", "")
    c = F.regexp_replace(F.regexp_replace(c, " ", " "), "\r\n|\r| | ", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(or_empty(c), r"^\s+|\s+$", "")


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), *ACCENTS)


def normal_key(c: Column) -> Column:
    """A name's key: lower case, no accents, one kind of apostrophe, blanks for - and _, no other punctuation."""
    c = folded(F.trim(or_empty(c)))
    c = F.regexp_replace(F.translate(c, "’-_", "'  "), r"\s+", " ")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s.'()]", ""))


def blank_words(c: Column) -> Column:
    """Words between white space."""
    t = F.regexp_replace(or_empty(c), r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def letter_words(c: Column) -> Column:
    """Words of letters and digits, with inner hyphens and apostrophes."""
    return F.regexp_count(or_empty(c), F.lit(r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"))


def any_word(words: list[str], longest_first: bool = False) -> str | None:
    """A pattern of any of the given words as whole words; None without any. File order decides unless longest first."""
    words = [w for w in dict.fromkeys(x.strip().lower() for x in words) if w]
    if longest_first:
        words.sort(key=lambda w: (-len(w), w))
    quoted = ["".join("\\" + ch if not (ch.isalnum() or ch in " _") else ch for ch in w) for w in words]
    return f"{EDGE_LEFT}({'|'.join(quoted)}){EDGE_RIGHT}" if words else None


def has_any(c: Column, words: list[str]) -> Column:
    p = any_word(words, longest_first=True)
    return F.lower(or_empty(c)).rlike(p) if p else F.lit(False)


def pattern_hits(c: Column, patterns: list[str]) -> Column:
    """Non-overlapping matches of any pattern, without regard to case."""
    return F.regexp_count(or_empty(c), F.lit("(?iU)" + "|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(0)


def english_date(c: Column) -> Column:
    """Dates' month names in English, weekdays and commas gone, `5. ` as `5 `."""
    for name, english in MONTHS.items():
        c = F.regexp_replace(c, rf"(?iu)\b{name}\b", english)
    c = F.regexp_replace(c, rf"(?iu)\b(?:{'|'.join(WEEKDAYS)})\b", "")
    c = F.regexp_replace(F.regexp_replace(c, ",", " "), r"(\d)\.\s", "$1 ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def parsed_date(c: Column) -> Column:
    """Day first; null if no format fits."""
    c = english_date(or_empty(c))
    return F.coalesce(*(F.try_to_date(c, f) for f in DATE_FORMATS))


def without_artifacts(c: Column) -> Column:
    """What extraction leaves gone: numbered dashes that begin a line, page marks, all but the last of consecutive numbers, long hexes, escapes of RTF; lines trimmed."""
    c = or_empty(c)
    for p in (r"(?m)^\s*-\d+\s*", r"(?i)\b-?\d+\s+Page of\s+-?\d+\b", r"\b-?\d+\b(?=\s+-?\d+\b)", r"\b[0-9A-Fa-f]{32,}\b", r"\\'[0-9a-fA-F]{2}", r"\\\*"):
        c = F.regexp_replace(c, p, " ")
    c = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), "\n")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def looks_corrupt(title: Column, newspaper: Column, body: Column) -> Column:
    t = or_empty(title)
    hexes = F.regexp_count(F.concat_ws(" ", t, or_empty(body)), F.lit(r"\b[0-9A-Fa-f]{16,}\b"))
    return (F.trim(t) == "") | (F.trim(or_empty(newspaper)) == "") | t.startswith("Times New Roman") | t.contains("Page of") | (hexes > 2)


def uid(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("||", *(or_empty(p) for p in parts)), 256)


def listed(c: Column, sep: str = ";") -> Column:
    """Items of a joined list: trimmed, empty ones gone, first of equals kept."""
    return F.array_distinct(F.filter(F.transform(F.split(or_empty(c), sep), lambda x: F.trim(x)), lambda x: x != ""))


def joined_reasons(*reasons: Column) -> Column:
    parts = F.array_distinct(F.filter(F.flatten(F.array(*(F.split(or_empty(r), r"\|") for r in reasons))), lambda x: x != ""))
    return F.when(F.size(parts) == 0, F.lit("unknown")).otherwise(F.array_join(parts, "|"))


def sentence_list(c: Column) -> Column:
    """Sentences end in . ! or ? before white space and a capital letter."""
    marked = F.regexp_replace(F.trim(or_empty(c)), r"([.!?])\s+([A-ZÀ-ÖØ-Ý])", "$1\u0001$2")
    return F.filter(F.split(marked, "\u0001"), lambda x: F.trim(x) != "")


#: Abbreviations after which no sentence ends.
ABBREVIATIONS = ["dhr", "dr", "prof", "mr", "mevr", "mw", "ir", "ing", "st", "nr", "ca", "vgl", "bijv", "etc", "z.B", "bzw", "bspw", "d.h", "u.a", "e.g", "i.e", "vs"]


def guarded_sentence_list(c: Column) -> Column:
    """As sentence_list, but abbreviations don't end a sentence, digits may begin one, and quotes or brackets that close one go with the white space."""
    text = stripped(c)
    for a in (a for a in ABBREVIATIONS if "." in a):
        first, last = a.split(".")
        text = F.regexp_replace(text, rf"(?iU)\b({first})\.({last})\.", "$1\u0002$2\u0002")
    text = F.regexp_replace(text, rf"(?iU)\b({'|'.join(a for a in ABBREVIATIONS if '.' not in a)})\.", "$1\u0002")
    parts = F.split(text, "(?<=[.!?])(?:[\"')\\]]+)?\\s+(?=[A-ZÀ-ÖØ-Ý0-9])")
    return F.filter(F.transform(parts, lambda x: F.trim(F.translate(x, "\u0002", "."))), lambda x: x != "")


def slug(c: Column) -> Column:
    """A name for files: runs of anything but letters, digits and _ as one hyphen."""
    return F.trim(F.regexp_replace(F.lower(F.trim(or_empty(c))), r"[^\p{L}\p{N}_]+", "-"), F.lit("-"))


def cut_off(c: Column, most: int) -> Column:
    """At most so many characters, an ellipsis as the last if any are missing."""
    t = or_empty(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def truthy(c: Column) -> Column:
    return F.lower(F.trim(or_empty(c))).isin("1", "true", "yes", "y", "t")


def preview(c: Column, most: int = 1200) -> Column:
    """One line of at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(or_empty(c), r"\s+", " ")), 1, most)
