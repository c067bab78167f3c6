"""String functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import constants as K

_NOT_ALNUM = r"[^\p{L}\p{N}]"


def normalize_name(name: Column) -> Column:
    """Lower-cased, every character that is no letter or digit a space."""
    return F.regexp_replace(F.lower(name), _NOT_ALNUM, " ")


def bytes_of(s: Column) -> Column:
    return F.octet_length(s)


def filename_tier(name: Column, query: str) -> Column:
    """Base score of a name that begins with or holds the query, as it stands or normalised; null without a match."""
    low, q = F.lower(name), query.lower()
    norm = normalize_name(name)
    nq = "".join(c if c.isalnum() else " " for c in q)
    return (
        F.when(low.startswith(q), K.PREFIX).when(low.contains(q), K.CONTAINS).when(norm.startswith(nq), K.PREFIX).when(norm.contains(nq), K.CONTAINS)
    )


def stem(name: Column) -> Column:
    """What precedes the last dot; the whole name if there is none."""
    return F.regexp_replace(name, r"(?s)\.[^.]*\z", "")


def typo_match(name: Column, query: str) -> Column:
    """Whether a word of the name's stem is within a small, non-zero edit distance of the query."""
    q = query.lower()
    n = len(q.encode())
    most = 1 if n <= 6 else 2
    words = F.filter(F.split(F.lower(stem(name)), _NOT_ALNUM), lambda w: F.abs(F.octet_length(w) - n) <= 1)
    return F.exists(words, lambda w: F.levenshtein(w, F.lit(q)).between(1, most))


def escape_query(q: Column) -> Column:
    """A backslash before each character of the query syntax."""
    return F.regexp_replace(q, "([" + "".join("\\" + c for c in K.SYNTAX) + "])", r"\\$1")


def strip_tags(x: Column) -> Column:
    """Without ``<...>``; an unclosed ``<`` swallows the rest, a lone ``>`` goes."""
    return F.replace(F.regexp_replace(x, r"(?s)<[^>]*(>|\z)", ""), F.lit(">"), F.lit(""))


def strip_code(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)`[^`]*(`|\z)", "")


def strip_links(x: Column) -> Column:
    return F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1")


def first_line(x: Column) -> Column:
    """First line with more than 3 bytes, trimmed and without leading #; empty if there is none."""
    lines = F.transform(F.split(x, r"\r?\n"), lambda s: F.trim(F.regexp_replace(F.trim(s), "^#+", "")))
    return F.coalesce(F.try_element_at(F.filter(lines, lambda s: F.octet_length(s) > 3), F.lit(1)), F.lit(""))


def truncate(x: Column, most: int) -> Column:
    """At most ``most`` bytes of UTF-8, cut between characters."""
    # each leading character counts its bytes; those past the limit go
    head = F.substring(x, 1, most)
    ends = F.aggregate(F.split(head, ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), lambda a, c: F.when(a["b"] + F.octet_length(c) <= most, F.struct((a["n"] + F.length(c)).alias("n"), (a["b"] + F.octet_length(c)).alias("b"))).otherwise(F.struct(a["n"].alias("n"), F.lit(most + 1).alias("b"))))
    return F.when(F.octet_length(x) <= most, x).when(F.octet_length(head) == F.length(head), head).otherwise(head.substr(F.lit(1), ends["n"]))


def collapse_ws(x: Column, most: int = K.DOC_CHARS) -> Column:
    return F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, most)


def redact_home(x: Column, home: str) -> Column:
    return F.replace(x, F.lit(home), F.lit("~"))


def exif_text(exif: Column) -> Column:
    """``[Date: d] [Location: x]`` of what is there."""
    return F.concat_ws(
        " ",
        F.when(exif["date_taken"].isNotNull(), F.concat(F.lit("[Date: "), F.substring_index(exif["date_taken"], "T", 1), F.lit("]"))),
        F.when(exif["gps"].isNotNull(), F.concat(F.lit("[Location: "), exif["gps"], F.lit("]"))),
    )


def tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits of at most 40 bytes."""
    return F.filter(F.split(F.lower(x), _NOT_ALNUM + "+"), lambda w: (w != "") & (F.octet_length(w) <= 40))


def readable(x: Column) -> Column:
    """Whether a text looks like text: readable characters, enough words of usual length, no raw PDF."""
    t = F.regexp_replace(x, r"\A\s+|\s+\z", "")
    sample = F.substring(t, 1, 2000)
    kept = F.length(F.regexp_replace(sample, r"[^\p{L}\p{N}\s!-/:-@\[-`{-~]", ""))
    words = F.filter(F.split(sample, r"\s+"), lambda w: F.octet_length(w).between(2, 30))
    mean = F.aggregate(words, F.lit(0), lambda a, w: a + F.octet_length(w)) / F.greatest(F.size(words), F.lit(1))
    marks = sum((F.size(F.split(sample, "\\Q" + m + "\\E", -1)) - 1 for m in K.PDF_MARKERS), F.lit(0))
    good = (kept / F.greatest(F.octet_length(sample), F.lit(1)) >= 0.7) & (F.size(words) >= 5) & mean.between(2.0, 15.0) & (marks <= 5)
    return F.coalesce((t != "") & ~t.startswith("%PDF") & good, F.lit(False))


def snippet(x: Column, query: str, most: int = 200) -> Column:
    """The line of the first match (or 80 characters before it and 160 from it on), in dots if longer; else the first line."""
    pos = F.locate(query.lower(), F.lower(x))
    before, after = x.substr(F.lit(1), pos - 1), x.substr(pos, F.length(x))
    start = F.when(F.locate("\n", before) > 0, F.substring_index(before, "\n", -1)).otherwise(F.right(before, F.lit(80)))
    end = F.when(F.locate("\n", after) > 0, F.substring_index(after, "\n", 1)).otherwise(after.substr(1, 160))
    hit = F.trim(F.concat(start, end))
    line = F.regexp_replace(F.substring_index(x, "\n", 1), r"\r\z", "")
    dots = F.lit("...")
    return F.when(pos > 0, F.when(F.octet_length(hit) > most, F.concat(dots, truncate(hit, most), dots)).otherwise(hit)).when(x != "", F.when(F.octet_length(line) > most, F.concat(truncate(line, most), dots)).otherwise(line))


# fixed values: what a fenced block is, which lines are rules or table rows, and the marks before a list item
MD_FENCED = r"(?m)^[ \t]*```[^\n]*\n?(?s:.*?)(?:^[ \t]*```[^\n]*$|\z)"
MD_DROPPED = r"^(\|--|\| --|---|===)|^\|(.*\|)?$"
MD_MARKS = r"^(- )*(\* )*(\+ )*"


def strip_md(x: Column) -> Column:
    """Text of markdown: no fences, rules, tables, heading, emphasis, code, link and list marks; lines joined by a space."""
    ends = r"^\s+|\s+$"
    lines = F.transform(F.split(F.regexp_replace(x, MD_FENCED, ""), r"\r?\n"), lambda s: F.regexp_replace(s, ends, ""))
    text = F.filter(lines, lambda s: ~s.rlike(MD_DROPPED))
    heads = F.transform(text, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^#+", ""), ends, ""), r"\*\*|__", ""))
    plain = F.transform(heads, lambda s: F.regexp_replace(strip_links(strip_code(s)), MD_MARKS, ""))
    return F.array_join(F.filter(plain, lambda s: s != ""), " ")


def embed_text(name: Column, text: Column, ext: Column) -> Column:
    """What is embedded of a file, by its extension; null for other kinds."""
    head = F.concat(F.lit("File: "), name, F.lit("\n\n"))
    code = "rs ts tsx js jsx py go rb java c cpp h swift".split()
    return (
        F.when(ext.isin("md", "txt"), F.concat(F.lit("File: "), name, F.lit("\n"), first_line(text), F.lit("\n\n"), truncate(strip_md(text), 800)))
        .when(ext.isin("pdf", "docx", "xlsx"), F.concat(head, truncate(text, 800)))
        .when(ext.isin(code), F.concat(head, truncate(text, 200)))
        .when(ext == "csv", F.concat(head, truncate(text, 400)))
        .when(ext.isin("html", "htm"), F.concat(head, truncate(strip_tags(text), 800)))
    )


def csv_preview(x: Column, rows: int = 20, columns: int = 5, width: int = 20) -> Column:
    """The first lines of comma-separated text as a markdown table."""
    lines = F.filter(F.split(x, r"\r?\n"), lambda s: F.trim(s) != "")
    cells = F.transform(F.slice(lines, 1, rows), lambda s: F.transform(F.slice(F.split(s, ","), 1, columns), lambda c: F.substring(F.trim(c), 1, width)))
    table = F.transform(cells, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.try_element_at(cells, F.lit(1)))))
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.slice(table, 1, 1), F.array(rule), F.slice(table, 2, rows)), "\n"))
