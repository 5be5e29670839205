"""Text rules shared by the operators, as column expressions.

Character classes are spelled out instead of using ``\\s``, ``\\w`` and ``\\d``
so that they mean the same thing in every regex engine, for all scripts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank, word, digit and line break.
# ASCII comes first and the rest sits behind one range test, which keeps matching fast.
_ASCII_BLANK = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20"
_OTHER_BLANK = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = rf"[{_ASCII_BLANK}[\x{{85}}-\x{{3000}}&&[{_OTHER_BLANK}]]]"
NONSPACE = rf"[^{_ASCII_BLANK}[\x{{85}}-\x{{3000}}&&[{_OTHER_BLANK}]]]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# What makes a continuation line the start of a stack trace.
TRACE_START = (
    rf"(?d)^{SPACE}*(?:at .*{NONSPACE}|Caused by:|Suppressed:|\.\.\. .*{NONSPACE}"
    rf"|[A-Za-z_][\p{{L}}\p{{N}}_.$]*(?:Exception|Error)(?::|{SPACE}|$))"
)

REPLACEMENT = "�"
STAND_IN = "﷐"  # a Unicode noncharacter, never part of exchanged text


def strip(text: Column) -> Column:
    """Drop blank characters at both ends (``trim`` drops spaces only)."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"\A{SPACE}*\z")


def first_line(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?s)(?:{LINE_BREAK}).*", "")


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def lenient_utf8(text: Column) -> Column:
    """Drop byte sequences that are not UTF-8, keep everything else.

    A line that really contains U+FFFD keeps it: it is written with a noncharacter while the
    invalid bytes are marked and removed, and so is the noncharacter itself.
    """
    escapes = [(STAND_IN, STAND_IN + "0"), (REPLACEMENT, STAND_IN + "1")]
    clean = text
    for char, escape in escapes:
        clean = F.replace(clean, F.lit(char), F.lit(escape))
    clean = F.replace(F.make_valid_utf8(clean), F.lit(REPLACEMENT), F.lit(""))
    for char, escape in reversed(escapes):
        clean = F.replace(clean, F.lit(escape), F.lit(char))
    return F.when(F.is_valid_utf8(text), text).otherwise(clean)


def starts_trace(line: Column) -> Column:
    return line.rlike(TRACE_START)


def safe_file_part(text: Column) -> Column:
    """A level made usable inside a file name."""
    safe = F.regexp_replace(strip(text), r"[^\p{L}\p{N}_-]", "_")
    return F.when(safe == "", F.lit("UNKNOWN")).otherwise(safe)


def exception_signature(stacktrace: Column, message_body: Column, message: Column) -> Column:
    """The line that names the exception of a group, or the empty string."""

    def names_one(line: Column) -> Column:
        return line.contains("Exception") | line.contains("Error")

    trace_line = strip(
        F.regexp_replace(first_line(strip(stacktrace)), rf"\A{SPACE}*{DIGIT}+:{SPACE}*", "")
    )
    body_lines = F.filter(
        F.transform(split_lines(message_body), strip),
        lambda line: names_one(line) | line.startswith("Caused by:"),
    )
    message_line = F.when(names_one(message), strip(first_line(strip(message))))
    return F.coalesce(
        F.nullif(trace_line, F.lit("")),
        F.get(body_lines, F.lit(0)),
        message_line,
        F.lit(""),
    )
