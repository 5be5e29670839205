"""Layout patterns (``%d [%thread] %-5level %logger - %msg%n``) as one regex.

The driver turns a layout into a constant Java regex once per query; executors
only run ``rlike`` and ``regexp_extract`` with it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweft.functions.text import DIGIT, NONSPACE, SPACE, WORD

FIELDS = ("timestamp", "thread", "level", "logger", "message")
SEPARATOR = "\x01"

# The built-in layout, the conversion words and what they match.
DEFAULT_LAYOUT = "%d{yyyy-MM-dd HH:mm:ss.SSS} [%thread] %-5level %logger{36} - %msg%n"
TIMESTAMP = (
    rf"({DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}} "
    rf"{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}(?:[.,]{DIGIT}{{3}})?)"
)
DEFAULT_REGEX = (
    rf"(?d)^{TIMESTAMP}{SPACE}+\[(.*?)\]{SPACE}+({WORD}+){SPACE}+(.*?){SPACE}+-{SPACE}+(.*)$"
)
FIELD_WORDS = {
    "timestamp": ("d", "date"),
    "thread": ("thread", "t"),
    "level": ("level", "le", "p"),
    "logger": ("logger", "lo", "c", "C", "class"),
    "message": ("msg", "message", "m"),
}
FIELD_REGEX = {
    "timestamp": TIMESTAMP,
    "thread": r"(.*?)",
    "level": rf"{SPACE}*({WORD}+){SPACE}*",
    "logger": rf"(.+?{NONSPACE}){SPACE}*",
    "message": r"(.*)",
}
LOGGER_BEFORE_METHOD = rf"(.+{NONSPACE}){SPACE}*"
LOGGER_BEFORE_METHOD_WORDS = ("logger", "lo", "c")
METHOD_WORDS = ("method", "M")
OTHER_WORDS = {
    f"{SPACE}*": ("n",),
    f"{NONSPACE}+": ("file", "method", "M", "pid"),
    f"{DIGIT}+": ("line", "L"),
    r".*?": ("caller", "marker", "mdc", "X", "property"),
    r".*": ("ex", "throwable", "xEx", "wEx", "wex", "rootException", "rEx"),
}
WRAPPER_WORDS = (
    "replace", "highlight", "cyan", "green", "yellow", "blue", "magenta", "red", "white",
    "black", "gray", "grey", "bold", "boldCyan", "boldGreen", "boldYellow", "boldBlue",
    "boldMagenta", "boldRed", "boldWhite",
)

_FIELD_OF = {word: field for field, words in FIELD_WORDS.items() for word in words}
_OTHER_REGEX_OF = {word: regex for regex, words in OTHER_WORDS.items() for word in words}
_CLOSER = {"(": ")", "{": "}"}


class UnsupportedLayoutError(ValueError):
    """The layout uses an unknown conversion word or lacks a field."""


@dataclass(frozen=True)
class Layout:
    """A layout ready for Spark: one Java regex and the group of each field."""

    regex: str
    groups: dict[str, int]

    def matches(self, line: Column) -> Column:
        return _with_newline(line).rlike(self.regex)

    def parse(self, line: Column) -> Column:
        """The fields of a header as an array, from one pass of the regex.

        A line that is no header gives an array of another size. Lines that
        contain the separator themselves take the slower way, group by group.
        """
        text, groups = _with_newline(line), range(1, len(FIELDS) + 1)
        joined = SEPARATOR.join(f"${group}" for group in groups)
        quick = F.split(F.regexp_replace(text, self.regex + "\n?", joined), SEPARATOR)
        slow = F.array(*[F.regexp_extract(text, self.regex, group) for group in groups])
        careful = F.when(text.rlike(self.regex), slow).otherwise(F.array(F.lit("")))
        return F.when(line.contains(SEPARATOR), careful).otherwise(quick)

    def field(self, parsed: Column, name: str) -> Column:
        return F.get(parsed, F.lit(self.groups[name] - 1))

    def fields(self, parsed: Column) -> dict[str, Column]:
        return {name: self.field(parsed, name) for name in FIELDS}


def is_header(parsed: Column) -> Column:
    return F.size(parsed) == len(FIELDS)


def _with_newline(line: Column) -> Column:
    # Blanks required after the last dash may be the end of the line itself.
    return F.concat(line, F.lit("\n"))


def compile_layout(pattern: str | None = None) -> Layout:
    """Turn a layout pattern into a ``Layout``; blank means the built-in one."""
    flat = _unwrap(_use_defaults((pattern or "").strip()))
    if not flat:
        return Layout(DEFAULT_REGEX, {name: i for i, name in enumerate(FIELDS, 1)})

    regex, groups, literal_from = "(?d)^", {}, 0
    tokens = list(_conversions(flat))
    for token, following in zip_longest(tokens, tokens[1:]):
        regex += _literal(flat[literal_from : token.start])
        literal_from, word = token.end, token.word
        field = _FIELD_OF.get(word)
        if field is None:
            if word not in _OTHER_REGEX_OF:
                raise UnsupportedLayoutError(f"unsupported conversion word: %{word}")
            regex += _OTHER_REGEX_OF[word]
            continue
        if field in groups:
            raise UnsupportedLayoutError(f"the layout names the {field} twice")
        groups[field] = len(groups) + 1
        to_method = following and following.word in METHOD_WORDS and flat[token.end : following.start] == "."
        split = to_method and word in LOGGER_BEFORE_METHOD_WORDS
        regex += LOGGER_BEFORE_METHOD if split else FIELD_REGEX[field]
    missing = [name for name in FIELDS if name not in groups]
    if missing:
        raise UnsupportedLayoutError("the layout lacks: " + ", ".join(missing))
    return Layout(regex + _literal(flat[literal_from:]) + "$", groups)


def _literal(text: str) -> str:
    return "".join(f"{SPACE}+" if char.isspace() else re.escape(char) for char in text)


def _closing(text: str, opening: int) -> int:
    """Where the bracket opened at ``opening`` closes, or -1."""
    opener, depth = text[opening], 0
    for at in range(opening, len(text)):
        depth += (text[at] == opener) - (text[at] == _CLOSER[opener])
        if depth == 0:
            return at
    return -1


@dataclass(frozen=True)
class _Conversion:
    """A conversion specifier: ``start`` of its percent sign, end of its ``word``, ``end`` of its options."""

    start: int
    word: str
    word_end: int
    end: int


def _skip(text: str, at: int, allowed: str) -> int:
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def _number(text: str, at: int) -> int:
    """Past an optional minus sign and digits."""
    return _skip(text, at + (text[at : at + 1] == "-"), "0123456789")


def _conversions(text: str):
    """The specifiers in a pattern: percent, minimum, dot and maximum, word, options in braces."""
    at = text.find("%")
    while at >= 0:
        begin = _number(text, at + 1)
        if text[begin : begin + 1] == ".":
            begin = _number(text, begin + 1)
        word_end = begin
        while word_end < len(text) and text[word_end].isascii() and text[word_end].isalpha():
            word_end += 1
        if word_end > begin:
            close = text.find("}", word_end) if text[word_end : word_end + 1] == "{" else -1
            end = close + 1 if close >= 0 else word_end
            yield _Conversion(at, text[begin:word_end], word_end, end)
            at = text.find("%", end)
        else:
            at = text.find("%", at + 1)


def _placeholder(text: str) -> tuple[int, int] | None:
    """Where the first ``${NAME:-`` starts and its default begins."""
    start = text.find("${")
    while start >= 0:
        stop = start + 2
        while stop < len(text) and text[stop] not in "{}:":
            stop += 1
        if stop > start + 2 and text[stop : stop + 2] == ":-":
            return start, stop + 2
        start = text.find("${", start + 1)
    return None


def _use_defaults(text: str) -> str:
    """Put the default in the place of every ``${NAME:-default}``."""
    found = _placeholder(text)
    if found is None:
        return text
    start, begin = found
    end = _closing(text, start + 1)
    if end < 0:
        return text[:begin] + _use_defaults(text[begin:])
    return text[:start] + _use_defaults(text[begin:end]) + _use_defaults(text[end + 1 :])


def _unwrap(text: str) -> str:
    """Keep what colour and replace wrappers enclose, drop the wrappers."""
    for found in _conversions(text):
        opening = found.word_end
        if found.word not in WRAPPER_WORDS or text[opening : opening + 1] != "(":
            continue
        end = _closing(text, opening)
        if end < 0:
            continue
        rest = end + 1
        while text[rest : rest + 1] == "{" and _closing(text, rest) > 0:
            rest = _closing(text, rest) + 1
        inner = _unwrap(text[opening + 1 : end])
        return text[: found.start] + inner + _unwrap(text[rest:])
    return text
