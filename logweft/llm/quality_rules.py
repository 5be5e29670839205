"""Quality rules: a table of thresholds, compiled into one Spark projection without user functions.

A rule bounds the ratio of two counts of a text, in thousandths, so that a verdict is a
comparison of whole numbers. The counts are taken once per text, all rules share them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of this many in a row that occur twice in a text are repeated.
WINDOW = 3

#: Frequent words of the languages judged, in ASCII.
STOP_WORDS = (
    "the of and to in is that was for it with as on at by this are from or an be he a "
    "la le de les et des que pour dans une un en est au du par sur "
    "el los las se del con y "
    "der die das und den von zu mit ist ein eine im dem auf sich"
).split()
#: Marks that may end a stop word, one at most.
STOP_ENDS = ",.;:!?"


@dataclass(frozen=True)
class Rule:
    """``least <= 1000 * part / whole <= most``; a bound of None is none, and a whole of 0 keeps the rule."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def holds(self, counts: Column) -> Column:
        part, whole = counts[self.part] * 1000, counts[self.whole]
        verdict = F.lit(True)
        if self.least is not None:
            verdict = verdict & (part >= whole * self.least)
        if self.most is not None:
            verdict = verdict & (part <= whole * self.most)
        return verdict


#: Decide ``base_failed``.
BASE = (
    Rule("words", "n_words", "one", least=50_000),
    Rule("repeated words", "n_repeat_words", "n_words", most=500),
)
#: Decide the rest of the verdict.
RULES = (
    Rule("word length", "word_chars", "n_words", least=2_500, most=10_000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("stop words", "n_stop_words", "n_words", least=50),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=500),
    Rule("bullets", "n_bullet_lines", "n_lines", most=900),
    Rule("cut lines", "n_cut_lines", "n_lines", most=300),
)


def spellings() -> list[str]:
    """Every form in which a word counts as a stop word: lower, capital or upper case, with a mark or none."""
    forms = {form for word in STOP_WORDS for form in (word, word.capitalize(), word.upper())}
    return sorted(form + end for form in forms for end in ("", *STOP_ENDS))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: as the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words in windows that occur more than once. Windows are told apart by 64-bit hashes.

    Hashes are sorted with their places in their low bits. Windows with a neighbour of the same
    high bits are few in most texts; those are sorted by whole hashes.
    """
    count = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    hashes = F.transform(F.slice(words, 1, count), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    places = F.lit((1 << 31) - 1).cast("long")

    def close(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(-(1 << 31))).bitwiseOR(i.cast("long"))))
        return _let(order, lambda order: F.filter(order, lambda key, k: _beside(order, k, lambda other: other.bitwiseXOR(key).between(0, places))))

    def again(hashes: Column) -> Column:
        windows = F.transform(close(hashes), lambda key: key.bitwiseAND(places).cast("int"))
        order = F.sort_array(F.transform(windows, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i"))))
        same = _let(order, lambda order: F.filter(order, lambda window, k: _beside(order, k, lambda other: other["h"] == window["h"])))
        return F.sort_array(F.transform(same, lambda window: window["i"]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda at, k: F.least(F.coalesce(F.get(places, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    return _let(_let(hashes, again), covered)


def _beside(order: Column, k: Column, holds) -> Column:
    """Whether ``holds`` is true of an element next to number ``k``."""
    return F.coalesce(holds(F.get(order, k + 1)), F.lit(False)) | F.coalesce(holds(F.get(order, k - 1)), F.lit(False))


def _counted(text: Column, words: Column, lines: Column) -> Column:
    counts = {
        "one": F.lit(1),
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_cut_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        "n_stop_words": F.size(F.filter(words, lambda x: x.isin(spellings()))),
        "n_repeat_words": _repeated(words),
    }
    return F.struct(*[value.cast("long").alias(name) for name, value in counts.items()])


def counted(text: Column) -> Column:
    """The counts of a text that rules are made of, as a struct of longs; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(F.struct(words.alias("w"), lines.alias("l")), lambda cut: _counted(text, cut["w"], cut["l"]))


def compiled(text: Column, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE) -> Column:
    """One expression for a text: its counts, ``base_failed``, ``kept`` and ``failed``, the names of rules that fail."""

    def judged(counts: Column) -> Column:
        kept = [rule.holds(counts) for rule in base], [rule.holds(counts) for rule in rules]
        names = [F.when(~holds, F.lit(rule.name)) for rule, holds in zip((*base, *rules), (*kept[0], *kept[1]), strict=True)]
        failed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
        base_failed = F.lit(False)
        for holds in kept[0]:
            base_failed = base_failed | ~holds
        return F.struct(counts.alias("counts"), base_failed.alias("base_failed"), (F.size(failed) == 0).alias("kept"), F.array_join(failed, ", ").alias("failed"))

    return _let(counted(text), judged)


def report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the counts of the whole text, ``base_failed``, ``kept`` and ``failed`` of every row; other columns are dropped.

    A null or blank text has no words, so it fails. Rows that repeat are judged alike, each for
    itself; an empty table gives no rows. Very long texts are judged whole, in the memory of
    about a hundred bytes a word.
    """
    rows = docs.select("doc_id", compiled(F.col("text"), rules).alias("judged"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_lines", "n_bullet_lines", "n_cut_lines", "n_stop_words"]
    verdict = ["base_failed", "kept"]
    return rows.select(
        "doc_id", *[F.col(f"judged.counts.{c}") for c in counts], *[F.col(f"judged.{c}") for c in verdict],
        *[F.col(f"judged.counts.{c}") for c in more], "judged.failed",
    )


def kept(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule fails, with their columns; null and blank texts go."""
    return docs.where(compiled(F.col("text"), rules)["kept"])


def sql() -> str:
    """DuckDB SQL of ``report`` over ``documents``, from the same tables."""
    stop = "|".join(sorted({form for word in STOP_WORDS for form in (word, word.capitalize(), word.upper())}))

    def holds(rule: Rule) -> str:
        bounds = [f"{rule.part} * 1000 >= {rule.whole} * {rule.least}"] if rule.least is not None else []
        bounds += [f"{rule.part} * 1000 <= {rule.whole} * {rule.most}"] if rule.most is not None else []
        return "(" + " AND ".join(bounds or ["true"]) + ")"

    names = ", ".join(f"CASE WHEN NOT {holds(rule)} THEN '{rule.name}' END" for rule in (*BASE, *RULES))
    return rf"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM cut WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r
), counts AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS one, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_cut_lines,
    CAST(len(list_filter(w, lambda x: regexp_full_match(x, '(?:{stop})[{STOP_ENDS}]?'))) AS BIGINT) AS n_stop_words
  FROM cut LEFT JOIN repeated USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  NOT ({" AND ".join(holds(rule) for rule in BASE)}) AS base_failed,
  {" AND ".join(holds(rule) for rule in (*BASE, *RULES))} AS kept,
  n_lines, n_bullet_lines, n_cut_lines, n_stop_words, concat_ws(', ', {names}) AS failed
FROM counts
"""
