"""Documents for the tests of the operators."""

import random

#: Names that operators use inside; documents may have columns of the same names.
CLASHES = ["key", "number", "id", "hash", "bands", "root", "size", "target", "bucket", "ghost", "own", "place", "found",
           "ranges", "score", "lang_pred", "taken", "position", "again", "digest", "held_out", "copies", "label",
           "__key", "__id", "__text", "__n", "__ranges", "__found", "__lang", "__score"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def words(seed: int, count: int, kinds: int = 400) -> str:
    chosen = random.Random(seed)
    return " ".join(f"w{chosen.randrange(kinds):x}" for _ in range(count))


def frame(spark, rows):
    """(doc_id, text, lang, source) as documents with clashing further columns."""
    full = [(i, t, lang, source, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)
