"""Quality rules: a table of thresholds compiled into one native projection.

Every feature is a built-in column expression over the whole text; no Python runs on the executors
and no row leaves its partition, so the job is one scan without a shuffle at any size.

Defined results: a null or blank text has no words, fails the base rule and is not kept. A text of any
length is judged whole. Repeated rows are judged alone and stay repeated. Columns of the input that
share a feature's name are replaced by the feature; all others come back as they were. An empty table gives an
empty one. The rule on stop words knows English, German, French and Spanish: a text of its length or more in another
language fails it and is not kept, so such corpora need their own list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A word with a letter; a line that begins with a bullet; a line that ends with an ellipsis. Both engines read these alike.
LETTER, BULLET, ELLIPSIS = r"\p{L}", r"^[*\-\x{2022}\x{2023}\x{25cf}\x{25aa}]", r"(\.\.\.|\x{2026})$"
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with as by at from this are be or not he she they "
    "der die das und ist in von zu den mit nicht auf ein eine im dem des sich als auch es an "
    "le la les de des du et est un une que qui dans pour pas sur au en il elle se ce "
    "el los las del y es una por con para no su al lo como se"
).split()


FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_letter_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_kinds", "n_repeat_words", "base_failed", "kept",
)


@dataclass(frozen=True)
class Rule:
    """A document passes when low * denominator <= numerator <= high * denominator (in hundredths)."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0


#: Hundredths, so that both engines compare integers only.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=2000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=25),
    Rule("words_with_letters", "n_letter_words", "n_words", low=70),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
    Rule("stop_word_kinds", "n_stop_kinds", "one", low=100, from_words=80),
)


def _passes(rules) -> Column:
    verdict = F.lit(True)
    for r in rules:
        scaled, base = F.col(r.numerator) * 100, F.col(r.denominator)
        if r.low is not None:
            verdict &= (scaled >= r.low * base) | (F.col("n_words") < r.from_words)
        if r.high is not None:
            verdict &= (scaled <= r.high * base) | (F.col("n_words") < r.from_words)
    return verdict


def repeated_window_words(words: Column, hashes: str) -> Column:
    """Words inside windows that occur twice or more; `hashes` names the column of window hashes.

    Windows are compared by 64-bit hash within one text. Sorting (hash, position) pairs puts equal
    windows side by side, so the cost is n log n however often a window repeats.
    """
    h = F.col(hashes)
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    # the window of each pair is repeated if a neighbour has its hash
    hit = F.transform(
        F.array(pairs),
        lambda s: F.sort_array(
            F.transform(
                F.filter(
                    F.zip_with(
                        s,
                        F.zip_with(
                            F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), s),
                            F.slice(s, 2, F.size(s)),
                            lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")),
                        ),
                        lambda x, n: F.struct(x["p"].alias("p"), x["h"].alias("h"), n["a"].alias("a"), n["b"].alias("b")),
                    ),
                    lambda x: x["p"].isNotNull() & (x["h"].eqNullSafe(x["a"]) | x["h"].eqNullSafe(x["b"])),
                ),
                lambda x: x["p"],
            )
        ),
    )[0]
    steps = F.transform(
        F.array(hit),
        lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x,
        ),
    )[0]
    return F.when(F.size(F.array_distinct(h)) < F.size(h), steps).otherwise(F.lit(0).cast("long"))


def quality_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`_document` (the row of `docs`) and the counts that rules refer to."""
    t = F.coalesce(F.col("_document").getField(text), F.lit(""))
    own = {
        "_words": F.when(F.trim(t, F.lit(SPACE)) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(t, F.lit(SPACE)), SPACES)),
        "_lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != ""),
    }
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document")).withColumns(own)
    words, lines, n = F.col("_words"), F.col("_lines"), F.size("_words")
    df = df.withColumns(
        {
            "_windows": F.when(
                n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
            ).otherwise(F.array().cast("array<bigint>")),
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(LETTER))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: F.trim(x, F.lit(SPACE)).rlike(BULLET))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.trim(x, F.lit(SPACE)).rlike(ELLIPSIS))).cast("long"),
            "n_stop_kinds": F.size(F.array_intersect(F.split(F.lower(t), SPACES), F.array(*map(F.lit, STOP_WORDS)))).cast("long"),
            "one": F.lit(1).cast("long"),
        }
    )
    return df.withColumn("n_repeat_words", repeated_window_words(words, "_windows"))


def judge_quality(docs: DataFrame, rules=RULES, text: str = "text", min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """`docs` with the features, base_failed and kept (false if base_failed, else every rule's verdict)."""
    df = quality_features(docs, text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "kept": ~failed & _passes(rules)})
    # a generator of one row: filters on the verdict are not moved into the expressions it is made of
    own = [F.col("_document").getField(c).alias(c) for c in docs.columns if c not in FEATURES]
    return df.select(*own, F.inline(F.array(F.struct(*FEATURES))))


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with their own columns whatever those are called."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document"), F.col(text).alias("_text"))
    return judge_quality(rows, rules, "_text").filter("kept").select("_document.*")
