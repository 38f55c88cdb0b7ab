"""Item preparation, splits and grading, as column expressions inside table-to-table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions.exprs import WHITE, blank_to_null, col, ordinal, shuffle_key, strip

BOX = "\\boxed{"


def boxed(text, strict: bool = True) -> Column:
    """Content of the last balanced \\boxed{...}; without one '' (strict) or the whole text."""
    t = col(text)
    start = F.length(t) - F.locate(BOX[::-1], F.reverse(t)) + 2  # behind the marker
    rest = F.when(F.instr(t, BOX) > 0, F.substring(t, start, F.length(t))).otherwise(F.lit(""))
    step = lambda s, c: F.struct(
        (s["i"] + 1).alias("i"),
        (s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
        F.when((s["end"] == 0) & (c == "}") & (s["depth"] == 1), s["i"]).otherwise(s["end"]).alias("end"),
    )
    zero = F.struct(F.lit(1).alias("i"), F.lit(1).alias("depth"), F.lit(0).alias("end"))
    end = F.aggregate(F.split(rest, ""), zero, step)["end"]
    return F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(F.lit("") if strict else t)


def normalize_answer(text) -> Column:
    t = strip(boxed(text, strict=False))
    for piece in ("\\left", "\\right", "$"):
        t = F.replace(t, F.lit(piece), F.lit(""))
    return F.regexp_replace(F.regexp_replace(t, f"[{WHITE}]+", ""), r"\.+$", "")


def exact_match(prediction, answer) -> Column:
    return normalize_answer(prediction) == normalize_answer(answer)


def choice_letter(text) -> Column:
    """The last letter A to D that follows the word answer, else the last that stands alone, else null."""
    last = lambda regex: F.try_element_at(F.regexp_extract_all(col(text), F.lit(regex), F.lit(1)), F.lit(-1))
    return F.coalesce(last(r"[Aa]nswer\b\W*([A-D])"), last(r"\b([A-D])\b"))


def code_block(text) -> Column:
    """The longest fenced block (the first of equals), else from the first import or definition, else the text."""
    t = col(text)
    blocks = F.regexp_extract_all(t, F.lit(r"(?s)```(?:python)?\s*\n(.*?)```"), F.lit(1))
    longest = F.aggregate(blocks, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.length(b) > F.length(a)), b).otherwise(a))
    at = F.regexp_instr(t, F.lit(r"(?:^|\n)(import |from |def |class )"))
    return F.when(F.size(blocks) > 0, longest).when(at > 0, F.substring(t, at, F.length(t))).otherwise(t)


def corrupt_answer(answer) -> Column:
    a = strip(answer)
    return F.when(a == "", F.lit("0")).when(a.rlike(r"\p{Nd}$"), F.concat(a, F.lit("1"))).otherwise(F.concat(a, F.lit("0")))


def stable_id(prefix: str, index, text) -> Column:
    return F.concat(F.lit(prefix + "-"), F.format_string("%05d", col(index)), F.lit("-"), F.substring(F.sha1(col(text)), 1, 12))


def first_filled(*columns) -> Column:
    """The first that is neither null nor empty; blanks count as filled and are trimmed afterwards."""
    return strip(F.coalesce(*(blank_to_null(c) for c in columns), F.lit("")))


def normalize_items(rows: DataFrame, prefix: str, split: str, index: str) -> DataFrame:
    """id, source_index, split, question, solution and answer from whichever columns hold them."""
    have = lambda *names: [c for c in names if c in rows.columns] or [F.lit(None).cast("string")]
    r = rows.select(F.col(index).alias("source_index"), first_filled(*have("problem", "question")).alias("question"), first_filled(*have("solution", "completion", "answer")).alias("solution"), F.coalesce(*have("answer")).alias("_answer"))
    r = r.withColumn("answer", first_filled("_answer", boxed("solution")))
    return r.select(stable_id(prefix, "source_index", "question").alias("id"), "source_index", F.lit(split).alias("split"), "question", "solution", "answer")


def reject_invalid(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with question and answer, and the count of those without by reason."""
    reason = F.when(F.coalesce("question", F.lit("")) == "", "no question").when(F.coalesce("answer", F.lit("")) == "", "no answer")
    marked = items.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").groupBy("reason").count()


def render_choices(question, choices, gold, least: int = 2, most: int = 4) -> tuple[Column, Column, Column]:
    """Body with lettered choices, solution text, and whether the row is valid."""
    c, g = col(choices), col(gold)
    lines = F.transform(c, lambda x, i: F.concat(F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(") "), x))
    body = F.concat(col(question), F.lit("\n"), F.array_join(lines, "\n"))
    valid = F.size(c).between(least, most) & (g >= 0) & (g < F.size(c))
    return body, F.concat(F.lit("Answer: "), F.substring(F.lit("ABCD"), g + 1, F.lit(1))), valid


def shuffle_choices(choices, gold, seed, key) -> tuple[Column, Column]:
    """Choices in the order of their keys, and the new index of the right one (the first equal text)."""
    keyed = F.array_sort(F.transform(col(choices), lambda c, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), col(key).cast("string"), i.cast("string"))).alias("k"), c.alias("c"))))
    out = F.transform(keyed, lambda s: s["c"])
    right = F.element_at(col(choices), (col(gold) + 1).cast("int"))
    return out, (F.array_position(out, right) - 1).cast("int")


# One quoted string of a list literal, with either quote; \ escapes the next character.
_QUOTED = r"""(?:'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*")"""


def parse_choices(text) -> Column:
    """A list of strings written with single or double quotes, which may hold the other quote; null if it is none."""
    t = strip(text)
    parts = F.regexp_extract_all(t, F.lit(_QUOTED), F.lit(0))
    plain = lambda x: F.regexp_replace(F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1")
    return F.when(t.rlike(rf"(?s)^\[\s*(?:{_QUOTED}\s*(?:,\s*{_QUOTED}\s*)*,?\s*)?\]$"), F.transform(parts, plain))


def choice_index(choices, gold, form: str) -> Column:
    """The index of the right choice; null if there is none.

    form: how the source states it. index: a number from 0; letter: A, B, ... in either case; text: the text
    of a choice (the first equal one). The forms are never guessed from the value, as a choice may read "1" or "A".
    """
    g, c = strip(col(gold).cast("string")), col(choices)
    if form == "index":
        at = F.when(g.rlike("^[0-9]{1,9}$"), g.try_cast("int"))
    elif form == "letter":
        at = F.when(g.rlike("^[A-Za-z]$"), F.ascii(F.upper(g)) - F.ascii(F.lit("A")))
    elif form == "text":
        at = F.array_position(F.transform(c, strip), F.nullif(g, F.lit(""))) - 1
    else:
        raise ValueError(f"unknown form {form!r}: index, letter or text")
    return F.when((at >= 0) & (at < F.size(c)), at).cast("int")


def chat_messages(system: str, user) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", col(user)))


def turns(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its turns in order, rendered."""
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    line = lambda x: F.concat(F.lit("<"), x["role"], F.lit("> "), x["text"])
    return rows.select("conv_id", F.size("t").alias("n_turns"), F.array_join(F.transform("t", line), "\n").alias("rendered"))


def numbered(items: DataFrame, seed, key: str = "id") -> DataFrame:
    return ordinal(items.withColumn("_key", shuffle_key(seed, key)), [], "_key", tie=(key,)).drop("_key")


def split_train_probe(items: DataFrame, probe: int, seed, raw_rows: int | None = None) -> DataFrame:
    """The first `probe` items in the seed's order are the probe; the raw table must have more rows than that."""
    if raw_rows is not None and raw_rows <= probe:
        raise ValueError("the table has no rows beyond the probe")
    return numbered(items, seed).withColumn("split", F.when(F.col("rn") <= probe, "probe").otherwise("train_pool")).drop("rn")


def carve_probes(items: DataFrame, sizes: list[tuple[str, int]], seed) -> DataFrame:
    """Named probe sets, one after another in the seed's order; the rest is train_pool."""
    name, upto = F.lit("train_pool"), 0
    steps = []
    for label, n in sizes:
        upto += n
        steps.append((label, upto))
    for label, end in reversed(steps):
        name = F.when(F.col("rn") <= end, label).otherwise(name)
    return numbered(items, seed).withColumn("probe_set", name).drop("rn")


def difficulty_filter(items: DataFrame, column: str, levels: list[str], least: int = 64, part: int = 5) -> DataFrame:
    """Only rows of these levels, if they are at least max(least, n // part); else all rows."""
    hit = F.coalesce(F.col(column).isin(levels), F.lit(False))
    gate = items.agg((F.count_if(hit) >= F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) / part))).alias("_use"))
    return items.crossJoin(F.broadcast(gate)).filter(~F.col("_use") | hit).drop("_use")  # one row


def contamination(train: DataFrame, final: DataFrame, key) -> DataFrame:
    """Rows of train whose key is in final."""
    return train.withColumn("_k", key).join(final.select(key.alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def contamination_counts(final: DataFrame, train: DataFrame, final_key, train_key) -> DataFrame:
    """`final` with n_in_train, the rows of train that have its key; train shrinks to one row for each key first."""
    seen = train.groupBy(train_key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return final.withColumn("_k", final_key).join(seen, "_k", "left").withColumn("n_in_train", F.coalesce("_n", F.lit(0))).drop("_k", "_n")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    examples = duplicates(df, key).limit(5).collect()
    if examples:
        raise ValueError(f"repeated {key}: {[r[0] for r in examples]}")
    return df


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def grade(completions: DataFrame, items: DataFrame, noisy: str = "is_noisy") -> DataFrame:
    """reward 0 or 1 by the verifier of the item's domain; a noisy item's answer is corrupted first.

    Empty completions are dropped; a domain without a verifier is an error when its row is met.
    """
    rows = completions.filter(F.coalesce("completion", F.lit("")) != "").join(items, "prompt_id")
    answer = F.when(F.col(noisy), corrupt_answer("answer")).otherwise(F.col("answer"))
    math = exact_match("completion", answer)
    choice = F.coalesce(choice_letter("completion") == answer, F.lit(False))
    unknown = F.raise_error(F.concat(F.lit("no verifier for domain "), F.col("domain"))).cast("boolean")
    right = F.when(F.col("domain") == "math", math).when(F.col("domain") == "choice", choice).otherwise(unknown)
    return rows.withColumn("reward", right.cast("double"))
