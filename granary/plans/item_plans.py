"""Queries of item preparation, splits and grading."""

from pyspark.sql import functions as F

from granary.functions.exprs import WHITE
from granary.operators import items as I, labels as L

from .base import query

# A text with nested, unclosed and absent boxes made from each document's numbers.
RAW = r"""concat('so \boxed{\frac{', n_chars % 7, '}{', doc_id % 5, '}} ', case doc_id % 4 when 0 then 'and \boxed{open' when 1 then 'then \boxed{ \left( ' || (n_chars % 3) || ' \right). }.' when 2 then '' else 'end' end)"""


def raw_text():
    d, n = F.col("doc_id"), F.col("n_chars")
    tail = F.when(d % 4 == 0, F.lit("and \\boxed{open")).when(d % 4 == 1, F.concat(F.lit("then \\boxed{ \\left( "), (n % 3).cast("string"), F.lit(" \\right). }."))).when(d % 4 == 2, "").otherwise("end")
    return F.concat(F.lit("so \\boxed{\\frac{"), (n % 7).cast("string"), F.lit("}{"), (d % 5).cast("string"), F.lit("}} "), tail)


def _boxed(source, lax):
    return rf""", r as (select doc_id, t, case when contains(t, '\boxed{{') then substr(t, length(t) - strpos(reverse(t), reverse('\boxed{{')) + 2) else '' end as rest from ({source})),
k as (select doc_id, t, rest, list_filter(range(1, length(rest) + 1), lambda i: rest[i] = '}}' and length(replace(rest[:i], '}}', '')) - length(replace(rest[:i], '{{', '')) < 0)[1] as e from r),
bx as (select doc_id, t, case when e is not null then substr(rest, 1, e - 1) else {'t' if lax else "''"} end as box from k)"""


SRC = f"select doc_id, {RAW} as t from documents"
BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITE)
NORM = rf""", nm as (select doc_id, regexp_replace(regexp_replace(replace(replace(replace(trim(box, {BLANKS}), '\left', ''), '\right', ''), '$', ''), '[' || {BLANKS} || ']+', '', 'g'), '\.+$', '') as norm from bx)"""


# Half of the questions have white space of other kinds at their ends.
PADDED = "case when source_index % 2 = 0 then chr(9) || question || chr(10) || chr(8195) else question end"


@query("b1_normalize_items", rf""", i as (select source_index, trim({PADDED}, {BLANKS}) as question, solution from v_items)
select concat('math-', printf('%05d', source_index), '-', substr(sha1(question), 1, 12)) as id, source_index, 'train' as split, length(question) as n_question, solution,
  replace(replace(replace(solution, 'Reasoning \boxed{{', ''), '}}', ''), ' ', '') as answer from i""")
def b1(t):
    padded = F.when(F.col("source_index") % 2 == 0, F.concat(F.lit("\t"), "question", F.lit("\n\u2003"))).otherwise(F.col("question"))
    out = I.normalize_items(t.items.select("source_index", padded.alias("question"), "solution"), "math", "train", "source_index")
    return out.select("id", "source_index", "split", F.length("question").cast("long").alias("n_question"), "solution", "answer")


@query("b2_stable_id", " select doc_id, concat('p-', printf('%05d', doc_id * 100), '-', substr(sha1(text), 1, 12)) as id from documents")
def b2(t):
    return t["documents"].select("doc_id", I.stable_id("p", F.col("doc_id") * 100, "text").alias("id"))


@query("b3_boxed", _boxed(SRC, False) + " select doc_id, box from bx")
def b3(t):
    return t["documents"].withColumn("t", raw_text()).select("doc_id", I.boxed("t").alias("box"))


@query("b4_normalize_answer", _boxed(SRC, True) + NORM + " select doc_id, norm from nm")
def b4(t):
    return t["documents"].withColumn("t", raw_text()).select("doc_id", I.normalize_answer("t").alias("norm"))


@query("b5_exact_match", _boxed(SRC, True) + NORM + r" select doc_id, norm = concat('\frac{', doc_id % 3, '}{', doc_id % 5, '}') as is_match from nm")
def b5(t):
    answer = F.concat(F.lit("$\\frac{"), (F.col("doc_id") % 3).cast("string"), F.lit("}{ "), (F.col("doc_id") % 5).cast("string"), F.lit("} $ ."))
    return t["documents"].withColumn("t", raw_text()).select("doc_id", I.exact_match("t", answer).alias("is_match"))


CHOICE = """select doc_id, case doc_id % 5 when 0 then 'I think answer: (B) or answer is C' when 1 then 'A or D maybe' when 2 then 'none of them' when 3 then concat('The Answer -> ', substr('ABCD', n_chars % 4 + 1, 1)) else concat(text, ' B') end as t from documents"""


def choice_text():
    d, n = F.col("doc_id"), F.col("n_chars")
    return (
        F.when(d % 5 == 0, "I think answer: (B) or answer is C").when(d % 5 == 1, "A or D maybe").when(d % 5 == 2, "none of them")
        .when(d % 5 == 3, F.concat(F.lit("The Answer -> "), F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1)))).otherwise(F.concat("text", F.lit(" B")))
    )


@query("b6_choice_letter", f""", c as ({CHOICE}) select doc_id, coalesce(regexp_extract_all(t, '[Aa]nswer\\b\\W*([A-D])', 1)[-1], regexp_extract_all(t, '\\b([A-D])\\b', 1)[-1]) as letter from c""")
def b6(t):
    return t["documents"].withColumn("t", choice_text()).select("doc_id", I.choice_letter("t").alias("letter"))


@query(
    "b7_extract_code",
    r""", c as (select doc_id, case doc_id % 3 when 0 then concat('see', chr(10), '```python', chr(10), 'a = ', n_chars, chr(10), '``` and ```', chr(10), 'bb = 1', chr(10), '```') when 1 then concat('text', chr(10), 'def f():', chr(10), ' return ', n_chars) else lang end as t from documents),
b as (select doc_id, t, regexp_extract_all(t, '(?s)```(?:python)?\s*\n(.*?)```', 1) as bl from c)
select doc_id, case when len(bl) > 0 then list_filter(bl, lambda x: length(x) = list_max(list_transform(bl, lambda y: length(y))))[1] when regexp_matches(t, '(?:^|\n)(import |from |def |class )') then regexp_extract(t, '(?s)(?:^|\n)(?:import |from |def |class ).*') else t end as code from b""",
)
def b7(t):
    d, n, nl = F.col("doc_id"), F.col("n_chars").cast("string"), F.lit("\n")
    text = F.when(d % 3 == 0, F.concat(F.lit("see\n```python\na = "), n, F.lit("\n``` and ```\nbb = 1\n```"))).when(d % 3 == 1, F.concat(F.lit("text\ndef f():\n return "), n)).otherwise(F.col("lang"))
    return t["documents"].withColumn("t", text).select("doc_id", I.code_block("t").alias("code"))


MC = """, q as (select doc_id, concat('Q', doc_id) as question, [lang, source, concat('n', n_chars % 9), 'none'][1:cast(doc_id % 5 as int)] as choices, cast(n_chars % 5 as int) as gold from documents)"""


def mcq(t):
    choices = F.slice(F.array("lang", "source", F.concat(F.lit("n"), (F.col("n_chars") % 9).cast("string")), F.lit("none")), F.lit(1), (F.col("doc_id") % 5).cast("int"))
    return t["documents"].select("doc_id", F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("question"), choices.alias("choices"), (F.col("n_chars") % 5).cast("int").alias("gold"))


# choices that read like indexes and letters of others: only the form says which one is meant
NUMERIC = """, q as (select doc_id, [cast(3 - doc_id % 4 as varchar), substr('BADC', cast(doc_id % 4 as int) + 1, 1), lang, concat(' ', source)][1:cast(2 + doc_id % 3 as int)] as choices, cast(n_chars % 5 as int) as i from documents)"""


@query(
    "b8_choice_index",
    NUMERIC + """ select doc_id, case when i < len(choices) then i end as by_index, case when i < len(choices) then i end as by_letter,
  cast(list_position(list_transform(choices, lambda x: trim(x)), trim(case when i < len(choices) then choices[i + 1] else 'none' end)) - 1 as int) as by_text from q""",
)
def b8_gold(t):
    at, k = F.col("at"), F.col("doc_id") % 4
    choices = F.slice(F.array((3 - k).cast("string"), F.substring(F.lit("BADC"), k.cast("int") + 1, F.lit(1)), "lang", F.concat(F.lit(" "), "source")), F.lit(1), (2 + F.col("doc_id") % 3).cast("int"))
    rows = t["documents"].withColumn("at", (F.col("n_chars") % 5).cast("int")).withColumn("choices", choices)
    text = F.coalesce(F.get("choices", at), F.lit("none"))
    return rows.select(
        "doc_id", I.choice_index("choices", at, "index").alias("by_index"), I.choice_index("choices", F.concat(F.lit(" "), F.substring(F.lit("AbCdE"), at + 1, F.lit(1))), "letter").alias("by_letter"), I.choice_index("choices", text, "text").alias("by_text")
    )


@query(
    "b8_render_mcq",
    MC + """ select doc_id, concat(question, chr(10), array_to_string(list_transform(choices, lambda x, i: concat(substr('ABCD', i, 1), ') ', x)), chr(10))) as body, concat('Answer: ', substr('ABCD', gold + 1, 1)) as solution
from q where len(choices) between 2 and 4 and gold < len(choices)""",
)
def b8(t):
    body, solution, valid = I.render_choices("question", "choices", "gold")
    return mcq(t).filter(valid).select("doc_id", body.alias("body"), solution.alias("solution"))


@query(
    "b9_shuffle_choices",
    MC + """, s as (select doc_id, choices, gold, list_transform(list_sort(list_transform(choices, lambda x, i: {'k': md5(concat('4:', doc_id, ':', i - 1)), 'c': x})), lambda z: z.c) as o from q where gold < len(choices))
select doc_id, o as choices, cast(list_position(o, choices[gold + 1]) - 1 as int) as gold from s""",
)
def b9(t):
    rows = mcq(t).filter("gold < size(choices)")
    choices, gold = I.shuffle_choices("choices", "gold", 4, "doc_id")
    return rows.select("doc_id", choices.alias("choices"), gold.alias("gold"))


@query(
    "b10_parse_choice_list",
    """ select doc_id, case when doc_id % 6 = 0 then null when doc_id % 6 = 1 then [concat('it''s ', lang), source] when doc_id % 6 = 2 then [] else [lang, concat(chr(34), source, chr(34))] end as choices from documents""",
)
def b10(t):
    kind = F.col("doc_id") % 6
    text = F.when(kind == 0, F.lit("['open, 'list']")).when(kind == 1, F.concat(F.lit('["it\'s '), "lang", F.lit("\", '"), "source", F.lit("'] "))).when(kind == 2, F.lit("[ ]"))
    text = text.otherwise(F.concat(F.lit("['"), "lang", F.lit("', '\""), "source", F.lit("\\\"',]")))
    return t["documents"].select("doc_id", I.parse_choices(text).alias("choices"))


@query(
    "b11_chat_messages",
    """ select conv_id, cast(count(*) as int) as n_turns, string_agg(concat('<', role, '> ', text), chr(10) order by turn) as rendered from conversations group by 1""",
)
def b11(t):
    return I.turns(t["conversations"])


@query("b11_prompt_messages", " select doc_id, 'system' as role_1, 'Answer briefly.' as content_1, 'user' as role_2, md5(text) as content_2 from documents")
def b11b(t):
    m = t["documents"].select("doc_id", I.chat_messages("Answer briefly.", "text").alias("m"))
    return m.select("doc_id", F.col("m")[0]["role"].alias("role_1"), F.col("m")[0]["content"].alias("content_1"), F.col("m")[1]["role"].alias("role_2"), F.md5(F.col("m")[1]["content"]).alias("content_2"))


@query(
    "b12_corrupt_answer",
    """, a as (select doc_id, case doc_id % 3 when 0 then concat(' ', n_chars, ' ') when 1 then lang else '  ' end as a from documents)
select doc_id, case when trim(a, ' ') = '' then '0' when regexp_matches(trim(a, ' '), '[0-9]$') then concat(trim(a, ' '), '1') else concat(trim(a, ' '), '0') end as corrupted from a""",
)
def b12(t):
    a = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.col("lang")).otherwise("  ")
    return t["documents"].select("doc_id", I.corrupt_answer(a).alias("corrupted"))


def holed(t):
    d = F.col("source_index")
    return t.items.select("id", F.when(d % 7 != 0, F.col("question")).alias("question"), F.when(d % 5 == 0, "").otherwise(F.col("solution")).alias("answer"))


@query("b13_reject_invalid", " select case when source_index % 7 = 0 then 'no question' else 'no answer' end as reason, count(*) as count from v_items where source_index % 7 = 0 or source_index % 5 = 0 group by 1")
def b13(t):
    return I.reject_invalid(holed(t))[1]


NUM = """, nb as (select *, row_number() over (order by md5(concat('9:', id)), id) as rn from v_items)"""


@query("b14_split_train_probe", NUM + " select id, source_index, case when rn <= 128 then 'probe' else 'train_pool' end as split from nb")
def b14(t):
    return I.split_train_probe(t.items, 128, 9).select("id", "source_index", "split")


@query("b15_carve_probes", NUM + " select id, case when rn <= 64 then 'global' when rn <= 80 then 'fingerprint' else 'train_pool' end as probe_set from nb")
def b15(t):
    return I.carve_probes(t.items, [("global", 64), ("fingerprint", 16)], 9).select("id", "probe_set")


@query("b16_difficulty_filter", " select id, level from v_items where level in ('en', 'de') or (select count(*) filter (level in ('en', 'de')) < greatest(64, count(*) // 5) from v_items)")
def b16(t):
    return I.difficulty_filter(t.items, "level", ["en", "de"]).select("id", "level")


FINAL = """, f as (select concat('math500-', printf('%05d', item_id), '-', substr(sha1(trim(text, ' ')), 1, 12)) as id, item_id as source_index, 'math500' as split, md5(lower(trim(text, ' '))) as k from benchmark where coalesce(text, '') <> '')"""


@query("b17_final_split", FINAL + " select id, source_index, split, (select count(*) from documents where md5(lower(trim(text, ' '))) = k) as n_in_train from f")
def b17(t):
    """The final items under their own prefix and split, and how many training documents are the same whole text."""
    final = I.normalize_items(t["benchmark"].withColumnRenamed("text", "question"), "math500", "math500", "item_id").filter("question <> ''")
    return I.contamination_counts(final, t["documents"].select("doc_id", "text"), F.md5(F.lower("question")), F.md5(F.lower(I.strip("text")))).select("id", "source_index", "split", "n_in_train")


@query("b18_dedup_keep_first", " select arg_min(doc_id, doc_id) as doc_id, md5(text) as h from documents group by md5(text)")
def b18(t):
    rows = t["documents"].select(F.md5("text").alias("h"), "doc_id")
    return L.keep_first(rows, ["h"], ["doc_id"])


@query("b19_assert_unique", " select md5(text) as h, count(*) as n from documents group by 1 having count(*) > 1")
def b19(t):
    return I.duplicates(t["documents"].select(F.md5("text").alias("h")), "h")


@query(
    "d1_grade_rollouts",
    f""", c as ({CHOICE}), g as (select d.doc_id, lang, case when lang = 'en' then case when doc_id % 4 = 0 then null else concat('\\boxed{{', n_chars % 7, '}}') end else t end as completion,
  case when lang = 'en' then cast(n_chars % 5 as varchar) else 'B' end as answer, doc_id % 10 = 0 as noisy from documents d join c using (doc_id)),
a as (select *, case when noisy then case when lang = 'en' then concat(answer, '1') else concat(answer, '0') end else answer end as ans from g where coalesce(completion, '') <> '')
select doc_id as prompt_id, case when lang = 'en' then case when replace(replace(completion, '\\boxed{{', ''), '}}', '') = ans then 1e0 else 0e0 end
  else case when coalesce(regexp_extract_all(completion, '[Aa]nswer\\b\\W*([A-D])', 1)[-1], regexp_extract_all(completion, '\\b([A-D])\\b', 1)[-1]) = ans then 1e0 else 0e0 end end as reward from a""",
)
def d1(t):
    d = t["documents"].withColumn("t", choice_text())
    math = F.col("lang") == "en"
    box = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("\\boxed{"), (F.col("n_chars") % 7).cast("string"), F.lit("}")))
    completions = d.select(F.col("doc_id").alias("prompt_id"), F.when(math, box).otherwise(F.col("t")).alias("completion"))
    answers = d.select(
        F.col("doc_id").alias("prompt_id"), F.when(math, "math").otherwise("choice").alias("domain"), F.when(math, (F.col("n_chars") % 5).cast("string")).otherwise("B").alias("answer"), (F.col("doc_id") % 10 == 0).alias("is_noisy")
    )
    return I.grade(completions, answers).select("prompt_id", "reward")
