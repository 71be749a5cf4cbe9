"""Preference formatting of chat conversations, in DataFrame operations only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is found turn by turn and rendered once,
as the prompt; what follows it in either conversation is rendered as that one's completion. A completion comes with a mask,
the spans of it (start:end, in code points, end excluded) that a loss counts: the texts and end marks of the assistant's turns.

A rendered turn is <|role|>, a line end, the text, <|end|> and a line end.

`preferences` takes the pairs. The query makes them from single conversations: the chosen one is the conversation itself, with all its turns; the rejected one
ends in the last assistant turn of its partner (conv_id with the last bit flipped) in the place of its own. pairs(whole=False) cuts the
chosen one behind its last assistant turn too. A pair's conversations are dealt to one task by conv_id without the last bit, where turns become
conversations and conversations pairs: one shuffle of the table, and a first turn or a text that is very common is no key.
A conversation is the unit of work, as a document is elsewhere: its turns meet in one row.

Defined cases: turns are ordered by turn, role and text; null role and text count as empty, a null turn sorts first. Without a
partner, or if it has no assistant turn, the rejected completion is empty. Without an assistant turn of its own a
conversation is all prompt and both completions are empty. Each row with a null conv_id is a conversation of its own, without partner. A repeated row is a
repeated turn. An empty table gives no rows. Extra columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

ANSWERS = "assistant"
END = "<|end|>"


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def spans(turns: Column) -> Column:
    """start:end of what the loss counts in rendered(turns), joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        body = state["at"] + F.length(t["role"]) + 5
        end = body + F.length(t["text"]) + len(END)
        span = F.concat(body.cast("string"), F.lit(":"), end.cast("string"))
        more = F.when(t["role"] == ANSWERS, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), more.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns at the start that are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, n.cast("bigint")).otherwise(first - 1)


def preferences(pairs: DataFrame) -> DataFrame:
    """pairs: its key columns, chosen and rejected (arrays of role and text). They become n_common, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    keys = [c for c in pairs.columns if c not in ("chosen", "rejected")]

    def rest(c: str) -> Column:
        return F.slice(c, (F.col("n_common") + 1).cast("int"), F.greatest(F.size(c), F.lit(1)))

    cut = pairs.withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))
    cut = cut.select(*keys, "n_common", F.slice("chosen", F.lit(1), F.col("n_common").cast("int")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return cut.select(
        *keys, "n_common", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"),
        spans(F.col("c")).alias("chosen_spans"), spans(F.col("r")).alias("rejected_spans"),
    )


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, its pair (conv_id without the last bit) and turns, an array of (role, text) in order; rows with a null conv_id are left to pairs()."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def bare(turns: Column) -> Column:
        return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")

    turns = F.array_sort(F.collect_list("t"), lambda a, b: F.when(_before(a, b), -1).when(_before(b, a), 1).otherwise(0))
    named = rows.filter("conv_id is not null").select("conv_id", F.shiftright("conv_id", 1).alias("pair"), turn.alias("t"))
    return named.repartition("pair").groupBy("pair", "conv_id").agg(F.transform(turns, _bare).alias("turns"))


def _bare(t: Column) -> Column:
    return F.struct(t["role"].alias("role"), t["text"].alias("text"))


def _before(a: Column, b: Column) -> Column:
    x, y = (F.coalesce(t["turn"].cast("bigint"), F.lit(-(1 << 63))) for t in (a, b))
    later = F.when(a["role"] != b["role"], a["role"] < b["role"]).otherwise(a["text"] < b["text"])
    return F.when(x != y, x < y).otherwise(later)


def _answered(convs: DataFrame) -> DataFrame:
    """convs with the 1-based place of the last assistant turn (0: none), and that turn."""
    back = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), ANSWERS).cast("int")
    known = convs.withColumn("last", F.when(back == 0, 0).otherwise(F.size("turns") - back + 1))
    return known.withColumn("answer", F.when(F.col("last") > 0, F.element_at("turns", F.col("last"))))


def _against(both: DataFrame, whole: bool) -> DataFrame:
    """conv_id, chosen and rejected from conv_id, turns, last and other, the partner's last answer or null."""
    chosen = F.col("turns") if whole else F.when(F.col("last") == 0, F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.col("last")))
    before = F.slice("turns", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0)))
    rejected = F.when(F.col("last") == 0, F.col("turns")).when(F.col("other").isNull(), before).otherwise(F.concat(before, F.array("other")))
    return both.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))


def mismatched_pairs(convs: DataFrame, whole: bool = True) -> DataFrame:
    """conv_id, chosen and rejected: each conversation against itself with its partner's last answer. whole: chosen has the turns after the last answer too."""
    met = _answered(convs).groupBy("pair").agg(F.collect_list(F.struct("conv_id", "turns", "last", "answer")).alias("two"))
    other = lambda c: F.get(F.filter("two", lambda o: o["conv_id"] != c["conv_id"]), F.lit(0))["answer"]
    of = F.transform("two", lambda c: F.struct(*[c[n].alias(n) for n in ("conv_id", "turns", "last")], other(c).alias("other")))
    return _against(met.select(F.inline(of)), whole)


def pairs(rows: DataFrame, whole: bool = True) -> DataFrame:
    """mismatched_pairs() of the conversations in a table of turns, and each turn without conv_id by itself."""
    named = mismatched_pairs(conversations(rows), whole)
    turn = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    alone = _answered(rows.filter("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    return named.unionAll(_against(alone.withColumn("other", F.when(F.lit(False), F.col("answer"))), whole))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(pairs(table(spark, sf_dir, "conversations")))


ORACLE = """
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id UNION ALL SELECT conv_id, [{'role': coalesce(role, ''), 'text': coalesce(text, '')}] FROM conversations WHERE conv_id IS NULL),
k AS (SELECT conv_id, turns, coalesce(list_max([i for i in range(1, len(turns) + 1) if turns[i].role = 'assistant']), 0) AS last FROM c),
o AS (SELECT xor(conv_id, 1) AS conv_id, turns[last] AS other FROM k WHERE last > 0),
p AS (SELECT k.conv_id, turns AS chosen,
  CASE WHEN last = 0 THEN turns WHEN other IS NULL THEN turns[:last - 1] ELSE turns[:last - 1] || [other] END AS rejected
  FROM k LEFT JOIN o ON k.conv_id = o.conv_id),
n AS (SELECT *, coalesce(list_min([i for i in range(1, least(len(chosen), len(rejected)) + 1) if chosen[i] <> rejected[i]]) - 1, least(len(chosen), len(rejected))) AS n_common FROM p),
s AS (SELECT conv_id, n_common, chosen[:n_common] AS p, chosen[n_common + 1:] AS c, rejected[n_common + 1:] AS r FROM n),
w AS (SELECT *, ['<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) for t in p] AS pt,
  ['<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) for t in c] AS ct, ['<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) for t in r] AS rt FROM s)
SELECT conv_id, n_common::BIGINT AS n_common, array_to_string(pt, '') AS prompt, array_to_string(ct, '') AS chosen, array_to_string(rt, '') AS rejected,
  array_to_string([(length(array_to_string(ct[:i - 1], '')) + length(c[i].role) + 5)::VARCHAR || ':' || (length(array_to_string(ct[:i], '')) - 1)::VARCHAR for i in range(1, len(c) + 1) if c[i].role = 'assistant'], ',') AS chosen_spans,
  array_to_string([(length(array_to_string(rt[:i - 1], '')) + length(r[i].role) + 5)::VARCHAR || ':' || (length(array_to_string(rt[:i], '')) - 1)::VARCHAR for i in range(1, len(r) + 1) if r[i].role = 'assistant'], ',') AS rejected_spans
FROM w
"""
