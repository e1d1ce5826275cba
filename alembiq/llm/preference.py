"""Preference formatting: paired conversations as one prompt and two masked completions.

The longest common prefix of turns (role and text equal) of a chosen and a rejected conversation is
rendered once, as the prompt; the turns after it are rendered as completions, with the character
spans that are trained on: the text and end mark of each assistant turn.

Tables without preference labels are paired by what they ask: conversations whose first turn that is
not the system's is equal form a group, and its members are paired in order of conv_id, the smaller
id as chosen. A group may be a third of the table, so it is paired in blocks of 1,024 ids; what each
block leaves over, one conversation at most, is paired in blocks 1,024 times as wide, and so on.
Every conversation appears in one row: those that stay alone are rendered with the turns before their
last assistant turn as prompt, and without a rejected completion.

Defined results: turns follow turn, then role and text, null turns first; a null role or text renders
as nothing but equals only null; conversations that are equal, or one the beginning of the other,
have empty completions where no turn is left; a turn of null conv_id is a conversation of its own, never paired;
repeated turns stay; marks inside a text stay as they are, since spans come from the turns and not from the
marks; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Bits of conv_id that one level of pairing covers.
BLOCK_BITS = 10


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: one row a conversation."""
    typed = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), typed.alias("t"))
    named = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return named.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))


def pair(convs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id (null where a conversation stays alone). conv_ids must be distinct."""
    first = F.get(F.filter("turns", lambda t: F.coalesce(t["role"] != "system", F.lit(True))), F.lit(0))
    asked = F.struct(first["role"], first["text"])
    left = written(convs.where("conv_id IS NOT NULL").select("conv_id", F.xxhash64(asked).alias("k1"), F.xxhash64(F.lit("asked"), asked).alias("k2")), "preference-keys")
    pairs = None
    for level in range(1, 64 // BLOCK_BITS + 2):
        block = F.shiftright("conv_id", min(63, level * BLOCK_BITS))
        group = Window.partitionBy("k1", "k2", "block").orderBy("conv_id")
        placed = left.withColumn("block", block).withColumn("i", F.row_number().over(group)).withColumn("next", F.lead("conv_id").over(group)).where("i % 2 = 1")
        placed = written(placed.drop("block", "i"), "preference-pairs")
        found = placed.where("next IS NOT NULL").select(F.col("conv_id").alias("chosen_id"), F.col("next").alias("rejected_id"))
        pairs = found if pairs is None else pairs.unionByName(found)
        left = placed.where("next IS NULL").drop("next")
        if left.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    return pairs.unionByName(left.select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast("long").alias("rejected_id")))


def paired(turns: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, chosen, rejected (arrays of turns; rejected is null for conversations without a partner)."""
    convs = written(conversations(turns), "preference-turns")
    pairs = pair(convs)
    chosen = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    rejected = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    both = pairs.join(chosen, "chosen_id").join(rejected, "rejected_id", "left")
    unnamed = convs.where("conv_id IS NULL").select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("chosen"), F.lit(None).cast(convs.schema["turns"].dataType).alias("rejected"))
    return both.select("chosen_id", "rejected_id", "chosen", "rejected").unionByName(unnamed)


def _rendered(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """start and end (code points, end excluded) of the text and end mark of each assistant turn in the rendering."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.lit(len(OPEN) + 1) + F.char_length(F.coalesce(t["role"], F.lit("")))
        end = acc["at"] + head + F.char_length(F.coalesce(t["text"], F.lit(""))) + len(CLOSE)
        span = F.struct((acc["at"] + head).alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(F.coalesce(t["role"] == "assistant", F.lit(False)), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def preference_format(pairs: DataFrame) -> DataFrame:
    """``pairs`` with n_common, prompt, chosen_text, chosen_spans, rejected_text, rejected_spans for its turn arrays chosen and rejected."""
    least = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", F.lit(1), least), F.slice("rejected", F.lit(1), least), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differs = F.array_position(same, False)
    common = F.when(differs > 0, differs - 1).otherwise(least)
    answers = F.transform("chosen", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
    last = F.array_position(F.reverse(answers), True)
    alone = F.when(last > 0, F.size("chosen") - last).otherwise(F.size("chosen"))
    df = pairs.withColumn("n_common", F.when(F.col("rejected").isNull(), alone).otherwise(common).cast("int"))
    df = df.withColumns({f"_{c}": F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0))) for c in ("chosen", "rejected")})
    df = df.withColumn("prompt", _render(F.slice("chosen", F.lit(1), F.col("n_common"))))
    for c in ("chosen", "rejected"):
        df = df.withColumn(f"{c}_text", _render(F.col(f"_{c}"))).withColumn(f"{c}_spans", _spans(F.col(f"_{c}")))
    return df.drop("_chosen", "_rejected")


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference_format(paired(table(spark, sf_dir, "conversations")))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("chosen_id", "rejected_id", "n_common", "prompt", "chosen_text", flat(F.col("chosen_spans")).alias("chosen_spans"), "rejected_text", flat(F.col("rejected_spans")).alias("rejected_spans"))


def _sql() -> str:
    """The same in SQL: one table a level of pairing, then list functions."""
    mark = lambda t: f"'{OPEN}' || coalesce({t}.role, '') || chr(10) || coalesce({t}.text, '') || '{CLOSE}' || chr(10)"
    render = lambda c: f"coalesce(array_to_string(list_transform({c}, lambda t: {mark('t')}), ''), '')"
    before = lambda c: f"coalesce(list_sum(list_transform({c}[1:i - 1], lambda u: length({mark('u')}))), 0)"
    head = f"{len(OPEN) + 1}"
    spans = lambda c: (
        f"coalesce(array_to_string(list_transform(list_filter(range(1, len({c}) + 1), lambda i: coalesce({c}[i].role = 'assistant', false)), "
        f"lambda i: CAST({before(c)} + {head} + length({c}[i].role) AS BIGINT) || '-' || CAST({before(c)} + length({mark(f'{c}[i]')}) - 1 AS BIGINT)), ','), '')"
    )
    levels, left = [], "k"
    for n in range(1, 64 // BLOCK_BITS + 2):
        over = f"OVER (PARTITION BY asked, conv_id >> {min(63, n * BLOCK_BITS)} ORDER BY conv_id)"
        levels.append(f"l{n} AS (SELECT conv_id, asked, row_number() {over} AS i, lead(conv_id) {over} AS next FROM {left})")
        levels.append(f"r{n} AS (SELECT conv_id, asked FROM l{n} WHERE i % 2 = 1 AND next IS NULL)")
        left = f"r{n}"
    pairs = " UNION ALL ".join(f"SELECT conv_id AS chosen_id, next AS rejected_id FROM l{n} WHERE i % 2 = 1 AND next IS NOT NULL" for n in range(1, 64 // BLOCK_BITS + 2))
    same = "x[i].role IS NOT DISTINCT FROM y[i].role AND x[i].text IS NOT DISTINCT FROM y[i].text"
    return f"""
WITH c AS (
  SELECT conv_id, list(struct_pack(role := role, "text" := "text") ORDER BY turn NULLS FIRST, role NULLS FIRST, "text" NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), k AS (
  SELECT conv_id, (list_filter(turns, lambda t: coalesce(t.role <> 'system', true)))[1] AS asked FROM c
), {", ".join(levels)}, p AS ({pairs} UNION ALL SELECT conv_id, NULL FROM {left}), b AS (
  SELECT p.chosen_id, p.rejected_id, a.turns AS x, r.turns AS y FROM p JOIN c a ON a.conv_id = p.chosen_id LEFT JOIN c r ON r.conv_id = p.rejected_id
  UNION ALL SELECT NULL, NULL, [struct_pack(role := role, "text" := "text")], NULL FROM conversations WHERE conv_id IS NULL
), n AS (
  SELECT *, CASE WHEN y IS NULL THEN coalesce(list_max(list_filter(range(1, len(x) + 1), lambda i: coalesce(x[i].role = 'assistant', false))) - 1, len(x))
    ELSE coalesce(list_min(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: NOT ({same}))) - 1, least(len(x), len(y))) END AS n FROM b
), s AS (
  SELECT chosen_id, rejected_id, n, y IS NULL AS alone, x[1:n] AS same, x[n + 1:] AS x, y[n + 1:] AS y FROM n
)
SELECT chosen_id, rejected_id, CAST(n AS INTEGER) AS n_common, {render("same")} AS prompt, {render("x")} AS chosen_text, {spans("x")} AS chosen_spans,
  CASE WHEN NOT alone THEN {render("y")} END AS rejected_text, CASE WHEN NOT alone THEN {spans("y")} END AS rejected_spans
FROM s
"""


OP7_SQL = _sql()
