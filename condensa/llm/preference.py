"""Preference formatting: shared turns once as prompt, the rest as two masked completions.

Formatting a pair is array expressions over one row: no shuffle and no user function. Conversations
that are too large for a row are formatted turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from condensa.functions.text import bind
from condensa.llm.common import fresh
from condensa.llm.graph import small_side
from condensa.operators.sample import ordered_index
from condensa.session import materialize

#: The marks of the chat format.
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
#: What a mark's opening becomes inside a text, so that no text can end its own turn.
DEFUSED = "<\u200b|"
#: Turns of these roles are learned.
LEARNED = ("assistant",)
#: Turns, and bytes of roles and texts, that a conversation may have to be one row.
WHOLE_TURNS, WHOLE_BYTES = 4096, 4 << 20
#: Turns whose lengths are added up in one task.
BLOCK = 65_536


def _clean(turns: Column) -> Column:
    """Turns as (role, text) without nulls: a null role is `user`, a null text or turn is empty."""

    def one(t: Column) -> Column:
        return F.struct(
            F.coalesce(t["role"], F.lit("user")).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("text"),
        )

    return F.transform(F.coalesce(turns, F.array()), one)


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns both begin with, equal in role and text."""
    same = F.zip_with(
        chosen, rejected, lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"])
    )
    # turns that only one side has differ; without a difference all turns are common
    differs = F.transform(same, lambda s: ~F.coalesce(s, F.lit(False)))
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(F.size(chosen)).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SHUT))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(turn["text"], F.lit(OPEN), F.lit(DEFUSED)), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def learned_spans(turns: Column) -> Column:
    """Character spans `start, end` of what is learned in the rendered turns: bodies and their end marks."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        end = start + F.length(_body(turn))
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(
            turn["role"].isin(*LEARNED), F.concat(state["spans"], F.array(span))
        ).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    nothing = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )
    return F.aggregate(turns, nothing, step, lambda state: state["spans"])


def _after(turns: Column, skipped: Column) -> Column:
    return F.slice(turns, skipped + 1, F.greatest(F.size(turns), F.lit(1)))


def format_preferences(
    pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected"
) -> DataFrame:
    """`pairs` with `n_common, prompt, chosen_text, chosen_spans, rejected_text, rejected_spans`.

    `chosen` and `rejected` are arrays of turns with `role` and `text`. The turns that both begin
    with are rendered once, as the prompt; each completion is the rest of its side, and its spans
    are the characters to learn. Equal conversations have empty completions. A null or empty side has
    no turns; nulls within a turn are defined by `_clean`. Rows stand for themselves, repeated ones
    too. Columns of the input that have a name of the result are replaced.
    """
    both = fresh("_pair", pairs.columns)

    def of_pair(p: Column) -> Column:
        parts = F.struct(
            p["n"].alias("n"),
            F.slice(p["c"], 1, p["n"]).alias("prompt"),
            _after(p["c"], p["n"]).alias("c"),
            _after(p["r"], p["n"]).alias("r"),
        )
        return bind(
            parts,
            lambda q: F.struct(
                q["n"].alias("n_common"),
                rendered(q["prompt"]).alias("prompt"),
                rendered(q["c"]).alias("chosen_text"),
                learned_spans(q["c"]).alias("chosen_spans"),
                rendered(q["r"]).alias("rejected_text"),
                learned_spans(q["r"]).alias("rejected_spans"),
            ),
        )

    sides = F.struct(_clean(F.col(chosen)).alias("c"), _clean(F.col(rejected)).alias("r"))
    counted = bind(
        sides,
        lambda s: F.struct(
            s["c"].alias("c"), s["r"].alias("r"), common_turns(s["c"], s["r"]).alias("n")
        ),
    )
    # explode of one element keeps the optimizer from computing the pair once per use
    one = pairs.select(*pairs.columns, F.explode(F.array(bind(counted, of_pair))).alias(both))
    names = [
        "n_common", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans",
    ]
    kept = [c for c in pairs.columns if c.lower() not in names]
    return one.select(*kept, f"{both}.*")


def stale_reply_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """`key, chosen, rejected` from conversations (`key, turn, role, text`).

    The conversation is the chosen side. In the rejected one the last assistant turn repeats what the
    conversation's first assistant turn said or, if it is that turn itself, echoes the turn before
    it (nothing, if there is none): replies that a preference model should learn to rank below.
    Turns are ordered by number, then role and text. A conversation without an assistant has equal
    sides; turns with a null key form one conversation. A conversation is one row of the result, so it
    has to fit into a task: `stale_reply_preferences` passes only those of a bounded size on to this.
    Conversations with equal turns stay rows of their own.
    """
    turn = F.struct("turn", "role", "text")
    whole = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    sides = bind(
        F.col("_turns"),
        lambda t: bind(
            F.struct(
                t.alias("t"),
                F.coalesce(F.array_position(_is_reply(t), True), F.lit(0)).alias("first"),
                F.coalesce(F.array_position(F.reverse(_is_reply(t)), True), F.lit(0)).alias("back"),
            ),
            _sides,
        ),
    )
    one = whole.select(key, F.explode(F.array(sides)).alias("_sides"))
    return one.select(key, "_sides.chosen", "_sides.rejected")


def _is_reply(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))


def _sides(s: Column) -> Column:
    last = F.when(s["back"] > 0, F.size(s["t"]) - s["back"]).otherwise(-1)  # counted from 0
    source = F.when(s["first"] - 1 == last, last - 1).otherwise(s["first"] - 1)

    def plain(t: Column) -> Column:
        return F.struct(t["role"].alias("role"), t["text"].alias("text"))

    def changed(t: Column, i: Column) -> Column:
        worse = F.when(source >= 0, F.get(s["t"], source.cast("int"))["text"])
        return F.struct(
            t["role"].alias("role"), F.when(i == last, worse).otherwise(t["text"]).alias("text")
        )

    return F.struct(
        F.transform(s["t"], plain).alias("chosen"), F.transform(s["t"], changed).alias("rejected")
    )


def stale_reply_preferences(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """`format_preferences` of `stale_reply_pairs` with a column `place`, at any size of a conversation.

    A conversation of at most `WHOLE_TURNS` turns and `WHOLE_BYTES` is a row, its `place` null. A larger one
    is a row for each of its turns: `place` counts them from 0, each column has the turn's part of it
    (spans from the start of the whole completion), and parts in order of `place` make up the whole. The
    columns are the same whether there are larger ones or not.
    """
    size = F.coalesce(F.octet_length("role"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0))
    counted = turns.groupBy(key).agg(F.count("*").alias("_n"), F.sum(size.cast("long")).alias("_bytes"))
    large = counted.where((F.col("_n") > WHOLE_TURNS) | (F.col("_bytes") > WHOLE_BYTES))
    large = materialize(large.select(F.col(key).alias("_large")), "large-conversations")
    names = [
        key, "n_common", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans",
    ]

    def in_rows(small: DataFrame) -> DataFrame:
        whole = format_preferences(stale_reply_pairs(small, key)).select(*names)
        wide = "array<struct<start:bigint,end:bigint>>"
        spans = {c: F.col(c).cast(wide) for c in ("chosen_spans", "rejected_spans")}
        return whole.withColumns(spans | {"place": F.lit(None).cast("long")})

    if large.isEmpty():
        return in_rows(turns)
    large = small_side(large)
    is_large = turns[key].eqNullSafe(F.col("_large"))
    whole = in_rows(turns.join(large, is_large, "left_anti"))
    parts = _turn_parts(turns.join(large, is_large, "left_semi"), key)
    return whole.unionByName(parts.select(*whole.columns))


def _turn_parts(turns: DataFrame, key: str) -> DataFrame:
    """The turns of large conversations, rendered each: no task holds a conversation.

    Turns get places over ranges, and what a conversation is cut at comes from aggregates that are added
    up in the map tasks. Offsets are running sums over the blocks of a conversation.
    """
    columns = [F.col(key).alias("_key"), "turn", "role", "text"]
    # the last column spreads equal turns over ranges
    tied = turns.select(*columns, F.monotonically_increasing_id().alias("_tie"))
    placed = ordered_index(tied, "_key", "turn", "role", "text", "_tie").drop("_tie")
    reply = F.when(F.col("role") == "assistant", F.col("idx"))
    found = placed.groupBy("_key").agg(
        F.min("idx").alias("_low"), F.count("*").alias("_n"),
        F.min(reply).alias("_first"), F.max(reply).alias("_last"),
    )
    before = F.when(F.col("_last") > F.col("_low"), F.col("_last") - 1)
    source = F.when(F.col("_first") == F.col("_last"), before).otherwise(F.col("_first"))
    found = materialize(found.withColumn("_source", source), "large-places")
    ends = found.select(F.explode(F.array("_source", "_last")).alias("idx"))
    ends = ends.where("idx IS NOT NULL").distinct()
    texts = placed.join(small_side(materialize(ends, "large-asked")), "idx").select("idx", F.coalesce("text", F.lit("")).alias("_t"))
    texts = materialize(texts, "large-ends")
    worse = texts.select(F.col("idx").alias("_source"), F.col("_t").alias("_worse"))
    better = texts.select(F.col("idx").alias("_last"), F.col("_t").alias("_better"))
    replaced = found.where("_last IS NOT NULL").join(worse, "_source", "left").join(better, "_last")
    replaced = replaced.withColumn("_worse", F.coalesce("_worse", F.lit("")))
    replaced = replaced.where("_worse <> _better").select(F.col("_last").alias("idx"), "_worse")
    replaced = materialize(replaced, "stale-replies")
    # sides differ in the last reply or nowhere
    differs = replaced.select(F.col("idx").alias("_last"), F.lit(True).alias("_differs"))
    common = F.when(F.col("_differs"), F.col("_last") - F.col("_low")).otherwise(F.col("_n"))
    cuts = found.join(differs, "_last", "left").select(
        F.col("_key").alias("_of"), "_low", common.cast("int").alias("n_common")
    )
    cuts = materialize(cuts, "large-cuts")

    met = placed.join(small_side(cuts), F.col("_key").eqNullSafe(F.col("_of"))).drop("_of")
    met = met.join(replaced, "idx", "left")
    role = F.coalesce("role", F.lit("user"))
    text = F.coalesce("text", F.lit(""))
    chosen = F.struct(role.alias("role"), text.alias("text"))
    rejected = F.struct(role.alias("role"), F.coalesce("_worse", text).alias("text"))
    shared = F.col("idx") < F.col("_low") + F.col("n_common")
    drawn = met.select(
        "_key", "idx", "n_common", "_low", shared.alias("_shared"), role.isin(*LEARNED).alias("_learned"),
        F.length(_head(chosen)).alias("_head"),
        F.concat(_head(chosen), _body(chosen)).alias("_c"),
        F.concat(_head(rejected), _body(rejected)).alias("_r"),
    )
    drawn = drawn.withColumns(
        {
            "_block": F.floor((F.col("idx") - F.col("_low")) / BLOCK),
            "_c_size": F.when(F.col("_shared"), 0).otherwise(F.length("_c")).cast("long"),
            "_r_size": F.when(F.col("_shared"), 0).otherwise(F.length("_r")).cast("long"),
        }
    )
    drawn = materialize(drawn, "large-turns")
    block = ["_low", "_block"]
    sums = drawn.groupBy(*block).agg(F.sum("_c_size").alias("_c_sum"), F.sum("_r_size").alias("_r_sum"))
    # of a conversation one row per block, and within a block its turns
    earlier = Window.partitionBy("_low").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*block).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)

    def running(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    offsets = sums.select(
        *block, running("_c_sum", earlier).alias("_c_off"), running("_r_sum", earlier).alias("_r_off")
    )
    places = drawn.withColumns(
        {"_c_in": running("_c_size", inside), "_r_in": running("_r_size", inside)}
    )
    rows = places.join(small_side(materialize(offsets, "large-offsets")), block)
    rows = rows.withColumns(
        {"_c_at": F.col("_c_off") + F.col("_c_in"), "_r_at": F.col("_r_off") + F.col("_r_in")}
    )

    def part(side: str) -> Column:
        return F.when(~F.col("_shared"), F.col(side)).otherwise("")

    def spans(side: str) -> Column:
        at = F.col(f"{side}_at")
        span = F.struct((at + F.col("_head")).alias("start"), (at + F.col(f"{side}_size")).alias("end"))
        none = F.array().cast("array<struct<start:bigint,end:bigint>>")
        return F.when(F.col("_learned") & ~F.col("_shared"), F.array(span)).otherwise(none)

    return rows.select(
        F.col("_key").alias(key),
        (F.col("idx") - F.col("_low")).alias("place"),
        "n_common",
        F.when(F.col("_shared"), F.col("_c")).otherwise("").alias("prompt"),
        part("_c").alias("chosen_text"), spans("_c").alias("chosen_spans"),
        part("_r").alias("rejected_text"), spans("_r").alias("rejected_spans"),
    )
