"""Chat logs: collapse cumulative snapshots, then render.

Logged conversations often hold the state after each exchange, so a log that is a prefix of a longer one says nothing
new. Every turn gets a rolling hash of the turns up to it: two independent 64-bit hashes of (position, role, text),
combined by exclusive or. Being a prefix is then equality of a length and a hash, so one anti-join of whole
conversations against the proper prefixes of others leaves the maximal ones. Copies of a conversation are one class,
known by its smallest conv_id. DataFrame operations only.

Positions and rolling hashes are computed within blocks of turn numbers and carried over between blocks, so a
conversation with a large part of all rows is split. Rendered text comes in pieces of a bounded number of turns.

Turns are ordered by (turn, role, text), nulls last; rows that repeat all of them count once. A null conv_id is one
conversation of its own. Null and empty roles or texts differ from each other, and render as nothing. Extra columns are
not read. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.llm.common import null_safe_join, stored

BLOCK = 512
PIECE_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    parts = [F.lit(seed), F.col("pos")]
    for name in ("role", "text"):
        parts += [F.col(name).isNull(), F.coalesce(name, F.lit(""))]
    return F.xxhash64(*parts)


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, role, text with pos, n_turns and the rolling hashes p1, p2."""
    turns = turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).distinct().withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = [F.asc_nulls_last(c) for c in ("turn", "role", "text")]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    turns = turns.withColumn("at", F.row_number().over(inside) - 1)
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy(F.asc_nulls_last("block")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select(
        "conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("n_turns")
    )
    placed = null_safe_join(turns, sizes, ["conv_id", "block"]).select(
        "conv_id", "block", "role", "text", "at", "n_turns", (F.col("base") + F.col("at")).alias("pos")
    )
    placed = stored(placed.withColumns({"h1": _turn_hash(17), "h2": _turn_hash(10007)}), "turns")
    upto = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumns({f"q{i}": F.bit_xor(f"h{i}").over(upto) for i in (1, 2)})
    carried = placed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")).select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0).cast("long")).alias(f"c{i}") for i in (1, 2)]
    )
    return null_safe_join(rolled, carried, ["conv_id", "block"]).select(
        "conv_id", "role", "text", "pos", "n_turns",
        *[F.col(f"q{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"p{i}") for i in (1, 2)],
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another."""
    ends = F.col("pos") + 1 == F.col("n_turns")
    classes = rolled.where(ends).groupBy("n_turns", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")
    )
    prefixes = rolled.where(~ends).select((F.col("pos") + 1).alias("n_turns"), "p1", "p2").distinct()
    return classes.join(prefixes, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(kept: DataFrame, turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """conv_id, piece, n_turns, n_copies, rendered: at most `piece_turns` turns in a row."""
    line = F.concat(
        F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE)
    )
    rows = null_safe_join(turns.drop("n_turns"), kept, ["conv_id"]).select(
        "conv_id", F.floor(F.col("pos") / piece_turns).alias("piece"), "n_turns", "n_copies",
        F.struct("pos", line.alias("line")).alias("line"),
    )
    return rows.groupBy("conv_id", "piece", "n_turns", "n_copies").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]), "").alias("rendered")
    )


def collapse_and_render(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    rolled = stored(rolling_hashes(turns), "rolling")
    return render(maximal(rolled), rolled, piece_turns)


ORACLE = f"""
    WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) - 1 AS pos FROM d
    ), c AS (SELECT conv_id, count(*) AS n_turns, list({{'r': role, 't': text}} ORDER BY pos) AS turns FROM r GROUP BY conv_id),
    k AS (SELECT turns, any_value(n_turns) AS n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns),
    m AS (
      SELECT * FROM k a WHERE NOT EXISTS (
        SELECT 1 FROM k b WHERE b.n_turns > a.n_turns AND list_slice(b.turns, 1, a.n_turns) = a.turns)
    )
    SELECT r.conv_id, CAST(floor(r.pos / {PIECE_TURNS}) AS BIGINT) AS piece, m.n_turns, m.n_copies,
      string_agg('{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE.rstrip()}' || chr(10), '' ORDER BY r.pos) AS rendered
    FROM r JOIN m ON r.conv_id IS NOT DISTINCT FROM m.conv_id
    GROUP BY r.conv_id, CAST(floor(r.pos / {PIECE_TURNS}) AS BIGINT), m.n_turns, m.n_copies"""
