"""Plans of the ordered-row algebra, over events per user and other tables."""

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import edits as E
from ..operators import sequence as Q
from ..operators.boxes import box_intersects
from ..operators.keyframes import BASE
from .registry import query, r, rounded

KEY = ["plate_id"]


def _events(t):
    return t.edits.select("plate_id", "seq", "value", "op", "k")


@query("filter_where", "SELECT plate_id, seq, value FROM f_edits WHERE value > 100 AND op <> 'error'")
def _(t):
    return Q.where(_events(t), (F.col("value") > 100) & (F.col("op") != "error")).select("plate_id", "seq", "value")


@query("filter_in_range", "SELECT plate_id, seq, k FROM f_edits WHERE k >= 20 AND k <= 40")
def _(t):
    return Q.where(_events(t), N.in_range(F.col("k"), 20, 40)).select("plate_id", "seq", "k")


@query("find_first", """
  SELECT conv_id, turn, role, length(text)::INT AS n_chars FROM conversations
  WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def _(t):
    rows = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    return Q.find_first(rows, F.col("role") == "assistant", ["conv_id"], "turn", ["role", "n_chars"])


@query("clamp_columns", f"""
  SELECT plate_id, seq, {r('greatest(0e0, least(1e0, value / 100 - 0.2e0))', 'c01')}, greatest(20, least(60, k)) AS ck,
         {r("CASE WHEN k % 10 = 0 THEN 5e0 ELSE greatest(5e0, least(90e0, value)) END", 'valid')} FROM f_edits""")
def _(t):
    typed = F.when(F.col("k") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    out = _events(t).select(
        "plate_id", "seq", N.clamp01(F.col("value") / 100 - 0.2).alias("c01"),
        N.clamp_int(F.col("k"), 20, 60).alias("ck"), N.clamp_input(typed, 5.0, 90.0).alias("valid"),
    )
    return rounded(out, "c01", "valid")


@query("distinct_first", "SELECT plate_id, op, min(seq) AS seq FROM f_edits GROUP BY plate_id, op")
def _(t):
    return Q.distinct_first(_events(t), KEY, "op", "seq")


@query("distinct_first_number", """
  SELECT plate_id, k / 10 AS tenth, min(seq) AS seq FROM f_edits WHERE k % 7 <> 0 GROUP BY plate_id, k""")
def _(t):
    tenth = F.when(F.col("k") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("k") / 10)
    return Q.distinct_first(_events(t).withColumn("tenth", tenth), KEY, "tenth", "seq")


@query("sort_rows", "SELECT value, plate_id, seq FROM f_edits ORDER BY value DESC, seq")
def _(t):
    return Q.sort_rows(_events(t).select("value", "plate_id", "seq"), [F.col("value").desc()], "seq")


@query("union_all", """
  SELECT 0 AS part, c_custkey AS id, c_acctbal AS balance FROM customer
  UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier""")
def _(t):
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return Q.union_all(customers, suppliers)


@query("zip_rows", """
  SELECT plate_id, pos, a, b FROM
    (SELECT plate_id, row_number() OVER (PARTITION BY plate_id ORDER BY seq) - 1 AS pos, value AS a FROM f_edits WHERE op = 'click')
  JOIN (SELECT plate_id, row_number() OVER (PARTITION BY plate_id ORDER BY seq) - 1 AS pos, value AS b FROM f_edits WHERE op = 'view')
  USING (plate_id, pos)""")
def _(t):
    side = lambda op, name: _events(t).where(F.col("op") == op).select("plate_id", "seq", F.col("value").alias(name))
    return Q.zip_rows(side("click", "a"), side("view", "b"), KEY, "seq")


@query("map_with_index", f"""
  SELECT plate_id, seq, index, {r('value * index', 'scaled')} FROM
    (SELECT plate_id, seq, value, row_number() OVER (PARTITION BY plate_id ORDER BY seq) - 1 AS index FROM f_edits)""")
def _(t):
    rows = _events(t).select("plate_id", "seq", "value")
    out = Q.map_with_index(rows, KEY, "seq", lambda i: F.col("value") * i, "scaled").drop("value")
    return rounded(out, "scaled")


_POS = "(SELECT *, row_number() OVER (PARTITION BY plate_id ORDER BY seq) - 1 AS pos FROM f_edits)"


def _window_text(df, key):
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["value"])
    out = df.select("plate_id", key, F.array_join(F.col("items.seq").cast("array<string>"), " ").alias("seqs"), total.alias("total"))
    return rounded(out, "total")


@query("window_tumbling_count", f"""
  SELECT plate_id, pos // 5 AS "window", string_agg(seq::VARCHAR, ' ' ORDER BY seq) AS seqs, {r('sum(value)', 'total')}
  FROM {_POS} GROUP BY plate_id, pos // 5 HAVING count(*) = 5""")
def _(t):
    return _window_text(Q.window_tumbling_count(_events(t), KEY, "seq", ["value"], 5), "window")


@query("window_sliding_count", f"""
  SELECT plate_id, start, string_agg(seq::VARCHAR, ' ' ORDER BY seq) AS seqs, {r('sum(value)', 'total')}
  FROM {_POS} p JOIN (
    SELECT plate_id, pos AS start FROM {_POS} WHERE pos = 0 OR (pos - 1) % 2 = 0) s USING (plate_id)
  WHERE p.pos >= start AND p.pos < start + 3 GROUP BY plate_id, start HAVING count(*) = 3""")
def _(t):
    return _window_text(Q.window_sliding_count(_events(t), KEY, "seq", ["value"], 3, 2), "start")


@query("array_collect", """
  SELECT plate_id, 0 AS part, string_agg(seq::VARCHAR, ' ' ORDER BY seq) AS seqs FROM f_edits GROUP BY plate_id""")
def _(t):
    out = Q.array_collect(_events(t), KEY, "seq", ["seq"])
    return out.select("plate_id", F.col("part").cast("int").alias("part"), F.array_join(F.col("seq").cast("array<string>"), " ").alias("seqs"))


@query("array_flatten", f"""
  SELECT vec_id, i::INT AS item_idx, {r('embedding[i + 1]::DOUBLE', 'item')}
  FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)""")
def _(t):
    out = Q.array_flatten(t.embeddings.select("vec_id", "embedding"), "embedding", "item")
    return rounded(out.withColumn("item", F.col("item").cast("double")), "item")


@query("array_flat_map", f"""
  SELECT plate_id, index, unnest([value, value + index]) AS item FROM
    (SELECT plate_id, value, row_number() OVER (PARTITION BY plate_id ORDER BY seq) - 1 AS index FROM f_edits)""")
def _(t):
    pair = lambda i: F.array(F.col("value"), F.col("value") + i)
    return Q.array_flat_map(_events(t).select("plate_id", "seq", "value"), KEY, "seq", pair, "item").select("plate_id", "index", "item")


@query("agg_sum", f"SELECT plate_id, {r('coalesce(sum(CASE WHEN value > 200 THEN value END), 0)', 'total')} FROM f_edits GROUP BY plate_id")
def _(t):
    big = F.when(F.col("value") > 200, F.col("value"))
    return rounded(Q.agg_sum(_events(t), KEY, big, "total"), "total")


@query("agg_average", f"SELECT plate_id, {r('avg(CASE WHEN value > 200 THEN value END)', 'mean')} FROM f_edits GROUP BY plate_id")
def _(t):
    big = F.when(F.col("value") > 200, F.col("value"))
    return rounded(Q.agg_average(_events(t), KEY, big, "mean"), "mean")


def _pick(order: str) -> str:
    return f"SELECT plate_id, seq, value, k FROM f_edits QUALIFY row_number() OVER (PARTITION BY plate_id ORDER BY {order}) = 1"


VALUES = ["seq", "value", "k"]


@query("agg_find_max", _pick("k DESC, seq"))
def _(t):
    return Q.find_max(_events(t), KEY, F.col("k"), "seq", VALUES)


@query("agg_find_min", _pick("k, seq"))
def _(t):
    return Q.find_min(_events(t), KEY, F.col("k"), "seq", VALUES)


@query("agg_nearest", _pick("abs(k - 50), seq DESC"))
def _(t):
    return Q.nearest(_events(t), KEY, F.col("k"), F.lit(50), "seq", VALUES)


@query("agg_compare", f"""
  SELECT 'lowest' AS name, * FROM ({_pick('k DESC, seq DESC')}) UNION ALL SELECT 'highest', * FROM ({_pick('k, seq DESC')})""")
def _(t):
    low = Q.get_lowest(_events(t), KEY, F.col("k"), "seq", VALUES).withColumn("name", F.lit("lowest"))
    high = Q.get_highest(_events(t), KEY, F.col("k"), "seq", VALUES).withColumn("name", F.lit("highest"))
    return low.unionByName(high)


@query("agg_reduce", f"""
  SELECT plate_id, {r("list_reduce(list_prepend(0e0, list(value ORDER BY seq)), lambda a, x: a * 0.5e0 + x)", 'result')}
  FROM f_edits GROUP BY plate_id""")
def _(t):
    # result * 0.5 + value, as composition of the maps x -> scale * x + shift
    lift = F.struct(F.lit(0.5).alias("scale"), F.col("value").alias("shift"))
    join = lambda p, q: F.struct(
        (p["scale"] * q["scale"]).alias("scale"), (p["shift"] * q["scale"] + q["shift"]).alias("shift")
    )
    folded = Q.ordered_fold(_events(t), KEY, "seq", lift, join, "f")
    return rounded(folded.select("plate_id", F.col("f.shift").alias("result")), "result")


_BOX = """
  SELECT p_partkey AS id, (p_partkey * 7919 % 10007) / 10007e0 AS x0, (p_partkey * 104729 % 10007) / 10007e0 AS y0,
         p_size / 2000e0 AS w, p_retailprice / 100000e0 AS h FROM part"""
_TARGET = """
  SELECT o_orderkey AS id, (o_orderkey * 7907 % 10007) / 10007e0 AS x0, (o_orderkey * 104723 % 10007) / 10007e0 AS y0,
         o_totalprice / 100000000e0 AS w, (o_custkey % 50) / 10000e0 AS h FROM orders"""


@query("box_intersects", f"""
  SELECT a.id AS left_id, b.id AS right_id FROM ({_BOX}) a JOIN ({_TARGET}) b
  ON a.x0 <= b.x0 + b.w AND a.x0 + a.w >= b.x0 AND a.y0 <= b.y0 + b.h AND a.y0 + a.h >= b.y0""")
def _(t):
    return box_intersects(*t.boxes)


@query("find_moved_point", """
  SELECT p.plate_id, p.kf_seq, b.k AS new_k, min(p.point_idx) AS point_idx
  FROM (SELECT plate_id, -1 AS kf_seq, point_idx, u, v FROM f_base
        UNION ALL SELECT plate_id, kf_seq, point_idx, u, v FROM f_kf) p
  JOIN (SELECT plate_id, u, v, arg_min(k, seq) AS k FROM f_edits GROUP BY plate_id, u, v) b
    ON b.plate_id = p.plate_id AND b.u = p.u AND b.v = p.v
  GROUP BY p.plate_id, p.kf_seq, b.k""")
def _(t):
    """The positions of all edits, looked up in the base and in every frame of their plate."""
    moves = t.edits.groupBy("plate_id", F.col("u").alias("old_u"), F.col("v").alias("old_v")).agg(
        F.min_by("k", "seq").alias("k")
    )
    moves = moves.select("plate_id", "old_u", "old_v", F.col("k").alias("new_u"), F.col("k").alias("new_v"))
    points = t.base.withColumn("kf_seq", F.lit(BASE).cast("bigint")).select("plate_id", "kf_seq", "point_idx", "u", "v")
    points = points.unionByName(t.keyframes.select("plate_id", "kf_seq", "point_idx", "u", "v"))
    found = E.find_moved_point(points, moves, within=("kf_seq",))
    return found.select("plate_id", "kf_seq", F.col("new_u").alias("new_k"), "point_idx")
