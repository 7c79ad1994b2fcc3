"""Plans over keyframes: interpolation, edits and the edit stream."""

from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import keyframes as K
from ..operators import replay as RP
from ..session import scratch_path
from ..sources.bindings import utc_day, utc_instant
from ..streaming import keyframes as ST
from ..streaming import replay as SR
from .registry import query, r, rounded, rs
from .views import interpolated


def asked(t):
    """Every plate at 0, 0.1, ..., 1."""
    steps = F.array(*[F.lit(i / 10.0) for i in range(11)])
    return t.edits.select("plate_id").distinct().select("plate_id", F.explode(steps).alias("t"))


@query("keyframe_interpolate", f"""
  SELECT plate_id, t, point_idx, {rs('u', 'v')} FROM ({interpolated('f_extreme')})""")
def _(t):
    return rounded(K.interpolate(t.base, t.keyframes, asked(t)), "u", "v")


@query("keyframe_interpolate_bracket", f"""
  SELECT plate_id, t, point_idx, {rs('u', 'v')} FROM ({interpolated('f_bracket')})""")
def _(t):
    return rounded(K.interpolate(t.base, t.keyframes, asked(t), "bracket"), "u", "v")


@query("keyframe_bracket_window", f"""
  SELECT plate_id, t, ls AS lower_seq, {r('lt', 'lower_time', 9)}, coalesce(us, ls) AS upper_seq, {r('coalesce(ut, lt)', 'upper_time', 9)}
  FROM f_bracket""")
def _(t):
    return rounded(K.bracket_frames(t.keyframes, asked(t)), "lower_time", "upper_time", digits=9)


def _state(pair):
    """Base and frames of a plate in one table; the base is frame -1 at time 0."""
    base, keyframes = pair
    zero = base.select(
        "plate_id", F.lit(-1).cast("bigint").alias("kf_seq"), F.lit(0.0).alias("time"), "point_idx", "u", "v"
    )
    return rounded(rounded(keyframes.unionByName(zero), "u", "v"), "time", digits=9)


def _state_sql(base: str, frames: str) -> str:
    return f"""
      SELECT plate_id, kf_seq, {r('time', 'time', 9)}, point_idx, {rs('u', 'v')} FROM ({frames})
      UNION ALL SELECT plate_id, -1, 0e0, point_idx, {rs('u', 'v')} FROM ({base})"""


def _slots(t):
    """Edits whose times fall on hundredths, so that several of a plate meet at one time, some at 0."""
    slot = F.floor(F.col("time") * 20.0) / 100.0
    one = t.edits.where("op = 'purchase'").select(
        "plate_id", "seq", slot.alias("time"), F.lit(0).alias("point_idx"), "u", "v"
    )
    two = one.select("plate_id", "seq", "time", F.lit(1).alias("point_idx"), F.col("v").alias("u"), F.col("u").alias("v"))
    return one.unionByName(two)


def _on_slots(t):
    """Frames on the same hundredths, several of a plate at one time."""
    return t.keyframes.withColumn("time", F.floor(F.col("time") * 20.0) / 100.0)


_SLOT_KF = "(SELECT plate_id, kf_seq, floor(time * 20e0) / 100e0 AS time, point_idx, u, v FROM f_kf)"
_SLOT_EDIT = """(
  SELECT *, max(seq) OVER w AS last, min(seq) OVER w AS first FROM (
    SELECT plate_id, seq, floor(time * 20e0) / 100e0 AS time, point_idx,
           CASE point_idx WHEN 0 THEN u ELSE v END AS u, CASE point_idx WHEN 0 THEN v ELSE u END AS v
    FROM f_edits, f_pair WHERE op = 'purchase')
  WINDOW w AS (PARTITION BY plate_id, time))"""
_SLOT_FIRST = f"(SELECT plate_id, time, min(kf_seq) AS kf FROM {_SLOT_KF} GROUP BY plate_id, time)"


@query("edit_upsert_keyframe", _state_sql(
    f"""SELECT * FROM f_base WHERE plate_id NOT IN (SELECT plate_id FROM {_SLOT_EDIT} WHERE time = 0)
        UNION ALL SELECT plate_id, point_idx, u, v FROM {_SLOT_EDIT} WHERE time = 0 AND seq = last""",
    f"""SELECT k.* FROM {_SLOT_KF} k WHERE NOT EXISTS (
          SELECT 1 FROM {_SLOT_EDIT} e JOIN {_SLOT_FIRST} f ON f.plate_id = e.plate_id AND f.time = e.time
          WHERE e.time <> 0 AND f.plate_id = k.plate_id AND f.kf = k.kf_seq)
        UNION ALL
        SELECT e.plate_id, coalesce(f.kf, coalesce(m.top, -1) + 1 + e.first), e.time, e.point_idx, e.u, e.v
        FROM {_SLOT_EDIT} e LEFT JOIN {_SLOT_FIRST} f ON f.plate_id = e.plate_id AND f.time = e.time
        LEFT JOIN (SELECT plate_id, max(kf_seq) AS top FROM {_SLOT_KF} GROUP BY plate_id) m ON m.plate_id = e.plate_id
        WHERE e.time <> 0 AND e.seq = e.last"""))
def _(t):
    return _state(E.upsert_keyframe(t.base, _on_slots(t), _slots(t)))


_SIGNUPS = """(
  SELECT plate_id, (row_number() OVER (PARTITION BY plate_id ORDER BY seq) + 1)::INT AS idx, u, v
  FROM f_edits WHERE op = 'signup')"""


@query("edit_append_point", _state_sql(
    f"SELECT * FROM f_base UNION ALL SELECT plate_id, idx, u, v FROM {_SIGNUPS}",
    f"""SELECT * FROM f_kf UNION ALL
       SELECT f.plate_id, f.kf_seq, f.time, e.idx, e.u, e.v FROM f_frames f JOIN {_SIGNUPS} e ON e.plate_id = f.plate_id"""))
def _(t):
    return _state(E.append_point(t.base, t.keyframes, t.edits.where("op = 'signup'")))


_GONE = "(SELECT DISTINCT plate_id, k % 40 AS gone FROM f_edits WHERE op = 'error')"


@query("edit_delete_point", _state_sql(
    *[f"""SELECT s.* REPLACE (s.point_idx - (SELECT count(*) FROM {_GONE} d WHERE d.plate_id = s.plate_id AND d.gone < s.point_idx)::INT AS point_idx)
          FROM {s} s WHERE NOT EXISTS (SELECT 1 FROM {_GONE} d WHERE d.plate_id = s.plate_id AND d.gone = s.point_idx)"""
      for s in ("f_base", "f_kf")]))
def _(t):
    gone = t.edits.where("op = 'error'").select("plate_id", (F.col("k") % 40).alias("point_idx"))
    return _state(E.delete_point(t.base, t.keyframes, gone))


def _moves(t):
    """Each click drags base point 0, seen at time 0 or past the last frame."""
    click = t.edits.where("op = 'click'").select("plate_id", "seq", "k", "u", "v")
    old = t.base.where("point_idx = 0").select("plate_id", F.col("u").alias("old_u"), F.col("v").alias("old_v"))
    when = F.when(F.col("k") % 2 == 0, F.lit(0.0)).otherwise(F.lit(2.0))
    return click.join(old, "plate_id").select(
        "plate_id", "seq", when.alias("t"), "old_u", "old_v", F.col("u").alias("new_u"), F.col("v").alias("new_v")
    )


_MOVE = """(
  SELECT c.plate_id, c.seq, CASE WHEN c.k % 2 = 0 THEN 0e0 ELSE 2e0 END AS t, b.u AS old_u, b.v AS old_v, c.u AS new_u, c.v AS new_v
  FROM (SELECT * FROM f_edits WHERE op = 'click' QUALIFY row_number() OVER (PARTITION BY plate_id, k % 2 ORDER BY seq DESC) = 1) c JOIN f_base b ON b.plate_id = c.plate_id AND b.point_idx = 0)"""
# Time 0 shows the base; time 2, past every frame, shows the earliest frame.
_MOVED = f"""(
  SELECT m.plate_id, m.seq, m.t, s.point_idx,
         CASE WHEN s.point_idx = h.hit THEN m.new_u ELSE s.u END AS u, CASE WHEN s.point_idx = h.hit THEN m.new_v ELSE s.v END AS v
  FROM {_MOVE} m
  JOIN (SELECT plate_id, 0e0 AS t, point_idx, u, v FROM f_base
        UNION ALL SELECT k.plate_id, 2e0, k.point_idx, k.u, k.v FROM f_kf k JOIN f_ends e ON e.plate_id = k.plate_id AND e.s0 = k.kf_seq
       ) s ON s.plate_id = m.plate_id AND s.t = m.t
  LEFT JOIN (
    SELECT m.plate_id, m.t, min(s.point_idx) AS hit FROM {_MOVE} m
    JOIN (SELECT plate_id, 0e0 AS t, point_idx, u, v FROM f_base
          UNION ALL SELECT k.plate_id, 2e0, k.point_idx, k.u, k.v FROM f_kf k JOIN f_ends e ON e.plate_id = k.plate_id AND e.s0 = k.kf_seq
         ) s ON s.plate_id = m.plate_id AND s.t = m.t AND s.u = m.old_u AND s.v = m.old_v
    GROUP BY m.plate_id, m.t) h ON h.plate_id = m.plate_id AND h.t = m.t)"""


@query("edit_move_point", _state_sql(
    f"""SELECT * FROM f_base WHERE plate_id NOT IN (SELECT plate_id FROM {_MOVED} WHERE t = 0)
        UNION ALL SELECT plate_id, point_idx, u, v FROM {_MOVED} WHERE t = 0""",
    f"""SELECT * FROM f_kf UNION ALL
        SELECT m.plate_id, x.top + 1 + m.seq, m.t, m.point_idx, m.u, m.v FROM {_MOVED} m
        JOIN (SELECT plate_id, max(kf_seq) AS top FROM f_kf GROUP BY plate_id) x ON x.plate_id = m.plate_id WHERE m.t <> 0"""))
def _(t):
    return _state(E.move_point(t.base, t.keyframes, _moves(t)))


@query("edit_add_keyframe", _state_sql(
    "SELECT * FROM f_base",
    """SELECT * FROM f_kf UNION ALL
       SELECT k.plate_id, x.top + 1 + p.seq, k.time + p.nth * 0.1e0, k.point_idx, k.u, k.v
       FROM f_kf k JOIN f_ends e ON e.plate_id = k.plate_id AND e.s1 = k.kf_seq
       JOIN (SELECT plate_id, seq, row_number() OVER (PARTITION BY plate_id ORDER BY seq) AS nth
             FROM f_edits WHERE op = 'purchase') p ON p.plate_id = k.plate_id
       JOIN (SELECT plate_id, max(kf_seq) AS top FROM f_kf GROUP BY plate_id) x ON x.plate_id = k.plate_id"""))
def _(t):
    return _state(E.add_keyframe(t.base, t.keyframes, t.edits.where("op = 'purchase'")))


@query("edit_delete_keyframe", f"""
  SELECT plate_id, kf_seq, {r('time', 'time', 9)}, point_idx, {rs('u', 'v')} FROM f_kf
  WHERE NOT EXISTS (SELECT 1 FROM f_edits e WHERE e.op = 'error' AND e.plate_id = f_kf.plate_id AND e.seq = f_kf.kf_seq)""")
def _(t):
    gone = t.edits.where("op = 'error'").select("plate_id", F.col("seq").alias("kf_seq"))
    return rounded(rounded(E.delete_keyframe(t.keyframes, gone), "u", "v"), "time", digits=9)


@query("edit_retime_keyframe", f"""
  SELECT k.plate_id, k.kf_seq, {r("CASE WHEN e.op = 'view' THEN e.k / 100e0 ELSE k.time END", 'time', 9)}, k.point_idx,
         {r('k.u', 'u')}, {r('k.v', 'v')}
  FROM f_kf k JOIN f_edits e ON e.plate_id = k.plate_id AND e.seq = k.kf_seq""")
def _(t):
    edits = t.edits.where("op = 'view'").select(
        "plate_id", "seq", F.col("seq").alias("kf_seq"), (F.col("k") / 100.0).alias("time")
    )
    return rounded(rounded(E.retime_keyframe(t.keyframes, edits), "u", "v"), "time", digits=9)


@query("edit_set_coordinate", _state_sql(
    """SELECT b.plate_id, b.point_idx, CASE WHEN b.point_idx = 0 THEN coalesce(s.u, b.u) ELSE b.u END AS u, b.v
       FROM f_base b LEFT JOIN (SELECT plate_id, arg_max(u, seq) AS u FROM f_edits WHERE op = 'signup' GROUP BY plate_id) s ON s.plate_id = b.plate_id""",
    """SELECT k.plate_id, k.kf_seq, k.time, k.point_idx, k.u,
              CASE WHEN e.op = 'click' AND k.point_idx = 1 THEN e.k / 50e0 ELSE k.v END AS v
       FROM f_kf k JOIN f_edits e ON e.plate_id = k.plate_id AND e.seq = k.kf_seq"""))
def _(t):
    on_base = t.edits.where("op = 'signup'").select(
        "plate_id", "seq", F.lit(None).cast("bigint").alias("kf_seq"), F.lit(0).alias("point_idx"),
        F.lit("u").alias("axis"), F.col("u").alias("value"),
    )
    on_frames = t.edits.where("op = 'click'").select(
        "plate_id", "seq", F.col("seq").alias("kf_seq"), F.lit(1).alias("point_idx"),
        F.lit("v").alias("axis"), (F.col("k") / 50.0).alias("value"),
    )
    return _state(E.set_coordinate(t.base, t.keyframes, on_base.unionByName(on_frames)))


def first_state(t):
    """Two points and one frame of each plate, from its first event."""
    first = t.edits.groupBy("plate_id").agg(F.min("seq").alias("kf_seq"))
    return t.base, t.keyframes.join(first, ["plate_id", "kf_seq"])


def edit_log(t, events=None):
    """Every event as an edit of the log; a plate's first event, which made its first state, too.

    Frames named are the first one and the plate's first added one, which may not be there yet, or no more.
    """
    added = F.min(F.when(F.col("op") == "purchase", F.col("seq")))
    first = t.edits.groupBy("plate_id").agg(F.min("seq").alias("first"), added.alias("added"))
    k, op = F.col("k"), F.col("op")
    number = lambda when, value: F.when(when, value)
    error, drop = op == "error", (op == "error") & (k % 5 == 0)
    kind = F.when(op == "signup", "append").when(drop, "drop").when(error, "delete").when(op == "click", "move")
    kind = kind.when(op == "purchase", "add").otherwise("retime")
    made = F.col("first") + 1 + F.col("added")
    frame = F.when(k % 4 == 1, F.col("first")).when((k % 2 == 1) | (op == "view") | drop, made)
    return (t.edits if events is None else events).join(first, "plate_id").select(
        "plate_id", "seq", kind.alias("op"), frame.alias("kf_seq"),
        number(error | (op == "click"), k % 7).alias("point_idx"),
        number(op.isin("purchase", "view"), k / 100.0).alias("time"),
        number(op.isin("signup", "click") & (k % 3 != 1), F.col("u")).alias("u"),
        number(op.isin("signup", "click") & ((k % 3 != 2) | (op == "signup")), F.col("v")).alias("v"),
    ).withColumn("u", F.when(F.col("op") == "append", F.coalesce("u", F.lit(0.5))).otherwise(F.col("u")))


_LOG_SQL = """(
  SELECT *, row_number() OVER (PARTITION BY plate_id ORDER BY seq) AS n FROM (
    SELECT plate_id, seq, time, k,
           CASE op WHEN 'signup' THEN 'append' WHEN 'error' THEN CASE WHEN k % 5 = 0 THEN 'drop' ELSE 'delete' END
                   WHEN 'click' THEN 'move' WHEN 'purchase' THEN 'add' ELSE 'retime' END AS kind,
           CASE WHEN k % 4 = 1 THEN first WHEN k % 2 = 1 OR op = 'view' OR (op = 'error' AND k % 5 = 0) THEN first + 1 + added END AS frame,
           first + 1 + seq AS fresh, k % 7 AS idx, k / 100e0 AS at,
           CASE WHEN k % 3 <> 1 THEN u WHEN op = 'signup' THEN 0.5e0 END AS u, CASE WHEN k % 3 <> 2 OR op = 'signup' THEN v END AS v
    FROM f_edits JOIN (SELECT plate_id, min(seq) AS first, min(seq) FILTER (WHERE op = 'purchase') AS added FROM f_edits GROUP BY plate_id) USING (plate_id)))"""
# A plain loop: one edit of every plate per step, on whole lists.
_PUT = "list_transform({0}, lambda p, i: CASE WHEN i = e.idx + 1 THEN {{'u': coalesce(e.u, p.u), 'v': coalesce(e.v, p.v)}} ELSE p END)"
_CUT = "({0}[1:e.idx] || {0}[e.idx + 2:])"
_EDIT_REPLAY_SQL = f"""
  WITH RECURSIVE logged AS {_LOG_SQL},
  state AS (
    SELECT b.plate_id, 0::BIGINT AS n, b.pts, [{{'kf': k.kf_seq, 'time': k.time, 'pts': b.pts}}] AS frames
    FROM (SELECT plate_id, list({{'u': u, 'v': v}} ORDER BY point_idx) AS pts FROM f_base GROUP BY plate_id) b
    JOIN (SELECT plate_id, min(kf_seq) AS kf_seq, arg_min(time, kf_seq) AS time FROM f_kf GROUP BY plate_id) k USING (plate_id)
    UNION ALL
    SELECT s.plate_id, s.n + 1,
      CASE WHEN e.kind = 'append' THEN list_append(s.pts, {{'u': e.u, 'v': e.v}}) WHEN e.kind = 'delete' THEN {_CUT.format('s.pts')}
           WHEN e.kind = 'move' AND e.frame IS NULL THEN {_PUT.format('s.pts')} ELSE s.pts END,
      CASE WHEN e.kind = 'append' THEN list_transform(s.frames, lambda f: {{'kf': f.kf, 'time': f.time, 'pts': list_append(f.pts, {{'u': e.u, 'v': e.v}})}})
           WHEN e.kind = 'delete' THEN list_transform(s.frames, lambda f: {{'kf': f.kf, 'time': f.time, 'pts': {_CUT.format('f.pts')}}})
           WHEN e.kind = 'move' THEN list_transform(s.frames, lambda f: CASE WHEN f.kf = e.frame
             THEN {{'kf': f.kf, 'time': f.time, 'pts': {_PUT.format('f.pts')}}} ELSE f END)
           WHEN e.kind = 'add' THEN list_append(s.frames, {{'kf': e.fresh, 'time': e.at, 'pts': s.pts}})
           WHEN e.kind = 'retime' THEN list_transform(s.frames, lambda f: CASE WHEN f.kf = e.frame THEN {{'kf': f.kf, 'time': e.at, 'pts': f.pts}} ELSE f END)
           WHEN e.kind = 'drop' THEN list_filter(s.frames, lambda f: f.kf IS DISTINCT FROM e.frame) END
    FROM state s JOIN logged e ON e.plate_id = s.plate_id AND e.n = s.n + 1),
  done AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY plate_id ORDER BY n DESC) = 1),
  lists AS (SELECT plate_id, unnest(list_append(frames, {{'kf': -1, 'time': 0e0, 'pts': pts}})) AS f FROM done),
  rows AS (SELECT plate_id, f.kf AS kf_seq, f.time AS time, unnest(f.pts) AS p, unnest(range(0, len(f.pts))) AS i FROM lists)
  SELECT plate_id, kf_seq, {r('time', 'time', 9)}, i::INT AS point_idx, {r('p.u', 'u')}, {r('p.v', 'v')} FROM rows"""


@query("edit_replay", _EDIT_REPLAY_SQL)
def _(t):
    return _state(RP.replay(*first_state(t), edit_log(t)))


@query("stream_replay", _EDIT_REPLAY_SQL)
def _(t):
    # As they arrive: one file, and batch, per stretch of time, in no order.
    log = edit_log(t).join(t.edits.select("seq", "ts"), "seq")
    arrived, out = scratch_path(t.spark, "log"), scratch_path(t.spark, "states")
    log.repartitionByRange(4, "ts").write.parquet(arrived)
    stream = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    SR.run_replay_stream(stream, *first_state(t), out, scratch_path(t.spark, "replay"))
    return _state(SR.read_state(t.spark, out))


@query("stream_keyframes", f"""
  SELECT plate_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS frame_start, max(seq) AS seq,
         {r('arg_max(u, seq)', 'u')}, {r('arg_max(v, seq)', 'v')}, count(*) AS n_edits
  FROM f_edits GROUP BY plate_id, date_trunc('day', ts)""")
def _(t):
    events = ST.edit_stream(t.spark, t.folder, "events.parquet")
    edits = events.select(
        F.col("user_id").alias("plate_id"), F.col("event_id").alias("seq"), utc_instant("ts").alias("ts"),
        (F.col("value") / 500.0).alias("u"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("v"),
    )
    out = scratch_path(t.spark, "frames")
    ST.run_keyframe_stream(edits, out, scratch_path(t.spark, "stream"))
    frames = ST.read_keyframes(t.spark, out).withColumn("frame_start", utc_day("frame_start"))
    return rounded(frames, "u", "v")
