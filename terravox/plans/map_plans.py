"""Queries on trajectories, target maps and recorded logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.functions.geometry import AXES
from terravox.operators.folds import accepted, numbered
from terravox.operators.graph import components
from terravox.shared import written
from terravox.sources.tables import PTS_EV, PTS_LI, event_points, lineitem_points, table

BY_ROBOT = "PARTITION BY robot ORDER BY sec, pid"


def _views(spark, sf_dir):
    return lineitem_points(spark, sf_dir).groupBy("segment", "view").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in AXES])


SQL_VIEWS = "vw AS (SELECT segment, view, count(*) n, avg(x) x, avg(y) y, avg(z) z FROM pts GROUP BY 1, 2)"


def last_view(spark, sf_dir):
    last = _views(spark, sf_dir).groupBy("segment").agg(F.max_by(F.struct("view", "n", *AXES), "view").alias("l"))
    return last.select("segment", "l.view", "l.n", *[F.round(f"l.{a}", 4).alias(a) for a in AXES])


LAST_VIEW = f"WITH {PTS_LI}, {SQL_VIEWS} SELECT segment, view, n, round(x, 4) x, round(y, 4) y, round(z, 4) z FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY view DESC) r FROM vw) WHERE r = 1"


def remove_irrelevant(spark, sf_dir):
    """Views without those smaller than half the last view of their segment."""
    views = _views(spark, sf_dir)
    last = F.max_by("n", "view").over(Window.partitionBy("segment"))
    return views.withColumn("ratio", F.col("n") / last).filter("ratio >= 0.5").select("segment", "view", F.round("ratio", 6).alias("ratio"))


IRRELEVANT = f"WITH {PTS_LI}, {SQL_VIEWS} SELECT segment, view, round(ratio, 6) ratio FROM (SELECT segment, view, n / arg_max(n, view) OVER (PARTITION BY segment) ratio FROM vw) WHERE ratio >= 0.5"


def remove_unchanged(spark, sf_dir):
    """Views at least a tenth larger than the last one kept."""
    views = _views(spark, sf_dir).select("segment", "view", "n")
    return accepted(views, "segment", ["view"], "n", lambda n, last: n >= 1.1 * last)


UNCHANGED = f"""
WITH RECURSIVE {PTS_LI}, o AS (SELECT segment, view, count(*) n, row_number() OVER (PARTITION BY segment ORDER BY view) r FROM pts GROUP BY 1, 2),
f AS (SELECT segment, view, n, r, n last, TRUE kept FROM o WHERE r = 1 UNION ALL
      SELECT o.segment, o.view, o.n, o.r, CASE WHEN o.n >= CAST(1.1 AS DOUBLE) * f.last THEN o.n ELSE f.last END, o.n >= CAST(1.1 AS DOUBLE) * f.last FROM f JOIN o ON o.segment = f.segment AND o.r = f.r + 1)
SELECT segment, view, n FROM f WHERE kept
"""


def drove_enough_gate(spark, sf_dir):
    """Poses more than ten apart from the last accepted pose of their robot."""
    poses = event_points(spark, sf_dir).select("robot", "sec", "pid", "x")
    return accepted(poses, "robot", ["sec", "pid"], "x", lambda x, last: abs(x - last) > 10).select("robot", "pid")


GATE = f"""
WITH RECURSIVE {PTS_EV}, o AS (SELECT robot, pid, x, row_number() OVER ({BY_ROBOT}) r FROM pts),
f AS (SELECT robot, pid, x, r, x last, TRUE kept FROM o WHERE r = 1 UNION ALL
      SELECT o.robot, o.pid, o.x, o.r, CASE WHEN abs(o.x - f.last) > 10 THEN o.x ELSE f.last END, abs(o.x - f.last) > 10 FROM f JOIN o ON o.robot = f.robot AND o.r = f.r + 1)
SELECT robot, pid FROM f WHERE kept
"""


def run_sessionize(spark, sf_dir):
    """Runs of equal kinds in each robot's log."""
    w = Window.partitionBy("robot").orderBy("sec", "pid")
    new = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)), 0).otherwise(1)
    runs = event_points(spark, sf_dir).withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("robot", "run").agg(F.min("kind").alias("kind"), F.count("*").alias("n"), F.min("sec").alias("first_sec"))


SESSIONS = f"WITH {PTS_EV}, a AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER ({BY_ROBOT}) THEN 0 ELSE 1 END new FROM pts), b AS (SELECT *, CAST(sum(new) OVER ({BY_ROBOT}) AS BIGINT) run FROM a) SELECT robot, run, min(kind) kind, count(*) n, min(sec) first_sec FROM b GROUP BY 1, 2"


def most_frequent(spark, sf_dir):
    """The most frequent kind of each robot; the smallest wins ties."""
    counts = event_points(spark, sf_dir).groupBy("robot", "kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy("robot").orderBy(F.desc("n"), "kind")
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("robot", "kind", "n")


FREQUENT = f"WITH {PTS_EV} SELECT robot, kind, n FROM (SELECT robot, kind, count(*) n, row_number() OVER (PARTITION BY robot ORDER BY count(*) DESC, kind) r FROM pts GROUP BY 1, 2) WHERE r = 1"


def closest_pose_argmin(spark, sf_dir):
    """The pose of each robot nearest to the mean of its poses; the earliest wins ties."""
    points = event_points(spark, sf_dir)
    mean = points.groupBy("robot").agg(F.round(F.avg("x"), 3).alias("mx"), F.round(F.avg("y"), 3).alias("my"))
    d2 = F.round((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")), 4)
    best = points.join(mean, "robot").withColumn("d2", d2).groupBy("robot").agg(F.min(F.struct("d2", "sec", "pid")).alias("b"))
    return best.select("robot", "b.pid", "b.d2")


ARGMIN = f"""
WITH {PTS_EV}, m AS (SELECT robot, round(avg(x), 3) mx, round(avg(y), 3) my FROM pts GROUP BY 1), d AS (SELECT robot, sec, pid, round((x - mx) * (x - mx) + (y - my) * (y - my), 4) d2 FROM pts JOIN m USING (robot))
SELECT robot, pid, d2 FROM (SELECT *, row_number() OVER (PARTITION BY robot ORDER BY d2, sec, pid) r FROM d) WHERE r = 1
"""


def nearest_pose_interval(spark, sf_dir):
    """For each purchase, the pose of its robot within six hours that is nearest in space.

    An interval join on time buckets of the interval's length: each purchase meets three buckets.
    """
    reach = 6 * 3600
    points = event_points(spark, sf_dir)
    asked = points.filter("kind = 'purchase'").select("robot", F.col("pid").alias("query"), F.col("sec").alias("qs"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("qs") / reach) - 1, F.floor(F.col("qs") / reach) + 1)))
    poses = points.select("robot", "pid", "sec", "x", "y", F.floor(F.col("sec") / reach).alias("bucket"))
    near = asked.join(poses, ["robot", "bucket"]).filter(f"query <> pid AND abs(qs - sec) <= {reach}")
    d2 = F.round((F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy")), 4)
    best = near.withColumn("d2", d2).groupBy("query").agg(F.min(F.struct("d2", "sec", "pid")).alias("b"))
    return best.select("query", "b.pid", "b.d2")


INTERVAL = f"""
WITH {PTS_EV}, d AS (SELECT a.pid AS query, b.pid, b.sec, round((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), 4) d2 FROM pts a JOIN pts b ON a.robot = b.robot AND a.pid <> b.pid AND abs(a.sec - b.sec) <= 21600 WHERE a.kind = 'purchase')
SELECT query, pid, d2 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, sec, pid) r FROM d) WHERE r = 1
"""


def log_cut(spark, sf_dir):
    """A time range of the log: ten days from the second day on, counted from the first message."""
    points = event_points(spark, sf_dir)
    start = points.agg(F.min("sec").alias("t0"))
    return points.crossJoin(F.broadcast(start)).filter("sec BETWEEN t0 + 86400 AND t0 + 950400").select("pid", "sec")


def log_offset(spark, sf_dir):
    """Every message an hour later."""
    return event_points(spark, sf_dir).select("pid", (F.col("sec") + 3600).alias("sec"))


def log_prefix(spark, sf_dir):
    """Topics below a prefix; absolute names stay absolute."""
    kind = F.when(F.col("kind").startswith("/"), F.concat(F.lit("/robot"), F.col("kind"))).otherwise(F.concat(F.lit("robot/"), F.col("kind")))
    return event_points(spark, sf_dir).select("pid", kind.alias("topic"))


def merge_chain_resolve(spark, sf_dir):
    """Merge events replayed: ids that were merged, directly or not, take the smallest id. An order merges its id into its customer's."""
    merges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return components(merges.filter("src <> dst"))


#: The label of a node is lowered until nothing changes; one row per node is kept.
MERGES = """
WITH RECURSIVE u AS (SELECT o_custkey s, o_orderkey d FROM orders WHERE o_custkey <> o_orderkey UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <> o_orderkey),
r(n, l) USING KEY (n) AS (SELECT s, min(s) FROM u GROUP BY 1 UNION SELECT u.d, min(r.l) FROM r JOIN u ON u.s = r.n JOIN recurring.r k ON k.n = u.d WHERE r.l < k.l GROUP BY 1)
SELECT n node, l component FROM r
"""


def target_upsert(spark, sf_dir):
    """A target map of the first three views, upserted with the others: a view joins if the segment is new or it is a tenth larger than the last."""
    views = _views(spark, sf_dir).select("segment", "view", "n")
    target = views.filter("view <= 3").groupBy("segment").agg(F.max_by("n", "view").alias("n_old"), F.max("view").alias("view_old"))
    source = views.filter("view > 3").groupBy("segment").agg(F.max_by("n", "view").alias("n_new"), F.max("view").alias("view_new"))
    both = target.join(source, "segment", "full")
    action = F.when(F.col("n_new").isNull(), "kept").when(F.col("n_old").isNull(), "inserted").when(F.col("n_new") >= 1.1 * F.col("n_old"), "appended").otherwise("refreshed")
    fresh = action.isin("inserted", "appended")
    return both.select("segment", action.alias("action"), F.when(fresh, F.col("n_new")).otherwise(F.col("n_old")).alias("n"), F.when(action == "kept", F.col("view_old")).otherwise(F.col("view_new")).alias("view"))


UPSERT = f"""
WITH {PTS_LI}, {SQL_VIEWS}, t AS (SELECT segment, arg_max(n, view) n_old, max(view) view_old FROM vw WHERE view <= 3 GROUP BY 1), s AS (SELECT segment, arg_max(n, view) n_new, max(view) view_new FROM vw WHERE view > 3 GROUP BY 1),
b AS (SELECT *, CASE WHEN n_new IS NULL THEN 'kept' WHEN n_old IS NULL THEN 'inserted' WHEN n_new >= CAST(1.1 AS DOUBLE) * n_old THEN 'appended' ELSE 'refreshed' END action FROM t FULL JOIN s USING (segment))
SELECT segment, action, CASE WHEN action IN ('inserted', 'appended') THEN n_new ELSE n_old END n, CASE WHEN action = 'kept' THEN view_old ELSE view_new END AS view FROM b
"""


def delete_renamed(spark, sf_dir):
    """Segments without those that a rename log deletes."""
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select((F.col("o_custkey")).alias("segment"))
    return lineitem_points(spark, sf_dir).join(gone, "segment", "left_anti").groupBy("segment").agg(F.count("*").alias("n"))


def keep_listed(spark, sf_dir):
    """Only segments that a list names."""
    kept = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select((F.col("o_custkey")).alias("segment"))
    return lineitem_points(spark, sf_dir).join(kept, "segment", "left_semi").groupBy("segment").agg(F.count("*").alias("n"))


def reproject_segments(spark, sf_dir):
    """Centroids of last views moved by the difference of an old and a corrected pose, joined by view."""
    views = _views(spark, sf_dir)
    last = views.groupBy("segment").agg(F.max_by(F.struct("view", *AXES), "view").alias("l")).select("segment", "l.*")
    poses = views.groupBy("view").agg(F.round(F.avg("x"), 2).alias("px"), F.round(F.avg("y"), 2).alias("py"))
    moved = last.join(poses, "view")
    return moved.select("segment", "view", F.round(F.col("x") - F.col("px") + 1, 4).alias("x"), F.round(F.col("y") - F.col("py") - 1, 4).alias("y"), F.round("z", 4).alias("z"))


REPROJECT = f"""
WITH {PTS_LI}, {SQL_VIEWS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY view DESC) r FROM vw) WHERE r = 1), p AS (SELECT view, round(avg(x), 2) px, round(avg(y), 2) py FROM vw GROUP BY 1)
SELECT segment, view, round(x - px + 1, 4) x, round(y - py - 1, 4) y, round(z, 4) z FROM l JOIN p USING (view)
"""

def loop_closure_endpoints(spark, sf_dir):
    """Per robot the closure between its last purchase and its most frequent earlier hour of day.

    Matches of a robot vote by the hour of their target pose (ties: the earliest); the endpoint on the target side is the pose within
    that hour, at least a day before the last purchase, that lies nearest to it in space.
    """
    points = event_points(spark, sf_dir)
    last = points.filter("kind = 'purchase'").groupBy("robot").agg(F.max(F.struct("sec", "pid", "x", "y")).alias("s"))
    old = points.join(last, "robot").filter("sec <= s.sec - 86400").withColumn("hour", F.floor(F.pmod("sec", F.lit(86400)) / 3600).cast("long"))
    votes = old.groupBy("robot", "hour").agg(F.count("*").alias("n"))
    mode = votes.groupBy("robot").agg(F.min(F.struct((-F.col("n")).alias("m"), "hour")).alias("v")).select("robot", F.col("v.hour").alias("hour"))
    d2 = F.round((F.col("x") - F.col("s.x")) * (F.col("x") - F.col("s.x")) + (F.col("y") - F.col("s.y")) * (F.col("y") - F.col("s.y")), 4)
    near = old.join(mode, ["robot", "hour"]).groupBy("robot").agg(F.min(F.struct(d2.alias("d2"), "sec", "pid")).alias("t"), F.first("s.pid").alias("source"))
    return near.select("robot", "source", F.col("t.pid").alias("target"), F.col("t.d2").alias("d2"))


CLOSURES = f"""
WITH {PTS_EV}, l AS (SELECT * FROM (SELECT robot, sec ls, pid source, x lx, y ly, row_number() OVER (PARTITION BY robot ORDER BY sec DESC, pid DESC) r FROM pts WHERE kind = 'purchase') WHERE r = 1),
o AS (SELECT robot, source, pid, sec, CAST(floor((sec % 86400) / 3600) AS BIGINT) AS hod, round((x - lx) * (x - lx) + (y - ly) * (y - ly), 4) d2 FROM pts JOIN l USING (robot) WHERE sec <= ls - 86400),
m AS (SELECT robot, hod FROM (SELECT robot, hod, row_number() OVER (PARTITION BY robot ORDER BY count(*) DESC, hod) r FROM o GROUP BY 1, 2) WHERE r = 1)
SELECT robot, source, target, d2 FROM (SELECT robot, source, pid target, d2, row_number() OVER (PARTITION BY robot ORDER BY d2, sec, pid) r FROM o JOIN m USING (robot, hod)) WHERE r = 1
"""


def combine_sequences(spark, sf_dir):
    """Views of merged segments behind those of the segment that takes them in, with a running count of their points.

    The merge log is that of the returned orders: the customer's segment goes into the order's, along whole chains.
    """
    views = _views(spark, sf_dir).select("segment", "view", "n")
    log = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_custkey <> o_orderkey").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    family = components(log).withColumnRenamed("node", "segment")
    joined = views.join(family, "segment", "left").withColumn("family", F.coalesce("component", "segment"))
    w = Window.partitionBy("family").orderBy("segment", "view")
    return joined.select("family", "segment", "view", F.row_number().over(w).cast("long").alias("new_view"), F.sum("n").over(w).alias("points_so_far"))


COMBINE = f"""
WITH RECURSIVE {PTS_LI}, {SQL_VIEWS}, m AS (SELECT o_custkey s, o_orderkey d FROM orders WHERE o_orderstatus = 'P' AND o_custkey <> o_orderkey), u AS (SELECT s, d FROM m UNION SELECT d, s FROM m),
r(n, l) USING KEY (n) AS (SELECT s, min(s) FROM u GROUP BY 1 UNION SELECT u.d, min(r.l) FROM r JOIN u ON u.s = r.n JOIN recurring.r k ON k.n = u.d WHERE r.l < k.l GROUP BY 1)
SELECT family, segment, view, row_number() OVER w new_view, CAST(sum(n) OVER w AS BIGINT) points_so_far FROM (SELECT vw.segment, vw.view, vw.n, coalesce(r.l, vw.segment) family FROM vw LEFT JOIN r ON r.n = vw.segment) WINDOW w AS (PARTITION BY family ORDER BY segment, view)
"""


def centroids_within_radius(spark, sf_dir):
    """Last-view centroids of segments whose pose then lay within a distance of a place."""
    views = _views(spark, sf_dir)
    poses = views.groupBy("view").agg(F.round(F.avg("x"), 2).alias("px"), F.round(F.avg("y"), 2).alias("py"))
    last = views.groupBy("segment").agg(F.max_by(F.struct("view", *AXES), "view").alias("l")).select("segment", "l.*").join(poses, "view")
    near = last.filter("(px - 25.4) * (px - 25.4) + (py - 26.5) * (py - 26.5) <= 0.09")
    return near.select("segment", "view", *[F.round(a, 4).alias(a) for a in AXES])


WITHIN = f"""
WITH {PTS_LI}, {SQL_VIEWS}, p AS (SELECT view, round(avg(x), 2) px, round(avg(y), 2) py FROM vw GROUP BY 1), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY view DESC) r FROM vw) WHERE r = 1)
SELECT segment, view, round(x, 4) x, round(y, 4) y, round(z, 4) z FROM l JOIN p USING (view) WHERE (px - 25.4::DOUBLE) * (px - 25.4::DOUBLE) + (py - 26.5::DOUBLE) * (py - 26.5::DOUBLE) <= 0.09::DOUBLE
"""


def log_without_frame(spark, sf_dir):
    """Messages, each a robot's list of transforms of a day, without those of one frame; messages left empty go."""
    messages = event_points(spark, sf_dir).groupBy("robot", F.floor(F.col("sec") / 86400).alias("day")).agg(F.sort_array(F.collect_list("kind")).alias("frames"))
    left = messages.withColumn("left", F.filter("frames", lambda f: f != "purchase")).filter(F.size("left") > 0)
    return left.select("robot", "day", F.array_join("left", ",").alias("frames"))


WITHOUT = f"WITH {PTS_EV} SELECT robot, sec // 86400 AS day, string_agg(kind, ',' ORDER BY kind) frames FROM pts WHERE kind <> 'purchase' GROUP BY 1, 2"


def dataset_load(spark, sf_dir):
    """A data set in its fixed order of steps: views, without irrelevant and unchanged ones, classes of two views or more numbered without gaps."""
    views = remove_irrelevant(spark, sf_dir).join(_views(spark, sf_dir).select("segment", "view", "n"), ["segment", "view"]).select("segment", "view", "n")
    kept = written(accepted(views, "segment", ["view"], "n", lambda n, last: n >= 1.1 * last), "views")
    classes = numbered(kept.groupBy("segment").agg(F.count("*").alias("views")).filter("views >= 2").select("segment"), ["segment"], "class")
    return kept.join(classes, "segment").select("segment", "view", "n", (F.col("class") - 1).alias("class"))


DATASET = f"""
WITH RECURSIVE {PTS_LI}, {SQL_VIEWS}, i AS (SELECT segment, view, n, n / arg_max(n, view) OVER (PARTITION BY segment) ratio FROM vw), o AS (SELECT segment, view, n, row_number() OVER (PARTITION BY segment ORDER BY view) r FROM i WHERE ratio >= 0.5),
f AS (SELECT segment, view, n, r, n last, TRUE kept FROM o WHERE r = 1 UNION ALL
      SELECT o.segment, o.view, o.n, o.r, CASE WHEN o.n >= CAST(1.1 AS DOUBLE) * f.last THEN o.n ELSE f.last END, o.n >= CAST(1.1 AS DOUBLE) * f.last FROM f JOIN o ON o.segment = f.segment AND o.r = f.r + 1),
c AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS class FROM f WHERE kept GROUP BY 1 HAVING count(*) >= 2)
SELECT segment, view, n, class FROM f JOIN c USING (segment) WHERE kept
"""


def map_union(spark, sf_dir):
    """One map upserted into another: a segment of both keeps the views of both, the incoming map's in place of equal ones."""
    views = _views(spark, sf_dir).select("segment", "view", "n")
    left, right = views.filter("view <= 4 AND segment % 3 <> 0"), views.filter("view >= 4 AND segment % 5 <> 0").withColumn("n", -F.col("n"))
    rest = left.join(right.select("segment", "view"), ["segment", "view"], "left_anti")
    return rest.unionByName(right).groupBy("segment").agg(F.count("*").alias("views"), F.sum("n").alias("n"), F.max("view").alias("last"))


MAP_UNION = f"""
WITH {PTS_LI}, {SQL_VIEWS}, a AS (SELECT * FROM vw WHERE view <= 4 AND segment % 3 <> 0), b AS (SELECT segment, view, -n n FROM vw WHERE view >= 4 AND segment % 5 <> 0),
u AS (SELECT segment, view, n FROM a ANTI JOIN b USING (segment, view) UNION ALL SELECT segment, view, n FROM b)
SELECT segment, count(*) AS views, CAST(sum(n) AS BIGINT) n, max(view) AS last FROM u GROUP BY 1
"""

PACK = {
    "centroids_within_radius": (centroids_within_radius, WITHIN),
    "log_without_frame": (log_without_frame, WITHOUT),
    "dataset_load": (dataset_load, DATASET),
    "map_union": (map_union, MAP_UNION),
    "loop_closure_endpoints": (loop_closure_endpoints, CLOSURES),
    "combine_sequences": (combine_sequences, COMBINE),
    "last_view": (last_view, LAST_VIEW),
    "remove_irrelevant": (remove_irrelevant, IRRELEVANT),
    "remove_unchanged": (remove_unchanged, UNCHANGED),
    "drove_enough_gate": (drove_enough_gate, GATE),
    "run_sessionize": (run_sessionize, SESSIONS),
    "most_frequent": (most_frequent, FREQUENT),
    "closest_pose_argmin": (closest_pose_argmin, ARGMIN),
    "nearest_pose_interval": (nearest_pose_interval, INTERVAL),
    "log_cut": (log_cut, f"WITH {PTS_EV} SELECT pid, sec FROM pts, (SELECT min(sec) t0 FROM pts) WHERE sec BETWEEN t0 + 86400 AND t0 + 950400"),
    "log_offset": (log_offset, f"WITH {PTS_EV} SELECT pid, sec + 3600 sec FROM pts"),
    "log_prefix": (log_prefix, f"WITH {PTS_EV} SELECT pid, CASE WHEN starts_with(kind, '/') THEN '/robot' || kind ELSE 'robot/' || kind END topic FROM pts"),
    "merge_chain_resolve": (merge_chain_resolve, MERGES),
    "target_upsert": (target_upsert, UPSERT),
    "delete_renamed": (delete_renamed, f"WITH {PTS_LI} SELECT segment, count(*) n FROM pts WHERE segment NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"),
    "keep_listed": (keep_listed, f"WITH {PTS_LI} SELECT segment, count(*) n FROM pts WHERE segment IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"),
    "reproject_segments": (reproject_segments, REPROJECT),
}
