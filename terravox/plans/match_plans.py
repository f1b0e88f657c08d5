"""Queries on descriptors, candidate matches and their consistency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.operators.folds import numbered
from terravox.operators.graph import cliques, components, degrees
from terravox.operators.grouping import consensus_groups, greedy_groups
from terravox.operators.hulls import convex_hulls, overlap, shared
from terravox.operators.neighbours import nearest, range_join
from terravox.operators.pivots import nearest_join
from terravox.operators.rigid import fitted
from terravox.shared import written
from terravox.ship import ship
from terravox.sources.tables import PTS_EV, PTS_LI, descriptors, event_points, lineitem_points

K = 5
SQL_D2 = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]) * (a.embedding[i]::DOUBLE - b.embedding[i])))"


def _queries(found):
    """Query set: every descriptor whose id is divisible by 50."""
    return found.filter("id % 50 = 0")


def _knn_sql(where: str = "TRUE", k: int = K, asked: str = "a.vec_id % 50 = 0") -> str:
    return f"""
    SELECT query, target, round(d2, 5) d2, rank FROM (
      SELECT a.vec_id query, b.vec_id target, {SQL_D2} d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_D2}, b.vec_id) rank
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {asked} WHERE {where}) WHERE rank <= {k}"""


def _rounded(found):
    return found.select("query", "target", F.round("d2", 5).alias("d2"), F.col("rank").cast("long").alias("rank"))


def knn_candidates(spark, sf_dir):
    """The k nearest descriptors of each query."""
    found = descriptors(spark, sf_dir)
    return _rounded(nearest(found, _queries(found), K))


def knn_join(spark, sf_dir):
    """The k nearest other descriptors of every descriptor, by pivots and cells."""
    found = descriptors(spark, sf_dir)
    return _rounded(nearest_join(found, found, K).neighbours)


def knn_exclude_class(spark, sf_dir):
    """The same with an excluded class on both sides."""
    found = descriptors(spark, sf_dir).filter("label <> 1")
    return _rounded(nearest(found, _queries(found), K))


def knn_hard_threshold(spark, sf_dir):
    """Candidates by the first seven dimensions, kept if the whole vectors are close as well."""
    found = descriptors(spark, sf_dir)
    short = found.withColumn("vector", F.slice("vector", 1, 7))
    pairs = nearest(short, _queries(short), 20).drop("d2")
    a, b = (found.select(F.col("id").alias(n), F.col("vector").alias(v)) for n, v in (("query", "a"), ("target", "b")))
    d2 = F.aggregate(F.zip_with("a", "b", lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, t: s + t)
    return pairs.join(a, "query").join(b, "target").withColumn("d2", d2).filter("d2 <= 1.8").select("query", "target", F.round("d2", 5).alias("d2"), F.col("rank").cast("long").alias("rank"))


def _hard() -> str:
    short = SQL_D2.replace("len(a.embedding) + 1", "8")
    return f"""
    SELECT query, target, round(d2, 5) d2, rank FROM (
      SELECT a.vec_id query, b.vec_id target, {SQL_D2} d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {short}, b.vec_id) rank
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0) WHERE rank <= 20 AND d2 <= 1.8"""


def _compared(spark, sf_dir):
    """Candidate matches with the descriptors of both sides: query, target, a, b."""
    found = descriptors(spark, sf_dir)
    pairs = nearest(found, _queries(found), K).select("query", "target")
    a, b = (found.select(F.col("id").alias(n), F.col("vector").alias(v)) for n, v in (("query", "a"), ("target", "b")))
    return pairs.join(a, "query").join(b, "target")


SQL_COMPARED = f"k AS ({_knn_sql()}), c AS (SELECT k.query, k.target, a.embedding a, b.embedding b FROM k JOIN embeddings a ON a.vec_id = k.query JOIN embeddings b ON b.vec_id = k.target)"


def histogram_intersection(spark, sf_dir):
    """Sum of the smaller bins of both descriptors of each candidate match."""
    score = F.aggregate(F.zip_with("a", "b", lambda p, q: F.least(F.abs(p.cast("double")), F.abs(q.cast("double")))), F.lit(0.0), lambda s, t: s + t)
    return _compared(spark, sf_dir).select("query", "target", F.round(score, 5).alias("score"))


HISTOGRAM = f"WITH {SQL_COMPARED} SELECT query, target, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: least(abs(a[i]::DOUBLE), abs(b[i]::DOUBLE)))), 5) score FROM c"


def feature_distance(spark, sf_dir):
    """Absolute differences of both descriptors of each candidate match, one row per dimension."""
    gaps = F.zip_with("a", "b", lambda p, q: F.abs(p.cast("double") - q))
    flat = _compared(spark, sf_dir).select("query", "target", F.posexplode(gaps).alias("dim", "gap"))
    return flat.select("query", "target", F.col("dim").cast("long").alias("dim"), F.round("gap", 6).alias("gap"))


FEATURE_DISTANCE = f"WITH {SQL_COMPARED} SELECT query, target, unnest(range(0, len(a))) dim, round(unnest(list_transform(range(1, len(a) + 1), lambda i: abs(a[i]::DOUBLE - b[i]))), 6) gap FROM c"


def match_time_filter(spark, sf_dir):
    """Candidate matches kept if their tracks differ or their times are far apart; a segment was seen at the event of its id."""
    found = descriptors(spark, sf_dir)
    pairs = nearest(found, _queries(found), 20).select("query", "target")
    seen = event_points(spark, sf_dir).select("pid", "track", "sec")
    a, b = (seen.select(F.col("pid").alias(n), F.col("track").alias(f"{n}_track"), F.col("sec").alias(f"{n}_sec")) for n in ("query", "target"))
    return pairs.join(a, "query").join(b, "target").filter("query_track <> target_track OR abs(query_sec - target_sec) >= 864000").select("query", "target")


MATCH_TIME = f"WITH {PTS_EV}, k AS ({_knn_sql(k=20)}) SELECT k.query, k.target FROM k JOIN pts a ON a.pid = k.query JOIN pts b ON b.pid = k.target WHERE a.track <> b.track OR abs(a.sec - b.sec) >= 864000"


def recognize_lookups(spark, sf_dir):
    """Candidate matches with the source and target segments they name; a missing segment is an error."""
    found = descriptors(spark, sf_dir)
    pairs = written(nearest(found, _queries(found), K).select("query", "target", "rank"), "pairs")
    a, b = (found.select(F.col("id").alias(n), F.col("label").alias(f"{n}_label"), F.round(F.col("vector")[0].cast("double"), 6).alias(f"{n}_first")) for n in ("query", "target"))
    both = written(pairs.join(a, "query").join(b, "target"), "looked-up")
    if both.count() != pairs.count():
        raise ValueError("a match names a segment that is not there")
    return both.select("query", "target", F.col("rank").cast("long").alias("rank"), "query_label", "target_label", "query_first", "target_first")


LOOKUPS = f"WITH k AS ({_knn_sql()}) SELECT query, target, rank, a.label::BIGINT query_label, b.label::BIGINT target_label, round(a.embedding[1]::DOUBLE, 6) query_first, round(b.embedding[1]::DOUBLE, 6) target_first FROM k JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = target"


def update_match_centroids(spark, sf_dir):
    """Matches with their segments' new places; one whose segment is gone keeps the place it had."""
    cen = lineitem_points(spark, sf_dir).groupBy("segment").agg(F.round(F.avg("x"), 3).alias("x"))
    matches = cen.select(F.col("segment").alias("source"), (F.pmod(F.col("segment") * 31, F.lit(200)) + 1).alias("target"), F.lit(-1.0).alias("old"))
    fresh = cen.filter("segment % 3 <> 0").select("segment", (F.col("x") + 1).alias("new"))
    for side in ("source", "target"):
        matches = matches.join(fresh.withColumnsRenamed({"segment": side, "new": f"{side}_new"}), side, "left")
    return matches.select("source", "target", *[F.round(F.coalesce(f"{s}_new", "old"), 3).alias(f"{s}_x") for s in ("source", "target")])


UPDATE_MATCHES = f"WITH {PTS_LI}, c AS (SELECT segment, round(avg(x), 3) x FROM pts GROUP BY 1), m AS (SELECT segment source, segment * 31 % 200 + 1 target FROM c), f AS (SELECT segment, x + 1 n FROM c WHERE segment % 3 <> 0) SELECT source, target, round(coalesce(a.n, -1.0::DOUBLE), 3) source_x, round(coalesce(b.n, -1.0::DOUBLE), 3) target_x FROM m LEFT JOIN f a ON a.segment = source LEFT JOIN f b ON b.segment = target"


def _matches(spark, sf_dir):
    """Candidate matches: an event and the next of its robot, as scene and model positions."""
    w = Window.partitionBy("robot").orderBy("sec", "pid")
    nxt = lambda c: F.lead(c).over(w)
    points = event_points(spark, sf_dir)
    return points.select("pid", "robot", F.col("x").alias("sx"), F.col("y").alias("sy"), nxt("x").alias("mx"), nxt("y").alias("my")).filter("mx IS NOT NULL")


SQL_MATCHES = "mat AS (SELECT * FROM (SELECT pid, robot, x sx, y sy, lead(x) OVER w mx, lead(y) OVER w my FROM pts WINDOW w AS (PARTITION BY robot ORDER BY sec, pid)) WHERE mx IS NOT NULL)"
RES = 1.0
SQL_CONSISTENT = f"abs(sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy)) - sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my))) <= {RES}"


def _edges(spark, sf_dir, capped: bool):
    """Consistent pairs of matches of one robot in the same or a neighbouring cell of the model plane.

    Both modes use cells as the join key: ``cell8`` takes all pairs of the eight neighbours, ``capped`` those at most one cell apart in distance.
    """
    size = 2.0
    mat = _matches(spark, sf_dir).withColumns({"cx": F.floor(F.col("mx") / size), "cy": F.floor(F.col("my") / size)})
    right = mat.select(*[F.col(c).alias(f"b_{c}") for c in ("pid", "robot", "sx", "sy", "mx", "my", "cx", "cy")])
    # Each two neighbouring cells meet once: a cell goes to itself and to the four after it.
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    around = mat.withColumn("step", F.explode(steps)).select("pid", F.col("robot").alias("b_robot"), "robot", "sx", "sy", "mx", "my", (F.col("cx") + F.col("step.i")).alias("b_cx"), (F.col("cy") + F.col("step.j")).alias("b_cy"), F.expr("step.i <> 0 OR step.j <> 0").alias("other"))
    pairs = around.join(right, ["b_robot", "b_cx", "b_cy"]).filter("other OR pid < b_pid")
    plane = lambda p: F.sqrt((F.col(f"{p}x") - F.col(f"b_{p}x")) * (F.col(f"{p}x") - F.col(f"b_{p}x")) + (F.col(f"{p}y") - F.col(f"b_{p}y")) * (F.col(f"{p}y") - F.col(f"b_{p}y")))
    pairs = pairs.filter(F.abs(plane("s") - plane("m")) <= RES)
    if capped:
        pairs = pairs.filter(plane("m") <= size)
    return pairs.select("robot", F.least("pid", "b_pid").alias("src"), F.greatest("pid", "b_pid").alias("dst"))


def consistency_edges_cell8(spark, sf_dir):
    return _edges(spark, sf_dir, capped=False)


def consistency_edges_capped(spark, sf_dir):
    return _edges(spark, sf_dir, capped=True)


SQL_CELL8 = "floor(a.mx / 2) - floor(b.mx / 2) BETWEEN -1 AND 1 AND floor(a.my / 2) - floor(b.my / 2) BETWEEN -1 AND 1"
CELL8 = f"WITH {PTS_EV}, {SQL_MATCHES} SELECT a.robot, a.pid src, b.pid dst FROM mat a JOIN mat b ON a.robot = b.robot AND a.pid < b.pid WHERE {SQL_CELL8} AND {SQL_CONSISTENT}"
CAPPED = f"WITH {PTS_EV}, {SQL_MATCHES} SELECT a.robot, a.pid src, b.pid dst FROM mat a JOIN mat b ON a.robot = b.robot AND a.pid < b.pid WHERE sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) <= 2 AND {SQL_CONSISTENT}"


def vertex_degrees(spark, sf_dir):
    found = written(degrees(_edges(spark, sf_dir, capped=True)), "degrees")
    return found.crossJoin(F.broadcast(found.agg(F.max("degree").alias("max_degree"))))


DEGREES = f"WITH e AS ({CAPPED}), n AS (SELECT src node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*) degree, max(count(*)) OVER () max_degree FROM n GROUP BY 1"


def max_clique_size(spark, sf_dir):
    """Size of the largest clique of three or more mutually consistent matches of each robot that has one."""
    edges = written(_edges(spark, sf_dir, capped=True), "edges")
    sizes = cliques(edges.select("src", "dst"), 3).groupBy("component").agg(F.count("*").alias("size"), F.min("member").alias("node"))
    of = edges.select(F.explode(F.array("src", "dst")).alias("node"), "robot").distinct()
    return sizes.join(of, "node").groupBy("robot").agg(F.max("size").alias("size"))


#: Every clique grows from its smallest member on, in ascending order.
MAX_CLIQUE = f"""
WITH RECURSIVE e AS ({CAPPED}), u AS (SELECT robot, src s, dst d FROM e UNION SELECT robot, dst, src FROM e), adj AS (SELECT s n, list(d) ns FROM u GROUP BY 1),
q(robot, members, last) AS (SELECT robot, [src, dst], dst FROM e UNION ALL
  SELECT q.robot, list_append(q.members, u.d), u.d FROM q JOIN u ON u.s = q.last AND u.d > q.last JOIN adj ON adj.n = u.d WHERE len(list_intersect(q.members, adj.ns)) = len(q.members))
SELECT robot, max(len(members)) AS size FROM q WHERE len(members) >= 3 GROUP BY 1
"""


def rigid_fit(spark, sf_dir):
    """Turn and shift, without scale, in three dimensions, that map each clique's scene positions best onto its model positions.

    A match lies at the heights of its events. The turn comes back as its quaternion (w >= 0), the rest as shift and mean error.
    """
    ship(spark)
    members = cliques(_edges(spark, sf_dir, capped=True).select("src", "dst"), 3)
    w = Window.partitionBy("robot").orderBy("sec", "pid")
    heights = event_points(spark, sf_dir).select("pid", (F.col("z") + F.pmod("pid", F.lit(3))).alias("sz"), F.col("z").alias("mz"), F.lead("pid").over(w).alias("next"))
    rows = members.join(_matches(spark, sf_dir), members["member"] == F.col("pid")).join(heights, "pid").select("component", "pid", "sx", "sy", "sz", "mx", "my", "mz")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        found = fitted(pdf[["sx", "sy", "sz"]].to_numpy("f8"), pdf[["mx", "my", "mz"]].to_numpy("f8"))
        return pd.DataFrame([(int(pdf["component"].iloc[0]), len(pdf), *map(float, found))], columns=["component", "n", "qw", "qx", "qy", "qz", "dx", "dy", "dz", "error"])

    return rows.groupBy("component").applyInPandas(fit, "component long, n long, qw double, qx double, qy double, qz double, dx double, dy double, dz double, error double")


def relabel_components(spark, sf_dir):
    """Transitive closure of match groups: classes joined by shared members take the smallest id."""
    found = descriptors(spark, sf_dir)
    pairs = nearest(found, _queries(found), K).select(F.col("query").alias("src"), F.col("target").alias("dst"))
    return components(pairs)


RELABEL = f"""
WITH RECURSIVE k AS ({_knn_sql()}), u AS (SELECT query s, target d FROM k UNION SELECT target, query FROM k), nodes AS (SELECT DISTINCT s id FROM u),
r(n, l) AS (SELECT id, id FROM nodes UNION SELECT u.d, r.l FROM r JOIN u ON u.s = r.n WHERE r.l < u.d)
SELECT n node, min(l) component FROM r GROUP BY 1
"""


def ids_matching(spark, sf_dir):
    """Whether each id and the next one known to the groups are in one group."""
    groups = written(relabel_components(spark, sf_dir), "groups")
    later = groups.select((F.col("node") - 1).alias("node"), F.col("component").alias("other"))
    return groups.join(later, "node").select(F.col("node").alias("id"), (F.col("component") == F.col("other")).alias("same"))


IDS_MATCHING = f"WITH g AS ({RELABEL}) SELECT a.node id, a.component = b.component same FROM g a JOIN g b ON b.node = a.node + 1"


def front_cluster(spark, sf_dir):
    """The first of the candidate clusters: the largest clique, the smallest as a sorted list among equals."""
    found = cliques(_edges(spark, sf_dir, capped=True).select("src", "dst"), 3)
    lists = found.groupBy("component").agg(F.sort_array(F.collect_list("member")).alias("members"))
    first = lists.agg(F.min(F.struct((-F.size("members")).alias("size"), "members")).alias("first"))
    return first.select(F.explode("first.members").alias("member"), (-F.col("first.size")).cast("long").alias("n"))


FRONT_CLUSTER = MAX_CLIQUE.rsplit("SELECT robot,", 1)[0] + "SELECT unnest(members) AS member, len(members) n FROM (SELECT members FROM q WHERE len(members) >= 3 ORDER BY len(members) DESC, members LIMIT 1)"


def roc_pairs(spark, sf_dir):
    """Labelled pairs for a ROC curve: always one against the last of a sequence.

    Positives join each member of a class to the last ones of its other sequences, so they grow with the members times the
    sequences (three). As many negatives of other classes, at least a distance apart, are taken in the order of a hash of the pair. The
    hash adds up what each side brings, modulo a prime, so the pairs of a small hash are found by a range of the last ones' shares: pairs are
    made slice by slice of the hash until there are enough, never all of them.
    """
    found = descriptors(spark, sf_dir).select("id", "label", F.pmod("id", F.lit(3)).alias("seq"), "vector")
    last = written(found.groupBy("label", "seq").agg(F.max_by(F.struct("id", "vector"), "id").alias("l")).select(F.col("label").alias("l_label"), F.col("seq").alias("l_seq"), F.col("l.id").alias("last"), F.col("l.vector").alias("l_vector")), "last")
    pairs = found.select("id", "label", "seq").join(last.select(F.col("l_label").alias("label"), "l_seq", "last"), "label").filter("seq <> l_seq")
    positive = written(pairs.select(F.least("id", "last").alias("a"), F.greatest("id", "last").alias("b")).distinct(), "positive")
    wanted, (members, ends) = positive.count(), (found.count(), last.count())
    negative, upto, held = None, 0, 0
    # Some more than wanted at first: a pair can turn out near, of one class, or the same from both sides.
    width = -(-2 * PRIME * wanted // max(1, members * ends))
    while held < wanted and upto < PRIME:
        to = min(PRIME, upto + max(1, width))
        fresh = written(_negatives(found, last, upto, to), "negative")
        negative, held, upto, width = (fresh if negative is None else negative.unionByName(fresh)), held + fresh.count(), to, 2 * width
    positive = positive.select("a", "b", F.lit(1).cast("long").alias("same"))
    if negative is None:
        return positive
    chosen = numbered(negative, ["h", "a", "b"]).filter(F.col("n") <= wanted)
    return positive.unionByName(chosen.select("a", "b", F.lit(0).cast("long").alias("same")))


#: The hash of a pair a < b is (7919 a + 104729 b) modulo this prime.
PRIME, FACTORS = 1_000_003, (7919, 104_729)


def _negatives(found, last, lo: int, hi: int):
    """(a, b, h): pairs of a member and a last one of other classes, far enough apart, whose hash h lies in [lo, hi).

    Whichever of the two is the smaller, h less the member's share, modulo the prime, is the last one's share, so members meet the last
    ones of a range of shares: the range is cut into buckets of its width, of which it touches two or, where it wraps, three.
    """
    width = hi - lo
    d2 = F.aggregate(F.zip_with("vector", "l_vector", lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, t: s + t)
    out = None
    for small, order in ((0, "id < last"), (1, "last < id")):
        mine, theirs = FACTORS[small], FACTORS[1 - small]
        start = F.pmod(F.lit(lo) - F.col("id") * mine, F.lit(PRIME))
        bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
        buckets = F.array_distinct(F.array(bucket(start), bucket(F.pmod(start + F.least(F.lit(width - 1), PRIME - 1 - start), F.lit(PRIME))), bucket(F.pmod(start + (width - 1), F.lit(PRIME))), F.when(start + width > PRIME, F.lit(0)).otherwise(bucket(start))))
        members = found.withColumn("bucket", F.explode(buckets))
        ends = last.withColumn("bucket", bucket(F.pmod(F.col("last") * theirs, F.lit(PRIME))))
        h = F.pmod(F.col("id") * mine + F.col("last") * theirs, F.lit(PRIME))
        met = members.join(ends, "bucket").filter(order).filter("label <> l_label").withColumn("h", h).filter((F.col("h") >= lo) & (F.col("h") < hi)).filter(d2 >= 2.0)
        met = met.select(F.least("id", "last").alias("a"), F.greatest("id", "last").alias("b"), "h")
        out = met if out is None else out.unionByName(met)
    return out.distinct()


ROC_PAIRS = """
WITH f AS (SELECT vec_id id, label, vec_id % 3 seq, embedding v FROM embeddings), l AS (SELECT label, seq, max(id) AS last, arg_max(v, id) lv FROM f GROUP BY 1, 2),
p AS (SELECT DISTINCT least(id, last) a, greatest(id, last) b FROM f JOIN l ON f.label = l.label AND f.seq <> l.seq),
o AS (SELECT DISTINCT least(id, last) a, greatest(id, last) b FROM f JOIN l ON f.label <> l.label WHERE list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i]::DOUBLE - lv[i]) * (v[i]::DOUBLE - lv[i]))) >= 2.0),
n AS (SELECT a, b, row_number() OVER (ORDER BY (a * 7919 + b * 104729) % 1000003, a, b) n FROM o)
SELECT a, b, 1::BIGINT same FROM p UNION ALL SELECT a, b, 0 FROM n WHERE n <= (SELECT count(*) FROM p)
"""


HULL_DISTANCE, HULL_RATIO, HULL_GAP = 0.3, 0.33, 100


def hull_matches(spark, sf_dir):
    """Segments that fill the same space: close centroids, ids far enough apart, and hulls that share at least a third of both.

    Queries are the segments whose id is divisible by 50, against all segments of larger id. Segments of the same points are one shape: a
    range join of the shapes' centroids finds the candidates, and each pair of shapes is judged once, whatever the number of segments that
    have them. Only candidates get points: each pair is one row with both point lists, so no task holds more than a pair at a time.
    """
    ship(spark)
    # Points in order, so that segments of the same points have the same centroid and the same digest to the last bit.
    listed = lineitem_points(spark, sf_dir).groupBy("segment").agg(F.sort_array(F.collect_list(F.array("x", "y", "z"))).alias("points"))
    digest = F.sha2(F.to_binary(F.concat_ws(",", F.transform(F.flatten("points"), lambda v: F.coalesce(v.cast("string"), F.lit("-")))), F.lit("utf-8")), 256)
    listed = written(listed.withColumn("shape", digest), "listed")
    mean = lambda i: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[i]) / F.size("points")
    segments = listed.select("segment", "shape")
    shapes = listed.groupBy("shape").agg(F.min("segment").alias("one"), F.max(F.col("segment") % 50 == 0).alias("asked"), F.min(F.when(F.col("segment") % 50 == 0, F.col("segment"))).alias("lo"), F.max("segment").alias("hi"))
    cen = written(shapes.join(listed.select(F.col("segment").alias("one"), *[mean(i).alias(a) for i, a in enumerate("xyz")]), "one"), "shapes")
    near = range_join(cen.filter("asked").select("shape", "one", "lo", *"xyz"), cen.select("shape", "one", "hi", *"xyz"), HULL_DISTANCE).filter(f"r.hi - l.lo > {HULL_GAP}")
    near = written(near.select(F.col("l.shape").alias("sa"), F.col("r.shape").alias("sb"), F.col("l.one").alias("a"), F.col("r.one").alias("b")), "near")
    # Either order of two shapes is one judgement.
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    lists = listed.select("segment", "points")
    left, right = (lists.select(F.col("segment").alias(n), F.col("points").alias(f"p{n}")) for n in "ab")

    def judge(batches):
        known: dict[int, tuple] = {}

        def judged(pdf):
            if len(known) > 2000:
                known.clear()
            fresh = {**dict(zip(pdf["a"], pdf["pa"])), **dict(zip(pdf["b"], pdf["pb"]))}
            clouds = {s: np.array([list(p) for p in rows], "f8") for s, rows in fresh.items() if s not in known}
            known.update(zip(clouds, zip(clouds.values(), convex_hulls(list(clouds.values())))))
            ends = [(*known[a], *known[b]) for a, b in zip(pdf["a"], pdf["b"])]
            # Hulls of a batch grow together.
            within = [shared(left, right, a, b) for left, a, right, b in ends]
            both = convex_hulls([np.concatenate(w) for w in within])
            rows = [(a, b, *overlap(e[0], e[2], e[1], e[3], 5, (*w, hull))) for a, b, e, w, hull in zip(pdf["a"], pdf["b"], ends, within, both)]
            return pd.DataFrame(rows, columns=["a", "b", "a_in_b", "b_in_a", "ratio_a", "ratio_b"]).astype({"a": "int64", "b": "int64", "a_in_b": "int64", "b_in_a": "int64"})

        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                yield judged(pdf.iloc[lo : lo + 1000])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # By the first of a pair, so that its hull is built once.
    joined = pairs.join(left, "a").join(right, "b").repartition(parts, "a").sortWithinPartitions("a", "b").select("a", "b", "pa", "pb")
    judged = joined.mapInPandas(judge, "a long, b long, a_in_b long, b_in_a long, ratio_a double, ratio_b double")
    judged = written(judged.filter(f"ratio_a > {HULL_RATIO} AND ratio_b > {HULL_RATIO}"), "judged")
    turned = judged.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_in_a").alias("a_in_b"), F.col("a_in_b").alias("b_in_a"), F.col("ratio_b").alias("ratio_a"), F.col("ratio_a").alias("ratio_b"))
    found = near.join(judged.unionByName(turned), ["a", "b"]).drop("a", "b")
    member = lambda n: segments.select(F.col("segment").alias(n), F.col("shape").alias(f"s{n}"))
    found = found.join(member("a").filter("a % 50 = 0"), "sa").join(member("b"), "sb").filter(f"b - a > {HULL_GAP}")
    return found.select("a", "b", "a_in_b", "b_in_a", F.round("ratio_a", 6).alias("ratio_a"), F.round("ratio_b", 6).alias("ratio_b"))


def greedy_grouping(spark, sf_dir):
    """Consensus groups of three or more: seeds in order of degree take all unused matches consistent with the whole group."""
    edges = written(_edges(spark, sf_dir, capped=True), "edges")
    of = edges.select(F.explode(F.array("src", "dst")).alias("member"), "robot").distinct()
    return greedy_groups(edges.select("src", "dst")).join(of, "member").select("robot", "grp", "member")


#: Seeds take their turns in a recursion that carries what is used; neighbours join in the order of their ids.
GREEDY = f"""
WITH RECURSIVE e AS ({CAPPED}), u AS MATERIALIZED (SELECT robot, src s, dst d FROM e UNION SELECT robot, dst, src FROM e),
adj AS MATERIALIZED (SELECT robot, s, list(d ORDER BY d) ns FROM u GROUP BY 1, 2), turn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY robot ORDER BY len(ns) DESC, s) i FROM adj),
g(robot, i, k, used, members, seed) AS (
  SELECT DISTINCT robot, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::BIGINT[], 0::BIGINT FROM turn UNION ALL
  SELECT robot, CASE WHEN k = 0 THEN i + 1 ELSE i END, CASE WHEN k = 0 THEN (CASE WHEN off THEN 0 ELSE 1 END) WHEN k >= len(ns) THEN 0 ELSE k + 1 END,
    CASE WHEN k > 0 AND k >= len(ns) AND len(grown) >= 3 THEN used || grown ELSE used END, CASE WHEN k = 0 THEN [t] ELSE grown END, CASE WHEN k = 0 THEN t ELSE seed END
  FROM (SELECT g.robot, g.i, g.k, g.used, g.seed, turn.s t, turn.ns, list_contains(g.used, turn.s) off,
      CASE WHEN g.k = 0 OR list_contains(g.used, turn.ns[g.k]) OR len(list_intersect(g.members, a.ns)) < len(g.members) THEN g.members ELSE list_append(g.members, turn.ns[g.k]) END grown
    FROM g JOIN turn ON turn.robot = g.robot AND turn.i = CASE WHEN g.k = 0 THEN g.i + 1 ELSE g.i END LEFT JOIN adj a ON g.k > 0 AND a.robot = g.robot AND a.s = turn.ns[g.k]))
SELECT robot, seed grp, unnest(members) AS member FROM (
  SELECT robot, seed, members, used, lag(len(used), 1, 0) OVER (PARTITION BY robot ORDER BY i, CASE WHEN k = 0 THEN 1e9 ELSE k END, len(used)) was FROM g) WHERE len(used) > was
"""


def consensus_rejection(spark, sf_dir):
    """The same groups without the matches that do not agree on their group's motion, and that motion."""
    w = Window.partitionBy("robot").orderBy("sec", "pid")
    heights = event_points(spark, sf_dir).select("pid", (F.col("z") + F.pmod("pid", F.lit(3))).alias("sz"), F.col("z").alias("mz"), F.lead("pid").over(w).alias("next"))
    groups = greedy_grouping(spark, sf_dir).join(_matches(spark, sf_dir).drop("robot"), F.col("member") == F.col("pid")).join(heights, "pid")
    return consensus_groups(groups.select("grp", "member", "sx", "sy", "sz", "mx", "my", "mz"), RES)


PACK = {
    "knn_candidates": (knn_candidates, _knn_sql()),
    "knn_join": (knn_join, _knn_sql(asked="TRUE")),
    "knn_exclude_class": (knn_exclude_class, _knn_sql("a.label <> 1 AND b.label <> 1")),
    "knn_hard_threshold": (knn_hard_threshold, _hard()),
    "histogram_intersection": (histogram_intersection, HISTOGRAM),
    "feature_distance": (feature_distance, FEATURE_DISTANCE),
    "match_time_filter": (match_time_filter, MATCH_TIME),
    "recognize_lookups": (recognize_lookups, LOOKUPS),
    "update_match_centroids": (update_match_centroids, UPDATE_MATCHES),
    "ids_matching": (ids_matching, IDS_MATCHING),
    "front_cluster": (front_cluster, FRONT_CLUSTER),
    "roc_pairs": (roc_pairs, ROC_PAIRS),
    "hull_matches": (hull_matches, None),
    "consistency_edges_cell8": (consistency_edges_cell8, CELL8),
    "consistency_edges_capped": (consistency_edges_capped, CAPPED),
    "vertex_degrees": (vertex_degrees, DEGREES),
    "max_clique_size": (max_clique_size, MAX_CLIQUE),
    "rigid_fit": (rigid_fit, None),
    "relabel_components": (relabel_components, RELABEL),
    "greedy_grouping": (greedy_grouping, GREEDY),
    "consensus_rejection": (consensus_rejection, None),
}
