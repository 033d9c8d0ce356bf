"""Every reorder rule applied to every frame of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import settle
from ..functions.numeric import big, rnd
from ..operators import reorder as ro
from ..sources.tables import EVENT_W, ORDER_W, frames_events, frames_orders, sql_frames, table
from .burst_queries import EVENT_LENGTHS, ORDER_LENGTHS
from .perm_sql import perms_by_length
from .registry import register

DRP = {"p": 23, "s": 1, "read": [3, 0, 1, 2], "write": [0, 3, 2, 1]}

# id, rule, table, parameters
RULE_QUERIES = [
    ("I1_block", "block", "orders", {}),
    ("I2_block_matched", "blockCM", "orders", {}),
    ("I3_matrix", "matrix", "events", {}),
    ("I4_snake", "snake", "orders", {}),
    ("I5_helical", "helical", "events", {}),
    ("I6_helical_scan", "helicalScan", "events", {}),
    ("I7_diagonal", "diagonal", "orders", {}),
    ("I8_spiral", "spiral", "events", {}),
    ("I9_hierarchical", "hierarchical", "orders", {}),
    ("I10_multi_dim", "multiDim", "orders", {}),
    ("I11_latin_square", "latinSquare", "events", {}),
    ("I12_time", "time", "orders", {}),
    ("I13_freq_determ", "freqDeterm", "orders", {}),
    ("I14_freq_random", "freqRandom", "orders", {}),
    ("I15_random", "random", "orders", {}),
    ("I16_golden", "goldenRP", "orders", {}),
    ("I17_prime", "prime", "events", {}),
    ("I18_algebraic", "algebraic", "orders", {"f1": 7, "f2": 30}),
    ("I19_turbo", "turbo", "orders", {"f1": 29, "f2": 60}),
    ("I20_convolutional", "convolutional", "orders", {}),
    ("I20b_convolutional_matched", "convCM", "orders", {}),
    ("I21_arp", "arp", "orders", {}),
    ("I22_drp", "drp", "orders", DRP),
    ("I23_swap", "S", "orders", {}),
]


LENGTHS = {"events": EVENT_LENGTHS, "orders": ORDER_LENGTHS}
#: Rules with parameters for listed lengths only; they take whole frames.
LISTED = {"arp"}


def frames(spark, sf, source, whole=False):
    return frames_events(spark, sf, whole=whole) if source == "events" else frames_orders(spark, sf, whole=whole)


def _add(name, rule, source, kw):
    whole = rule in LISTED
    sql = f"""WITH {sql_frames(source=source, whole=whole)}, {perms_by_length([(rule, kw)], LENGTHS[source][: 1 if whole else None])},
    ids AS (SELECT DISTINCT frame_id, n_rows FROM f)
    SELECT i.frame_id, p.pos, p.src, f.value FROM ids i JOIN perm p ON p.n_rows = i.n_rows
    LEFT JOIN f ON f.frame_id = i.frame_id AND f.pos = p.src"""

    @register(name, sql)
    def run(spark, sf):
        f = frames(spark, sf, source, whole)
        return ro.reorder(f, ro.permutations_of(f, [(rule, kw)]), ["value"]).select("frame_id", "pos", "src", "value")


for _q in RULE_QUERIES:
    _add(*_q)


@register("I0_restore", f"""WITH {sql_frames()} SELECT frame_id, pos, value,
    CAST(0 AS BIGINT) AS moved_back_wrong FROM f""")
def restore(spark, sf):
    """Reorder with a padding rule, restore, and compare with the original row by row."""
    f = frames_events(spark, sf, whole=False)
    perm = ro.permutations_of(f, ["helical"]).drop("method")
    back = ro.restore(ro.reorder(f, perm, ["value"]), perm, ["value"])
    orig = f.select("frame_id", "pos", F.col("value").alias("was"))
    return back.join(orig, ["frame_id", "pos"]).select(
        "frame_id", "pos", "value", big((F.col("value") != F.col("was")).cast("int")).alias("moved_back_wrong"))


@register("I0_number_rows", """SELECT o_custkey AS customer, o_orderkey AS "order", CAST(row_number() OVER w AS BIGINT) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n_rows
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def numbered(spark, sf):
    """Every customer's orders as one frame."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"))
    return ro.number_rows(o, ["customer"], "order")


ALL_240 = [(r, kw) for _, r, s, kw in RULE_QUERIES if s == "orders"] + [("identity", {})]
ALL_200 = ["block", "matrix", "snake", "helical", "helicalScan", "diagonal", "spiral", "hierarchical", "multiDim",
           "latinSquare", "time", "freqDeterm", "goldenRP", "prime", "convolutional", "S", "identity"]


@register("I0_extension", f"""WITH {sql_frames(whole=False)}, {perms_by_length(ALL_200, EVENT_LENGTHS)},
    e AS (SELECT method, n_rows, max(pos) AS n_out FROM perm GROUP BY ALL)
    SELECT method, n_rows, count(DISTINCT frame_id) AS frames, CAST(sum(hit) AS BIGINT) AS hits, any_value(n_out) AS n_out,
    round(n_rows::DOUBLE / any_value(n_out), 9) AS be, CAST(count(DISTINCT frame_id) * any_value(n_out) AS BIGINT) AS rows_sent
    FROM f JOIN e USING (n_rows) GROUP BY method, n_rows""")
def extension(spark, sf):
    """What each rule costs on a whole table: rows sent when every frame is padded to its length."""
    f = frames_events(spark, sf, whole=False)
    tot = f.groupBy("n_rows").agg(F.count(F.when(F.col("pos") == 1, 1)).alias("frames"), F.sum("hit").alias("hits"))
    return tot.join(ro.extension(ro.permutations_of(f, ALL_200), ["method"]), "n_rows").select(
        "method", "n_rows", "frames", "hits", "n_out", rnd("be").alias("be"), (F.col("frames") * F.col("n_out")).alias("rows_sent"))


@register("I24_perm_valid", f"""WITH {sql_frames(source='orders', whole=False)}, {perms_by_length(ALL_240, LENGTHS['orders'])},
    ids AS (SELECT DISTINCT frame_id, n_rows FROM f),
    got AS (SELECT method, i.frame_id, p.pos, p.src, g.value FROM ids i JOIN perm p ON p.n_rows = i.n_rows
            LEFT JOIN f g ON g.frame_id = i.frame_id AND g.pos = p.src),
    fp AS (SELECT method, frame_id, count(*) AS n_out, count(DISTINCT src) AS n_src, sum((pos = src)::INT) AS fx,
           string_agg(CAST(src AS VARCHAR), ',' ORDER BY pos) AS s FROM got GROUP BY ALL),
    dup AS (SELECT frame_id, s, count(*) AS copies FROM fp GROUP BY ALL)
    SELECT method, frame_id, CAST(n_out AS BIGINT) AS n_out, n_src = n_out AS bijection, fx = n_out AS is_identity,
    CAST(fx AS BIGINT) AS fixed_points, CAST(copies AS BIGINT) AS copies FROM fp JOIN dup USING (frame_id, s)""")
def perm_valid(spark, sf):
    """Checked on the reordered rows themselves, frame by frame, for every rule."""
    f = frames_orders(spark, sf, whole=False)
    moved = ro.reorder(f, settle(ro.permutations_of(f, ALL_240, where_listed=True)), [])
    return ro.perm_valid(moved, ["method", "frame_id"], ["frame_id"])


@register("I25_perm_equal", f"""WITH {sql_frames(source='orders', whole=False)}, {perms_by_length(ALL_240, LENGTHS['orders'])},
    g AS (SELECT f.frame_id, method, p.pos, p.src FROM f JOIN perm p ON f.pos = p.src AND f.n_rows = p.n_rows),
    w AS (SELECT frame_id, pos, row_number() OVER (PARTITION BY frame_id ORDER BY (pos - 1) % 15, pos) AS bpos FROM f)
    SELECT g.method, g.frame_id, count(*) AS rows, CAST(sum((w.pos <> g.src)::INT) AS BIGINT) AS mismatches,
    sum((w.pos <> g.src)::INT) = 0 AS equal
    FROM g JOIN w ON w.frame_id = g.frame_id AND w.bpos = g.pos GROUP BY ALL""")
def perm_equal(spark, sf):
    """Rule tables against the order Spark gives by sorting each frame on (column, row)."""
    from pyspark.sql import Window

    f = frames_orders(spark, sf, whole=False)
    w = Window.partitionBy("frame_id").orderBy((F.col("pos") - 1) % 15, "pos")
    sorted_ = f.select("frame_id", "n_rows", F.col("pos").alias("src"), big(F.row_number().over(w)).alias("pos"))
    rules = ro.reorder(f, settle(ro.permutations_of(f, ALL_240, where_listed=True)), [])
    by_rule = sorted_.withColumn("method", F.explode(F.array(*[F.lit(r) for r, _ in ALL_240])))
    by_rule = by_rule.where(~F.col("method").isin(*LISTED) | F.col("n_rows").isin([r[0] for r in ro.ARP_TABLE]))
    return ro.perm_equal(rules, by_rule, ["method", "frame_id"])
