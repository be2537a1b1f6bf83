"""Registered queries over the test tables, each with its DuckDB oracle.

Every query reads whole tables; parameters that depend on the data (number of
steps, oversize shard, slice bounds) are derived from the row counts so the
work grows with the tables. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_half_away
from ..functions.rowindex import with_row_index
from ..operators import evaluate, features, manifest, metrics, shards, stats
from . import objects, streams

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_TYPES = ["view", "click", "error", "purchase", "signup"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(col):
    """Six decimal places, as the oracle rounds doubles."""
    return round_half_away(col, 6)


# --------------------------------------------------------------------------- shards

def q_row_index(spark, d):
    idx = with_row_index(table(spark, d, "orders"), "o_orderkey")
    return idx.select("row_idx", "o_orderkey", "o_custkey")


def q_shard_assignment(spark, d):
    idx, n = with_row_index(table(spark, d, "orders"), "o_orderkey", return_count=True)
    s, r = 4096, 3
    m = shards.max_shards_for_epochs(n, s, r, epochs=2)
    return shards.assign_shards(idx, n, s, r, m)


def q_shard_worker_slice(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    idx, n = with_row_index(ev, "event_id", return_count=True)
    s, r = 100, 4
    m = shards.max_shards_for_epochs(n, s, r, epochs=1)
    return shards.assign_shards(idx, n, s, r, m, worker=1)


def q_shard_oversize_wrap(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    idx, n = with_row_index(cust, "c_custkey", return_count=True)
    s, r, m = 2 * n + 1, 2, 2
    return shards.assign_shards(idx, n, s, r, m)


def q_slice_rows(spark, d):
    idx, n = with_row_index(table(spark, d, "orders").select("o_orderkey", "o_totalprice"),
                            "o_orderkey", return_count=True)
    return shards.slice_rows(idx, n, n // 3, 2 * n // 3)


def q_slice_rows_wrap(spark, d):
    idx, n = with_row_index(table(spark, d, "orders").select("o_orderkey", "o_totalprice"),
                            "o_orderkey", return_count=True)
    return shards.slice_rows(idx, n, 2 * n // 3, n // 3)


def q_shard_matrices(spark, d):
    ev = table(spark, d, "events")
    idx, n = with_row_index(ev, "event_id", return_count=True)
    s, r = 16, 2
    m = shards.max_shards_for_epochs(n, s, r, epochs=1)
    tagged = shards.assign_shards(idx, n, s, r, m)
    vec = features.feature_vector(tagged, ["event_id", "user_id", "value"],
                                  keep=["worker", "step", "pos"])
    return features.shard_matrices(vec)


SHARD_SQL = {
    "row_index": """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey, o_custkey FROM orders""",
    "shard_assignment": """
WITH idx AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders),
prm AS (SELECT n, s, r, m, r * m * s AS total, CAST(ceil((r * m * s) / n) AS BIGINT) AS e
        FROM (SELECT count(*) AS n, 4096 AS s, 3 AS r,
                     CAST(ceil(2.0 * count(*) / (3 * 4096)) AS BIGINT) AS m FROM orders)),
pos AS (SELECT idx.*, ep * prm.n + idx.row_idx AS p, prm.s, prm.r, prm.total
        FROM idx, prm, (SELECT unnest(range(0, (SELECT e FROM prm))) AS ep))
SELECT CAST((p // s) % r AS INTEGER) AS worker, CAST((p // s) // r AS BIGINT) AS step,
       CAST(p % s AS BIGINT) AS pos, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       o_orderdate, o_orderpriority, row_idx
FROM pos WHERE p < total""",
    "shard_worker_slice": """
WITH idx AS (SELECT event_id, user_id, event_type, value,
                    row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events),
prm AS (SELECT n, s, r, r * m * s AS total, CAST(ceil((r * m * s) / n) AS BIGINT) AS e
        FROM (SELECT count(*) AS n, 100 AS s, 4 AS r,
                     CAST(ceil(1.0 * count(*) / (4 * 100)) AS BIGINT) AS m FROM events)),
pos AS (SELECT idx.*, ep * prm.n + idx.row_idx AS p, prm.s, prm.r, prm.total
        FROM idx, prm, (SELECT unnest(range(0, (SELECT e FROM prm))) AS ep)),
tagged AS (SELECT CAST((p // s) % r AS INTEGER) AS worker, CAST((p // s) // r AS BIGINT) AS step,
                  CAST(p % s AS BIGINT) AS pos, event_id, user_id, event_type, value, row_idx
           FROM pos WHERE p < total)
SELECT * FROM tagged WHERE worker = 1""",
    "shard_oversize_wrap": """
WITH idx AS (SELECT c_custkey, c_nationkey, c_acctbal,
                    row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx FROM customer),
prm AS (SELECT n, s, r, r * m * s AS total, CAST(ceil((r * m * s) / n) AS BIGINT) AS e
        FROM (SELECT count(*) AS n, 2 * count(*) + 1 AS s, 2 AS r, 2 AS m FROM customer)),
pos AS (SELECT idx.*, ep * prm.n + idx.row_idx AS p, prm.s, prm.r, prm.total
        FROM idx, prm, (SELECT unnest(range(0, (SELECT e FROM prm))) AS ep))
SELECT CAST((p // s) % r AS INTEGER) AS worker, CAST((p // s) // r AS BIGINT) AS step,
       CAST(p % s AS BIGINT) AS pos, c_custkey, c_nationkey, c_acctbal, row_idx
FROM pos WHERE p < total""",
    "slice_rows": """
WITH idx AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx
             FROM orders),
b AS (SELECT count(*) // 3 AS st, 2 * count(*) // 3 AS en FROM orders)
SELECT o_orderkey, o_totalprice, row_idx, row_idx - st AS seq FROM idx, b
WHERE row_idx >= st AND row_idx < en""",
    "slice_rows_wrap": """
WITH idx AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx
             FROM orders),
b AS (SELECT count(*) AS n, 2 * count(*) // 3 AS st, count(*) // 3 AS en FROM orders)
SELECT o_orderkey, o_totalprice, row_idx,
       CASE WHEN row_idx >= st THEN row_idx - st ELSE row_idx + n - st END AS seq
FROM idx, b WHERE row_idx >= st OR row_idx < en""",
    "shard_matrices": """
WITH idx AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY event_id) - 1 AS row_idx
             FROM events),
prm AS (SELECT n, s, r, r * m * s AS total, CAST(ceil((r * m * s) / n) AS BIGINT) AS e
        FROM (SELECT count(*) AS n, 16 AS s, 2 AS r,
                     CAST(ceil(1.0 * count(*) / (2 * 16)) AS BIGINT) AS m FROM events)),
pos AS (SELECT idx.*, ep * prm.n + idx.row_idx AS p, prm.s, prm.r, prm.total
        FROM idx, prm, (SELECT unnest(range(0, (SELECT e FROM prm))) AS ep)),
tagged AS (SELECT CAST((p // s) % r AS INTEGER) AS worker, CAST((p // s) // r AS BIGINT) AS step,
                  p % s AS pos,
                  [CAST(event_id AS DOUBLE), CAST(user_id AS DOUBLE), value] AS f
           FROM pos WHERE p < total)
SELECT worker, step, list(f ORDER BY pos) AS matrix, count(*) AS rows FROM tagged GROUP BY worker, step""",
}


# --------------------------------------------------------------------------- manifest

def _nation_manifest_raw(spark, d):
    """Customer stored as one object per nation (-1: none): raw manifest ``id, count``."""
    cust = table(spark, d, "customer")
    return cust.groupBy(F.coalesce(F.col("c_nationkey").cast("int"), F.lit(-1)).alias("id")).agg(
        F.count(F.lit(1)).alias("count"))


def q_manifest_offsets(spark, d):
    return manifest.make_manifest(df=_nation_manifest_raw(spark, d))


def q_manifest_zero_row(spark, d):
    layout = table(spark, d, "customer").repartitionById(
        25, F.coalesce(F.col("c_nationkey").cast("int"), F.lit(0)))
    return manifest.make_manifest(df=manifest.partition_counts(layout, include_empty_zero_id=True))


def q_manifest_totals(spark, d):
    return manifest.manifest_totals(q_manifest_offsets(spark, d))


def _read_spec(spark, d, wrap):
    man = q_manifest_offsets(spark, d)
    n = manifest.manifest_totals(man).first()["row_count"]
    start, end = (2 * n // 3, n // 3) if wrap else (n // 3, 2 * n // 3)
    return shards.read_spec(man, n, start, end)


def q_read_spec(spark, d):
    return _read_spec(spark, d, wrap=False)


def q_read_spec_wrap(spark, d):
    return _read_spec(spark, d, wrap=True)


def q_uri_pairing(spark, d):
    """Objects named after nations (size = rows stored there) paired by position."""
    raw = _nation_manifest_raw(spark, d)  # one aggregate of customer serves both sides
    listing = table(spark, d, "nation").join(
        raw.select(F.col("id").alias("n_nationkey"), F.col("count").alias("size")), "n_nationkey", "full"
    ).select(
        F.concat(F.lit("file:/data/customer/"), F.lower(F.coalesce("n_name", F.lit("none"))),
                 F.lit(".csv")).alias("uri"),
        F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    return manifest.attach_uris(manifest.make_manifest(df=raw), listing)


def q_partition_counts(spark, d):
    layout = table(spark, d, "lineitem").repartitionById(
        8, F.coalesce((F.col("l_orderkey") % 8).cast("int"), F.lit(0)))
    return manifest.partition_counts(layout)


_RAW = "SELECT CAST(coalesce(c_nationkey, -1) AS INTEGER) AS id, count(*) AS cnt FROM customer GROUP BY 1"
_MAN = f"""
SELECT id, CAST(end_idx - cnt AS BIGINT) AS start_idx, CAST(end_idx AS BIGINT) AS end_idx,
       row_number() OVER (ORDER BY id, end_idx - cnt, end_idx) - 1 AS pos
FROM (SELECT id, cnt, sum(cnt) OVER (ORDER BY id, cnt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             AS end_idx FROM ({_RAW}))"""


def _spec_sql(wrap: bool) -> str:
    bounds = ("2 * n // 3 AS st, n // 3 AS en" if wrap else "n // 3 AS st, 2 * n // 3 AS en")
    head = """
SELECT 0 AS part, pos AS o, id, greatest(0, st - start_idx) AS skiprows,
       {num} AS numrows
FROM man, b, lim WHERE {cond}"""
    if not wrap:
        body = head.format(num="least(end_idx, en) - (start_idx + greatest(0, st - start_idx))",
                           cond="pos BETWEEN lo AND hi")
    else:
        body = head.format(num="end_idx - (start_idx + greatest(0, st - start_idx))",
                           cond="pos >= lo") + """
UNION ALL
SELECT 1 AS part, pos AS o, id, 0 AS skiprows, least(end_idx, en) - start_idx AS numrows
FROM man, b, lim WHERE pos <= hi"""
    return f"""
WITH man AS ({_MAN}),
b AS (SELECT {bounds} FROM (SELECT max(end_idx) AS n FROM man)),
lim AS (SELECT min(pos) FILTER (WHERE start_idx <= st AND st < end_idx) AS lo,
               max(pos) FILTER (WHERE start_idx <= en AND en <= end_idx) AS hi FROM man, b),
spec AS ({body})
SELECT part, row_number() OVER (ORDER BY part, o) - 1 AS seq, id,
       CAST(skiprows AS BIGINT) AS skiprows, CAST(numrows AS BIGINT) AS numrows FROM spec"""


MANIFEST_SQL = {
    "manifest_offsets": f"SELECT id, start_idx, end_idx FROM ({_MAN})",
    "manifest_zero_row": f"""
SELECT id, CAST(end_idx - cnt AS BIGINT) AS start_idx, CAST(end_idx AS BIGINT) AS end_idx
FROM (SELECT id, cnt, sum(cnt) OVER (ORDER BY id, cnt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             AS end_idx FROM (SELECT CAST(coalesce(c_nationkey, 0) % 25 AS INTEGER) AS id, count(*) AS cnt FROM customer GROUP BY 1
      UNION ALL SELECT 0 AS id, 0 AS cnt))""",
    "partition_counts": """
SELECT CAST(coalesce(l_orderkey, 0) % 8 AS INTEGER) AS id, count(*) AS count FROM lineitem GROUP BY 1""",
    "manifest_totals": f"SELECT count(*) AS obj_count, CAST(max(end_idx) AS BIGINT) AS row_count FROM ({_MAN})",
    "read_spec": _spec_sql(False),
    "read_spec_wrap": _spec_sql(True),
    "uri_pairing": f"""
WITH man AS ({_MAN}),
lst AS (SELECT 'file:/data/customer/' || lower(coalesce(n_name, 'none')) || '.csv' AS uri,
               coalesce(c.cnt, 0) AS size
        FROM nation FULL JOIN ({_RAW}) c ON n_nationkey = c.id),
r AS (SELECT uri, row_number() OVER (ORDER BY uri) AS k FROM lst
      WHERE size > 0 OR (SELECT count(*) FROM lst) = (SELECT count(*) FROM man))
SELECT id, start_idx, end_idx, uri FROM man JOIN r ON man.pos + 1 = r.k""",
}


# --------------------------------------------------------------------------- statistics

def q_summary_stats(spark, d):
    long = stats.summarize(table(spark, d, "lineitem"), LINEITEM_NUMERIC)
    return long.select("field", "count", *[r6(c).alias(c) for c in ("mean", "stddev", "min", "max")])


def q_summary_wide(spark, d):
    wide = stats.summary_wide(table(spark, d, "lineitem"), LINEITEM_NUMERIC)
    return wide.select("summary", *[r6(c).alias(c) for c in LINEITEM_NUMERIC])


def _by_flag(spark, d):
    return stats.zscores_by_group(table(spark, d, "lineitem"), "l_returnflag", LINEITEM_NUMERIC)


def q_zscore_by_sample(spark, d):
    z = _by_flag(spark, d)
    return z.select("l_returnflag", "field", "count", "sample_size", r6("mean").alias("mean"),
                    r6("zscore").alias("zscore"))


def q_pvalue_by_sample(spark, d):
    p = stats.pvalues(_by_flag(spark, d))
    return p.select("l_returnflag", "field", r6("zscore").alias("zscore"), r6("pvalue").alias("pvalue"))


def _agg_sql(cols, by=None):
    parts = []
    for c in cols:
        key = f"{by}, " if by else ""
        parts.append(
            f"SELECT {key}'{c}' AS field, count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean, "
            f"stddev_samp(CAST({c} AS DOUBLE)) AS stddev, CAST(min({c}) AS DOUBLE) AS min, "
            f"CAST(max({c}) AS DOUBLE) AS max FROM lineitem" + (f" GROUP BY {by}" if by else ""))
    return "\nUNION ALL\n".join(parts)


def _z_sql():
    return f"""
WITH pop AS ({_agg_sql(LINEITEM_NUMERIC)}),
smp AS ({_agg_sql(LINEITEM_NUMERIC, "l_returnflag")}),
nn AS (SELECT l_returnflag, max(count) AS sample_size FROM smp GROUP BY 1),
z AS (SELECT smp.l_returnflag, smp.field, smp.count, nn.sample_size, smp.mean,
             (smp.mean - pop.mean) / (pop.stddev / sqrt(CAST(nn.sample_size AS DOUBLE))) AS zscore
      FROM smp JOIN nn USING (l_returnflag) LEFT JOIN pop USING (field))"""


# Two-sided normal p-value without erf: Phi(x) = 1/2 + phi(x) * sum_k x^(2k+1) / (2k+1)!!
# (150 terms; |z| > 8 rounds to 0 at 6 places).
def pvalue_sql(z: str) -> str:
    return f"""
CASE WHEN {z} IS NULL THEN NULL
     WHEN abs({z}) > 8 THEN 0.0
     WHEN {z} = 0 THEN 1.0
     ELSE 1.0 - 2.0 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150),
          lambda k: exp((2 * k + 1) * ln(abs({z})) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))
END"""

STATS_SQL = {
    "summary_stats": f"""
SELECT field, count, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(min, 6) AS min,
       round(max, 6) AS max FROM ({_agg_sql(LINEITEM_NUMERIC)})""",
    "summary_wide": "\nUNION ALL\n".join(
        f"SELECT '{row}' AS summary, " + ", ".join(
            f"round(CAST({fn.format(c=c)} AS DOUBLE), 6) AS {c}" for c in LINEITEM_NUMERIC) + " FROM lineitem"
        for row, fn in (("count", "count({c})"), ("mean", "avg(CAST({c} AS DOUBLE))"),
                        ("stddev", "stddev_samp(CAST({c} AS DOUBLE))"), ("min", "min({c})"),
                        ("max", "max({c})"))),
    "zscore_by_sample": _z_sql() + """
SELECT l_returnflag, field, count, sample_size, round(mean, 6) AS mean, round(zscore, 6) AS zscore FROM z""",
    "pvalue_by_sample": _z_sql() + f"""
SELECT l_returnflag, field, round(zscore, 6) AS zscore, round({pvalue_sql("zscore")}, 6) AS pvalue FROM z""",
}


# --------------------------------------------------------------------------- features

def q_numeric_features(spark, d):
    li = table(spark, d, "lineitem")
    return features.feature_vector(li, LINEITEM_NUMERIC, keep=["l_orderkey", "l_linenumber"])


def q_standardize(spark, d):
    li = table(spark, d, "lineitem")
    params = features.fit_standardizer(li, LINEITEM_MEASURES)
    out = features.apply_standardizer(li, params, suffix="_z")
    return out.select("l_orderkey", "l_linenumber", *[r6(c + "_z").alias(c + "_z") for c in LINEITEM_MEASURES])


def q_batch_sizes(spark, d):
    idx = with_row_index(table(spark, d, "events").select("event_id"), "event_id")
    return features.batch_summary(features.assign_batches(idx, 64))


def q_split_batches(spark, d):
    """Events in three splits, each in batches of its own size (64, 1000 and 1000 rows). [D5]"""
    part = F.pmod("event_id", F.lit(10))
    split = F.when(part == 0, "test").when(part == 1, "validation").otherwise("train")
    events = table(spark, d, "events").select("event_id", split.alias("split"))
    batched = features.assign_split_batches(events, "split", "event_id")
    return features.batch_summary(batched, by=["split"])


def _scored(spark, d):
    emb = table(spark, d, "embeddings")
    idx = with_row_index(emb, "vec_id")
    batched = features.assign_batches(idx, 64)
    return evaluate.row_losses(batched, "embedding", "label")


def q_logloss_batches(spark, d):
    b = evaluate.batch_losses(_scored(spark, d))
    return b.select("batch", "n_rows", r6("loss").alias("loss"))


def q_logloss_mean(spark, d):
    e = evaluate.epoch_loss(evaluate.batch_losses(_scored(spark, d)))
    return e.select(r6("mean_batch_loss").alias("mean_batch_loss"),
                    r6("mean_row_loss").alias("mean_row_loss"), "n_batches", "n_rows")


_LOSS_SQL = """
WITH idx AS (SELECT CAST(embedding AS DOUBLE[]) AS x, label,
                    (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch FROM embeddings),
lse AS (SELECT batch, x, label, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))))
               AS z FROM idx),
rows AS (SELECT batch, -(x[label + 1] - z) AS loss FROM lse),
b AS (SELECT batch, count(*) AS n_rows, avg(loss) AS loss FROM rows GROUP BY batch)"""

FEATURE_SQL = {
    "numeric_features": "SELECT l_orderkey, l_linenumber, [" + ", ".join(
        f"CAST({c} AS DOUBLE)" for c in LINEITEM_NUMERIC) + "] AS features FROM lineitem",
    "standardize": "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}_z" for c in LINEITEM_MEASURES)
    + " FROM lineitem",
    "batch_sizes": """
SELECT batch, count(*) AS n_rows, min(row_idx) AS first_row, max(row_idx) AS last_row
FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx,
             (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch FROM events) GROUP BY batch""",
    "split_batches": """
WITH s AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split
           FROM events),
i AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY event_id) - 1 AS row_idx FROM s)
SELECT split, row_idx // CASE split WHEN 'train' THEN 64 ELSE 1000 END AS batch, count(*) AS n_rows,
       min(row_idx) AS first_row, max(row_idx) AS last_row FROM i GROUP BY 1, 2""",
    "logloss_batches": _LOSS_SQL + "\nSELECT batch, n_rows, round(loss, 6) AS loss FROM b",
    "logloss_mean": _LOSS_SQL + """
SELECT round(avg(loss), 6) AS mean_batch_loss, round(sum(loss * n_rows) / sum(n_rows), 6) AS mean_row_loss,
       count(*) AS n_batches, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM b""",
}


# --------------------------------------------------------------------------- fleet metrics

def _events(spark, d):
    return table(spark, d, "events")


def q_metric_avg_60s(spark, d):
    w = metrics.window_stat(_events(spark, d), "ts", "user_id", "value", 60, "avg")
    return w.withColumn("value", r6("value"))


def q_metric_min_60s(spark, d):
    return metrics.window_stat(_events(spark, d), "ts", "user_id", "value", 60, "min")


def q_metric_max_60s(spark, d):
    return metrics.window_stat(_events(spark, d), "ts", ["user_id", "event_type"], "value", 60, "max")


def q_metric_pivot(spark, d):
    p = metrics.pivot_metrics(_events(spark, d), "ts", "user_id", "event_type", "value", EVENT_TYPES, 3600)
    return p.select("window_start", "window_end", "user_id", *[r6(m).alias(m) for m in EVENT_TYPES])


def q_metric_selected_instances(spark, d):
    """Hourly average for the users registered as BUILDING-segment customers."""
    watched = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("user_id"))
    ev = metrics.restrict(_events(spark, d), watched, "user_id")
    return metrics.window_stat(ev, "ts", "user_id", "value", 3600, "avg").withColumn("value", r6("value"))


def q_latest_rows(spark, d):
    return metrics.latest(_events(spark, d), "ts", ["ts", "user_id", "props"], 20, tiebreak=["event_id"])


def q_alarm_low(spark, d):
    a = metrics.threshold_alarm(_events(spark, d), "ts", "event_type", "value", 3600, 35.0, "<")
    return a.withColumn("value", r6("value"))


def q_alarm_sustained(spark, d):
    return metrics.sustained_alarm(_events(spark, d), "ts", "event_type", "value", 3600, 45.0, ">=", 5, 5)


def q_alarm_3_of_5(spark, d):
    return metrics.sustained_alarm(_events(spark, d), "ts", "event_type", "value", 3600, 60.0, ">=", 3, 5)


def _win_sql(period_s, keys, stat, value="value", name="value", where="", rnd=True):
    v = f"{stat}({value})"
    v = f"round({v}, 6)" if rnd else v
    return f"""
SELECT time_bucket(INTERVAL '{period_s} seconds', ts) AS window_start,
       time_bucket(INTERVAL '{period_s} seconds', ts) + INTERVAL '{period_s} seconds' AS window_end,
       {keys}, {v} AS {name}
FROM events {where} GROUP BY 1, 2, {keys}"""


def _sustained_sql(threshold, m, n):
    return f"""
WITH w AS (SELECT time_bucket(INTERVAL '3600 seconds', ts) AS ws, event_type, avg(value) AS v
           FROM events GROUP BY 1, 2),
c AS (SELECT event_type, ws,
             count(*) FILTER (WHERE v >= {threshold}) OVER (PARTITION BY event_type ORDER BY ws
                 RANGE BETWEEN INTERVAL '{(n - 1) * 3600} seconds' PRECEDING AND CURRENT ROW) AS breaches
      FROM w)
SELECT event_type, ws AS window_start, ws + INTERVAL '3600 seconds' AS window_end, breaches
FROM c WHERE breaches >= {m}"""


METRIC_SQL = {
    "metric_avg_60s": _win_sql(60, "user_id", "avg"),
    "metric_min_60s": _win_sql(60, "user_id", "min", rnd=False),
    "metric_max_60s": _win_sql(60, "user_id, event_type", "max", rnd=False),
    "metric_pivot": """
SELECT time_bucket(INTERVAL '3600 seconds', ts) AS window_start,
       time_bucket(INTERVAL '3600 seconds', ts) + INTERVAL '3600 seconds' AS window_end, user_id, """
    + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{m}'), 6) AS {m}" for m in EVENT_TYPES)
    + " FROM events WHERE event_type IN (" + ", ".join(f"'{m}'" for m in EVENT_TYPES) + ") GROUP BY 1, 2, 3",
    "metric_selected_instances": _win_sql(
        3600, "user_id", "avg",
        where="WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "latest_rows": "SELECT ts, user_id, props FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "alarm_low": "SELECT window_start, window_end, event_type, round(value, 6) AS value FROM ("
    + _win_sql(3600, "event_type", "avg", rnd=False) + ") WHERE value < 35.0",
    "alarm_sustained": _sustained_sql(45.0, 5, 5),
    "alarm_3_of_5": _sustained_sql(60.0, 3, 5),
}


# --------------------------------------------------------------------------- registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "row_index": q_row_index,
    "shard_assignment": q_shard_assignment,
    "shard_worker_slice": q_shard_worker_slice,
    "shard_oversize_wrap": q_shard_oversize_wrap,
    "slice_rows": q_slice_rows,
    "slice_rows_wrap": q_slice_rows_wrap,
    "shard_matrices": q_shard_matrices,
    "manifest_offsets": q_manifest_offsets,
    "manifest_zero_row": q_manifest_zero_row,
    "manifest_totals": q_manifest_totals,
    "read_spec": q_read_spec,
    "read_spec_wrap": q_read_spec_wrap,
    "uri_pairing": q_uri_pairing,
    "partition_counts": q_partition_counts,
    "summary_stats": q_summary_stats,
    "summary_wide": q_summary_wide,
    "zscore_by_sample": q_zscore_by_sample,
    "pvalue_by_sample": q_pvalue_by_sample,
    "numeric_features": q_numeric_features,
    "standardize": q_standardize,
    "batch_sizes": q_batch_sizes,
    "split_batches": q_split_batches,
    "logloss_batches": q_logloss_batches,
    "logloss_mean": q_logloss_mean,
    "metric_avg_60s": q_metric_avg_60s,
    "metric_min_60s": q_metric_min_60s,
    "metric_max_60s": q_metric_max_60s,
    "metric_pivot": q_metric_pivot,
    "metric_selected_instances": q_metric_selected_instances,
    "latest_rows": q_latest_rows,
    "alarm_low": q_alarm_low,
    "alarm_sustained": q_alarm_sustained,
    "alarm_3_of_5": q_alarm_3_of_5,
    **objects.QUERIES,
    **streams.QUERIES,
}

ORACLE_SQL: dict[str, str] = {**SHARD_SQL, **MANIFEST_SQL, **STATS_SQL, **FEATURE_SQL, **METRIC_SQL,
                              **objects.oracle_sql(),
                              # What a stream emits in all is what the batch query gives.
                              **{name: METRIC_SQL[name.removeprefix("stream_")] for name in streams.QUERIES}}
