"""Customer recency / frequency / monetary segmentation (M1-M9).

RFM is one ``groupBy(customer)`` (partial aggregation: a customer holding a
third of all rows collapses to one row per map task).  Standardisation and
K-Means run on the per-customer table: all restarts advance together, one
pass and one small aggregate an iteration, and the lowest cost wins.  Cluster
labels come from a k-row ranking, broadcast back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import exprs, rules
from ..session import stage


def rfm(df: DataFrame, customer: str, amount: str, date: str | None = None) -> DataFrame:
    """M2 + M3: customer_code, last_date, frequency, monetary, recency.

    Recency is whole days (floor of 24-hour periods) from the latest
    purchase of all customers; 0 when there is no date column.
    """
    aggs = [F.count(F.lit(1)).alias("frequency"), F.sum(F.col(amount)).cast("double").alias("monetary")]
    if date:
        aggs.insert(0, F.max(F.col(date)).cast("timestamp").alias("last_date"))
    per = df.groupBy(F.col(customer).alias("customer_code")).agg(*aggs)
    if not date:
        return per.withColumn("last_date", F.lit(None).cast("timestamp")).withColumn("recency", F.lit(0).cast("long"))
    # read three times from here on (latest date, z-score moments, rows): written once
    per = stage(per, "rfm")
    # one scalar, not a data set: the global latest purchase
    top = per.agg(F.max("last_date").alias("m")).first()["m"]
    if top is None:
        return per.withColumn("recency", F.lit(0).cast("long"))
    gap = F.unix_micros(F.lit(top).cast("timestamp")) - F.unix_micros(F.col("last_date"))
    return per.withColumn("recency", F.floor(gap / F.lit(86_400_000_000)).cast("long"))


def rule_segments(r: DataFrame) -> DataFrame:
    """M7: threshold segments (used when there are fewer than 4 customers)."""
    return r.withColumn(
        "segment",
        F.when(F.col("frequency") >= rules.RULE_CHAMPION_FREQ, F.lit("Champions"))
         .when(F.col("recency") > rules.RULE_AT_RISK_DAYS, F.lit("At-Risk"))
         .otherwise(F.lit("Loyal Customers")))


FEATURES = ["recency", "frequency", "monetary"]


def standardize(r: DataFrame) -> DataFrame:
    """M4: z-scores with the population standard deviation (0 when constant)."""
    st = r.agg(*[F.avg(c).alias(f"mu_{c}") for c in FEATURES],
               *[F.stddev_pop(c).alias(f"sd_{c}") for c in FEATURES]).first()
    out = r
    for c in FEATURES:
        mu, sd = st[f"mu_{c}"], st[f"sd_{c}"]
        z = (F.col(c) - F.lit(mu)) / F.lit(sd) if sd else F.lit(0.0)
        out = out.withColumn(f"z_{c}", z.cast("double"))
    return out


INIT_ROWS = 4096  # rows the starting centres are drawn from


def starting_centres(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre drawn with the squared distance to those before."""
    draw = np.random.default_rng(seed)
    out = [points[draw.integers(len(points))]]
    for _ in range(k - 1):
        far = np.min([((points - c) ** 2).sum(axis=1) for c in out], axis=0)
        total = far.sum()
        out.append(points[draw.choice(len(points), p=far / total) if total > 0 else draw.integers(len(points))])
    return np.array(out)


def _lloyd_sums(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """One pass for all given restarts: per cluster the sums and counts of its
    points, and the cost.  Every task sends restarts x clusters rows."""
    import pyarrow as pa

    dims = len(points.columns)
    names = ["r", "c", "n", "cost", *[f"s{d}" for d in range(dims)]]

    def run(batches):
        total = {r: np.zeros((len(own), dims + 2)) for r, own in centres.items()}
        for batch in batches:
            x = np.stack([col.to_numpy(zero_copy_only=False) for col in batch.columns], axis=1)
            for r, own in centres.items():
                far = ((x[:, None, :] - own[None, :, :]) ** 2).sum(axis=2)
                near = far.argmin(axis=1)
                total[r][:, 0] += np.bincount(near, minlength=len(own))
                total[r][:, 1] += np.bincount(near, far[np.arange(len(x)), near], len(own))
                for d in range(dims):
                    total[r][:, 2 + d] += np.bincount(near, x[:, d], len(own))
        flat = np.concatenate(list(total.values()))
        ids = [(r, c) for r, own in centres.items() for c in range(len(own))]
        yield pa.RecordBatch.from_arrays([pa.array([i[0] for i in ids], pa.int32()), pa.array([i[1] for i in ids], pa.int32()),
                                          *[pa.array(flat[:, j]) for j in range(dims + 2)]], names)

    schema = "r int, c int, " + ", ".join(f"{n} double" for n in names[2:])
    found = points.mapInArrow(run, schema).groupBy("r", "c").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect()
    out = {r: (np.zeros((len(own), dims)), np.zeros(len(own)), 0.0) for r, own in centres.items()}
    for row in found:  # restarts x clusters rows
        sums, counts, cost = out[row["r"]]
        sums[row["c"]], counts[row["c"]] = [row[f"s{d}"] for d in range(dims)], row["n"]
        out[row["r"]] = (sums, counts, cost + row["cost"])
    return out


def batched_kmeans(points: DataFrame, k: int, seed: int, restarts: int, max_iter: int = 300,
                   tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """M5: centres of the lowest cost among ``restarts``, and that cost.

    ``points``: double columns only, read once an iteration.  Starts are drawn
    from the ``INIT_ROWS`` rows of smallest hash; every iteration covers all
    rows.  A restart rests when no centre moves further than ``tol``; empty
    clusters keep their centre.  Ties in cost go to the earlier restart."""
    cols = points.columns
    few = np.array([tuple(r) for r in points.orderBy(F.xxhash64(*cols), *cols).limit(INIT_ROWS).collect()], float)
    if not len(few):
        return np.zeros((k, len(cols))), 0.0
    centres = {r: starting_centres(few, k, seed + r) for r in range(restarts)}
    cost, moving = {}, dict(centres)
    for _ in range(max_iter):
        found = _lloyd_sums(points, moving)
        for r, (sums, counts, total) in found.items():
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres[r])
            if ((new - centres[r]) ** 2).sum(axis=1).max() <= tol * tol:
                moving.pop(r)
            else:
                moving[r] = new
            centres[r], cost[r] = new, total
        if not moving:
            break
    cost = {r: x[2] for r, x in _lloyd_sums(points, centres).items()}
    best = min(cost, key=lambda r: (cost[r], r))
    return centres[best], cost[best]


def assign_clusters(z: DataFrame, centres, cols: list[str] | None = None) -> DataFrame:
    """Adds ``cluster``, the nearest centre (squared distance; ties: the first)."""
    cols = cols or [f"z_{c}" for c in FEATURES]
    near = F.least(*[F.struct(sum(((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(cols, row)),
                                  F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, row in enumerate(centres)])
    return z.withColumn("cluster", near["i"])


def label_clusters(clustered: DataFrame) -> DataFrame:
    """M6: segments by the clusters' mean spend, highest first."""
    labels = F.array(*[F.lit(s) for s in rules.SEGMENT_LABELS])
    rank = (clustered.groupBy("cluster").agg(F.avg("monetary").alias("_mean"))
            .withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_mean"), "cluster")))
            .select("cluster", F.get(labels, F.col("_r") - 1).alias("segment")))
    # k rows: bounded by the number of clusters
    return clustered.join(F.broadcast(rank), "cluster")


def kmeans_segments(r: DataFrame, k: int = rules.KMEANS_K, seed: int = rules.KMEANS_SEED,
                    restarts: int = rules.KMEANS_RESTARTS) -> DataFrame:
    """M4-M6: K-Means on standardised RFM, clusters labelled by mean spend."""
    z = stage(standardize(r), "kmeans-features")  # read once an iteration
    cols = [f"z_{c}" for c in FEATURES]
    centres, _ = batched_kmeans(z.select(*cols), k, seed, restarts)
    return label_clusters(assign_clusters(z, centres)).drop(*cols)


def segment_customers(df: DataFrame, customer: str, amount: str, date: str | None = None) -> DataFrame:
    """M1-M8: per-customer rows with their segment."""
    r = rfm(df, customer, amount, date)
    n = r.count()
    seg = rule_segments(r) if n < rules.RULE_MIN_CUSTOMERS else kmeans_segments(r)
    return seg.select("customer_code", "recency", "frequency", "monetary", "segment")


def segment_summary(seg: DataFrame) -> DataFrame:
    """M9: customer_count, avg_monetary, percentage per segment."""
    total = Window.partitionBy()  # over the <= 4 aggregated rows only
    g = seg.groupBy(F.col("segment").alias("segment_name")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.avg("monetary").alias("_avg"))
    return g.select(
        "segment_name", "customer_count",
        exprs.np_round(F.col("_avg"), 2).alias("avg_monetary"),
        exprs.np_round(F.col("customer_count") / F.sum("customer_count").over(total) * 100.0, 2)
        .alias("percentage"))


def resolve_columns(prof: DataFrame) -> DataFrame:
    """M1: customer / date / amount columns from profile rows.

    customer: first Customer_ID or Email column, else the first column;
    amount: first Monetary, Quantity or Number column (column order), else
    the last column.  Output (one row): customer_col, date_col, amount_col.
    """
    sem = F.col("semantic_type")
    return prof.agg(
        F.coalesce(F.min_by("column_name", F.when(sem.isin("Customer_ID", "Email"), F.col("ordinal"))),
                   F.min_by("column_name", F.col("ordinal"))).alias("customer_col"),
        F.min_by("column_name", F.when(sem == "Date", F.col("ordinal"))).alias("date_col"),
        F.coalesce(F.min_by("column_name", F.when(sem.isin("Monetary", "Quantity", "Number"),
                                                  F.col("ordinal"))),
                   F.max_by("column_name", F.col("ordinal"))).alias("amount_col"))


def scatter_points(seg: DataFrame) -> DataFrame:
    """Frequency x monetary per customer, tagged by segment."""
    return seg.select("customer_code", F.col("frequency").alias("x"), F.col("monetary").alias("y"),
                      "segment")

