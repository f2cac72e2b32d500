"""Dataset storage and catalog.

A dataset version is a Parquet directory; the catalog is a set of Parquet
tables.  A publish stages everything under names of its own: the data in a
fresh directory, its catalog rows in one ``commit_id=...`` partition of each
table.  One commit file makes all of it visible at once.  It is named by the
next number of its dataset version and created only if no such file exists, so
of two writers that began from the same state one is refused.  A publish that
fails before its commit file takes back what it has written; the version
before it is never touched.  Readers follow commit files only.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.profile import PROFILE_SCHEMA
from ..operators.profile_state import STATE_SCHEMA, column_states, merge_states, profile_of_state
from ..session import stage

CATALOG_SCHEMAS = {
    "datasets": ("dataset_id string, filename string, domain string, confidence_score double, "
                 "record_count long, uploaded_by string, version string, path string, created_at timestamp"),
    "upload_history": ("upload_id string, filename string, uploaded_by string, status string, "
                       "records_processed long, created_at timestamp"),
    # what ingest derives, stored once so that reports and digests read it
    "column_metadata": f"dataset_id string, {PROFILE_SCHEMA}",
    "column_states": f"dataset_id string, {STATE_SCHEMA}",  # what a profile of appended rows is merged with
    "generated_kpis": "dataset_id string, kpi_order int, kpi_name string, formula string",
    "dataset_parts": "dataset_id string, part int, path string",
    "generated_insights": "dataset_id string, insight_order int, text string",
    "audit_logs": ("user_id string, action string, table_name string, record_id string, details string, "
                   "created_at timestamp"),
}
COMMIT_SCHEMA = "dataset_id string, version string, seq long, commit_id string, path string, created_at timestamp"


class ConcurrentWriteError(RuntimeError):
    """Another publish of the same dataset version was committed meanwhile."""


# ---------------------------------------------------------------- shared file system
def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder (none, if it does not exist)."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if it does."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:  # noqa: BLE001 - the JVM's FileAlreadyExistsException
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


# ---------------------------------------------------------------- commits
def _root(root: str) -> str:
    return root.rstrip("/")


def _safe(name: str) -> str:
    """A name as one path component."""
    import urllib.parse

    return urllib.parse.quote(name, safe="") or "_"


def dataset_path(root: str, dataset_id: str, version: str = "cleaned") -> str:
    return f"{_root(root)}/datasets/{_safe(dataset_id)}/version={_safe(version)}"


def _commit_dir(root: str, dataset_id: str, version: str) -> str:
    return f"{_root(root)}/catalog/commits/{_safe(dataset_id)}/{_safe(version)}"


def last_seq(spark: SparkSession, root: str, dataset_id: str, version: str = "cleaned") -> int:
    """Number of the last commit of a dataset version, 0 before the first."""
    names = [n for n in _names(spark, _commit_dir(root, dataset_id, version)) if n.endswith(".json")]
    return max((int(n.split(".")[0]) for n in names), default=0)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """Every commit: dataset_id, version, seq, commit_id, path, created_at."""
    if not _names(spark, f"{_root(root)}/catalog/commits"):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).json(f"{_root(root)}/catalog/commits/*/*/*.json")


def live_commits(spark: SparkSession, root: str) -> DataFrame:
    """The last commit of every dataset version."""
    newest = Window.partitionBy("dataset_id", "version").orderBy(F.desc("seq"))
    return commits(spark, root).withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")


class Publish:
    """One publish of a dataset version: stage data and catalog rows, then
    commit.  As a context manager it takes everything back on an error.

    The commit number to claim is fixed when the publish begins, so a commit
    by someone else in between is noticed."""

    def __init__(self, spark: SparkSession, root: str, dataset_id: str, version: str = "cleaned"):
        self.spark, self.root, self.dataset_id, self.version = spark, _root(root), dataset_id, version
        self.commit_id = uuid.uuid4().hex
        self.seq = last_seq(spark, root, dataset_id, version) + 1
        self.path = f"{dataset_path(root, dataset_id, version)}/commit_id={self.commit_id}"
        self.staged: list[str] = []
        self.committed = False

    def _write(self, df: DataFrame, path: str) -> None:
        self.staged.append(path)  # before the write: a failed one leaves files too
        df.write.mode("error").parquet(path)

    def data(self, df: DataFrame) -> str:
        """S3: the dataset's rows, in a directory of their own."""
        self._write(df, self.path)
        return self.path

    def rows(self, table: str, rows: list[tuple] | DataFrame) -> None:
        """Rows of a catalog table, in this commit's partition of it."""
        schema = T._parse_datatype_string(CATALOG_SCHEMAS[table])
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema)
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        self._write(df, f"{self.root}/catalog/{table}/commit_id={self.commit_id}")

    def commit(self) -> None:
        """Make all of it visible; refused if the number is taken."""
        now = _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        row = {"dataset_id": self.dataset_id, "version": self.version, "seq": self.seq, "commit_id": self.commit_id,
               "path": self.path, "created_at": now}
        name = f"{_commit_dir(self.root, self.dataset_id, self.version)}/{self.seq:012d}.json"
        if not _create_new(self.spark, name, json.dumps(row)):
            raise ConcurrentWriteError(f"{self.dataset_id}, version {self.version}: commit {self.seq} exists already")
        self.committed = True

    def roll_back(self) -> None:
        for path in reversed(self.staged):
            _remove(self.spark, path)
        self.staged.clear()

    def __enter__(self) -> "Publish":
        return self

    def __exit__(self, kind, error, trace) -> bool:
        try:
            if kind is None and not self.committed:
                self.commit()
        finally:
            if not self.committed:
                self.roll_back()
        return False


def publish(df: DataFrame, root: str, dataset_id: str, filename: str, owner: str, domain: str,
            confidence: float, record_count: int, version: str = "cleaned",
            metadata: dict[str, DataFrame] | None = None) -> str:
    """S3 + S5: data, catalog rows and ``metadata`` (catalog table to rows
    without dataset_id) of one dataset version, visible together or not at all."""
    with Publish(df.sparkSession, root, dataset_id, version) as p:
        path = p.data(df)
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        p.rows("datasets", [(dataset_id, filename, domain, float(confidence), int(record_count), owner, version, path, now)])
        p.rows("upload_history", [(dataset_id, filename, owner, "Success", int(record_count), now)])
        p.rows("audit_logs", [(owner, "INGEST_SCHEMA_AWARE", "datasets", dataset_id,
                               f"Uploaded and parsed business dataset {filename}. Domain classified as {domain}.", now)])
        for table, rows in (metadata or {}).items():
            p.rows(table, rows.withColumn("dataset_id", F.lit(dataset_id)))
    return path


def write_dataset(df: DataFrame, root: str, dataset_id: str, version: str = "cleaned") -> str:
    """Publish the rows of a dataset version alone."""
    with Publish(df.sparkSession, root, dataset_id, version) as p:
        path = p.data(df)
    return path


def store_metadata(root: str, dataset_id: str, prof: DataFrame, kpis: DataFrame, insights: DataFrame,
                   version: str = "metadata") -> None:
    """The profile (P1-P7), KPIs (P9) and insights (P12) of a dataset,
    published together; the last ones stored are the ones read."""
    with Publish(prof.sparkSession, root, dataset_id, version) as p:
        for table, df in (("column_metadata", prof), ("generated_kpis", kpis), ("generated_insights", insights)):
            p.rows(table, df.withColumn("dataset_id", F.lit(dataset_id)))


def append_rows(df: DataFrame, root: str, dataset_id: str, version: str = "cleaned") -> str:
    """Publish a dataset version grown by ``df``, with its profile.

    Only the new rows are profiled: their column states are merged with the
    stored ones.  Files of the version before are read by the new one, not
    copied: the commit's folder holds the new rows, and a list of the folders
    before it is kept in the commit's rows."""
    spark = df.sparkSession
    with Publish(spark, root, dataset_id, version) as p:
        path = p.data(df)
        state = column_states(df)
        if p.seq > 1:
            state = merge_states(stored_metadata(spark, root, "column_states", dataset_id, version), state)
            before = stored_metadata(spark, root, "dataset_parts", dataset_id, version)
            parts = [r["path"] for r in before.orderBy("part").collect()]  # one row an append
            state = spark.createDataFrame(state.collect(), state.schema)  # one row a column
        else:
            parts = []
        p.rows("dataset_parts", [(dataset_id, i, x) for i, x in enumerate([*parts, path])])
        p.rows("column_states", state.withColumn("dataset_id", F.lit(dataset_id)))
        p.rows("column_metadata", profile_of_state(state).withColumn("dataset_id", F.lit(dataset_id)))
    return path


def read_parts(spark: SparkSession, root: str, dataset_id: str, version: str = "cleaned") -> DataFrame:
    """All rows of a dataset version built by :func:`append_rows`."""
    parts = stored_metadata(spark, root, "dataset_parts", dataset_id, version).orderBy("part").collect()
    return spark.read.parquet(*[r["path"] for r in parts])


# ---------------------------------------------------------------- readers
def read_dataset(spark: SparkSession, root: str, dataset_id: str, version: str = "cleaned", seq: int | None = None) -> DataFrame:
    """The rows of a dataset version as last committed, or as of commit ``seq``."""
    seq = last_seq(spark, root, dataset_id, version) if seq is None else seq
    names = _names(spark, _commit_dir(root, dataset_id, version))
    if f"{seq:012d}.json" not in names:
        raise LookupError(f"{dataset_id}, version {version}: no commit {seq}")
    row = spark.read.schema(COMMIT_SCHEMA).json(f"{_commit_dir(root, dataset_id, version)}/{seq:012d}.json").first()
    return spark.read.parquet(row["path"])


def read_catalog(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of a catalog table that live commits published.

    The commit is a partition of the table, so files of other commits are not
    opened where the planner prunes, and never seen where it does not."""
    if not _names(spark, f"{_root(root)}/catalog/{table}"):
        return spark.createDataFrame([], CATALOG_SCHEMAS[table])
    rows = spark.read.schema(f"{CATALOG_SCHEMAS[table]}, commit_id string").parquet(f"{_root(root)}/catalog/{table}")
    return rows.join(live_commits(spark, root).select("commit_id"), "commit_id", "left_semi").drop("commit_id")


def stored_metadata(spark: SparkSession, root: str, table: str, dataset_id: str, version: str = "metadata") -> DataFrame:
    """The stored rows of one dataset: the partition of its last commit."""
    schema = T._parse_datatype_string(CATALOG_SCHEMAS[table])
    seq = last_seq(spark, root, dataset_id, version)
    if not seq:
        return spark.createDataFrame([], schema).drop("dataset_id")
    row = spark.read.schema(COMMIT_SCHEMA).json(f"{_commit_dir(root, dataset_id, version)}/{seq:012d}.json").first()
    path = f"{_root(root)}/catalog/{table}/commit_id={row['commit_id']}"
    return (spark.read.schema(schema).parquet(path) if _names(spark, path) else spark.createDataFrame([], schema)).drop("dataset_id")


def orphans(spark: SparkSession, root: str) -> list[str]:
    """Staged directories that no commit names: what a writer that died before
    its rollback has left (or is still writing)."""
    root = _root(root)
    known = {r["commit_id"] for r in commits(spark, root).select("commit_id").collect()}  # one row a publish
    found = []
    for table in CATALOG_SCHEMAS:
        found += [f"{root}/catalog/{table}/{n}" for n in _names(spark, f"{root}/catalog/{table}")]
    for dataset in _names(spark, f"{root}/datasets"):
        for version in _names(spark, f"{root}/datasets/{dataset}"):
            at = f"{root}/datasets/{dataset}/{version}"
            found += [f"{at}/{n}" for n in _names(spark, at)]
    return [p for p in found if p.rsplit("commit_id=", 1)[-1] not in known]


def remove_orphans(spark: SparkSession, root: str) -> list[str]:
    """Remove what :func:`orphans` finds; only while no publish is running."""
    gone = orphans(spark, root)
    for path in gone:
        _remove(spark, path)
    return gone


def dataset_lists(catalog: DataFrame) -> DataFrame:
    """S6 for all owners: every owner's datasets with their position, newest first."""
    newest = Window.partitionBy("uploaded_by").orderBy(F.desc("created_at"), "dataset_id")
    return catalog.withColumn("position", F.row_number().over(newest).cast("long"))


def list_datasets(catalog: DataFrame, owner: str) -> DataFrame:
    """An owner's datasets, newest first."""
    return catalog.where(F.col("uploaded_by") == owner).orderBy(F.desc("created_at"), "dataset_id")


def resolve_datasets(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """S7 for many requests at once: the requested dataset if the owner has
    it, else the owner's most recent one, else null.

    ``requests``: owner, dataset_id (nullable).  Output: owner,
    requested_id, resolved_id.  Two equi-joins and one partial aggregate
    -- no request is paired with all datasets of its owner.
    """
    latest = catalog.groupBy(F.col("uploaded_by").alias("owner")).agg(
        F.max_by("dataset_id", F.struct("created_at", "dataset_id")).alias("_latest"))
    owned = catalog.select(F.col("uploaded_by").alias("owner"), F.col("dataset_id").alias("requested_id"),
                           F.lit(True).alias("_owned")).distinct()
    req = requests.select("owner", F.col("dataset_id").alias("requested_id"))
    j = req.join(owned, ["owner", "requested_id"], "left").join(latest, "owner", "left")
    return j.select("owner", "requested_id",
                    F.when(F.col("_owned"), F.col("requested_id")).otherwise(F.col("_latest")).alias("resolved_id"))


# ---------------------------------------------------------------- version difference
def _digest(cols: list[str]) -> list:
    """Two 64-bit hashes of a row (128 bits); nulls count as values of their own."""
    flat = []
    for c in cols:
        flat += [F.col(c).isNull(), F.col(c)]
    return [F.xxhash64(*flat).alias("_a"), F.xxhash64(F.lit(1), *reversed(flat)).alias("_b")]


def version_difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How two versions of a dataset (same columns) differ as multisets of rows.

    Output: the columns, ``change`` and ``copies``.  A row that one version
    holds more often than the other is listed once, with the surplus as
    ``copies``: "added" or "removed", or "changed_to" and "changed_from" where
    its key has rows on both sides of the difference.  Equal rows are found by
    narrow digests; whole rows move only for digests whose counts differ.
    NaN equals NaN; null keys are keys like any other."""
    cols = old.columns
    new = new.select(*cols)
    marked = old.select(*cols, *_digest(cols), F.lit(-1).alias("_s")).unionByName(
        new.select(*cols, *_digest(cols), F.lit(1).alias("_s")))
    # written, so that the join below is planned by its size: a small difference is broadcast
    counts = stage(marked.groupBy("_a", "_b").agg(F.sum("_s").alias("_net")).where("_net <> 0"), "difference")
    side = F.when(F.col("_net") > 0, 1).otherwise(-1)
    rows = marked.join(counts, ["_a", "_b"]).where(F.col("_s") == side)
    once = rows.groupBy("_a", "_b", "_net").agg(*[F.first(c).alias(c) for c in cols])
    by_key = Window.partitionBy(*keys)
    both = (F.min("_net").over(by_key) < 0) & (F.max("_net").over(by_key) > 0)
    change = (F.when(both & (F.col("_net") > 0), "changed_to").when(both, "changed_from")
              .when(F.col("_net") > 0, "added").otherwise("removed"))
    return once.select(*cols, change.alias("change"), F.abs("_net").alias("copies"))
