"""Session helpers: a default session, the shared folder for cut lineage, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its measured size is below this many bytes.
BROADCAST_BYTES = 32 << 20


def session(name: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE); `conf` overrides with `_` for `.`."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that it needn't be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_leafmill_shipped", False):
        return
    home = Path(__file__).resolve().parent
    # the driver serves this file to executors for as long as the application runs
    d = tempfile.mkdtemp(prefix="leafmill-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    with zipfile.ZipFile(f"{d}/leafmill.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(z.filename)
    sc._leafmill_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session that names none (tests) gets a folder of its own.

    On a cluster a machine-local folder would be out of the other machines' sight, so a session without
    a shared one is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"master {master} needs spark.checkpoint.dir, a folder that all machines share")
    local = tempfile.mkdtemp(prefix="leafmill-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    own = f"file://{local}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/leafmill-{spark.sparkContext.applicationId}"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def drop_written(spark: SparkSession, since: set[str] | None = None) -> int:
    """Remove what this application's `written` left in the shared folder, once its results are read; tells how many tables.

    `since` keeps the tables that `written_tables` named before: `mine = written_tables(spark)`, run a
    query, read its result, `drop_written(spark, mine)`.
    """
    found = written_tables(spark) - (since or set())
    for name in found:
        fs, p = _files(spark, f"{_own_dir(spark)}/{name}")
        fs.delete(p, True)
    return len(found)


def written_tables(spark: SparkSession) -> set[str]:
    """The names of this application's written tables."""
    fs, p = _files(spark, _own_dir(spark))
    return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it a query is run and its result read; what it wrote on the way is removed at the end."""
    before = written_tables(spark)
    try:
        yield
    finally:
        drop_written(spark, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of `df` with a Parquet table in the shared folder and read it back.

    Unlike an executor-local cache it survives lost executors; unlike a serialised checkpoint it is
    columnar, compressed and prunes columns when it is read. The tables of one application stand in
    one folder; `tidy` and `drop_written` remove them.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """The bytes of all values of a written table as a hash table holds them: fixed widths by the row count, texts and arrays by summing."""
    fixed, sums = 48, []  # a row's own share
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sums.append(F.sum(F.octet_length(f.name)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            sums.append(F.sum(F.octet_length(F.to_json(F.struct(f.name)))))
        fixed += 16
    row = df.agg(F.count("*"), *sums).first()
    return row[0] * fixed + sum(x or 0 for x in row[1:])


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast of a *written* `df` only if its values measure no more than `limit` bytes (BROADCAST_BYTES).

    Beyond it the frame comes back without a hint, so the join shuffles (AQE splits skewed partitions).
    The measure reads the table's text columns once; numbers cost the footers only.
    """
    return F.broadcast(df) if measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df
