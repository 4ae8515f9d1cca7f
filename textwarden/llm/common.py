"""What the operators of this subpackage share: shared storage, words, labelled samples, calibration."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to Python at once: a batch of Arrow rows is worked on in slices of about so many characters.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    there = "file://" + tempfile.mkdtemp(prefix="textwarden-")
    spark.conf.set("spark.checkpoint.dir", there)
    return there


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textwarden/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textwarden_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that written() made and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_textwarden_path", None)
        if path:
            jvm = df.sparkSession._jvm
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _scanned(docs: DataFrame) -> bool:
    """Whether a table's files are read with nothing but columns and conditions on top, so that a row is named by its place."""
    try:
        node = docs._jdf.queryExecution().analyzed()
        while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and node.deterministic():
            node = node.children().apply(0)
        if node.nodeName() != "LogicalRelation" or "_metadata" in {c.lower() for c in docs.columns}:
            return False
        docs.select("_metadata.file_path", "_metadata.row_index").schema
        return True
    except (AttributeError, AnalysisException):
        return False


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a column that names each row, by its file and its place in it: the same whenever and however the files are
    read again, on whatever executors. What is not a plain scan of Parquet files is written first."""
    if not _scanned(docs):
        docs = written(docs)
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return docs.select("*", place.alias(name))


ROW = "struct<file:bigint,at:bigint>"


def _released() -> None:
    """Gives freed memory back, as Python workers outlive their tasks beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: Rows of an Arrow batch where the session has no figure of its own: whole texts are large rows, and each batch is held by
#: the JVM, outside its heap, and by the worker.
BATCH_ROWS, _ROWS = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), with a worker's memory given back when a partition ends. Sets the session's rows of a batch
    to BATCH_ROWS if they are at their default."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS) == "10000":
        conf.set(_ROWS, str(BATCH_ROWS))

    def released(batches):
        try:
            yield from run(batches)
        finally:
            _released()

    return df.mapInArrow(released, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds one text or at most about so many characters."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


#: Lower-cases A-Z and makes every other ASCII byte that is not a letter or a digit a blank.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def held_out(doc_id, modulus: int, remainder: int):
    """Rows that learning never sees: crc32 of the id as text, by its remainder. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most per_class documents of each label 0 and 1, and how many labelled ids each class has.

    Takes the ids with the smallest hashes, so a sample is the same in every run. Ids whose labels contradict each
    other, and null ids, labels and texts, are left out.
    """
    kept = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other").select("doc_id", "y")
    )
    sizes = {int(r["y"]): int(r["n"]) for r in kept.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    parts = [kept.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class ids: a few hundred kB however large the tables are
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(ids, "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")), {0: sizes.get(0, 0), 1: sizes.get(1, 0)}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression with an intercept as the last, by Newton's method."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))
