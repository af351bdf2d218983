"""Plumbing shared by the operators: shared-folder tables, appended columns,
hot-bucket splitting and connected components."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc  # by its own name it travels with functions; pa.compute may not be loaded in a worker
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship


#: Rows that with_fields hands to a function at once.
ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in a local session without
    that setting, a temporary folder of this machine."""
    ship(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="tessellar-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and
    losing an executor loses nothing.  drop: an earlier cut() that is no longer
    needed.  What is left goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessellar-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._cut_at = path
    release(drop)
    return out


def release(df: DataFrame | None) -> None:
    """Deletes the files of a table made by cut()."""
    at = getattr(df, "_cut_at", None)
    if at:
        fs, p = _fs(df.sparkSession, at)
        fs.delete(p, True)


def give_back() -> None:
    """Returns this Python process's free memory to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, after which the worker gives its free memory back: workers
    are kept for later tasks, and what they hold counts against the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def same_name(name: str, others: list[str]) -> bool:
    """Whether a column's name is one of the others, case aside, as Spark compares them by default."""
    return name.lower() in {o.lower() for o in others}


def with_fields(df: DataFrame, fn: Callable[[Iterator[pa.Table]], Iterator[pa.Table]], needs: dict[str, str], adds: list[tuple[str, T.DataType]]) -> DataFrame:
    """df with columns that fn computes from some of its columns, in one pass.

    fn maps an iterator of tables holding the columns `needs` (new name ->
    df's name) to an iterator of tables of as many rows holding the columns
    `adds`.  Every other column passes through as it is; a column of df named
    like an added one (whatever the case, if the session doesn't tell) is replaced.
    """
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if not same_name(f.name, [n for n, _ in adds])]
    own = [f.name for f in kept]
    # what fn needs is read from the row itself, if it is there: no column travels twice
    apart = [k for k, src in needs.items() if src not in own]
    packed = df.select(
        F.struct(*[F.col(f"`{n}`") for n in own]).alias("row") if kept else F.lit(1).alias("row"),
        *[F.col(f"`{needs[k]}`").alias(f"in_{k}") for k in apart],
    )
    row_type = packed.schema["row"].dataType
    schema = T.StructType([T.StructField("row", row_type), *[T.StructField(f"out_{n}", t) for n, t in adds]])
    place = {k: ("in", apart.index(k) + 1) if k in apart else ("row", own.index(src)) for k, src in needs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.Array] = []

        def feed() -> Iterator[pa.Table]:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    some = b.slice(at, ROWS)
                    rows.append(some.column(0))
                    yield pa.table({k: some.column(i) if kind == "in" else pc.struct_field(some.column(0), [i]) for k, (kind, i) in place.items()})

        for made in fn(feed()):
            made = made.combine_chunks()
            columns = [made.column(n).combine_chunks() if made.column(n).num_chunks != 1 else made.column(n).chunk(0) for n, _ in adds]
            yield pa.RecordBatch.from_arrays([rows.pop(0), *columns], names=["row", *[f"out_{n}" for n, _ in adds]])

    out = packed.mapInArrow(lean(run), schema)
    return out.select(*[F.col("row").getField(f.name).alias(f.name) for f in kept], *[F.col(f"out_{n}").alias(n) for n, _ in adds])


def crc32_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def python_crc32_mod(value: object, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def split_hot(rows: DataFrame, key: list[str], member: Column, most: int) -> DataFrame:
    """Buckets of up to about 2 x `most` rows from buckets of any size, such
    that every two rows of a bucket still meet in at least one.

    A key of more than `most` rows is dealt into ceil(count / most) chunks and
    each pair of chunks becomes a bucket; adds part_i, part_j (0, 0 for keys
    within bounds).  Two rows of one chunk meet in every bucket of that chunk;
    callers that count use own_part: true in exactly one of those.
    """
    # a table of its own, so that the planner knows its size and broadcasts it only if small
    hot = cut(rows.groupBy(*key).count().filter(F.col("count") > most).select(*key, F.ceil(F.col("count") / most).cast("int").alias("_chunks")))
    chunk = F.pmod(F.xxhash64(member, F.lit(7)), F.col("_chunks")).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("_own", F.when(F.col("_chunks").isNull(), 0).otherwise(chunk))
    dealt = dealt.withColumn("_other", F.explode(F.when(F.col("_chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_chunks") - 1))))
    return dealt.withColumn("part_i", F.least("_own", "_other")).withColumn("part_j", F.greatest("_own", "_other")).withColumnRenamed("_own", "chunk").drop("_chunks", "_other")


def runs(table: pa.Table, keys: list[str]):
    """Start offsets (with the end) of runs of equal keys in a sorted table."""
    import numpy as np

    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), n)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys; the group at a
    batch's end waits for the rest of it."""
    rest: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        at = runs(t, keys)
        first, final = [tuple(t.column(k)[i].as_py() for k in keys) for i in (0, t.num_rows - 1)]
        if len(at) == 2 and (last is None or first == last):
            rest.append(t)
            last = final
            continue
        cut_at = int(at[1]) if first == last else 0
        ready = pa.concat_tables([*rest, t.slice(0, cut_at)]) if rest else t.slice(0, cut_at)
        begin = int(at[-2])
        if ready.num_rows and begin > cut_at:
            yield pa.concat_tables([ready, t.slice(cut_at, begin - cut_at)]).combine_chunks()
        elif ready.num_rows:
            yield ready.combine_chunks()
        elif begin > cut_at:
            yield t.slice(cut_at, begin - cut_at).combine_chunks()
        rest, last = [t.slice(begin)], final
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def forest(n: int, a, b):
    """Indices of edges (arrays a, b of nodes below n) that form a spanning
    forest: at most n - 1 edges, with the same components."""
    import numpy as np

    label = np.arange(n)
    kept = []
    left = np.arange(len(a))
    while len(left):
        la, lb = label[a[left]], label[b[left]]
        open_ = la != lb
        left, la, lb = left[open_], la[open_], lb[open_]
        if not len(left):
            break
        hi, lo = np.maximum(la, lb), np.minimum(la, lb)
        # each root takes one edge to a smaller root: acyclic, since labels only fall
        roots, first = np.unique(hi, return_index=True)
        kept.append(left[first])
        parent = np.arange(n)
        parent[roots] = lo[first]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b longs, a != b): node, root, the root
    being the component's smallest node.  Roots themselves are not listed.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join; a table in the shared folder ends the lineage of each round.  The
    grouped minimum combines before the shuffle and adaptive execution splits
    the skewed side of the join, so a node with very many links is no one
    task's burden.  No links at all give an empty table; a graph that hasn't
    settled after `rounds` is an error (the steps settle in about the logarithm
    of its size).
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for k in range(rounds + 1):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        if k == rounds:
            raise RuntimeError(f"components haven't settled in {rounds} rounds")
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = cut(small, drop=e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
