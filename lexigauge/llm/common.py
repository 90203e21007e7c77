"""What the operators of this folder share: tables, the shared scratch folder, code shipping, text slices, components."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so Python stages can import it wherever they run."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if getattr(sc, "_lexigauge_shipped", False) or not root.is_dir():
        return
    into = tempfile.mkdtemp(prefix="lexigauge-")
    atexit.register(shutil.rmtree, into, ignore_errors=True)
    name = os.path.join(into, f"lexigauge-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(name)
    sc._lexigauge_shipped = True


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master gets one of its own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(sc, "_lexigauge_scratch", None)
        if not base:
            base = sc._lexigauge_scratch = tempfile.mkdtemp(prefix="lexigauge-scratch-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/lexigauge"


def keep(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: the plan is cut and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*dfs: DataFrame) -> None:
    """Deletes tables made by keep() that no later plan reads."""
    for df in dfs:
        if path := getattr(df, "_kept_at", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
            df._kept_at = None


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; its cleaner waits for a collection."""
    gc.collect()
    time.sleep(0.3)  # the gateway lets go of its objects a moment after Python does
    spark._jvm.System.gc()
    time.sleep(0.3)


def spots(df: DataFrame, spot, bits: int) -> np.ndarray:
    """A filter of that many bits with the bit of every value of spot (0 up to bits) set. Built in buckets of 32,768 bits."""
    out = np.zeros(bits // 8, np.uint8)
    x = df.select((spot + 1).alias("x"))  # bitmap buckets start at 1
    for r in x.groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m")).collect():
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """(first, past the last) of runs of texts that together have at most limit bytes."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def quoted(name: str):
    """The column of exactly that name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def column(batch, name: str, null: bytes | None = b"") -> list:
    """A string column of an Arrow batch as UTF-8 bytes, null given as `null`."""
    import pyarrow as pa

    out = batch.column(name).cast(pa.binary()).to_pylist()
    return out if null is None else [null if x is None else x for x in out]


GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashes(strings) -> np.ndarray:
    """64-bit hashes of an Arrow string array's values; different ones of up to eight bytes and equal length never share one."""
    import xxhash

    n_all = len(strings)
    if not n_all:
        return np.zeros(0, np.uint64)
    off = np.frombuffer(strings.buffers()[1], np.int32, n_all + 1, strings.offset * 4).astype(np.int64)
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = raw
    at, n = off[:-1] - off[0], np.diff(off)
    eight = np.ndarray(len(raw) + 1, "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix(n.astype(np.uint64) + np.uint64(GOLD))
        live = np.arange(n_all)
        for j in range(0, 64, 8):
            live = live[n[live] > j]
            if not len(live):
                break
            short = np.maximum(0, 8 - (n[live] - j)).astype(np.uint64) * np.uint64(8)
            x = eight[at[live] + j] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> short)
            h[live] = mix(h[live] * np.uint64(GOLD) + x)
    for i in np.flatnonzero(n > 64).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i] + n[i]].tobytes())
    return h


def array_slices(texts, limit: int = SLICE_BYTES):
    """(first, past the last) of runs of an Arrow string array that together have at most limit bytes, single longer ones apart."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    a = total = 0
    for i, n in enumerate(size.tolist()):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(size):
        yield a, len(size)
    pa.default_memory_pool().release_unused()


def word_codes(units, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """Of an Arrow string array: the unit and the kind of every word in order, the kinds' hashes, and the kinds.

    Words are runs without \\x20 and \\x09-\\x0D, A-Z lower-cased; null units have none.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_dictionary(units.type) or units.null_count:
        units = pc.fill_null(units, "")
    words = pc.ascii_split_whitespace(pc.ascii_lower(units) if lower else units)
    owner = np.repeat(np.arange(len(units)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    kind, kinds = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    blank = np.flatnonzero(pc.binary_length(kinds).to_numpy(zero_copy_only=False) == 0)  # splitting leaves one at a unit's ends
    if len(blank):
        real = kind != blank[0]
        owner, kind = owner[real], kind[real]
    return owner, kind, hashes(kinds), kinds


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: two columns of one sortable type; direction, loops and repeats don't matter, rows with a null are ignored.
    Returns (node, root) for every node that has an edge to another one or to itself; root is the least node of its component.
    Only joins and aggregates: a star's centre is aggregated map-side, and its join side is split by AQE.
    """
    a, b = edges.columns
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = keep(both.select("u").union(both.select("v")).distinct())
    cur = keep(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    print_of = mark(cur)
    for _ in range(rounds if print_of["n"] else 0):
        two = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        nxt = keep(nxt.where("u <> v").distinct())
        drop(cur, large)
        cur = nxt
        now = mark(cur)
        if now == print_of:
            break
        print_of = now
    else:
        if print_of["n"]:
            raise RuntimeError(f"components: not settled after {rounds} rounds")
    return nodes.join(cur, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))
