"""The chunk table and its index: segments, snapshots, whole replacement, upserts, health."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import block_index, lexical
from ..working import new_path

DDL = """CREATE TABLE IF NOT EXISTS {name} (
  id BIGINT NOT NULL, file STRING NOT NULL, speaker STRING NOT NULL, start_ms INT NOT NULL, end_ms INT NOT NULL,
  text STRING NOT NULL, n_words INT NOT NULL, embedding ARRAY<FLOAT>)
  USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS"""
#: The postings of a catalog table; a bucket holds all blocks of its terms, so counts by term need no exchange.
BLOCKS_DDL = """CREATE TABLE IF NOT EXISTS {name}_blocks (
  term STRING, block BIGINT, n_docs INT, n_postings INT, max_tf INT, min_len INT, slots ARRAY<TINYINT>, lens ARRAY<INT>, tfs ARRAY<INT>, gaps ARRAY<INT>)
  USING parquet CLUSTERED BY (term) SORTED BY (term, block) INTO {buckets} BUCKETS"""
LENGTHS_DDL = "CREATE TABLE IF NOT EXISTS {name}_lengths (id BIGINT, n_terms INT) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS"
TABLES = {"": DDL, "_blocks": BLOCKS_DDL, "_lengths": LENGTHS_DDL}
#: Columns of a catalog table that hold no null.
REQUIRED = ["id", "file", "speaker", "start_ms", "end_ms", "text", "n_words"]


def create(spark: SparkSession, name: str = "chunks", buckets: int = lexical.BUCKETS) -> None:
    """Create the chunk table of that name and those of its index, if there are none."""
    for ddl in TABLES.values():
        spark.sql(ddl.format(name=name, buckets=buckets))


def ingest_table(chunks: DataFrame, name: str = "chunks", buckets: int = lexical.BUCKETS, stemmed: bool = True, stops: frozenset[str] | None = None) -> None:
    """Replace the rows of the catalog table ``name`` and its index by ``chunks`` with ids; a null in a required column is an error, and nothing changes.

    For sessions that share a catalog. The tables are overwritten one after another, so who needs a load to be
    seen at once uses the store of ``ingest``. All blocks of a term are in one bucket, which is one task's to read.
    """
    spark = chunks.sparkSession
    create(spark, name, buckets)
    path = new_path(spark, "load")
    bad = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED))
    checked = chunks.select(COLUMNS).withColumn("id", F.when(bad != "", F.raise_error(F.concat(F.lit("null in "), bad)).cast("long")).otherwise(F.col("id")))
    checked.write.parquet(path)
    rows = spark.read.parquet(path)
    left_out = lexical.stop_words() if stops is None else stops
    parts = {
        "_blocks": block_index.blocks(rows, stemmed, stops).drop("bucket").repartition(buckets, "term"),
        "_lengths": block_index.lengths(rows, left_out).repartition(buckets, "id"),
        "": rows.repartition(buckets, "id"),
    }
    for suffix, part in parts.items():
        part.select(spark.table(name + suffix).columns).createOrReplaceTempView("_cadenza_load")
        spark.sql(f"INSERT OVERWRITE TABLE {name}{suffix} SELECT * FROM _cadenza_load")
    spark.catalog.dropTempView("_cadenza_load")
    fs, folder = _hadoop(spark, path)
    fs.delete(folder, True)


def table_index(spark: SparkSession, name: str = "chunks") -> tuple[DataFrame, block_index.Index]:
    """The chunks of a catalog table and their index."""
    blocks, lengths = spark.table(f"{name}_blocks"), spark.table(f"{name}_lengths")
    return spark.table(name), block_index.Index(blocks, lengths, block_index.counts(blocks), lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms")))


def with_ids(chunks: DataFrame, file: str = "stem", pos: str = "chunk_pos", block: int = 1 << 16) -> DataFrame:
    """Ids from 1 in order of file and place, an integer.

    Rows are counted by file and block of places; a block's first id is the sum of the counts before
    it, over one row per block, and numbering inside a block needs that block's rows only. So a
    file of any size is dealt to many tasks.
    """
    rows = chunks.withColumn("_block", F.floor(F.col(pos) / block))
    sizes = rows.groupBy(file, "_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy(file, "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(file, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(file, "_block").orderBy(pos))
    return rows.withColumn("_in", inside).join(starts, [file, "_block"]).withColumn("id", (F.col("_before") + F.col("_in")).cast("long")).select(*chunks.columns, "id")


COLUMNS = ["id", "file", "speaker", "start_ms", "end_ms", "text", "n_words", "embedding"]


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class StoreChangedError(RuntimeError):
    """Another load was published first; what this one was made from is no longer the present state."""


@dataclass(frozen=True)
class Snapshot:
    """A state of a store: its number, its segments from the oldest, and the first id that was never given out."""

    number: int
    segments: tuple[str, ...]
    next_id: int


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots that readers can still open, the present one first."""
    fs, folder = _hadoop(spark, f"{path}/snapshots")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot | None:
    """The present snapshot or that of a number; None if there is no store."""
    found = versions(spark, path) if number is None else [number]
    if not found:
        return None
    state = json.loads(spark.read.text(f"{path}/snapshots/{found[0]:08d}", wholetext=True).first()[0])
    return Snapshot(found[0], tuple(state["segments"]), state["next_id"])


def publish(spark: SparkSession, path: str, after: Snapshot | None, segments: list[str], next_id: int) -> None:
    """Make ``segments`` the snapshot that follows ``after``: a small file that is renamed to its number, which fails if that is taken.

    Of two loads from one state only one is published. Snapshots before the one that was replaced go, with the
    segments that only they name; whoever still reads the replaced one can.
    """
    number = after.number + 1 if after else 1
    fs, target = _hadoop(spark, f"{path}/snapshots/{number:08d}")
    fresh = _hadoop(spark, f"{path}/snapshots/.{uuid.uuid4().hex}")[1]
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps({"segments": segments, "next_id": next_id}), "utf-8"))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fresh, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(fresh, False)
        if fs.exists(target):
            raise StoreChangedError(f"{path} has a snapshot {number} already") from e
        raise
    old = versions(spark, path)[2:]
    named = {s for n in versions(spark, path)[:2] for s in snapshot(spark, path, n).segments}
    for n in old:
        for s in set(snapshot(spark, path, n).segments) - named:
            fs.delete(_hadoop(spark, f"{path}/{s}")[1], True)
        fs.delete(_hadoop(spark, f"{path}/snapshots/{n:08d}")[1], False)


def vacuum(spark: SparkSession, path: str, hours: float = 24) -> int:
    """Delete segments that no snapshot names and that were begun over ``hours`` ago: those of loads that failed or lost."""
    fs, root = _hadoop(spark, path)
    named = {s for n in versions(spark, path) for s in snapshot(spark, path, n).segments}
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("s-") and s.getPath().getName() not in named and time.time() - s.getModificationTime() / 1000 >= hours * 3600]
    for p in old:
        fs.delete(p, True)
    return len(old)


def _segment(chunks: DataFrame, gone: DataFrame, path: str, name: str, stemmed: bool, stops: frozenset[str] | None) -> DataFrame:
    """Write a segment: rows with ids, their index, and the ids that it takes out of earlier segments."""
    chunks.select(COLUMNS).write.parquet(f"{path}/{name}/chunks")
    stored = chunks.sparkSession.read.parquet(f"{path}/{name}/chunks")
    block_index.write(stored, f"{path}/{name}/index", stemmed, stops)
    gone.write.parquet(f"{path}/{name}/gone")
    return stored


def _new_segment() -> str:
    return f"s-{uuid.uuid4().hex}"


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long")


def ingest(chunks: DataFrame, path: str, stemmed: bool = True, stops: frozenset[str] | None = None) -> DataFrame:
    """Replace the store at ``path`` (embedded rows with ids, and their index) as a whole.

    Rows and index are written to a segment of their own, then a snapshot that names only it is published. Readers see the old
    store or the new one, a load that fails leaves the old one, and of concurrent whole loads the last wins.
    """
    spark = chunks.sparkSession
    name = _new_segment()
    stored = _segment(chunks, _nothing(spark), path, name, stemmed, stops)
    following = stored.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    while True:
        before = snapshot(spark, path)
        try:
            publish(spark, path, before, [name], max(following, before.next_id if before else 1))
            return stored
        except StoreChangedError:
            continue


def upsert(changed: DataFrame, path: str, files: DataFrame | None = None, stemmed: bool = True, stops: frozenset[str] | None = None) -> DataFrame:
    """Replace the rows of some files: ``changed`` are all rows of these files as they are now, without ids.

    ``files`` (``file``) names the files if one of them has no row left, and goes. A row is known by its file and
    start; of rows that share both, by its place among them in order of end, speaker and text. Known rows that
    are the same are left alone, changed ones keep their id, new ones get ids that were never used. Only
    changed and new rows are written, to a segment that also names the ids it replaces or removes; nothing else is
    rewritten. Returns ``file, start_ms, nth, id, state`` of the rows that were not left alone: ``new``,
    ``changed`` or ``gone``. If another load is published meanwhile, it is an error and nothing changes.
    """
    spark, name = changed.sparkSession, _new_segment()
    before = snapshot(spark, path)
    if before is None:
        raise FileNotFoundError(f"no store at {path}")
    key = ["file", "start_ms", "nth"]
    nth = F.row_number().over(Window.partitionBy("file", "start_ms").orderBy("end_ms", "speaker", "text"))
    touched = (changed if files is None else files).select("file").distinct()
    content = F.struct("speaker", "end_ms", "text", "n_words", "embedding")
    old = live_chunks(spark, path, before).join(touched, "file", "left_semi").select("id", "file", "start_ms", nth.alias("nth"), content.alias("was"))
    now = changed.select("file", "start_ms", nth.alias("nth"), content.alias("now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    found = f"{path}/{name}/found"
    old.join(now, key, "full_outer").withColumn("state", state).where("state is not null").select(*key, "id", "state", "now").write.parquet(found)
    rows, changes = spark.read.parquet(found), f"{path}/{name}/changes"
    fresh = with_ids(rows.where("state = 'new'").drop("id"), "file", "start_ms").withColumn("id", F.col("id") + (before.next_id - 1))
    rows.where("state <> 'new'").unionByName(fresh).write.parquet(changes)
    told = spark.read.parquet(changes)
    kept = told.where("state <> 'gone'").select("id", "file", "now.speaker", "start_ms", "now.end_ms", "now.text", "now.n_words", "now.embedding")
    _segment(kept, told.where("state <> 'new'").select("id"), path, name, stemmed, stops)
    try:
        publish(spark, path, before, [*before.segments, name], before.next_id + told.where("state = 'new'").count())
    except StoreChangedError:
        _hadoop(spark, path)[0].delete(_hadoop(spark, f"{path}/{name}")[1], True)
        raise
    return told.select(*key, "id", "state")


def compact(spark: SparkSession, path: str, stemmed: bool = True, stops: frozenset[str] | None = None) -> None:
    """Write all live rows, with the ids they have, to one segment that takes the place of all others."""
    before, name = snapshot(spark, path), _new_segment()
    if before is None:
        raise FileNotFoundError(f"no store at {path}")
    _segment(live_chunks(spark, path, before), _nothing(spark), path, name, stemmed, stops)
    publish(spark, path, before, [name], before.next_id)


def _gone_later(spark: SparkSession, path: str, segments: tuple[str, ...], i: int) -> DataFrame | None:
    """The ids that segments after the ``i``-th take out of it."""
    later = [f"{path}/{s}/gone" for s in segments[i + 1 :]]
    return spark.read.schema("id long").parquet(*later).distinct() if later else None


def live_chunks(spark: SparkSession, path: str, at: Snapshot) -> DataFrame:
    """The rows of a snapshot: those of each segment that no later one takes out."""
    parts = []
    for i, s in enumerate(at.segments):
        rows, gone = spark.read.parquet(f"{path}/{s}/chunks"), _gone_later(spark, path, at.segments, i)
        parts.append(rows if gone is None else rows.join(gone, "id", "left_anti").select(rows.columns))
    return reduce(DataFrame.unionByName, parts)


def without(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    """Blocks of an index without the documents ``gone``; arrays that no one asks for are not read. Skip entries stay bounds."""
    slot = (F.col("id") - F.shiftleft(F.shiftright("id", block_index.BLOCK_BITS), block_index.BLOCK_BITS)).cast("tinyint")
    dead = gone.groupBy(F.shiftright("id", block_index.BLOCK_BITS).alias("block")).agg(F.collect_set(slot).alias("dead"))
    rows = blocks.join(dead, "block", "left").where(F.col("dead").isNull() | (F.size(F.array_except("slots", "dead")) > 0))
    stay = F.filter(F.sequence(F.lit(1), F.size("slots")), lambda i: ~F.array_contains("dead", F.get("slots", i - 1)))
    live = lambda c: F.transform(stay, lambda i: F.get(c, i - 1))
    parts = F.flatten(F.transform(stay, lambda i: F.slice("gaps", F.aggregate(F.slice("tfs", F.lit(1), i - 1), F.lit(1), lambda a, x: a + x), F.get("tfs", i - 1))))
    left = {c: F.when(F.col("dead").isNull(), F.col(c)).otherwise(x) for c, x in (("slots", live("slots")), ("lens", live("lens")), ("tfs", live("tfs")), ("gaps", parts))}
    counts = {"n_docs": F.size(left["slots"]), "n_postings": F.aggregate(left["tfs"], F.lit(0), lambda a, x: a + x)}
    return rows.select(*((left | counts).get(c, F.col(c)).alias(c) for c in blocks.columns))


def live_index(spark: SparkSession, path: str, at: Snapshot) -> block_index.Index:
    """The index of a snapshot. A term may have a row per segment for one block, and counts are of live documents."""
    parts = [block_index.read(spark, f"{path}/{s}/index") for s in at.segments]
    if len(parts) == 1:
        return parts[0]
    gone = [_gone_later(spark, path, at.segments, i) for i in range(len(parts))]
    blocks = reduce(DataFrame.unionByName, (p.blocks if g is None else without(p.blocks, g) for p, g in zip(parts, gone)))
    lengths = reduce(DataFrame.unionByName, (p.lengths if g is None else p.lengths.join(g, "id", "left_anti") for p, g in zip(parts, gone)))
    return block_index.Index(blocks, lengths, block_index.counts(blocks), lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms")))


def opened(spark: SparkSession, path: str, number: int | None = None) -> tuple[DataFrame, block_index.Index]:
    """The chunks and the index of the store at ``path``, as they are now or as of a snapshot."""
    at = snapshot(spark, path, number)
    if at is None:
        raise FileNotFoundError(f"no store at {path}")
    return live_chunks(spark, path, at), live_index(spark, path, at)


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The chunks and the blocks of postings of the store at ``path``."""
    chunks, index = opened(spark, path)
    return chunks, index.blocks


_INDEXES: dict[tuple, str] = {}


def index_of(docs: DataFrame, source: str, stemmed: bool, stops: frozenset[str] | None) -> block_index.Index:
    """The stored index of ``docs``, which come from the path ``source``: written once in a session while that stays as it is."""
    spark = docs.sparkSession
    fs, path = _hadoop(spark, source)
    status = fs.getFileStatus(path)
    key = (spark.sparkContext.applicationId, source, status.getModificationTime(), status.getLen(), stemmed, stops)
    if key not in _INDEXES or not fs.exists(_hadoop(spark, _INDEXES[key])[1]):
        target = new_path(spark, "index")
        block_index.write(docs, target, stemmed, stops)
        _INDEXES[key] = target
    return block_index.read(spark, _INDEXES[key])


def by_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file").agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"))


def health(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows, rows without vector, rows without any term by the ``lengths`` of an index."""
    has = lengths.where("n_terms > 0").select("id", F.lit(True).alias("_has"))
    return chunks.join(has, "id", "left").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("embedding").isNull()).alias("n_no_vector"), F.count_if(F.col("_has").isNull()).alias("n_no_terms"))
