"""Random access to a registry dump by id, through a saved index that follows the files.

The index is a folder of two Parquet tables.  ``files`` has one snapshot per
refresh: path, size and modification time of every file of the dump, and the
generation that read it last.  ``entries`` has one generation per refresh: id,
path and position of the studies of the files that this refresh read, in
buckets of the id.  A refresh compares the listing with the last snapshot and
reads changed files only; nothing is rewritten, since a look-up believes an
entry only if its file's present generation wrote it.  A look-up reads the
buckets of the ids it is asked for, then only the files that hold them.

A refresh writes its entries first and its snapshot last: one that dies leaves
entries that no snapshot names.

Defined cases: JSON pages are preferred over XML where a dump holds both;
broken files have no entries but are remembered by their signature; of several
studies of one id the one in the last file by name counts, there the last; an
index of another version is built anew; an empty dump has an empty index;
unknown ids give no row; null ids and studies without id are left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.sources import folders, readers

VERSION = 1
#: Ids and files of a look-up that are named to the reader one by one; beyond, tables are joined.
NAMED = 10_000

_FILES = "path string, size long, modified timestamp, kind string, read_by int, version int"
_ENTRIES = "id string, path string, position int"
#: A map, since the two spellings of the id differ in case only.
_IDS = "array<struct<protocolSection:struct<identificationModule:map<string,string>>>>"


class Refresh(NamedTuple):
    """What a refresh did: files read again, files kept, files gone."""

    generation: int
    read: int
    kept: int
    gone: int


def _listing(spark: SparkSession, dump: str) -> DataFrame:
    """path, size, modified and kind of the dump's files; no file is opened for this."""
    meta = [F.col(f"_metadata.{x}") for x in ("file_path", "file_size", "file_modification_time")]
    found = []
    for kind, pattern in (("json", "page_*.json"), ("xml", "*.xml")):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(dump)
        found.append(files.select(*meta).toDF("path", "size", "modified").withColumn("kind", F.lit(kind)))
    pages, single = found
    return single if pages.isEmpty() else pages


def snapshot(spark: SparkSession, index: str) -> tuple[DataFrame, int]:
    """The last snapshot of the files and its generation; none and -1 where there is no index."""
    if not folders.exists(spark, f"{index}/files"):
        return spark.createDataFrame([], _FILES), -1
    rows = spark.read.schema(f"{_FILES}, generation int").parquet(f"{index}/files")
    last = rows.agg(F.max("generation")).first()[0]
    if last is None:
        return spark.createDataFrame([], _FILES), -1
    return rows.where(F.col("generation") == last).drop("generation"), last


def id_probe(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """id, path and position of every study in ``paths``; of a study only its id is parsed."""
    if kind == "xml":
        rows = readers.raw_xml(spark, paths, "id_info struct<nct_id:string>")
        return rows.select(F.trim("id_info.nct_id").alias("id"), F.col("_metadata.file_path").alias("path"), F.lit(-1).alias("position"))
    pages = spark.read.option("wholetext", True).text(paths)
    rows = pages.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.from_json("value", _IDS)).alias("position", "study"))
    name = F.col("study.protocolSection.identificationModule")
    return rows.select(F.coalesce(name["nctId"], name["NCTId"]).alias("id"), "path", "position")


def _bucket(name, buckets: int):
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def refresh(spark: SparkSession, dump: str, index: str, buckets: int = 64) -> Refresh:
    """Bring ``index`` up to date with the files of ``dump``; only new and changed files are read.

    The paths of these are listed to the reader one by one, as many as Spark's own listing holds.
    """
    now = _listing(spark, dump)
    old, last = snapshot(spark, index)
    same = ["path", "size", "modified", "kind"]
    old = old.where(F.col("version") == VERSION)
    state = now.join(old.select(*same, "read_by"), same, "left")
    rows = state.select("path", "kind", "read_by").collect()
    kept, changed = [r for r in rows if r.read_by is not None], [r for r in rows if r.read_by is None]
    gone = old.select("path").join(now.select("path"), "path", "left_anti").count()
    if last >= 0 and not changed and not gone and old.count() == len(rows):
        return Refresh(last, 0, len(kept), 0)
    new = last + 1
    if changed:
        found = id_probe(spark, [r.path for r in changed], changed[0].kind).where("coalesce(id, '') <> ''")
        # of several studies of an id in one file the last counts
        found = found.groupBy("id", "path").agg(F.max("position").alias("position"))
        found = found.withColumn("bucket", _bucket("id", buckets))
        found.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{index}/entries/buckets={buckets}/generation={new}"
        )
    listed = state.select(*same, F.coalesce("read_by", F.lit(new)).alias("read_by"), F.lit(VERSION).alias("version"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{index}/files/generation={new}")
    return Refresh(new, len(changed), len(kept), gone)


def entries(spark: SparkSession, index: str) -> DataFrame:
    """id, path, position, bucket, buckets: where every study is now, repeated ids included."""
    files, last = snapshot(spark, index)
    if last < 0 or not folders.exists(spark, f"{index}/entries"):
        return spark.createDataFrame([], f"{_ENTRIES}, bucket int, buckets int")
    rows = spark.read.schema(f"{_ENTRIES}, buckets int, generation int, bucket int").parquet(f"{index}/entries")
    current = files.select("path", F.col("read_by").alias("generation"))
    return rows.join(current, ["path", "generation"], "left_semi").select("id", "path", "position", "bucket", "buckets")


def ids(spark: SparkSession, index: str) -> DataFrame:
    """Every id of the corpus, once."""
    return entries(spark, index).select("id").distinct()


def locate(spark: SparkSession, index: str, wanted: DataFrame) -> DataFrame:
    """id, path and position of the ids of ``wanted`` (id) that the corpus holds."""
    wanted = wanted.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct()
    rows = entries(spark, index)
    asked = [r.id for r in wanted.limit(NAMED + 1).collect()]
    if len(asked) > NAMED:
        rows = rows.join(wanted, "id", "left_semi")
    else:
        sizes = [r.buckets for r in rows.select("buckets").distinct().collect()]
        near = F.lit(False)
        for n in sizes:
            one = spark.createDataFrame([(x,) for x in asked], "id string").select(_bucket("id", n).alias("b")).distinct()
            near = near | ((F.col("buckets") == n) & F.col("bucket").isin([r.b for r in one.collect()]))
        rows = rows.where(near & F.col("id").isin(asked))
    return rows.groupBy("id").agg(F.max(F.struct("path", "position")).alias("at")).select("id", "at.path", "at.position")


def look_up(spark: SparkSession, index: str, wanted: DataFrame) -> DataFrame:
    """The trials of the ids of ``wanted`` (id), as the readers give them; unknown ids give no row."""
    at = locate(spark, index, wanted)
    files = at.select("path").distinct()
    paths = [r.path for r in files.limit(NAMED + 1).collect()]
    if len(paths) > NAMED:  # read the dump's files once and keep what was asked for
        paths = [r.path for r in snapshot(spark, index)[0].select("path").collect()]
    if not paths:
        return readers.trials_of_xml(spark.createDataFrame([], readers._XML))
    at = at.select("path", "position", F.col("id").alias("asked"))
    if paths[0].endswith(".xml"):
        raw = readers.raw_xml(spark, paths).withColumn("path", F.col("_metadata.file_path"))
        found = readers.trials_of_xml(raw, ("path",))
        return found.join(at, [found["path"] == at["path"], found["nct_id"] == at["asked"]], "left_semi").drop("path")
    page = F.from_json("value", f"array<struct<{readers._JSON}>>".replace("protocolSection struct", "protocolSection:struct"))
    text = spark.read.option("wholetext", True).text(paths)
    raw = text.select(F.col("_metadata.file_path").alias("path"), F.posexplode(page).alias("position", "study"))
    raw = raw.join(at, ["path", "position"], "left_semi").select("study.protocolSection.*")
    return readers.trials_of_sections(raw)
