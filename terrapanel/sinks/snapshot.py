"""Validated, recoverable publication of table sets; appends; the load log.

A base folder holds two things::

    <base>/_manifests/0000000007.json   one per publication, never changed
    <base>/data/<publication>/<table>.parquet   files, never changed

A manifest names every table's *segments* (folder, rows, bytes, key ranges,
column counts, bucketing) and carries the lineage rows of its publication, so
tables and log become visible in the same step. Readers take the manifest with
the highest version: they see all of a publication or nothing of it.

A publication writes its segments first, validates what was written, and then
creates the next manifest, which only succeeds if no other writer has created
that version (optimistic concurrency). A loser whose tables nobody touched is
put on top of the newer manifest; otherwise it fails and its files go. Files of
writers that died are found by :func:`recover`: no manifest names them.

Counts, key ranges and non-null counts are observed while a segment is written;
no second job reads it for them.
"""

from __future__ import annotations

import datetime as _dt
import json
import time
import uuid
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bucketing_unsupported
from ..sources.star import DIM_TABLES, FACT_TABLES, PRIMARY_KEYS, Star

#: One row per table and publication; ``id`` grows with the publications.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("carga_id", T.StringType()),
        T.StructField("tabela", T.StringType()),
        T.StructField("origem", T.StringType()),
        T.StructField("linhas", T.LongType()),
        T.StructField("bytes_origem", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("iniciado_em", T.TimestampType()),
        T.StructField("duracao_ms", T.LongType()),
        T.StructField("executado_por", T.StringType()),
    ]
)


class PublicationRejected(ValueError):
    """What was written breaks a rule; nothing was published."""


class PublicationConflict(RuntimeError):
    """Another writer has published the same tables in the meantime."""


# --------------------------------------------------------------------------
# Files
# --------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def _create_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``, unless it exists: then False. The file
    appears with its whole text or not at all: it is written under another
    name and linked (local files) or renamed without overwriting (others,
    whose rename must be atomic, as HDFS's is)."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    _, tmp = _path(spark, f"{path.rsplit('/', 1)[0]}/_tmp-{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda q: jvm.java.nio.file.Paths.get(q.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(p), local(tmp))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(context.makeQualified(tmp), context.makeQualified(p), none)
        return True
    except Exception as exc:
        if "FileAlreadyExistsException" in str(exc):
            return False
        raise
    finally:
        fs.delete(tmp, False)


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below ``path`` (file-system metadata, no job)."""
    fs, p = _path(spark, path)
    return int(fs.getContentSummary(p).getLength())


# --------------------------------------------------------------------------
# Manifests
# --------------------------------------------------------------------------


def _folder(base: str) -> str:
    return f"{base.rstrip('/')}/_manifests"


def versions(spark: SparkSession, base: str) -> list[int]:
    """Published versions, ascending."""
    fs, p = _path(spark, _folder(base))
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, base: str, version: int | None = None) -> dict | None:
    """A published manifest, the newest by default; None before the first."""
    have = versions(spark, base)
    if version is None:
        version = have[-1] if have else None
    elif version not in have:
        raise FileNotFoundError(f"no version {version} under {base}")
    return None if version is None else json.loads(_read_text(spark, f"{_folder(base)}/{version:010d}.json"))


def current_snapshot(spark: SparkSession, base: str) -> str | None:
    """Id of the newest publication."""
    m = manifest(spark, base)
    return m["publication"] if m else None


def _paths(m: dict | None, name: str) -> list[str]:
    return [s["path"] for s in m["tables"][name]["segments"]] if m and name in m["tables"] else []


def _publish(spark: SparkSession, base: str, seen: dict | None, publication: str, tables: dict, log: list[dict]) -> dict:
    """Create the next manifest: ``seen`` (the newest one when the writer
    began) with ``tables`` in place of theirs. Versions that other writers
    published since are taken over if they left these tables alone."""
    began = seen
    while True:
        version = (seen["version"] if seen else 0) + 1
        moved = [name for name in tables if _paths(seen, name) != _paths(began, name)]
        if moved:
            raise PublicationConflict(f"{', '.join(moved)} published by another writer since version {began['version'] if began else 0}")
        rows = [{**row, "id": version * 1000 + k} for k, row in enumerate(log)]
        m = {"version": version, "publication": publication, "tables": {**(seen["tables"] if seen else {}), **tables}, "log": rows}
        if _create_absent(spark, f"{_folder(base)}/{version:010d}.json", json.dumps(m, ensure_ascii=False)):
            return m
        seen = manifest(spark, base)


def recover(spark: SparkSession, base: str, min_age_seconds: float = 86400.0) -> list[str]:
    """Remove what no manifest names: folders of writers that died before
    they published (and temporary manifests), once they are as old as
    ``min_age_seconds`` (a running writer's folder is young). Returns the
    names of the removed folders."""
    named = {s["path"].rsplit("/", 2)[1] for v in versions(spark, base) for t in manifest(spark, base, v)["tables"].values() for s in t["segments"]}
    removed = []
    for folder in (f"{base.rstrip('/')}/data", _folder(base)):
        fs, p = _path(spark, folder)
        for status in fs.listStatus(p) if fs.exists(p) else []:
            name = status.getPath().getName()
            lost = name not in named if folder.endswith("/data") else name.startswith("_tmp-")
            if lost and time.time() - status.getModificationTime() / 1000 >= min_age_seconds:
                fs.delete(status.getPath(), True)
                if folder.endswith("/data"):
                    removed.append(name)
    return sorted(removed)


# --------------------------------------------------------------------------
# Segments
# --------------------------------------------------------------------------


def _frame(spark: SparkSession, segment: dict) -> DataFrame:
    """The rows of a segment: a bucketed one through its catalog table, which
    is registered again (external, explicit columns) where this session's
    catalog doesn't know it."""
    if not segment["bucket"]:
        return spark.read.schema(segment["schema"]).parquet(segment["path"])
    name = segment["bucket"]["table"]
    if not spark.catalog.tableExists(name):
        part = f" PARTITIONED BY ({', '.join(segment['partition'])})" if segment["partition"] else ""
        by = ", ".join(segment["bucket"]["cols"])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({segment['schema']}) USING parquet{part} CLUSTERED BY ({by}) SORTED BY ({by}) INTO {segment['bucket']['n']} BUCKETS LOCATION '{segment['path']}'")
        if segment["partition"]:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def read_segments(spark: SparkSession, segments: Sequence[dict]) -> DataFrame:
    out = _frame(spark, segments[0])
    for s in segments[1:]:
        out = out.unionByName(_frame(spark, s))
    return out


def _scalar(value):
    return value.isoformat() if isinstance(value, (_dt.date, _dt.datetime)) else str(value) if value is not None and not isinstance(value, (int, float, str, bool)) else value


def _write_segment(df: DataFrame, path: str, key: Sequence[str], partition: Sequence[str] = (), bucket: Sequence[str] = (), buckets: int = 1, table: str = "") -> dict:
    """Write ``df`` as one segment and describe it: counts and ranges are
    observed by the writing tasks themselves."""
    spark = df.sparkSession
    if bucket:
        df = df.repartition(buckets, *bucket)  # one writer task per bucket, so one file per bucket (and partition)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    order = [c for c in df.columns if c not in partition] + list(partition)
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows"), *(F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(df.columns))]
    metrics += [f(F.col(c)).alias(f"{side}_{c}") for c in key for side, f in (("lo", F.min), ("hi", F.max))]
    writer = df.observe(seen, *metrics).write.mode("errorifexists").format("parquet")
    if partition:
        writer = writer.partitionBy(*partition)
    spec = None
    if bucket:
        try:
            writer.bucketBy(buckets, *bucket).sortBy(*bucket).option("path", path).saveAsTable(table)
            spec = {"table": table, "n": buckets, "cols": list(bucket)}
        except AnalysisException as exc:
            if not bucketing_unsupported(exc):
                raise
            # same rows without co-location: plain files at the same place
            warnings.warn(f"bucketed write of {table} unavailable ({exc.getCondition()}); writing plain Parquet")
            seen = Observation()
            plain = df.observe(seen, *metrics).write.mode("overwrite").format("parquet")
            (plain.partitionBy(*partition) if partition else plain).save(path)
    else:
        writer.save(path)
    got = seen.get
    return {
        "path": path,
        "schema": ", ".join(f"`{c}` {types[c]}" for c in order),
        "partition": list(partition),
        "bucket": spec,
        "rows": got["rows"],
        "bytes": path_bytes(spark, path),
        "nonnull": {c: got[f"n_{i}"] for i, c in enumerate(df.columns)},
        "low": {c: _scalar(got[f"lo_{c}"]) for c in key},
        "high": {c: _scalar(got[f"hi_{c}"]) for c in key},
    }


def _discard(spark: SparkSession, folder: str, segments: Sequence[dict]) -> None:
    for s in segments:
        if s["bucket"]:
            spark.sql(f"DROP TABLE IF EXISTS {s['bucket']['table']}")
    _remove(spark, folder)


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def _log_row(spark: SparkSession, publication: str, name: str, segment: dict, origins: Sequence[str], source: str, started: _dt.datetime, seconds: float) -> dict:
    return {
        "carga_id": publication,
        "tabela": name,
        "origem": ", ".join(origins) or source,
        "linhas": segment["rows"],
        "bytes_origem": sum(path_bytes(spark, o) for o in origins) if origins else None,
        "bytes": segment["bytes"],
        "iniciado_em": started.isoformat(sep=" ", timespec="milliseconds"),
        "duracao_ms": int(seconds * 1000),
        "executado_por": spark.sparkContext.sparkUser(),
    }


def _publication() -> str:
    return _now().strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:6]


# --------------------------------------------------------------------------
# Publishing and reading
# --------------------------------------------------------------------------


def write_snapshot(
    tables: dict,
    base: str,
    *,
    partition_by: dict[str, list[str]] | None = None,
    bucket_by: dict[str, list[str]] | None = None,
    buckets: int | None = None,
    validate: Callable[[SparkSession, dict[str, DataFrame]], None] | None = None,
    source: str = "",
    origins: dict[str, Sequence[str]] | None = None,
    extra: Callable[[str], dict] | None = None,
) -> str:
    """Replace ``tables`` under ``base`` in one publication; other tables
    there stay. Returns the publication's folder.

    Dimensions are written first, then facts, then tables that are given as a
    function of those written. ``validate(spark, written)`` may raise: nothing
    is published then and the files go. ``PublicationConflict`` is raised if
    another writer has published one of the tables meanwhile.

    Tables in ``bucket_by`` are written bucketed (and sorted) on those columns
    into ``buckets`` buckets (default: the shuffle partitions) and registered
    as external catalog tables: joins and aggregations on the bucket key
    between tables of one publication need no exchange. ``partition_by`` adds
    folder partitions, so filters on them prune files. ``origins`` names the
    input paths of each table for the log; ``extra`` adds entries to a table's
    part of the manifest.
    """
    spark = next(v for v in tables.values() if isinstance(v, DataFrame)).sparkSession
    seen = manifest(spark, base)
    publication = _publication()
    folder = f"{base.rstrip('/')}/data/{publication}"
    written: dict[str, DataFrame] = {}
    segments: dict[str, dict] = {}
    log: dict[str, dict] = {}
    n_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write_one(name: str) -> None:
        started, t0 = _now(), time.perf_counter()
        df = tables[name]
        df = df if isinstance(df, DataFrame) else df(written)
        bucket = list((bucket_by or {}).get(name, []))
        key = [c for c in PRIMARY_KEYS.get(name, []) if c in df.columns]
        segments[name] = _write_segment(
            df, f"{folder}/{name}.parquet", key, list((partition_by or {}).get(name, [])), bucket, n_buckets, f"terrapanel_{publication.replace('-', '_')}_{name}"
        )
        written[name] = _frame(spark, segments[name])
        log[name] = _log_row(spark, publication, name, segments[name], (origins or {}).get(name, ()), source, started, time.perf_counter() - t0)

    dims = [t for t in tables if t in DIM_TABLES]
    derived = [t for t in tables if not isinstance(tables[t], DataFrame)]
    facts = [t for t in tables if t not in dims and t not in derived]
    try:
        # the tables of one batch are independent: their jobs run side by side
        for batch in (dims, facts, derived):
            if batch:
                with ThreadPoolExecutor(max_workers=min(8, len(batch))) as pool:
                    list(pool.map(write_one, batch))
        if validate is not None:
            validate(spark, written)
        new = {n: {"segments": [segments[n]], **(extra(n) if extra else {})} for n in tables}
        _publish(spark, base, seen, publication, new, [log[n] for n in (*dims, *facts, *derived)])
    except BaseException:
        _discard(spark, folder, list(segments.values()))
        raise
    return folder


def read_snapshot(spark: SparkSession, base: str, names=None, version: int | None = None) -> dict[str, DataFrame]:
    """Tables as of a version (the newest by default)."""
    m = manifest(spark, base, version)
    if m is None:
        raise FileNotFoundError(f"nothing published under {base}")
    return {n: read_segments(spark, m["tables"][n]["segments"]) for n in names or (*DIM_TABLES, *FACT_TABLES)}


def _overlap(a: dict, b: dict, key: Sequence[str]) -> bool:
    """Whether the key ranges of two segments meet in every key column."""
    for c in key:
        x, y = (a["low"].get(c), a["high"].get(c)), (b["low"].get(c), b["high"].get(c))
        if None not in (*x, *y) and (x[1] < y[0] or y[1] < x[0]):
            return False
    return bool(a["rows"] and b["rows"])


def append_rows(
    new: DataFrame,
    base: str,
    table: str,
    *,
    key: Sequence[str] | None = None,
    validate: Callable[[SparkSession, dict[str, DataFrame]], None] | None = None,
    source: str = "",
    origins: Sequence[str] = (),
) -> int:
    """Publish ``new`` as one more segment of ``table``; returns its rows.

    A NULL in a key column, a key twice within ``new`` or a key that the table
    has already rejects the whole append, and nothing is left of it. Only
    segments whose key ranges meet those of the new one are read for the check.
    ``validate(spark, {table: rows})`` may raise as well. Appends of others in
    the meantime are no conflict: their segments are checked too, and the
    publication is tried again.
    """
    spark = new.sparkSession
    key = list(key or PRIMARY_KEYS[table])
    seen = manifest(spark, base)
    if seen is None or table not in seen["tables"]:
        raise FileNotFoundError(f"{table} isn't published under {base}")
    publication, started, t0 = _publication(), _now(), time.perf_counter()
    folder = f"{base.rstrip('/')}/data/{publication}"
    segment = None
    try:
        own_type = read_segments(spark, seen["tables"][table]["segments"][:1]).schema
        segment = _write_segment(new.select(*(F.col(f.name).cast(f.dataType) for f in own_type.fields)), f"{folder}/{table}.parquet", key)
        rows = _frame(spark, segment)
        if any(segment["nonnull"][c] < segment["rows"] for c in key):
            raise PublicationRejected(f"append to {table}: NULL in key {key}")
        if not rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
            raise PublicationRejected(f"append to {table}: key {key} repeated in the new rows")
        if validate is not None:
            validate(spark, {table: rows})
        checked: set[str] = set()
        while True:
            have = seen["tables"][table]["segments"]
            rest = [s for s in have if s["path"] not in checked]
            for s in rest:
                if _overlap(s, segment, key):
                    # the ranges again as filters, so that files and row groups are pruned
                    old = _frame(spark, s).where(F.col(key[0]).between(F.lit(segment["low"][key[0]]), F.lit(segment["high"][key[0]])))
                    if not rows.join(old.select(*key), key, "left_semi").isEmpty():
                        raise PublicationRejected(f"append to {table}: key {key} present already")
            checked |= {s["path"] for s in rest}
            log = _log_row(spark, publication, table, segment, origins, source, started, time.perf_counter() - t0)
            try:
                _publish(spark, base, seen, publication, {table: {**seen["tables"][table], "segments": [*have, segment]}}, [log])
                return segment["rows"]
            except PublicationConflict:
                seen = manifest(spark, base)
    except BaseException:
        _discard(spark, folder, [segment] if segment else [])
        raise


# --------------------------------------------------------------------------
# The star
# --------------------------------------------------------------------------

#: Municipal tables are co-located on the entity key; facts are also
#: partitioned by year (latest-year selections read one folder).
MUNICIPAL_BUCKETS = {
    "dim_municipio": ["municipio_id"],
    "fato_populacao_municipio": ["municipio_id"],
    "fato_censo_municipio": ["municipio_id"],
    "fato_pib_municipio": ["municipio_id"],
}
YEAR_PARTITIONS = {"fato_populacao_municipio": ["ano"], "fato_pib_municipio": ["ano"]}


def write_star(star: Star, base: str, *, source: str = "", origins: dict | None = None, buckets: int | None = None, validate=None) -> Star:
    """Publish a star (ETL output) and return it re-read from storage.
    ``validate`` is called with the written tables, e.g.
    ``operators.quality.enforce``."""
    write_snapshot(star.tables(), base, source=source, origins=origins, bucket_by=MUNICIPAL_BUCKETS, partition_by=YEAR_PARTITIONS, buckets=buckets, validate=validate)
    return Star(**read_snapshot(star.spark, base))


def load_log(spark: SparkSession, base: str) -> DataFrame:
    """All lineage rows, of every publication (the manifests hold them)."""
    log = T.StructType([T.StructField("log", T.ArrayType(LOG_SCHEMA))])
    return spark.read.schema(log).option("pathGlobFilter", "[0-9]*.json").json(_folder(base)).select(F.explode("log").alias("r")).select("r.*")


def latest_loads(log: DataFrame) -> DataFrame:
    """Latest load per table (ids grow with the publications)."""
    cols = [c for c in log.columns if c != "tabela"]
    latest = F.max_by(F.struct(*cols), F.col("id")).alias("x")
    return log.groupBy("tabela").agg(latest).select("tabela", "x.*")


def column_counts(spark: SparkSession, base: str, table: str) -> DataFrame:
    """(``coluna``, ``nao_nulos``, ``linhas``) as the writing tasks counted them."""
    segments = manifest(spark, base)["tables"][table]["segments"]
    rows = [(c, sum(s["nonnull"][c] for s in segments), sum(s["rows"] for s in segments)) for c in segments[0]["nonnull"]]
    return spark.createDataFrame(rows, "coluna string, nao_nulos long, linhas long")


def primary_key(name: str) -> list[str]:
    return PRIMARY_KEYS[name]
