"""Versioned snapshots of the archive: tables in parts, kept indexes, and one manifest a version.

Each table is dealt to PARTS folders by a hash of its key.  A change writes the
parts it touched, of the tables it touched, beside the current ones; the new
manifest names for every part the version that holds it.  Manifests are numbered
and never overwritten: readers take the highest, so they see the old or the new
state, never a part, and a writer that stops half way leaves the old one as it
was.  A writer claims the number of its version; of two at once the second is
refused and may start again from the new state.  A manifest newer than this
code is refused.

With every version goes the inverted index of pages and of quotes: records
whose texts changed get a new segment (``operators.index``).
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecask.operators import index as I
from pagecask.operators.archive import Archive, page_id
from pagecask.sources.scratch import written

FORMAT = 1
#: Folders a table is dealt to.
PARTS = 32
#: Segments of an index from which upkeep merges them.
MERGE_AT = 8
#: A claim without a manifest is void after so long.
CLAIM_MS = 6 * 3_600_000
TABLES = ("pages", "contents", "snippets")
_KEY = {"pages": "url", "contents": "page_id", "snippets": "id"}
_ORDER = {"pages": ("domain", "last_visit"), "contents": ("page_id",), "snippets": ("domain", "created_at")}
_WEIGHTS = {"pages": I.PAGE_WEIGHTS, "snippets": I.SNIPPET_WEIGHTS}
_LOCKS: dict[str, threading.RLock] = {}


class TooNewError(RuntimeError):
    """The snapshot was written by a later version of this code."""


class ConflictError(RuntimeError):
    """Another writer made this version first."""


@dataclass(frozen=True)
class Opened:
    """An archive as read, and where from; ``parts`` are those read of a table, all of the others."""

    archive: Archive
    manifest: dict
    parts: dict[str, list[int]]


def writer_lock(root: str) -> threading.RLock:
    """Writers of one process take turns."""
    return _LOCKS.setdefault(root, threading.RLock())


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder and when they were last written; none if there is no folder."""
    _, path, fs = _fs(spark, folder)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(path)} if fs.exists(path) else {}


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(m[1]) for n in _names(spark, root) if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))


def read_manifest(spark: SparkSession, root: str, newest: int = FORMAT) -> dict | None:
    versions = _versions(spark, root)
    if not versions:
        return None
    jvm, path, fs = _fs(spark, f"{root}/manifest-{versions[-1]}.json")
    stream = fs.open(path)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    manifest = json.loads(text)
    if manifest["format"] > newest:
        raise TooNewError(f"format {manifest['format']}, this code knows {newest}")
    return manifest


def _claim(spark: SparkSession, root: str, version: int) -> None:
    """Makes the version this writer's; refused if another has it, unless that one gave up long ago."""
    _, path, fs = _fs(spark, f"{root}/claim-{version}")
    if version in _versions(spark, root):
        raise ConflictError(f"version {version} of {root} is there")
    if fs.exists(path) and time.time() * 1000 - fs.getFileStatus(path).getModificationTime() >= CLAIM_MS:
        fs.delete(path, False)
    try:
        made = fs.createNewFile(path)
    except Exception as e:  # a file system may refuse by an error
        raise ConflictError(f"version {version} of {root} is claimed") from e
    if not made:
        raise ConflictError(f"version {version} of {root} is claimed")


@contextmanager
def _version(spark: SparkSession, root: str, version: int) -> Iterator[None]:
    """A claimed version; given back if the work on it fails."""
    _claim(spark, root, version)
    try:
        yield
    except BaseException:
        _, path, fs = _fs(spark, f"{root}/claim-{version}")
        fs.delete(path, False)
        raise


def _publish(spark: SparkSession, root: str, manifest: dict) -> None:
    version = manifest["version"]
    jvm, path, fs = _fs(spark, f"{root}/manifest-{version}.json")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{root}/.manifest-{version}.json.new")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if not fs.rename(fresh, path):
        raise OSError(f"cannot make {path}")


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    """``manifest`` as the next version; its tables stay where they are."""
    version = manifest["version"] + 1
    with _version(spark, root, version):
        _publish(spark, root, manifest | {"version": version})


# --- tables in parts ------------------------------------------------------------


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def parts_of(keys: DataFrame) -> list[int]:
    """Parts that hold the keys in the only column; PARTS numbers at most."""
    return sorted(r[0] for r in keys.select(part_of(F.col(keys.columns[0]))).distinct().collect())


def _write_parts(df: DataFrame, root: str, table: str, version: int) -> dict:
    folder = f"{root}/{table}/v{version}"
    dealt = df.withColumn("_part", part_of(F.col(_KEY[table]))).hint("rebalance", F.col("_part"))
    dealt.sortWithinPartitions("_part", *_ORDER[table]).write.mode("overwrite").partitionBy("_part").parquet(folder)
    return {n.removeprefix("_part="): f"v{version}" for n in _names(df.sparkSession, folder) if n.startswith("_part=")}


def _read_parts(spark: SparkSession, root: str, table: str, entry: dict, parts: list[int] | None) -> DataFrame:
    schema = T.StructType.fromJson(entry["schema"])
    wanted = [f"{root}/{table}/{v}/_part={k}" for k, v in sorted(entry["parts"].items()) if parts is None or int(k) in parts]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def open_snapshot(spark: SparkSession, root: str, newest: int = FORMAT, parts: dict[str, list[int]] | None = None) -> Opened | None:
    """The newest version; of the tables named in ``parts`` those parts only."""
    manifest = read_manifest(spark, root, newest)
    if manifest is None:
        return None
    parts = parts or {}
    tables = (_read_parts(spark, root, t, manifest["tables"][t], parts.get(t)) for t in TABLES)
    return Opened(Archive(*tables), manifest, parts)


def read_snapshot(spark: SparkSession, root: str, newest: int = FORMAT) -> Archive | None:
    opened = open_snapshot(spark, root, newest)
    return opened and opened.archive


def open_for(spark: SparkSession, root: str, urls: DataFrame, contents: bool = False) -> Opened:
    """The parts that hold the addresses in ``urls`` (url, in normal form) and, with ``contents``, their texts."""
    keys = written(urls.select("url").distinct(), "addresses")
    parts = {"pages": parts_of(keys)}
    if contents:
        own = open_snapshot(spark, root, parts=parts).archive.pages.join(keys, "url", "left_semi").select("id")
        parts["contents"] = parts_of(own.unionByName(keys.select(page_id(F.col("url")).alias("id"))))
    return open_snapshot(spark, root, parts=parts)


def write_snapshot(state: Archive, root: str, *, base: Opened | None = None, extra: dict | None = None, form: int = FORMAT) -> int:
    """The new version's number. ``extra`` is kept in the manifest (checkpoints of streams and imports).

    ``base`` is what the state was made of: tables that are still those of
    ``base`` stay where they are, and of the others only the parts that
    ``base`` has read are written.
    """
    spark = state.pages.sparkSession
    with writer_lock(root):
        old = (base.manifest if base else read_manifest(spark, root, form)) or {"version": 0, "extra": {}, "tables": {}, "index": {}}
        version = old["version"] + 1
        with _version(spark, root, version):
            tables, current = {}, {}
            for t in TABLES:
                df = getattr(state, t)
                if base and df is getattr(base.archive, t):
                    tables[t] = old["tables"][t]
                    continue
                fresh = _write_parts(df, root, t, version)
                kept = base.parts.get(t) if base else None
                others = {k: v for k, v in old["tables"][t]["parts"].items() if int(k) not in kept} if kept is not None else {}
                tables[t] = {"schema": json.loads(df.schema.json()), "parts": others | fresh}
                current[t] = _read_parts(spark, root, t, {"schema": tables[t]["schema"], "parts": fresh}, None)
            now = Archive(*(current.get(t, getattr(state, t)) for t in TABLES))
            kept_index = {"pages": list(old["index"].get("pages", [])), "snippets": list(old["index"].get("snippets", []))}
            for name in _WEIGHTS:
                segment = _segment(name, now, root, base, version, kept_index[name], bool(current.keys() & ({"pages", "contents"} if name == "pages" else {"snippets"})))
                if segment:
                    kept_index[name] = [*(kept_index[name] if base else []), segment.__dict__]
            _publish(spark, root, {"format": form, "version": version, "extra": old["extra"] | (extra or {}), "tables": tables, "index": kept_index})
    return version


# --- indexes ---------------------------------------------------------------------


def _texts(name: str, a: Archive) -> DataFrame:
    return I.page_texts(a.pages, a.contents) if name == "pages" else a.snippets.select("id", *I.SNIPPET_WEIGHTS)


def _marks(name: str, a: Archive, with_contents: bool) -> DataFrame:
    """(id, mark): a mark that changes with a record's texts, without reading them: a text is told by its size, hash and times."""
    if name == "snippets":
        return a.snippets.select("id", F.lit(0).alias("mark"))  # quotes come and go, and never change
    if not with_contents:
        return a.pages.select("id", F.xxhash64(F.coalesce("title", F.lit(""))).alias("mark"))
    sizes = a.contents.select(F.col("page_id").alias("id"), "bytes").hint("merge")
    told = ["bytes", "content_hash", "content_indexed_at", "saved_at"]
    return a.pages.select("id", "title", *told[1:]).join(sizes, "id", "left").select("id", F.xxhash64(F.coalesce("title", F.lit("")), *told).alias("mark"))


def _segment(name: str, now: Archive, root: str, base: Opened | None, version: int, segments: list, changed: bool) -> I.Segment | None:
    """The segment that a new version adds, if it changed a text."""
    spark, path = now.pages.sparkSession, f"{root}/index/{name}-{version}"
    if base is None or not segments:
        return I.write_segment(path, _WEIGHTS[name], _texts(name, now))
    if not changed:
        return None
    with_contents = now.contents is not base.archive.contents
    was, is_ = _marks(name, base.archive, with_contents), _marks(name, now, with_contents)
    both = was.select("id", F.col("mark").alias("a")).join(is_.select("id", F.col("mark").alias("b")).hint("merge"), "id", "full_outer")
    touched = written(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("id"), "touched")
    if not touched.limit(1).count():
        return None
    old = base.archive
    if name == "pages" and not with_contents:  # only the parts that hold the texts of the pages touched
        texts = _read_parts(spark, root, "contents", base.manifest["tables"]["contents"], parts_of(touched))
        now, old = replace(now, contents=texts), replace(old, contents=texts)
    only = lambda a: _texts(name, a).join(touched, "id", "left_semi")
    docs = read_index(spark, base.manifest, name).docs
    return I.write_segment(path, _WEIGHTS[name], only(now), only(old), touched, docs)


def read_index(spark: SparkSession, manifest: dict, name: str) -> I.Index:
    """The kept index of ``pages`` or ``snippets``."""
    return I.read_index(spark, [I.Segment(**s) for s in manifest["index"][name]], _WEIGHTS[name])


def merge_indexes(spark: SparkSession, root: str, at: int = MERGE_AT) -> list[str]:
    """Indexes of at least ``at`` segments get one, without reading a text; the names of those merged."""
    with writer_lock(root):
        manifest = read_manifest(spark, root)
        due = [n for n in _WEIGHTS if len(manifest["index"][n]) >= max(2, at)]
        if not due:
            return []
        version = manifest["version"] + 1
        with _version(spark, root, version):
            fresh = {n: [I.merged_segment(read_index(spark, manifest, n), f"{root}/index/{n}-{version}").__dict__] for n in due}
            _publish(spark, root, manifest | {"version": version, "index": manifest["index"] | fresh})
    return due


def compact(spark: SparkSession, root: str, most_files: int = 8, parts: int = 4) -> dict[str, list[int]]:
    """Rewrites at most ``parts`` parts of each table that have more than ``most_files`` files; a bounded step, repeated by later runs."""
    with writer_lock(root):
        manifest = read_manifest(spark, root)
        count = lambda t, k, v: sum(n.endswith(".parquet") for n in _names(spark, f"{root}/{t}/{v}/_part={k}"))
        due: dict[str, list[int]] = {}
        for t in TABLES:
            sizes = {k: count(t, k, v) for k, v in manifest["tables"][t]["parts"].items()}
            worst = sorted((k for k, n in sizes.items() if n > most_files), key=lambda k: (-sizes[k], int(k)))[:parts]
            if worst:
                due[t] = sorted(map(int, worst))
        if not due:
            return {}
        version = manifest["version"] + 1
        with _version(spark, root, version):
            tables = dict(manifest["tables"])
            for t, ks in due.items():
                fresh = _write_parts(_read_parts(spark, root, t, tables[t], ks), root, t, version)
                tables[t] = tables[t] | {"parts": tables[t]["parts"] | fresh}
            _publish(spark, root, manifest | {"version": version, "tables": tables})
    return due


# --- versions --------------------------------------------------------------------


def migrate(spark: SparkSession, root: str, steps: list[Callable[[Archive], Archive]]) -> int:
    """Brings an older snapshot to format len(steps), one step after another.

    The manifest appears once, after the last step: if one fails, the old
    version stays as it was.
    """
    opened = open_snapshot(spark, root, newest=len(steps))
    state = opened.archive
    for step in steps[opened.manifest["format"] :]:
        state = step(state)
    if opened.manifest["format"] < len(steps):
        write_snapshot(state, root, form=len(steps))
    return len(steps)


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes all manifests but the newest ``keep``, and the folders that none of these names; the versions removed."""
    versions = _versions(spark, root)
    stay = versions[-keep:]
    used: set[str] = set()
    for v in stay:
        jvm, path, fs = _fs(spark, f"{root}/manifest-{v}.json")
        stream = fs.open(path)
        manifest = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        used |= {f"{t}/{x}" for t in TABLES for x in manifest["tables"][t]["parts"].values()}
        used |= {"index/" + s["path"].rsplit("/", 1)[1] for segments in manifest["index"].values() for s in segments}
    _, _, fs = _fs(spark, root)
    delete = lambda name: fs.delete(_fs(spark, f"{root}/{name}")[1], True)
    for v in versions[:-keep]:
        delete(f"manifest-{v}.json")
    for name in _names(spark, root):
        if (m := re.fullmatch(r"claim-(\d+)", name)) and int(m[1]) < versions[-1]:
            delete(name)
    newer = versions[-1]
    for folder in (*TABLES, "index"):
        for name in _names(spark, f"{root}/{folder}"):
            number = int(re.search(r"(\d+)$", name)[1]) if re.search(r"\d+$", name) else newer + 1
            if f"{folder}/{name}" not in used and number <= newer:  # later ones are being written
                delete(f"{folder}/{name}")
    return [f"v{v}" for v in versions[:-keep]]
