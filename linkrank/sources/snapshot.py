"""Generations of an index on any Hadoop file system: datasets, a manifest with checksums, and a replayable log.

A generation is a folder that is complete once its manifest is there; the manifest is written last. Reading takes the
newest generation whose files match their checksums, so a broken write falls back to the one before.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
PARTS = ("documents", "chunks", "vectors")
MAX_LOG_RECORDS = 10_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's ``spark.checkpoint.dir``. Without one, a single-machine session gets a temporary folder; a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)


def hadoop(spark: SparkSession, path: str):
    """File system and path of a location, and the JVM."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p, _ = hadoop(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target and rename over it, so that a reader sees the old text or the new one."""
    fs, p, jvm = hadoop(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(path + ".next")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    whole = fs.makeQualified(p)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), whole, options)


def integrity(spark: SparkSession, path: str) -> dict:
    """bytes and sha256 of a dataset: the hash of its files' hashes, each computed where the file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("length", F.sha2("content", 256).alias("h"))
    row = files.agg(F.sum("length").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("h")).first()
    return {"bytes": row["n"] or 0, "sha256": row["h"]}


def generations(spark: SparkSession, root: str) -> list[int]:
    fs, p, _ = hadoop(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((int(n[11:]) for n in names if re.fullmatch(r"generation-\d+", n)), reverse=True)


def write(spark: SparkSession, root: str, parts: dict[str, DataFrame], identity: dict, keep: int = 2) -> int:
    """Write the next generation and drop those before the last ``keep``."""
    have = generations(spark, root)
    number = (have[0] if have else 0) + 1
    folder = f"{root}/generation-{number}"
    manifest = {"schemaVersion": SCHEMA_VERSION, "generation": number, "identity": identity, "files": {}}
    for name in PARTS:
        parts[name].write.mode("overwrite").parquet(f"{folder}/{name}")
        manifest["files"][name] = integrity(spark, f"{folder}/{name}") | {"rows": spark.read.parquet(f"{folder}/{name}").count()}
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=2) + "\n")
    for old in have[keep - 1 :]:
        delete(spark, f"{root}/generation-{old}")
    return number


def valid(spark: SparkSession, root: str, number: int) -> dict | None:
    """The manifest of a generation that is complete, of this schema and unchanged; None otherwise."""
    folder = f"{root}/generation-{number}"
    try:
        manifest = json.loads(read_text(spark, f"{folder}/manifest.json") or "null")
        if not manifest or manifest["schemaVersion"] != SCHEMA_VERSION:
            return None
        same = all({k: manifest["files"][n][k] for k in ("bytes", "sha256")} == integrity(spark, f"{folder}/{n}") for n in PARTS)
        return manifest if same else None
    except Exception:  # whatever is wrong with a generation, an older one may be sound
        return None


def open_latest(spark: SparkSession, root: str, identity: dict | None = None) -> tuple[dict, dict[str, DataFrame]] | None:
    """Manifest and datasets of the newest sound generation (of this identity, if one is given)."""
    for number in generations(spark, root):
        manifest = valid(spark, root, number)
        if manifest and (identity is None or manifest["identity"] == identity):
            return manifest, {n: spark.read.parquet(f"{root}/generation-{number}/{n}") for n in PARTS}
    return None


def log_record(sequence: int, created_at: int, delta: dict) -> str:
    """One line of the log: the payload with its SHA-256."""
    payload = json.dumps({"sequence": sequence, "createdAt": created_at, "delta": delta}, ensure_ascii=False, separators=(",", ":"))
    return json.dumps({"payload": payload, "checksum": hashlib.sha256(payload.encode()).hexdigest()}, ensure_ascii=False)


PAYLOAD = "sequence long, createdAt long, delta struct<removals:array<string>,upserts:array<struct<path:string,value:string>>>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, created_at, delta, valid) of a log's lines; ``incremental.valid_prefix`` gives what may be replayed.

    A line that is cut off or altered is not valid; where it has no readable number it counts as a gap.
    """
    line = F.from_json("value", "payload string, checksum string")
    x = spark.read.text(path).select(line.alias("l")).select(F.from_json("l.payload", PAYLOAD).alias("p"), (F.sha2(F.col("l.payload").cast("binary"), 256) == F.col("l.checksum")).alias("ok"))
    return x.select(F.col("p.sequence").alias("sequence"), F.col("p.createdAt").alias("created_at"), F.col("p.delta").alias("delta"), F.coalesce("ok", F.lit(False)).alias("valid")).where("sequence is not null")


def log_entries(records: DataFrame) -> DataFrame:
    """(sequence, op, path, value) of valid records, for ``incremental.replay``."""
    up = records.select("sequence", F.lit("upsert").alias("op"), F.explode("delta.upserts").alias("u")).select("sequence", "op", "u.path", "u.value")
    gone = records.select("sequence", F.lit("remove").alias("op"), F.explode("delta.removals").alias("path")).withColumn("value", F.lit(None).cast("string"))
    return up.unionByName(gone)


# The log as a folder: a header that says what it belongs to, and a file for each record. Object stores can't append.


def _record_name(sequence: int) -> str:
    return f"record-{sequence:08d}.json"


def _sequences(spark: SparkSession, root: str) -> list[int]:
    fs, p, _ = hadoop(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[7:15]) for n in names if re.fullmatch(r"record-\d{8}\.json", n))


def log_identity(spark: SparkSession, root: str) -> dict | None:
    """What the log belongs to, by its header; None without a sound one."""
    try:
        header = json.loads(read_text(spark, f"{root}/header.json") or "null")
    except ValueError:
        return None
    return header["identity"] if isinstance(header, dict) and header.get("schemaVersion") == SCHEMA_VERSION and "identity" in header else None


def append_log(spark: SparkSession, root: str, identity: dict, created_at: int, delta: dict) -> int:
    """Append a record and return its sequence; a log of another identity is begun anew, an empty delta appends nothing (0)."""
    if not delta.get("removals") and not delta.get("upserts"):
        return 0
    if log_identity(spark, root) != identity:
        delete(spark, root)
        write_text(spark, f"{root}/header.json", json.dumps({"schemaVersion": SCHEMA_VERSION, "identity": identity}, sort_keys=True))
    have = _sequences(spark, root)
    if len(have) >= MAX_LOG_RECORDS:
        raise ValueError(f"the log has {MAX_LOG_RECORDS} records; write a generation and clear it")
    number = (have[-1] if have else 0) + 1
    write_text(spark, f"{root}/{_record_name(number)}", log_record(number, created_at, delta))
    return number


def open_log(spark: SparkSession, root: str, identity: dict) -> tuple[DataFrame, int]:
    """(records up to the first that is unsound, number of records dropped). A log of another identity is dropped whole.

    What is dropped is deleted, so the next record follows the last sound one.
    """
    from linkrank.operators.incremental import valid_prefix

    have = _sequences(spark, root)
    empty = spark.createDataFrame([], f"sequence long, created_at long, delta {PAYLOAD.split('delta ')[1]}, valid boolean")
    if log_identity(spark, root) != identity:
        delete(spark, root)
        return empty, len(have)
    if not have:
        return empty, 0
    last = valid_prefix(read_log(spark, f"{root}/record-*.json")).agg({"sequence": "max"}).first()[0] or 0
    broken = [n for n in have if n > last]
    for n in broken:
        delete(spark, f"{root}/{_record_name(n)}")
    return (read_log(spark, f"{root}/record-*.json") if last else empty), len(broken)


def clear_log(spark: SparkSession, root: str) -> bool:
    return delete(spark, root)


def sound_entry(sha256: Column, size: Column) -> Column:
    """True for a manifest's entry that can be one: a SHA-256 in small letters, a size that isn't negative."""
    return F.coalesce(sha256.rlike("^[a-f0-9]{64}$") & (size >= 0), F.lit(False))
