"""Writes: full refresh, never-overwrite, several tables at once, count checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, p: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(p)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, p: str) -> bool:
    path, fs = _path(spark, p)
    return fs.exists(path)


def list_keys(spark: SparkSession, root: str) -> list[str]:
    """Paths of the files under `root`, relative to it."""
    path, fs = _path(spark, root)
    base, out, it = fs.makeQualified(path).toString().rstrip("/") + "/", [], fs.listFiles(path, True)
    while it.hasNext():
        out.append(it.next().getPath().toString().removeprefix(base))
    return sorted(out)


def with_loaded_at(df: DataFrame, at: str) -> DataFrame:
    """One load time shared by all tables of a run."""
    return df.withColumn("_loaded_at", F.lit(at).cast("timestamp"))


def refresh(df: DataFrame, path: str) -> int:
    """Replaces the table at `path`, schema included; an empty result is refused before anything is replaced. Returns its rows."""
    replace_all({path: df})
    return df.sparkSession.read.parquet(path).count()


def write_once(df: DataFrame, path: str) -> bool:
    """Writes an immutable dated file; False if there is one already, which stays as it is."""
    if exists(df.sparkSession, path):
        return False
    df.coalesce(1).write.mode("ignore").json(path)
    return True


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes an object whole: under a name of its own, then renamed over the old one."""
    target, fs = _path(spark, path)
    tmp = _path(spark, f"{path}._new_{uuid.uuid4().hex}")[0]
    s = fs.create(tmp, True)
    s.write(bytearray(data))
    s.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(tmp, target):
        raise OSError(f"{path} can't be written")


def put_json(spark: SparkSession, path: str, value) -> None:
    import json

    put_bytes(spark, path, json.dumps(value, sort_keys=True, ensure_ascii=False, indent=1).encode())


def collect_once(spark: SparkSession, path: str, role: str, location: str, fetched_at: str, jobs: list[dict]) -> dict:
    """Writes a collection as an immutable envelope; returns the audit counters: fetched, without id, repeated, written (0 if there was one already)."""
    ids = [j.get("job_id") for j in jobs]
    known = [i for i in ids if i]
    audit = {"fetched": len(jobs), "without_id": len(jobs) - len(known), "repeated": len(known) - len(set(known)), "written": 0}
    if jobs and not exists(spark, path):
        put_json(spark, path, {"role": role, "location": location, "fetched_at": fetched_at, "jobs": jobs, "audit": audit})
        audit["written"] = len(jobs)
    return audit


def replace_all(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Replaces several tables together: all are written beside their targets and counted, and only then renamed into place.

    If a rename fails, the tables renamed before are put back.
    """
    staged, counts = {}, {}
    for path, df in tables.items():
        tmp = f"{path.rstrip('/')}._new_{uuid.uuid4().hex}"
        df.write.parquet(tmp)
        staged[path], counts[path] = tmp, df.sparkSession.read.parquet(tmp).count()
        if not counts[path]:
            for t in staged.values():
                p, fs = _path(df.sparkSession, t)
                fs.delete(p, True)
            raise ValueError(f"{path}: no rows; nothing was replaced")
    spark = next(iter(tables.values())).sparkSession
    old, done = {}, []
    try:
        for path, tmp in staged.items():
            target, fs = _path(spark, path)
            if fs.exists(target):
                aside = f"{path.rstrip('/')}._old_{uuid.uuid4().hex}"
                if not fs.rename(target, _path(spark, aside)[0]):
                    raise OSError(f"{path} can't be set aside")
                old[path] = aside
            if not fs.rename(_path(spark, tmp)[0], target):
                raise OSError(f"{tmp} can't take the place of {path}")
            done.append(path)
    except Exception:
        for path in tables:  # all tables stand again as they were
            target, fs = _path(spark, path)
            if path in done:
                fs.delete(target, True)
            if path in old:
                fs.rename(_path(spark, old[path])[0], target)
            fs.delete(_path(spark, staged[path])[0], True)
        raise
    for o in old.values():
        p, fs = _path(spark, o)
        fs.delete(p, True)
    return counts


def to_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str] | None = None) -> int:
    """Overwrites a database table keeping its definition, then compares the row counts."""
    df.write.option("truncate", "true").option("batchsize", "10000").jdbc(url, name, mode="overwrite", properties=properties or {})
    got, want = df.sparkSession.read.jdbc(url, name, properties=properties or {}).count(), df.count()
    if got != want:
        raise ValueError(f"{name}: {got} rows arrived of {want}")
    return got


def fixture_sql(sample: DataFrame, name: str, most: int = 10_000) -> str:
    """A sampled table as SQL text: a fixture is small by purpose, more than `most` rows are refused."""
    rows = sample.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a fixture of more than {most} rows")

    def literal(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    columns = ", ".join(f'"{f.name}" {f.dataType.simpleString()}' for f in sample.schema.fields)
    values = ",\n".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f'CREATE TABLE "{name}" ({columns});\n' + (f'INSERT INTO "{name}" VALUES\n{values};\n' if rows else "")


def contract(schemas: dict[str, DataFrame]) -> str:
    """Schemas of named results as JSON with sorted keys."""
    import json

    return json.dumps({k: json.loads(df.schema.json()) for k, df in schemas.items()}, sort_keys=True, indent=1)


def read_only_statements(role: str, schemas: list[str], seconds: int = 30) -> list[str]:
    """SQL that lets a serving role read and nothing else."""
    out = [f"ALTER ROLE {role} SET statement_timeout = '{seconds}s'", f"ALTER ROLE {role} SET default_transaction_read_only = on"]
    for s in schemas:
        out += [f"GRANT USAGE ON SCHEMA {s} TO {role}", f"GRANT SELECT ON ALL TABLES IN SCHEMA {s} TO {role}", f"ALTER DEFAULT PRIVILEGES IN SCHEMA {s} GRANT SELECT ON TABLES TO {role}"]
    return out
