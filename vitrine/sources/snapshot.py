"""Versioned, content-addressed snapshots of a catalogue.

A snapshot is a folder of parquet tables, a manifest with the hash of every file, and a
pointer that names the current manifest under a sequence number that only grows.  The
pointer is written last, so readers see the old or the new snapshot, never a mixture.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from vitrine.config import SCHEMA_VERSION, RankingConfig
from vitrine.functions.scalars import canonical_json
from vitrine.sources.files import file_system

_BLOCK = 1 << 20


def _blocks(path: str) -> Iterator[bytes]:
    system, inner = file_system(path)
    with system.open_input_stream(inner) as f:
        while block := f.read(_BLOCK):
            yield block


def file_hash(path: str) -> str:
    h = hashlib.sha256()
    for block in _blocks(path):
        h.update(block)
    return h.hexdigest()


def _exists(path: str) -> bool:
    system, inner = file_system(path)
    return system.get_file_info(inner).type == fs.FileType.File


def _read(path: str) -> bytes:
    return b"".join(_blocks(path))


def _write(path: str, blocks) -> int:
    """Write beside ``path`` and move there, so that nobody sees half a file; returns the bytes."""
    system, inner = file_system(path)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    n, aside = 0, f"{inner}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(aside) as f:
        for block in blocks:
            n += f.write(block)
    system.move(aside, inner)
    return n


def _remove(path: str) -> None:
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        system.delete_dir(inner)
    elif info.type == fs.FileType.File:
        system.delete_file(inner)


def _below(folder: str) -> list[str]:
    """Paths of all files below a folder, relative to it."""
    system, inner = file_system(folder)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted(posixpath.relpath(f.path, inner) for f in found if f.type == fs.FileType.File)


def _each(job: Callable[[str, str], tuple[str, int, str]], pairs: list[tuple[str, str]]) -> list[tuple[str, int, str]]:
    """``job(a, b)`` for every pair of paths, in the tasks of the active session, else here; a row of text, number and text each."""
    spark = SparkSession.getActiveSession()
    if spark is None or len(pairs) < 2:
        return [job(*p) for p in pairs]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([job(*p) for p in zip(pdf["a"], pdf["b"])], columns=["x", "n", "y"])

    parts = min(len(pairs), spark.sparkContext.defaultParallelism * 4)
    # One row a file: what a manifest lists anyway.
    rows = spark.createDataFrame(pairs, "a string, b string").repartition(parts).mapInPandas(run, "x string, n long, y string")
    return [(r["x"], r["n"], r["y"]) for r in rows.collect()]


@dataclass(frozen=True)
class Pointer:
    version: str
    sequence: int
    manifest: str
    signature: str = ""

    @staticmethod
    def load(root: str) -> "Pointer | None":
        path = f"{root}/pointer.json"
        return Pointer(**json.loads(_read(path))) if _exists(path) else None

    def save(self, root: str) -> None:
        _write(f"{root}/pointer.json", [json.dumps(self.__dict__).encode()])


def publish(
    tables: dict[str, DataFrame], root: str, version: str, sequence: int, meta: dict | None = None, config: RankingConfig | None = None, sign: Callable[[bytes], str] | None = None
) -> Pointer:
    """Write the tables and move the pointer to them.

    ``root`` is on any file system that Spark and Arrow know.  Tasks hash and store the
    files of the tables; those equal to stored ones are stored once.  Raises
    ``ValueError`` for a sequence that isn't above the current one."""
    now = Pointer.load(root)
    if now and sequence <= now.sequence:
        raise ValueError(f"sequence {sequence} isn't above the current {now.sequence}")
    stage, store = f"{root}/stage-{version}-{sequence}", f"{root}/objects"
    _remove(stage)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{stage}/{name}")
    _write(f"{stage}/ranking.json", [(config or RankingConfig()).to_json().encode()])
    staged = [p for p in _below(stage) if p.endswith((".parquet", "ranking.json"))]

    def keep(path: str, _: str) -> tuple[str, int, str]:
        h = file_hash(f"{stage}/{path}")
        if not _exists(f"{store}/{h}"):
            _write(f"{store}/{h}", _blocks(f"{stage}/{path}"))
        system, inner = file_system(f"{store}/{h}")
        return path, system.get_file_info(inner).size, h

    files = [{"path": p, "hash": h, "bytes": n} for p, n, h in sorted(_each(keep, [(p, "") for p in staged]))]
    manifest = canonical_json({"version": version, "schema_version": SCHEMA_VERSION, "meta": meta or {}, "files": files})
    name = hashlib.sha256(manifest).hexdigest()
    _write(f"{store}/{name}", [manifest])
    pointer = Pointer(version, sequence, name, sign(manifest) if sign else "")
    pointer.save(root)
    _remove(stage)
    return pointer


def sync(root: str, local: str, verify: Callable[[bytes, str], bool] | None = None, floor: int = 0) -> tuple[Pointer, dict]:
    """Bring a copy up to date; returns the pointer and counts of chunks.

    Only files whose hash isn't there are copied, by tasks, every copy is checked, files
    that are no longer listed go, and the copy's pointer moves last.  Raises
    ``ValueError`` for a rolled back sequence, a bad signature, a bad hash or a path that
    leaves the folder."""
    pointer = Pointer.load(root)
    if pointer is None:
        raise ValueError(f"no snapshot in {root}")
    mine = Pointer.load(local)
    if pointer.sequence < max(floor, mine.sequence if mine else 0):
        raise ValueError(f"sequence {pointer.sequence} is older than what was seen before")
    raw = _read(f"{root}/objects/{pointer.manifest}")
    if hashlib.sha256(raw).hexdigest() != pointer.manifest or (verify and not verify(raw, pointer.signature)):
        raise ValueError("the manifest isn't the one that was published")
    manifest, target = json.loads(raw), f"{local}/files"
    for f in manifest["files"]:
        if posixpath.isabs(f["path"]) or posixpath.normpath(f["path"]).startswith(".."):
            raise ValueError(f"{f['path']} leaves the folder")

    def fetch(path: str, h: str) -> tuple[str, int, str]:
        place = f"{target}/{path}"
        if _exists(place) and file_hash(place) == h:
            return path, 0, "reused"
        n = _write(place, _blocks(f"{root}/objects/{h}"))
        if file_hash(place) != h:
            _remove(place)
            return path, 0, "bad"
        return path, n, "fetched"

    done = _each(fetch, [(posixpath.normpath(f["path"]), f["hash"]) for f in manifest["files"]])
    bad = [p for p, _, how in done if how == "bad"]
    if bad:
        raise ValueError(f"{bad[0]} isn't what was published")
    kept = {p for p, _, _ in done}
    for old in _below(target):
        if old not in kept:
            _remove(f"{target}/{old}")
    pointer.save(local)
    count = lambda how: sum(h == how for _, _, h in done)
    return pointer, {"fetched": count("fetched"), "reused": count("reused"), "bytes": sum(n for _, n, _ in done)}


def load(spark: SparkSession, local: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{local}/files/{name}")


def has(local: str, name: str) -> bool:
    system, inner = file_system(f"{local}/files/{name}")
    return system.get_file_info(inner).type == fs.FileType.Directory


def load_config(local: str, schema_version: int = SCHEMA_VERSION) -> RankingConfig:
    """The snapshot's ranking; old snapshots may lack it, newer ones must not, and a malformed one raises."""
    path = f"{local}/files/ranking.json"
    if not _exists(path):
        if schema_version < 2:
            return RankingConfig()
        raise FileNotFoundError(f"{path} is missing")
    return RankingConfig.from_json(_read(path).decode())
