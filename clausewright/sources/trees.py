"""Source trees: the listing with its policy on the driver, reading and decoding on the executors."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clausewright.functions.policy import PROJECT_SKIPS

#: Bytes that a file is judged by before the rest is read.
PROBE = 8192
CONTENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("policy", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType()), T.StructField("problem", T.StringType()), T.StructField("raw", T.ArrayType(T.StringType())), T.StructField("named_file", T.StringType()), T.StructField("manifest_error", T.StringType())])
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
MANIFESTS = ("package.json", "composer.json", "Cargo.toml", "pyproject.toml")
#: Bytes that no text has, and how files of well-known binary formats begin.
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]")
_SIGNATURES = (b"%PDF-", b"\x89PNG", b"GIF87a", b"GIF89a", b"\xff\xd8\xff", b"PK\x03\x04", b"\x7fELF", b"\x1f\x8b", b"BZh", b"\xfd7zXZ", b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a", b"\xca\xfe\xba\xbe", b"RIFF", b"OggS")


@dataclass(frozen=True)
class ScanOptions:
    """Limits and scope of a scan; a limit of 0 is none."""

    max_depth: int = 32
    max_files: int = 10_000
    max_file_size: int = 1 << 20
    skip_dirs: tuple[str, ...] = ()
    no_default_skip: bool = False
    include_legal_files: bool = False
    scanner_version: str = "dev"
    workers: int | None = None

    def __post_init__(self) -> None:
        if self.workers is not None and self.workers < 1:
            raise ValueError("workers must be 1 or more")
        for name in ("max_depth", "max_files", "max_file_size"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")

    @property
    def scope(self) -> str:
        return "all" if self.no_default_skip else "project"


@dataclass
class Listing:
    root: str
    tasks: list[tuple[int, str, str, str]]  # doc_id, full path, path shown, path that the policy looks at
    skipped: list[tuple[str, str]]
    errors: list[tuple[str, str]]
    visited: int = 0
    directories_skipped: int = 0
    truncated: bool = False


def _directory_reason(name: str, depth: int, options: ScanOptions) -> str | None:
    if options.max_depth and depth > options.max_depth:
        return "depth"
    if name == ".git":
        return "version-control"
    if name in options.skip_dirs:
        return "configured-directory"
    if not options.no_default_skip and name.startswith("."):
        return "hidden-directory"
    return "project-scope" if not options.no_default_skip and name in PROJECT_SKIPS else None


def discover(root: str, options: ScanOptions = ScanOptions()) -> Listing:
    """The files to scan, in lexical order of the walk, and what is passed over and why. A root may be a single file."""
    found = Listing(root, [], [], [])
    info = os.stat(root)
    if not stat.S_ISDIR(info.st_mode):
        shown, found.visited = os.path.basename(root), 1
        folder = os.path.basename(os.path.dirname(os.path.normpath(root)))
        reason = "not-regular" if not stat.S_ISREG(info.st_mode) else "size" if options.max_file_size and info.st_size > options.max_file_size else None
        if reason:
            found.skipped.append((shown, reason))
        else:
            found.tasks.append((0, root, shown, f"{folder}/{shown}" if folder not in ("", ".") else shown))
        return found
    todo: list[tuple[str, str, int]] = [(os.path.realpath(root), "", 0)]
    while todo:
        full, shown, depth = todo.pop()
        if shown and not os.path.islink(full) and os.path.isdir(full) or not shown:
            reason = _directory_reason(os.path.basename(shown), depth, options) if shown else None
            if reason:
                found.directories_skipped += 1
                found.skipped.append((shown, reason))
                continue
            try:
                names = sorted(os.listdir(full), reverse=True)
            except OSError as e:
                found.errors.append((shown or ".", str(e)))
                continue
            todo += [(os.path.join(full, n), f"{shown}/{n}" if shown else n, depth + 1) for n in names]
            continue
        if options.max_files and found.visited >= options.max_files:
            found.truncated = True
            break
        found.visited += 1
        try:
            info = os.lstat(full)
        except OSError as e:
            found.errors.append((shown, str(e)))
            continue
        if stat.S_ISLNK(info.st_mode):
            found.skipped.append((shown, "symlink"))
        elif not stat.S_ISREG(info.st_mode):
            found.skipped.append((shown, "not-regular"))
        elif options.max_file_size and info.st_size > options.max_file_size:
            found.skipped.append((shown, "size"))
        else:
            found.tasks.append((len(found.tasks), full, shown, shown))
    return found


def is_binary(data: bytes) -> bool:
    return data.startswith(_SIGNATURES) or bool(_CONTROL.search(data))


def decode(data: bytes) -> tuple[str, str] | None:
    """(encoding, text) of the bytes of a file; None for a binary one. What is neither UTF-16 with a mark nor UTF-8 is ISO-8859-1."""
    for mark, name in ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data.startswith(mark):
            try:
                return name, data[2:].decode(name.replace("16", "16-"))
            except UnicodeDecodeError:
                break
    if is_binary(data):
        return None
    marked = data.startswith(b"\xef\xbb\xbf")
    try:
        return ("utf-8-bom", data[3:].decode("utf-8")) if marked else ("utf-8", data.decode("utf-8"))
    except UnicodeDecodeError:
        return "iso-8859-1", data.decode("iso-8859-1")


def declared(name: str, data: bytes) -> tuple[list[str], str]:
    """(names, file) of the licences that a package manifest declares. ValueError if it can't be read."""
    content = json.loads(data) if name.endswith("json") else tomllib.loads(data.decode("utf-8"))
    if not isinstance(content, dict):
        raise ValueError("no object at the top")
    part = content.get("package" if name == "Cargo.toml" else "project", {}) if name.endswith("toml") else content
    if not isinstance(part, dict):
        raise ValueError("no table of the package")
    raw, file, value = [], "", part.get("license", part.get("licenses"))
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, str) and x:
            raw.append(x)
        elif isinstance(x, dict):
            raw += [x[k] for k in ("type", "text") if isinstance(x.get(k), str)][:1]
            file = x.get("file", file)
    return raw, part.get("license-file", file) or ""


def raw_offset(text: str, encoding: str, offset: int) -> int:
    """The place in the file of a byte offset in the decoded text's UTF-8."""
    if encoding == "utf-8":
        return offset
    if encoding == "utf-8-bom":
        return offset + 3
    prefix = text.encode("utf-8")[:offset].decode("utf-8", "ignore")
    return len(prefix) if encoding == "iso-8859-1" else 2 + len(prefix.encode("utf-16-le"))


def read(spark: SparkSession, found: Listing, options: ScanOptions = ScanOptions(), workers: int | None = None) -> DataFrame:
    """One row for each listed file; ``problem`` is binary, size or an error. Files are read where the tasks run, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = options.max_file_size
        for batch in batches:
            for doc, full, shown, policy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row: list = [doc, shown, policy, *[None] * 8]
                name, data, marked = os.path.basename(shown), b"", False
                try:
                    with open(full, "rb") as f:
                        data = f.read(min(PROBE, most + 1) if most else PROBE)
                        marked = data.startswith((b"\xff\xfe", b"\xfe\xff"))
                        if marked or not is_binary(data):
                            data += f.read(max(0, most + 1 - len(data)) if most else -1)
                except OSError as e:
                    row[7] = f"error: {e}"
                else:
                    found = None if not marked and is_binary(data[:PROBE]) else decode(data)
                    if most and len(data) > most and (found or not is_binary(data[:PROBE])):
                        row[7] = "size"
                    elif found is None:
                        row[7] = "binary"
                    else:
                        row[3:7] = [len(data), hashlib.sha256(data).hexdigest(), *found]
                    if name in MANIFESTS:
                        try:
                            row[8:10] = declared(name, data)
                        except ValueError as e:
                            row[10] = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], CONTENT.names)

    tasks = spark.createDataFrame(found.tasks, "doc_id long, full string, path string, policy string")
    return tasks.repartition(workers or max(1, min(len(found.tasks) // 64 + 1, spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, CONTENT)
