"""Files by content: digests, manifests, path guard, environment."""

from __future__ import annotations

import hashlib
import platform
from collections.abc import Iterator
from importlib import import_module, metadata
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.errors import EvidenceError

#: The libraries whose versions a report records.
AUDITED = ("accelerate", "bitsandbytes", "datasets", "numpy", "peft", "scikit-learn", "torch", "transformers", "trl")


def sha256_file(path: str | Path) -> str:
    """The digest of a local file of any size, read in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


#: Files from this size on are read in pieces instead of as one value.
WHOLE = 1 << 27


def _hashed_in_pieces(paths: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in paths:
        digests = []
        for place in batch.column(0).to_pylist():
            filesystem, path = fs.FileSystem.from_uri(place)
            with filesystem.open_input_stream(path) as f:
                digests.append(hashlib.file_digest(_Readable(f), "sha256").hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], ["path", "length", "sha256"])


class _Readable:
    """An input stream in the form that file_digest() reads."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        piece = self.stream.read(len(buffer))
        buffer[: len(piece)] = piece
        return len(piece)


def scan(spark: SparkSession, root: str, whole: int = WHOLE) -> DataFrame:
    """(path, length, sha256) of all files under a folder, paths relative to it.

    Files are read and hashed by the cluster: small ones each as one value, those of
    ``whole`` bytes or more in pieces, so no length is too long.  Empty files come
    from the listing, as the reader skips them.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    marker = "/" + PurePosixPath(base).name + "/"
    # the reader gives absolute URIs; keep what follows the folder's own path
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    start = F.lit(len("/" + base.split(":", 1)[-1].strip("/")) + 2) if base.startswith("/") or ":" in base else F.locate(marker, plain) + len(marker)
    empty = spark.createDataFrame([(p,) for p in _empty_files(spark, base)], "path string")
    small = files.where(F.col("length") < whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") >= whole).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length").mapInArrow(_hashed_in_pieces, "path string, length bigint, sha256 string")
    found = small.unionByName(large).unionByName(empty.select("path", F.lit(0).cast("bigint").alias("length"), F.sha2(F.lit(b""), 256).alias("sha256")))
    return found.select(plain.substr(start, F.lit(1 << 20)).alias("path"), "length", "sha256")


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            out.append(status.getPath().toString())
    return out


def local_manifest(root: str | Path) -> dict:
    """Digests of the files of a local folder in the order of their paths, and the whole."""
    root = Path(root)
    if not root.is_dir():
        raise EvidenceError(f"{root} is not a folder")
    files = {p.relative_to(root): p for p in root.rglob("*") if p.is_file()}
    if not files:
        raise EvidenceError(f"{root} has no files")
    digests = {p.as_posix(): sha256_file(files[p]) for p in sorted(files)}
    whole = hashlib.sha256("".join(f"{n}\0{d}\n" for n, d in digests.items()).encode()).hexdigest()
    return {"files": digests, "combined_sha256": whole, "total_bytes": sum(p.stat().st_size for p in files.values())}


def verify_manifest(root: str | Path, recorded: dict, mutable: frozenset[str] = frozenset()) -> None:
    """Refuse missing, added and changed files, but for the ``mutable`` ones."""
    if not isinstance(recorded, dict) or not isinstance(recorded.get("files"), dict):
        raise EvidenceError("the recorded manifest is malformed")
    now, then = local_manifest(root)["files"], recorded["files"]
    bad = sorted(n for n in {*now, *then} - mutable if now.get(n) != then.get(n))
    if bad:
        raise EvidenceError(f"{root} differs from its manifest in {bad[:10]}")


def exists(spark: SparkSession, place: str) -> bool:
    """Whether the file system that the cluster uses for ``place`` has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def guarded(reference: object, root: str | Path, suffix: str) -> Path:
    """The place of a relative path inside ``root``; anything that leads out is refused."""
    if not isinstance(reference, str) or not reference:
        raise EvidenceError("a stored path must be a text")
    relative = PurePosixPath(reference)
    if relative.is_absolute() or ".." in relative.parts or relative.suffix != suffix:
        raise EvidenceError(f"{reference} is not a relative {suffix} path")
    base = Path(root).resolve()
    place = (base / relative).resolve()
    if base not in place.parents:
        raise EvidenceError(f"{reference} leads out of {root}")
    return place


def versions(names: tuple[str, ...] = AUDITED) -> dict[str, str]:
    out = {}
    for name in names:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = "not-installed"
    return out


def environment(gpu_name: str | None = None, cuda_version: str | None = None) -> dict:
    """Versions of the driver; the GPU is asked for where the library for it is installed."""
    available = gpu_name is not None
    if not available:
        try:
            cuda = import_module("torch").cuda
            available = bool(cuda.is_available())
            gpu_name = cuda.get_device_name(0) if available else None
        except ImportError:
            pass
    out = {"python": platform.python_version(), "platform": platform.platform(), "packages": versions(), "gpu_name": gpu_name, "cuda_available": available}
    return out | ({"cuda_version": cuda_version} if cuda_version else {})


def environment_table(spark: SparkSession) -> DataFrame:
    """(package, version) of the driver."""
    return spark.createDataFrame(sorted(versions().items()), "package string, version string")
