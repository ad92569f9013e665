"""Small files with names of their own: manifests, sidecars, one document for each record."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 4 << 20         # bytes of a log in one row
BATCH = 8 << 20         # bytes that a task hands on at once


def _store(root: str):
    """Arrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    # Hadoop writes local URIs with one slash
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", root))


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _pieces(stream, whole: bool) -> Iterator[bytes]:
    """All of a file, or pieces of whole lines."""
    if whole:
        yield stream.read()
        return
    rest = b""
    while more := stream.read(PIECE):
        cut = more.rfind(b"\n") + 1
        if cut:
            yield rest + more[:cut]
            rest = more[cut:]
        else:
            rest += more
    if rest:
        yield rest


def read_files(spark: SparkSession, root: str, names: tuple[str, ...], lines: tuple[str, ...] = (), content: bool = True) -> DataFrame:
    """(path, piece, content) of the files below ``root`` with a name like one of ``names``, whole, or ``lines``, in pieces of
    whole lines. Without ``content`` files are only listed.

    Tasks list the folders, so the driver never holds a list of the files: the folder itself in one task, the two levels below
    it dealt out, each with all that is below in the task that reads it. Where Arrow has no file system for the
    root, Spark's own reader lists and reads whole files; then the list of the files passes through the driver.
    """
    try:
        base = _store(root)[1]
    except Exception:       # a store that only Hadoop knows
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join((*names, *lines)) + "}").load(root)
        return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit(0).alias("piece"), F.col("content" if content else "path").cast("binary").alias("content"))

    def children(store, folder: str):
        from pyarrow import fs

        return [x for x in store.get_file_info(fs.FileSelector(folder)) if not _hidden(x.base_name)]

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store = _store(root)[0]
        for d in batches:
            for path, folder in zip(d["path"], d["folder"], strict=True):
                found = [(x.path, x.type == fs.FileType.Directory) for x in children(store, path)] if folder else [(path, False)]
                yield pd.DataFrame(found, columns=["path", "folder"]).astype({"path": object, "folder": bool})

    def below(store, path: str, folder: bool) -> Iterator[str]:
        from pyarrow import fs

        if not folder:
            yield path
            return
        for x in children(store, path):
            yield from below(store, x.path, x.type == fs.FileType.Directory)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = _store(root)[0]
        rows, size = [], 0
        frame = lambda: pd.DataFrame(rows, columns=["path", "piece", "content"])
        for d in batches:
            for top, folder in zip(d["path"], d["folder"], strict=True):
                for path in below(store, top, folder):
                    name = path.rsplit("/", 1)[1]
                    whole = any(fnmatchcase(name, x) for x in names)
                    if not whole and not any(fnmatchcase(name, x) for x in lines):
                        continue
                    if not content:
                        rows.append((path, 0, b""))
                    else:
                        with store.open_input_stream(path) as stream:
                            for piece, data in enumerate(_pieces(stream, whole)):
                                # JSON comes in any of its encodings
                                if name.endswith(".json") and (code := json.detect_encoding(data)) != "utf-8":
                                    data = data.decode(code, "replace").encode()
                                rows.append((path, piece, data))
                                size += len(data)
                                if size >= BATCH:
                                    yield frame()
                                    rows, size = [], 0
                    if len(rows) >= 10_000:
                        yield frame()
                        rows, size = [], 0
        if rows:
            yield frame()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.createDataFrame([(base, True)], "path string, folder boolean")
    for _ in range(2):
        found = found.mapInPandas(opened, "path string, folder boolean").repartition(tasks, "path")
    return found.mapInPandas(read, "path string, piece int, content binary")


def write_files(files: DataFrame, root: str) -> int:
    """Write each row (path, content) as a UTF-8 file below ``root`` and return their number.

    Spark's own writers name files themselves; here the layout is the format. Tasks write through Arrow's
    file systems (a local or mounted path, or a URI), each its own files. A task that runs again writes the
    same files again. ``path`` is relative, and must not repeat; rows with a null are left out.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        made = set()
        for d in batches:
            for path, content in zip(d["path"], d["content"], strict=True):
                name = f"{base}/{path}"
                folder = name.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(name) as out:
                    out.write(content.encode())
            yield pd.DataFrame({"n": [len(d)]})

    rows = files.where("path is not null and content is not null").select("path", "content")
    return rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
