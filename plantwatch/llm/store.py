"""Work folders and binary files in the store that the cluster shares."""

import contextlib
import ctypes
import io
import os
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyarrow import fs

import plantwatch
from plantwatch.session import work_dir


def shared_dir(spark, name):
    """A fresh folder under ``spark.checkpoint.dir`` as a URI that every task can open."""
    path = work_dir(spark, name)
    return path if "://" in path else "file://" + path.removeprefix("file:")


def written(df, name, spark=None):
    """Write ``df`` to the shared folder and read it back: later steps start from the files, not from the lineage."""
    spark = spark or df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_file(folder, name, data):
    """Write one file whole or not at all: under a name of this attempt first, renamed when it is complete."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(attempt, compression=None) as out:
        for part in data if not isinstance(data, bytes) else [data]:
            out.write(part)
    store.move(attempt, f"{path}/{name}")
    return f"{folder}/{name}"


def ship(spark):
    """Send this package to the Python workers, once a session, unless they find it by themselves.

    They do if its folder is on PYTHONPATH, or is the working folder of a local session. Otherwise a zip file in the shared
    folder is added to the session, as ``--py-files`` would.
    """
    root = Path(plantwatch.__file__).resolve().parents[1]
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if spark.sparkContext.master.startswith("local"):
        paths.append(os.getcwd())
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(Path(p).resolve() == root for p in paths):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.joinpath("plantwatch").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(write_file(shared_dir(spark, "package"), "plantwatch.zip", data.getvalue()))
    _SHIPPED.add(app)


_SHIPPED = set()


def removed(folder):
    """Delete a folder of the store whose successor has been written."""
    store, path = fs.FileSystem.from_uri(folder)
    store.delete_dir(path)


def open_file(uri):
    """A seekable file of the store, for ranged reads."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def partitions(df):
    """How many tasks a shuffle of this session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release():
    """Give memory that is no longer used back to the system; a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def column_by_parts(batch, name, compute, schema, rows=512):
    """A column of an Arrow batch, computed from lists of a text column's values, a few rows at a time."""
    column, found = batch.column(name), []
    for k in range(0, batch.num_rows, rows):
        found.extend(compute([t or "" for t in column.slice(k, rows).to_pylist()]))
    return pa.array(found, schema)


def kept_rows(docs, text_column, keep):
    """The rows of ``docs`` whose text ``keep`` (a function from lists of texts to lists of booleans) wants."""
    def choose(batches):
        for batch in batches:
            yield batch.filter(column_by_parts(batch, text_column, keep, pa.bool_()))
        release()

    return docs.mapInArrow(choose, docs.schema)


def rows_of(batch, rows=256):
    """An Arrow batch as tuples of its columns, turned into Python values a few rows at a time."""
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        yield from zip(*[column.to_pylist() for column in part.columns])
