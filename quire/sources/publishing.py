"""Folders that are there whole or not at all.

Data is written aside, in a folder of its own version; a marker file that names the version is then put in place by
one rename, which a file system does at once or not at all. Only what the marker names is
read, so a writer that dies half-way leaves nothing that counts, and of two writers the second finds the
marker and takes the first one's data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

MARKER = "_PUBLISHED"


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file context and file system that serve ``path``, and its path class."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(conf)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf), fs, of


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the published version of ``path``; None where nothing has been published."""
    _, fs, of = _hadoop(spark, path)
    marker = of(f"{path}/{MARKER}")
    if not fs.exists(marker):
        return None
    stream = fs.open(marker)
    try:
        return f"{path}/{stream.readUTF()}"
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, write: Callable[[str], None], replace: bool = False) -> str:
    """Calls ``write`` with a new folder and publishes it, unless ``path`` has been published (then, without
    ``replace``, nothing is written). Returns the folder that counts afterwards."""
    if not replace and (there := published(spark, path)):
        return there
    context, fs, of = _hadoop(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    note = of(f"{path}/_note-{version}")
    stream = fs.create(note, True)
    stream.writeUTF(version)
    stream.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE if replace else options.NONE
    try:
        context.rename(note, of(f"{path}/{MARKER}"), how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(note, False)  # another writer was first: ours goes, theirs counts
        fs.delete(of(f"{path}/{version}"), True)
    return published(spark, path)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Published folders right below ``path``, by name."""
    _, fs, of = _hadoop(spark, path)
    found = fs.globStatus(of(f"{path}/*/{MARKER}"))
    parents = sorted(f.getPath().getParent().toString() for f in found or ())
    return [published(spark, p) for p in parents]
