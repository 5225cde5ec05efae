"""File system calls that the DataFrame writer has no form for, through Hadoop's own interface, so
that they reach whatever store the paths name."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def _system(spark: SparkSession, path: str):
    hadoop, conf = _hadoop(spark)
    place = hadoop.Path(path)
    return place.getFileSystem(conf), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without hidden ones; none if there is no such folder."""
    system, place = _system(spark, path)
    if not system.exists(place):
        return []
    found = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(name for name in found if name[0] not in "._")


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _system(spark, path)
    return system.exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.mkdirs(place)


def delete(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, place = _system(spark, path)
    out = system.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Gives a complete file its name unless that is taken; says whether it did.

    The name node of a distributed file system does this in one step, and so does a link on a local
    disk: of two writers one is refused. A store that copies on renaming cannot promise that: there
    one writer at a time.
    """
    hadoop, conf = _hadoop(spark)
    system, place = _system(spark, target)
    try:
        if system.getScheme() == "file":
            jvm = spark.sparkContext._jvm
            local = [jvm.java.io.File(system.makeQualified(hadoop.Path(p)).toUri()).toPath() for p in (target, source)]
            jvm.java.nio.file.Files.createLink(*local)
            delete(spark, source)
        else:
            options = getattr(hadoop, "Options$Rename")
            nothing = spark.sparkContext._gateway.new_array(options, 0)
            hadoop.FileContext.getFileContext(place.toUri(), conf).rename(hadoop.Path(source), place, nothing)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True
