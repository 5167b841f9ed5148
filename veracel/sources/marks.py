"""Empty files whose names say what was committed, on any store that Spark reaches."""

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def mark(spark: SparkSession, path: str) -> bool:
    """Make the empty file; False if it is there already, so of two writers one wins."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    try:
        fs.create(p, False).close()
    except Exception as e:  # a Java exception of any store
        if fs.exists(p):
            return False
        raise e
    return True


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
