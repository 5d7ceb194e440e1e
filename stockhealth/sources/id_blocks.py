"""Action ids for several writers: a writer claims whole blocks of ids by creating a file for each."""
from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 16  # ids in a block; the same for all writers of a log
CLAIMS = "_ids"  # readers pass over names with an underscore


def open_claims(spark: SparkSession, log: str):
    """The folder of claims, made if it is not there, and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{log.rstrip('/')}/{CLAIMS}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    return folder, files


def claim_blocks(spark: SparkSession, log: str, first: int, count: int) -> list[int]:
    """The numbers, ascending, of ``count`` blocks from ``first`` on that nobody else has or will get.

    A claim is a file that only one writer can create: ``O_EXCL`` on a local disk, elsewhere a create without overwrite, which must
    be atomic in that store (it is on HDFS). The block of a writer that fails afterwards is never used.
    """
    folder, files = open_claims(spark, log)
    local = folder.toUri().getPath() if files.getScheme() == "file" else None

    def taken(number: int) -> bool:
        if local:
            try:
                os.close(os.open(f"{local}/{number}", os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        file = spark._jvm.org.apache.hadoop.fs.Path(folder, str(number))
        try:
            files.create(file, False).close()
        except Py4JJavaError:
            if files.exists(file):
                return False
            raise
        return True

    blocks: list[int] = []
    number = first
    while len(blocks) < count:
        if taken(number):
            blocks.append(number)
        number += 1
    return blocks


def next_block(last_id: int | None, size: int = BLOCK) -> int:
    """The first block that lies above all ids up to ``last_id``."""
    return -(-(last_id or 0) // size)


def id_at(position: Column, blocks: list[int], size: int = BLOCK) -> Column:
    """The id of the row at a position counted from 1: the blocks are filled one after the other."""
    row = position - 1
    return F.array(*[F.lit(b * size) for b in blocks])[F.floor(row / size).cast("int")].cast("long") + row % size + 1
