"""Shared parts of the training-data operators.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every
executor sees, so that work survives the loss of an executor. Only where the
session names none (as in tests) is a temporary folder chosen.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only when its measured size is at most this; else it is shuffled.
BROADCAST_BYTES = 8 << 20
#: The same where the other side would have to shuffle whole texts.
BROADCAST_BESIDE_TEXTS = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, which no optimizer rule undoes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; text that is all ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def passthrough(df: DataFrame, reserved) -> list[Column]:
    """The input's columns but for those whose names the operator itself returns."""
    taken = {x.casefold() for x in reserved}
    return [quoted(c) for c in df.columns if c.casefold() not in taken]


class Scratch:
    """Written tables of one operator call, in the shared folder, until ``clear`` or the driver's end.

    Who runs operators one after another collects their tables with ``Scratch.recorded``
    and clears them once the results are written; nobody else's tables are touched.
    """

    _roots: dict[int, str] = {}
    _recording: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{self.root(spark)}/strandloom/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)
        for made in self._recording:
            made.append(self)

    @classmethod
    @contextlib.contextmanager
    def recorded(cls):
        """A list that gets every Scratch made inside the block."""
        made: list[Scratch] = []
        cls._recording.append(made)
        try:
            yield made
        finally:
            cls._recording.remove(made)

    @classmethod
    def root(cls, spark: SparkSession) -> str:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if found:
            return found.rstrip("/")
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return cls._roots.setdefault(id(spark.sparkContext), "file://" + tempfile.mkdtemp(prefix="strandloom-"))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The table as written and read back: a cut lineage that outlives executors."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception as why:  # the session may be going away with us
                print(f"scratch {self.path} stays: {why}")


def trimmed(work, mapped: int | None = None):
    """An Arrow function that gives its worker's unused memory back to the system when a task ends.

    Workers are kept from task to task; what they hold on to is taken from the executor's other tasks.
    Where ``mapped`` is given, blocks of so many bytes go back as soon as they are freed: else the
    C library raises that bound by itself, and large arrays leave holes in the worker's heap.
    """

    def run(batches):
        import ctypes
        import gc

        import pyarrow

        pyarrow.set_memory_pool(pyarrow.system_memory_pool())  # whose freed memory can be given back
        if mapped is not None:
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).mallopt(-3, mapped)  # M_MMAP_THRESHOLD
        try:
            yield from work(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every system's C library has it
                pass

    return run


def left_join_sized(left: DataFrame, right: DataFrame, keys: list[str], row_bytes: int, spread: Column, limit: int = BROADCAST_BYTES, salts: int = 16) -> DataFrame:
    """Left join with a written right side whose keys are unique.

    The right side is counted: up to ``limit`` bytes it is broadcast. Beyond, both
    sides are shuffled on the keys and a salt, with the right side's rows once per
    salt, so that a key that holds a third of the left rows meets many tasks.
    """
    if right.count() * row_bytes <= limit:
        return left.join(F.broadcast(right), keys, "left")
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(many, [*keys, "__salt"], "left").drop("__salt")
