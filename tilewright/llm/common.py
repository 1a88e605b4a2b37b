"""Words, folds and kept tables shared by the operators.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; ``bytes.split()`` without arguments cuts exactly
there, and ``bytes.lower()`` lowers exactly A-Z, so the Python operators work on the UTF-8 bytes of the text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tilewright.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
SIEVE = 2 ** 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: computed once, cut from its lineage, columnar.

    The files belong to the application (``<checkpoint dir>/<uuid>/kept-*``) and go when that folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def discard(kept: DataFrame) -> None:
    """Delete the files of a table from :func:`keep` that nothing reads any more; what was made of it must be kept itself."""
    path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.kept_path)
    path.getFileSystem(kept.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fold(column: Column | str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null stays null."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(col.cast("string").cast("binary")) % modulus


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], dict], keep_columns: list[str],
              added: list[tuple[str, T.DataType]]) -> DataFrame:
    """Arrow map that passes ``keep_columns`` through and adds the columns that ``work`` computes for each batch."""
    schema = T.StructType([df.schema[c] for c in keep_columns] + [T.StructField(n, t) for n, t in added])
    types = {n: _arrow(t) for n, t in added}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = work(batch)
                arrays = [batch.column(c) for c in keep_columns] + [pa.array(new[n], types[n]) for n in types]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep_columns, *types])

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
            "binary": pa.binary(), "boolean": pa.bool_()}[kind.simpleString()]


class HashedWords(dict):
    """word -> 32-bit hash, remembered for frequent lookups; starts anew when a million words are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with one row for each group, where a group may hold any share of the rows.

    ``groups`` has ``_n``, the number of rows of the group; those above ``total / 1000`` are at most a thousand and are
    broadcast, so their rows stay where they are. The others meet in a shuffle. ``_n`` is dropped.
    """
    share = total // 1000 + 1
    hot = F.broadcast(groups.where(F.col("_n") > share).drop("_n"))
    rest = groups.where(F.col("_n") <= share).drop("_n")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key, how), allowMissingColumns=True)


def sieve(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key may be among the wanted ones: all that are and some others, before a join has to shuffle them.

    A broadcast table has ``SIEVE`` words of 64 bits and a bit for the hash of each wanted key. Its size is bounded; with
    more keys than bits it only lets more rows pass.
    """
    bit = "shiftleft(1L, int(pmod(shiftright(_h, 32), 64)))"
    word = F.pmod("_h", F.lit(SIEVE)).alias("_w")
    words = wanted.select(F.xxhash64(wanted_key).alias("_h")).groupBy(word).agg(F.expr(f"bit_or({bit})").alias("_m"))
    hashed = rows.withColumn("_h", F.xxhash64(key)).select("*", word)
    return hashed.join(F.broadcast(words), "_w").where(F.expr(f"(_m & {bit}) != 0")).select(rows.columns)
