"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.session import reliable_checkpoint

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A table is broadcast only while its rows, times their width, stay below this.
BROADCAST_BYTES = 16 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay, as the contracts ask."""
    return F.translate(text, UPPER, UPPER.lower())


def saved(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder and read back."""
    return reliable_checkpoint(df)


def small_enough(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def hand_back() -> None:
    """Gives the system what this worker's allocators hold unused.  A worker stays beside the stages
    that follow, and on a small executor their memory is what it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others return memory by themselves
    if trim:
        trim(0)


def buckets_of(df: DataFrame) -> int:
    """Groups for work that loads one group at a time: a few for each shuffle
    partition, so that a group's size follows the partition size chosen for
    the cluster."""
    return 4 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, by name or by absolute path."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def streamed_sha256(df: DataFrame, keys: list[str], order: list[str], texts: dict[str, str],
                    between: str = "") -> DataFrame:
    """(*keys, and a column for each of ``texts``, name: column): SHA-256, as hex, of a group's texts in order.

    A digest is sequential, so a group passes through one task, sorted by Spark (which spills); the
    task holds a digest's state and one batch, never a group.  Join short texts to longer ones first."""
    rows = df.select(*keys, *order, *texts.values()).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema, joint = df.select(*keys).schema, between.encode()
    for name in texts:
        schema = schema.add(name, "string")

    def run(batches):
        now, digests, batch = None, None, None
        for batch in batches:
            done = []
            values = zip(*(batch[c].to_pylist() for c in (*keys, *texts.values())), strict=True)
            for row in values:
                key, parts = row[:len(keys)], row[len(keys):]
                if digests is None or key != now:
                    if digests is not None:
                        done.append((*now, *(d.hexdigest() for d in digests)))
                    now, digests = key, [hashlib.sha256() for _ in parts]
                elif joint:
                    for digest in digests:
                        digest.update(joint)
                for digest, part in zip(digests, parts, strict=True):
                    digest.update((part or "").encode("utf-8", "replace"))
            yield arrow(done, batch)
        if digests is not None:
            yield arrow([(*now, *(d.hexdigest() for d in digests))], batch)

    def arrow(done, like):
        fields = [*(like.schema.field(k) for k in keys), *(pa.field(n, pa.string()) for n in texts)]
        columns = zip(*done, strict=True) if done else [()] * len(fields)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    return rows.mapInArrow(run, schema)
