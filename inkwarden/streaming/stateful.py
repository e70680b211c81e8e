"""Stateful streams: the audit chain by keyed state; the sealed audit log and the admission counter by a ledger of batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..operators import admission, ops
from ..operators.ops import canonical_halves
from .poll import Ledger


def chain_stream(entries: DataFrame, chain: list[str], order: str, fields: list[str],
                 rows_per_file: int = 4096, parts: int = 16) -> DataFrame:
    """The audit chain as a stream: state is the last hash of each log file.

    Log files are rotated by sequence number (see the batch operator), so a file receives at
    most ``rows_per_file`` rows over its life.  A state row holds the files of one number in one of
    ``parts`` parts of the chains: files of a few lines each are gathered, and a call of the function
    is for many of them.  Where every chain has sequence numbers of its own, ``parts`` is to grow with
    the chains, for all of them have a file of each number.
    """
    head, tail = canonical_halves(fields)
    numbered = entries.withColumn("file_no", F.floor(F.col(order) / rows_per_file).cast("bigint"))
    # Chains pass as text: a long column with nulls would be floats in pandas.
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    rows = numbered.select(
        F.to_json(F.struct(*chain), exact).alias("name"), "file_no", F.pmod(F.xxhash64(*chain), F.lit(parts)).alias("part"),
        F.col(order).alias("seq"), head.alias("head"), tail.alias("tail"))
    schema = "name string, file_no bigint, seq bigint, prev string, hash string"

    def extend(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["name", "seq"])
        ends = dict(zip(*state.get, strict=True)) if state.exists else {}
        prevs, hashes = [], []
        for name, h, t in zip(rows["name"], rows["head"], rows["tail"], strict=True):
            prevs.append(ends.get(name, fixed.GENESIS))
            ends[name] = hashlib.sha256(f"{h}{prevs[-1]}{t}".encode()).hexdigest()
            hashes.append(ends[name])
        state.update((list(ends), list(ends.values())))
        yield pd.DataFrame({"name": rows["name"].to_numpy(), "file_no": [key[0]] * len(rows), "seq": rows["seq"].to_numpy(),
                            "prev": prevs, "hash": hashes})

    linked = rows.groupBy("file_no", "part").applyInPandasWithState(
        extend, schema, "names array<string>, ends array<string>", "append", GroupStateTimeout.NoTimeout)
    own = F.from_json("name", T.StructType([entries.schema[c] for c in chain]), exact)
    return linked.withColumn("own", own).select(*[F.col(f"own.`{c}`") for c in chain], "file_no", "seq", "prev", "hash")


def sealed_log_stream(entries: DataFrame, chain: list[str], order: str, fields: list[str], folder: str, checkpoint: str,
                      rows_per_file: int = 4096) -> StreamingQuery:
    """A sealed audit log as a stream (see the batch operators): lines, seals and the last seal of every chain are
    published together per micro-batch in the ledger at ``folder``.

    A micro-batch writes files of its own, one per chain and range of ``order``; chains are not null, and ``order`` is
    unique within a chain and micro-batch.  Files are closed with their batch, so the only state is the last seal of each chain, and a
    batch that runs again overwrites what it had staged.  A chain with most rows is as many files as it has ranges.
    ``folder`` and ``checkpoint`` belong together: neither is used with another.
    """
    ledger = Ledger(entries.sparkSession, folder)
    types = dict(entries.dtypes)
    ends = ", ".join([*[f"`{c}` {types[c]}" for c in chain], "seals bigint", "head string"])

    def process(batch: DataFrame, number: int) -> None:
        if number <= ledger.last():  # published before the stream noted it
            return
        file_no = F.lit(number).cast("bigint") * 2 ** 32 + F.floor(F.col(order) / rows_per_file)
        lines = ledger.stage("audit", ops.link_files(batch.withColumn("file_no", file_no), chain, order, fields), number)
        before = ledger.snapshot("heads", ends)
        seals = ledger.stage("seals", ops.seal_audit_files(lines, chain, before), number)
        newer = ops.audit_heads(seals, chain).withColumnsRenamed({"seals": "_seals", "head": "_head"})
        ledger.stage("heads", before.join(newer, chain, "full").select(
            *chain, F.coalesce("_seals", "seals").alias("seals"), F.coalesce("_head", "head").alias("head")), number)
        ledger.publish(number, str(number))

    return entries.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def sealed_log(ledger: Ledger) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Published lines, seals and last seals of a ``sealed_log_stream``, as ``verify_audit_log`` takes them."""
    heads = ledger.table("heads")
    return ledger.table("audit").drop("batch"), ledger.table("seals").drop("batch"), heads.where(
        F.col("batch") == ledger.last()).drop("batch")


def admission_stream(hits: DataFrame, key: str, ts: str, limit: int, folder: str, checkpoint: str,
                     seconds: int = fixed.BURST_SECONDS) -> StreamingQuery:
    """Admission of a stream of hits (see the batch operator): decisions and the times that still count are published
    together per micro-batch in the ledger at ``folder``, so a batch that runs again continues from the same state.

    Hits are handled in their order of arrival: by micro-batch, then by time and id.
    """
    ledger = Ledger(hits.sparkSession, folder)

    def process(batch: DataFrame, number: int) -> None:
        if number <= ledger.last():  # published before the stream noted it
            return
        rows = admission.timed_hits(batch, key, ts)
        before = ledger.snapshot("recent", admission.STATE)
        found = ledger.stage("admissions", admission.admissions(rows, limit, seconds, before), number)
        ledger.stage("recent", found.where("recent is not null").select("key", "recent"), number)
        ledger.stage("decisions", admission.decisions(rows, found, limit), number)
        ledger.publish(number, str(number))

    return hits.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
