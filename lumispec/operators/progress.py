"""Build progress as an event table: throttling, reduction to a status, stage durations.

Events: run_id, seq, ts (timestamp), stage (start, genome, indexStart, metaStart, finalizeStart, done), genomes, peaks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def throttle(events: DataFrame, interval_us: int) -> DataFrame:
    """Events that are emitted: of the genome events of a run, the first and each that comes interval_us or more after the last one emitted; all
    others. A run's events stream by in order, so that a task holds one time stamp, however long the run."""
    rest = events.where("not (stage <=> 'genome')")
    genome = events.where("stage = 'genome'")
    if interval_us <= 0:
        return events
    held = genome.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).repartition("run_id").sortWithinPartitions("run_id", "_us", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_id, last = object(), 0
        for batch in batches:
            us, ids = batch["_us"].to_numpy(), batch["run_id"].to_numpy()
            keep = np.zeros(len(us), bool)
            for i in range(len(us)):
                if ids[i] != run_id or us[i] - last >= interval_us:
                    run_id, last, keep[i] = ids[i], us[i], True
            yield batch[keep]

    out = held.mapInPandas(run, held.schema)
    return rest.unionByName(out.drop("_us"))


def reduce_status(events: DataFrame) -> DataFrame:
    """The status after each event: its stage, and the counters as last set; start sets them to 0, genome and done to their own."""
    sets = F.col("stage").isin("start", "genome", "done")
    before = Window.partitionBy("run_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)

    def carried(name: str):
        value = F.when(F.col("stage") == "start", F.lit(0).cast("long")).when(sets, F.col(name))
        return F.coalesce(F.last(value, ignorenulls=True).over(before), F.lit(0)).cast("long").alias(f"{name}_processed")

    return events.select("run_id", "seq", "stage", carried("genomes"), carried("peaks"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Microseconds of each run: decode (start to index), index (index to meta) and total (start to done), by each stage's first event."""
    at = lambda stage: F.min(F.when(F.col("stage") == stage, F.unix_micros(F.col("ts").cast("timestamp"))))
    firsts = events.groupBy("run_id").agg(*(at(s).alias(s) for s in ("start", "indexStart", "metaStart", "done")))
    return firsts.select("run_id", (F.col("indexStart") - F.col("start")).alias("decode_us"), (F.col("metaStart") - F.col("indexStart")).alias("index_us"), (F.col("done") - F.col("start")).alias("total_us"))


def throttle_stream(events: DataFrame, interval_us: int) -> DataFrame:
    """throttle() over a stream: the state of a run is the time of its last genome event emitted. Events of a run count in the order in which they
    come; within a batch, in order of time."""
    if interval_us <= 0:
        return events
    held = events.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for batch in batches:
            batch = batch.sort_values(["_us", "seq"])
            keep = np.ones(len(batch), bool)
            for i, (us, stage) in enumerate(zip(batch["_us"], batch["stage"], strict=True)):
                if stage == "genome":
                    keep[i] = last is None or us - last >= interval_us
                    last = us if keep[i] else last
            yield batch[keep].drop(columns="_us")
        if last is not None:
            state.update((int(last),))

    return held.groupBy("run_id").applyInPandasWithState(run, events.schema, "last long", "append", "NoTimeout")


_STATE = "last long, genomes long, peaks long, us array<long>, seq array<long>, stage array<string>, own_genomes array<long>, own_peaks array<long>"


def _in_order(events: DataFrame, delay: str, schema: str, step: Callable[[list, list[tuple]], Iterator[tuple]]) -> DataFrame:
    """Folds the events of each run in order of (ts, seq), in whatever order and batches they come: they wait in the run's state until the watermark,
    the newest time less delay, has passed them. Rows later than that can't be placed any more and are left out; the events of the last delay come
    out once newer ones arrive. step(memory, events) changes memory, [last, genomes, peaks], and gives rows of the schema."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("_us", F.unix_micros("ts"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, genomes, peaks, *waiting = state.get if state.exists else (None, 0, 0, [], [], [], [], [])
        rows = list(zip(*waiting, strict=True))
        if not state.hasTimedOut:
            for batch in batches:
                rows += zip(*(batch[c].tolist() for c in ("_us", "seq", "stage", "genomes", "peaks")), strict=True)
        mark = state.getCurrentWatermarkMs()
        rows.sort(key=lambda r: r[:2])
        ready = sum(r[0] <= mark * 1000 for r in rows)
        memory = [last, genomes, peaks]
        out = [(key[0], *row) for row in step(memory, rows[:ready])]
        rest = [list(x) for x in zip(*rows[ready:], strict=True)] or [[], [], [], [], []]
        state.update((*memory, *rest))
        if ready < len(rows):
            state.setTimeoutTimestamp(max(rows[ready][0] // 1000 + 1, mark + 1))
        yield pd.DataFrame(out, columns=names)

    return held.groupBy("run_id").applyInPandasWithState(run, schema, _STATE, "append", "EventTimeTimeout")


def throttle_late_stream(events: DataFrame, interval_us: int, delay: str) -> DataFrame:
    """(run_id, seq, stage) of what throttle() emits, over a stream whose events come shuffled within delay."""

    def step(memory: list, rows: list[tuple]) -> Iterator[tuple]:
        for us, seq, stage, *_ in rows:
            if stage == "genome":
                if memory[0] is not None and us - memory[0] < interval_us:
                    continue
                memory[0] = us
            yield seq, stage

    return _in_order(events, delay, "run_id long, seq long, stage string", step)


def reduce_stream(events: DataFrame, delay: str) -> DataFrame:
    """reduce_status() over a stream whose events come shuffled within delay."""

    def step(memory: list, rows: list[tuple]) -> Iterator[tuple]:
        for _, seq, stage, genomes, peaks in rows:
            if stage in ("start", "genome", "done"):
                memory[1:] = [0, 0] if stage == "start" else [memory[1] if genomes is None else genomes, memory[2] if peaks is None else peaks]
            yield seq, stage, *memory[1:]

    return _in_order(events, delay, "run_id long, seq long, stage string, genomes_processed long, peaks_processed long", step)
