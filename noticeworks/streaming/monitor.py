"""The monitor over a stream of notice files: each micro-batch is one run against the notified state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeworks.operators import gate
from noticeworks.operators.notified import NotifiedState
from noticeworks.plans.monitor import BIDS, monitor
from noticeworks.rules import DEFAULT, RulePack

from .outbox import Outbox


Deliver = Callable[[DataFrame, int], bool]


def _start(rows: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    stream = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="1 minute")).start()


def deliver_waiting(spark: SparkSession, state_path: str, outbox_path: str, deliver: Deliver) -> list[int]:
    """Deliver the batches that wait, oldest first, and return the numbers of those that still wait.

    ``deliver`` gets a batch's rows, ranked, and its number. Where it returns true the rows enter the state and the batch
    is marked; otherwise both stay as they are. The state comes before the mark, so a batch whose run ends between its
    delivery and the mark is delivered again, under its number, and none is lost."""
    outbox, held = Outbox(spark, outbox_path), NotifiedState(spark, state_path)
    for number in outbox.waiting():
        rows = outbox.read(number)
        if rows.isEmpty():
            outbox.mark(number)
        elif deliver(gate.rank_notifications(rows), number):
            held.mark(rows, F.current_timestamp())
            outbox.mark(number)
    return outbox.waiting()


def _waiting_entries(outbox: Outbox, before: int) -> DataFrame | None:
    """The rows of earlier batches that wait, as entries: they are on their way."""
    found = None
    for number in outbox.waiting():
        if number < before:
            rows = outbox.read(number).select("primary_key", F.col("keys").alias("alias_keys"))
            found = rows if found is None else found.unionByName(rows)
    return found


def start_monitor(spark: SparkSession, source: str, state_path: str, outbox_path: str, checkpoint: str, deliver: Deliver, *, pack: RulePack = DEFAULT, files: int = 100, once: bool = True) -> StreamingQuery:
    """Watch a folder of Parquet notices.

    A micro-batch's new rows go to the outbox, and what waits there is delivered (``deliver_waiting``): at the start,
    which brings back what an earlier run could not deliver, and after each batch. Rows that wait are not new in later
    batches, and only what was delivered enters the state. If ``deliver`` raises, the query ends and the batch waits."""
    outbox, held = Outbox(spark, outbox_path), NotifiedState(spark, state_path)

    def known(rows: DataFrame, number: int) -> DataFrame:
        entries, waiting = held.lookup(rows), _waiting_entries(outbox, number)
        return entries if waiting is None else entries.unionByName(waiting, allowMissingColumns=True)

    def run(batch: DataFrame, number: int) -> None:
        if not outbox.is_sent(number):
            outbox.put(monitor(batch, lambda rows: known(rows, number), F.current_timestamp(), pack=pack).new, number)
        deliver_waiting(spark, state_path, outbox_path, deliver)

    deliver_waiting(spark, state_path, outbox_path, deliver)
    return _start(spark.readStream.schema(BIDS).option("maxFilesPerTrigger", files).parquet(source), run, checkpoint, once)


def start_gate(spark: SparkSession, source: str, out: str, checkpoint: str, *, schema: str = BIDS, pack: RulePack = DEFAULT, files: int = 100, once: bool = True) -> StreamingQuery:
    """Notices of a watched folder that pass the gate, appended to ``out``. Stateless, so it scales with its files."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream = gate.filter_notices(rows, pack).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="1 minute")).start()


def start_notified(spark: SparkSession, source: str, state_path: str, checkpoint: str, *, schema: str, files: int = 100, once: bool = True) -> StreamingQuery:
    """Keeps the state of a watched folder of keyed rows: each micro-batch resolves against the state before it, reads
    the buckets that its keys fall into, and writes what it changes. A batch that is repeated replaces what it wrote."""
    held = NotifiedState(spark, state_path)

    def run(batch: DataFrame, number: int) -> None:
        held.take(batch, F.current_timestamp(), turn=number + 1)

    return _start(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source), run, checkpoint, once)
