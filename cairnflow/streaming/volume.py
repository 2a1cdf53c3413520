"""Problem volume per period over an event-time stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from cairnflow.functions.numbers import period_start
from cairnflow.schemas import GRANULARITIES
from cairnflow.sources.scopes import one_of


def problem_volume(problems: DataFrame, granularity: str, timestamp: str = "ts", lateness: str = "7 days") -> DataFrame:
    """``(period_start, problem_count)`` with rows later than ``lateness`` dropped by the watermark (``LateRows`` counts them).

    Days and Monday weeks are tumbling windows, whose state is evicted once the watermark passes. Months have no fixed length,
    so their rows are counted by day, evicted the same way, and ``monthly`` adds the days up where the counts are read.
    """
    one_of(granularity, GRANULARITIES, "granularity")
    marked = problems.withWatermark(timestamp, lateness)
    # The epoch was a Thursday: weeks shifted by four days start on Monday.
    window = {
        "day": F.window(timestamp, "1 day"),
        "month": F.window(timestamp, "1 day"),
        "week": F.window(timestamp, "7 days", "7 days", "4 days"),
    }[granularity]
    return (
        marked.groupBy(window.alias("period"))
        .agg(F.count("*").alias("problem_count"))
        .select(F.col("period.start").alias("period_start"), "problem_count")
    )


def monthly(counts: DataFrame) -> DataFrame:
    """Daily counts as a stream has written them, added up by month."""
    return counts.groupBy(period_start(F.col("period_start"), "month").alias("period_start")).agg(F.sum("problem_count").alias("problem_count"))


class LateRows(StreamingQueryListener):
    """Counts the rows that came after the watermark had passed them, over all batches it listens to.

    Register it with ``spark.streams.addListener`` before the query starts; events arrive after their batch.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event):
        self.dropped[str(event.id)] = 0

    def onQueryProgress(self, event):
        late = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.id))
