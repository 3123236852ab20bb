"""The best ``k`` of many slots at once: higher scores first, equal scores by smaller number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: No entry: below every score, behind every number.  A null number is written as the largest, so it comes last.
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Tasks whose bests meet in a first step, so that no slot's last step reads a row of every task.
MET = 64


class Best:
    """Scores and numbers, best first in each row; memory is slots times k whatever is offered."""

    def __init__(self, slots: int, k: int):
        self.score, self.number = np.full((slots, k), NONE), np.full((slots, k), LAST)

    @property
    def floor(self) -> np.ndarray:
        """What a score must reach to enter, by slot; with the same score a smaller number enters."""
        return self.score[:, -1]

    def offer(self, slot: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        last = self.score[slot, -1]
        good = np.flatnonzero((score > last) | ((score == last) & (number < self.number[slot, -1])))
        if not len(good):
            return
        slot, score, number = slot[good], score[good], number[good]
        touched, k = np.unique(slot), self.score.shape[1]
        slot = np.concatenate([np.repeat(touched, k), slot])
        score = np.concatenate([self.score[touched].ravel(), score])
        number = np.concatenate([self.number[touched].ravel(), number])
        order = np.lexsort((number, ~score, slot))  # ~ turns the order round and never overflows
        first = np.searchsorted(slot[order], touched)
        chosen = order[first[:, None] + np.arange(k)]
        self.score[touched], self.number[touched] = score[chosen], number[chosen]

    def found(self, part: int) -> pa.RecordBatch:
        """All entries: part (the task), slot, number, score."""
        slot, place = np.nonzero(self.score != NONE)
        number = self.number[slot, place]
        columns = [pa.array(np.full(len(slot), part // MET, np.int64)), pa.array(slot, pa.int64()), pa.array(number, pa.int64(), mask=number == LAST), pa.array(self.score[slot, place])]
        return pa.record_batch(columns, names=["part", "slot", "number", "score"])


FOUND = "part long, slot long, number long, score long"


def best_of_all(found: DataFrame, k: int) -> DataFrame:
    """slot, rank from 1, number, score: the best of what all tasks have found, in two steps."""
    order = (F.desc("score"), F.asc_nulls_last("number"))
    met = found.withColumn("rank", F.row_number().over(Window.partitionBy("slot", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("slot", "rank", "number", "score")
