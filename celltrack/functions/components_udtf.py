"""Connected components as a table function for SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from celltrack.operators.tracking import component_labels


@udtf(returnType="frame int, level int, label bigint, y int, x int")
class LabelComponents:
    """Labels of the cells ``(frame, level, y, x, x_dim, radius)`` of each partition: the smallest y * x_dim + x of a component.

        SELECT * FROM label_components(TABLE(cells) PARTITION BY frame, level)
    """

    def __init__(self):
        self.cells: list[tuple[int, int]] = []
        self.key = None

    def eval(self, row):
        if row["y"] is not None and row["x"] is not None:
            self.key = (row["frame"], row["level"], row["x_dim"], row["radius"])
            self.cells.append((row["y"], row["x"]))

    def terminate(self):
        if self.cells:
            frame, level, x_dim, radius = self.key
            at = np.array(self.cells)
            for (y, x), label in zip(self.cells, component_labels(at[:, 0], at[:, 1], radius, x_dim).tolist()):
                yield frame, level, label, y, x


def register(spark: SparkSession, name: str = "label_components") -> None:
    spark.udtf.register(name, LabelComponents)
