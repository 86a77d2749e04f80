"""Model and file-format back ends behind one interface.

An adapter turns a batch of input rows into output rows in Python workers; the engine only fixes the schema. Nothing
here needs a model: tests plug in a stub.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = "doc_id string, page int, ord int, text string, x int, y int, x_min int, y_min int, x_max int, y_max int, width int, height int, confidence double"
PAIRS = "doc_id string, page int, ord int, label string, value string, confidence double"
FIELDS = "doc_id string, field string, value string"
PAGES = "doc_id string, page int, text string"


def run_adapter(rows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """make() loads a back end once a task; it is then called batch by batch, so memory stays bounded."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for batch in batches:
            yield call(batch)

    return rows.mapInPandas(each, schema)
