"""Providers and scans as table functions of SQL (UDF3).

``register_provider(spark, name, model)`` makes a provider of rows callable:

    SELECT * FROM name(TABLE(SELECT stimulus_id, sr, samples FROM clips))
    SELECT c.stimulus_id, r.* FROM clips c, LATERAL name(c.sr, c.samples) r

It is polymorphic: given a table, the result has all its columns but the samples,
then those of the provider, whose schema and name clashes are settled when the
query is analysed. Clips are independent, so rows stay where they are; a clip is
one call. Null samples give no rows. (Spark plans LEFT JOIN LATERAL over a Python
table function like an inner one: join the result back where clips without rows
matter.)

``register_gaps(spark, name)`` is a scan over a partitioned table:

    SELECT * FROM name(TABLE(SELECT stimulus_id, onset, `offset` FROM words) PARTITION BY stimulus_id ORDER BY (onset, `offset`))

gives (stimulus_id, onset, gap), the gap being from the offset before to the onset,
null at the first word. It takes Arrow batches as they come and holds one offset,
so memory does not grow with a stimulus; a stimulus that is too long for one task
is for ``operators.ordered.gaps`` with a ``width``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

SAMPLES, RATE = "samples", "sr"


#: Bytes of an Arrow batch on its way to a table function, which turns all samples of a batch into Python numbers at once.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes in this session, unless its own bound is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def register_provider(spark: SparkSession, name: str, model) -> None:
    """``model`` (a provider of rows) as the table function ``name``; Arrow batches of the session are bounded to ``BATCH_BYTES``."""
    from pyspark.sql.functions import AnalyzeResult, udtf

    small_batches(spark)
    own: StructType = _parse_datatype_string(model.schema)
    found = [f.name for f in own.fields]

    class Rows:
        def __init__(self):
            self._model = None

        @staticmethod
        def analyze(*args) -> AnalyzeResult:
            if len(args) == 2 and not args[0].isTable:
                return AnalyzeResult(schema=own)
            if len(args) != 1 or not args[0].isTable:
                raise ValueError("give one table with columns sr and samples, or a rate and samples")
            given = args[0].dataType.fields
            names = [f.name for f in given]
            if missing := [c for c in (RATE, SAMPLES) if c not in names]:
                raise ValueError(f"the table has no column {', '.join(missing)}")
            if clash := [c for c in names if c in found and c != SAMPLES]:
                raise ValueError(f"the provider's own columns are in the table already: {', '.join(clash)}")
            return AnalyzeResult(schema=StructType([*(f for f in given if f.name != SAMPLES), *own.fields]))

        def eval(self, *args):
            if len(args) == 2:
                sr, samples, kept = *args, ()
            else:
                row = args[0].asDict()
                sr, samples = row[RATE], row[SAMPLES]
                kept = tuple(v for c, v in row.items() if c != SAMPLES)
            if samples is None:
                return
            if self._model is None:
                model.load()
                self._model = model
            for r in self._model.clip(np.asarray(samples, dtype=np.float32), sr):
                yield (*kept, *(r.get(c) for c in found))

    spark.udtf.register(name, udtf(Rows, useArrow=True))


def register_gaps(spark: SparkSession, name: str, key: str = "string", order: str | None = None) -> None:
    """The scan over words as the table function ``name``; ``key`` is the type of ``stimulus_id``, ``order`` a bigint column to return beside it."""
    from pyspark.sql.functions import arrow_udtf
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(_parse_datatype_string(key))

    class Gaps:
        def __init__(self):
            self._end = None

        def eval(self, words: pa.RecordBatch) -> Iterator[pa.Table]:
            if not words.num_rows:
                return
            onset = words.column("onset").cast(pa.float64())
            ends = words.column("offset").cast(pa.float64())
            before = pa.concat_arrays([pa.array([self._end], pa.float64()), ends.slice(0, words.num_rows - 1)])
            self._end = ends[-1].as_py()
            gap = pc.subtract(onset, before)
            place = {order: words.column(order).cast(pa.int64())} if order else {}
            yield pa.table({"stimulus_id": words.column("stimulus_id").cast(kind), **place, "onset": onset, "gap": gap})

    spark.udtf.register(name, arrow_udtf(Gaps, returnType=f"stimulus_id {key}, " + (f"{order} bigint, " if order else "") + "onset double, gap double"))
