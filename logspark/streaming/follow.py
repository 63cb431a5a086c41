"""Follow a growing folder of log files.

Projection, filters and membership in finite relations work row by row, so a program whose only query reads one file
source without grouping, sorting or limiting runs unchanged over each new batch of lines. Anything that waits for the
end of its input is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..bind import relations as r
from ..engine import Engine
from ..errors import BindError
from ..plans import Lowering
from ..sources import formats


def _stateless(rel: r.Relation) -> r.File:
    """The one file below; an error for whatever needs all of its input."""
    if isinstance(rel, r.File):
        return rel
    if isinstance(rel, r.Select):
        if rel.keys is not None or rel.aggregated or rel.order or rel.limit is not None:
            raise BindError("only SELECT and WHERE can follow a stream", rel.span)
        return _stateless(rel.source)
    if isinstance(rel, (r.Alias, r.Materialize)):
        return _stateless(rel.source)
    raise BindError(f"{rel.title()} can't follow a stream", rel.span)


def follow(engine: Engine, program: str, folder: str, format_name: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run the program's only query over each batch of new files in ``folder``; its own path is a placeholder.

    ``sink(frame, batch_id)`` gets each batch; with the checkpoint, a restarted query repeats at most its last batch
    under the same id. ``once``: stop after what is there now.
    """
    fmt = next((f for f in formats.ALL if f.name == format_name), None)
    if fmt is None:
        raise ValueError(f"unknown format {format_name}")
    results = engine.results(program)
    if len(results) != 1:
        raise BindError(f"expected one query, got {len(results)}")
    rel = results[0].relation
    source = _stateless(rel)

    class Batch(Lowering):
        def __init__(self, lines: DataFrame):
            super().__init__(lines.sparkSession, engine.options)
            self.lines = lines

        def _file(self, own: r.File, needs) -> DataFrame:
            if own is not source:
                return super()._file(own, needs)
            return self._parsed(self.lines, fmt, sorted(f.name for f in needs))

    lines = engine.spark.readStream.option("lineSep", "\n").text(folder)
    writer = lines.writeStream.foreachBatch(lambda df, n: sink(Batch(df).query(rel), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
