"""A query kept up to date over batches of new events.

Each view of a plan is a Parquet table with a partition for each batch.  A
batch adds the partial matches whose last variable is among its rows; nothing
stored is read again but what those rows can join with.  A view that does not
fire with a batch takes it in when it fires next, and is completed for an answer
that is asked for before.  The answer is composed
from the tables when the schedule asks for it.  A partition is written under
its batch's number with overwrite, so a batch that is tried again leaves the
same state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compose, kleene, nearest
from ..operators.scan import first_key, order_columns
from ..pattern.graph import Graph, View
from ..pattern.model import PLUS, PatternQuery
from ..plans.covers import Plan
from ..plans.storage import file_bytes
from .schedule import Firing


class OrderError(ValueError):
    """A batch has rows that are not later than all before them."""


@dataclass
class Incremental:
    spark: SparkSession
    query: PatternQuery
    plan: Plan
    path: str  # a folder that driver and executors share
    firing: Firing = field(default_factory=Firing)
    late: str = "refuse"  # or "allow"

    @property
    def graph(self) -> Graph:
        return Graph(self.query)

    def _where(self, name: str, batch: int | None = None) -> str:
        return f"{self.path}/{name}" + (f"/batch_id={batch}" if batch is not None else "")

    def batches(self, name: str = "events") -> list[int]:
        """The batches a table holds, from its folder."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self._where(name))
        fs = at.getFileSystem(conf)
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self._where(name)}/batch_id=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def read(self, name: str, upto: int | None = None) -> DataFrame | None:
        held = [b for b in self.batches(name) if upto is None or b <= upto]
        if not held:
            return None
        return self.spark.read.option("basePath", self._where(name)).parquet(*[self._where(name, b) for b in held])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Store a batch and add to each view; the body of ``foreachBatch``."""
        q, ts = self.query, self.query.ts_column
        before = self.read("events", batch_id - 1)
        if before is not None and self.late == "refuse":
            newest, oldest = before.agg(F.max(ts)).first()[0], batch.agg(F.min(ts)).first()[0]
            if oldest is not None and newest is not None and oldest <= newest:
                raise OrderError(f"batch {batch_id} begins at {oldest}, not after {newest}")
        batch.write.mode("overwrite").parquet(self._where("events", batch_id))
        for view in self.plan.updates():
            if self.fires(view, batch_id):
                # Sources come first in the order of updates, so a view's delta sees theirs.
                self.update(view, batch_id).write.mode("overwrite").parquet(self._where(self.graph.label(view), batch_id))

        for variable in self.query.kleene:
            if self.fires(frozenset([variable]), batch_id):
                self.stitch(variable, batch_id)

    def initialise(self, events: DataFrame, mode: str = "backfill") -> int:
        """Begin with a history: ``backfill`` takes it in as batch 1, views and runs too, whatever fires; ``events`` stores it alone, for views to take in later.

        Returns the number of the next batch.
        """
        if mode not in ("backfill", "events"):
            raise ValueError("a history is taken in by backfill or as events")
        if self.batches():
            raise ValueError("there are batches already")
        given, self.firing = self.firing, Firing("always" if mode == "backfill" else "never")
        try:
            self.process(events, 1)
        finally:
            self.firing = given
        return 2

    def done(self, view: View, upto: int) -> int:
        """The last batch before ``upto`` that the stored view has taken in; 0 if none."""
        return max((b for b in self.batches(self.graph.label(view)) if b < upto), default=0)

    def unfinished(self, variable: str, done: int, batch_id: int) -> DataFrame:
        """The rows of the run that was open after one batch, and all events since up to another: what later rows can still change."""
        fresh = self.since(done, batch_id) if done < batch_id else None
        if not done:
            return fresh
        left = self.spark.read.parquet(self._where(f"{variable}__open", done))
        return left if fresh is None else left.unionByName(fresh.select(*left.columns))

    def stitch(self, variable: str, batch_id: int) -> None:
        """Store the runs that ended, and the rows of the one that is open (of each partition), which the next batch may go on with."""
        q = self.query
        rows = self.unfinished(variable, self.done(frozenset([variable]), batch_id), batch_id)
        plus = q.variable(variable).quantifier == PLUS
        open_ = kleene.run_ends(rows, q, variable).where("__open").select(*rows.columns) if plus else rows.limit(0)
        open_.write.mode("overwrite").parquet(self._where(f"{variable}__open", batch_id))
        ended = kleene.runs(rows, q, variable, kleene.needs_every_end(q, variable), ended=plus)
        ended.write.mode("overwrite").parquet(self._where(variable, batch_id))

    def runs(self, variable: str, batch_id: int) -> DataFrame:
        """A variable's runs as of a batch: those stored, and those of the rows that are not settled."""
        q = self.query
        done = self.done(frozenset([variable]), batch_id + 1)
        if self.late == "allow":  # rows may come into a run that has ended
            return compose.source(self.read("events", batch_id), q, variable)
        rest = compose.source(self.unfinished(variable, done, batch_id), q, variable)
        return self.read(variable, batch_id).select(variable).unionByName(rest) if done else rest

    def fires(self, view: View, batch_id: int) -> bool:
        """Whether the view is updated with this batch; sizes are those of the view that the firing names, else of the events it has not taken in."""
        rows = 0
        if self.firing.kind == "when_size_exceeds":
            if self.firing.view is not None:
                table = self.read("_".join(self.graph.ordered(self.firing.view)), batch_id)
            else:
                table = self.since(self.done(view, batch_id), batch_id)
            rows = 0 if table is None else table.count()
        return self.firing.fires(batch_id, rows)

    def since(self, batch: int, upto: int) -> DataFrame:
        """The events of the batches after one, up to another."""
        held = [b for b in self.batches() if batch < b <= upto]
        return self.spark.read.option("basePath", self._where("events")).parquet(*[self._where("events", b) for b in held]).drop("batch_id")

    def update(self, view: View, batch_id: int) -> DataFrame:
        """What a view lacks up to a batch: the partial matches of all batches since the last that it has taken in."""
        done = self.done(view, batch_id)
        fresh, before = self.since(done, batch_id), self.read("events", done) if done else None
        if before is not None and self.late == "allow":
            ts = self.query.ts_column
            newest, oldest = before.agg(F.max(ts)).first()[0], fresh.agg(F.min(ts)).first()[0]
            if oldest is not None and newest is not None and oldest <= newest:
                return self.late_delta(view, before, fresh)
        return self.delta(view, fresh, batch_id)

    def state(self, view: View, batch_id: int) -> DataFrame:
        """A view as of a batch: what is stored, and what it has not taken in yet."""
        label, names = self.graph.label(view), self.graph.ordered(view)
        stored = self.read(label, batch_id)
        if stored is not None and batch_id in self.batches(label):
            return stored.select(*names)
        rest = self.update(view, batch_id).select(*names)
        return rest if stored is None else stored.select(*names).unionByName(rest)

    def delta(self, view: View, fresh: DataFrame, batch_id: int) -> DataFrame:
        """Partial matches whose last variable is new; the others may be of any batch up to this one."""
        q = self.query
        last = frozenset([self.graph.ordered(view)[-1]])
        history = self.recent(self.read("events", batch_id), fresh)
        frames = {}
        for s in self.plan.sources[view]:
            if s == last:
                frames[s] = compose.source(fresh, q, next(iter(s)))
            elif len(s) > 1:
                frames[s] = self.bounded(self.state(s, batch_id), s, view, fresh)
            else:
                frames[s] = compose.source(history, q, next(iter(s)))
        return compose.build(compose.default_tree(q, list(frames)), frames, q).select(*self.graph.ordered(view))

    def bounded(self, table: DataFrame, source: View, view: View, fresh: DataFrame) -> DataFrame:
        """Without rows that the implied windows put out of the new rows' reach."""
        q = self.query
        first, last = self.graph.ordered(source)[0], self.graph.ordered(view)[-1]
        window = self.graph.windows().get((first, last))
        oldest = fresh.agg(F.min(q.ts_column)).first()[0] if window is not None else None
        if oldest is None or not hasattr(oldest, "year"):
            return table
        return table.where(F.col(f"{first_key(q, first)}.{q.ts_column}") >= F.lit(oldest) - F.expr(f"INTERVAL '{window / 1e6:.6f}' SECOND"))

    def recent(self, events: DataFrame, fresh: DataFrame) -> DataFrame:
        """Events that new rows can still meet, where windows bound every pair of variables."""
        q, windows = self.query, self.graph.windows()
        n = len(q.names)
        if n < 2 or len(windows) < n * (n - 1) // 2 or q.kleene:
            return events
        oldest = fresh.agg(F.min(q.ts_column)).first()[0]
        if oldest is None or not hasattr(oldest, "year"):
            return events
        return events.where(F.col(q.ts_column) >= F.lit(oldest) - F.expr(f"INTERVAL '{max(windows.values()) / 1e6:.6f}' SECOND"))

    def late_delta(self, view: View, old: DataFrame, fresh: DataFrame) -> DataFrame:
        """Partial matches with any new row, each once: old rows before the first new variable, any rows after it."""
        q, names = self.query, self.graph.ordered(view)
        old = old.select(*fresh.columns)
        both = old.unionByName(fresh)
        out = None
        for k, _ in enumerate(names):
            frames = {frozenset([v]): compose.source(old if i < k else fresh if i == k else both, q, v) for i, v in enumerate(names)}
            part = compose.build(compose.default_tree(q, list(frames)), frames, q).select(*names)
            out = part if out is None else out.unionByName(part)
        return out

    def answer(self, batch_id: int | None = None) -> DataFrame:
        """The query's answer as of a batch; views that have not taken in all its events are completed for it."""
        q = self.query
        events = self.read("events", batch_id)
        held = self.batches()
        batch = max(b for b in held if batch_id is None or b <= batch_id)
        frames = {}
        for v in compose_nodes(q, self.plan):
            name = next(iter(v))
            frames[v] = self.state(v, batch) if v in self.plan.cover else self.runs(name, batch) if q.variable(name).kleene else compose.source(events, q, name)
        alone = {name for v in frames if len(v) == 1 for name in v}
        return compose.answer(q, frames, None if nearest.free_variables(q, alone) else self.plan.tree)

    def state_rows(self, batch_id: int | None = None) -> dict[str, int]:
        return {self.graph.label(v): (t.count() if (t := self.read(self.graph.label(v), batch_id)) is not None else 0) for v in self.plan.cover}

    def state_bytes(self) -> dict[str, int]:
        """Bytes of the files of each table that is kept: views, runs and the rows of open runs."""
        names = [*map(self.graph.label, self.plan.cover), *(n for v in self.query.kleene for n in (v, f"{v}__open"))]
        return {n: file_bytes(self.spark, self._where(n)) for n in names}

    def watermark(self, batch_id: int | None = None):
        """The newest time stored."""
        events = self.read("events", batch_id)
        return None if events is None else events.agg(F.max(order_columns(self.query)[0])).first()[0]

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run over a streaming DataFrame; the stream's batches count from 0."""
        return stream.writeStream.foreachBatch(lambda df, k: self.process(df, k + 1)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compose_nodes(q: PatternQuery, plan: Plan) -> list[View]:
    have = set().union(*plan.cover) if plan.cover else set()
    return [*plan.cover, *(frozenset([v]) for v in q.names if v not in have)]


def result_counts(answer: DataFrame, batch: int, keys: list[str]) -> DataFrame:
    """(batch_id, keys, c): how often each result key occurs in the answer as of a batch."""
    return answer.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).select(F.lit(batch).alias("batch_id"), *keys, "c")


def compared(baseline: DataFrame, result: DataFrame, keys: list[str]) -> DataFrame:
    """All result keys of two tables of counts, with both counts (0 where one lacks the key)."""
    by = ["batch_id", *keys]
    a, b = baseline.select(*by, F.col("c").alias("expected")), result.select(*by, F.col("c").alias("found"))
    both = a.withColumn("found", F.lit(0).cast("long")).unionByName(b.withColumn("expected", F.lit(0).cast("long")))
    return both.groupBy(*by).agg(F.sum("expected").alias("expected"), F.sum("found").alias("found"))


def identity_gate(baseline: DataFrame, result: DataFrame, keys: list[str]) -> DataFrame:
    """Result keys whose counts differ between two tables of counts, with both (0 where one lacks the key)."""
    return compared(baseline, result, keys).where("expected <> found")


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    names = a.columns
    return a.exceptAll(b.select(*names)).withColumn("side", F.lit("left")).unionByName(b.select(*names).exceptAll(a).withColumn("side", F.lit("right")))
