"""The nearest row of one variable before or after each row of a frame, without joining pairs.

Both sides meet in one window over the time order.  Buckets of the order are
tasks of their own; what a bucket cannot see itself comes as one carried row
from its neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..pattern.model import GREEDY, PLUS, PatternQuery
from .numbering import PER_BUCKET
from .ranges import range_of, splitters
from .scan import first_key, last_key, order_columns, scan


def attach(frame: DataFrame, q: PatternQuery, variable: str, rows: DataFrame, other: str | None, per_bucket: int = PER_BUCKET, greedy: bool | None = None, cuts: list[tuple] | None = None) -> DataFrame:
    """Adds ``variable`` to each row of ``frame``: of ``rows``, the first after ``other`` ends or, where its gap is greedy, the last before ``other`` begins.

    With no ``other`` (greedy, nothing behind it) it is the last of all.  Frame
    rows without such a row go.  ``rows`` holds one struct column, a row or a run.
    ``greedy`` and ``cuts`` stand for the gap's kind and the buckets' bounds where the caller has them.
    """
    greedy = q.gaps[q.positions[variable] - 1] == GREEDY if greedy is None else greedy
    cols, keys = order_columns(q), list(q.partition_by)
    first = first_key(q, variable)
    full = [q.ts_column, q.id_column]  # ties in time are decided by the id
    names = [f"__k{i}" for i in range(len(keys))]
    own = rows.select(*[F.col(f"{first}.{k}").alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"{first}.{c}").alias(f"__t{i}") for i, c in enumerate(full)], F.col(variable).alias("__v"))
    for k in names:  # a null is no one's partition
        own = own.where(F.col(k).isNotNull())
    held = frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("__f"))
    anchor = first_key(q, q.names[0])
    if other is None:
        place = F.struct("__t0", "__t1")
        last = own.groupBy(*names).agg(F.max_by("__v", place).alias("__v"))
        met = held.crossJoin(F.broadcast(last)) if not names else held.join(last, [F.col(f"__f.{anchor}.{k}") == F.col(f"__k{i}") for i, k in enumerate(keys)])
        return met.select("__f.*", F.col("__v").alias(variable)).where(f"`{variable}` is not null")
    edge = f"__f.{first_key(q, other) if greedy else last_key(q, other)}"
    # Where only time counts, equal times stay in one bucket, so that a frame row meets exactly those it may not take.
    time_only = len(cols) == 1
    by = ["__t0"] if time_only else ["__t0", "__t1"]
    cuts = splitters(own, by, per_bucket) if cuts is None else cuts
    spot = held.select(*[F.col(f"__f.{anchor}.{k}").alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"{edge}.{c}").alias(f"__t{i}") for i, c in enumerate(full)], F.col("__f"))
    bucket = range_of(cuts, [F.col(c) for c in by])
    spot = spot.withColumns({"__kind": F.lit(0), "__b": bucket, "__v": F.lit(None).cast(own.schema["__v"].dataType)})
    both = spot.unionByName(own.withColumns({"__kind": F.lit(1), "__b": bucket, "__f": F.lit(None).cast(held.schema["__f"].dataType)}))
    way = (lambda c: F.col(c).asc()) if greedy else (lambda c: F.col(c).desc())
    order = [way("__t0"), F.col("__kind").asc(), way("__t1")] if time_only else [way("__t0"), way("__t1"), F.col("__kind").asc()]
    seen = Window.partitionBy(*names, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("__near", F.last("__v", ignorenulls=True).over(seen)).where("__kind = 0")
    if cuts:
        pick = F.max_by if greedy else F.min_by
        ends = own.withColumn("__b", bucket).groupBy(*names, "__b").agg(pick("__v", F.struct("__t0", "__t1")).alias("v"))
        ends = ends.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("__b", "v"))).alias("__ends"))  # a row for each bucket
        near = near.join(ends, names, "left") if names else near.crossJoin(F.broadcast(ends))
        carried = F.try_element_at(F.filter("__ends", lambda e: e["__b"] < F.col("__b")), F.lit(-1)) if greedy else F.try_element_at(F.filter("__ends", lambda e: e["__b"] > F.col("__b")), F.lit(1))
        near = near.withColumn("__near", F.coalesce("__near", carried["v"]))
    return near.where("__near is not null").select("__f.*", F.col("__near").alias(variable))


def cut_runs(q: PatternQuery) -> list[str]:
    """Runs tied by order alone that a later variable may cut short: each pair of the rows around one has one best run."""
    from .kleene import needs_every_end

    near = {v for v, _ in free_variables(q, set(q.names))}
    out: list[str] = []
    for a, v, b in zip(q.names, q.names[1:], q.names[2:], strict=False):
        tied = any(v in p.variables for p in q.dependent)
        if q.variable(v).quantifier == PLUS and not tied and needs_every_end(q, v) and not {a, b} & near and a not in out:
            out.append(v)
    return out


def attach_cut(frame: DataFrame, q: PatternQuery, variable: str, events: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds the run of ``variable`` to each row of ``frame`` that has the variables around it, without making its shorter ends.

    Behind a reluctant gap the run begins with the first row after the variable
    before and goes on to the last row before the next one, if that is of the
    same run, else to its own end.  Behind a greedy gap it is the last row
    before the next one alone.
    """
    from .kleene import runs

    at, rows = q.positions[variable], runs(events, q, variable, per_bucket=per_bucket)
    a, b, v = q.names[at - 1], q.names[at + 1], variable
    place = [F.col(f"{v}.{c}").alias(f"__t{i}") for i, c in enumerate((q.ts_column, q.id_column))]
    cuts = splitters(scan(events, q, v).select(*place), ["__t0", "__t1"][: len(order_columns(q))], per_bucket)  # each row of the variable begins a run
    last = attach(frame, q, v, rows, b, per_bucket, True, cuts)
    if q.gaps[at - 1] == GREEDY:
        return last.withColumn(v, F.struct(F.col(f"{v}.first").alias("first"), F.col(f"{v}.first").alias("last"), F.lit(1).cast("long").alias("count")))
    out = attach(last.withColumnRenamed(v, "__w"), q, v, rows, a, per_bucket, False, cuts)
    same = reduce(lambda x, y: x & y, [F.col(f"{v}.last.{c}") == F.col(f"__w.last.{c}") for c in (q.ts_column, q.id_column)])
    end, count = F.when(same, F.col("__w.first")).otherwise(F.col(f"{v}.last")), F.when(same, F.col(f"{v}.count") - F.col("__w.count") + 1).otherwise(F.col(f"{v}.count"))
    return out.withColumn(v, F.struct(F.col(f"{v}.first").alias("first"), end.alias("last"), count.alias("count"))).drop("__w").where(f"`{v}`.count > 0")


def takes(q: PatternQuery, variable: str) -> bool:
    """Whether the variable is tied to others by its order alone, so that each prefix and suffix of a match has one best row for it."""
    from .kleene import needs_every_end

    at = q.positions[variable]
    if at == 0 or any(variable in p.variables for p in q.dependent):
        return False
    return not (q.variable(variable).kleene and needs_every_end(q, variable))


def free_variables(q: PatternQuery, singles: set[str]) -> list[tuple[str, str | None]]:
    """(variable, the neighbour it is measured from) in the order in which to attach them, of those that stand alone in a frame."""
    free = [v for v in q.names if v in singles and takes(q, v)]
    names = list(q.names)
    greedy = lambda v: q.gaps[names.index(v) - 1] == GREEDY
    # A greedy one measured from a reluctant one that is measured from it: the second is joined as usual.
    free = [v for k, v in enumerate(names) if v in free and not (not greedy(v) and names[k - 1] in free and greedy(names[k - 1]))]
    forward = [(v, names[names.index(v) - 1]) for v in names if v in free and not greedy(v)]
    backward = [(v, names[names.index(v) + 1] if names.index(v) + 1 < len(names) else None) for v in reversed(names) if v in free and greedy(v)]
    return [*forward, *backward]
