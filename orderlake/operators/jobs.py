"""Incremental jobs on snapshot tables: silver tables grow by what their sources got since the last run, gold tables are
merged with what the silver tables give now."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from orderlake.operators import merge
from orderlake.sources import snapshots
from orderlake.sources.snapshots import Table


@dataclass
class SilverJob:
    """Reads the commits of its sources that it hasn't read, and adds what they make new to its target. Data are written
    before the marks, and rows that are there already aren't new, so a run that was lost between the two is made good by the
    next one. The first run reads the earliest commit of each source. ``transform`` takes the frames by the sources' names.

    ``how``: ``"rows"`` for transforms that take each row alone: the new rows of each source. ``"join"`` for joins, which may
    drop duplicates but count nothing: the new rows of each source with all of the sources before it, and with what was read
    before of those after it, so partners meet in whatever commits they come, and a source that is silent is read whole.
    ``"recount"`` for transforms that sum up: keys (``touched``) of new rows are made anew from all rows of theirs, and
    replace the target's.

    As with a MERGE that only inserts, all rows of keys that the target doesn't have are taken, also several of one key."""

    name: str
    sources: dict[str, Table]
    target: Table
    marks: Table
    keys: list[str]
    transform: Callable[..., DataFrame]
    how: str = "rows"
    touched: tuple[str, ...] = ()

    def run(self, at: str) -> int | None:
        """The number of rows that the run added or changed, counted from the files' footers; None where the sources had nothing new."""
        known = {r["src"]: r["last_processed_snapshot_id"] for r in snapshots.marked(self.marks).where(F.col("app_name") == self.name).collect()}  # one for each source
        to = {name: snapshots.reach(table, known.get(name)) for name, table in self.sources.items()}
        reached = {name: n for name, n in to.items() if n is not None and n != known.get(name)}
        if not reached:
            return None
        new = {name: (t.as_of(to[name]) if known.get(name) is None else t.between(known[name], to[name])) if name in reached else t.rows([]) for name, t in self.sources.items()}
        state = lambda name, n: self.sources[name].as_of(n) if n else self.sources[name].rows([])
        whole = {name: state(name, to[name]) for name in self.sources}
        if self.how == "recount":
            number = self.recount(new, whole, at)
        else:
            if self.how == "rows":
                rows = self.transform(**new)
            else:
                before, parts = {name: state(name, known.get(name)) for name in self.sources}, []
                for k, name in enumerate(self.sources):
                    if name in reached:
                        parts.append(self.transform(**{other: new[other] if i == k else whole[other] if i < k else before[other] for i, other in enumerate(self.sources)}))
                rows = reduce(DataFrame.unionByName, parts).distinct()
            number = self.target.commit(merge.new_rows(self.target.read(), rows, self.keys, single=False), at, self.name)
        snapshots.mark(self.marks, self.name, reached, at)
        return self.target.between(number - 1, number).count()

    def recount(self, new: dict[str, DataFrame], whole: dict[str, DataFrame], at: str) -> int:
        keys = reduce(DataFrame.union, [df.select(*self.touched) for df in new.values()]).dropna().distinct()
        made = self.transform(**{name: df.join(keys, list(self.touched), "left_semi") for name, df in whole.items()})
        return merge_changes(self.target, lambda: made, self.keys, lambda t, s: merge.overwrite(t, s, self.keys), at, self.name)

    def catch_up(self, at: str) -> list[int]:
        """Runs until there is nothing new; the rows of each."""
        added = []
        while (n := self.run(at)) is not None:
            added.append(n)
        return added


def merge_into(target: Table, rows: Callable[[], DataFrame], how: Callable[[DataFrame, DataFrame], DataFrame], at: str, tries: int = 5) -> int:
    """Replace a table by ``how(target, source)``, from what it holds now; a writer that came in between makes it read and merge
    again, after a pause. Returns the commit's number."""

    def once() -> int:
        number = target.last()
        return target.commit(how(target.as_of(number), rows()), at, after=number)

    return snapshots.retried(once, tries)


#: Rows of a source for each file of its target from which on every file is taken to hold one of its keys, and none is searched.
EACH = 10_000


def hit(target: Table, files: list[str], keys: DataFrame, on: list[str]) -> list[str]:
    """The data files that hold one of the keys."""
    at_file = F.regexp_extract(F.input_file_name(), "([^/]+/[^/]+)$", 1)
    found = {r["__file"] for r in target.rows(files).select(*on, at_file.alias("__file")).join(keys, on, "left_semi").select("__file").distinct().collect()}  # data files
    return sorted(f for f in files if f.removeprefix("data/") in found)


def merge_changes(target: Table, rows: Callable[[], DataFrame], on: list[str], how: Callable[[DataFrame, DataFrame], DataFrame], at: str, app: str = "", batch: int | None = None, tries: int = 5) -> int:
    """Merge a frame into a table by its key, as ``how(target, source)`` says, and rewrite only the data files that hold one of
    its keys, or all where there are ``EACH`` source rows for each of them. Rows that become what they were are kept, so that readers of changes see the others alone. The source, the rows of
    the files, and what each row becomes are made once and held on disk meanwhile. Conflicts and the result as ``merge_into``; a batch of
    an app is merged once."""

    def once() -> int:
        lines = target.lines()
        if batch is not None and (done := target.done(lines, app, batch)):
            return done
        number = lines[-1]["commit_id"] if lines else 0
        files, names, held = target.files(number, lines), target.schema.names, []

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist(StorageLevel.DISK_ONLY))
            return held[-1]

        try:
            if not files:
                return target.rewrite(number, [], how(target.rows([]), hold(rows().select(*names))), target.rows([]), at, app, batch)
            source = hold(rows().select(*names))
            keys = source.select(*on).dropna().distinct()
            gone = files if source.count() >= EACH * len(files) else hit(target, files, keys, on)
            if not gone:
                return target.rewrite(number, [], how(target.rows([]), source), target.rows([]), at, app, batch)
            part = hold(target.rows(gone).join(keys.withColumn("__hit", F.lit(True)), on, "left").select(*names, F.col("__hit").isNotNull().alias("__hit")))
            mine = part.where("__hit").select(*names)
            one = lambda df, m, t: df.select(*names, F.lit(m).alias("__m"), F.lit(t).alias("__t"))
            counted = one(how(mine, source).select(*names), 1, 0).unionByName(one(mine, 0, 1)).groupBy(*names).agg(F.sum("__m").alias("__m"), F.sum("__t").alias("__t"))
            became = hold(counted.where("__m > 0"))  # rows after the merge, how often, and how often before
            times = lambda n: became.where(n > 0).select(*names, F.explode(F.sequence(F.lit(1), n)).alias("__i")).select(*names)
            new, kept = times(F.col("__m") - F.col("__t")), times(F.least("__m", "__t"))
            return target.rewrite(number, gone, new, part.where("NOT __hit").select(*names).unionByName(kept), at, app, batch)
        finally:
            for df in held:
                df.unpersist()

    return snapshots.retried(once, tries)
