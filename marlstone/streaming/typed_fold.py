"""The fold of the event log as a stream with typed keyed state: entries, lists and a head by run instead of one whole view.

A micro-batch reads and writes the entries that its events touch, and emits just those as changes, so neither state traffic nor
output grows with the length of a run. ``assemble`` makes views of changes. A run that has ended keeps what is needed to pass
over redelivered events for a retention; then a timer clears all of its state but the head.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import VIEW_SCHEMA, FoldError, fold_events

#: Sections of a view that are maps by a key and those that only grow; everything else is in the head. Numbers of an entry of ``seen``.
MAPS = ("seen", "stages", "agents", "issues", "documents", "chunks", "evidence", "claims", "arguments", "counterarguments", "precedent_cards", "objections", "jury_ballots")
SEEN = 64
LISTS = ("timeline", "queries", "verifications", "unresolved_questions", "validation_failures", "budget_warnings")
CHANGE_SCHEMA = "run_id string, version bigint, section string, key string, value string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Entries:
    """A map section: an entry is read from state when it is asked for, and is written back if it was set."""

    def __init__(self, view: _View, section: str):
        self.view, self.section = view, section

    def get(self, key, default=None):
        held, at = self.view.cache, (self.section, str(key))
        if at not in held:
            raw = self.view.entries.getValue(at) if not self.view.fresh and self.view.entries.containsKey(at) else None
            held[at] = json.loads(raw[0]) if raw else None
        return default if held[at] is None else held[at]

    def __contains__(self, key):
        return self.get(key) is not None

    def __setitem__(self, key, value):
        at = (self.section, str(key))
        self.view.cache[at] = value
        self.view.changed[at] = None


class _Seen:
    """Which event had which number, SEEN numbers to an entry. Numbers rise, so for one above all so far no state is asked."""

    def __init__(self, view: _View):
        self.view, self.chunks = view, _Entries(view, "seen")

    def get(self, seq, default=None):
        return default if int(seq) > self.view.head["last_seq"] else self.chunks.get(int(seq) // SEEN, {}).get(seq, default)

    def __setitem__(self, seq, event):
        at = int(seq) // SEEN
        # The first number of an entry finds none, unless the entry has a number already.
        fresh = self.view.head["last_seq"] // SEEN < at
        self.chunks[at] = ({} if fresh else self.chunks.get(at, {})) | {seq: event}


class _Items:
    """A section that only grows: new items are appended to state, old ones are never read."""

    def __init__(self, view: _View, section: str):
        self.view, self.section = view, section

    def append(self, item: dict):
        counts = self.view.head["counts"]
        counts[self.section] = counts.get(self.section, 0) + 1
        self.view.added.append((self.section, f"{counts[self.section]:09d}", item))
        if self.section == "timeline":
            self.view.head["last_seq"] = item["seq"]

    def __bool__(self):
        return bool(self.view.head["counts"].get(self.section))

    def __getitem__(self, at):
        if (self.section, at) != ("timeline", -1):
            raise IndexError("only the last event's number is at hand")
        return {"seq": self.view.head["last_seq"]}


class _View:
    """What the rules of the fold see of one run's state."""

    def __init__(self, entries, head: dict):
        self.entries, self.head = entries, head
        #: A run that begins in this batch has no entries in state, so none are asked for.
        self.fresh = False
        self.cache: dict[tuple[str, str], object] = {}
        self.changed: dict[tuple[str, str], None] = {}
        self.added: list[tuple[str, str, dict]] = []

    def get(self, name, default=None):
        if name in MAPS:
            return _Seen(self) if name == "seen" else _Entries(self, name)
        return _Items(self, name) if name in LISTS else self.head["fields"].get(name, default)

    __getitem__ = setdefault = get

    def __setitem__(self, name, value):
        self.head["fields"][name] = value

    def update(self, **fields):
        self.head["fields"].update(fields)

    @classmethod
    def begin(cls, entries, plain: dict) -> _View:
        """The state of a run from the view of its first event."""
        view = cls(entries, {"fields": {k: v for k, v in plain.items() if k not in MAPS + LISTS}, "counts": {}, "last_seq": -1})
        view.fresh = True
        for name in MAPS:
            for k, v in plain.get(name, {}).items():
                view[name][k] = v
        for name in LISTS:
            for item in plain.get(name, []):
                view[name].append(item)
        return view


def _records(pdf: pd.DataFrame) -> Iterator[dict]:
    """Rows as dictionaries, missing values as None."""
    columns = [[None if v is None or v != v else v for v in pdf[c].tolist()] for c in pdf.columns]
    return (dict(zip(pdf.columns, row)) for row in zip(*columns))


class FoldProcessor(StatefulProcessor):
    def __init__(self, retention: int | None = None):
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "value string")
        self.entries = handle.getMapState("entries", "section string, key string", "value string")
        self.items = handle.getListState("items", "section string, key string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [e for pdf in rows for e in _records(pdf)]
        events.sort(key=lambda r: r["seq"])
        view, error = _View(self.entries, json.loads(self.head.get()[0])) if self.head.exists() else None, None
        running = view is not None and view["status"] == "running"
        try:
            if view is None:
                view = _View.begin(self.entries, fold_events(events[:1]))
                running, events = True, events[1:]
            fold_events(events, view)
        except FoldError as e:
            error = str(e)
        out = []
        if view is not None:
            version = view.head["last_seq"]
            for section, name in view.changed:
                value = json.dumps(view.cache[section, name])
                self.entries.updateValue((section, name), (value,))
                if section != "seen":
                    out.append((key[0], version, section, name, value))
            added = [(section, name, json.dumps(item)) for section, name, item in view.added]
            if added:
                self.items.appendList(added)
            out += [(key[0], version, *item) for item in added]
            self.head.update((json.dumps(view.head),))
            out.append((key[0], version, "head", "", json.dumps(view.head["fields"] | {"last_seq": version})))
            if self.retention is not None and running and view["status"] != "running":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retention)
        if error:
            out.append((key[0], view.head["last_seq"] if view else None, "error", "", error))
        yield pd.DataFrame(out, columns=["run_id", "version", "section", "key", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        self.items.clear()
        yield pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("run_id", "object"), ("version", "int64"), ("section", "object"), ("key", "object"), ("value", "object"))})

    def close(self) -> None:
        pass


def fold_changes(events: DataFrame, retention: int | None = None) -> DataFrame:
    """Changes of runs' views as a stream (update mode): run_id, version (last seq), section, key, value (JSON).

    Sections are those of the view, ``head`` (all that is neither map nor list) and ``error``: an event that cannot be folded leaves the
    state as the events before it made it, and is told. Start it under ``typed_state``.

    ``retention`` is how many milliseconds the state of an ended run is kept. Spark's timers keep a stream at work as long as it is not
    stopped, so it is for streams that go on; one that drains what is there now (availableNow) is to have none.
    """
    return events.groupBy("run_id").transformWithStateInPandas(FoldProcessor(retention), CHANGE_SCHEMA, "Update", "None" if retention is None else "ProcessingTime")


@contextmanager
def typed_state(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which typed state needs; the session's own setting comes back after."""
    held = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, held)


def assemble(changes: DataFrame) -> DataFrame:
    """Views (as of ``events.fold``) from all changes so far: the newest value of each entry, and list items in order."""
    newest = changes.where("section <> 'error'").groupBy("run_id", "section", "key").agg(F.max_by("value", "version").alias("value"))
    errors = changes.where("section = 'error'").groupBy("run_id").agg(F.max_by("value", F.coalesce("version", F.lit(-1))).alias("error"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        view: dict = {}
        for r in pdf.sort_values(["section", "key"]).itertuples(index=False):
            value = json.loads(r.value)
            if r.section == "head":
                view.update(value)
            elif r.section in LISTS:
                view.setdefault(r.section, []).append(value)
            else:
                view.setdefault(r.section, {})[r.key] = value
        last = view.pop("last_seq", None)
        return pd.DataFrame([(key[0], view.get("status"), last, len(view.get("timeline", [])), json.dumps(view, sort_keys=True))], columns=["run_id", "status", "last_seq", "events", "view"])

    views = newest.groupBy("run_id").applyInPandas(run, "run_id string, status string, last_seq bigint, events bigint, view string")
    both = views.join(errors, "run_id", "full")
    return both.select(*[c.split()[0] for c in VIEW_SCHEMA.split(", ")])
