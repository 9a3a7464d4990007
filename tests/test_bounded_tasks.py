"""What a task holds at once, and what it asks of its state."""

import pandas as pd
import pyarrow as pa

from cloakframe.sources import office
from cloakframe.streaming.placeholders import _Allocator


def test_office_rows_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(office, "CHARS_PER_BATCH", 1000)
    run = office._parser(lambda content: iter([(content.decode() * 400,)]), office.TEXT_SCHEMA, "Word")
    files = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(9)], "content": [b"x"] * 8 + [b"\xff"]})
    batches = list(run(iter([files])))
    assert [b.num_rows for b in batches] == [3, 3, 3] and batches[0].schema.names == ["path", "text", "error"]
    rows = pa.Table.from_batches(batches).to_pylist()
    assert [r["text"] for r in rows] == ["x" * 400] * 8 + [None] and rows[8]["error"] and rows[0]["error"] is None


class _State(dict):
    """A value, a map and the handle of both, which counts what it is asked."""

    asked = 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return _Given()

    def containsKey(self, key):
        self.asked += 1
        return key in self

    def updateValue(self, key, value):
        self[key] = value


class _Given:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def _run(allocator, *values):
    frame = pd.DataFrame({"original": values, "seen": range(len(values))})
    return pd.concat(allocator.handleInputRows((0,), iter([frame]), None))["original"].tolist()


def test_a_first_batch_asks_the_state_nothing():
    state, allocator = _State(), _Allocator("ITEM", "corpus", 1, 16, 0)
    allocator.init(state)
    assert _run(allocator, "a", "b", "a") == ["a", "b"] and state.asked == 0
    assert _run(allocator, "b", "c") == ["c"] and state.asked == 2


def test_values_that_were_taken_over_are_asked_for():
    state, allocator = _State(), _Allocator("ITEM", "corpus", 1, 16, 5)
    allocator.init(state)
    allocator.handleInitialState((0,), pd.DataFrame({"original": ["a"], "number": [5]}), None)
    assert _run(allocator, "a", "b") == ["b"] and state.asked == 2
