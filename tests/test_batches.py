"""How much text a task holds as Python objects."""

import pyarrow as pa

from lorekeep.functions.batches import slices
from lorekeep.operators import chunking, transcripts


def test_slices():
    texts = ["x" * n for n in (5, 0, 90, 3, 3, 40, 40, 40)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    for size in (1, 10, 80, 1000):
        got = [part["t"].to_pylist() for part in slices(batch, "t", size)]
        assert sum(got, []) == texts and all(len(x) == 1 or sum(len(y or "") for y in x) <= size for x in got)
    assert [len(x) for x in slices(batch, "t", 1000, rows=4)] == [4, 4, 1]
    assert list(slices(batch.slice(0, 0), "t", 9)) == []


class Task:
    """Stands for a table; what mapInArrow would run stays at hand."""

    columns, schema = ("doc_path", "content"), type("Schema", (), {"fields": []})

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_chunks_hold_few_texts(spark):
    """A batch of many texts is cut and embedded a few megabytes at a time."""
    raw = [f"## H\n{'word ' * 20_000}{i}" for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(60)]), pa.array(raw)], names=["path", "raw"])
    made = list(chunking.chunks(Task()).run(iter([batch])))
    assert len(made) > 2 and max(x.nbytes for x in made) < 3 * chunking.TEXT
    assert sorted({p for x in made for p in x["doc_path"].to_pylist()}) == sorted(f"p{i}" for i in range(60))
    batch = batch.rename_columns(["doc_path", "content"])
    embedded = list(chunking.embedded(Task(), lambda texts: [[float(len(t))] for t in texts]).run(iter([batch])))
    assert len(embedded) > 2 and [v for x in embedded for v in x["embedding"].to_pylist()] == [[float(len(t))] for t in raw]


def test_collapsed_holds_few_texts(monkeypatch):
    seen = []
    monkeypatch.setattr(transcripts, "shortened", lambda t: seen.append(t) or t.upper())
    texts = [f"t{i}" if i % 7 else None for i in range(500)]
    got = transcripts.collapsed.func(pa.array(texts, pa.string()))
    assert isinstance(got, pa.Array) and got.to_pylist() == [t and t.upper() for t in texts] and len(seen) == 428
    assert transcripts.collapsed.func(pa.array([], pa.string())).to_pylist() == []
