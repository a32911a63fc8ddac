"""Workers make and give out rows in runs of bounded bytes, whatever batch they get."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from builders import package_of
from pyspark.sql import types as T

from caseloom import frames
from caseloom.operators import anchors, phrases
from caseloom.operators.seam import apply_model
from caseloom.sources.archives import Guard, _expanded
from caseloom.sources.documents import _decode


def test_runs():
    sizes = frames.byte_sizes([pa.array(["ab", None, "ü"]), pa.array([1, 2, 3]), pa.array([b"", b"xyz", None], pa.large_binary())])
    assert sizes.tolist() == [2, 3, 2]
    half = frames.RUN_BYTES // 2
    assert list(frames.runs(pa.array([half, half, 1, 3 * half, 0, 0]).to_numpy())) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert [b - a for a, b in frames.runs(pa.array([0] * (2 * frames.RUN_ROWS + 5)).to_numpy())] == [frames.RUN_ROWS, frames.RUN_ROWS, 5]
    assert list(frames.runs(pa.array([], pa.int64()).to_numpy())) == []


def test_members_leave_in_small_batches():
    """One batch of 40 archives that hold 40 MB."""
    archives = [package_of({"a.bin": bytes([i]) * 1_000_000, "b.txt": b"b"}) for i in range(40)]
    rows = pa.record_batch({"package_id": pa.array([f"p{i}" for i in range(40)]), "content": pa.array(archives, pa.binary())})
    out = list(_expanded(iter([rows]), Guard(), True))
    assert max(b.nbytes for b in out) < 6 << 20
    found = [r for b in out for r in b.to_pylist()]
    assert [(r["file_id"], r["length"], r["content"][:1]) for r in found] == [
        x for i in range(40) for x in ((f"p{i}#0", 1_000_000, bytes([i])), (f"p{i}#1", 1, b"b"))]



def test_documents_are_decoded_in_runs():
    """One batch of 30 files of 1 MB, as Spark may hand it over."""
    mail = b"Content-Type: text/plain\n\n" + b"x" * 1_000_000
    reader, content = pa.array(["eml", "eml", "pdf"] * 10), pa.array([mail, None, None] * 10, pa.binary())
    out = list(_decode.func(iter([(reader, content)])))
    assert max(a.nbytes for a in out) < 3 << 20
    found = [x for a in out for x in a.to_pylist()]
    assert [(x["type"], len(x["text"] or "")) for x in found] == [("text/plain", 1_000_000), (None, 0), (None, 0)] * 10



def test_a_model_gets_runs(spark):
    """All rows come in one batch; one refused call costs its own run alone."""
    def model(batch):
        if (batch["text"] == "bad").any():
            raise RuntimeError("refused")
        return pd.DataFrame({"seen": [len(batch)] * len(batch)})

    rows = [(i, "bad" if i == 7 else "t" * (3 << 20 if i == 2500 else 3)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "i long, text string").coalesce(1)
    got = {r.i: r for r in apply_model(frame, model, ["text"], T.StructType([T.StructField("seen", T.LongType())])).collect()}
    assert sorted(got) == list(range(3000)) and got[7].seen is None and got[7].model_error == "RuntimeError: refused"
    assert got[6].seen == got[999].seen == 1 and got[1000].seen == frames.RUN_ROWS and got[2500].seen == 1
    assert got[2499].seen == 500 and got[2501].seen == 499 and all(r.model_error is None for i, r in got.items() if i != 7)



def test_anchors_leave_without_their_texts():
    """A text of 60 KB with an anchor at every ninth place."""
    text, size = "abcdefgh " * 7000, 8
    batch = pa.record_batch({"_k0": pa.array([1]), "_scope": pa.array([0]), "_form": pa.array([text])})
    data, ends = anchors.as_bytes(batch.column("_form"))
    (_, hashes), = anchors.window_hashes(data, [size])
    bits = anchors.bits_of(anchors.scoped(hashes, np.zeros(1, np.int64), ends)[:1])
    work = phrases._around(SimpleNamespace(value=bits), [size], SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64))), ["_k0", "_scope"])
    before, most, places = pa.total_allocated_bytes(), 0, []
    for out in work(iter([batch])):
        most = max(most, pa.total_allocated_bytes() - before)
        places += out.column("place").to_pylist()
    assert set(range(0, len(text), 9)) <= set(places) and most < 8 << 20
