"""Python workers hand the memory of a task back: Spark keeps them, and an executor may have more than it has cores."""

import numpy as np
import pyarrow as pa

from tillcast.llm import common, line_dedup


def _resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_a_finished_task_holds_no_freed_memory():
    def run(batches):
        held = [np.ones(8_000, np.uint8) for _ in range(20_000)]  # 160 MB below malloc's limit for pages of their own
        keep = held[::2000]
        del held
        yield from batches
        kept.extend(keep)

    kept: list = []
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["a"])
    before = _resident_mb()
    assert list(run([batch])) == [batch]
    plain = _resident_mb() - before
    kept.clear()
    before = _resident_mb()
    assert list(common.lean(run)([batch])) == [batch]
    assert _resident_mb() - before < 40, plain


def test_memory_is_handed_back_when_the_reader_stops_early(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "hand_back", lambda: seen.append(1))
    rows = common.lean(iter)([1, 2, 3])
    assert next(rows) == 1 and not seen
    rows.close()
    assert seen == [1]


def test_a_task_of_the_bloom_filter_has_one_worker(spark, monkeypatch):
    """Every step of a chain of Python operators takes a worker of its own, and executors keep them."""
    rows = spark.createDataFrame([(i, i % 7, i % 3) for i in range(50)], "h bigint, doc bigint, line int")
    plans, fold = [], common._fold_cells
    monkeypatch.setattr(common, "_fold_cells", lambda parts, *a: plans.append(parts._jdf.queryExecution().executedPlan().toString()) or fold(parts, *a))
    bits = line_dedup._row_bloom(rows)
    assert [p.count("MapInArrow") for p in plans] == [1]
    h, doc, line = (np.array([r[k] for r in rows.collect()]) for k in range(3))
    assert common.bloom_has(bits, line_dedup._tag(h, doc, line)).all() and common.bloom_has(bits, common.mix64(np.arange(7))).all()
    assert not common.bloom_has(bits, common.mix64(np.arange(1000, 1100))).any()
