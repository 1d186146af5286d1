import pyarrow as pa

from govlens.llm import common


def test_tidy_gives_memory_back_and_passes_batches_on(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append("released")

    monkeypatch.setattr(pa, "default_memory_pool", lambda: Pool())
    assert list(common.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
    assert calls == ["released"]


def test_ready_bounds_batches(spark):
    common.ready(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == common.BATCH_ROWS


def test_long_texts_are_hashed_in_small_segments():
    """A worker's powers and a text's temporaries stay below 16 MB, whatever the text's size."""
    import tracemalloc

    from govlens.llm import shingles

    shingles._POWERS.clear()
    text = b"word " * 600_000
    tracemalloc.start()
    hashes = shingles.word_hashes(text)
    peak = tracemalloc.get_traced_memory()[1] - 2 * hashes.nbytes
    tracemalloc.stop()
    assert len(hashes) == 600_000 and len(set(hashes.tolist())) == 1
    assert peak < 16 << 20
