"""Micro-batches of a long series stay small, and results do not depend on them."""

from candlemill.catalog import models_and_streams as M
from candlemill.streaming import queries as Q


def test_shapes_in_bounded_batches(spark, sf_dir, monkeypatch):
    """Before, all bars of a run came in one micro-batch, whatever their number."""
    monkeypatch.setattr(M, "BATCH", 70)
    sizes = []

    def found(stream, name):
        def keep(batch, _):
            sizes.append(max((r["count"] for r in batch.groupBy("run_id").count().collect()), default=0))

        counting = stream.writeStream.foreachBatch(keep).option("checkpointLocation", Q.scratch_path(spark, name)).trigger(availableNow=True).start()
        counting.awaitTermination()
        out = Q.run_to_end(Q.detect_shapes(stream, M.ALL), name)
        return sorted(tuple(r) for r in out.collect())

    small = found(M.price_stream(spark, sf_dir), "small")
    assert len(sizes) > 2 and max(sizes) == 70
    monkeypatch.setattr(M, "BATCH", 1 << 40)
    sizes.clear()
    whole = found(M.price_stream(spark, sf_dir), "whole")
    assert len(sizes) == 1 and len(small) > 0
    same = [(a[:3] + a[4:], round(a[3], 12)) for a in small]
    assert same == [(a[:3] + a[4:], round(a[3], 12)) for a in whole]
