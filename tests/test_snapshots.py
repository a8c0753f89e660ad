"""Writers at once, and what is left behind after merges and failures."""

import os
import threading

from pyspark.sql import functions as F

from paperlantern.plans import index as ix
from paperlantern.workload import fixtures as fx

SF = "/root/testdata/sf0.001"


def _few(spark):
    docs = fx.documents(spark, SF)
    return docs.where("index_id IN ('src1', 'src2', 'src3')").select(*[c for c in docs.columns])


def _count(root):
    return sum(len(files) for _, _, files in os.walk(root))


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    root, docs, catalog = str(tmp_path / "index"), _few(spark), fx.catalog(spark, SF)
    only = lambda df, name: df.where(F.col("index_id") == name)
    ix.write_index(only(docs, "src3"), root, only(catalog, "src3"), buckets=2, positions=False)
    # both look at the index before either has committed
    both, look = threading.Barrier(2, timeout=120), ix.segments
    seen = threading.local()

    def looked(*a):
        found = look(*a)
        if not getattr(seen, "once", False) and threading.current_thread() is not threading.main_thread():
            seen.once = True
            both.wait()
        return found

    monkeypatch.setattr(ix, "segments", looked)
    failed = []

    def write(name):
        try:
            ix.write_index(only(docs, name), root, only(catalog, name))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in ("src1", "src2")]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed
    index = ix.open_index(spark, root)
    assert sorted((r.index_id, r["count"]) for r in index.documents.groupBy("index_id").count().collect()) == sorted(
        (r.index_id, r["count"]) for r in docs.groupBy("index_id").count().collect())
    assert [s.seq for s in ix.segments(spark, root)] == [0, 1, 2]
    assert {r.index_id for r in index.catalog.collect()} == {"src1", "src2", "src3"}


def test_merged_and_failed_attempts_go(spark, tmp_path, monkeypatch):
    root, docs = str(tmp_path / "index"), _few(spark).where("index_id = 'src1'")
    catalog = fx.catalog(spark, SF).where("index_id = 'src1'")
    ix.write_index(docs, root, catalog, buckets=2, positions=False)
    for _ in range(3):
        ix.append_segment(spark, root, docs.limit(2))
    commit = ix.commit

    def crash(*a):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(ix, "commit", crash)
    try:
        ix.append_segment(spark, root, docs.limit(1))
    except RuntimeError:
        pass
    monkeypatch.setattr(ix, "commit", commit)
    ix.append_segment(spark, root, docs.limit(1))
    assert ix.segments(spark, root)[-1].seq == 5  # the number of the lost one is not used again
    ix.merge_segments(spark, root, 1, 5)
    wanted = sorted(map(tuple, ix.open_index(spark, root).postings.select("path", "term", "tf").collect()))
    files = _count(root)
    assert ix.clean_up(spark, root) == 0 and _count(root) == files  # too young
    assert ix.clean_up(spark, root, older_than=-5) > 20 and _count(root) < files / 2
    assert sorted(os.listdir(f"{root}/rows")) == ["seq=0", "seq=5"] and sorted(os.listdir(f"{root}/segments")) == ["seq=0", "seq=5"]
    index = ix.open_index(spark, root)
    assert sorted(map(tuple, index.postings.select("path", "term", "tf").collect())) == wanted
    assert index.documents.count() == docs.count() and ix.next_seq(spark, root) == 6
    assert ix.clean_up(spark, root, older_than=-5) == 0
