import json
import shutil

from quaymark.sources.shards import ShardReader, ShardSource


class Log:
    def __init__(self, root):
        self.root = root

    def shard(self, name, parents=(), end=None):
        (self.root / name).mkdir(parents=True, exist_ok=True)
        (self.root / name / "shard.json").write_text(json.dumps({"parents": list(parents)} | ({} if end is None else {"end": end})))

    def put(self, name, first, n):
        (self.root / name / f"{first:012d}.jsonl").write_text("".join(json.dumps({"n": first + i}) + "\n" for i in range(n)))


def test_read_in_batches_and_restart(spark, tmp_path):
    log, cp, got = Log(tmp_path / "log"), str(tmp_path / "cp"), []
    spark.dataSource.register(ShardSource)
    log.shard("a")
    log.put("a", 0, 3)
    log.put("a", 3, 4)
    log.shard("b")
    log.put("b", 10, 2)  # older records are gone

    def go(**options):
        s = spark.readStream.format("shards").option("path", str(tmp_path / "log")).options(**options).load()
        q = s.writeStream.foreachBatch(lambda d, _: got.append(sorted((r.shard, r.sequence) for r in d.collect()))).option("checkpointLocation", cp).trigger(once=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    go()
    assert got[-1] == [("a", i) for i in range(7)] + [("b", 10), ("b", 11)]
    log.put("a", 7, 2)
    log.shard("a", end=9)
    log.shard("a1", ["a"])
    log.put("a1", 0, 1)
    log.shard("m", ["a", "b"])
    log.put("m", 0, 1)
    go()
    assert got[-1] == [("a", 7), ("a", 8)]  # the children wait for their parents
    go()
    assert got[-1] == [("a1", 0)]  # m still waits for b
    log.shard("b", end=12)
    go()
    assert got[-1] == [("m", 0)]


def test_positions_no_longer_kept(tmp_path):
    log = Log(tmp_path)
    log.shard("s")
    log.put("s", 100, 5)
    old, new = ShardReader({"path": str(tmp_path)}), ShardReader({"path": str(tmp_path), "initial": "latest"})
    assert new.initialOffset() == {"s": 105} and old.initialOffset() == {}
    end = old.latestOffset({"s": 7})
    assert [(p.start, p.end) for p in old.partitions({"s": 7}, end)] == [(100, 105)]
    assert [(p.start, p.end) for p in old.partitions({"s": 900}, end)] == [(100, 105)]
    assert new.partitions({"s": 7}, new.latestOffset({"s": 7})) == []
    few = ShardReader({"path": str(tmp_path), "maxrecordspershard": "2"})
    assert few.latestOffset({"s": 101}) == {"s": 103}
    assert [r[1] for p in few.partitions({"s": 101}, {"s": 103}) for r in few.read(p)] == [101, 102]


def test_parents_that_are_gone_count_as_read(tmp_path):
    log = Log(tmp_path)
    log.shard("child", ["gone"])
    log.put("child", 0, 2)
    log.shard("empty", end=0)
    log.shard("heir", ["empty"])
    log.put("heir", 0, 1)
    r = ShardReader({"path": str(tmp_path)})
    assert r.latestOffset({}) == {"child": 2, "empty": 0, "heir": 1}
    shutil.rmtree(tmp_path / "child")
    assert ShardReader({"path": str(tmp_path / "nothing")}).latestOffset({}) == {}
