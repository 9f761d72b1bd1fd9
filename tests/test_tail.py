import json
import random

from pyspark.sql import functions as F

from lorekeep.sources import tail


def by_hand(path, limit):
    """Records in the last ``limit`` bytes of a file, without the first line if there are more."""
    data = path.read_bytes()
    lines = data[-limit:].decode("utf-8", "replace").split("\n")
    out = []
    for line in lines[len(data) > limit :]:
        try:
            record = json.loads(line.strip() or "null")
        except json.JSONDecodeError:
            continue
        if isinstance(record, dict):
            out.append(record)
    return out


def found(df):
    rows = df.select("file", "offset", F.to_json("record").alias("j")).orderBy("file", "offset").collect()
    return [json.loads(r.j) for r in rows]


def test_tails_as_by_hand(spark, tmp_path):
    rng = random.Random(2)
    big = tmp_path / "deep" / "big.jsonl"
    big.parent.mkdir()
    with big.open("w", encoding="utf-8") as f:
        while f.tell() < 5 << 20:
            f.write(rng.choice([json.dumps({"i": f.tell(), "t": "é😀" * rng.randrange(900)}, ensure_ascii=False), "[1, 2]", "3", '"text"', "{broken", "", "  ", "null"]) + "\n")
    small = tmp_path / "small.jsonl"
    small.write_bytes(b'{"a": 1}\n\xff\xfe broken\n{"b": [1, {"c": null}]}')
    (tmp_path / "other.txt").write_text('{"no": 1}\n')
    for limit in (tail.TAIL_BYTES, 100_000, 7):
        got = found(tail.jsonl_tail(spark, str(tmp_path), limit))
        assert got == by_hand(big, limit) + by_hand(small, limit)
    assert len(found(tail.jsonl_tail(spark, str(tmp_path)))) > 100
    assert found(tail.jsonl_tail(spark, f"file://{small}")) == by_hand(small, 1 << 20)
    assert found(tail.jsonl_tail(spark, str(tmp_path / "missing"))) == []
    read = tail.jsonl_tail(spark, str(big), 100_000).select(F.min("offset")).first()[0]
    assert read >= big.stat().st_size - 100_000


def test_ranges_are_grouped_by_size():
    ranges = [(f"f{i}", 0, 10, False) for i in range(10)]
    groups = tail.grouped(ranges, 35)
    assert [len(g.ranges) for g in groups] == [3, 3, 3, 1] and tail.grouped([]) == []


def test_a_stream_takes_what_is_appended(spark, tmp_path):
    log = tmp_path / "logs" / "one.jsonl"
    log.parent.mkdir()
    log.write_text("".join(json.dumps({"n": i}) + "\n" for i in range(50)) + '{"n": 50')
    tail_bytes = 100
    query = lambda: (
        tail.jsonl_stream(spark, str(log.parent), tail_bytes).select(F.to_json("record").alias("j"))
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    )
    seen = lambda: sorted(json.loads(r.j)["n"] for r in spark.read.schema("j string").parquet(str(tmp_path / "out")).collect())
    query()
    complete = log.read_text().rpartition("\n")[0] + "\n"
    first = [json.loads(x)["n"] for x in complete[-tail_bytes:].split("\n")[1:] if x]
    assert seen() == first and first[-1] == 49
    with log.open("a") as f:
        f.write('}\n{"n": 51}\n{"n"')
    (log.parent / "two.jsonl").write_text('{"n": 100}\n')
    query()
    assert seen() == [*first, 50, 51, 100]
    query()
    assert seen() == [*first, 50, 51, 100]
