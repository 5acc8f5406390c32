import random
import zlib
from collections import Counter

from stratalith.llm import ring_sharding
from stratalith.llm.ring_sharding import CELLS, arcs, flow, ring, shard


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    per = Counter(r["shard"] for r in rows)
    sizes = [per.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = sorted((r["shard"], r["slot"]) for r in rows)
    assert slots == [(s, i) for s in range(shards) for i in range(per.get(s, 0))]
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_edge_cases(edge, edge_texts):
    for n in (1, 5, 24):
        check(shard(edge, n).collect(), edge_texts, n)


def test_repeated_rows_and_null_ids(spark, edge):
    doubled = edge.union(edge).union(edge.selectExpr("cast(null as bigint) doc_id", *edge.columns[1:]))
    rows = shard(doubled, 4).collect()
    per = Counter(r["shard"] for r in rows)
    assert sum(per.values()) == doubled.count() and max(per.values()) - min(per.values()) <= 1


def test_empty_table(empty):
    assert shard(empty).count() == 0


def test_most_rows_stay_when_a_shard_comes():
    """Few rows move: about the new shard's share, and what the bounds push on."""

    def owner(shards):
        points = ring(shards, 128)
        arc = arcs(points)
        cells = Counter(arc[i * 7919 % CELLS] for i in range(24_000))
        runs = flow(points, cells, shards)
        out, seen = {}, Counter()
        for i in range(24_000):
            a = arc[i * 7919 % CELLS]
            rank = seen[a]
            seen[a] += 1
            out[i] = max((r for r in runs if r[0] == a and r[1] <= rank), key=lambda r: r[1])[2]
        return out

    a, b = owner(24), owner(25)
    assert sum(a[i] != b[i] for i in a) < 1.5 / 24 * len(a)


def plain(points, arc_of_rows, shards):
    """Row by row: each takes its own arc's shard while there is room; then those left go on clockwise, first come first served."""
    n = len(arc_of_rows)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    owner, left = {}, {}
    for arc, (_, s) in enumerate(points):
        for row in (i for i in range(n) if arc_of_rows[i] == arc):
            if room[s]:
                room[s] -= 1
                owner[row] = s
            else:
                left.setdefault(arc, []).append(row)
    queue = []
    for step in range(2 * len(points)):
        arc = step % len(points)
        queue += left.pop(arc, [])
        while queue and room[points[arc][1]]:
            room[points[arc][1]] -= 1
            owner[queue.pop(0)] = points[arc][1]
    return owner


def test_flow_equals_row_by_row_placing():
    rnd = random.Random(3)
    for shards, nodes, n in ((3, 2, 40), (5, 4, 200), (4, 1, 17), (7, 8, 5)):
        points = ring(shards, nodes)
        rows = [min(rnd.randrange(len(points)), rnd.randrange(len(points))) for _ in range(n)]
        want, seen = plain(points, rows, shards), Counter()
        runs = flow(points, Counter(rows), shards)
        for i, a in enumerate(rows):
            rank = seen[a]
            seen[a] += 1
            assert max((r for r in runs if r[0] == a and r[1] <= rank), key=lambda r: r[1])[2] == want[i]


def test_the_query_places_as_row_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    points = ring(24, 128)
    arc = arcs(points)
    key = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    ids = sorted(key, key=lambda i: key[i])
    want = plain(points, [arc[key[i] % CELLS] for i in ids], 24)
    assert {r["doc_id"]: r["shard"] for r in shard(docs).collect()} == {i: want[k] for k, i in enumerate(ids)}


def test_an_id_of_many_rows_is_dealt_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ring_sharding, "PIECE", 10)
    docs = spark.createDataFrame([(7, "same")] * 95 + [(i, "x") for i in range(100, 140)], "doc_id bigint, text string")
    rows = shard(docs, 5).collect()
    per = Counter(r["shard"] for r in rows)
    assert set(per.values()) == {27} and sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(5) for i in range(27)]
    assert sum(r["doc_id"] == 7 for r in rows) == 95
