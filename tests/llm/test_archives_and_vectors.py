import base64
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspan.llm import archives, cover_tree
from graphspan.session import scratch

PAGES = [
    (5, "http://a/1", "<p>one</p>"), (3, "http://a/2", "<p>one</p>"), (9, "http://a b/3", "<p>one</p>"), (1, None, None), (2, "http://c/", ""),
    (7, "http://d/", "é漢\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n" * 3), (8, "http://e/", "HTTP/1.1 200 OK\r\n\r\nx"), (8, "http://e/", "HTTP/1.1 200 OK\r\n\r\nx"), (None, "http://n/", "<p>one</p>"),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_pages_through_arc_and_warc(spark, min_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    path = scratch(spark, "w")
    archives.write_warc(archives.with_revisits(archives.arc_to_records(archives.pages_to_arcs(pages, records=2)), min_bytes), path)
    got = archives.read_warc(spark, path).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= min_bytes:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        to = first.get(h or "") if i is not None else None
        again = to is not None and to != i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", to if again else None))
    assert sorted(((r["key"], r["payload_bytes"], r["digest"], r["type"], r["refers_key"]) for r in got), key=repr) == sorted(want, key=repr)
    assert {bytes(r["payload"]).decode() for r in got if r["type"] == "response"} == {h or "" for _, _, h in PAGES}
    assert all(r["date"] == "2000-01-01T00:00:00Z" for r in got)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch(spark, "w")
    archives.write_warc(archives.with_revisits(archives.arc_to_records(archives.pages_to_arcs(pages))), path)
    assert archives.read_warc(spark, path).count() == 0


@pytest.mark.parametrize("version", [b"1", b"2"])
def test_both_arc_versions(version):
    data = archives.arc_block(version) + archives.arc_record(version, b"http://x/a b", b"19990102", b"text/plain", b"body\nwith lines\n") + archives.arc_record(version, b"dns:x", b"20010203040506", b"text/dns", b"")
    found = list(archives.parse_arc(data))
    assert found == [(b"http://x/a%20b", b"19990102", b"text/plain", b"body\nwith lines\n"), (b"dns:x", b"20010203040506", b"text/dns", b"")]
    record = archives._converted(*found[0])
    assert record["date"] == "1999-01-02T00:00:00Z" and record["type"] == "resource"
    assert record == archives._converted(*found[0])


@pytest.mark.parametrize("data", [b"http://x/ 0.0.0.0 2000 text/html 3\nabc\n", archives.arc_block(b"1") + b"http://x/ 0.0.0.0 2000 text/html 30\nabc\n", archives.arc_block(b"1").replace(b"1 0 ", b"7 0 ")])
def test_broken_archives_raise(data):
    with pytest.raises(ValueError):
        list(archives.parse_arc(data))


def _vectors(seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(25, 16))
    rows = [(i, (centre[i % 25] + rng.normal(scale=rng.choice([0.05, 0.3, 0.6]), size=16)).tolist(), i % 3) for i in range(300)]
    rows += [(300 + i, rows[4][1], rows[4][2]) for i in range(40)]
    rows += [(400, (np.array(rows[4][1]) * 1e-30).tolist(), rows[4][2]), (401, rows[4][1], None), (402, None, 1), (403, [], 1), (404, [0.0] * 16, 1), (405, [float("nan")] * 16, 1)]
    rows += [(406, [None] + [1.0] * 15, 1), (407, [float("inf")] + [1.0] * 15, 1), (408, [1.0, 0.0], 1), (409, [1.0, 0.001], 1), rows[7]]
    return rows


@pytest.mark.parametrize("cell", [2000, 40, 12])
def test_cosine_links_match_brute_force(spark, cell):
    rows = _vectors()
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                link[i, j] = link[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    label = list(range(n))
    for _ in range(n):
        new = [min([rows[label[j]][0] for j in np.flatnonzero(link[i])] + [rows[label[i]][0]]) for i in range(n)]
        index = {rows[i][0]: i for i in range(n - 1, -1, -1)}
        new = [index[x] for x in new]
        if new == label:
            break
        label = new
    want = sorted((rows[i][0], int(link[i].sum()), rows[label[i]][0], rows[label[i]][0] == rows[i][0]) for i in range(n))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("x"))
    assert sorted(tuple(r) for r in cover_tree.cosine_links(df, cell=cell).collect()) == want
    assert max(w[1] for w in want) >= 40


def test_one_id_on_unlike_vectors_and_labels(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, [1.0, 0.1, 0.0], 0), (3, [0.1, 1.0, 0.0], 0), (1, a, 7), (4, a, 7), (0, [0.1, 1.0, 0.01], 0)]
    got = sorted(tuple(r) for r in cover_tree.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 2, 0, False), (2, 1, 1, False), (3, 2, 0, False), (1, 1, 1, True), (4, 1, 1, False), (0, 2, 0, True)])


def test_no_vectors(spark):
    assert cover_tree.cosine_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cover_tree_levels_nest_and_cover():
    x = np.random.default_rng(1).normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = cover_tree.CoverTree(x, 0.2)
    radius = 2.0
    for (centres, radii, kids), (below, _, _) in zip(tree.levels, tree.levels[1:]):
        assert set(centres) <= set(below) and sorted(np.concatenate(kids)) == list(range(len(below)))
        assert (radii <= radius + 1e-9).all()
        radius /= 2
    assert sorted(np.concatenate(tree.levels[-1][2])) == list(range(200))
    i, j = cover_tree.dual_links(tree, tree, 0.8)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.8))}


def test_warc_of_one_gzip_member_a_record(spark, tmp_path):
    import gzip

    block = lambda i: b"payload %d" % i
    told = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode().encode()
    record = lambda i: b"WARC/1.1\r\nWARC-Type: resource\r\nX-Key: %d\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, told(block(i)), len(block(i)), block(i))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(5)))
    got = archives.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r["key"], bytes(r["payload"])) for r in got) == [(i, block(i)) for i in range(5)]


def test_balls_far_apart_do_not_meet(spark):
    rng = np.random.default_rng(5)
    centre = np.eye(16)[rng.integers(0, 16, 3000)]
    x = centre + rng.normal(scale=0.02, size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, 1, v.tolist(), 0) for i, v in enumerate(x)]
    units = spark.createDataFrame(rows, "node long, n long, unit array<double>, label int").withColumn("group", F.struct("label", F.size("unit").alias("dim"))).drop("label")
    pairs = cover_tree._pairs(units, 3000, 0.3742, 100, 64)
    assert pairs.select("node").distinct().count() == 3000
    assert pairs.count() < 3000 * 30 / 4  # of 30 cells


def test_small_labels_have_centres_too(spark):
    """A label of half a percent of the rows drops the balls that are far apart."""
    rng = np.random.default_rng(6)
    rows = []
    for label, n in ((0, 19_000), (1, 100)):
        x = (np.eye(16)[rng.integers(0, 16, n)] + rng.normal(scale=0.02, size=(n, 16))) if label else np.eye(16)[:1].repeat(n, 0) + rng.normal(scale=0.02, size=(n, 16))
        x /= np.linalg.norm(x, axis=1)[:, None]
        rows += [(len(rows) + i, 1, v.tolist(), label) for i, v in enumerate(x)]
    units = spark.createDataFrame(rows, "node long, n long, unit array<double>, label int").withColumn("group", F.struct("label", F.size("unit").alias("dim"))).drop("label")
    few = units.filter("group.label = 1")
    pairs = cover_tree._pairs(few.unionByName(units.filter("group.label = 0 and node % 19 = 0")), 19_100, 0.3742, 5, 64).filter("group.label = 1")
    assert pairs.select("node").distinct().count() == 100
    assert pairs.count() < 100 * 20 / 4  # of 20 cells


def test_files_of_archives_follow_bytes(spark, tmp_path):
    """Payloads of very unlike lengths: no file is longer than its bound by more than its last record."""
    lengths = [10] * 300 + [200_000, 3_000_000, 50, 0, 9_000_000] + [20_000] * 40
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " + "x" * n) for i, n in enumerate(lengths)], "page_id long, url string, html string").coalesce(1)
    arcs = archives.pages_to_arcs(pages, file_bytes=100_000)
    own = [[len(body) for *_, body in archives.parse_arc(r["content"])] for r in arcs.collect()]
    assert sum(map(len, own)) == len(lengths) and all(sum(x[:-1]) < 100_000 for x in own)
    path = str(tmp_path / "warc")
    archives.convert_archives(arcs, path, file_bytes=100_000)
    files = [gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".gz")]
    blocks = [[len(b) for _, b in archives.parse_warc(f)] for f in files]
    assert sum(map(len, blocks)) == len(lengths) and all(sum(x[:-1]) < 100_000 for x in blocks)
    back = {r["key"]: len(r["payload"]) for r in archives.read_warc(spark, path).collect()}
    assert back == {i: n + len(str(i)) + 1 for i, n in enumerate(lengths)}
