"""The WARC writer against its SQL, byte for byte against itself, and edge rows."""

import gzip
import hashlib
from base64 import b32encode
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, shard int, kind int, bytes long"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def told(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, url, html in rows:
        groups[(html or "").encode()].append((i is None, i, url is not None, url))
    out = Counter()
    for data, own in groups.items():
        digest = b32encode(hashlib.sha1(data).digest()).decode()
        own = sorted(own, key=lambda x: (x[0], x[1] or 0, x[2], x[3] or ""))
        for k, (_, i, _, _) in enumerate(own):
            first = k == 0 or len(data) < least
            out[i, len(data), digest, "response" if first else "revisit", None if first else own[0][1]] += 1
    return out


@pytest.mark.parametrize("size", ["small", "middle"])
def test_archive_equals_its_sql(spark, request, size):
    folder = request.getfixturevalue(size)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_warc']})").fetchall())
    assert told(queries.warc_query(spark, folder)) == want


def edge_rows():
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a b/é\r\nX: y", ""), (5, "u", "x" * 3_000_000), (6, "v", "x" * 3_000_000)]
    rows += [(2, "http://a/2", "<p>one</p>"), (1, "http://a/1", "<p>one</p>"), (1, "http://a/0", "<p>one</p>"), (None, "n", "only null ids"), (None, "n", "only null ids"), (None, "m", "<p>one</p>"), (None, None, None)]
    rows += [(-(2**62), "low", "far"), (2**62, "high", "far"), (7, "w", "\r\n\r\nWARC/1.1\r\n\x00é日本")]
    return rows + [(1000 + i, f"http://b/{i}", "copy" if i % 3 else f"page {i} " * 40) for i in range(300)] + [(77, f"z{i}", f"same id {i} " * 30) for i in range(200)]


def test_archive_of_edge_rows(spark, tmp_path):
    rows = edge_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    made = []
    for k, given in enumerate((df.repartition(7), df.orderBy(F.desc("url")).coalesce(2))):
        root = f"file://{tmp_path}/a{k}"
        listed = warc.write_archive(given, root, roll_bytes=3_000, shard_bytes=20_000).collect()
        assert told(warc.read_archive(spark, root)) == brute(rows)
        files = {p.name: p.read_bytes() for p in (tmp_path / f"a{k}").glob("*.warc.gz")}
        assert {r["name"]: r["sha256"] for r in listed} == {n: hashlib.sha256(b).hexdigest() for n, b in files.items()}
        assert sum(r["records"] for r in listed) == len(rows) and not (tmp_path / f"a{k}" / "tmp").exists()
        made.append(files)
    assert made[0] == made[1] and len(made[0]) > 30
    texts = b"".join(gzip.decompress(b) for _, b in sorted(made[0].items()))
    assert texts.count(b"WARC-Type: warcinfo") == len(made[0]) and texts.count(b"WARC-Record-ID:") == len(set(x.split(b"\r\n")[0] for x in texts.split(b"WARC-Record-ID: ")[1:]))
    with pytest.raises(FileExistsError):
        warc.write_archive(df.limit(3), f"file://{tmp_path}/a0")
    # Files are in order of page_id, and one page_id of many bytes is in several shards.
    tops = [(r["first_page"], r["last_page"]) for r in sorted(listed, key=lambda r: r["name"]) if r["first_page"] is not None]
    assert all(a[1] <= b[0] for a, b in zip(tops, tops[1:]))
    assert len({r["name"][:8] for r in listed if r["first_page"] == r["last_page"] == 77}) > 1
    back = {(r["page_id"], r["url"]): r["payload"] for r in warc.read_archive(spark, f"file://{tmp_path}/a0").filter("record_type = 'response'").collect()}
    assert back[7, "w"].decode() == "\r\n\r\nWARC/1.1\r\n\x00é日本"


def test_small_payloads_are_no_revisits_and_empty_tables_give_no_file(spark, tmp_path):
    rows = edge_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    root = f"file://{tmp_path}/b"
    warc.write_archive(df, root, min_revisit=5)
    assert told(warc.read_archive(spark, root)) == brute(rows, 5)
    root = f"file://{tmp_path}/c"
    assert warc.write_archive(df.limit(0), root).count() == 0 and warc.read_archive(spark, root).count() == 0
    assert not list((tmp_path / "c").glob("*.warc.gz"))


def test_a_damaged_file_and_a_repeated_rename(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    root = f"file://{tmp_path}/d"
    n = warc.write_archive(df, root, least_shards=2).count()
    warc.manifest(spark, root).write.parquet(f"{tmp_path}/again")
    (tmp_path / "d" / "manifest").rename(tmp_path / "d" / "old")
    # The job that renames, run again after it has done so.
    assert warc._publish(spark, spark.read.parquet(f"{tmp_path}/again"), root).count() == n
    assert warc.read_archive(spark, root).count() == 20
    name = next((tmp_path / "d").glob("*.warc.gz"))
    text = gzip.decompress(name.read_bytes()).replace(b"page 1", b"page 2", 1)
    name.write_bytes(gzip.compress(text))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, root).count()
