import gzip
import hashlib
from pathlib import Path

from paysift.llm.warc import archive_pages, digests, read_archives

BIG = "<p>" + "é漢x" * 60_000 + "</p>"
PAGES = [(1, "u1", "a" * 100), (2, "u2", "a" * 100), (3, "u3", "a" * 99), (4, "u4", "a" * 99), (5, None, None), (6, "u6", ""), (7, "u7", BIG), (8, "u8", BIG), (9, "u 9\r\nX: y", "WARC/1.1\r\n\r\n" * 20), (None, "n", "b" * 200), (None, "n", "a" * 100), (2, "u2", "a" * 100), (1, "u1", "a" * 100)]


def frame(spark):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in PAGES], "page_id long, url string, html string, digest string, salt int")


def test_round_trip(spark):
    got = sorted(digests(archive_pages(frame(spark))).collect(), key=str)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        same = [j for j, _, g in PAGES if (g or "").encode() == raw and j is not None]
        first = min(same, default=None)
        revisit = len(raw) >= 100 and first is not None and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)


def test_chunks_are_the_payload(spark):
    rows = read_archives(archive_pages(frame(spark))).collect()
    for page, _, html in PAGES:
        mine = sorted((r for r in rows if r.page_id == page and r.record_type == "response" and page in (1, 7, 9)), key=lambda r: r.chunk_no)
        if page == 7:
            assert len(mine) > 4 and b"".join(r.chunk for r in mine) == html.encode()
            so_far = hashlib.sha256()
            for r in mine:
                so_far.update(r.chunk)
                assert r.running_sha256 == so_far.hexdigest() and len(r.chunk) <= 1 << 16
            assert [r.last for r in mine] == [False] * (len(mine) - 1) + [True]


def test_files_are_gzip_members(spark, tmp_path):
    files = archive_pages(frame(spark), str(tmp_path / "w")).collect()
    text = b"".join(gzip.decompress(Path(f.path).read_bytes()) for f in files)
    assert text.count(b"WARC-Record-ID: <urn:uuid:") == len(PAGES) == sum(f.records for f in files)
    assert b"WARC-Target-URI: u9X:y\r\n" in text


def test_nothing(spark):
    assert digests(archive_pages(frame(spark).where("false"))).count() == 0


def test_each_file_is_read_by_a_task(spark):
    pages = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 100) AS html")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = archive_pages(pages)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = files.count()
    assert n > 1 and read_archives(files).rdd.getNumPartitions() == n


def test_large_payloads_take_linear_time():
    """4, 16 and 64 MB through the chunker and the stream reader: four times the bytes, well under eight times the seconds."""
    import time

    import pyarrow as pa

    from paysift.llm import warc

    def seconds(megabytes):
        column = pa.array(["é<p>x " * (megabytes << 17)])
        began = time.perf_counter()
        (payload,) = warc._views(column)
        so_far = hashlib.sha256()
        for at in range(0, len(payload), warc.CHUNK):
            so_far.update(payload[at : at + warc.CHUNK])
        source = warc._Members(pa.BufferReader(gzip.compress(payload, 1)))
        while source.read(warc.CHUNK):
            pass
        return time.perf_counter() - began

    seconds(4)
    small, large = min(seconds(4) for _ in range(3)), seconds(64)
    assert large < 40 * small + 0.5


def test_one_large_page(spark):
    pages = spark.range(2).selectExpr("id AS page_id", "'u' AS url", "repeat('0123456789abcdeé', 1000000) AS html")
    got = sorted(tuple(r) for r in digests(archive_pages(pages)).collect())
    raw = ("0123456789abcdeé" * 1_000_000).encode()
    assert got == [(0, len(raw), hashlib.sha256(raw).hexdigest(), "response", None), (1, len(raw), hashlib.sha256(raw).hexdigest(), "revisit", 0)]
