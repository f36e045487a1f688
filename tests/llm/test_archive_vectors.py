import gzip
import hashlib
import math

import numpy as np
import pytest

from docquarry.llm import embedding_dedup, warc
from docquarry.llm.common import shared_dir


def check_archive(spark, rows, tmp):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, digest string")
    warc.write_archive(df, tmp)
    got = warc.read_archive(spark, tmp).collect()
    assert len(got) == len(rows)
    by = {}
    for i, _, html in rows:
        by.setdefault(html or "", []).append(i)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        holder = max((x for x in by[html or ""] if x is not None), default=None)
        revisit = len(raw) >= 1000 and holder is not None and i != holder
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(holder if revisit else None)))
    assert sorted(want) == sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got)
    assert sorted((str(i), h or "") for i, _, h in rows) == sorted((str(r["page_id"]), bytes(r["payload"]).decode()) for r in got)
    return got


def test_archive(spark, tmp_path):
    big, small = "<p>" + "ä" * 800, "<p>small"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, small), (4, "u", small), (5, "u\r\nx: y", None), (6, "", ""), (None, "n", big), (7, "v", big + "!"), (2, "http://b", big), (None, "w", "q" * 2000)]
    got = check_archive(spark, rows, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({h or "" for _, _, h in rows})
    for r in got:
        assert f"Content-Length: {len(r['http_head']) + (len(r['payload']) if r['record_type'] == 'response' else 0)}".encode() in bytes(r["warc_head"])
    check_archive(spark, [], str(tmp_path / "b"))
    # the files are WARC: records follow each other by their lengths
    warc.export_warc(warc.read_archive(spark, str(tmp_path / "a")), str(tmp_path / "files"))
    n = 0
    for f in (tmp_path / "files").glob("part-*"):
        data = f.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            size = int(head.rpartition(b"Content-Length: ")[2])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            data, n = rest[size + 4 :], n + 1
    assert n == len(rows)


def test_foreign_files(spark, tmp_path):
    def record(kind, mime, block, extra=b""):
        return b"WARC/1.0\r\nWARC-Type: %s\r\n%scontent-length:%d\r\nContent-Type: %s\r\n\r\n%s\r\n\r\n" % (kind, extra, len(block), mime, block)

    http = b"HTTP/1.1 200 OK\r\nX: \xff\r\n\r\n"
    body = b"a\r\n\r\nWARC/1.0\r\n\xfe" * 100
    records = [record(b"warcinfo", b"application/warc-fields", b"software: x\r\n\r\n"), record(b"response", b"application/http", http + body), record(b"response", b"application/http; msgtype=response", http + body, b"X-More:  odd \r\n"), record(b"revisit", b"application/http", http), record(b"response", b"application/http", b"no header"), record(b"metadata", b"text/plain", b"")]
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.warc").write_bytes(b"".join(records))
    (at / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (at / "empty.warc").write_bytes(b"")
    warc.archive_records(warc.read_warc(spark, str(at)), str(tmp_path / "kept"))
    files = {}
    for r in sorted(warc.restore_records(spark, str(tmp_path / "kept")).collect(), key=lambda r: r["nth"]):
        name = r["file"].rpartition("/")[2]
        files[name] = files.get(name, b"") + bytes(r["warc_head"]) + bytes(r["http_head"]) + bytes(r["payload"]) + b"\r\n\r\n"
    assert files == {"a.warc": b"".join(records), "b.warc.gz": b"".join(records)}
    assert spark.read.parquet(str(tmp_path / "kept/payloads")).count() == 4  # the fields, the body, nothing, "no header"
    for damaged in (records[1][:-5], b"x" + records[1], records[1].replace(b"length:", b"size:")):
        with pytest.raises(ValueError, match="WARC record"):
            warc.split_records(damaged)


def test_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "one"), (2, "v", "two")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    store = spark.read.parquet(str(tmp_path / "a/payloads"))
    other = store.orderBy("digest").collect()
    swapped = [(other[0]["digest"], other[0]["size"], other[1]["zbytes"], 1), (other[1]["digest"], other[1]["size"], other[0]["zbytes"], 2)]
    spark.createDataFrame(swapped, store.schema).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def brute(rows):
    ok = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / math.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.95:
                links[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        c = None if i is None else min(rows[x][0] for x in seen)
        out.append((str(i), len(links[k]), str(c), i == c))
    return sorted(out)


@pytest.mark.parametrize("block", [512, 4])
def test_vectors(spark, block):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 16))
    rows = [(k, [float(np.float32(x)) for x in centre[k % 12] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])]) for k in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [float(np.float32(2 * x)) for x in rows[4][1]])]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [None] * 16), (304, [float("nan")] * 16), (305, [1.0, 2.0]), (306, [1.0, 2.0]), (None, rows[3][1]), (None, None), (200, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, size int, code string")
    got = embedding_dedup.near_vectors(df, block=block).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == brute(rows)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    assert embedding_dedup.near_vectors(df.withColumn("embedding", df["embedding"].cast("array<double>"))).count() == len(rows)


def test_vectors_of_one_id(spark):
    """One id may have several vectors: each row counts its own links."""
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 0.01]), (8, [0.01, 1.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == brute(rows)
    assert all(r["n_links"] == 1 for r in got)


def test_shared_dir_is_set(spark):
    assert shared_dir(spark)
