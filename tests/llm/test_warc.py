import base64
import gzip
import hashlib
import random
import zlib

from loamgraph.llm import warc
from loamgraph.llm.warc import END, archive_pages, arc_records, arc_to_records, pages_to_arc, read_warc, warc_records, with_record_type, write_warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (7, "http://a/ x", "<p>é</p>"),
    (3, "http://b", "<p>é</p>"),
    (5, None, None),
    (9, "", ""),
    (1, "http://c", "a\r\n\r\nWARC/1.1\r\n\r\nhttp://x 0 0 0 5\n"),
    (None, "http://d", "<p>é</p>"),
    (2, "http://e", "x" * 300_000),
    (8, "http://e", "x" * 300_000),
    (3, "http://b", "<p>é</p>"),
    (None, "http://f", "only null ids"),
]


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        head = first.get(html or "")
        again = head is not None and i != head
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if again else "response", head if again else None))
    return sorted(out, key=repr)


def test_round_trip_against_brute_force(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    got = sorted((tuple(r) for r in archive_pages(pages, str(tmp_path / "w")).collect()), key=repr)
    assert got == brute(ROWS)
    payloads = {r.page_id: bytes(r.payload).decode() for r in read_warc(spark, str(tmp_path / "w")).collect() if r.payload is not None}
    assert payloads[1] == ROWS[4][2] and payloads[2] == ROWS[6][2]


def test_files_are_whole_warc_records(spark, tmp_path):
    archive_pages(spark.createDataFrame(ROWS, PAGES), str(tmp_path / "w"))
    files = [f.read_bytes() for f in (tmp_path / "w").rglob("part-*")]
    records = [r for f in files for r in warc_records(gzip.decompress(f))]
    heads = [h for h, _, _ in records if b"WARC-Type: warcinfo" not in h]
    assert len(heads) == len(ROWS) and all(e is None for _, _, e in records)
    assert all(h.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"WARC-Record-ID: <urn:uuid:" in h for h in heads)


def members(content):
    """Each gzip member by itself, as a reader that seeks finds them."""
    while content:
        one = zlib.decompressobj(31)
        yield one.decompress(content)
        content = one.unused_data


def test_each_record_is_a_member_and_files_are_bounded(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdefgh", k=5000))) for i in range(40)]
    records = with_record_type(arc_to_records(pages_to_arc(spark.createDataFrame(rows, PAGES).coalesce(1))))
    write_warc(records, str(tmp_path / "w"), 20_000)
    files = [list(members(f.read_bytes())) for f in (tmp_path / "w").rglob("part-*")]
    assert len(files) > 4 and all(f[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for f in files)
    assert all(sum(map(len, f)) < 80_000 for f in files)
    assert all(m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n") and m.count(b"WARC-Record-ID") == 1 for f in files for m in f)
    assert sum(b"WARC-Type: response" in m for f in files for m in f) == 40


def test_a_member_of_any_size_ends_with_a_zero():
    for size in (0, 10, (16 << 20) + 5):
        packed = warc._member([("WARC-Type", "x")], b"y" * size)
        assert packed[-1] == 0 and len(gzip.decompress(packed)) > size


def test_both_arc_versions(spark):
    archives = pages_to_arc(spark.createDataFrame(ROWS, PAGES).coalesce(1), archive_bytes=200)
    contents = [bytes(r.content) for r in archives.collect()]
    fields = {len(r.fields) for c in contents for r in arc_records(c) if not r.fields["URL"].startswith("filedesc:")}
    assert fields == {5, 10}
    rows = arc_to_records(archives).where("kind = 'response'").collect()
    assert len(rows) == len(ROWS) and {r.warc_date for r in rows} == {"2026-01-01T00:00:00Z"}


def arc(*records, fields="URL IP-address Archive-date Content-type Archive-length"):
    block = f"1 0 Old Crawler\n{fields}\n\n".encode()
    out = b"filedesc://f.arc 0.0.0.0 19970101000000 text/plain %d\n" % len(block) + block + b"\n"
    for line, body in records:
        out += (line if line.endswith(b"!") else line + b" %d" % len(body)) + b"\n" + body + b"\n"
    return out


def converted(spark, *contents):
    return arc_to_records(spark.createDataFrame([("f.arc", bytes(c)) for c in contents], "path string, content binary"))


def test_foreign_arc(spark):
    body = b"HTTP/1.0 200 OK\r\nContent-Type: image/gif\r\n\r\n\xff\xfe\n\n"
    content = gzip.compress(arc((b"http://h/ 1.2.3.4 19970203040506 image/gif", body)))
    row = converted(spark, content).where("kind = 'response'").first()
    assert (row.url, row.ip, row.warc_date, bytes(row.payload)) == ("http://h/", "1.2.3.4", "1997-02-03T04:05:06Z", b"\xff\xfe\n\n")
    # a gzip stream that breaks off gives what can be read of it
    kinds = {r.kind for r in converted(spark, content[:-20]).collect()}
    assert kinds <= {"warcinfo", "response", "rejected"} and "warcinfo" in kinds


def test_records_of_other_kinds(spark):
    http = b"HTTP/1.0 200 OK\nX: \xe9\n\nbody"
    content = arc(
        (b"dns:h 1.2.3.4 19970203040506 text/dns", b"19970203\nh. 5 IN A 1.2.3.4\n"),
        (b"http://h/a b c 1.2.3.4 202001011234 text/html", http),
        (b"http://h/x 1.2.3.4 99999999999999 text/html", http),
        (b"http://h/d 1.2.3.4 19970203 text/html", b"HTTP/1.1 200 OK\r\nno end"),
    )
    rows = {r.url: r for r in converted(spark, content).collect()}
    dns, spaced = rows["dns:h"], rows["http://h/a b c"]
    assert (dns.kind, dns.content_type, bytes(dns.http_head)) == ("resource", "text/dns", b"")
    assert (spaced.warc_date, bytes(spaced.http_head), bytes(spaced.payload)) == ("2020-01-01T12:34:00Z", http[:-4], b"body")
    assert rows["http://h/x"].kind == "rejected" and "no date" in rows["http://h/x"].error
    assert rows["http://h/d"].warc_date == "1997-02-03T00:00:00Z" and rows["filedesc://f.arc"].kind == "warcinfo"


def test_bad_records_are_set_aside_and_the_job_goes_on(spark, tmp_path):
    good = lambda n: (b"http://h/%d 1.2.3.4 19970203040506 text/html" % n, b"HTTP/1.0 200 OK\r\nX-Page-Id: %d\r\n\r\nbody %d" % (n, n))
    bad = arc(good(1), (b"http://h/bad 1.2.3.4 19970203040506 text/html x!", b"some\nlines\n"), good(2), (b"http://short 5", b"12345"), good(3))[:-3]
    rows = converted(spark, bad, arc(good(4)))
    assert sorted(r.page_id for r in rows.where("kind = 'response'").collect()) == [1, 2, 4]
    assert sorted(r.error.split(":")[0] for r in rows.where("error is not null").collect()) == ["header line unlike the version block", "no length in the header line", "record ends before its 39 bytes"]
    write_warc(with_record_type(rows), str(tmp_path / "w"))
    assert sorted(r.page_id for r in read_warc(spark, str(tmp_path / "w")).collect()) == [1, 2, 4]


def test_heads_go_through_byte_for_byte_and_sizes_do_not_come_from_them(spark, tmp_path):
    """Content-Length is wrong in one head and missing in the other; the second payload is a revisit."""
    heads = [b"HTTP/1.0 200 OK\r\nX-Page-Id: 1\r\nContent-Length: 99\r\nX: \xe9\r\n\r\n", b"HTTP/1.0 200 OK\nX-Page-Id: 2\n\n"]
    rows = with_record_type(converted(spark, arc(*((b"http://h/%d 1.2.3.4 19970203040506 text/html" % n, h + b"body") for n, h in enumerate(heads)))))
    write_warc(rows, str(tmp_path / "w"))
    back = {r.page_id: r for r in read_warc(spark, str(tmp_path / "w")).collect()}
    assert (back[1].record_type, back[1].payload_bytes, back[2].record_type, back[2].payload_bytes) == ("response", 4, "revisit", None)
    assert back[2].refers_to == back[1].record_id
    content = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").rglob("part-*"))
    assert all(h in content for h in heads)


def test_broken_warc_records_are_told(spark, tmp_path):
    one = gzip.decompress(warc._member([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Payload-Digest", "sha1:X")], b"HTTP/1.0 200 OK\r\n\r\nbody"))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a").write_bytes(b"junk" + END.encode() + one + one[:-10])
    errors = sorted(r.error.split()[0] for r in read_warc(spark, str(tmp_path / "w")).collect())
    assert errors == ["no", "payload", "record"]


def test_digests_that_are_many_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    got = sorted((tuple(r) for r in archive_pages(spark.createDataFrame(ROWS, PAGES), str(tmp_path / "w")).collect()), key=repr)
    assert got == brute(ROWS)


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    got = {r.page_id: (r.record_type, r.refers_to) for r in archive_pages(pages, str(tmp_path / "w"), 4).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_no_pages_and_clashing_columns(spark, tmp_path):
    assert archive_pages(spark.createDataFrame([], PAGES), str(tmp_path / "a")).count() == 0
    clash = spark.createDataFrame([(1, "u", "x", 2, "y")], PAGES + ", payload_bytes int, content string")
    assert archive_pages(clash, str(tmp_path / "b")).count() == 1


def test_pages_named_like_version_blocks_are_pages(spark, tmp_path):
    rows = [(1, "http://a", "<p>a</p>"), (2, "filedesc://x", "<p>b</p>"), (3, "filedesc://", "2 0 x\nA B\n"), (4, "http://b", "<p>a</p>")]
    got = sorted((tuple(r) for r in archive_pages(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w")).collect()), key=repr)
    assert got == brute(rows)


def test_version_blocks_with_odd_fields_are_set_aside(spark):
    record = (b"http://h/a 1.2.3.4 19970203040506 text/html", b"hello")
    for odd in ("Name Size", "IP-address URL Archive-length", "URL", "URL URL Archive-length"):
        rows = {r.url: r for r in converted(spark, arc(record, fields=odd)).collect()}
        assert rows["filedesc://f.arc"].kind == "rejected" and "version block" in rows["filedesc://f.arc"].error
        assert rows["http://h/a"].kind == "resource" and bytes(rows["http://h/a"].payload) == b"hello"
    again = {r.url: r.kind for r in converted(spark, arc(record) + arc((b"http://h/b" + record[0][10:], b"hello"))).collect()}
    assert again == {"filedesc://f.arc": "resource", "http://h/a": "resource", "http://h/b": "resource"}
