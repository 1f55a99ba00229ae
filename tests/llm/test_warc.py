import base64
import hashlib

import pytest
import zstandard
from pyarrow import fs

from antecede.llm import warc
from antecede.llm.store import shared_folder

PAGES = [(1, "http://a/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\ny", None), (4, "u", ""), (5, "v", "z" * 600_000), (6, "w", "line\r\n\r\nline"),
         (7, "w", "line\r\n\r\nline"), (7, "w", "line\r\n\r\nline"), (None, "n", "<p>é</p>"), (None, "n", "alone")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id bigint, url string, html string, id int, digest string").repartition(3)


def test_round_trip(spark, pages):
    folder = shared_folder(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index, folder).collect()
    smallest = {}
    for page, _, html in sorted((p for p in PAGES if p[0]), key=lambda p: p[0]):
        smallest.setdefault(html or "", page)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = smallest.get(html or "", page)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind = ("response", None) if page == first else ("revisit", first)
        want.append((page, len(data), digest, *kind, data if kind[0] == "response" else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)


def test_archives_are_plain_zstd_and_seekable(spark, pages):
    folder = shared_folder(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    store, path = warc._open(folder)
    names = [f for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".zst")]
    assert not [f for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith(".") and not f.base_name.endswith("crc")]
    records = 0
    for name in names:
        with store.open_input_file(name.path) as source:
            whole = zstandard.ZstdDecompressor().stream_reader(source.readall(), read_across_frames=True).read()
            reader = warc.BundleReader(source)
            assert b"".join(reader.frame(k) for k in range(len(reader.sizes))) == whole
        records += whole.count(b"WARC/1.1\r\n")
    assert records == len(PAGES)
    # one record by its offsets alone
    row = index.where("id = 6").first()
    with store.open_input_file(f"{path}/{row.archive}") as source:
        head, payload = warc.parse_record(warc.BundleReader(source).frame(row.frame)[row.offset:row.offset + row.length])
    assert head["WARC-Record-ID"] == "<urn:page:6>" and payload == b"line\r\n\r\nline"
    assert warc.read_records(index.where("id = 6"), folder).count() == 1


def test_empty_table(spark, pages):
    index, folder = warc.bundle(pages.where("false"))
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0
