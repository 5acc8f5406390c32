import gzip
import random
import zlib

import pytest
from stratalith.llm.shared import written
from stratalith.llm.warc import base32_sha1, export, normalise, normalised, parse, read, record, records, write

KIND = "page_id bigint, url string, html string, words string"


def fixture():
    rnd = random.Random(4)
    pages = [(i, f"http://h{i}.example/é \r\n{i}", rnd.choice(["same", "same too", f"<p>own {i} 漢</p>\r\n\r\n", "", None, "x" * 20_000]), "w") for i in range(120)]
    return pages + [(200, None, "same", None), (None, None, None, None), (None, "u", "alone", None), (119, "twice", "same", None), (119, "twice", "same", None), (300, "http://long.example/", "".join(chr(rnd.randrange(32, 126)) for _ in range(400_000)), None)]


def brute(pages, least):
    out = []
    for page, _, html, _ in pages:
        payload = (html or "").encode()
        ids = [p for p, _, h, _ in pages if (h or "").encode() == payload and p is not None]
        to = max(ids) if ids and len(payload) >= least and page != max(ids) else None
        out.append((page, len(payload), base32_sha1(payload), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = fixture()
    archives = written(spark, write(spark.createDataFrame(pages, KIND), least, 30_000), "w")
    own = normalised(archives)
    assert sorted(map(tuple, read(own).collect()), key=str) == brute(pages, least)
    for r in read(own, payloads=True).where("record_type = 'response'").collect():
        assert base32_sha1(bytes(r["payload"])) == r["payload_digest"]
    for r in own.collect():
        assert gzip.decompress(bytes(r["content"])) == gzip.decompress(bytes(archives.where(f"archive = '{r['archive']}'").first()["content"]))


def test_normalise_reads_members_and_whole_streams_in_any_pieces():
    all_records = [record(i, "u", b"p" * i + b"\r\n\r\n", None if i % 2 else 7) for i in range(40)]
    whole = gzip.compress(b"".join(all_records))
    members = b"".join(map(gzip.compress, all_records))
    for data in (whole, members):
        for size in (1, 7, 1 << 20):
            made = list(normalise(data[i : i + size] for i in range(0, len(data), size)))
            joined = b"".join(m for m, _, _ in made)
            assert [zlib.decompress(joined[at : at + len(m)], 31) for m, _, at in made] == all_records
            assert [parse(m)["page_id"] for m, _, _ in made] == list(range(40))


def test_truncated_archives_are_errors():
    data = gzip.compress(record(1, "u", b"x" * 100, None))
    with pytest.raises(ValueError):
        list(records([data[:-12]]))
    with pytest.raises(ValueError):
        list(records([gzip.compress(record(1, "u", b"x" * 100, None)[:-10])]))


def test_export_and_empty_table(spark, tmp_path):
    own = normalised(write(spark.createDataFrame(fixture()[:5], KIND)))
    assert sum(r["records"] for r in export(own, str(tmp_path / "a")).collect()) == 5
    assert len(list((tmp_path / "a").glob("*.warc.gz"))) == len(list((tmp_path / "a").glob("*.idx"))) >= 1
    assert read(normalised(write(spark.createDataFrame([], KIND)))).count() == 0
