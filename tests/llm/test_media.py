import hashlib
import io
import tarfile
import zlib

from tidemark.llm import media as M

TEXTS = ["", "a", "x" * 64, "x" * 65, "é🙂\n", "word " * 30_000, None, "a", "\x00" * 64]


def expected(text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_png_is_read_by_its_own_rules():
    for text in TEXTS:
        payload = M.payload_of(text or "")
        png = M.png_of(payload)
        assert M.samples_of(png) == payload and M.png_header(png[: M.HEADER]) == (64, len(payload) // 64, 8)


def test_columns(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "no key", "x"), (3, TEXTS[3], "x")], "doc_id long, text string, digest string")
    found = M.media_columns(docs, f"file://{tmp_path}/shards").collect()
    assert len(found) == len(TEXTS) + 2
    by = {r.doc_id: r for r in found}
    for k, t in enumerate(TEXTS):
        r = by[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(t) and r.payload_bytes == r.width * r.height
        raw = (tmp_path / "shards" / r.shard).read_bytes()[r.offset : r.offset + r.media_bytes]
        assert hashlib.sha256(raw).hexdigest() == r.media_sha256
    assert by[0].media_sha256 == by[6].media_sha256 and by[0].offset == by[6].offset and by[1].feature == by[7].feature
    # a task stores a digest once; of the places of several tasks all rows carry the same
    shards = {p.name: [m.name for m in tarfile.open(fileobj=io.BytesIO(p.read_bytes()))] for p in (tmp_path / "shards").glob("*.tar")}
    assert all(len(x) == len(set(x)) for x in shards.values())
    assert {x for names in shards.values() for x in names} == {r.payload_sha256 for r in found}
    assert len({(r.payload_sha256, r.shard, r.offset) for r in found}) == len({r.payload_sha256 for r in found})
    M.media_columns(docs.coalesce(1), f"file://{tmp_path}/one").collect()
    names = [m.name for p in (tmp_path / "one").glob("*.tar") for m in tarfile.open(fileobj=io.BytesIO(p.read_bytes()))]
    assert sorted(names) == sorted({r.payload_sha256 for r in found})


def test_documents_and_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in M.digest_columns(M.media_columns(docs)).collect()}
    assert found == {r.doc_id: expected(r.text) for r in docs.collect()}
    assert M.media_columns(docs.limit(0)).count() == 0


def test_many_copies_and_default_file_system(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'one text' ELSE concat('text ', id % 100) END AS text").repartition(7)
    found = M.media_columns(docs, f"{tmp_path}/plain").collect()
    assert len(found) == 20_000 and len(list((tmp_path / "plain").glob("*.tar"))) == 7
    assert {(r.doc_id, r.payload_sha256) for r in found} == {(k, expected("" if k % 3 == 0 else "one text" if k % 3 == 1 else f"text {k % 100}")[2]) for k in range(20_000)}


def test_places_that_are_forgotten(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, TEXTS[k % 4]) for k in range(40)], "doc_id long, text string").coalesce(1)
    plain = {r.doc_id: (r.payload_sha256, r.media_sha256, r.n_bytes) for r in M.media_columns(docs, f"file://{tmp_path}/b").collect()}
    monkeypatch.setattr(M, "KNOWN", 2)
    found = M.media_columns(docs, f"file://{tmp_path}/c").collect()
    assert {r.doc_id: (r.payload_sha256, r.media_sha256, r.n_bytes) for r in found} == plain
    assert len({(r.payload_sha256, r.shard, r.offset) for r in found}) == 4  # all rows of a payload carry one place
    members = [m for p in (tmp_path / "c").glob("*.tar") for m in tarfile.open(fileobj=io.BytesIO(p.read_bytes()))]
    assert len(members) > 4
