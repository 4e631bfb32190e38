import base64
import hashlib
import random
import zlib

import pytest

from palimpsest.llm import fingerprints as fp
from palimpsest.llm import warc


@pytest.mark.parametrize("range_bytes", [16 << 20, 2001])
def test_warc_round_trip(spark, small, tmp_path, range_bytes, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    extra = [(10**6, None, None), (10**6 + 1, "x\r\ny", ""), (None, "u", "only"), (None, None, "two"), (5000, "u", "two"), (4000, "u", "two"), (7, "z", "\x1f\x8b\x08" * 50), (8, "z", "é" * 200_000)]
    df = pages.unionAll(spark.createDataFrame(extra, pages.schema)).selectExpr("*", "1 AS sha", "2 AS first")
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    first = {}
    for i, h in rows:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = sorted(str((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first.get(h) == i else "revisit", None if first.get(h) == i else first.get(h))) for i, h in rows)
    got = warc.round_trip(df, f"file://{tmp_path}/a", range_bytes).collect()
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == want
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/b").count() == 0


def test_warc_passes_over_what_is_no_record(tmp_path):
    member = warc.record("1", "u", "response", None, warc.base32_sha1(b"abc"), b"abc")
    junk = zlib.compress(b"not a record", wbits=31)
    data = b"noise\x1f\x8b\x08noise" + junk + member + b"\x1f\x8b" + member
    path = tmp_path / "x.gz"
    path.write_bytes(data)
    import pyarrow as pa

    starts = []
    for lo in range(0, len(data), 7):
        with pa.OSFile(str(path)) as f:
            starts += [at for _, at in warc.owned(warc.Window(f, lo, len(data)), lo, min(len(data), lo + 7))]
    assert starts == [data.index(member), data.rindex(member)]
    assert warc.parsed(warc.member(warc.Window(pa.OSFile(str(path)), starts[0], len(data)), starts[0])[0])[-2:] == (b"abc", None)


@pytest.mark.parametrize("rows", [20_000, 30])
def test_edits_against_brute_force(spark, small, rows, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").selectExpr("*", "1 AS range", "2 AS ahead")
    texts = sorted((r["doc_id"], r["text"]) for r in df.collect())
    got = {r["doc_id"]: r for r in fp.with_edits(df).collect()}
    assert len(got) == len(texts)
    for i, (k, x) in enumerate(texts):
        y = texts[(i + 1) % len(texts)][1]
        half = len(x) // 2
        e = x[: len(x) - half] + y[:half]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(x), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(x), fp.fingerprint(e))
        assert 0 <= r["near_next"] <= 1 and r["near_edited"] == fp.likeness(r["fingerprint"], r["edited_fingerprint"])
    long = [r for r in got.values() if r["n_chars"] > 3000]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.35 > 0.05 > sum(r["near_next"] for r in long) / len(long)


def test_trees():
    rng = random.Random(2)
    for _ in range(200):
        x = "".join(rng.choice("ab \n.") for _ in range(rng.randint(0, 400)))
        assert "\n".join("".join(fp.pieces(line)) for line in x.split("\n")) == x
        assert (fp.fingerprint(x) == fp.fingerprint(x + "a")) is False and fp.likeness(fp.fingerprint(x), fp.fingerprint(x)) == 1
    f = fp.fingerprint
    assert fp.differing(f("a b\nc d\ne f"), f("a b\nc x\ne f")) == [(0, 1, 0)] and fp.differing(f("a"), f("a")) == []
    x = "\n".join(f"line {i} " + " ".join(f"w{i}x{k}" for k in range(60)) for i in range(50))
    assert {(i, j) for i, j, _ in fp.differing(f(x), f(x.replace("w40x30", "new")))} == {(40 // fp.SECTION, 40 % fp.SECTION)}


def plain_tree(text):
    """The tree by its description alone: sections of paragraphs of (digest, characters)."""
    sections, now = [], []
    for line in text.split("\n"):
        if now and (line == "" or len(now) == 16):
            sections.append(now)
            now = []
        words, cut, out = line.split(" "), [], []
        for i, w in enumerate(words):
            cut.append(w)
            last = i == len(words) - 1
            if not last and len(words) > 16 and ((zlib.crc32(w.encode()) % 8 == 0 and len(cut) >= 8) or len(cut) == 48):
                out.append(" ".join(cut) + " ")
                cut = []
        out.append(" ".join(cut))
        now.append([(hashlib.blake2b(p.encode(), digest_size=16).digest(), len(p)) for p in out])
    return [*sections, now]


def plain_fingerprint(text):
    h = lambda kind, parts: hashlib.blake2b(kind + b"".join(parts), digest_size=16).digest()
    node = lambda d, n: d.hex()[:8] + "." + hex(n)[2:]
    secs, marks = [], []
    for s in plain_tree(text):
        ps = [(h(b"paragraph", [d for d, _ in p]), sum(n for _, n in p), p) for p in s]
        marks.append(h(b"section", [d for d, _, _ in ps]))
        secs.append(node(marks[-1], sum(n for _, n, _ in ps)) + "=" + ";".join(node(*p[0]) if len(p) == 1 else node(d, n) + "[" + ",".join(node(*x) for x in p) + "]" for d, n, p in ps))
    return h(b"root", marks).hex() + ":" + "/".join(secs)


def plain_likeness(x, y):
    """Characters in common branches by taking sections, then paragraphs, then pieces out of both lists."""
    if plain_fingerprint(x) == plain_fingerprint(y):
        return 1.0
    level = [[(str(s), sum(n for p in s for _, n in p), s) for s in plain_tree(t)] for t in (x, y)]
    total, shared = sum(n for side in level for _, n, _ in side), 0
    for depth in range(3):
        a, b = level
        for item in list(a):
            twin = next((o for o in b if o[0] == item[0]), None)
            if twin:
                shared += item[1]
                a.remove(item)
                b.remove(twin)
        if depth < 2:
            level = [[(str(c), n if depth else sum(m for _, m in c), c) for _, _, inner in side for c, n in ((c, c[1] if depth else 0) for c in inner)] for side in (a, b)]
    return 2 * shared / max(1, total)


def test_fingerprints_against_a_plain_tree(small, spark):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()][:80] + ["", "\n", "a\n\nb", "x " * 5000]
    for x, y in zip(texts, texts[1:], strict=False):
        e = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        for other in (y, e, x):
            assert fp.fingerprint(other) == plain_fingerprint(other)
            assert fp.likeness(fp.fingerprint(x), fp.fingerprint(other)) == pytest.approx(plain_likeness(x, other), abs=1e-6)


def test_warc_faults_are_told_and_end_nothing(spark, tmp_path):
    good = warc.record("1", "u", "response", None, warc.base32_sha1(b"abc"), b"abc")
    raw = zlib.decompress(good, wbits=31)
    bad = [raw.replace(b"abc", b"abd"), raw.replace(b"Content-Length: ", b"Content-Length: x"), raw.replace(b"http; msgtype=response\r\nContent-Length: ", b"http; msgtype=response\r\nContent-Length: 9")]
    data = b"".join([good, *[(lambda z: z.compress(x) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31)) for x in bad], good])
    (tmp_path / "x.warc.gz").write_bytes(data)
    got = warc.read(spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "path string, bytes long")).collect()
    assert sorted((str(r["fault"]), r["payload"] is None) for r in got) == [("None", False), ("None", False), ("digest", True), ("length", True), ("length", True)]


def test_edits_with_nulls_ties_and_few_rows(spark):
    kind = "doc_id long, text string"
    rows = fp.with_edits(spark.createDataFrame([(None, "ab"), (None, None), (3, "bcd"), (3, "aaaa")], kind)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted((k, n, hashlib.sha256(e.encode()).hexdigest()) for k, n, e in [("None", 0, ""), ("None", 2, "aa"), ("3", 4, "aabc"), ("3", 3, "bc")])
    assert fp.with_edits(spark.createDataFrame([(1, "xy")], kind)).first()["edited_sha256"] == hashlib.sha256(b"xx").hexdigest()
    assert fp.with_edits(spark.createDataFrame([], kind)).count() == 0


def test_warc_headers_of_any_length(spark, tmp_path):
    url = base64.b64encode(random.Random(1).randbytes(120_000)).decode()
    df = spark.createDataFrame([(1, url, "<p>a"), (2, "short", "<p>b")], "page_id long, url string, html string")
    assert {r["page_id"] for r in warc.round_trip(df, f"file://{tmp_path}/a").collect()} == {1, 2}
    made = warc.write(warc.records(df), f"file://{tmp_path}/b")
    assert {r["uri"] for r in warc.read(made).collect()} == {url, "short"}
    with pytest.raises(ValueError, match="1 records were read of 2"):
        warc.complete(warc.read(made).limit(1), made)
