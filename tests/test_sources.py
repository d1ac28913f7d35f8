import gzip
import io
import json
import zipfile

from grammarlens.sources import lists, submissions, warc


def record(kind, body, extra=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()


def test_archives(spark, tmp_path):
    links = {"Envelope": {"Payload-Metadata": {"HTTP-Response-Metadata": {"HTML-Metadata": {"Links": [{"url": "http://a/"}, {"url": "/é"}, {"path": "x"}]}}}}}
    content = record("warcinfo", "WARC/ not a record") + record("metadata", json.dumps(links), "WARC-Target-URI: http://p/\r\n") + b"noise\r\n" + record("metadata", "{broken") + record("response", json.dumps(links))
    (tmp_path / "a.wat.gz").write_bytes(gzip.compress(content))
    (tmp_path / "b.warc").write_bytes(content + b"WARC/1.0\r\nContent-Length: x\r\n\r\n")
    got = warc.read_warc(spark, [str(tmp_path / "*")])
    assert {(r.path.rsplit("/", 1)[1], r.kind) for r in got.collect()} == {("a.wat.gz", k) for k in ("warcinfo", "metadata", "response")} | {("b.warc", k) for k in ("warcinfo", "metadata", "response", None)}
    assert got.count() == 9
    assert sorted(r.uri for r in warc.outlinks(got).collect()) == ["/é", "/é", "http://a/", "http://a/"]
    assert [r.uri for r in lists.read_uris(spark, [str(tmp_path / "b.warc")], "warc").collect()] == ["http://p/"]
    assert lists.read_uris(spark, [str(tmp_path / "a.wat.gz")], "wat").count() == 2
    assert warc.read_warc(spark, [str(tmp_path / "none*")]).count() == 0


def test_submissions(spark, tmp_path):
    good = {"schema_version": 1, "grammar": "g", "kind": "uri", "submitter": "s", "rationale": "r"}

    def archive(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
        return out.getvalue()

    lines = {"corpus/uris.txt": "# x\nhttp://a\n\n b:c \n"}
    cases = {
        "good": (archive({"submission.json": json.dumps(good), **lines}), None),
        "zip": (b"no", "no archive"),
        "none": (archive(lines), "no manifest"),
        "json": (archive({"submission.json": "{", **lines}), "manifest isn't JSON"),
        "more": (archive({"submission.json": json.dumps(good | {"x": 1}), **lines}), "manifest has other fields"),
        "value": (archive({"submission.json": json.dumps(good | {"kind": "z"}), **lines}), "manifest has a bad value"),
        "list": (archive({"submission.json": json.dumps(good)}), "no corpus/uris.txt"),
        "empty": (archive({"submission.json": json.dumps(good), "corpus/uris.txt": "# x"}), "corpus/uris.txt is empty"),
    }
    for name, (content, _) in cases.items():
        (tmp_path / f"{name}.zip").write_bytes(content)
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in submissions.read_submissions(spark, str(tmp_path)).collect()}
    assert {k: r.problem for k, r in got.items()} == {k: p for k, (_, p) in cases.items()}
    assert got["good"].lines == ["http://a", "b:c"]
