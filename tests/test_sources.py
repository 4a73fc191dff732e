import io
import os
import zipfile

import pytest

from siftline.operators import search
from siftline.operators.replace import replaced
from siftline.sinks.rows import write_back
from siftline.sources import decode, extract, files, ignore
from siftline.spec import SearchSpec, SpecError


@pytest.mark.parametrize(
    "rules, path, want",
    [("*.log", "a/b.log", True), ("/b.log", "a/b.log", False), ("a/", "a/b.log", True), ("*.log\n!keep.log", "keep.log", False), ("a/\n!a/b.log", "a/b.log", True), ("a/**/z", "a/x/y/z", True), ("# c\n\n", "# c", False), ("x/*.c", "x/y/a.c", False), ("**/tmp", "q/tmp/f", True), ("[ab].t", "b.t", True)],
)
def test_ignore_rules(rules, path, want):
    assert ignore.ignored_in([path], {"": rules})[path] is want


def test_inner_rules_override():
    files_ = {"": "*.log", "a": "!*.log"}
    assert ignore.ignored_in(["x.log", "a/x.log"], files_) == {"x.log": True, "a/x.log": False}


def test_decoding():
    assert decode.decoded(b"\xef\xbb\xbfx") == ("x", "UTF-8 BOM")
    assert decode.decoded("é".encode("utf-16-le")) [1] in ("UTF-8", "windows-1252")
    assert decode.decoded(b"\xff\xfe" + "é".encode("utf-16-le")) == ("é", "UTF-16 LE")
    assert decode.decoded(b"\xfe\xff" + "é".encode("utf-16-be")) == ("é", "UTF-16 BE")
    assert decode.decoded(b"caf\xe9") == ("café", "windows-1252")
    assert decode.decoded(b"\xff\xfe\x00\x00x")[1] == "UTF-32 LE"
    for label in ("UTF-8", "UTF-8 BOM", "UTF-16 LE", "UTF-16 BE", "windows-1252"):
        assert decode.decoded(decode.encoded("é", label)) == ("é", label)
    assert decode.encoded("€✓", "windows-1252") == b"\x80&#10003;"
    with pytest.raises(ValueError):
        decode.encoded("x", "UTF-32 LE")


def zipped(**entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return b.getvalue()


def test_rich_text_of_any_character():
    assert extract.extracted("rtf", rb"{\rtf1\uc0 \u-10179 \u-8704 \u233 \u-10179 x}") == "\U0001f600é\ufffdx"
    for text in ("été 日本 \U0001f600", "a\\{b}\r\n\tc\x01", "\U0010ffff\uffff1 2", ""):
        assert extract.extracted("rtf", extract.rich_text_of(text).encode("ascii")) == text



def test_extractors():
    assert extract.extracted("docx", zipped(word__document_dot_xml="<a><b>x &amp; y</b><c>z</c></a>")) == "x & y z \n"
    assert extract.extracted("docx", zipped(other="")) == ""
    slides = zipped(ppt__slides__slide10_dot_xml="<a>ten</a>", ppt__slides__slide2_dot_xml="<a>two</a>")
    assert extract.extracted("pptx", slides) == "ten \ntwo \n"
    assert "--- a.txt ---\nhello" in extract.extracted("zip", zipped(a_dot_txt="hello", b_dot_bin="no"))
    assert extract.extracted("rtf", rb"{\rtf1{\fonttbl x}a\par b\tab c{\*\x y}\'e9}") == "a\nb\tcé"
    assert extract.extracted("txt", b"x") is None
    for bad in (b"", b"no zip", zipped(word__document_dot_xml="<a>")):
        with pytest.raises(extract.ExtractError):
            extract.extracted("docx", bad)


@pytest.fixture
def root(tmp_path):
    for name, data in {"a/x.txt": b"the License\n", "a/_u.txt": b"license", ".h/y.txt": b"license", "b/skip.log": b"license", "b/keep.txt": b"caf\xe9 license", "top.md": b"license", ".gitignore": b"*.log\n", "c/d.docx": b"broken"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_tree(spark, root):
    spec = SearchSpec("license", include_binary=True)
    tree = files.tree(spark, str(root), spec)
    got = {r.relative_path: (r.encoding, r.walk_error) for r in tree.collect()}
    assert set(got) == {"a/x.txt", "a/_u.txt", "b/keep.txt", "top.md", "c/d.docx"}
    assert got["b/keep.txt"][0] == "windows-1252" and got["c/d.docx"][1].startswith("Extract")
    rows = search.content_rows(tree, spec).collect()
    assert {r.relative_path for r in rows} == {"a/x.txt", "a/_u.txt", "b/keep.txt", "top.md"}
    flat = SearchSpec("license", include_subfolders=False, include_hidden=True, respect_ignore=False)
    assert {r.relative_path for r in files.listed(spark, str(root), flat).collect()} == {"top.md", ".gitignore"}


def test_bad_roots(spark, root):
    with pytest.raises(SpecError):
        files.listed(spark, str(root / "none"), SearchSpec("x"))
    with pytest.raises(SpecError):
        files.listed(spark, str(root / "top.md"), SearchSpec("x"))


def test_write_back(spark, root):
    spec = SearchSpec("license")
    tree = files.tree(spark, str(root), spec)
    changed = replaced(tree, spec, "permit").where("status = 'modified'").join(tree.select("full_path", "encoding"), "full_path")
    os.chmod(root / "top.md", 0o640)
    assert [r.failure for r in write_back(changed, str(root)).collect()] == [None] * 4
    assert (root / "b/keep.txt").read_bytes() == b"caf\xe9 permit"
    assert os.stat(root / "top.md").st_mode & 0o777 == 0o640
    outside = spark.createDataFrame([("/etc/none", "x", "UTF-8")], "full_path string, new_text string, encoding string")
    assert write_back(outside, str(root)).first().failure
