import json
import zlib

import pytest

from vectorloom.errors import EmbeddingError, SourceIOError
from vectorloom.sources import pdf
from vectorloom.sources.codebase import read_codebase
from vectorloom.sources.text import extracted, read_whole_text
from vectorloom.sources.wiki import read_wiki, summary


def names(df):
    return sorted(r["source"] for r in df.collect())


def test_codebase(spark, tmp_path):
    for name, content in {"main.rs": "fn", "lib.rs": "x", "readme.md": "# r", "c.toml": "", "__init__.py": "1", ".env.py": "s", "target/debug.rs": "n", ".git/config.md": "n", ".hid/x.md": "y", "data.bin": "b"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "big.md").write_text("x" * 2000)
    root = str(tmp_path)
    assert names(read_codebase(spark, root, max_file_size=1000)) == [".hid/x.md", "__init__.py", "c.toml", "lib.rs", "main.rs", "readme.md"]
    assert names(read_codebase(spark, root, ["rs"])) == ["lib.rs", "main.rs"]
    row = read_codebase(spark, root, ["toml"]).head()
    assert row["metadata"] == {"format": "code", "extension": "toml", "path": f"{root}/c.toml"} and row["content"] == ""
    assert read_codebase(spark, root, ["none"]).count() == 0


def test_pdf_strings():
    assert pdf.decode_string(b"hello\\nworld") == "hello\nworld"
    assert pdf.decode_string(b"\\101\\9z\\q\xe9\\\\") == "Azq\xe9\\"
    assert pdf.closing_paren(b"(a (b) c)", 0) == 8 and pdf.closing_paren(b"(a", 0) is None
    assert pdf.array_text(b"(hello) 123 (world)") == "helloworld"


@pytest.mark.parametrize(
    ("data", "text"),
    [(b" (a) Tj\n", "a"), (b" (a) Tj", ""), (b"(a) Tj\n", ""), (b" (a\\(b) Tj ", "b"), (b"[(a) 1 (b)] TJ ", "ab"), (b" [[(a)] (b)] TJ (c) Tj ", "abc"), (b" <41> Tj ", ""), (b" (x) ' (y) Tj ", "y")],
)
def test_pdf_content(data, text):
    assert pdf.content_text(data) == text


def make_pdf(pages):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)]
    for i, page in enumerate(pages):
        body = zlib.compress(page)
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"%%EOF"


def test_pdf_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf([b"BT (Hello) Tj ET", b"BT ET"]))
    row = pdf.read_pdf(spark, str(tmp_path / "a.pdf")).head()
    assert row["content"] == "--- Page 1 ---\nHello\n--- Page 2 ---\n"
    assert row["source"] == "a.pdf" and row["metadata"]["format"] == "pdf"
    with pytest.raises(SourceIOError, match="Failed to load PDF"):
        pdf.pdf_text(b"no pdf")


def test_wiki(spark):
    asked = []

    def fetch(url):
        asked.append(url)
        return 200, json.dumps({"title": "Rust (language)", "extract": "Text."})

    content, source, metadata = summary("Rust (language)", "de", fetch)
    assert (content, source) == ("Text.", "Rust (language)") and metadata["language"] == "de"
    assert asked == ["https://de.wikipedia.org/api/rest_v1/page/summary/Rust_%28language%29"]
    assert metadata["url"] == "https://de.wikipedia.org/wiki/Rust_%28language%29"
    with pytest.raises(EmbeddingError, match="Wiki API returned status: 404"):
        summary("x", "en", lambda _: (404, ""))
    with pytest.raises(EmbeddingError, match="no extractable content"):
        summary("x", "en", lambda _: (200, "{}"))
    rows = read_wiki(spark, ["A", "B"], fetch=lambda url: (200, json.dumps({"extract": url[-1]})))
    assert sorted((r["source"], r["content"]) for r in rows.collect()) == [("A", "A"), ("B", "B")]


def test_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb")
    row = read_whole_text(spark, str(tmp_path / "t.txt")).head()
    assert row["content"] == "a\nb" and row["metadata"]["path"].endswith("t.txt")
    assert extracted(spark.createDataFrame([("c", "s")], "c string, s string"), "c", "s").head()["metadata"] == {}
