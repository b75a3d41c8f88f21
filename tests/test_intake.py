"""PDF files made as bytes, one defect each, against what must be found in them."""

import zlib

import pytest

from quillspan.operators import intake


def pdf(objects, start=None, trailer="", head=b"%PDF-1.7\n", offsets=None):
    """A file of numbered objects with a table of where they stand."""
    out, places = head, []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    out += b"".join(b"%010d 00000 n \n" % p for p in (offsets or places))
    return out + b"trailer\n<< /Root 1 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (trailer.encode(), at if start is None else start)


CATALOG, PAGE = b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents %s >>"
TREE = b"<< /Type /Pages /Kids [3 0 R] /Count %d >>"
SHOWN, DRAWN = b"<< >>\nstream\nBT (words) Tj ET\nendstream", b"<< >>\nstream\n0 0 m 5 5 l S\nendstream"


def deflated(data):
    return b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(data) + b"\nendstream"


def two_pages(first, second, count=2):
    return [CATALOG, TREE % count, PAGE % b"5 0 R", PAGE % b"[6 0 R]", first, second]


WHOLE = pdf(two_pages(SHOWN, deflated(b"BT [(a) 3 (b)] TJ ET")))
REVISED = WHOLE + b"5 0 obj\n" + DRAWN + b"\nendobj\nxref\n5 1\n%010d 00000 n \ntrailer\n<< /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (len(WHOLE), WHOLE.rindex(b"xref\n0"), len(WHOLE) + 16 + len(DRAWN))
RING = pdf(two_pages(SHOWN, SHOWN), trailer=f" /Prev {pdf(two_pages(SHOWN, SHOWN)).rindex(b'xref' + chr(10).encode() + b'0')}")

CASES = {
    "whole": (WHOLE, "ok", [], {"revisions": 1, "chain": 1, "astray": 0, "pages": 2, "count": 2, "textless": 0, "version": "1.7"}),
    "revised": (REVISED, "notice", ["incremental_updates", "pages_without_text"], {"revisions": 2, "chain": 2, "astray": 0, "pages": 2, "textless": 1}),
    "ring": (RING, "ok", [], {"chain": 1}),
    "scan": (pdf(two_pages(DRAWN, deflated(b"q Q"))), "warn", ["no_text_layer"], {"textless": 2}),
    "count": (pdf(two_pages(SHOWN, SHOWN, 9)), "warn", ["page_count_mismatch"], {"count": 9, "pages": 2}),
    "no tree": (pdf([SHOWN]), "warn", ["no_page_count"], {"pages": 0}),
    "beyond": (pdf(two_pages(SHOWN, SHOWN), start=10**7), "broken", ["startxref_out_of_range"], {"chain": 0, "startxref": 10**7}),
    "zero": (pdf(two_pages(SHOWN, SHOWN), start=0), "broken", ["startxref_out_of_range"], {"startxref": 0}),
    "misaligned": (pdf(two_pages(SHOWN, SHOWN), start=30), "warn", ["startxref_misaligned"], {"chain": 0}),
    "on an object": (pdf(two_pages(SHOWN, SHOWN), start=9), "ok", [], {"chain": 0}),
    "astray": (pdf(two_pages(SHOWN, SHOWN), offsets=[9, 11, 12, 13, 14, 15]), "ok", [], {"astray": 5}),
    "locked": (pdf(two_pages(SHOWN, SHOWN), trailer=" /Encrypt 9 0 R"), "warn", ["encrypted"], {}),
    "late head": (b"x" * 1000 + b"\n" + WHOLE, "warn", ["startxref_misaligned"], {"version": "1.7"}),
    "headless": (b"x" * 1030 + WHOLE[9:], "broken", ["no_header", "startxref_misaligned"], {"version": None}),
    "cut": (WHOLE[:-40], "broken", ["no_eof", "no_startxref"], {"revisions": 0, "startxref": None}),
    "no number": (WHOLE[: WHOLE.rindex(b"startxref") + 9] + b"\n%%EOF", "broken", ["bad_startxref"], {"startxref": None}),
    "long tail": (WHOLE + b" " * 5000, "broken", ["no_eof"], {"revisions": 1}),
    "fonts": (pdf([*two_pages(SHOWN, SHOWN), b"<< /Type /Font /ToUnicode 1 0 R >>", b"<< /Type /Font >>", b"<< /Type /Font /Subtype /CIDFontType2 >>", b"<< /Type /FontDescriptor >>"]), "notice", ["fonts_without_tounicode"], {"fonts": 2, "fonts_unmapped": 1}),
    "bad deflate": (pdf(two_pages(SHOWN, b"<< /FlateDecode >>\nstream\nnot deflated\nendstream")), "notice", ["pages_without_text"], {"textless": 1}),
    "empty": (b"", "broken", ["empty"], {"size": 0, "pages": 0}),
    "text": (b"no pdf at all", "broken", ["no_header", "no_eof", "no_startxref", "no_page_count"], {}),
    "unread": (None, "broken", ["unreadable"], {"size": None, "pages": 0}),
}


@pytest.fixture(scope="module")
def reports(spark):
    files = spark.createDataFrame([(name, bytearray(case[0]) if case[0] is not None else None) for name, case in CASES.items()], "path string, content binary")
    return {r.path: r for r in intake.inspect(files).collect()}


@pytest.mark.parametrize("name", CASES)
def test_findings(reports, name):
    _, severity, codes, facts = CASES[name]
    got = reports[name]
    assert [f.code for f in got.findings] == codes and got.severity == severity and got.readable == (severity in ("ok", "notice"))
    assert {k: got[k] for k in facts} == facts


def test_folder_of_files(spark, tmp_path):
    """Files of any case of the suffix below a folder, other files left out."""
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.pdf").write_bytes(WHOLE)
    (tmp_path / "deep" / "b.PDF").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(WHOLE)
    got = {r.path.rsplit("/", 1)[1]: r.severity for r in intake.inspect_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "ok", "b.PDF": "broken"}
    assert intake.inspect(spark.createDataFrame([], "path string, content binary")).isEmpty()
