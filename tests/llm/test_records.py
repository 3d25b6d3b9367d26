"""WARC archive, HTML extraction and media columns: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import table
from weftarc.llm import extract, media, warc
from weftarc.llm.common import scratch

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "x" * 200 + "</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("digest", "payload", "member", "header", "head", "record_type", "text")})


def test_archive_round_trip(spark):
    rows = [(5, "http://a/", LONG), (3, "http://b/\r\nX: y", LONG), (None, None, LONG), (9, "u", None), (2, "u", "é"), (4, "v", "é"), (7, "w", ""), (3, "again", LONG)]
    path = scratch(spark, "t")
    warc.write_archive(pages(spark, rows), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    got = warc.read_archive(spark, path, whole=True).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert body == raw + b"\r\n\r\n" and b"\r\nX: y" not in head
        assert (r.record_type, r.refers_to) == (("revisit", 3) if html == LONG and r.page_id != 3 else ("response", None))


def test_archive_detects_damage(spark):
    path = scratch(spark, "t")
    warc.write_archive(pages(spark, [(1, "u", LONG)]), path)
    bad = f"{path}-bad"
    spark.read.parquet(f"{path}/payloads").withColumn("member", F.lit(zlib.compress(b"other", wbits=31))).write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{bad}/records")
    with pytest.raises(Exception, match="has the digest"):
        warc.read_archive(spark, bad).collect()


def test_archive_of_nothing(spark):
    path = scratch(spark, "t")
    warc.write_archive(pages(spark, []), path)
    assert warc.read_archive(spark, path).count() == 0


ARTICLE = "<article><h1>Title &amp; more</h1><p>First<br>line  of\n text.<p>Second &#233;<div class='ad'>Buy</div><p>End.</article>"
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body class="no-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href="/x">x</a></li></ul></nav><div id="cookie-notice">We use cookies, of course, as all of us do in these days.</div>
{ARTICLE}<aside>Related things that someone might like to read some day soon.</aside><form><label>Mail</label><input name=a></form>
<section class="comments"><article class="comment"><p>A reader's comment, which is long enough to be an article itself.</p></article></section><footer>&copy; me</footer></body></html>"""
MAIN = "Title & more\n\nFirst line of text.\n\nSecond é\n\nEnd."


@pytest.mark.parametrize(
    "html,want",
    [
        (PAGE, MAIN),
        (PAGE.replace("article", "main"), MAIN),
        (PAGE.replace("<article>", "<div class='content'>").replace("</article>", "</div>"), MAIN),
        (None, ""), ("", ""), ("   \n", ""), ("plain text", "plain text"), ("<p>a &lt; b < c</p>", "a < b < c"), ("<p>cut <b>off</b> here <a hre", "cut off here"),
        ("<article><p>one<p>two &am", "one\n\ntwo &am"), ("<!-- c <p>x</p> --><article>y</article>", "y"), ("<article>a<nav>menu</nav>b</article>", "a\n\nb"),
        ("<form><article><p>Whole page in a form.</p></article></form>", "Whole page in a form."), ("<script>only", ""), ("<p a='>'>q</p>", "q"),
    ],
)
def test_extract_cases(html, want):
    assert extract.main_text(html) == want


def test_spans():
    assert extract.spans([0, 5, 0, 7, 0, 0, 0, 9, 1]) == [(1, 4, 12), (7, 9, 10)]
    assert extract.spans([]) == [] and extract.spans([0, 0]) == []


def test_extract_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, "<p>" + "word " * 50_000 + "</p>")]
    got = {(r.page_id, r.url): r for r in extract.extract(pages(spark, rows)).collect()}
    assert got[1, "u"].text == MAIN and got[1, "u"].n_chars == len(MAIN) and got[None, None].text == ""
    assert got[2, None].n_chars == 5 * 50_000 - 1
    assert extract.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000, 400_000])
def test_media_round_trip(size):
    data = media.payload(np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes())
    assert len(data) % media.UNIT == 0 and data
    image = media.coefficients(media.encode(data))
    assert media.stored_bytes(image) == data
    rgb = media.tensor(image)
    assert rgb.shape == (image.height, image.width, 3) and rgb.dtype == np.uint8


def test_inverse_transform_is_a_cosine_series():
    x = np.arange(8)
    c = np.zeros(64, np.float32)
    c[1] = 80  # one horizontal half wave
    want = 80 / 8 * np.sqrt(2) * np.cos((2 * x + 1) * np.pi / 16)
    assert np.allclose((c @ media.BASIS).reshape(8, 8), want[None, :], atol=1e-3)


class Bits:
    def __init__(self):
        self.s = ""

    def code(self, codes, symbol):
        n, v = next(k for k, s in codes.items() if s == symbol)
        self.s += f"{v:0{n}b}"

    def number(self, v, size):
        if size:
            self.s += f"{v if v > 0 else v + (1 << size) - 1:0{size}b}"

    def bytes(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def test_general_scans():
    """DC with refinement, sparse AC with zero and end-of-band runs, and refinement that makes new coefficients, against a plain encoder."""
    rng = np.random.default_rng(1)
    blocks = 12  # of one component, 3 x 4
    want = np.where(rng.random((blocks, 64)) < 0.15, rng.integers(-40, 41, (blocks, 64)), 0)
    want[3:6, 1:] = 0
    symbols = bytes(sorted({r << 4 | s for r in range(16) for s in range(11)}))
    lengths = {8: symbols[:170], 12: symbols[170:]}
    codes = media._codes(bytes(len(lengths.get(n, b"")) for n in range(1, 17)), symbols)
    dc = media._codes(bytes([0] * 3 + [12] + [0] * 12), bytes(range(12)))
    b, last = Bits(), 0
    for v in want[:, 0] >> 1:
        size = int(abs(v - last)).bit_length()
        b.code(dc, size), b.number(int(v - last), size)
        last = v
    scans = [([1], 0, 0, 0, 1, 0, b.bytes())]
    b = Bits()
    b.s = "".join(str(v & 1) for v in want[:, 0])
    scans.append(([1], 0, 0, 1, 0, 0, b.bytes()))
    cut = np.sign(want) * (np.abs(want) >> 1)
    b, empty = Bits(), 0

    def flush(b, n, tail=""):
        if n:
            size = n.bit_length() - 1
            b.code(codes, size << 4)
            b.s += (f"{n - (1 << size):0{size}b}" if size else "") + tail

    for row in cut:
        run = 0
        if row[1:].any():
            flush(b, int(empty))
            empty = 0
        for v in row[1 : 1 + (np.flatnonzero(row[1:]).max(initial=-1) + 1)]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                b.code(codes, 0xF0)
                run -= 16
            size = int(abs(v)).bit_length()
            b.code(codes, run << 4 | size), b.number(int(v), size)
            run = 0
        empty += row[63] == 0 if row[1:].any() else 1
    flush(b, int(empty))
    scans.append(([1], 1, 63, 0, 1, 0x00, b.bytes()))
    b = Bits()
    for was, row in zip(cut, want):
        run, pending = 0, ""
        new = [k for k in range(1, 64) if was[k] == 0 and row[k] != 0]
        for k in range(1, (new[-1] if new else 0) + 1):
            if was[k]:
                pending += str(abs(int(row[k])) & 1)
            elif row[k] == 0:
                run += 1
                if run == 16:
                    b.code(codes, 0xF0)
                    b.s += pending
                    run, pending = 0, ""
            else:
                b.code(codes, run << 4 | 1)
                b.s += ("1" if row[k] > 0 else "0") + pending
                run, pending = 0, ""
        start = (new[-1] if new else 0) + 1
        if start < 64:
            flush(b, 1, "".join(str(abs(int(row[k])) & 1) for k in range(start, 64) if was[k]))
    scans.append(([1], 1, 63, 1, 0, 0x00, b.bytes()))
    frame = bytes([8, 0, 24, 0, 32, 1, 1, 0x11, 0])
    tables = media._table(0, 0, {4: bytes(range(12))}) + media._table(1, 0, lengths)
    jpeg = b"\xff\xd8" + media.QUANTS + media._segment(0xC2, frame) + tables + b"".join(media._scan(*s) for s in scans) + b"\xff\xd9"
    got = media.coefficients(jpeg).components[1].coefs.reshape(-1, 64)
    assert (got == want).all()


def test_damaged_media():
    good = media.encode(media.payload(b"abc"))
    for bad in (b"", b"abc", good[:-300], good.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises(ValueError):
            media.coefficients(bad)


def test_media_table(spark):
    rows = [(1, "abc"), (1, "abc"), (None, None), (2, ""), (3, "é" * 1000)]
    got = media.with_media(table(spark, rows))
    features = media.arrow(media._read_rows, got, ", ".join(f"{k} {'string' if 'sha256' in k or k == 'feature' else 'long'}" for k in media.NAMES)).collect()
    by = {r.doc_id: r for r in features}
    for i, t in rows:
        data = media.payload((t or "").encode())
        assert (by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert len(features) == 5 and by[None].feature == by[2].feature
    shapes = media.tensors(got).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in shapes)
    assert media.with_media(table(spark, [])).count() == 0


def test_spans_against_all_windows():
    """Surges, dives and peaks by looking at each window by itself."""
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.choice([0, 0, 0, rng.randrange(1, 40)]) for _ in range(rng.randrange(30))]
        size = rng.randrange(1, 5)
        at = lambda i: w[i] if 0 <= i < len(w) else 0
        window = {i: sum(at(j) for j in range(i, i + size)) for i in range(1 - size, len(w))}
        want = []
        for i in sorted(window):
            if window[i] and not window.get(i - 1):
                end = i
                while window.get(end + 1):
                    end += 1
                lines_ = [j for j in range(i, end + size) if at(j)]
                want.append((lines_[0], lines_[-1] + 1, max(window[j] for j in range(i, end + 1))))
        assert extract.spans(w, size) == want


def test_windows_decide_without_lists_and_marks():
    """Menus of links go and text stays by weights alone; a short line far from the text goes."""
    menu = "<ul>" + "".join(f"<li><a href=x>Menu entry {i}</a></li>" for i in range(6)) + "</ul>"
    page = f"<div>Top.</div>{menu}<div>First paragraph with enough words to count as text of an article.</div><div>Second one, shorter.</div>{menu}<div>End.</div>"
    assert extract.main_text(page, told=False, marks=False) == "First paragraph with enough words to count as text of an article.\n\nSecond one, shorter."


def test_tensor_against_a_plain_transform():
    """Pixels from cosines, repeated chroma and the colour equations, one by one."""
    image = media.coefficients(media.encode(media.payload(bytes(range(256)) * 5)))
    planes = []
    tall, wide = max(c.v for c in image.components.values()), max(c.h for c in image.components.values())
    x = np.arange(8)
    waves = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1.0)
    for c in image.components.values():
        plane = np.zeros((8 * c.coefs.shape[0], 8 * c.coefs.shape[1]))
        for r in range(c.coefs.shape[0]):
            for q in range(c.coefs.shape[1]):
                values = np.zeros((8, 8))
                for k in range(64):
                    u, v = divmod(int(NATURAL[k]), 8)
                    values[u, v] = float(c.coefs[r, q, k]) * float(image.quants[c.quant][k])
                plane[8 * r : 8 * r + 8, 8 * q : 8 * q + 8] = np.clip(waves @ values @ waves.T / 4 + 128, 0, 255)
        planes.append(np.array([[plane[i * c.v // tall, j * c.h // wide] for j in range(image.width)] for i in range(image.height)]))
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    got = media.tensor(image).astype(float)
    assert np.abs(got - np.clip(want, 0, 255)).max() <= 1.01


#: Place of the k-th coefficient of a zigzag.
NATURAL = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
