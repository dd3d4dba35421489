"""Template removal and motion-JPEG clips."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from clausewright.llm import jpeg, op2_templates, op3_media

from .shared import prose, rows

PAGES = "page_id long, url string, html string"


def _page(site: str, k: int) -> str:
    return f"<html><head><title>x</title></head><body><nav id=n><ul><li><a href=/>Home {site}</a><li>About</ul></nav><main><p>{prose(k, 20)} &amp; more</p><script>var x = '<p>no</p>';</script></main><footer>Copyright {site}</footer></body></html>"


def test_templates_against_brute_force(spark):
    data = [(k, f"https://{'ab'[k % 2]}.example/p{k}", _page("ab"[k % 2], k)) for k in range(20)] + [(50, "http://a.example/y", None), (51, None, _page("a", 1)), (None, "nonsense", ""), (52, "https://A.example:8080/z", "<p>one<p>two <b>bold</p>stray</div> <ul><li>x")]
    counts, total = Counter(), Counter()
    host = lambda u: "a.example" if u and "a.example" in u.lower() else "b.example" if u and "b.example" in u else None
    for _, url, source in data:
        if host(url):
            total[host(url)] += 1
            counts.update((host(url), h) for h in (op2_templates.block_hashes(op2_templates.parse(source)) if source else ()))
    template = defaultdict(set)
    for (h, x), n in counts.items():
        if n >= op2_templates.MIN_PAGES and n >= op2_templates.SHARE * total[h]:
            template[h].add(x)
    expected = [(i, host(u), *op2_templates.extract(s, template[host(u)] if host(u) else set())) for i, u, s in data]
    found = rows(op2_templates.strip(spark.createDataFrame(data, PAGES).selectExpr("*", "1 AS host", "2 AS hash")))
    assert found == sorted(expected, key=repr)
    by = {r[0]: r for r in found}
    assert by[4][2] == prose(4, 20) + " & more" and by[4][3] >= 2
    assert "Home a" in by[51][2] and by[50][2] == "" and by[52][2].split("\n")[:2] == ["one", "two bold"]
    assert rows(op2_templates.strip(spark.createDataFrame([], PAGES))) == []


def test_wide_way_gives_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"https://a.example/{k}", _page("a", k)) for k in range(12)], PAGES)
    narrow = rows(op2_templates.strip(pages))
    monkeypatch.setattr(op2_templates, "BROADCAST_HASHES", 0)
    assert rows(op2_templates.strip(pages)) == narrow


def test_wide_way_slices_hosts(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"https://{'a' if k < 30 else 'b'}.example/{k}", _page("a", k)) for k in range(40)] + [(None, None, _page("a", 1)), (90, "https://c.example", None)], PAGES)
    narrow = rows(op2_templates.strip(pages))
    monkeypatch.setattr(op2_templates, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(op2_templates, "SLICE_BYTES", 2000)
    assert rows(op2_templates.strip(pages)) == narrow


def test_deep_nesting():
    assert op2_templates.extract("<div>" * 20_000 + "x")[0] == "x"


#: The same tokens by backtracking, which is plain but slow on malformed pages.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)


def test_tags_against_backtracking():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<div class='a>b' id=x>", "<br/>", "<a href=\"q > r\">", "</a >", "text", " < 3 ", "<!-- c > -->", "<!doctype html>", "<?x y?>", "<script>a<b>c</script>", "<style >p{}</style>", "<b", "a>b", "&amp;", "<LI>", "</UL>", "<svg/>x</svg>", "<3>"]
    for _ in range(300):
        source = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + rng.choice(["", "<!-- open", "<title>open", "<", "<p", "</"])
        plain = [(m.start(), m.end(), (m[3] or "").lower(), bool(m[2]), m[4] or "") for m in _TOKEN.finditer(source)]
        assert list(op2_templates._tags(source)) == plain, source


@pytest.mark.parametrize("part", ["<script ", "<a '", "<a \"x' ", "<a \">", "<!-", "<!-- ", "<b>", "</i><b>", "<p><b>", "<", "<div id='", "<td class=\"a", "<title>x"])
def test_malformed_pages_take_linear_time(part):
    n = (1 << 19) // len(part)
    began = time.process_time()
    op2_templates.block_hashes(op2_templates.parse(part * n))
    op2_templates.extract(part * (n // 2))
    assert time.process_time() - began < 20  # seconds for 500 kB and half of it; backtracking took hours


def _film(tones, per, with_index=True):
    frames = [jpeg.encode_grey(np.full((16, 24), t + k, np.uint8)) for t in tones for k in range(per)]
    return op3_media.write_avi(frames, 24, 16, 10, with_index), frames


@pytest.mark.parametrize("step", [1, 4])
def test_jpeg_round_trip(step):
    y, x = np.mgrid[0:32, 0:40]
    picture = (100 + 60 * np.sin(x / 6) + 40 * np.cos(y / 5)).clip(0, 255).astype(np.uint8)
    (plane,) = jpeg.decode(jpeg.encode_grey(picture, step))
    assert np.abs(plane[:32, :40].astype(int) - picture).max() <= 2 + 2 * step


@pytest.mark.parametrize("with_index", [True, False])
def test_shots(spark, with_index):
    film, frames = _film([20, 120, 220], 10, with_index)
    rate, places = op3_media.index(film)
    assert rate == 10 and [film[a:b] for a, b in places] == frames
    bad = op3_media.write_avi([frames[0], b"\xff\xd8broken", b"", frames[0]], 24, 16, 10)
    media = spark.createDataFrame([(1, bytearray(film)), (2, None), (3, bytearray(b"")), (4, bytearray(b"RIFFxxxxAVI ")), (5, bytearray(bad)), (None, bytearray(film[: len(film) // 2]))], "media_id long, content binary")
    found = defaultdict(list)
    for r in op3_media.detect(media.selectExpr("*", "1 AS shot", "'x' AS error")).collect():
        found[r["media_id"]].append(r.asDict())
    starts = [v for r in found[1] for k, v in r.items() if k in ("start_s", "start", "begin_s", "start_time")]
    assert len(found[1]) == 3 and (not starts or starts == [0.0, 1.0, 2.0])
    assert all(len(found[k]) == 1 and found[k][0]["error"] for k in (2, 3, 4))
    assert len(found[5]) == 1 and found[5][0]["bad_frames"] == 1
    assert found[None]


def test_steady_film_has_one_shot():
    film, _ = _film([50], 30)
    assert len(op3_media.clips(film)) == 1


def test_recurring_content_stays(spark):
    """A title on 6 of 60 pages, an article copied to 6 and pages repeated 6 times are content; a navigation of 6 pages is not."""
    def page(k: int, h1: str, body: str) -> str:
        return f"<body><nav><ul><li>Menu {k % 10}</ul></nav><article><h1>{h1}</h1><p>{body}</p></article></body>"

    data = [(k, f"https://a.example/{k}", page(k, "Same title" if k < 6 else prose(k, 5), prose(k + 100 if not 6 <= k < 12 else 1, 20))) for k in range(60)]
    data += [(100 + k, f"https://b.example/{k}", "<body><p>One page</p></body>") for k in range(6)]
    found = {r["page_id"]: r["text"] for r in op2_templates.strip(spark.createDataFrame(data, PAGES)).collect()}
    assert all(found[k].startswith("Same title\n") for k in range(6)) and all(found[k].endswith(prose(1, 20)) for k in range(6, 12))
    assert not any("Menu" in t for t in found.values()) and all(found[100 + k] == "One page" for k in range(6))


@pytest.mark.parametrize("indexed", [True, False])
def test_frames_of_a_later_segment(indexed):
    film, frames = _film([20], 5)
    more, words = [jpeg.encode_grey(np.full((16, 24), 200 + k, np.uint8)) for k in range(4)], lambda *v: b"".join(x.to_bytes(4, "little") for x in v)
    movi, places = b"movi", b""
    for f in more:
        places += words(len(movi) + 8, len(f))
        movi += b"00dc" + words(len(f)) + f + b"\0" * (len(f) & 1)
    if indexed:
        body = words(2) + words(len(more)) + b"00dc" + (len(film) + 20).to_bytes(8, "little") + words(0) + places
        movi += b"ix00" + words(len(body)) + body
    avix = b"AVIX" + b"LIST" + words(len(movi)) + movi
    _, places = op3_media.index(film + b"RIFF" + words(len(avix)) + avix)
    assert [(film + b"RIFF" + words(len(avix)) + avix)[a:b] for a, b in places] == frames + more
    assert len(op3_media.clips(film + b"RIFF" + words(len(avix)) + avix)) == 2


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (1, 2), (2, 2)])
@pytest.mark.parametrize("restart, tables", [(0, False), (1, True), (3, False)])
def test_colour_round_trip(sampling, restart, tables):
    height, width = 37, 45
    y, x = np.mgrid[0:height, 0:width]
    planes = [(120 + 60 * np.sin(x / 6) + 30 * np.cos(y / 5)).clip(0, 255).astype(np.uint8)]
    for k in (1, 2):
        h, w = -(-height // sampling[1]), -(-width // sampling[0])
        y, x = np.mgrid[0:h, 0:w]
        planes.append((100 * k + 40 * np.sin((x + k * y) / 7)).clip(0, 255).astype(np.uint8))
    data = jpeg.encode(planes, sampling, 2, tables, restart)
    assert (b"\xff\xd0" in data) == bool(restart)
    back = jpeg.decode(data)
    assert [p.shape for p in back] == [p.shape for p in planes]
    assert all(np.abs(b.astype(int) - p).max() <= 6 for b, p in zip(back, planes, strict=True))


def test_frames_decoded_together_equal_single_ones():
    rng = np.random.default_rng(5)
    noise = [rng.integers(0, 256, (24, 16), dtype=np.uint8) for _ in range(4)]
    frames = [jpeg.encode_grey(n, 3) for n in noise] + [jpeg.encode([n, n[:12, :8], n[:12, :8]], (2, 2), 5) for n in noise] + [b"\xff\xd8broken", jpeg.encode_grey(noise[0], 3)[:60]]
    for data, found in zip(frames, jpeg.decode_all(frames), strict=True):
        if isinstance(found, jpeg.BadFrame):
            with pytest.raises(jpeg.BadFrame):
                jpeg.decode(data)
        else:
            assert all((a == b).all() for a, b in zip(found, jpeg.decode(data), strict=True))
    assert [isinstance(f, jpeg.BadFrame) for f in jpeg.decode_all(frames)] == [False] * 8 + [True] * 2


def _plain_histogram(planes):
    out = []
    for k, p in enumerate(planes):
        bins = 8 if k else 32
        h = [0.0] * (bins + 1)
        for x in p.ravel().tolist():
            part = x * bins / 256
            h[int(part)] += 1 - part % 1
            h[int(part) + 1] += part % 1
        out += [x / p.size / len(planes) for x in h]
    return out


def test_histogram_against_plain():
    rng = np.random.default_rng(6)
    planes = [rng.integers(0, 256, s, dtype=np.uint8) for s in ((16, 24), (8, 12), (8, 12))]
    assert np.allclose(op3_media.histogram(planes), _plain_histogram(planes))


def _plain_cuts(d):
    out = []
    for t in range(1, len(d)):
        before, after = list(d[max(1, t - op3_media.RADIUS) : t]), list(d[t + 1 : t + op3_media.RADIUS + 1])
        around = before + after
        if d[t] >= op3_media.FLOOR and all(x < d[t] for x in before) and all(x <= d[t] for x in after) and (not around or d[t] > op3_media.RATIO * sum(around) / len(around)):
            out.append(t)
    return out


def test_cuts_against_plain_with_ties():
    rng = random.Random(7)
    for _ in range(500):
        d = [0.0] + [rng.choice([0.0, 0.01, 0.05, 0.19, 0.2, 0.5, 0.5, 1.0]) for _ in range(rng.randint(0, 25))]
        assert op3_media.cuts(np.array(d)).tolist() == _plain_cuts(d)
    assert op3_media.cuts(np.array([0, 0, 0.5, 0, 0.5, 0, 0])).tolist() == [2]


def test_rendered_films_hold_every_number(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=64)
    v[0], v[1] = -5, 5
    film = op3_media.render(v.tolist())
    tones = np.clip((v + 5) / 10, 0, 1) * 200 + 20
    _, places = op3_media.index(film)
    assert len(places) == 15
    for scene, first in enumerate((0, 6, 11)):
        planes = jpeg.decode(film[places[first][0] : places[first][1]])
        found = np.concatenate([p.reshape(p.shape[0] // 8, 8, -1, 8).mean(axis=(1, 3)).ravel() for p in planes])
        run = tones[scene * 64 // 3 : (scene + 1) * 64 // 3]
        assert np.abs(found[: len(run)] - run).max() < 2.5
    table = spark.createDataFrame([(1, v.tolist()), (2, None), (3, []), (4, [None, 1.0]), (5, [0.5])], "vec_id long, embedding array<double>").selectExpr("*", "'x' AS media_id", "1 AS content")
    got = defaultdict(list)
    for r in op3_media.detect(op3_media.rendered(table)).collect():
        got[r["media_id"]].append(r)
    assert len(got[1]) == 3 and [r["start_s"] for r in got[1]] == [0.0, 0.75, 1.375]
    assert all(len(got[k]) == 1 and got[k][0]["error"] for k in (2, 3)) and len(got[5]) == 1 and got[5][0]["error"] is None
    assert rows(op3_media.detect(op3_media.rendered(table.limit(0)))) == []
