"""Archives, page text, chats and segmentations: round trips, brute force and awkward rows."""

from __future__ import annotations

import hashlib
import io
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from ledgertide.llm import archives, conversations, html_text, segmentations

needs_model = pytest.mark.skipif(not Path(segmentations.MODEL).exists(), reason="the tokenizer file is not here")
LONG = "<p>" + "z" * 150


def expected_archive(rows):
    first = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None and len(payload) >= 100:
            first[payload] = min(first.get(payload, page), page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        original = first.get(payload)
        again = page is not None and original is not None and page != original
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", original if again else None))
    return out


@pytest.mark.parametrize("version", [1, 2, None])
def test_archives_come_back_whole(spark, version):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\nhttp://x 0.0.0.0 20240101000000 text/html 5\nABCDE\n" * 3
    rows = [(5, "http://a/ b", LONG), (2, None, LONG), (9, "http://é/", LONG), (3, "u", None), (4, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", LONG),
            (10, "u", tricky), (11, "u", tricky), (12, "u", "ü\n" * 200_000), (13, "u", "\n\n" * 80), (14, "u", "\n\n" * 80)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, size int").repartition(3)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archives.archived(pages, version=version).collect()]
    assert sorted(got, key=str) == sorted(expected_archive(rows), key=str)


def test_archives_of_nothing_and_of_repeated_ids(spark):
    schema = "page_id long, url string, html string"
    assert archives.archived(spark.createDataFrame([], schema)).collect() == []
    rows = archives.archived(spark.createDataFrame([(1, "u", LONG)] * 3, schema)).collect()
    assert sorted((r["record_type"], r["refers_to"]) for r in rows if r["refers_to"] is not None) == [("revisit", 1)] * 2 and len({r["record_id"] for r in rows}) == 3


def test_arc_reader_follows_versions_and_lengths():
    for version in (1, 2):
        head = archives.version_block(version, "f.arc")
        blocks = [b"HTTP/1.0 200 OK\r\n\r\nhi\nthere", b"", b"x" * 70]
        text = head.encode() + b"\n" + b"".join(archives.arc_header(version, f"http://h/{i}", "20200102030405", "text/html", len(b)).encode() + b"\n" + b + b"\n" for i, b in enumerate(blocks))
        text = text.replace(b"http://h/1", b"damaged line\nhttp://h/1", 1)
        found = list(archives.read_arc(io.BytesIO(text)))
        assert [(c.url, c.date, c.block) for c in found] == [(f"http://h/{i}", "20200102030405", b) for i, b in enumerate(blocks)]
        assert all(text[c.offset:].startswith(c.url.encode()) for c in found)
    assert "WARC-Date: 2020-01-02T03:04:05Z" in archives.warc_record(found[0], "<urn:uuid:1>")


@pytest.mark.parametrize("source,text", [
    (None, ""), ("", ""), ("  \n ", ""), ("a  b\n c", "a b c"), ("<p>One<p>Two", "One\n\nTwo"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<head><title>no</title><body>yes", "yes"), ("x<script>if (a < b) '</p>'</script>y", "xy"), ("<!-- c --><p hidden>no</p><span style='display: none'>no</span>ok<i aria-hidden=true>no</i>", "ok"),
    ("<ul><li>a<li>b<ol start=9><li>c<li>d</ol></ul>", "- a\n- b\n  9. c\n  10. d"), ("<table><tr><td>ab<td>c<tr><td>d<td>efg</table>", "ab | c\nd  | efg"),
    ("<table><tr><td colspan=2>wide<tr><td>1<td>2</table>", "wide\n1 | 2"), ("<pre> a\n  b </pre>", " a\n  b"), ("&lt;b&gt; &amp; &copy;", "<b> & ©"),
    ("</div></p>stray<b>bold", "straybold"), ("<a title='x>y'>link</a>", "link"), ("<a title=don't>link</a> more", "link more"), ("1 < 2 and <3", "1 < 2 and <3"),
    ("<td>loose<td>cells", "loose\ncells"), ("<h1>H</h1>t", "H\n\nt"), ("<p>a<table><tr><td>b</table>", "a\n\nb"), ("<select><option>x<option>y</select>", "x\ny"), ("<textarea>&lt;t&gt;</textarea>", "<t>"),
])
def test_page_text(source, text):
    assert html_text.visible_text(source) == text


@pytest.mark.parametrize("source,text", [
    ("<html><head><title>T</title><p>Hello", "Hello"), ("<head><meta charset=x><title>T</title>\n Hello <b>you</b>", "Hello you"),
    ("<html><head><link rel=x><style>p {}</style><script>1</script><h1>H</h1><div>a</div>", "H\n\na"), ("<head><template><p>no</p></template><base href=x>\n<table><tr><td>c</table>", "c"),
    ("<head><html><head><title>no</title><main>yes</main>", "yes"), ("<head><title>no</title></head>yes", "yes"), ("<body>a<head><p>b", "a\n\nb"),
])
def test_page_text_without_the_end_of_the_head(source, text):
    assert html_text.visible_text(source) == text


@pytest.mark.parametrize("attributes,shown", [
    ('title="the hidden truth"', True), ('class="nav hidden md:block"', True), ("alt='x hidden=y'", True), ('class="hidden"', True), ("data-type=hidden", True), ("type=hidden", True),
    ('data-style="display:none"', True), ("data-hidden", True), ("title='aria-hidden=true'", True), ("style='background:url(a;display:none)'", True), ("style='content:\";display:none;\"'", True),
    ("style='display:none;display:block'", True), ("hidden style='display:flex'", True), ("style='backface-visibility:hidden'", True), ("aria-hidden=false", True), ("style='display:'", True),
    ("hidden", False), ("HIDDEN", False), ("id=a hidden=''", False), ("a/hidden", False), ("title='a'hidden", False), ("style='color:red; DISPLAY : None'", False), ("style=display:none", False),
    ("style='visibility: collapse'", False), ("style='display:none!important;display:block'", False), ("style='/* a; */display:none'", False), ("hidden=until-found", False), ("style='display&#58;none'", False),
])
def test_page_text_of_hidden_elements(attributes, shown):
    expected = "a\nb\nc" if shown else "a\nc"
    assert html_text.visible_text(f"<div>a</div><div {attributes}>b</div><div>c</div>") == expected


@pytest.mark.parametrize("source,text", [
    ("so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> holds", "so x= 1 2 holds"),
    ("<math><semantics><mrow><mi>a</mi></mrow><annotation encoding=tex>\\a</annotation><annotation-xml><mi>no</mi></annotation-xml></semantics></math>b", "ab"),
    ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata>no<g><rect/><text>up <tspan>and</tspan></text><text>down</text></g></svg>b", "a up and down b"),
    ("<svg><title/><style/><path d=M0/><text>x</text></svg> y", "x y"), ("<svg><foreignObject><div>in</div><p>side</p></foreignObject></svg>", "in\n\nside"), ("<svg hidden><text>no</text></svg>ok", "ok"),
    ("<svg><path d='M0'><p>Hello", "Hello"), ("<math><mi>x<mo>+</math><p>b", "x+\n\nb"), ("<svg/>a<math/>b", "ab"), ("<svg><text>x<desc>no</desc></text></svg>", "x"), ("<annotation>a</annotation><desc>b</desc>", "ab"),
    ("<math><annotation-xml><mi>no</annotation-xml><p>a", "a"), ("<math><annotation-xml encoding=text/html><p>no</p></annotation-xml></math>a", "a"), ("<script/>no</script>yes", "yes"),
    ("a<xmp> <b>&lt;</b>\n  two</xmp>b", "a\n\n <b>&lt;</b>\n  two\n\nb"), ("<p>a<xmp>b</xmp>", "a\n\nb"), ("<pre>a<svg><text>x</text><text>y</text></svg>\n<math><mi>z</math></pre>", "ax y\nz"),
])
def test_page_text_of_formulas_drawings_and_xmp(source, text):
    assert html_text.visible_text(source) == text


@pytest.mark.parametrize("tags", ["<ul>", "<table>", "<ul><table>", "<ol><li>", "<table><tr><td>", "<dl><dd><ol>", "<menu><li><table><tbody><tr><th>", "<table><colgroup>", "<pre><b>", "<math><mrow>", "<svg><g>", "<svg><foreignObject>"])
def test_page_text_of_any_nesting(tags):
    inner = "<text>x" if tags == "<svg><g>" else "x"
    assert html_text.visible_text(tags * 1000 + inner).endswith("x")
    assert html_text.visible_text(f"<p>a</p>{tags * 500}{inner}").startswith("a\n")


def test_page_text_of_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 10
    assert html_text.visible_text(deep) == "x"
    assert html_text.visible_text("<ul><li>" * 300 + "x").endswith("x") and html_text.visible_text("<a b='" * 3000 + "x") is not None
    pages = spark.createDataFrame([(1, "<p>a", 0), (1, "<p>a", 0), (None, None, 1), (2, "<p>w</p>" * 50_000, 2)], "page_id long, html string, n_chars int")
    got = html_text.extracted(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"], r["n_lines"]) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 149_998, 99_999)]
    assert html_text.extracted(pages.where("false")).collect() == []


def expected_chats(rows):
    chats = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        chats.setdefault(conv, []).append((role, text))
    best = {}
    for conv, turns in chats.items():
        best.setdefault(tuple(turns), []).append(conv)
    return {min(convs): (turns, len(convs)) for turns, convs in best.items() if not any(len(other) > len(turns) and other[:len(turns)] == turns for other in best)}


def test_chats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", 4)
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "ok"), ("user", "x"), ("assistant", "y")]
    rows = [(c, t, *base[t]) for c, n in ((1, 2), (2, 4), (3, 6), (4, 6), (5, 5)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", None), (7, 0, "user", "hi"), (7, 1, "assistant", ""), (8, 0, None, "hi"), (None, 0, "user", "hi")]
    rows += [(9, 10 * t, *base[t]) for t in range(3)] + [(10, 3, "user", "one"), (10, 3, "user", "one"), (11, 0, "user", "one")]
    rows += [(12, t, "user", f"t{t}") for t in range(21)] + [(13, t, "user", f"t{t}") for t in range(17)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, place int, rendered string").repartition(3)
    got = {}
    for r in conversations.collapsed_chats(frame).orderBy("conv_id", "segment").collect():
        n, equal, text = got.get(r["conv_id"], (0, 0, ""))
        got[r["conv_id"]] = (r["n_turns"], r["n_equal"], text + r["rendered"])
    want = {c: (len(t), n, "".join(f"<|im_start|>{a or ''}\n{b or ''}<|im_end|>\n" for a, b in t)) for c, (t, n) in expected_chats(rows).items()}
    assert got == want
    assert conversations.collapsed_chats(frame.where("false")).collect() == []


@needs_model
def test_samples_follow_the_law_of_sampling_without_replacement():
    vocab = segmentations.vocabulary()
    pieces, n = segmentations.Pieces(vocab), 6000
    found = segmentations.sampled(["thon"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), pieces, 3)
    first, pairs, log = Counter(), Counter(), {}
    for lattice, paths, after in found:
        ids = [tuple(segmentations.piece_ids(lattice, p.edges, pieces).tolist()) for p in paths]
        assert len(set(ids)) == 3 and paths[0].value >= paths[1].value >= paths[2].value >= after
        first[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
        log |= {i: p.log for i, p in zip(ids, paths, strict=True)}
    assert sum(math.exp(x) for x in log.values()) == pytest.approx(1, abs=1e-3)
    for a in log:
        assert first[a] / n == pytest.approx(math.exp(log[a]), abs=0.01)
        for b in log:
            if a != b:
                assert pairs[a, b] / n == pytest.approx(math.exp(log[a] + log[b]) / (1 - math.exp(log[a])), abs=0.02)


@needs_model
def test_lattice_mass_equals_brute_force():
    vocab = segmentations.vocabulary(alpha=0.3)
    pieces = segmentations.Pieces(vocab)
    weight = dict(zip(vocab.pieces, vocab.weights, strict=True))

    def total(text):
        return 1.0 if not text else sum(math.exp(weight[text[:n]]) * total(text[n:]) for n in range(1, len(text) + 1) if text[:n] in weight)

    for text in ("thhere", "ab cd", "ennemi"):
        lattice, paths, _ = segmentations.sampled([text], np.array([3], np.uint64), pieces, 1)[0]
        raw = sum(weight[vocab.pieces[p]] for p in lattice.piece[paths[0].edges])
        assert paths[0].log == pytest.approx(raw - math.log(total(" " + text)), abs=1e-9)


@needs_model
def test_segmentations_of_awkward_rows(spark):
    texts = [(1, "The quick  brown\tfox\n"), (1, "The quick  brown\tfox\n"), (2, None), (3, ""), (None, " lead and trail "), (4, "▁ literal ▁▁"), (5, "emoji 👩‍👩‍👧 ﬁ \x00 ünï"), (6, "nospace" * 3000), (7, "a"), (8, "日本語のテキスト" * 50), (9, "\n\n\n")]
    frame = spark.createDataFrame([(i, t, 5, [1]) for i, t in texts], "doc_id long, text string, sample int, ids array<int>")
    rows = segmentations.decoded(segmentations.encoded(frame, k=3)).collect()
    assert all(r["round_trip"] for r in rows) and {(r["doc_id"], r["decoded"]) for r in rows} == {(i, t or "") for i, t in texts}
    count = Counter(r["doc_id"] for r in rows)
    assert count[2] == count[3] == 1 and count[1] == 6 and count[6] == 3 and count[9] == 1
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] == 1}) == 3
    again = {(r["doc_id"], r["sample"]): r["ids"] for r in segmentations.encoded(frame.repartition(4), k=3).collect()}
    assert all(again[r["doc_id"], r["sample"]] == r["ids"] for r in rows)
    assert all(r["log_inclusion"] <= 0 and r["log_prob"] <= 0 for r in rows)
    assert segmentations.encoded(frame.where("false")).collect() == []


@needs_model
def test_lattice_edges_are_looked_up_directly(monkeypatch):
    """All pieces at all places, also those that share a slot of the table, without a binary search for each."""
    vocab = segmentations.vocabulary()
    pieces = segmentations.Pieces(vocab)
    at = {p: i for i, p in enumerate(vocab.pieces)}
    shared = [vocab.pieces[pieces.rows[i]] for i in np.flatnonzero(pieces.next >= 0)]
    assert len(shared) > 100
    chunks = [*shared, " there", "thhere", "naïve", "日本語", "a", "x☃☃y"]
    offsets = np.r_[0, np.cumsum([len(c) for c in chunks])]
    monkeypatch.setattr(np, "searchsorted", None)
    lattice = segmentations.Lattice(segmentations._codes("".join(chunks)), offsets, pieces)
    for chunk, first, last in zip(chunks, lattice.first.tolist(), lattice.last.tolist(), strict=True):
        assert last - first == len(chunk)
        for i, node in enumerate(range(first, last)):
            edges = range(lattice.edge[node], lattice.edge[node + 1])
            found = [(int(lattice.target[e]) - node, int(lattice.piece[e])) for e in edges]
            want = [(n, at[chunk[i:i + n]]) for n in range(1, len(chunk) - i + 1) if chunk[i:i + n] in at]
            assert found == (want if chunk[i] in at else want + [(1, segmentations.AS_BYTES + ord(chunk[i]))])
            assert lattice.chance[edges.start:edges.stop].sum() == pytest.approx(1, abs=1e-9)
