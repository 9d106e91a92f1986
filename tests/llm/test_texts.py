"""Pieces, HTML and media: exact round trips, the library's ids, hard cases."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.llm import html_extraction as H
from verdictlake.llm import media as M
from verdictlake.llm import sentencepiece_codec as P

DOC = "doc_id long, text string"
needs_model = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no public tokenizer here")


def some_texts(n=400, seed=0):
    rng = random.Random(seed)
    letters = "abcdeéß日本🎉  \n.,the ing▁aaaa   \t\x01"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)] + ["", " ", "\n", "  a", "a" * 5000, "the quick brown fox " * 50, "🎉", "\x00"]


@needs_model
def test_ids_are_the_library_s(spark):
    import sentencepiece

    texts = some_texts()
    encoder = P.Encoder(P.Vocabulary.load())
    want = sentencepiece.SentencePieceProcessor(model_file=P.MODEL).encode(texts)
    assert [i.tolist() for i in encoder.encode(texts)] == want


@needs_model
def test_texts_without_spaces(spark):
    """Long words: the library's ids, and in no time that grows with a step a letter."""
    import time

    import sentencepiece

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(8000)), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(8000)), "".join(rng.choice("日本語のテキスト。") for _ in range(3000)), "-" * 300 + "x" * 50]
    encoder = P.Encoder(P.Vocabulary.load())
    start = time.time()
    got = [i.tolist() for i in encoder.encode(texts)]
    assert time.time() - start < 8
    assert got == sentencepiece.SentencePieceProcessor(model_file=P.MODEL).encode(texts)


@needs_model
def test_unigram_ids_are_the_library_s(tmp_path):
    """The same pieces as a unigram model: the sum of scores decides."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(P.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = P.UNIGRAM
    rng = random.Random(9)
    for p in model.pieces:
        if p.type == P.NORMAL:
            p.score = -8 - 4 * rng.random() + 0.5 * len(p.piece)
    path = tmp_path / "u.model"
    path.write_bytes(model.SerializeToString())
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdetionhers  ") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    encoder, library = P.Encoder(P.Vocabulary.load(str(path))), sentencepiece.SentencePieceProcessor(model_file=str(path))
    score = lambda ids: sum(encoder.v.scores[i] for i in ids)
    for text, ids, want in zip(texts, encoder.encode(texts), library.encode(texts), strict=True):
        assert ids.tolist() == want or abs(score(ids) - score(want)) < 1e-3, text


@needs_model
def test_round_trip_through_tables(spark):
    texts = [t for t in some_texts() if P.SPACE not in t]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, DOC).withColumn("ids", F.lit("clash"))
    v = P.Vocabulary.load()
    coded = P.encode(df, v)
    got = coded.collect()
    assert len(got) == len(rows) and all(r.exact and r.n_tokens == len(r.ids) for r in got)
    back = {r.doc_id: r.text for r in P.decode(coded.filter("doc_id is not null and doc_id <> 7"), v).collect()}
    assert back == {k: t for k, t in rows if k not in (None, 7)}
    assert P.encode(df.limit(0), v).count() == 0
    marked = P.encode(spark.createDataFrame([(1, "a▁b")], DOC), v).first()
    assert not marked.exact and P.Encoder(v).decode(marked.ids) == "a b"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
<article><header>By me</header><h1>Head &amp; more</h1><p>One  two<br>three<p><b>Open<div class="share-buttons"><div>Share</div></div><ul><li>i1<li>i2</ul>
<table><tr><td>c1</td><td>c2</td></tr></table><section class="comments"><article class="comment"><p>First!</p></article></section><aside>Side</aside><!-- no --><p>Last &lt;tag&gt; &#8364;</article>
<form><input><button>Go</button></form><footer>&copy; F</footer></body>"""


NONE = np.zeros(0, np.uint64)


def alone(page):
    return H.main_text(page, NONE, set()).split("\n\n")


def test_article_of_a_page():
    assert alone(PAGE) == ["Head & more", "One two three", "Open", "i1", "i2", "c1", "c2", "Last <tag> €"]
    for broken in (None, "", "<", "<article", "<p>x", "a < b", "<article><p>x", "<!-- open", "<script>never closed", "</div></article>x", "<p>" * 3000):
        H.main_text(broken, NONE, set())
    assert alone("<main><p>in</p></main><p>out</p>") == ["in"]


def test_wrappers_do_not_hide_the_article():
    for wrapper in ("has-sidebar", "section-header", "comments-open", "with-ads wide"):
        assert alone(f'<body><div class="{wrapper}"><p>x</p><article><p>Text of it</p></article></div></body>')[-1] == "Text of it", wrapper
    assert alone('<article><p>A</p></article><div id="comments"><article><p>First!</p></article></div>') == ["A"]
    assert alone('<aside><article>side</article></aside><p>body</p>') == ["body"]


def test_repeated_runs_against_counting():
    rng = random.Random(3)
    streams = [H._hashes([f"w{rng.randint(0, 6)}" for _ in range(rng.randint(0, 60))]) for _ in range(40)]
    grams, n = H.repeated_runs(streams)
    want = {}
    for k, w in enumerate(streams):
        for g in {tuple(w[i : i + H.RUN].tolist()) for i in range(len(w) - H.RUN + 1)}:
            want.setdefault(g, set()).add(k)
    assert dict(zip(grams.tolist(), n.tolist(), strict=True)) == {int(H._gram_hashes(np.array(g, np.uint64))[0]): len(v) for g, v in want.items()}
    assert len(H.repeated_runs([NONE])[0]) == len(H.repeated_runs([])[0]) == 0


def own_words(k, n=20):
    return " ".join(f"own{k}x{j}" for j in range(n))


@pytest.mark.parametrize("bound", [H.MAX_BROADCAST_RUNS, 0])
def test_pages_without_marks_lose_what_their_host_repeats(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "MAX_BROADCAST_RUNS", bound)
    menu = "<div>Home News Sport Weather Culture Travel Money Jobs Shop</div>"
    rows = [(k, f"https://Site.example.com/{k}", f"<html><body>{menu}<section>{own_words(k)}</section></body></html>") for k in range(5)]
    # an article on three pages is no boilerplate, with marks or without
    rows += [(20 + k, f"https://copies.example.com/{k}", f"<body>{menu}<section>{own_words(7, 60)}</section></body>") for k in range(3)]
    rows += [(30 + k, f"https://copies.example.com/m{k}", f"<body>{menu}<article><p>{own_words(7, 60)}</p></article></body>") for k in range(3)]
    # what articles of a host repeat in a place of its own goes from them too, as it stands outside others
    share = "tell your friends about this story on every network now"
    rows += [(40 + k, f"https://share.example.com/{k}", f'<body><article><p>{own_words(k, 40)}</p><section>{share}</section></article><section>{share}</section></body>') for k in range(4)]
    rows += [(10, "https://other.example.com/", f"<body>{menu}</body>"), (11, None, None), (12, "u", ""), (13, "https://site.example.com/a", PAGE), (13, "https://site.example.com/a", PAGE)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = H.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert [by[k] for k in range(5)] == [own_words(k) for k in range(5)]
    assert by[10].startswith("Home News") and by[11] == by[12] == ""
    assert all(by[20 + k].endswith(own_words(7, 60)) and by[30 + k] == own_words(7, 60) for k in range(3))
    assert all(by[40 + k] == own_words(k, 40) for k in range(4))
    assert by[13].startswith("Head & more\n\nOne two three")
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_the_text_is_the_same_where_articles_are_not_marked(spark):
    """Every page of a table, with and without its article elements, against a plain reading of the article."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        plain[r.page_id] = "\n\n".join(x for x in parts if x)
    unmarked = pages.withColumn("html", F.regexp_replace("html", "<(/?)article", "<$1div"))
    assert {r.page_id: r.text for r in H.extract(pages).collect()} == plain
    # without marks, a heading that two pages of a small host share is taken for boilerplate
    equal = sum(plain[r.page_id] == r.text for r in H.extract(unmarked).collect())
    assert equal >= 0.98 * len(plain)


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long text " * 20_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "a")], DOC).withColumn("media", F.lit(1))
    got = {r.doc_id: r for r in M.media_columns(df).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        raw, r = (t or "").encode(), got[k]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert M.read_back(bytes(r.media)) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        table = M.load_tensors(bytes(r.features))
        assert table.schema.field("log_mel").type.shape == [M.PATCH_FRAMES, M.MELS] and len(table) == r.n_tensors == -(-r.n_frames // M.PATCH_FRAMES)
        assert r.tensors_sha256 == hashlib.sha256(bytes(r.features)).hexdigest() and table.column("end_s").to_pylist()[-1] == pytest.approx(r.n_frames * M.HOP * M.DOWN / M.RATE)
        assert all(a.end_s <= b.start_s for a, b in zip(r.segments, r.segments[1:]))
    assert got[None].feature == got[2].feature and got[0].feature == got[1].feature
    assert M.media_columns(df.limit(0), keep=False).count() == 0


def test_resampling_is_polyphase():
    """The same as filtering with zeros in between, for several ratios."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=300).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        phases = M._filter(up, down, M.TAPS)
        width = phases.shape[1]
        got = M.resample(x, up, down)
        padded = np.pad(x, (width // 2, width + down))
        want = [float(phases[(k * down) % up] @ padded[(k * down) // up : (k * down) // up + width]) for k in range(len(got))]
        assert np.allclose(got, want, atol=1e-4)


def test_log_mel_against_the_formulas():
    """Windowed frames, discrete Fourier sums and triangular bands, term by term."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=700)
    got = M.log_mel(x.astype(np.float32))
    n = max(1, -(-(len(x) - M.FRAME) // M.HOP) + 1)
    padded = np.r_[x, np.zeros(n * M.HOP + M.FRAME)]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    top = M.RATE * M.UP / M.DOWN / 2
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(20.0), mel(top), M.MELS + 2)]
    t = np.arange(M.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / (M.FRAME - 1))
    assert got.shape == (n, M.MELS)
    for k in range(n):
        frame = padded[k * M.HOP : k * M.HOP + M.FRAME] * window
        power = [abs((frame * np.exp(-2j * np.pi * f * t / M.FRAME)).sum()) ** 2 for f in range(M.FRAME // 2 + 1)]
        for band in range(M.MELS):
            low, mid, high = edges[band : band + 3]
            total = 0.0
            for f, p in enumerate(power):
                hz = f * 2 * top / M.FRAME
                total += p * max(0.0, min((hz - low) / (mid - low), (high - hz) / (high - mid)))
            assert got[k, band] == pytest.approx(np.log10(max(total, 1e-10)), abs=2e-3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_media_query_row_by_row(spark):
    """The whole query on the smallest table, each value worked out anew from the text."""
    from verdictlake.llm import queries as Q

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = Q.op10_media(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        file = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0]) + M.RATE.to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0]) + b"data" + len(payload).to_bytes(4, "little") + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(file).hexdigest())
        mel = M.log_mel(M.resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
        assert np.allclose([float(v) for v in r.feature.split(",")], [*mel.mean(0), *mel.std(0)], atol=2e-3)
        assert r.n_segments == len(r.segments) and r.active_s == pytest.approx(sum(s.end_s - s.start_s for s in r.segments), abs=1e-5)


def test_features_hear_a_tone_and_its_span():
    t = np.arange(M.RATE) / M.RATE
    tone = np.where((t > 0.4) & (t < 0.7), np.sin(2 * np.pi * 1000 * t), 0.001 * np.sin(2 * np.pi * 100 * t)).astype(np.float32)
    mel = M.log_mel(M.resample(tone))
    spans = M.segments(mel)
    assert any(abs(a - 0.4) < 0.05 and abs(b - 0.7) < 0.05 for a, b in spans)
    loud = mel[int(0.55 / (M.HOP * M.DOWN / M.RATE))]
    assert 4 <= loud.argmax() <= 9
