"""Pages, archives and vectors against brute force; the queries and the pipeline as registered."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cleanspan.llm import htmltext, topk, warc

PAGES = "page_id long, url string, html string, text string, n_chars string"

PROSE = (
    "The river is one of the longest in the region and it runs from the hills to the sea, with towns on both of its banks for most "
    "of the way. It was the main road of the country before there were any others, and much of what is old is still to be seen there."
)


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>Title</h1><p>{PROSE}</p></article><footer>&copy; x</footer>", f"Title\n\n{PROSE}"),
        (f"<div class='ad'>Buy the best of it now and for all of you</div><article><p>{PROSE}<p>Short &amp; sweet.</article>", f"{PROSE}\n\nShort & sweet."),
        (f"<header>Site of the year</header><div><h2>Heading</h2><p>{PROSE}</p></div><div id='comments'><p>{PROSE} I say.</p></div>", f"Heading\n\n{PROSE}"),
        (f"<div><p>{PROSE}</p><p>And so it is.</p><p>{PROSE}</p></div><aside>{PROSE}</aside>", f"{PROSE}\n\nAnd so it is.\n\n{PROSE}"),
        (f"<p><a href='/x'>{PROSE}</a></p>", ""),
        (f"<article><p>{PROSE}</p><script>if (a < b) document.write('</p>')</script><form><p>{PROSE}</p></form></article>", PROSE),
        (f"<article><p>a\t b<br>c &#233;&nbsp;d\n e</p><!-- {PROSE} --><p>{PROSE}</p></article>", f"a b c é d e\n\n{PROSE}"),
        ("", ""),
    ],
)
def test_main_text(body, want):
    assert htmltext.main_text(page(body)) == want


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div style='overflow:hidden'><p>{PROSE}</p></div>", PROSE),
        (f'<main data-title="hidden gems"><p>{PROSE}</p></main>', PROSE),
        (f"<article style='overflow-x:hidden' data-hidden=true><p>{PROSE}</p></article>", PROSE),
        (f"<div title='role=form' alt='a class=nav'><p>{PROSE}</p></div>", PROSE),
        (f"<div class='content no-sidebar'><p>{PROSE}</p></div>", PROSE),
        (f"<div id='content-sidebar-wrap'><div class='has-banner'><article><p>Short.</p></article></div><div class='site-footer'>Ring us</div></div>", "Short."),
        (f"<p>{PROSE}</p><div hidden><p>{PROSE}</p></div><div class='x sidebar'><p>{PROSE}</p></div><p aria-hidden='true'>{PROSE}</p>", PROSE),
    ],
)
def test_attributes_are_read_by_name(body, want):
    assert htmltext.main_text(page(body)) == want


def test_pages_that_are_cut_off():
    for end in ("An end that is cut <b", "An end that is cut &amp; <a href='/x", "An end that is cut <!-- no"):
        assert htmltext.main_text(f"<html><body><article><p>{PROSE}</p><p>{end}").split("\n\n")[1].startswith("An end that is cut")
        assert "<" not in htmltext.main_text(f"<html><body><article><p>{PROSE}</p><p>{end}")


def test_two_passes():
    short, near = "Too short to tell", "It is of the size that is in between and so it has to be seen by what is near it in the page"
    got = htmltext.main_text(page(f"<div>{short}</div><p>{PROSE}</p><div>{near}</div><div>{short}</div>"))
    assert got == f"{PROSE}\n\n{near}"


def test_slashes_at_the_end_of_tags():
    assert htmltext.main_text(page(f"<div/><p>{PROSE}</p>")) == PROSE
    assert htmltext.main_text(page(f"<p><svg/>{PROSE}</p>")) == PROSE
    assert htmltext.main_text(page(f"<p><a href=/x/>{PROSE}</a></p>")) == ""


def made_page(rng):
    """A page put together from blocks that are content and blocks that are not, and the text of the former."""
    words = PROSE.replace(",", "").replace(".", "").split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    odd = lambda n: " ".join("".join(rng.choice("qwzx") for _ in range(6)) for _ in range(n))
    good, body = [], []

    def content(text, tag="p"):
        good.append(" ".join(text.split()))
        body.append(f"<{tag}>{text.replace('&', '&amp;')}</{tag}>")

    noise = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{i}>{say(2)}</a></li>' for i in range(4))}</ul></nav>",
        lambda: f"<aside><p>{say(60)}</p></aside>", lambda: f"<div class='ad'>{say(50)}</div>", lambda: f"<form>{say(40)}</form>",
        lambda: f"<script>var s = '<p>{say(40)}</p>';</script>", lambda: f"<div id=comments><p>{say(60)}</p></div>",
        lambda: f"<!-- <p>{say(40)}</p> -->", lambda: f"<div hidden><p>{say(60)}</p></div>", lambda: f"<p><a href=/x>{say(30)}</a></p>",
    ]
    inside = rng.random() < 0.6
    body += [rng.choice(noise)() for _ in range(rng.randint(0, 3))] + ["<article>" if inside else "<div>"]
    content(say(5), "h2")
    content(say(60))
    for _ in range(rng.randint(0, 5)):
        kind = rng.random()
        if kind < 0.3:
            body.append(rng.choice(noise[1:])())
        elif kind < 0.6 and inside:
            content(rng.choice([say(3), odd(40), odd(3), say(9) + " & so"]), rng.choice(["p", "li", "h3"]))
        else:
            content(say(rng.randint(50, 80)) + " &\n \u00e9")
    content(say(60))
    body += ["</article>" if inside else "</div>", f"<footer>{say(40)}</footer>", *(rng.choice(noise)() for _ in range(rng.randint(0, 2)))]
    return page("".join(body)), "\n\n".join(good)


def test_pages_that_are_put_together():
    rng = random.Random(11)
    for _ in range(400):
        made, want = made_page(rng)
        assert htmltext.main_text(made) == want, made


def odd_pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://a/{i}", page(f"<article><p>{PROSE} {rng.random()}</p></article>"), "t", "n") for i in range(40)]
    rows += [(100 + i, None, rows[7][2], None, None) for i in range(9)] + [rows[3], rows[3]]
    rows += [(60, "u", None, "t", "n"), (61, None, "", "t", "n"), (None, "z", rows[7][2], "t", "n"), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(62, "x\r\ny", "<p>" + "word & é \U0001f600 " * 60_000, "t", "n"), (63, "g", "".join(chr(rng.randint(32, 0xD7FF)) for _ in range(30_000)), "t", "n")]
    return rows, spark.createDataFrame(rows, PAGES).repartition(4)


def test_extract(spark):
    rows, df = odd_pages(spark)
    got = htmltext.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = Counter((r[0], r[1], t := htmltext.main_text(r[2]), len(t)) for r in rows)
    assert Counter(map(tuple, got.collect())) == want
    assert htmltext.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("least", [0, 1])
def test_archives(spark, least):
    rows, df = odd_pages(spark)
    manifest = warc.stored(warc.write(df, warc.fresh_path(spark, "test-warc"), least, archive_bytes=2_000), "test-manifest")
    assert manifest.count() > 5
    got = warc.read(manifest, split_bytes=4099).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] or "").encode()].append((r[0] is None, r[0] or 0))
    want = Counter()
    for data, ids in groups.items():
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first, *others = sorted(ids)
        plain = lambda x: None if x[0] else x[1]
        want[(plain(first), len(data), sha, "response", None)] += 1
        for x in others:
            want[(plain(x), len(data), sha, "revisit", plain(first)) if len(data) >= least else (plain(x), len(data), sha, "response", None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.url for r in got} == {r[1] for r in rows}
    pages = Counter((r.page_id, r.html) for r in got if r.record_type == "response")
    assert all((i, h or "") in {(r[0], r[2] or "") for r in rows} for i, h in pages)
    assert sum(m.records for m in manifest.collect()) == len(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_ranges_own_each_record_once(tmp_path):
    """Whatever the ranges, and with bytes in the payloads that look like members."""
    path = str(tmp_path / "a.warc.gz")
    rng = random.Random(1)
    fake = warc.GZIP_MAGIC.decode("latin-1") * 50
    with open(path, "wb") as f:
        for i in range(60):
            f.write(warc.record(i, f"u{i}", "".join(chr(rng.randint(32, 0x2FF)) for _ in range(rng.randint(0, 900))) + fake, False, None))
    size = sum(1 for _ in open(path, "rb").read())
    for step in (1999, 50_000, size):
        seen = [warc.parse(raw)[0] for a in range(0, size, step) for raw in warc.records_in(path, a, min(a + step, size))]
        assert seen == list(range(60)), step
    assert list(warc.records_in(path, 1, 2)) == []
    with open(path, "r+b") as f:
        f.truncate(size - 5)
    assert len(list(warc.records_in(path, 0, size - 5))) == 59


def brute_top(rows, every, k):
    scale = {}
    sound = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in sound:
        if i % every == 0:
            scores = sorted((-int(q @ v), j) for j, v in sound if j != i)[:k]
            scale[(i, q.tobytes())] = [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    return sorted(x for v in scale.values() for x in v)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)] + [(40, rows[40][1]), (11, rows[11][1])]
    rows += [(None, rows[1][1]), (500, None), (510, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (520, [float("nan")] * 6), (530, [float("inf")] + [0.0] * 5), (540, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "r") for i, v in rows], "vec_id long, embedding array<float>, label int, rank string").repartition(3)
    for blocks in ({"candidate_block": 50, "query_block": 9}, {}):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, every=10, **blocks).collect())
        assert got == brute_top(rows, 10, 5)
    few = df.where("vec_id IN (0, 10, 11)")
    assert topk.top_k(few, every=10).count() == sum(1 for _ in brute_top([r for r in rows if r[0] in (0, 10, 11)], 10, 5))
    assert topk.top_k(df.limit(0)).count() == 0


def test_threshold_algorithm_stops_early():
    """With one strong direction the walk ends long before the end of the lists, and the result is exact."""
    rng = np.random.default_rng(6)
    vectors = rng.integers(-9, 10, (4000, 3)).astype(float)
    vectors[:, 0] = rng.permutation(4000)
    queries, ids = np.array([[50.0, 1, 1], [-50.0, 1, -1]]), np.arange(4000)
    scores, found = topk.best_of_block(queries, np.array([-1, -1]), vectors, ids, 5)
    for q, s, f in zip(queries, scores, found, strict=True):
        order = np.lexsort((ids, -(vectors @ q)))[:5]
        assert f.tolist() == order.tolist() and s.tolist() == (vectors @ q)[order].tolist()


def test_a_known_score_closes_a_block():
    rng = np.random.default_rng(7)
    vectors, ids = rng.integers(-5, 6, (500, 4)).astype(float), np.arange(500)
    queries = rng.integers(-5, 6, (6, 4)).astype(float)
    every, _ = topk.best_of_block(queries, np.full(6, -1), vectors, ids, 3)
    same, _ = topk.best_of_block(queries, np.full(6, -1), vectors, ids, 3, every[:, -1])
    assert (every == same).all()
    above, _ = topk.best_of_block(queries, np.full(6, -1), vectors, ids, 3, np.full(6, 1e9))
    assert np.isinf(above).all()


def test_toxicity_on_held_out_labels(spark):
    from cleanspan.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.predictions(docs.repartition(4), labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows]) == 1
    above = (score[toxic][:, None] > score[~toxic]).mean() + (score[toxic][:, None] == score[~toxic]).mean() / 2
    assert toxic.sum() > 50 and above > 0.95 and ((score >= 0.5) == toxic).mean() > 0.97


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_pipeline(spark):
    """Each stage against what its operator decides on its own input."""
    import corpus_pipeline
    from cleanspan.llm import mixing, packing, quality, simhash, toxicity

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels, seen = docs.columns, spark.read.parquet(f"{sf_dir}/labels.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = warc.stored(stage(spark, docs, sf_dir), "test-stage")
        seen.append((name, docs, out))
        if name != "packing":
            assert out.columns == columns
        docs = out
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    assert ids(b) == ids(quality.assess(a).where("kept"))
    assert ids(c) == ids(toxicity.predictions(b, labels).where("predicted = 0"))
    assert ids(d) == sorted({r.component_id for r in simhash.near_duplicates(c).collect()})
    times = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.planned(d).collect() if r["size"]}
    assert Counter(ids(e)) == Counter({k: v for k, v in times.items() if v})
    assert f.count() == packing.pieces(e).count() and f.agg({"length": "sum"}).first()[0] == sum(
        len(packing.encoder(packing.default_tokenizer()).encode(r.text)) // 4 + 1 for r in e.collect()
    )


def test_pipeline_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = warc.stored(stage(spark, docs, "/root/testdata/sf0.001"), "test-odd")
            assert name == "packing" or out.columns == odd.columns
            docs = out


def test_crc_of_pieces():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
