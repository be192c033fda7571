"""Operators on texts against brute force, and their defined results for odd rows."""

import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from spanloom.llm import decontaminate, fingerprints, html_text, lm_scoring, queries, token_counts, warc
from spanloom.llm.common import WORD, crc_mod, sliced, text_buffer, word_hashes

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "a", "a b", "a b", "\t\x0b\x0c", "É é", "x" * 5000, "wörd " * 300, "\x00", "🙂 🙂"]


def docs(spark, texts, start=0):
    """Rows with a clashing extra column; the last two rows repeat, one id is null."""
    rows = [(k + start, t, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "null id", "y")] if rows else [], "doc_id long, text string, id string")


def words(text):
    return re.findall(WORD, (text or "").translate(LOW))


def test_word_hashes_are_words():
    texts = [*ODD, "The cat\nTHE Cat"]
    h, first = word_hashes(*text_buffer(pa.array(texts)))
    flat = [w for t in texts for w in words(t)]
    assert len(h) == len(flat) and len(set(h.tolist())) == len(set(flat)) == len(set(zip(flat, h.tolist(), strict=True)))
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]


def test_slices_are_bounded_by_bytes():
    texts = ["a" * 10, None, "b" * 900, "", "é" * 40, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["k", "t"])
    parts = [p.column(0).to_pylist() for p in sliced(batch, 1, 100)]
    assert parts == [[0, 1], [2], [3, 4, 5]] and list(sliced(batch.slice(0, 0), 1)) == []


# ---------------------------------------------------------------- token counts


def test_token_counts_are_the_librarys(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, library = token_counts.PieceCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  é你\n▁🙂x\tthes") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["  ", "x</s>y<s>", "▁", "a ", " a"]
    want = [len(library.encode(t)) for t in texts]
    assert counter.count(texts) == want
    monkeypatch.setattr(token_counts, "LONG_CHUNK", 3)
    counter.forget()
    assert counter.count(texts) == want


def test_token_counts_of_odd_rows(spark):
    got = token_counts.count_tokens(docs(spark, ODD), public_tokenizers.path("piece_bpe_32k.model"), limit=10).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got}
    assert (by[0].n_bytes, by[0].n_tokens, by[0].over_limit) == (0, 0, False) and by[8].over_limit and None in by
    assert token_counts.count_tokens(docs(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_estimate_generalised_jaccard():
    rng = random.Random(7)
    errors = []
    for _ in range(60):
        base = [f"w{rng.randint(0, 80)}" for _ in range(150)]
        other = base[rng.randint(0, 80) :] + [f"w{rng.randint(0, 200)}" for _ in range(40)]
        a, b = (Counter(x) + Counter(zip(x, x[1:])) for x in (base, other))
        exact = sum((a & b).values()) / sum((a | b).values())
        errors.append(fingerprints.likeness(*fingerprints.signatures(*text_buffer(pa.array([" ".join(base), " ".join(other)])))) - exact)
    assert abs(np.mean(errors)) < 0.025 and np.std(errors) < 0.09


def test_edits_follow_descending_ids(spark):
    texts = [*ODD, *(f"text number {k} of a few" for k in range(30))]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
    same = {}
    for i, t in rows:
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert fingerprints.with_edits(docs(spark, [])).count() == 0 and fingerprints.with_edits(docs(spark, ODD)).count() == len(ODD) + 2
    assert fingerprints.fingerprint(docs(spark, ODD)).where("doc_id = 0").first().fingerprint == ""


# ---------------------------------------------------------------- language model


def test_lm_counts_are_exact_and_scores_are_the_models(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.score_held_out(d).collect()}
    tokens = {r.doc_id: [*words(r.text), None] for r in d.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    pairs = Counter(p for i, ts in tokens.items() if not held[i] for p in zip([None, *ts], ts))
    n, v = sum(c.values()), len(c)
    unseen, back = sum(x == 1 for x in c.values()) / (n + 1), sum(x == 1 for x in pairs.values()) / sum(pairs.values())

    def low(x):
        """The least count of its level."""
        return 2 ** (math.floor(2 * math.log2(x) + 1e-9) / 2) if x else 0

    def log_p(before, t):
        alone = (1 - unseen) * c[t] / n if c[t] else unseen
        if not c[before]:
            return math.log10(alone)
        return math.log10((1 - back) * min(low(pairs[before, t]) / c[before], 1) + back * alone)

    off = 0
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(c[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
        model = sum(log_p(a, b) for a, b in zip([None, *ts], ts))
        off += abs(r.score - model)
        assert abs(r.score - model) < 0.02 * len(ts) + 3
    assert off < 0.002 * sum(map(len, tokens.values()))  # a false level of the filter changes a term now and then
    mine = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    monkeypatch.setattr(lm_scoring, "GATHER", 2_000)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = {r.doc_id: r for r in lm_scoring.score(d.repartition(5), crc_mod("doc_id", 7) != 2, filter_bytes=0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(
        again[i].score == r.score and again[i].n_known == r.n_known and again[i].base_score == pytest.approx(r.base_score, rel=1e-12) for i, r in got.items()
    )


def test_lm_knows_pairs_seen_once(spark):
    rng = random.Random(4)
    d = docs(spark, [" ".join(rng.sample([f"w{k}" for k in range(40)], 40)) for _ in range(3)] + ["w1 a w2 b w3", "w1 a w2 b w3", "w1 b w2 a w3"])
    got = {r.doc_id: r.score for r in lm_scoring.score(d, "doc_id < 4").collect()}
    assert got[4] > got[5] + 0.5  # a and b occur once, each pair of the former text is seen once, of the latter never


def test_filter_never_underestimates():
    low = np.unique(np.random.default_rng(1).integers(0, 2**32, 5000, dtype=np.uint64))
    keys = low + (np.random.default_rng(3).integers(0, 4, len(low), dtype=np.uint64) << np.uint64(32))
    levels = np.random.default_rng(2).integers(1, 9, len(keys))
    part = lm_scoring.build_filter(keys, levels).tobytes()
    found = lm_scoring.Filter(part * 4, {k: len(part) for k in range(4)}, 2).levels(keys)
    assert (found >= levels).all() and (found > levels).mean() < 0.005
    packed = lm_scoring._unpack(lm_scoring._pack(low, levels, levels / 3))
    assert (packed[0] == low).all() and (packed[1] == levels).all() and np.allclose(packed[2], levels / 3)


def test_lm_odd_rows(spark):
    assert lm_scoring.score(docs(spark, [])).count() == 0
    got = lm_scoring.score(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) + 2 and all(r.n_known == r.n_tokens for r in got)
    none = lm_scoring.score(docs(spark, ODD), crc_mod("doc_id", 1) == 5).collect()
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in none)


# ---------------------------------------------------------------- decontamination


def oracle(con, d, b):
    con.register("documents", d)
    con.register("benchmark", b)
    return con.sql(decontaminate.ORACLE).fetchall()


def test_decontamination_matches_sql(spark):
    w = [f"w{k}" for k in range(40)]
    bench = [(1, " ".join(w[:20])), (2, "Short item"), (3, None), (4, "!!"), (5, " ".join(w[5:25])), (5, " ".join(w[5:25])), (6, "é")]
    texts = [
        "x " * 30 + " ".join(w[3:17]),
        "a short ITEM, short item",
        None,
        "",
        " ".join(w),
        " ".join(w),
        " ".join(w[:12]),
        "é É",
        " ".join(w + w),
        "y " * 400 + " ".join(w[:13]),
    ]
    d = docs(spark, texts)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.hits(d, b).collect()), key=str)
    assert got == sorted(oracle(duckdb.connect(), d.toArrow(), b.toArrow()), key=str)
    clean = decontaminate.clean(d, b)
    assert clean.columns == d.columns and sorted(r.doc_id is None or r.doc_id for r in clean.collect()) == sorted(r[0] is None or r[0] for r in got if not r[5])
    none = spark.createDataFrame([], b.schema)
    assert decontaminate.hits(docs(spark, []), none).count() == 0 and decontaminate.hits(d, none).where("contaminated").count() == 0


def test_decontamination_plan_is_native(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plan = decontaminate.hits(d, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


# ---------------------------------------------------------------- pages


def test_main_text_rules():
    page = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="menu"><a href=1>Home</a></div><div class="content"><h2>Title here</h2>
    <p>This is the first paragraph of the story, and it is long enough to be decided by the stop words that it has in it.<p>Short  one.
    <div class="related-posts"><p>This is the related posts thing of the site and it is long enough to be good but it is not.</div>
    <p>AT&amp;T &lt;b&gt; and the end of the text which is in the same place as the other &#8212; it goes on and on for the rest.</p><form><input><p>Sign up for the newsletter of the site.</form></div>
    <section id="comments"><p>I think that this is the best of the texts that I have read in the last year and I am glad it is here.</section><footer>the end</footer><script>if (a<b) {"</p>"}</script></body>"""
    assert html_text.main_text(
        page
    ) == "Title here\n\nThis is the first paragraph of the story, and it is long enough to be decided by the stop words that it has in it.\n\nShort one.\n\nAT&T <b> and the end of the text which is in the same place as the other — it goes on and on for the rest."
    assert html_text.main_text("<article><h1>T</h1><p>a<b>b</b>c<br>d</article>") == "T\n\nabc d"
    for broken in (None, "", "<", "<p", "a<b", "<a <a " * 5000, "<!-- x", "<script>", "<div " + '"' * 9999, "<p>" * 9999, "</p>" * 9999):
        html_text.main_text(broken)


@pytest.mark.parametrize("tail", ["", " "])
def test_pages_of_other_languages_without_article(tail):
    """Long paragraphs count without known stop words, unless the page shows that its prose has them."""
    finnish = "Tämä kappale kertoo pitkästi siitä, miten kaupungin vanha satama muuttui vuosien aikana ja miksi."
    russian = "Этот абзац достаточно длинный, чтобы правила приняли его за основной текст страницы без списка слов."
    links = "<ul>" + "".join(f"<li><a href=http://x.com/{k}/>linkki numero {k}</a>" for k in range(5)) + "</ul>"
    for one in (finnish, russian):
        page = f"<body><div class='menu'/><p>{one}</div>{links}<div class=content><p>{one}{tail}<p>{one}</div><div id=footer>{one}</div></body>"
        assert html_text.main_text(page) == f"{one}\n\n{one}"
    english = "This is the kind of prose that the page is made of, and it has the words that all of them have."
    junk = "cheap shoes boots sandals sneakers slippers loafers heels flats clogs moccasins trainers pumps"
    page = f"<div><p>{english}<p>{english}</div><ul><li><a href=/a>{junk}</a></ul><p>{junk}</p><ul><li><a href=/b>{junk}</a></ul>"
    assert html_text.main_text(page) == f"{english}\n\n{english}"


def test_markup_as_html_reads_it():
    text = "This is the text that the page has for the reader, and it is long enough for the rules that there are."
    for page, want in [
        (f'<div class="menu"/><p>{text}</p></div><p>{text}</p>', text),  # the slash closes nothing
        (f"<p><a href=http://x.com/>{text}</a></p><p>{text}</p>", text),  # nor does it unmake a link
        (f"<div role='main'><p>{text}<h2>Short</h2><p>tail</div>", f"{text}\n\nShort\n\ntail"),
        (f"<svg><path d='x'/><text>no</text></svg><p>{text}", text),
        (f"<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><p>{text}</article>", f"one\n\ntwo\n\na\n\nb\n\nc\n\n{text}"),
        (f"<article><h1><b>Bold title</b></h1><p>{text}</article>", f"Bold title\n\n{text}"),
        (f"<article hidden><p>{text}</article><article><p>{text}</article>", text),
        (f"<p>{text}<p>&nbsp;&#x41;&amp;lt;&notit; {text}", f"{text}\n\nA&lt;¬it; {text}"),
    ]:
        assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "unit,tail",
    [
        ("<b>", "</i>"),
        ("<div>", "</p>"),
        ("<p>", "</div>"),
        ('<a ">"', ""),
        ('<a "', "'"),
        ("<a 'x\" ", ""),
        ("<li><b>", "</li>"),
        ("<table><tr><td>", "</td>"),
        ("<svg>", "<path/>"),
        ("<!--", ""),
        ("&", ""),
        ("<title>", ""),
        ("x = ", ""),
        ("<a x ", "= "),
    ],
)
def test_time_follows_the_length_of_a_page(unit, tail):
    page = unit * (500_000 // len(unit)) + "x" + tail * (500_000 // max(len(tail), 1)) + ">"
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 2


def test_stop_words_are_learnt_from_long_blocks(spark, monkeypatch):
    monkeypatch.setattr(html_text, "LEARNT_BLOCKS", 2)
    monkeypatch.setattr(html_text, "LEARNT_SHARE", 0.5)
    block = "ja se on niin kuin se oli ennen ja tulee olemaan aina ja ikuisesti maailman loppuun asti kaikille"
    p = spark.createDataFrame(
        [(k, "u", f"<p>{block} {'abcd'[k] * 3}</p><p><a>{'linked ' * 20}</a></p>{'<p>short</p>' * 9}") for k in range(4)],
        "page_id long, url string, html string",
    )
    got = html_text.learnt_words(p) - html_text._STOP
    assert got == set(block.split()) - html_text._STOP
    assert html_text.learnt_words(p.limit(0)) == html_text._STOP


def test_article_text_of_generated_pages(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(r.html) == "\n\n".join(p for p in parts if p)


def test_extract_odd_rows(spark):
    p = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.n_chars, r.text) for r in html_text.extract(p).collect()) == [(0, ""), (0, ""), (0, "")]
    assert html_text.extract(p.limit(0)).count() == 0
    long = spark.createDataFrame([(1, None, "<article>" + f"<p>{'word ' * 20}</p>" * 20_000, 5)], "page_id long, url string, html string, text int")
    assert html_text.extract(long).first().n_chars == 20_000 * 101 - 2


# ---------------------------------------------------------------- archives


def test_archives_round_trip(spark, tmp_path):
    big, tricky = "x" * 100_000, "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 100
    rows = [
        (1, "u", big),
        (2, "u", big),
        (3, None, tricky),
        (4, "u\r\nX: y", tricky),
        (4, "v", tricky),
        (5, "w", None),
        (None, "n", big),
        (6, "", "a"),
        (7, "", "a"),
    ]
    p = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, name int").repartition(3)
    warc.write(p, f"file://{tmp_path}/warc")
    got = warc.read(spark, f"file://{tmp_path}/warc").collect()
    assert len(got) == len(rows)
    for r in got:
        want = (dict((k, h) for k, _, h in rows)[r.page_id] or "").encode()
        assert r.payload_bytes == len(want) and r.payload_digest == hashlib.sha1(want).hexdigest() and (r.record_type == "revisit" or bytes(r.payload) == want)
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(1, 2), (3, 4)]
    heads = [f for x in (tmp_path / "warc").glob("*.gz") for f, _ in warc.parse(gzip.decompress(x.read_bytes()))]
    names = [f["warc-record-id"] for f in heads]
    assert len(set(names)) == len(names) and [f["warc-refers-to"] in names for f in heads if "warc-refers-to" in f] == [True]  # page 4 is twice there
    assert warc.round_trip(p.limit(0)).count() == 0
    long = spark.createDataFrame([(1, None, "wörd " * 1_000_000, 0)], p.schema)
    assert [(r.payload_bytes, r.record_type) for r in warc.round_trip(long).collect()] == [(6_000_000, "response")]


def test_chunks_and_broken_archives(spark, tmp_path):
    for n in (0, 1, 8192, 8193, 50_000):
        assert warc.dechunked(warc.chunked(b"z" * n)) == b"z" * n
    for bad in (b"", b"5\r\nabc", b"3\r\nabc\r\n", b"0\r\n\r\nmore", b"x\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    records = warc.records_of(1, 1, "u", b"q" * 100_000)
    assert len(records) == 4
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "x.warc").write_bytes(b"\r\n\r\n".join([records[2], records[0], records[3], records[1], b""]))
    assert warc.read(spark, f"file://{folder}").first().payload_bytes == 100_000
    (folder / "x.warc").write_bytes(b"\r\n\r\n".join([records[0], records[3], b""]))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(spark, f"file://{folder}").collect()
