"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows."""

import base64
import collections
import hashlib
import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixlake.llm import bpe, html, langid, minhash, packing, pii, spotsigs, suffixes, vectors, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Near copies, copies, shared passages, null, empty, short and non-ASCII texts, in rows with a null id too."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [base, base, base.replace("alpha", "alphx", 2), None, "", " \n", "one two", "ONE  two", "Ünï çödé " * 40, passage + " x", "y " + passage]
    for k in range(40):
        t = base.split()
        for _ in range(k % 14):
            t[rng.randrange(len(t))] = f"w{k}"
        texts += [" ".join(t), prose(rng, 30) + " " + passage + " " + prose(rng, 30), prose(rng, 50)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "de", i) for i, t in rows], "doc_id long, text string, id string, component long")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_minhash_components(docs, rows):
    sets = {i: shingle_set(t) for i, t in rows}
    part = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and part[i] != part[j]:
                    part[i] = part[j] = min(part[i], part[j])
                    changed = True
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs).collect()}
    assert found == {i: (len(sets[i]), part[i], part[i] == i) for i in sets}


def test_minhash_nulls_and_empty_table(spark):
    d = spark.createDataFrame([(None, "a b c"), (None, None), (3, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept) for r in minhash.components(d).collect()) == [(0, True), (0, True), (3, True)]
    assert minhash.components(d.limit(0)).count() == 0


def test_minhash_sets_about_as_large_as_a_sketch(spark):
    rng = random.Random(9)
    texts = []
    for k in range(60):
        small, large = (63, 84 - k % 2) if k < 40 else sorted((rng.randint(48, 90), rng.randint(48, 90)))
        words = [f"w{k}x{j}" for j in range(large + 4)]
        at = rng.randint(0, large - small)
        texts += [" ".join(words), " ".join(words[at : at + small + 4])]
    sets = [shingle_set(t) for t in texts]
    part = list(range(len(sets)))
    for i in range(0, len(sets), 2):
        a, b = sets[i], sets[i + 1]
        if 100 * len(a & b) >= 75 * len(a | b):
            part[i + 1] = i
    found = {r.doc_id: r.component_id for r in minhash.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == dict(enumerate(part))


def test_suffixes_remove_what_brute_force_removes(docs, rows):
    data = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[p : p + 200] for b in data.values() for p in range(len(b) - 199))
    found = {r.doc_id: r for r in suffixes.with_spans(docs).collect()}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = found[i].spans
        mine = bytearray(len(b))
        for s, e in suffixes.union(np.array(spans, np.int64)) if spans else []:
            mine[s:e] = b"\1" * (e - s)
        assert mine == gone, i


def test_suffixes_large_groups_and_empty_table(spark):
    rng = random.Random(2)
    passage = prose(rng, 40)
    d = spark.createDataFrame([(i, prose(rng, 5) + passage + prose(rng, 5)) for i in range(60)], "doc_id long, text string")
    kept = [r.text for r in suffixes.deduplicated(d).collect()]
    assert len(kept) == 60 and all(passage[20:-20] not in t for t in kept)
    assert suffixes.with_spans(d.limit(0)).count() == 0


@pytest.mark.parametrize("largest", [suffixes.LARGEST, 8])
def test_suffixes_of_a_group_stay_in_one_bucket(spark, monkeypatch, largest):
    monkeypatch.setattr(suffixes, "PER_BUCKET", 3)
    monkeypatch.setattr(suffixes, "LARGEST", largest)
    rng = random.Random(7)
    data = {}
    for k in range(30):
        passage = prose(rng, 30)
        for j in range(2 + k % 3 * 5):
            data[len(data)] = (prose(rng, 4) + passage + prose(rng, 30)).encode()
    seen = collections.Counter(b[p : p + 200] for b in data.values() for p in range(len(b) - 199))
    d = spark.createDataFrame([(i, b.decode()) for i, b in data.items()], "doc_id long, text string")
    found = {r.doc_id: suffixes.union(np.array(r.spans or [], np.int64)) for r in suffixes.with_spans(d).collect()}
    want = {i: suffixes.union(np.array([x for p in range(len(b) - 199) if seen[b[p : p + 200]] > 1 for x in (p, p + 200)], np.int64)) for i, b in data.items()}
    assert found == want


def test_loser_tree_keeps_common_prefixes():
    rng = random.Random(1)
    runs, everything = [], []
    for _ in range(5):
        run = sorted("".join(rng.choices("ab", k=rng.randint(0, 6))).encode() for _ in range(rng.randint(0, 9)))
        everything += run
        runs.append([(suffixes.common(run[k - 1] if k else b"", s), s, b"", 1, b"") for k, s in enumerate(run)])
    out = list(suffixes.merged([iter(r) for r in runs]))
    assert [e[1] for _, e in out] == sorted(everything)
    assert all(same == suffixes.common(out[k - 1][1][1], e[1]) for k, (same, e) in enumerate(out) if k)


def test_bpe_equals_the_library():
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    mine, library = bpe.loaded(path), Tokenizer.from_file(path)
    parts = ["the", " ", "\n", "  ", "ing", "é", "日本", "😀", "12", "'ll", "<|endoftext|>", "<|", "\x1c", " ", "x" * 40]
    for _ in range(2000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 10)))
        ids = mine.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_null_texts(docs, rows):
    found = {r.doc_id: r for r in bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert all(found[i].decoded == (t or "") for i, t in rows)


def test_packing_is_gapless_and_whole(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, capacity=128, fan_in=2, node_bins=16).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.piece, p.start, p.length))
        by_bin[p.sequence_id].append((p.offset, p.length))
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        assert sorted(by_doc[i]) == [(k, s, min(128, n - s)) for k, s in enumerate(range(0, n, 128))]
    for b in by_bin.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(docs.limit(0), path).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def confirmed(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.split(".")) or kind == "phone" and 9 <= len(d) <= 15


def test_pii_base_spans(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "_x@d.e", "..", "@", "1.2.3.4", "256", ".5.6", " ", "-", "4111 1111 1111 1111", "+1 (212) 555-0100", "+", "1", "22", "é😀", "x"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(800)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(d).collect():
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, r.text or "") if confirmed(k, m[0])]
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind in BASE] == want


def test_pii_added_kinds_and_redaction(spark):
    d = spark.createDataFrame([(1, "bank GB82 WEST 1234 5698 7654 32 end"), (2, "078-05-1120"), (3, "SSN 078-05-1120."), (4, "me@x.org, me@x.org")], "doc_id long, text string")
    assert [r.text for r in pii.redact(d).orderBy("doc_id").collect()] == ["bank [iban] end", "078-05-1120", "SSN [ssn].", "[email], [email]"]


def test_pii_ibans_end_at_their_countrys_length(spark):
    ibans = ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO9386011117947"]
    texts = [f"{a} {b}" for a in ibans for b in ["BIC WESTGB22", "2024 paid", "I paid", ibans[0]]] + ["DE88370400440532013000 I paid"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [[r.text[s.start : s.end] for s in r.pii if s.kind == "iban"] for r in pii.find(d).orderBy("doc_id").collect()]
    assert found == [[a] if b != 3 else [a, ibans[0]] for a in ibans for b in range(4)] + [[]]


def test_spotsigs(docs, rows):
    d = docs.filter("text is not null")
    found = {r.doc_id: r for r in spotsigs.with_next(d.select("doc_id", "text"), per_bucket=7).collect()}
    ids = sorted(found)
    assert all(found[i].next_text == found[ids[(k + 1) % len(ids)]].text for k, i in enumerate(ids))
    assert found[0].sigs == found[1].sigs
    assert spotsigs.with_next(d.select("doc_id", "text").limit(0)).count() == 0


@pytest.mark.parametrize("hot", [5_000, 3])
def test_components_of_stars_and_chains(spark, monkeypatch, hot):
    from helixlake.llm import _shared, graph

    monkeypatch.setattr(_shared, "HOT_ROWS", hot)
    monkeypatch.setattr(graph, "HOT_ROWS", hot)
    links = [(1, k) for k in range(2, 40)] + [(k, k + 1) for k in range(100, 120)] + [(119, 90), (7, 7), (200, 201), (200, 201)]
    found = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(1, 40), 1) | dict.fromkeys(range(100, 121), 90) | {90: 90, 200: 200, 201: 200}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spotsigs_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = [[f"{rng.randrange(60):08x}" for _ in range(rng.randint(1, 30))] for _ in range(60)]
    sets = [sorted(set(b)) for b in base] + [sorted(set(b[: len(b) - 1] + [f"{k:08x}"])) for k, b in enumerate(base)] + [sorted(set(base[0]))]
    names = {}
    for k, x in enumerate(sets):
        names.setdefault(tuple(x), k)
    ids = sorted(names.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.75}
    found = spotsigs.near_duplicates(spark.createDataFrame(list(enumerate(sets)), "doc_id long, sigs array<string>")).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_bpe_vocabulary_without_a_byte():
    mine = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    mine.automaton = bpe.ahocorasick.Automaton()
    mine.automaton.add_word("a", (1, 0))
    mine.automaton.make_automaton()
    with pytest.raises(ValueError, match="no tokens"):
        mine.encode("ab")


@pytest.mark.parametrize("chunk", [vectors.CHUNK, 20])
def test_vectors_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    x[100:200] = x[:100] + rng.normal(size=(100, 24)).astype(np.float32) * rng.uniform(0, 0.5, (100, 1)).astype(np.float32)
    x[250:] = x[0] + rng.normal(size=(50, 24)).astype(np.float32) * 0.1
    x[40:60] = x[39]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, 2.0])]
    found = {r.id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    y = x.astype(float)
    n = np.linalg.norm(y, axis=1)
    link = (y @ y.T) / (n[:, None] * n) >= 0.95
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.where(link, label, 10**6).min(1)
    assert found == {i: (int(link[i].sum()) - 1, int(label[i])) for i in range(len(x)) if link[i].sum() > 1}


@pytest.mark.parametrize(("grid_above", "chunk", "dense"), [(0, vectors.CHUNK, vectors.DENSE), (0, 20, 0), (1000, 90, 0), (1000, 90, 1), (1000, vectors.CHUNK, vectors.DENSE)])
def test_vectors_with_and_without_grid_equal_brute_force(spark, monkeypatch, grid_above, chunk, dense):
    """Components that single precision cannot hold, a group of near copies, links near the limit, copies, two lengths."""
    for name, value in {"ONE_SPACE": grid_above, "CHUNK": chunk, "DENSE": dense, "FEW": 64, "ROWS": 32, "COLUMNS": 48}.items():
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 20))
    x[60:140] = x[59] + rng.normal(size=(80, 20)) * 0.15
    x[140:200] = x[:60] + rng.normal(size=(60, 20)) * rng.uniform(0.2, 0.4, (60, 1))
    x[200:210] = x[:10].astype(np.float32)
    x[210:215] = x[0] * 3
    y = np.hstack([x[:70], x[:70]])
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)]
    found = {r.id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    expected = {}
    for first, v in ((0, x), (1000, y)):
        n = np.linalg.norm(v, axis=1)
        link = (v @ v.T) / (n[:, None] * n) >= 0.95
        label = np.arange(len(v))
        for _ in range(len(v)):
            label = np.where(link, label, 10**6).min(1)
        expected |= {first + i: (int(link[i].sum()) - 1, first + int(label[i])) for i in range(len(v)) if link[i].sum() > 1}
    assert found == expected


def test_vectors_are_shipped_once_a_chunk(spark):
    """A grid over eight blocks shipped each of these vectors 12 times and more with more vectors; tiles meet all pairs of chunks once."""
    rng = np.random.default_rng(3)
    data = [(i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(9_000, 8)).astype(np.float32))]
    tiles = vectors._tiles(spark.createDataFrame(data, "id long, copies long, vec array<float>"), 0.95, 0)
    rows = tiles.select("i", "j", "chunk", "ids").collect()
    assert sorted({(r.i, r.j) for r in rows}) == [(i, j) for i in range(3) for j in range(i, 3)]
    assert sum(len(r.ids) for r in rows) == 3 * len(data) and len(rows) < len(data) / 50
    assert sorted(k for r in rows if r.i == r.j for k in r.ids) == list(range(9_000))


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c d/", None), (4, "e", ""), (5, "f", "é" * 1000)]
    archives = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"))
    found = {r.page_id: r for r in warc.read_records(warc.normalise(archives)).collect()}
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert all(found[i].payload_digest == digest(h) and found[i].payload_bytes == len((h or "").encode()) for i, _, h in pages)
    assert {i: r.refers_to for i, r in found.items()} == {1: 2, 2: None, 3: 4, 4: None, 5: None}


def test_warc_edges(spark):
    schema = "page_id long, url string, html string"
    assert warc.read_records(warc.normalise(warc.write_archives(spark.createDataFrame([], schema)))).count() == 0
    pages = [(None, "a", "x"), (7, "b", "x"), (7, "c", "x"), (3, "d", "x"), (None, "e", "y")]
    found = warc.read_records(warc.normalise(warc.write_archives(spark.createDataFrame(pages, schema)))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in found) == [(0, "response", 0), (0, "revisit", 7), (3, "revisit", 7), (7, "response", 0), (7, "response", 0)]


def test_html_article_only():
    page = '<html><head><title>t</title><script>var a="</p>"</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>A long  paragraph with many words in it.<br><p>Short.</p></article><div id="comments"><p>I say so, at length, with many words.</p></div><footer>c</footer></body></html>'
    assert html.main_text(page) == "Head & more\nA long paragraph with many words in it.\nShort."
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<div class="layout has-sidebar with-comments"><article>%s</article></div>', "<div id=c>%s</div>"])
def test_html_keeps_short_blocks_of_the_article(wrap):
    long, cells = "many words stand here " * 12, [f"c{k}" for k in range(20)]
    inner = "".join(f"<p>{long}</p>" for _ in range(5)) + "<table>" + "".join(f"<tr><td>{c}</td></tr>" for c in cells) + "</table>" + "".join(f"<section><div>s{k}</div></section>" for k in range(9)) + f"<div><p>{long}</p></div>"
    page = "<body><div class=sidebar><p>side</p></div><div><a href=x>Home</a></div>" + wrap % inner + '<div id="comments"><p>I say so.</p></div><footer>f</footer></body>'
    assert html.main_text(page).split("\n") == [long.strip()] * 5 + cells + [f"s{k}" for k in range(9)] + [long.strip()]


STORY = "".join(f"<p>{f'many words of the story stand here, part {k}. ' * 8}</p>" for k in range(5))
TEXT = "\n".join(f"many words of the story stand here, part {k}. " * 8 for k in range(5)).replace(". \n", ".\n").strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div>Home About Contact</div><div>{STORY}</div><div>Copyright 2024 by us</div>", TEXT),
        (f"Home About Contact{STORY}Copyright 2024", TEXT),
        (f"<article><div class='entry-header'><h1>Headline</h1></div>{STORY}</article>", "Headline\n" + TEXT),
        (f"<div class='post'>{STORY}</div><article class='teaser'><p>Read another story, a long teaser with many words</p></article>", TEXT),
        (f"<form id=page><nav>x</nav><div>{STORY}</div><input></form>", TEXT),
        (f"<article>{STORY}<p class='share-price'>The price is 5</p></article>", TEXT + "\nThe price is 5"),
        (f"<article>{STORY}<article class='comment'><p>I say so, with very many words in this comment.</p></article></article>", TEXT),
        (f"<header><h1>Site</h1></header><main><h1>Title</h1>{STORY}</main><form><p>Subscribe to our letter</p><input></form>", "Title\n" + TEXT),
        (f"<header><h1>Site</h1></header><div>{STORY}</div>", TEXT),
        ("<div class=ad>Very many words of an advert stand here before it all.</div><article><h1>Head</h1><p>Short.</article>", "Head\nShort."),
    ],
)
def test_html_regions(page, text):
    assert html.main_text(f"<html><body>{page}</body></html>") == text


def test_html_articles_of_many_layouts(spark):
    """Pages with known articles in layouts of all kinds, with and without names to tell parts by."""
    rng, pages, wanted = random.Random(8), [], []
    for k in range(60):
        blocks = [prose(rng, rng.choice([3, 40, 60, 80])) for _ in range(rng.randint(4, 9))]
        blocks[0], blocks[-1] = prose(rng, 50), prose(rng, 50)
        body = "".join(f"<p>{b}</p>" for b in blocks)
        inner = [f"<article>{body}</article>", f"<div><div>{body}</div></div>", f"<main>{body}</main>", f"<section>{body}</section>"][k % 4]
        menu = "<div>" + "".join(f"<a href=/{j}>{rng.choice(WORDS)}</a> " for j in range(8)) + "</div>"
        pages.append((k, f"<body>{menu}<div class=sidebar>{prose(rng, 12)}</div>{inner}<div>Imprint {k}</div><footer>{prose(rng, 9)}</footer></body>"))
        wanted.append("\n".join(blocks))
    pages += [(60, None), (61, "")]
    found = html.extract(spark.createDataFrame(pages, "text long, html string").withColumnRenamed("text", "page_id")).collect()
    assert {r.page_id: r.text for r in found} == dict(enumerate([*wanted, "", ""]))
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_language_network_learns_and_rejects(spark):
    rng = random.Random(6)
    text = {"x": lambda: " ".join(rng.choice(["the", "this", "that", "with", "which"]) for _ in range(60)), "y": lambda: " ".join(rng.choice(["der", "nicht", "und", "eine", "ist"]) for _ in range(60))}
    data = [(i, text["xy"[i % 2]](), "xy"[i % 2]) for i in range(120)]
    net = langid.train([langid.spread(t) for _, t, _ in data[:80]], [lang for _, _, lang in data[:80]])
    d = spark.createDataFrame([*data[80:], (900, None, None), (901, "123 !", None), (902, "² ½ ① Ⅷ", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.predict(d, net).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in data[80:]) and found[900].lang_pred == found[901].lang_pred == found[902].lang_pred == "und"
    assert langid.fit(d.filter("lang is null")) is None


def test_suffixes_with_one_ending_merge_in_linear_time():
    """Texts with different beginnings and one ending have equal suffixes at its anchors, and different bytes before them."""
    rng = np.random.default_rng(3)
    ending = bytes(rng.integers(97, 123, 260, np.uint8)).decode()
    texts = [bytes(rng.integers(97, 123, 150, np.uint8)).decode() + ending for _ in range(16_000)]
    packed = []
    for t in texts:
        _, q, first, last = suffixes.anchors(t.encode())
        packed.append((q << 16 | (q - first) << 8 | (last - first)).tolist())
    batch = pa.RecordBatch.from_pydict({"tkey": [i.to_bytes(16, "big") for i in range(len(texts))], "text": texts, "packed": packed})
    blobs = [b for r in suffixes._runs(suffixes.LENGTH, 1)([batch]) for b in r.column("blob").to_pylist()]
    began = time.process_time()
    found = suffixes._merge(suffixes.LENGTH)(pd.DataFrame({"blob": blobs}))
    assert time.process_time() - began < 20
    ends = {k: suffixes.union(np.array(v)) for k, v in zip(found["tkey"], found["spans"], strict=True)}
    assert len(ends) == len(texts) and all(v[-1][1] == 410 and v[-1][0] <= 150 for v in ends.values())


LONG = "A sentence of the article that says something. " * 8


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<article><h1>T</h1><p>Hi <script>x()</script>there</p></article>", "T\nHi there"),
        ("<article><p>Be<style>p {}</style>fore</p></article>", "Before"),
        ("<article><p>Tell a <label>friend</label> now</p></article>", "Tell a friend now"),
        (f"<div><form><p><label>Name</label><input></p></form><p>{LONG}</p></div>", LONG.strip()),
        (f"<body><nav><a href=x>Home</a><article><h1>Title</h1><p>{LONG}</p></article></body>", "Title\n" + LONG.strip()),
        (f"<nav class=entry-header><h2>Sections</h2><ul>{'<li><a href=z>An entry of the menu</a></li>' * 60}</ul></nav><div><p>{LONG}</p><p>{LONG}</p></div>", LONG.strip() + "\n" + LONG.strip()),
        (f"<article><h1>Title</h1><p>{LONG}</p></article><h2>More</h2><article><h3><a href=y>Other story</a></h3><p>A small teaser.</p></article>", "Title\n" + LONG.strip()),
        (f"<article><h2>First part</h2><p>{LONG}</p></article><article><h2><a href=y>Second part</a></h2><p>{LONG}</p></article>", f"First part\n{LONG.strip()}\nSecond part\n{LONG.strip()}"),
    ],
)
def test_main_text_of_odd_markup(page, wanted):
    assert html.main_text(page) == wanted
