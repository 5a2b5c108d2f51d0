"""The queries of the training-data operators on whole tables: against their SQL, a library, or brute force."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixlake.llm import queries, spotsigs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    found, wanted = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    order = sorted(found.columns)
    places = [wanted.columns.index(c) for c in order]
    assert sorted((tuple(r[c] for c in order) for r in found.collect()), key=str) == sorted((tuple(r[i] for i in places) for r in wanted.fetchall()), key=str)


def test_languages_of_held_out_texts(spark, db):
    labels = dict(db.sql("SELECT doc_id, lang FROM documents").fetchall())
    found = queries.QUERIES["op3_langid"](spark, SF).collect()
    assert {r.doc_id: r.held_out for r in found} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in labels}
    held = [r for r in found if r.held_out and labels[r.doc_id]]
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in found)


def test_tokens_equal_the_librarys(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    for r in queries.QUERIES["op4_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_sequences_are_nearly_as_few_as_can_be(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    pieces = collections.defaultdict(list)
    for p in queries.QUERIES["op6_packing"](spark, SF).collect():
        pieces[p.sequence_id].append((p.offset, p.length))
    for s in pieces.values():
        ends = [0]
        for offset, length in sorted(s):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert len(pieces) <= -(-total // 2048) + 1


def signatures(text):
    words = re.sub(spotsigs._BETWEEN, " ", text.lower()).split(" ")
    words = [w for w in words if w]
    found = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN] if w in spotsigs.ANCHORS else []
        if len(chain) == spotsigs.CHAIN:
            found.add(" ".join([w, *chain]))
    return sorted({f"{zlib.crc32(s.encode()):08x}" for s in found})


def test_fingerprints_equal_brute_force(spark, texts):
    ids, jaccard = sorted(texts), lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    sigs = {i: signatures(texts[i]) for i in ids}
    found = {r.doc_id: r for r in queries.QUERIES["op7_spotsigs"](spark, SF).collect()}
    assert sorted(found) == ids
    for k, i in enumerate(ids):
        after = ids[(k + 1) % len(ids)]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[after][:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        if sigs[i]:
            assert r.fingerprint == "".join(sigs[i])
            if mine := signatures(edited):
                assert r.edited_fingerprint == "".join(mine) and r.near_edited == pytest.approx(jaccard(sigs[i], mine))
            if sigs[after]:
                assert r.near_next == pytest.approx(jaccard(sigs[i], sigs[after]))
