"""What DuckDB must find for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from helixlake.llm import pii

# Base 32 of a SHA-1: five bits of its 160 at a time.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(h)) AS n,
                  array_to_string(list_transform(string_split(sha1(h), ''), lambda c: substr(
                    '0000000100100011010001010110011110001001101010111100110111101111',
                    4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM p),
     e AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
                      + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT
                      + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS digest FROM d),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS newest FROM e)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM m"""

# Shingles as strings; pairs that share one, by an inverted list; labels that spread along the links.
MINHASH = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS l FROM w),
     g AS (SELECT doc_id, i, l, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS v FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     s AS (SELECT DISTINCT doc_id, md5_number_lower(v) AS v FROM g WHERE i <= greatest(1, l - 4)),
     z AS (SELECT doc_id, count(*) AS n, md5(string_agg(v, ',' ORDER BY v)) AS k FROM s GROUP BY doc_id),
     n AS (SELECT doc_id, coalesce(z.n, 0) AS n, z.k FROM documents LEFT JOIN z USING (doc_id)),
     c AS (SELECT k, min(doc_id) AS id, any_value(n) AS n FROM n WHERE n > 0 GROUP BY k),
     e AS (SELECT c.id, c.n, s.v FROM c JOIN s ON s.doc_id = c.id),
     p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.v = b.v AND a.id < b.id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
     l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)),
     u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
     r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
     q AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(q.component_id, n.doc_id) AS component_id, coalesce(q.component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN c ON n.k = c.k AND n.n > 0 LEFT JOIN q ON q.id = c.id"""

# All pairs in double precision.
VECTORS = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
     f AS (SELECT vec_id, x, list_dot_product(x, x) AS q FROM v WHERE x IS NOT NULL AND len(x) > 0
             AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(x, x) > 0),
     u AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (sqrt(a.q) * sqrt(b.q)) >= 0.95e0),
     r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
     t AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
     n AS (SELECT a AS vec_id, count(*) AS n FROM u GROUP BY a)
SELECT t.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, t.component_id, t.vec_id = t.component_id AS kept FROM t LEFT JOIN n USING (vec_id)"""

# Every 200-byte string as hexadecimal digits, and the bytes that repeated ones cover.
SUFFIXES = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
     b AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 256)) AS f FROM d WHERE len(h) >= 400),
     e AS (SELECT doc_id, f, substr(h, 2 * f + 1, 2 * (256 + 199)) AS h FROM b),
     s AS (SELECT doc_id, f, h, unnest(range(len(h) // 2 - 199)) AS q FROM e),
     k AS (SELECT doc_id, f + q AS p, md5_number(substr(h, 2 * q + 1, 400)) AS x FROM s),
     m AS (SELECT x FROM k GROUP BY x HAVING count(*) > 1),
     o AS (SELECT doc_id, p FROM k SEMI JOIN m USING (x)),
     i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM
            (SELECT *, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, -1))::INT AS new FROM o)),
     r AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY ALL),
     t AS (SELECT doc_id, list({'a': a, 'b': b} ORDER BY a) AS r, sum(b - a)::BIGINT AS gone FROM r GROUP BY doc_id),
     j AS (SELECT d.doc_id, d.h, coalesce(t.gone, 0) AS gone, coalesce(len(t.r), 0) AS n, coalesce(t.r, []) AS r FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, gone AS n_removed, n::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n = 0 THEN h ELSE substr(h, 1, 2 * r[1].a) || array_to_string(list_transform(range(1, n + 1),
         lambda q: CASE WHEN q = n THEN substr(h, 2 * r[q].b + 1) ELSE substr(h, 2 * r[q].b + 1, 2 * (r[q + 1].a - r[q].b)) END), '') END)) AS kept_sha256
FROM j"""


def _pii() -> str:
    """Spans by what stands between the matches; the patterns without what only keeps them linear, context as in the operator."""
    word = r"\b"
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": f"{word}(?:{'|'.join([*pii._KNOWN, pii._OTHER])}){word}", "ssn": f"{word}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{word}", "secret": f"{word}[A-Za-z0-9_]{{20,}}{word}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    plain = "replace(m, ' ', '')"
    moved = f"string_split(substr({plain}, 5) || substr({plain}, 1, 4), '')"
    mod = f"list_reduce(list_prepend(0::BIGINT, list_transform({moved}, lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)), lambda a, d: (a * CASE WHEN d < 10 THEN 10 ELSE 100 END + d) % 97) = 1"
    right = " ".join(f"WHEN substr(m, 1, 2) IN ({', '.join(repr(x) for x in c.split())}) THEN len({plain}) = {n}" for n, c in pii.IBAN_LENGTHS.items())
    borders = "len(regexp_replace(regexp_replace(m, '[0-9]+', '0', 'g'), '[^0]', '', 'g'))"
    valid = {
        "email": "true", "ip": r"len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"len({digits}) BETWEEN 9 AND 15",
        "iban": f"CASE {right} ELSE len({plain}) BETWEEN 15 AND 34 END AND {mod}",
        "ssn": "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'",
        "secret": f"len(m) <= 512 AND len({digits}) >= 3 AND len(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= 3 AND {borders} >= 3",
    }
    parts, names = [], list(pii.KINDS)
    for n, k in enumerate(names):
        p = patterns[k].replace("'", "''")
        around = f"lower(substr(t, greatest(1, a + 1 - {pii.NEARBY}), b - greatest(0, a - {pii.NEARBY}) + {pii.NEARBY}))"
        near = f"least(1e0, {pii.BASE_SCORE[k]}e0 + CASE WHEN regexp_matches({around}, '(?:^|[^a-z0-9])(?:{pii.KINDS[k][2]})') THEN {pii.CONTEXT}e0 ELSE 0e0 END)"
        keep = "true" if k in pii.BASE else f"{near} >= 0.5e0"
        parts.append(f"""SELECT doc_id, {n} AS kind, '{k}' AS name, a, b FROM (SELECT *, a + len(m) AS b FROM (SELECT doc_id, t, ms[i] AS m,
          (coalesce(list_sum(list_transform(gs[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::BIGINT AS a
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d)))) WHERE {valid[k]} AND {keep}""")
    count = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in names)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}),
      x AS (SELECT *, name || ':' || a || ':' || b AS span FROM s),
      g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = {n}) AS n_{k}" for n, k in enumerate(names))}, count(*) AS n_spans, string_agg(span, ',' ORDER BY kind, a) AS spans,
        string_agg(span, ',' ORDER BY kind, a) FILTER (kind < {len(pii.BASE)}) AS base FROM x GROUP BY doc_id)
      SELECT doc_id, {count}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0)::BIGINT AS n_spans FROM d LEFT JOIN g USING (doc_id)"""


PII = _pii()

# Buckets are checksums of the distinct features, by a table of 256 remainders.
RESAMPLING = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb),
     docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     goal AS (SELECT regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     df AS (SELECT row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM docs),
     gf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM goal),
     each AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM gf)),
     bytes AS (SELECT f, list_transform(range(len(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1)
         + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM each),
     hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tb[(xor(c, x) & 255) + 1])),
         4294967295) % 10000 AS bucket FROM bytes, tab),
     s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
     t AS (SELECT bucket, count(*) AS t FROM gf JOIN hashed USING (f) GROUP BY bucket),
     total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS a, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS b),
     gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (a + 10000) / ((s + 1)::DOUBLE * (b + 10000))))::BIGINT AS gain
         FROM s LEFT JOIN t USING (bucket), total),
     sums AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS total FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY row),
     valued AS (SELECT d.row, doc_id, len(w) AS words, coalesce(n, 0) AS n_features,
         coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM docs d LEFT JOIN sums USING (row)),
     scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM valued),
     placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
         FROM scored WHERE words >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (row)
"""

# Windows of words; each is gone from the documents after the first one that has it.
PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
     f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
     c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE doc_id > first),
     k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL = {
    "op2_minhash": MINHASH, "op5_pii": PII, "op8_vectors": VECTORS, "op9_suffixes": SUFFIXES, "op10_warc": WARC, "op11_passages": PASSAGES,
    "op12_resampling": RESAMPLING,
}
