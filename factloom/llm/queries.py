"""The queries of the training-data operators, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from factloom.llm import byte_bpe, decontamination, divergence, jaccard_join, pii, quality_crf, resampling, sentencepiece_codec, substring_dedup, topk_search, toxicity, url_filters, warc
from factloom.llm.common import table

URL_RULES = (
    url_filters.Rule("block", "com", "/en/"),
    url_filters.Rule("allow", "example.com", "/en/7"),
    url_filters.Rule("allow", "net", "/de/"),
    url_filters.Rule("block", "example.net", "/de/8"),
    url_filters.Rule("block", "org", "/es/"),
)


def op1_topk_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k_search(vectors, vectors.where("vec_id % 50 = 0"))


def op2_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op3_decontamination(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), piece_model(), keep_ids=False)


def op6_url_filters(spark, sf_dir):
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_crf(spark, sf_dir):
    return quality_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


PII_KEY = "example-key-for-tests"


def op9_pii(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), byte_model(), keep_ids=False)


def op12_importance_resampling(spark, sf_dir):
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_topk_search, op2_warc, op3_decontamination, op4_substring_dedup, op5_sentencepiece, op6_url_filters, op7_quality_crf, op8_toxicity, op9_pii, op10_jaccard_join, op11_byte_bpe, op12_importance_resampling, op13_source_divergence)
}

#: DuckDB: a text's words, as the contracts define them.
WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_PLAIN_WORDS = WORDS.format(text="coalesce(text, '')")
_LOWER_WORDS = WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
#: Five hex digits are four base32 digits.
_BASE32 = ", ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(floor(v[{g}] / {32**k}) AS BIGINT) % 32 + 1]" for g in range(1, 9) for k in (3, 2, 1, 0))

#: DuckDB: words of lower-cased letters, digits and whatever isn't ASCII.
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op13_source_divergence": f"""
        WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS.replace("2F", "40").replace("3A-", "5B-")} AS ts FROM documents),
        words AS (SELECT d, lang, source, unnest(ts) AS t FROM docs),
        vocab AS (SELECT lang, t FROM words GROUP BY lang, t HAVING count(DISTINCT d) >= 30),
        v AS (SELECT lang, count(t) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN vocab USING (lang) GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM docs),
        n AS (SELECT lang, source, t, count(*) AS c FROM words JOIN vocab USING (lang, t) GROUP BY ALL),
        cells AS (SELECT g.lang, g.source, vocab.t, coalesce(c, 0) AS c FROM g JOIN vocab USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.t = vocab.t),
        p AS (SELECT lang, source, t, c, 1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM cells JOIN v USING (lang)),
        q AS (SELECT lang, t, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 5)) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM cells JOIN v USING (lang) GROUP BY lang, t),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
        terms AS (SELECT p.lang, p.source, 'term' AS part, p.t AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.t = q.t WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50""",
    "op12_importance_resampling": f"""
        WITH docs AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
        word AS (SELECT doc_id, unnest(ws) AS w FROM docs),
        goal AS (SELECT unnest({_TERMS}) AS w FROM benchmark),
        crc_table AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS ct FROM range(256) r(i)),
        spelt AS (SELECT w, list_transform(range(CAST(strlen(w) AS BIGINT)), lambda i: CAST('0x' || substr(hex(w), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM (SELECT w FROM word UNION SELECT w FROM goal)),
        bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, ct[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM spelt, crc_table),
        s AS (SELECT b, count(*) AS n FROM word JOIN bucket USING (w) GROUP BY b),
        t AS (SELECT b, count(*) AS n FROM goal JOIN bucket USING (w) GROUP BY b),
        total AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) + 10000 AS sn, (SELECT coalesce(sum(n), 0) FROM t) + 10000 AS tn),
        gain AS (SELECT s.b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(sn AS DOUBLE) / (CAST(s.n + 1 AS DOUBLE) * CAST(tn AS DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t ON s.b = t.b, total),
        sums AS (SELECT doc_id, count(*) AS n, sum(g) AS g FROM word JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
        scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(CAST(floor(CAST(g AS DOUBLE) / n) AS BIGINT), 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM docs d LEFT JOIN sums ON d.doc_id = sums.doc_id),
        final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM final)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND r <= floor(n / 10) THEN r END AS rank FROM placed""",
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op2_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, list_transform(range(1, 41, 5), lambda i: CAST('0x' || substr(sha1(body), i, 5) AS BIGINT)) AS v, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, concat({_BASE32}) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d""",
    "op4_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_PLAIN_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, u.i, array_to_string(ws[u.i : u.i + 34], ' ') AS s FROM w, unnest(range(1, len(ws) - 33)) AS u(i)),
        again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT win.doc_id, list_distinct(flatten(list(range(win.i, win.i + 35)))) AS js FROM win JOIN again USING (s) GROUP BY win.doc_id),
        kept AS (SELECT w.doc_id, ws, coalesce(js, []) AS js FROM w LEFT JOIN gone USING (doc_id)),
        out AS (SELECT doc_id, len(ws) AS n_words, len(js) AS n_removed, list_filter(ws, lambda x, i: NOT list_contains(js, i)) AS k FROM kept)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM out""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM sets),
        e AS (SELECT doc_id, unnest(s) AS t FROM sets),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        reach(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(reach.root) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n""",
    "op6_url_filters": r"""
        WITH rules(action, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        parted AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        ranked AS (
            SELECT p.*, r.host || r.path AS rule, r.action,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
            FROM parted p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM ranked WHERE n = 1""",
}
