"""Queries of the training-data operators and their SQL."""

from . import byte_bpe, decontaminate, exact_dedup, html_text, jaccard_join, periodic, pii, prefix_trie, quality, secret_scan, spiece, token_records, url_filter
from .common import input_table as table


def op1_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.default_rules(spark))


def op3_personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_sentencepiece(spark, sf_dir):
    return spiece.round_trips(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_token_records(spark, sf_dir):
    index = token_records.encode_to_records(table(spark, sf_dir, "documents"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic.run_digests(table(spark, sf_dir, "documents"), edit=periodic.repeat_tail)


def op12_byte_bpe(spark, sf_dir):
    return byte_bpe.coded_digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), rebuild=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_url_filter, op3_personal_data, op4_exact_dedup, op5_quality, op6_sentencepiece,
        op7_decontaminate, op8_html_text, op9_token_records, op10_jaccard_join, op11_periodic_runs, op12_byte_bpe, op13_prefix_trie,
    )
}

SQL = {
    "op2_url_filter": r"""
        WITH u AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
          FROM pages),
        r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(h, p, verdict)),
        m AS (
          SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict,
                 row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS k
          FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
        SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM u LEFT JOIN m ON m.page_id IS NOT DISTINCT FROM u.page_id AND m.host = u.host AND m.path = u.path AND m.k = 1
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op7_decontaminate": r"""
        WITH dw AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
          FROM documents),
        bw AS (
          SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
          FROM benchmark),
        win AS (
          SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
          FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM win),
        spots AS (SELECT r, w, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS i FROM dw, lens WHERE len(w) >= n),
        hit AS (SELECT s.r, s.i, s.n, win.item FROM spots s JOIN win ON win.n = s.n AND win.k = array_to_string(s.w[s.i : s.i + s.n - 1], ' ')),
        pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN pos ON pos.r = dw.r LEFT JOIN its ON its.r = dw.r
    """,
    "op13_prefix_trie": r"""
        WITH RECURSIVE tb(i, k, v) AS (
          SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
          UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END FROM tb WHERE k < 8),
        own AS (
          SELECT conv_id::BIGINT AS c, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS s
          FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
        st(c, p, v) AS (
          SELECT c, 0, 4294967295::BIGINT FROM own
          UNION ALL SELECT st.c, p + 1, xor(tb.v, st.v >> 8) FROM st JOIN tb ON tb.k = 8 AND tb.i = xor(st.v, ascii(substr(st.c::VARCHAR, p + 1, 1))::BIGINT) & 255 WHERE p < length(st.c::VARCHAR)),
        h AS (SELECT c, xor(v, 4294967295::BIGINT) % 4 AS h FROM st WHERE p = length(c::VARCHAR)),
        conv AS (SELECT own.c, list_concat(coalesce(base.s, [])[1 : h], own.s[h + 1 :]) AS s FROM own JOIN h ON h.c = own.c LEFT JOIN own base ON base.c = own.c - own.c % 20),
        pre AS (SELECT c, s[1 : d] AS k, d, d = len(s) AS e FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM conv)),
        node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (e), '')) AS ends FROM pre GROUP BY k, d),
        kid AS (SELECT k[1 : d - 1] AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
        val AS (SELECT node.k, node.d, kid.n IS NULL AS leaf, CASE WHEN node.d > 0 THEN (node.n - 1) * len(regexp_extract_all(node.k[node.d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w
                FROM node LEFT JOIN kid ON kid.d = node.d AND kid.k = node.k),
        sub AS (SELECT k[1 : a] AS k, a AS d, count(*) FILTER (leaf) AS leaves, sum(w) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM val) GROUP BY ALL)
        SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, CAST(coalesce(kid.n, 0) AS BIGINT) AS n_children,
               CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
        FROM node JOIN sub ON sub.d = node.d AND sub.k = node.k LEFT JOIN kid ON kid.d = node.d AND kid.k = node.k
        LEFT JOIN node up ON up.d = node.d - 1 AND up.k = node.k[1 : node.d - 1]
    """,
}
