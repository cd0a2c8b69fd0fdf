"""DuckDB statements for the queries of this subpackage that SQL can express."""

from churnlake.llm import licenses

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '\P{L}+', '', 'g'))::BIGINT AS n_letters,
        length(regexp_replace(t, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaim
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
f AS (SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
        n_letters, n_upper, n_exclaim FROM m),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
        + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (2 * n_upper > n_letters)::INT + 32 * (5 * n_exclaim > n_words)::INT
        + 64 * (2 * n_letters < word_chars)::INT
        + 128 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::INT)::BIGINT AS failure_bits FROM f)
SELECT *, (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept FROM b
"""


def _op7() -> str:
    """Headers, their TF-IDF vectors and the ancestor search as joins; the templates are a VALUES list."""
    templates = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH tpl(k, name, body) AS (VALUES {templates}),
tt AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(regexp_extract_all(lower(body), '{licenses.TOKEN}')) AS t FROM tpl) GROUP BY 1, 2),
idf AS (SELECT t, ln((1 + (SELECT count(*) FROM tpl)) / (1.0 + count(DISTINCT k))) + 1 AS w FROM tt GROUP BY t),
tw AS (SELECT k, t, tf * w AS w FROM tt JOIN idf USING (t)),
tn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM tw GROUP BY k),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', coalesce(source, 'none'),
          CASE WHEN (doc_id % 3 + 3) % 3 >= 1 THEN (floor(doc_id / 1000))::BIGINT::VARCHAR END,
          CASE WHEN (doc_id % 3 + 3) % 3 >= 2 THEN (floor(doc_id / 100))::BIGINT::VARCHAR END, doc_id::VARCHAR) END AS path FROM documents),
seg AS (SELECT rid, row_number() OVER () AS sid, s FROM (SELECT rid, unnest(string_split(
          regexp_replace(text, '([.;!?])[ 	]+', E'\1
', 'g'), chr(10))) AS s FROM d) WHERE regexp_matches(s, '{licenses.CUE}')),
st AS (SELECT sid, t, count(*) AS tf FROM (SELECT sid, unnest(regexp_extract_all(lower(s), '{licenses.TOKEN}')) AS t FROM seg) GROUP BY 1, 2),
sw AS (SELECT sid, st.t, tf, tf * coalesce(w, ln(1.0 + (SELECT count(*) FROM tpl)) + 1) AS w FROM st LEFT JOIN idf ON st.t = idf.t),
sn AS (SELECT sid, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM sw GROUP BY sid),
cs AS (SELECT sid, k, round(sum(sw.w * tw.w) / any_value(sn.norm) / any_value(tn.norm), 6) AS sim
       FROM sw JOIN tw USING (t) JOIN sn USING (sid) JOIN tn USING (k) GROUP BY sid, k),
bs AS (SELECT sid, max(sim) AS sim, arg_min(k, (-sim, k)) AS k FROM cs GROUP BY sid),
h AS (SELECT rid, max(sim) AS similarity, arg_min(k, (-sim, k)) AS k, sum(words) AS words
      FROM bs JOIN seg USING (sid) JOIN sn USING (sid) WHERE sim >= {licenses.SIMILAR} GROUP BY rid),
r AS (SELECT d.rid, doc_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS dir,
        tpl.name AS licence, similarity, h.rid IS NOT NULL AND
        (words >= {licenses.FILE_SHARE} * len(regexp_extract_all(text, '[^ 	-
]+'))
         OR regexp_matches(path, '{licenses.LICENCE_NAME}')) AS is_file
      FROM d LEFT JOIN h USING (rid) LEFT JOIN tpl ON tpl.k = h.k),
f AS (SELECT dir AS above, arg_min(licence, (-similarity, licence)) AS fl, max(similarity) AS fs FROM r WHERE is_file GROUP BY dir),
a AS (SELECT dir, n, array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') AS above
      FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS n FROM (SELECT DISTINCT dir FROM r))),
near AS (SELECT dir, arg_max(f.above, n) AS above, arg_max(fl, n) AS fl, arg_max(fs, n) AS fs FROM a JOIN f USING (above) GROUP BY dir)
SELECT doc_id, path, coalesce(licence, fl) AS licence, coalesce(similarity, fs) AS similarity,
  CASE WHEN is_file THEN 'file' WHEN licence IS NOT NULL THEN 'header' WHEN near.above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN licence IS NOT NULL THEN r.dir ELSE near.above END AS origin_dir
FROM r LEFT JOIN near ON r.dir = near.dir
"""


ORACLE = {
    "op1_quality_rules": OP1,
    "op7_licenses": _op7(),
}
