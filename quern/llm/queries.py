"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quern.llm import chatformat, urlrules
from quern.llm.bpe import op4_bpe
from quern.llm.ctw import op2_ctw
from quern.llm.decontaminate import op10_decontaminate
from quern.llm.ivfpq import op8_neighbours
from quern.llm.langid import op7_language
from quern.llm.licenses import BLANK, TEMPLATES, THRESHOLD, op5_licenses
from quern.llm.simhash import op6_simhash
from quern.llm.toxicity import op1_toxicity


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_ctw": op2_ctw,
        "op3_url_filter": urlrules.op3_url_filter,
        "op4_bpe": op4_bpe,
        "op5_licenses": op5_licenses,
        "op6_simhash": op6_simhash,
        "op7_language": op7_language,
        "op8_neighbours": op8_neighbours,
        "op9_chat_format": chatformat.op9_chat_format,
        "op10_decontaminate": op10_decontaminate,
    }


_UPPER, _LOWER = urlrules.UPPER, urlrules.LOWER

#: Windows of all items against all word positions of all documents, by their text.
_DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, spot.n, i, item_id FROM spot JOIN win ON spot.k = win.k AND spot.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(k, name, body.replace("'", "''")) for k, (name, body) in enumerate(TEMPLATES))
_WORDS = "list_filter(string_split_regex(translate({}, '{}', '{}'), '[^a-z0-9]+'), lambda x: x <> '')"


def _words(text: str) -> str:
    return _WORDS.format(text, _UPPER, _LOWER)


#: TF-IDF cosine of every line, paragraph and whole text to every template, then the nearest directory upwards.
_LICENSES = f"""
WITH t AS (SELECT k, name, body FROM (VALUES {_TEMPLATES}) v(k, name, body)),
tw AS (SELECT k, name, w, count(*) AS tf FROM (SELECT k, name, unnest({_words("body")}) AS w FROM t) GROUP BY k, name, w),
vocab AS (SELECT DISTINCT w FROM tw),
d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, CASE WHEN doc_id % 50 <> 0 THEN lang END,
    CASE WHEN doc_id % 50 <> 0 AND doc_id % 3 <> 0 THEN 'd' || doc_id % 10 END) AS dir FROM documents),
units AS (
  SELECT doc_id, 'l' AS kind, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS u FROM d)
  UNION ALL SELECT doc_id, 'p', unnest(range(1, len(u) + 1)), unnest(u) FROM (SELECT doc_id, string_split_regex(text, '{BLANK}') AS u FROM d)
  UNION ALL SELECT doc_id, 'w', 1, text FROM d),
l AS (SELECT * FROM (SELECT doc_id, kind, i, {_words("u")} AS ws FROM units) WHERE len(ws) > 0),
lw AS (SELECT doc_id, kind, i, w, count(*) AS tf FROM (SELECT doc_id, kind, i, unnest(ws) AS w FROM l) GROUP BY doc_id, kind, i, w),
n AS (SELECT count(*) AS n FROM l WHERE kind = 'l'),
df AS (SELECT w, count(*) AS df FROM lw WHERE kind = 'l' AND w IN (FROM vocab) GROUP BY w),
idf AS (SELECT vocab.w, ln((1 + n.n) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocab CROSS JOIN n LEFT JOIN df ON vocab.w = df.w),
tn AS (SELECT k, sqrt(sum((tf * idf) ** 2)) AS norm FROM tw JOIN idf USING (w) GROUP BY k),
ln_ AS (SELECT doc_id, kind, i, sqrt(sum((tf * coalesce(idf, ln(1 + n.n) + 1)) ** 2)) AS norm FROM lw CROSS JOIN n LEFT JOIN idf ON lw.w = idf.w
    GROUP BY doc_id, kind, i),
dot AS (SELECT doc_id, kind, i, k, name, sum(lw.tf * tw.tf * idf * idf) AS dot FROM lw JOIN tw USING (w) JOIN idf USING (w) GROUP BY doc_id, kind, i, k, name),
best AS (SELECT doc_id, kind, i, max(struct_pack(score := round(dot / (ln_.norm * tn.norm), 9), license := name)) AS m
    FROM dot JOIN ln_ USING (doc_id, kind, i) JOIN tn USING (k) GROUP BY doc_id, kind, i),
own AS (SELECT doc_id, max(m) AS own, count(*) FILTER (WHERE kind = 'l') AS good, count(*) FILTER (WHERE kind = 'w') AS whole
    FROM best WHERE m.score >= {THRESHOLD} GROUP BY doc_id),
f AS (SELECT d.doc_id, dir || '/' || d.doc_id || '.txt' AS path, dir, own,
    own IS NOT NULL AND (whole > 0 OR 2 * good >= (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id AND kind = 'l')) AS whole
    FROM d LEFT JOIN own ON d.doc_id = own.doc_id),
given AS (SELECT dir, max(own) AS given FROM f WHERE whole GROUP BY dir),
above AS (SELECT dir AS of_dir, i AS depth, array_to_string(string_split(dir, '/')[1:i], '/') AS dir
    FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS i FROM (SELECT DISTINCT dir FROM f))),
near AS (SELECT of_dir, max(struct_pack(depth := depth, license := given.license, dir := above.dir)) AS near FROM above JOIN given USING (dir) GROUP BY of_dir)
SELECT doc_id, path, own.license AS own_license, own.score AS own_score, CASE WHEN own IS NOT NULL THEN own.license ELSE near.license END AS license,
    CASE WHEN own IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    CASE WHEN own IS NULL AND near IS NOT NULL THEN near.dir END AS from_dir
FROM f LEFT JOIN near ON f.dir = near.of_dir"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": urlrules.ORACLE_SQL,
        "op5_licenses": _LICENSES,
        "op9_chat_format": chatformat.ORACLE_SQL,
        "op10_decontaminate": _DECONTAMINATE,
    }
