"""The queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op10_ann
from .byte_bpe import op12_byte_bpe
from .decontaminate import op1_decontaminate
from .fill_in_middle import op13_fill_in_middle
from .lattice_lm import op8_lm
from .near_dup import op4_near_dup
from .packing import op3_packing
from .quality import op5_quality
from .secret_scan import op6_secret_scan
from .sharding import op7_sharding
from .substring_dedup import op9_substring_dedup
from .toxicity import op2_toxicity
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_toxicity, op3_packing, op4_near_dup, op5_quality, op6_secret_scan, op7_sharding, op8_lm, op9_substring_dedup, op10_ann, op11_whitening, op12_byte_bpe, op13_fill_in_middle)
}

#: Runs of words under each mask are compared as text here, not by hash; items
#: below the longest mask are looked for whole.
_DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b0 AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS iw FROM benchmark),
b AS (SELECT min(item_id) AS item_id, iw FROM b0 WHERE len(iw) >= 1 GROUP BY iw),
mask(name, span, looked) AS (VALUES ('a', 6, [0, 1, 2, 4, 5]), ('b', 7, [0, 1, 3, 5, 6])),
whole AS (SELECT DISTINCT 'whole ' || len(iw) AS name, len(iw) AS span, range(0, len(iw)) AS looked FROM b WHERE len(iw) < 7),
dm AS (SELECT doc_id, w, name, looked, unnest(range(0, len(w) - span + 1)) AS i FROM d, (SELECT * FROM mask UNION ALL SELECT * FROM whole) WHERE len(w) >= span),
bm AS (SELECT item_id, iw, name, looked, unnest(range(0, len(iw) - span + 1)) AS q FROM b, mask WHERE len(iw) >= 7 UNION ALL SELECT item_id, iw, name, looked, 0 AS q FROM b JOIN whole ON len(iw) = span),
ds AS (SELECT doc_id, w, i, name || ' ' || array_to_string(list_transform(looked, lambda k: w[i + k + 1]), ' ') AS seed FROM dm),
bs AS (SELECT item_id, iw, q, name || ' ' || array_to_string(list_transform(looked, lambda k: iw[q + k + 1]), ' ') AS seed FROM bm),
hit AS (SELECT doc_id, item_id, w, iw, q, i - q AS start, least(len(iw), 13) AS width, greatest(0, least(q - 3, len(iw) - least(len(iw), 13))) AS first FROM ds JOIN bs USING (seed)),
near AS (SELECT *, list_sum(list_transform(range(first, first + width), lambda j: CASE WHEN start + j >= 0 AND w[start + j + 1] = iw[j + 1] THEN 1 ELSE 0 END)) AS good FROM hit),
scored AS (SELECT DISTINCT doc_id, item_id, start, len(iw) AS size, list_sum(list_transform(range(0, len(iw)), lambda j: CASE WHEN start + j >= 0 AND w[start + j + 1] = iw[j + 1] THEN 1 ELSE 0 END)) AS eq FROM near WHERE good >= ceil(width * 0.75))
SELECT doc_id, item_id, CAST(max(size) AS BIGINT) AS item_words, CAST(max(eq) AS BIGINT) AS equal_words, CAST(arg_max(start, {'a': eq, 'b': -start}) AS BIGINT) AS start_word FROM scored GROUP BY doc_id, item_id
"""

_SECRETS = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
kinds(kind, ord, base, pattern) AS (VALUES
 ('assign', 0, TRUE, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
 ('access', 1, TRUE, 'AKIA[A-Z0-9]+'), ('hex', 2, TRUE, '[0-9a-f]+'),
 ('token', 3, FALSE, '[A-Za-z0-9/+=]{40,}'), ('endpoint', 4, FALSE, '[hH][tT][tT][pP][sS]?://[^\x20\x09-\x0D"''<>]+')),
m AS (SELECT r, kind, ord, base, regexp_extract_all(text, pattern) AS found, regexp_split_to_array(text, pattern) AS gaps,
        CASE WHEN kind = 'assign' THEN regexp_extract_all(text, pattern, 2) END AS value FROM t, kinds WHERE regexp_matches(text, pattern)),
f AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
e AS (SELECT r, kind, ord, base, i, found[i] AS hit, length(gaps[i]) AS gap, value[i] AS v FROM f),
p AS (SELECT *, sum(gap + length(hit)) OVER (PARTITION BY r, ord ORDER BY i) AS stop FROM e),
s AS (SELECT r, kind, ord, base, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE CASE kind WHEN 'assign' THEN length(v) >= 6
        WHEN 'access' THEN length(hit) >= 20 WHEN 'hex' THEN length(hit) >= 24 WHEN 'token' THEN length(hit) = 40 AND NOT contains(hit, '=') ELSE TRUE END),
linked AS (SELECT * FROM s WHERE base UNION ALL SELECT * FROM s w WHERE NOT base AND EXISTS (SELECT 1 FROM s b WHERE b.base AND b.r = w.r
        AND (b.kind = 'access' OR (b.kind = 'assign' AND w.kind = 'endpoint')) AND b.start <= w.stop + 256 AND w.start <= b.stop + 256)),
j AS (SELECT r, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord), '') AS spans, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE base), '') AS b,
        count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex FROM linked GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN j USING (r)
"""

_SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos, len(w) AS n, w FROM d),
k AS (SELECT r, doc_id, pos, word, CASE WHEN pos <= n - 49 THEN md5(array_to_string(w[pos : pos + 49], ' ')) END AS h FROM x),
least_id AS (SELECT h, min(doc_id) AS first FROM k WHERE h IS NOT NULL GROUP BY h),
gone AS (SELECT r, pos, word, coalesce(first < doc_id, FALSE) AS starts FROM k LEFT JOIN least_id USING (h)),
cover AS (SELECT r, pos, word, max(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS c FROM gone),
agg AS (SELECT r, sum(c) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE c = 0) AS kept FROM cover GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN agg USING (r)
"""

#: A unit is a line; a text that is to be rebuilt is cut at the marks again.
_FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER), 8) AS BIGINT)) AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
c AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s FROM f),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END AS output FROM c),
back AS (SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN split_part(split_part(output, '<S>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<M>', 1), '<S>', 2)
        ELSE split_part(split_part(output, '<M>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<P>', 1), '<S>', 2) END AS again FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(again) AS restored_sha256 FROM back
"""

#: The others hold what SQL cannot say: trained models, a random deal, packing by
#: steps, an approximate search, closed components; tests use brute force there.
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _DECONTAMINATE, "op6_secret_scan": _SECRETS, "op9_substring_dedup": _SUBSTRINGS, "op13_fill_in_middle": _FILL_IN_MIDDLE}
