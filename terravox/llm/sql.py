"""DuckDB SQL of the operators that SQL can express, by plain enumeration of windows and pairs."""

from __future__ import annotations

_SPLIT = {"word": r"[\x20\x09-\x0D]+", "alnum": r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def _words(text: str, kind: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_SPLIT[kind]}'), lambda w: w <> '')"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Items are windows of ten words, or whole where they have fewer; a document's windows of those lengths are looked up among them.
DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words(_lower('text'), 'alnum')} w FROM documents),
i AS (SELECT item_id, {_words(_lower('text'), 'alnum')} w FROM benchmark),
k AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') win FROM (SELECT item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) p FROM i WHERE len(w) > 0)),
s AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) p FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n),
h AS MATERIALIZED (SELECT s.doc_id, s.p, s.n, k.item_id FROM (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') win FROM s) s JOIN k USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT place) n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings),
u AS MATERIALIZED (SELECT a.vec_id s, b.vec_id d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(n, l) AS (SELECT vec_id, vec_id FROM v UNION SELECT u.d, r.l FROM r JOIN u ON u.s = r.n WHERE r.l < u.d),
c AS (SELECT n vec_id, min(l) component_id FROM r GROUP BY 1), k AS (SELECT s vec_id, count(*) n FROM u GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""

#: A window of 50 words is repeated if a smaller id has it too.
PASSAGES = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words('text', 'word')} w FROM documents),
s AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) p FROM d WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) least FROM s GROUP BY 1), g AS MATERIALIZED (SELECT s.doc_id, s.p FROM s JOIN f USING (win) WHERE f.least < s.doc_id),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS place FROM g),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS place, unnest(w) word FROM d),
k AS (SELECT doc_id, count(*) n, string_agg(word, ' ' ORDER BY place) kept FROM u ANTI JOIN c USING (doc_id, place) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: The same for 50 bytes. What is left is put together from the gaps between merged spans.
SUBSTRINGS = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) b FROM documents), l AS (SELECT doc_id, b, octet_length(b) n FROM d),
s AS MATERIALIZED (SELECT doc_id, p, md5(hex(b[p : p + 49])) win FROM (SELECT doc_id, b, unnest(range(1, n - 48)) p FROM l WHERE n >= 50)),
f AS (SELECT win, min(doc_id) least FROM s GROUP BY 1), g AS MATERIALIZED (SELECT s.doc_id, s.p FROM s JOIN f USING (win) WHERE f.least < s.doc_id),
o AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END new FROM g),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) run FROM o),
r AS MATERIALIZED (SELECT doc_id, run, min(p) lo, max(p) + 50 hi FROM i GROUP BY 1, 2),
e AS (SELECT doc_id, lo, hi FROM r UNION ALL SELECT doc_id, n + 1, n + 1 FROM l),
t AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi), 1) start FROM e),
k AS (SELECT doc_id, string_agg(CASE WHEN lo > start THEN hex(b[start : lo - 1]) ELSE '' END, '' ORDER BY start, lo) kept FROM t JOIN l USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) n_removed, count(*) n_spans FROM r GROUP BY 1)
SELECT doc_id, CAST(l.n AS BIGINT) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(kept)) kept_sha256 FROM l JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Words that documents give to a mix: whole passes over a source, and the documents of the smallest keys for the rest.
MIX = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len({_words('text', 'word')}) AS BIGINT) size, CAST('0x' || substr(md5(concat_ws(' ', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, row_number() OVER (ORDER BY source NULLS LAST) n FROM d GROUP BY 1),
w AS (SELECT *, 2 * source_size cap, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END weight FROM s),
r AS (SELECT *, row_number() OVER o place, CAST(sum(cap) OVER o AS BIGINT) - cap caps, CAST(sum(weight) OVER o AS BIGINT) - weight shares, CAST(sum(source_size) OVER () AS BIGINT) total, CAST(sum(weight) OVER () AS BIGINT) every FROM w
  WINDOW o AS (ORDER BY cap::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, (1.5::DOUBLE * total - caps) / (every - shares) AS level FROM r),
l AS (SELECT arg_min(level, place) AS level FROM v WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(l.level * weight, cap::DOUBLE)) target FROM r, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END passes FROM t),
c AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) upto, CAST(sum(size) OVER (PARTITION BY source, k) AS BIGINT) tied FROM d),
e AS (SELECT c.*, b.source_size, b.target, b.passes, CAST(floor(b.target + 0.5) AS BIGINT) - b.passes * b.source_size rest FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, passes * size + CASE WHEN upto <= rest THEN size WHEN upto - tied < rest THEN size * (rest - upto + tied) // tied ELSE 0 END taken FROM e
"""

#: Every document's failures, every order of the filters, and in it which filter is the first that a document fails.
FILTER_AUDIT = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t, {_words('text', 'word')} w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY t) THEN 'E' ELSE '' END fails FROM d),
g AS (SELECT doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic FROM labels GROUP BY 1),
m AS MATERIALIZED (SELECT part, fails, count(*) n, count(*) FILTER (good) good, count(*) FILTER (toxic) toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY 1, 2),
o(filter_order) AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step] own, filter_order[1 : step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) step) WHERE length(filter_order) = 5),
e AS (SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) failing, translate(fails, earlier, '') <> fails gone FROM m, s),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) step, own, sum(n) FILTER (NOT failing AND NOT gone) kept, sum(n) FILTER (failing AND NOT gone) removed, sum(n) FILTER (failing AND gone) redundant, sum(n) FILTER (fails = own) unique_fails,
  sum(good) FILTER (failing AND NOT gone) good_lost, sum(toxic) FILTER (failing AND NOT gone) toxic_lost FROM e GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))}, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) shapley FROM r
"""
