"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# Fixed values of the contract, written out again here.
_RULES = ("(VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), "
          "('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(action, domain, start)")

URLS = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parts),
best AS (
  SELECT page_id, host, path, max({{'n': length(domain || start), 'rule': domain || start, 'action': action}}) AS b
  FROM split JOIN {_RULES} ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
  GROUP BY ALL)
SELECT s.page_id, s.host, s.path, b.rule AS "rule",
       coalesce(b.action, CASE WHEN regexp_matches(s.host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)')
                               THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN best USING (page_id)"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, source_size * 2::DOUBLE AS most,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
              WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight
  FROM s),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER earlier, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM w
  WINDOW earlier AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(most, max(level) OVER () * weight) AS target,
         ('0x' || substr(sha256('mix' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296::DOUBLE AS start
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target, t.start,
         t.target / greatest(t.source_size, 1) AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS n
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
tried AS (
  SELECT *, CAST(floor(start + phase / 32::DOUBLE + (n + 1) * rate) - floor(start + phase / 32::DOUBLE + n * rate) AS BIGINT)
            * size AS taken
  FROM placed, range(32) AS p(phase)),
misses AS (SELECT source, phase, abs(sum(taken) - any_value(target)) AS miss FROM tried GROUP BY source, phase),
chosen AS (SELECT source, arg_min(phase, {'miss': miss, 'phase': phase}) AS phase FROM misses GROUP BY source)
SELECT doc_id, size, source_size, target, taken
FROM tried t JOIN chosen c ON t.source IS NOT DISTINCT FROM c.source AND t.phase = c.phase"""

# Words of every piece, then all runs of up to five of them; sums of 128 bits keep the scores exact.
PHRASES = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, len(w) AS size FROM words WHERE len(w) > 0),
totals AS (SELECT lang, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY lang),
starts AS (SELECT lang, w, size, unnest(range(1, size + 1)) AS i FROM sized),
runs AS (
  SELECT lang, m AS k, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM starts, (VALUES (1), (2), (3), (4), (5)) AS lengths(m) WHERE i + m - 1 <= size),
known AS (
  SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM runs GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, j.cut,
         CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM known c, (VALUES (1), (2), (3), (4)) AS j(cut), known x, known y, totals t
  WHERE j.cut < c.k AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j.cut], ' ')
    AND y.lang = c.lang AND y.phrase = array_to_string(c.w[j.cut + 1:], ' ') AND t.lang = c.lang),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts) WHERE nth = 1),
inner_runs AS (
  SELECT c.lang, c.f, array_to_string(c.w[s.i:s.i + m.m - 1], ' ') AS phrase
  FROM known c, (VALUES (1), (2), (3), (4)) AS s(i), (VALUES (2), (3), (4)) AS m(m)
  WHERE m.m < c.k AND s.i + m.m - 1 <= c.k),
covered AS (SELECT lang, phrase, max(f) AS f FROM inner_runs GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS "rank"
  FROM best b LEFT JOIN covered v ON v.lang = b.lang AND v.phrase = b.phrase WHERE v.f IS NULL OR v.f < b.a)
SELECT lang, "rank", phrase, a, l, r, n, score FROM ranked WHERE "rank" <= 2000"""

ORACLE: dict[str, str] = {"op5_urls": URLS, "op6_mixing": MIXING, "op11_phrases": PHRASES}
