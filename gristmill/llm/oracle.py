"""DuckDB SQL that states the same results for the operators SQL can express.

Language scores, 64-bit XXH64 fingerprints, trained licence scores, HTML and checksummed
permutations are beyond it; those queries are tested against brute force.
"""

from __future__ import annotations

from gristmill.llm import decontaminate, filter_audit, imatch, line_dedup, mixing, substring_dedup, url_reputation

ORACLE: dict[str, str] = {}
LETTERS = r"[\p{L}\p{N}]+"

ORACLE["op1_substring_dedup"] = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT *, regexp_extract_all(line, '{substring_dedup.CLAUSE.pattern}') AS clauses,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_at
  FROM lines
), cut AS (
  SELECT doc_id, line_at, unnest(clauses) AS part, generate_subscripts(clauses, 1) AS k
  FROM placed WHERE len(clauses) > 1
), parts AS (
  SELECT doc_id, 'line' AS unit, line_at, line_at AS start, line AS part FROM placed
  UNION ALL
  SELECT doc_id, 'clause', line_at, line_at + coalesce(sum(length(part)) OVER (
           PARTITION BY doc_id, line_at ORDER BY k
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT, part
  FROM cut
), units AS (
  SELECT *, regexp_extract_all(lower(part), '{LETTERS}') AS words FROM parts
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
  FROM units
  WHERE len(words) >= CASE unit WHEN 'line' THEN {substring_dedup.LINE_WORDS} ELSE {substring_dedup.CLAUSE_WORDS} END
  WINDOW w AS (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id NULLS LAST, start)
), later AS (
  SELECT *, bool_or(unit = 'line') OVER (PARTITION BY doc_id, line_at) AS line_gone
  FROM ranked WHERE doc_id <> kept_doc_id OR start <> kept_start
)
SELECT DISTINCT doc_id, start, length(part)::BIGINT AS n_chars, unit, kept_doc_id, kept_start
FROM later WHERE unit = 'line' OR NOT line_gone
"""


def _reputation_sql() -> str:
    u = url_reputation
    rules = " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        f" THEN '{action}|{host}{path}'"
        for action, host, path in sorted(u.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    )
    suffixes = ", ".join(f"'{s}'" for s in u.TWO_LABEL_SUFFIXES)
    upper, lower = u.UPPER, u.LOWER

    def strength(level: str, mean: str) -> str:
        inside = f"""SELECT sum(CASE WHEN n > 0 THEN bad * bad / n - 2.0 * {mean} * bad + n * {mean} * {mean} END) AS spread,
          sum(CASE WHEN n > 0 THEN {mean} * (1.0 - {mean}) END) AS binomial,
          sum(CASE WHEN n > 0 THEN {mean} * (1.0 - {mean}) * (n - 1.0) END) AS more FROM {level}"""
        return f"""SELECT 1.0::DOUBLE / greatest({u.RHO[0]}, least({u.RHO[1]}, coalesce(
          CASE WHEN more > 0 THEN (spread - binomial) / more ELSE 0.0 END, 0.0)))::DOUBLE - 1.0 AS k FROM ({inside})"""

    return rf"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), worst AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), outcomes AS (
  SELECT host, bad FROM (
    SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1), '') AS BIGINT) AS doc_id FROM cut
  ) LEFT JOIN worst USING (doc_id)
), bare AS (
  SELECT host, coalesce(sum(bad), 0)::DOUBLE AS bad, count(bad)::DOUBLE AS n,
         string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels
  FROM outcomes GROUP BY host
), hosts AS (
  SELECT host, bad, n,
    CASE WHEN array_to_string(labels[-2:], '.') IN ({suffixes}) THEN array_to_string(labels[-3:], '.')
         ELSE array_to_string(labels[-2:], '.') END AS domain,
    CASE WHEN array_to_string(labels[-2:], '.') IN ({suffixes}) THEN array_to_string(labels[-2:], '.')
         ELSE labels[-1] END AS suffix
  FROM bare
), overall AS (
  SELECT (coalesce(sum(bad), 0.0) + {u.FLAT / 2}::DOUBLE) / (coalesce(sum(n), 0.0) + {u.FLAT}::DOUBLE) AS m FROM hosts
), s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS up FROM hosts, overall GROUP BY suffix
), s1 AS (SELECT suffix, (bad + k * up) / (n + k) AS up FROM s0, ({strength("s0", "up")})
), d0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(up) AS up
  FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix
), d1 AS (SELECT domain, suffix, (bad + k * up) / (n + k) AS up FROM d0, ({strength("d0", "up")})
), h0 AS (SELECT host, n, bad, up FROM hosts JOIN d1 USING (domain, suffix)
), h1 AS (SELECT host, n + k AS size, (bad + k * up) / (n + k) AS m FROM h0, ({strength("h0", "up")})
), known AS (
  SELECT host, greatest(0.0, m - {u.Z}::DOUBLE * sqrt(m * (1.0 - m) / (size + 1.0))) AS bad_bound FROM h1
), ruled AS (SELECT *, CASE {rules} END AS hit FROM cut)
SELECT page_id, host, path, string_split(hit, '|')[2] AS rule,
       coalesce(string_split(hit, '|')[1], CASE WHEN bad_bound > {u.MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
       round(bad_bound, 6) AS bad_bound
FROM ruled LEFT JOIN known USING (host)
"""


ORACLE["op3_url_reputation"] = _reputation_sql()


def _imatch_sql() -> str:
    low, high = imatch.BAND
    kept = ", ".join(
        f"('0x' || substr(sha256(term), {4 * j + 1}, 4))::INT < {1 << (16 - k)} AS b{j}"
        for j, k in enumerate(imatch.RATES)
    )
    some = " OR ".join(f"b{j}" for j in range(len(imatch.RATES)))
    marks = ", ".join(
        f"coalesce(substr(md5(string_agg(term, ' ' ORDER BY term) FILTER (b{j})), 1, {imatch.DIGITS}), '{imatch.EMPTY}')"
        for j in range(len(imatch.RATES))
    )

    def alone(text: str) -> str:
        return f"list_transform(range({len(imatch.RATES)}), lambda j: substr(sha256({text}), 1, {imatch.DIGITS}))"

    def near(a: str, b: str) -> str:
        numbers = f"range(1, {len(imatch.RATES) + 1})"
        same = f"len(list_filter({numbers}, lambda j: {a}[j] = {b}[j] AND {a}[j] <> '{imatch.EMPTY}'))"
        used = f"len(list_filter({numbers}, lambda j: {a}[j] <> '{imatch.EMPTY}' OR {b}[j] <> '{imatch.EMPTY}'))"
        return f"round(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE coalesce({same}::DOUBLE / nullif({used}, 0), 0.0) END, 6)"

    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), ordered AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER () AS total,
         coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM docs WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC)
), sides AS (
  SELECT *, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) AS edited FROM ordered
), terms AS (
  SELECT rn, 0 AS side, unnest(list_distinct(regexp_extract_all(lower(text), '{LETTERS}'))) AS term FROM sides
  UNION ALL
  SELECT rn, 1, unnest(list_distinct(regexp_extract_all(lower(edited), '{LETTERS}'))) FROM sides
), counted AS (
  SELECT term, count(*) AS df FROM terms WHERE side = 0 GROUP BY term
), lexicon AS (
  SELECT * FROM (SELECT term, {kept} FROM counted
    WHERE ln((SELECT count(*) FROM docs)::DOUBLE / df) BETWEEN {low} AND {high}) WHERE {some}
), marked AS (
  SELECT rn, side, [{marks}] AS marks FROM terms JOIN lexicon USING (term) GROUP BY rn, side
), both_sides AS (
  SELECT s.*, coalesce(a.marks, {alone("s.text")}) AS marks, coalesce(b.marks, {alone("s.edited")}) AS edited_marks
  FROM sides s LEFT JOIN marked a ON a.rn = s.rn AND a.side = 0 LEFT JOIN marked b ON b.rn = s.rn AND b.side = 1
)
SELECT x.doc_id, x.n::BIGINT AS n_chars, sha256(x.edited) AS edited_sha256,
       array_to_string(x.marks, '') AS fingerprint, array_to_string(x.edited_marks, '') AS edited_fingerprint,
       {near("x.marks", "x.edited_marks")} AS near_edited, {near("x.marks", "y.marks")} AS near_next
FROM both_sides x JOIN both_sides y ON y.rn = x.rn % x.total + 1
"""


ORACLE["op4_imatch"] = _imatch_sql()


def _decontamination_sql() -> str:
    d = decontaminate
    least = min(map(len, d.MASKS))

    def seeds(table: str, key: str, tokens: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {key}, pos, {number} AS mask, concat_ws(' ', "
            + ", ".join(f"{tokens}[pos + {k + 1}]" for k, bit in enumerate(mask) if bit == "1")
            + f") AS seed FROM (SELECT *, unnest(range(0, len({tokens}) - {len(mask) - 1})) AS pos FROM {table})"
            for number, mask in enumerate(d.MASKS)
        )

    return rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{LETTERS}') AS t FROM documents
), items AS (
  SELECT coalesce(min(item_id), -1) AS item_id, b FROM (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{LETTERS}') AS b FROM benchmark
  ) WHERE len(b) >= {least} GROUP BY b
), document_seeds AS ({seeds("texts", "doc_id", "t")}
), item_seeds AS ({seeds("items", "item_id", "b")}
), hits AS (
  SELECT DISTINCT doc_id, item_id, s.pos - i.pos AS start
  FROM document_seeds s JOIN item_seeds i ON s.mask = i.mask AND s.seed = i.seed
), aligned AS (
  SELECT doc_id, item_id, start, least(len(b), {d.WINDOW}) AS compared,
    list_transform(range(1, len(b) + 1), lambda i:
      CASE WHEN start + i >= 1 AND start + i <= len(t) AND t[start + i] = b[i] THEN 1 ELSE 0 END) AS same
  FROM hits JOIN texts USING (doc_id) JOIN items USING (item_id)
), scored AS (
  SELECT *, list_max(list_transform(range(0, len(same) - compared + 1), lambda k:
    list_sum(same[k + 1 : k + compared])))::INT AS matched FROM aligned
)
SELECT doc_id, item_id, start, matched, compared, matched / compared AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) AS place
  FROM scored WHERE matched >= ceil(compared * {d.SIMILARITY} - 1e-9)
) WHERE place = 1
"""


ORACLE["op5_decontaminate"] = _decontamination_sql()

_W = ", ".join(map(str, mixing.WEIGHTS))
ORACLE["op6_mixing"] = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size) AS key,
         row_number() OVER () AS id FROM sizes
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [{_W}][(rank - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS weight,
         (source_size * {mixing.MOST_EPOCHS})::DOUBLE AS cap FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT *, least(cap, weight * coalesce((SELECT level FROM levels WHERE cap >= weight * level
    ORDER BY cap / weight, rank LIMIT 1), 0.0)) AS target FROM levels
), queues AS (
  SELECT k.id, k.doc_id, k.size, k.key, t.rank, t.source_size, t.target,
         sum(k.size) OVER (PARTITION BY t.rank ORDER BY k.key, k.id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT *, (epoch * source_size + cum) / target AS v
  FROM queues, (SELECT unnest(range({mixing.MOST_EPOCHS})) AS epoch) WHERE target > 0
), served AS (
  SELECT id, size, sum(size) OVER (ORDER BY v, rank, epoch, key ROWS UNBOUNDED PRECEDING) AS through FROM passes
), taken AS (
  SELECT id, count(*) AS copies FROM served WHERE through <= (SELECT sum(size) FROM sizes) GROUP BY id
)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * coalesce(copies, 0))::BIGINT AS taken
FROM queues LEFT JOIN taken USING (id)
"""

# Which of several texts without an id keeps a line follows Spark's hash of the text; everything
# else is stated here.
ORACLE["op11_line_dedup"] = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT id, doc_id, CASE WHEN doc_id IS NULL THEN text END AS own,
         unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM texts
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT key, doc_id, own FROM keyed)
  WHERE length(key) >= {line_dedup.LEAST_POINTS} GROUP BY key HAVING count(*) >= {line_dedup.LEAST_DOCS}
), judged AS (
  SELECT id, doc_id, pos, line, last IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone
  FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY id, doc_id
"""

ORACLE["op12_filter_audit"] = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), named AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < {filter_audit.LEAST_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < {filter_audit.DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {filter_audit.CAPITAL_PERCENT} * length(text)
       THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '{filter_audit.SYMBOLS}') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM texts LEFT JOIN named USING (doc_id)
), counted AS (
  SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS l, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), met AS (
  SELECT *, contains(fails, l) AS failed_here,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: contains(fails, f) AND contains(earlier, f))) > 0 AS gone
  FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, l,
    coalesce(sum(docs) FILTER (NOT gone AND NOT failed_here), 0)::BIGINT AS kept,
    coalesce(sum(docs) FILTER (NOT gone AND failed_here), 0)::BIGINT AS removed,
    coalesce(sum(docs) FILTER (gone AND failed_here), 0)::BIGINT AS redundant,
    coalesce(sum(docs) FILTER (fails = l), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failed_here), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND failed_here), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, l
)
SELECT * EXCLUDE (l), (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM summed
"""
