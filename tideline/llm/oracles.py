"""DuckDB counterparts of the queries whose whole result SQL can express.

They follow the definitions and not the Spark plans: all pairs that share a shingle or a label, reachability by recursion, one list fold for the
estimate's rounds. They are for small tables. op1, op2, op3, op8, op9 and op11 have none: trained models, copies and shards dealt by hash, vocabularies.
op10 has none either: its links are tested against a generator.
"""

from __future__ import annotations

from tideline.llm import rules, secrets

#: A word, and the letters that are lowered.
WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def components_sql(nodes: str, links: str) -> str:
    """CTEs linked, reach and comp (node, component) for the rows (id) of `nodes` and the rows (a, b) of `links`; the whole has to begin with WITH RECURSIVE."""
    return f""", linked AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach(node, other) AS (SELECT id, id FROM {nodes} UNION SELECT r.node, l.b FROM reach r JOIN linked l ON r.other = l.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


def jaccard_sql(percent: int = 75) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT id, len(s) AS n, unnest(s) AS h FROM s),
shared AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.id < y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM shared WHERE 100 * c >= {percent} * (na + nb - c)){components_sql("s", "links")}
SELECT s.id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, comp.component AS component_id FROM s JOIN comp ON comp.node = s.id"""


def embeddings_sql(cosine: float = 0.98) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT id, label, list_transform(v, lambda e: coalesce(e, 0)) AS v FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id < y.id WHERE CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) >= {cosine} ELSE false END){components_sql("v", "links")},
degree AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT comp.node AS vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, comp.component AS component_id, comp.node = comp.component AS kept FROM comp LEFT JOIN degree ON degree.a = comp.node"""


def secrets_sql(example_owners: int = 5, example_repositories: int = 8, least_bits: float = 2.0) -> str:
    """Spans of each kind by the lengths of pieces and matches, and the verdict on added spans by distinct owners and repositories of equal values."""
    alnum = "[A-Za-z0-9+/]"
    kinds = [
        ("assign", secrets.ASSIGN, f"length(regexp_replace(m, {quoted(secrets.ASSIGN_HEAD)}, '')) >= 12"),
        ("access", secrets.ACCESS, "length(m) >= 18"),
        ("hex", secrets.HEX, "true"),
        ("block", secrets.ADDED["block"], "true"),
        ("prefixed", secrets.ADDED["prefixed"], "true"),
        # whole runs, of which those with 32 characters and all three classes count
        ("mixed", f"{alnum}+={{0,2}}", f"regexp_matches(m, '^{alnum}{{32}}') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"),
    ]
    each = "\nUNION ALL ".join(
        f"""SELECT id, owner, repository, '{kind}' AS kind, {rank} AS rank, m, stop FROM (
  SELECT id, owner, repository, m, sum(length(m) + length(p)) OVER (PARTITION BY id ORDER BY i) AS stop FROM (
    SELECT id, owner, repository, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p FROM (
      SELECT *, regexp_extract_all(text, {quoted(pattern)}) AS ms, string_split_regex(text, {quoted(pattern)}) AS ps FROM d))) WHERE {test}"""
        for rank, (kind, pattern, test) in enumerate(kinds)
    )
    joined = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER ({where}), '')"
    return f"""WITH d AS (SELECT doc_id AS id, coalesce(source, chr(0)) AS owner, coalesce(source, chr(0)) || chr(1) || coalesce(lang, chr(0)) AS repository, coalesce(text, '') AS text FROM documents),
c AS ({each}),
found AS (SELECT *, stop - length(m) AS start, CASE WHEN kind = 'assign' THEN regexp_replace(m, {quoted(secrets.ASSIGN_HEAD)}, '') ELSE m END AS value FROM c),
use AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM found GROUP BY value),
letters AS (SELECT value, ch, count(*) AS n FROM (SELECT value, unnest(string_split(value, '')) AS ch FROM use) GROUP BY value, ch),
bits AS (SELECT value, -sum(n / length(value) * log2(n / length(value))) AS bits FROM letters GROUP BY value),
judged AS (SELECT found.*, rank < {len(secrets.BASE_KINDS)} AS base, use.owners < {example_owners} AND use.repositories < {example_repositories} AND bits.bits >= {least_bits} AND NOT regexp_matches(lower(value), '{"|".join(secrets.PLACEHOLDERS)}') AS live
  FROM found JOIN use USING (value) JOIN bits USING (value)),
s AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  {joined("base")} AS base, {joined("base OR live")} AS spans, count(*) FILTER (live) AS n_live FROM judged GROUP BY id)
SELECT d.id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN s ON s.id = d.id"""


#: The default rules as SQL over the counts, in their order.
VOTES = {
    "length": "n_words < 5",
    "word_length": "n_words >= 10 AND (word_chars / n < 2 OR word_chars / n > 14)",
    "symbols": "n_words >= 10 AND n_symbols / n > 0.15",
    "duplicate_lines": "n_lines >= 4 AND n_dup_lines * 10 > n_lines * 3",
    "repeated_words": "n_words >= 10 AND n_repeat_words / n > 0.2",
    "capitals": "n_words >= 10 AND n_upper > 0.35 * word_chars",
    "variety": "n_words >= 10 AND n_kinds / sqrt(n) < 1.5 AND n_kinds / n < 0.3",
    "shouting": "n_words >= 10 AND n_shouts / n > 0.2",
}
PROSE = "n_words >= 10 AND n_symbols / n < 0.03 AND n_upper < 0.15 * word_chars AND n_repeat_words / n < 0.05 AND n_shouts / n < 0.03 AND word_chars / n BETWEEN 2.5 AND 12"


def rules_sql(rounds: int = 40, threshold: float = 0.5) -> str:
    """Votes are 0 bad, 1 abstains, 2 good; a round's tables hold three probabilities a rule, in that order."""
    n_rules = len(VOTES) + 1
    votes = ", ".join([*[f"CASE WHEN {v} THEN 0 ELSE 1 END" for v in VOTES.values()], f"CASE WHEN {PROSE} THEN 2 ELSE 1 END"])
    table = lambda start: "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in start * n_rules) + "]"
    odds = lambda votes: f"ln(prior / (1 - prior)) + list_sum(list_transform({votes}, lambda x, r: ln(good[3 * r - 2 + x] / bad[3 * r - 2 + x])))"
    by_vote = lambda field: f"list_transform(range({3 * n_rules}), lambda j: coalesce(list_sum(list_transform(list_filter(x, lambda p: p.votes[j // 3 + 1] = j % 3), lambda p: p.{field})), 0.0))"
    mean = lambda field, start: f"list_transform(list_zip({by_vote(field)}, {table(start)}), lambda z: (z[1] + strength * z[2]) / ({field}_sum + strength))"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS h FROM w WHERE len(w) >= 5),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range({rules.WINDOW}) AS o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM w),
counts AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '{rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(text) - length(translate(text, '{UPPER}', '')) AS n_upper,
  len(list_distinct(w)) AS n_kinds, length(text) - length(replace(text, '!', '')) AS n_shouts, greatest(len(w), 1) AS n FROM w JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
voted AS (SELECT *, [{votes}] AS votes, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
patterns AS (SELECT list({{'votes': votes, 'n': CAST(c AS DOUBLE)}} ORDER BY votes) AS ps, coalesce(sum(c), 0) AS total, 0.01 * coalesce(sum(c), 0) + 1 AS strength FROM (SELECT votes, count(*) AS c FROM voted GROUP BY votes)),
em(step, prior, good, bad) AS (SELECT 0, CAST({rules.START_PRIOR} AS DOUBLE), {table(rules.START_GOOD)}, {table(rules.START_BAD)} UNION ALL
  SELECT step + 1, (good_sum + {rules.START_PRIOR} * strength) / (total + strength), {mean("good", rules.START_GOOD)}, {mean("bad", rules.START_BAD)} FROM (
    SELECT step, strength, total, x, list_sum(list_transform(x, lambda p: p.good)) AS good_sum, list_sum(list_transform(x, lambda p: p.bad)) AS bad_sum FROM (
      SELECT step, strength, total, list_transform(y, lambda p: {{'votes': p.votes, 'good': p.good, 'bad': p.n - p.good}}) AS x FROM (
        SELECT step, strength, total, list_transform(ps, lambda p: {{'votes': p.votes, 'n': p.n, 'good': p.n / (1 + exp(-({odds("p.votes")})))}}) AS y FROM em, patterns WHERE step < {rounds})))),
judged AS (SELECT voted.*, 1 / (1 + exp(-({odds("votes")}))) AS posterior FROM voted, em WHERE step = {rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {threshold} AS kept, posterior FROM judged"""


def collocations_sql(least: int = 100, most: int = 2000, percent: int = 100) -> str:
    """All runs of one to five words, counted; the sub-phrases of each one and its cuts by joins."""
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS t(k))),
f AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY lang, phrase, k HAVING count(*) >= {least}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ones AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS covered FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM c, range(2, 5) AS t(j) WHERE j < k) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ones USING (lang, phrase) WHERE covered IS NULL OR 100 * covered < {percent} * a),
cuts AS (SELECT x.lang, x.phrase, x.a, x.j, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * x.a * n.n) // (l.a::HUGEINT * r.a) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.j], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.j + 1:], ' ') JOIN n ON n.lang = x.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM low QUALIFY rank <= {most}"""


def repair_sql() -> str:
    """A table of four best audits (cost in twelve digits, then letters) for each row from the last to the first; then the audits' letters joined with rows."""
    blanks = "\\x20\\x09-\\x0D"
    add = lambda v, cost, letter: f"printf('%012d', CAST(substr({v}, 1, 12) AS BIGINT) + {cost}) || '{letter}' || substr({v}, 13)"
    ins = lambda v: add(v, 3, "I")
    filled = lambda d: [f"least({d[0]}, {ins(d[2])}, {ins(ins(d[3]))})", f"least({d[1]}, {ins(d[2])}, {ins(ins(d[3]))})", f"least({d[2]}, {ins(d[3])})", f"least({d[3]}, {ins(d[2])})"]
    direct = []
    for q, (due, to) in enumerate([("u", 2), ("u", 2), ("a", 3), ("u", 2)]):
        system = f"WHEN NOT gone AND initial = 's' THEN {add('v1', 'extra', 'K')} " if q == 0 else ""
        keep = f"CASE {system}WHEN NOT gone AND initial = '{due}' THEN {add(f'v{to}', 'extra', 'K')} END"
        direct.append(f"least({add(f'v{q}', 4, 'D')}, {keep}, CASE WHEN NOT gone THEN {add(f'v{to}', '3 + extra', 'R')} END) AS d{q}")
    zero, none = "'000000000000'", "CAST(NULL AS VARCHAR)"
    last = filled([zero, none, none, zero])
    four = lambda e: ", ".join(f"{x} AS v{q}" for q, x in enumerate(e))
    return f"""WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM given),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM kinds WHERE kind <> 0),
e0 AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^{blanks}]') AS blank, NOT regexp_matches(text, '[.!?][{blanks}]*$') AS open_end,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i FROM e0),
f AS (SELECT *, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND open_end AS truncated, blank OR seen AS gone, CASE WHEN open_end THEN 3 ELSE 0 END AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM e),
counts AS (SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
dp AS (SELECT conv_id, n + 1 AS i, {four(last)} FROM counts UNION ALL
  SELECT conv_id, i, {four(filled(["d0", "d1", "d2", "d3"]))} FROM (SELECT dp.conv_id, f.i, {", ".join(direct)} FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i - 1)),
best AS (SELECT conv_id, CAST(substr(v0, 1, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM dp WHERE i = 1),
letters AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS j, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS m FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
made AS (SELECT p.conv_id, p.j, p.m, p.letter, f.role, CASE WHEN p.letter = 'I' THEN '' ELSE f.text END AS text, f.initial FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE p.letter <> 'D'),
led AS (SELECT *, max(CASE WHEN m = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM made),
whole AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole FROM led GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLES = {
    "op4_embedding_near_dedup": embeddings_sql(),
    "op5_secret_scans": secrets_sql(),
    "op6_quality_rules": rules_sql(),
    "op7_ngram_jaccard_join": jaccard_sql(),
    "op12_phrase_collocations": collocations_sql(),
    "op13_conversation_repair": repair_sql(),
}
