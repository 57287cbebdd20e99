"""SQL that an independent engine runs beside the queries whose results SQL can express."""

from __future__ import annotations

from factloom.llm import ring

# Secrets -----------------------------------------------------------------------------------------------------------

#: Letters of either case are spelled out: this engine's (?i) would fold letters beyond ASCII too.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Pattern, group of the value, and what is asked of the value. A greedy run from its first character on is maximal.
_KINDS = ((_ASSIGN, 2, "length(v) >= 6"), ("AKIA[A-Z0-9]+", 0, "length(v) >= 20"), ("[0-9a-f]{24,}", 0, "true"), ("[A-Za-z0-9_+/-]{32,}", 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')"))
_NAMES = "['assign', 'access', 'hex', 'mixed']"


def _found(kind: int) -> str:
    pattern, group, kept = _KINDS[kind]
    parts = f"SELECT r, regexp_extract_all(t, '{pattern}') AS ws, regexp_extract_all(t, '{pattern}', {group}) AS vs, string_split_regex(t, '{pattern}') AS gs FROM d WHERE regexp_matches(t, '{pattern}')"
    each = f"SELECT r, unnest(ws) AS w, unnest(vs) AS v, unnest(gs[:len(ws)]) AS g, generate_subscripts(ws, 1) AS n FROM ({parts})"
    return f"SELECT r, {kind} AS kind, v, e - length(w) AS b, e FROM (SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY r ORDER BY n) AS e FROM ({each})) WHERE {kept}"


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS owner, concat_ws('/', source, lang) AS repository FROM documents),
base AS ({" UNION ALL ".join(_found(k) for k in range(3))}),
mixed AS ({_found(3)}),
found AS (SELECT * FROM base UNION ALL SELECT * FROM mixed m WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.r = m.r AND x.b < m.e AND m.b < x.e)),
counts AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM found JOIN d USING (r) GROUP BY v),
named AS (SELECT *, {_NAMES}[kind + 1] || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM found JOIN counts USING (v))
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY b, kind, e) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY b, kind, e) FILTER (kind < 3 OR owners < 3), '') AS spans,
  count(*) FILTER (owners <= 1) AS n_live, count(*) FILTER (owners >= 3) AS n_copied, coalesce(max(owners), 0) AS max_owners, coalesce(max(repositories), 0) AS max_repositories
FROM d LEFT JOIN named USING (r) GROUP BY r, doc_id"""

# Near duplicates ---------------------------------------------------------------------------------------------------

#: Sets of runs of five words, the pairs that share a run, links by similarity, and classes by reachability.
JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 1.8 >= 0.8 * (x.n + y.n) - 1e-3),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN links ON a = node WHERE root < b)
SELECT d.doc_id, d.root AS class_id, coalesce(l.n, 0) AS n_links FROM (SELECT node AS doc_id, min(root) AS root FROM reach GROUP BY 1) d LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY 1) l USING (doc_id)"""

# Shards ------------------------------------------------------------------------------------------------------------


def _crc_table() -> list[int]:
    found = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        found.append(c)
    return found


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8, in SQL."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])), 4294967295)"


def shards(n: int = 8, virtual: int = 64) -> str:
    """The ring, row by row: home while there is room, in ring order; then the others, each to the next node with room."""
    held = ring.nodes(n, virtual)
    ends = ", ".join(f"({i}, {at}, {shard})" for i, (at, shard) in enumerate(held))
    around = [shard for _, shard in held]
    crc = _crc32("t")
    return f"""
WITH RECURSIVE nodes(i, stands, shard) AS (VALUES {ends}),
d AS (SELECT doc_id, strlen(t) + 1 AS size, {crc} AS crc, CAST('0x' || substr(md5('ring/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {ring.WIDE // 4}) AS BIGINT) AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
c AS (SELECT *, p >> {ring.WIDE - ring.bits(n, virtual)} AS cell FROM d),
h AS (SELECT c.*, coalesce((SELECT min(i) FROM nodes WHERE stands >= cell), 0) AS home, row_number() OVER (ORDER BY cell, p, doc_id, crc, size) AS r FROM c),
s AS (SELECT h.*, shard FROM h JOIN nodes ON i = home),
room AS (SELECT list(n // {n} + CASE WHEN s < n % {n} THEN 1 ELSE 0 END ORDER BY s) AS room FROM (SELECT count(*) AS n FROM d), (SELECT unnest(range({n})) AS s)),
t AS (SELECT s.*, row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS k, room[shard + 1] AS most, room FROM s, room),
used AS (SELECT list(coalesce(least(n, most), 0) ORDER BY s) AS used FROM (SELECT unnest(range({n})) AS s) LEFT JOIN (SELECT shard, count(*) AS n, max(most) AS most FROM t GROUP BY 1) ON s = shard),
over AS (SELECT *, row_number() OVER (ORDER BY r) AS o FROM t WHERE k >= most),
step(o, used, shard, slot) AS (
  SELECT 0, used, -1, CAST(-1 AS BIGINT) FROM used
  UNION ALL SELECT o, list_transform(used, lambda u, j: CASE WHEN j = target + 1 THEN u + 1 ELSE u END), target, used[target + 1] FROM
    (SELECT over.o, step.used, list_filter(list_concat({around}[over.home + 2 :], {around}[: over.home + 1]), lambda x: step.used[x + 1] < over.room[x + 1])[1] AS target FROM step JOIN over ON over.o = step.o + 1)),
placed AS (SELECT doc_id, size, crc, shard, k AS slot FROM t WHERE k < most UNION ALL SELECT doc_id, size, crc, step.shard, slot FROM over JOIN step USING (o))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(slot AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed"""

# Importance resampling ---------------------------------------------------------------------------------------------

#: Buckets of distinct words; gains by bucket, the sums over all documents and all target texts beside them.
RESAMPLED = rf"""
WITH texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, -row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
b AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w)),
f AS (SELECT side, r, bucket FROM w JOIN b USING (word)),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (all_s + 10000)) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain FROM n, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM n)),
m AS (SELECT r, count(*) AS n, sum(gain) AS total FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM texts LEFT JOIN m USING (r) WHERE side = 0),
p AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS eligible FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM k"""


# Conversations -----------------------------------------------------------------------------------------------------


def _after(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {line}}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _put(state: str, role: str) -> str:
    return _after(state, "2", "I", f"chr(10) || '{role}:'")


def repairs() -> str:
    """Turn by turn, the cheapest and least edits (cost, letters, output) that end in each state.

    s0: nothing written, s1 a system's turn last, s2 a user's, s3 an assistant's; p2 and p3 after insertions.
    """
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}"
    keep = lambda state, x: f"CASE WHEN stays AND x = '{x}' THEN {_after(state, 'late', 'K', 'line')} ELSE {far} END"
    turn = lambda state, role: "CASE WHEN stays THEN " + _after(state, "2 + late", "R", f"chr(10) || '{role}:' || text") + f" ELSE {far} END"
    gone = lambda state: _after(state, "3", "D")
    user = ("s0", "s1", "p3")
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c, (SELECT unnest(range(2)) AS k) WHERE d <> 0 AND (k = 0 OR d = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM r),
w AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
f AS (SELECT *, left(role, 1) AS x, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late, chr(10) || role || ':' || text AS line FROM w),
held(conv, n, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {far.replace("1000000000", "0")}, {far}, {far}, {far} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv, n, {gone("s0")}, {_least(gone("s1"), keep("s0", "s"))}, {_least(gone("p2"), *(keep(q, "u") for q in user), *(turn(q, "user") for q in user))}, {_least(gone("p3"), keep("p2", "a"), turn("p2", "assistant"))}
  FROM (SELECT *, {_least("s3", _put("p2", "assistant"))} AS p3 FROM (SELECT conv, i AS n, s0, s1, s2, s3, text, x, stays, late, line, {_least("s2", *(_put(q, "user") for q in ("s0", "s1", "s3")))} AS p2 FROM held JOIN f ON f.conv_id IS NOT DISTINCT FROM conv AND i = n + 1))),
done AS (SELECT conv, {_least("s0", "s3", _put("s2", "assistant"), _put(_put("s1", "user"), "assistant"))} AS s FROM held QUALIFY row_number() OVER (PARTITION BY conv ORDER BY n DESC) = 1),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(s.c AS BIGINT) AS cost, s.a AS audit, sha256(substr(s.o, 2)) AS repaired_sha256
FROM done LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM conv"""
