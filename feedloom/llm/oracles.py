"""DuckDB SQL of the longer oracles: the same results from the contracts, by plain joins and windows."""

from __future__ import annotations

from feedloom.llm import licenses

#: A table for checksums by bytes, and the checksum of a decimal number's digits.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), i) AS v FROM range(256) AS r(i)))"


def crc32(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce({digits}, lambda a, b: xor(a >> 8, crc.t[CAST((xor(a, b) & 255) + 1 AS INTEGER)]), CAST(4294967295 AS BIGINT)))"


def license_scans() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({r.rule}, {quoted(r.keyword)}, {quoted(r.label)}, {r.priority}, {quoted(r.pattern)}, {r.phrase != ''})" for r in licenses.rules())
    heads = ", ".join(quoted(h) for h in sorted({r.keyword.split()[0] for r in licenses.rules()}))
    weights = " ".join(f"WHEN {p} THEN {w}" for p, w in licenses.WEIGHTS.items())
    return f"""
        WITH rules(rule, keyword, label, priority, pattern, base) AS (VALUES {values}),
        w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        p AS (SELECT r, CAST(i AS BIGINT) AS i, words[i] AS one, words[i] || ' ' || coalesce(words[i + 1], '') AS two, array_to_string(words[i : i + {licenses.REACH - 1}], ' ') || ' ' AS ahead
            FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w) WHERE words[i] IN ({heads})),
        t AS (SELECT r, i - 1 AS first, rule, label, priority, base, regexp_extract(ahead, pattern) AS hit FROM (SELECT * FROM p JOIN rules ON keyword = two UNION ALL SELECT * FROM p JOIN rules ON keyword = one)),
        d AS MATERIALIZED (SELECT r, first, rule, label, priority, base, first + length(hit) - length(replace(hit, ' ', '')) - 1 AS last FROM t WHERE hit <> ''),
        k AS MATERIALIZED (SELECT * FROM d AS a WHERE NOT EXISTS (SELECT 1 FROM d AS b WHERE b.r = a.r AND b.first <= a.first AND b.last >= a.last
            AND (b.priority > a.priority OR b.priority = a.priority AND (b.first < a.first OR b.last > a.last OR b.rule < a.rule)))),
        b AS (SELECT r, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM d WHERE base GROUP BY r),
        l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM k UNION SELECT r, label FROM d WHERE base) GROUP BY r),
        s AS (SELECT r, 1 - product(1 - CASE best {weights} END) AS score FROM (SELECT r, label, max(priority) AS best FROM k GROUP BY ALL) GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
        FROM w LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)"""


def merkle_manifest(depth: int = 7, upper: int = 4) -> str:
    """For at most 8 ** depth rows of a language and 8 ** upper languages."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, n: int) -> list[str]:
        """From name0 (tree, i, h): each level with the siblings to the left and right, unless the node stands alone."""
        out = []
        for k in range(n):
            if k:
                out.append(f"{name}{k} AS MATERIALIZED (SELECT tree, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k - 1}s GROUP BY tree, i // 8)")
            side = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN {frame}), '')"
            out.append(f"{name}{k}s AS MATERIALIZED (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k})")
        return out

    fold = lambda name, k, below: f"CASE WHEN {name}{k}s.n > 1 THEN sha256({name}{k}s.l || {below} || {name}{k}s.r) ELSE {below} END"
    steps = [("a", k) for k in range(depth)] + [("u", k) for k in range(upper)]
    folds, below = [], "forged"
    for at, (name, k) in enumerate(steps):
        folds.append(f"{fold(name, k, below)} AS f{at}")
        below = f"f{at}"
    low = f"translate(text, '{licenses.UPPER}', '{licenses.LOWER}')"
    return f"""
        WITH {CRC_TABLE},
        d AS MATERIALIZED (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {leaf('text')} AS leaf, CASE WHEN {crc32('doc_id')} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS forged FROM documents, crc),
        e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
        a0 AS MATERIALIZED (SELECT tree, pos AS i, leaf AS h FROM e), {', '.join(levels('a', depth + 1))},
        roots AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM a{depth}),
        u0 AS MATERIALIZED (SELECT 0 AS tree, pos AS i, h FROM roots), {', '.join(levels('u', upper + 1))},
        x AS (SELECT doc_id, leaf, roots.h AS subroot, u{upper}.h AS root, sha256({' || '.join(f"{n}{k}s.l || {n}{k}s.r" for n, k in steps)}) AS proof_sha256, {', '.join(folds)}
            FROM e JOIN roots USING (tree) {' '.join(f"JOIN a{k}s ON a{k}s.tree = e.tree AND a{k}s.i = e.pos // {8**k}" for k in range(depth))}
            {' '.join(f"JOIN u{k}s ON u{k}s.i = roots.pos // {8**k}" for k in range(upper))}, u{upper})
        SELECT doc_id, leaf, subroot, root, proof_sha256, {below} AS folded_root, {below} = root AS verified FROM x"""


def prefix_trie() -> str:
    return f"""
        WITH {CRC_TABLE},
        t AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS MATERIALIZED (SELECT conv_id, sha256(strlen(role) || ':' || role || text) AS digest, length(text) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS place FROM t),
        c AS MATERIALIZED (SELECT conv_id, {crc32('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
        b AS (SELECT c.conv_id, 0 AS own, place, digest, tokens FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND place < h
            UNION ALL SELECT c.conv_id, 1, place, digest, tokens FROM c JOIN o ON o.conv_id = c.conv_id AND place >= h),
        l AS MATERIALIZED (SELECT c.conv_id, list(digest ORDER BY own, place) FILTER (digest IS NOT NULL) AS turns, list(tokens ORDER BY own, place) FILTER (digest IS NOT NULL) AS sizes FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
        p AS MATERIALIZED (SELECT conv_id, d AS depth, coalesce(len(turns), 0) AS size, sha256(array_to_string(coalesce(turns[1:d], []), '')) AS prefix, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS tokens
            FROM (SELECT *, unnest(range(coalesce(len(turns), 0) + 1)) AS d FROM l)),
        n AS MATERIALIZED (SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, any_value(tokens) AS tokens, max(size) = depth AS childless,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM p GROUP BY depth, prefix),
        m AS MATERIALIZED (SELECT p.conv_id, p.depth, node FROM p JOIN n USING (depth, prefix)),
        s AS (SELECT m.node, m.depth, CAST(sum(CAST(n.childless AS INTEGER)) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.tokens) AS BIGINT) AS saved_tokens FROM n JOIN m ON m.conv_id = n.node AND m.depth <= n.depth GROUP BY m.node, m.depth),
        u AS (SELECT n.node, n.depth, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1),
        k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY ALL)
        SELECT n.node AS conv_id, n.depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
        FROM n JOIN s USING (node, depth) JOIN u USING (node, depth) LEFT JOIN k USING (node, depth)"""
