"""License scans, Merkle manifests and prefix tries against brute force and SQL, with odd rows."""

import collections
import glob
import hashlib
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from feedloom.llm import licenses, merkle, queries, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, run long, total long, words string, found int"
LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def docs_of(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows_of(df, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return collections.Counter(tuple(r[k] for k in order) for r in df)


@pytest.mark.parametrize("name", ["op11_license_scans", "op12_merkle_manifest", "op13_conversation_prefix_trie"])
def test_query_equals_its_oracle(spark, duck, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    cur = duck.execute(queries.oracle_sql()[name])
    assert rows_of(df.collect(), df.columns) == rows_of(cur.fetchall(), [c[0] for c in cur.description])


# ---- licenses

LICENSED = [
    (1, None, "en", "s", 1), (2, "", None, None, None), (3, "  ..  ", "en", "s", 1), (3, "All Rights Reserved. all rights-reserved", "en", "s", 1), (3, "All Rights Reserved. all rights-reserved", "en", "s", 1),
    (4, "under the GNU General Public License, version 3 or (at your option) any later version.", "en", "s", 1), (5, "CC BY-NC 4.0 and cc by, CC-BY", "en", "s", 1), (None, "general public\nlicense", "en", "s", 1),
    (6, "all rights reservedx overall rights reserved ALL É rights reserved", "fr", "s", 1), (7, "Tous droits réservés. SPDX-License-Identifier: GPL-2.0-or-later", "fr", "s", 1),
    (8, "Redistribution and use in source and binary forms, with or without modification, are permitted", "de", "s", 1), (9, "cc by cc by cc by", "en", "s", 1), (10, "general public general public license license", "en", "s", 1),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_license(text):
    """All columns but doc_id, by trying every rule at every word and comparing all pairs."""
    words = WORD.findall((text or "").translate(LOWER))
    base = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for i in range(len(words)):
        ahead = " ".join(words[i : i + licenses.REACH]) + " "
        for r in licenses.rules():
            if m := re.match(r.pattern[1:], ahead):
                found.append((i, i + m.group().count(" ") - 1, r.rule, r.label, r.priority))
    beats = lambda b, a: b[0] <= a[0] and b[1] >= a[1] and (b[4] > a[4] or b[4] == a[4] and (b[0] < a[0] or b[1] > a[1] or b[2] < a[2]))
    kept = [a for a in found if not any(beats(b, a) for b in found)]
    left = 1.0
    for label in {a[3] for a in kept}:
        left *= 1 - licenses.WEIGHTS[max(a[4] for a in kept if a[3] == label)]
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | {a[3] for a in kept})), pytest.approx(1 - left, abs=1e-6))


def test_licenses_equal_brute_force(spark):
    got = licenses.summary(licenses.scan(docs_of(spark, LICENSED))).collect()
    assert [r.doc_id for r in got] == [r[0] for r in LICENSED]
    for r, (_, text, *_) in zip(got, LICENSED, strict=True):
        assert tuple(r)[1:] == brute_license(text), text
    labels = {r.doc_id: r.labels for r in got}
    assert labels[4] == "gpl,gpl-3.0-or-later" and labels[5] == "cc-by,cc-by-nc-4.0" and labels[7] == "gpl-2.0-or-later,reserved" and labels[8] == "bsd"


def test_every_rule_can_match_and_reaches_no_further_than_its_words(spark):
    assert len(licenses.rules()) > 200
    for r in licenses.rules():
        assert r.pattern.startswith(f"^{r.keyword}") and len(r.keyword.split()) <= 2
        longest = re.sub(r"\(\?:([^()]*)\)\??", lambda m: max(m.group(1).split("|"), key=lambda x: len(x.split())), r.pattern)
        assert len(longest.split()) <= licenses.REACH, r


def test_license_scan_is_native_and_reads_long_texts_in_one_pass(spark):
    text = "a general word and " * 100_000 + "all rights reserved " * 20_000
    began = time.time()
    row = licenses.summary(licenses.scan(docs_of(spark, [(1, text, "en", "s", 1)]))).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (460_000, 20_000, 400_000, 459_997) and time.time() - began < 60
    plan = licenses.summary(licenses.scan(docs_of(spark, LICENSED)))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan.split("Physical Plan")[1])
    assert licenses.scan(docs_of(spark, LICENSED).limit(0)).count() == 0


# ---- manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        first = i - i % 8
        yield level[first:i], level[i + 1 : first + 8]
        i //= 8


def brute_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = {lang: tree([leaf(r) for r in by[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = collections.Counter()
    for k, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            way = [*siblings(trees[lang], i), *siblings(top, k)]
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            node = leaf(Row(**{**r.asDict(), "text": r.text.translate(LOWER)})) if changed else leaf(r)
            for before, after in way:
                node = h(*before, node, *after)
            out[r.doc_id, leaf(r), trees[lang][-1][0], top[-1][0], h(*[x for pair in way for side in pair for x in side]), node] += 1
    return out


MANIFEST = [(None, "x", None, None, None), (None, "ABC", None, "s", 1), (3, "Dup", "en", "s", 2), (3, "Dup", "en", "s", 2), (9, None, "zz", None, None), (10, "", "yy", "q", 0), (12, "LONE " * 50_000, "é", "q", 0)]


@pytest.mark.parametrize("run", [20_000, 50, 7])
def test_manifest_equals_brute_force(spark, sf_dir, run):
    many = [(i, f"T {i}", "en", "s", 3) for i in range(1000, 1700)] + [(i, f"T {i}", f"l{i % 11}", "s", 3) for i in range(40)]
    docs = docs_of(spark, MANIFEST + many).repartition(5)
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.translate("text", licenses.UPPER, licenses.LOWER))
    assert collections.Counter(tuple(r) for r in merkle.manifest(docs, changed, run).collect()) == brute_manifest(docs.select(*merkle.FIELDS).collect())


def test_manifests_of_one_row_and_of_none(spark):
    one = merkle.manifest(docs_of(spark, [(5, "Only", "en", "s", 1)])).first()
    assert one.leaf == one.subroot == one.root == one.folded and one.proof == h("")
    assert merkle.manifest(docs_of(spark, [(5, "Only", "en", "s", 1)]).limit(0)).count() == 0


@pytest.mark.parametrize(("start", "n", "total"), [(0, 1, 1), (0, 64, 64), (0, 65, 65), (3, 61, 100), (8, 8, 17), (16, 1, 17), (9, 500, 4097)])
def test_mountains_give_whole_nodes_and_leave_the_rest_open(start, n, total):
    levels = tree([str(k) for k in range(total)])
    found = list(merkle.mountains(levels[0][start : start + n], start, total))
    assert len({x[:2] for x in found}) == len(found)
    for level, index, node, still in found:
        assert node == levels[level][index]
        own = range(index // 8 * 8 * 8**level, min((index // 8 + 1) * 8 * 8**level, total))
        assert still == (len(levels[level]) > 1 and not (own[0] >= start and own[-1] < start + n))
    inside = {(k, i) for k in range(1, len(levels)) for i in range(len(levels[k])) if i * 8**k >= start and min((i + 1) * 8**k, total) <= start + n}
    assert inside == {x[:2] for x in found if x[0]}


# ---- prefix tries

TALKS = "conv_id long, turn long, role string, text string, name string, depth long, node long, size long"


def talks_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TALKS)


def brute_trie(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [x[3:] for x in sorted(own)] for c, own in by.items()}
    new = {c: turns.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + turns[c][zlib.crc32(str(c).encode()) % 6 :] for c in turns}
    members = collections.defaultdict(list)
    for c, own in new.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, own in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(own) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not children[k]
    ends = lambda k: ",".join(str(c) for c in sorted(members[k]) if len(new[c]) == len(k))
    return collections.Counter((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k], h(ends(k))) for k, v in members.items())


TALKED = [(100_000 + i * 7, t, "user", f"same {t}") for i in range(60) for t in range(i % 5)] + [(200_000 + i, t, "u", f"long {t % 3}") for i, n in ((0, 500), (1, 450)) for t in range(n)]
TALKED += [(300_105, 0, "u", "x"), (None, 0, "u", "x"), (300_300, None, None, None), (300_300, None, None, None), (300_301, 1, None, ""), (300_301, None, "", ""), (300_400, 0, "é", "long 𝔘 " * 20_000), (300_401, 0, "é", "long 𝔘 " * 20_000)]
TALKED += [(400_001 + 2 * k, 0, "u", f"y{k % 2}") for k in range(700)]


@pytest.mark.parametrize("ids", [512, 3])
def test_trie_equals_brute_force(spark, sf_dir, monkeypatch, ids):
    monkeypatch.setattr(trie, "IDS", ids)
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows = TALKED + given
    got = collections.Counter(tuple(r) for r in trie.prefix_trie(talks_of(spark, rows).repartition(5)).collect())
    assert got == brute_trie(rows)


def test_tries_without_turns_or_conversations(spark):
    talks = talks_of(spark, [(105, 0, "u", "x"), (None, 1, "u", "y")])  # crc32 of 105 takes more turns than there are
    assert trie.spliced and [tuple(r) for r in trie.prefix_trie(talks).collect()] == list(brute_trie([(105, 0, "u", "x")]))
    assert trie.prefix_trie(talks.limit(0)).count() == 0
