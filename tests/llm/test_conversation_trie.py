import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from trimline.llm import conversation_trie, oracle, queries
from verification import compare

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, owner string, depth int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c >= 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in children[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(8)
    rows = []
    for c in range(140):
        for t in range(rng.randint(0, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "hot turn", "c  d\te", "", None])))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(3)]  # copies
    rows += [(300, t, "user", f"long {t % 7}") for t in range(600)]  # a path
    rows += [(301 + k, t, "user", f"long {t % 7}") for k in range(4) for t in range(100 * k)]
    rows += [(-7, 1, "user", "x"), (-20, 1, "user", "y"), (-39, 0, "u", "x y"), (None, 1, "user", "z"), (10**15, 1, "u", "w " * 5000)]
    rows += [(400, 1, "user", "again")] * 30 + [(401, None, None, None)] * 3
    return rows


def _got(spark, rows, **options):
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = conversation_trie.prefix_trie(given, **options)
    assert found.columns == NAMES
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("small", [256, 5])
def test_equals_brute_force(spark, small):
    rows = _rows()
    assert _got(spark, rows, small=small) == _brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "a")], [(3, 1, "user", "a b")], [(3, 1, "user", "a"), (3, 2, "user", "a")], [(c, None, None, None) for c in range(41)]])
def test_tiny_tables(spark, rows):
    assert _got(spark, rows, small=1) == (_brute(rows) if any(r[0] is not None for r in rows) else [])


def test_query_equals_its_sql(spark):
    con = compare.connect(SF_DIR)
    columns, got = compare.spark_rows(queries.op13_conversation_trie(spark, SF_DIR))
    names, expected = compare.oracle_rows(con, oracle.ORACLES["op13_conversation_trie"])
    assert (columns, got) == (names, expected) and len(got) > 300
