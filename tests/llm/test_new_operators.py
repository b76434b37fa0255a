"""Periodic runs, conversation repair and SimHash components against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortide.llm import components as comp
from cohortide.llm import conversation_repair as repair
from cohortide.llm import periodic_runs, queries as llm, simhash_vp

FOLDER = "/root/testdata/sf0.001"
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ------------------------------------------------------------------------------

def brute_runs(w, least=24, periods=3):
    found = {}
    for q in range(1, len(w) // periods + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        i = 0
        while i < len(same):
            if same[i]:
                j = same.index(False, i)
                if j - i + q >= max(least, periods * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def run_texts():
    rng = random.Random(7)
    out = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a b " * 12, "A b c " * 400]
    fibonacci = ["a", "a b"]
    for _ in range(11):
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    out.append(fibonacci[-1])
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    out.append(" ".join(thue))
    for _ in range(90):
        unit = [rng.choice("abcdeü") + str(rng.randrange(3)) for _ in range(rng.randint(1, 40))]
        body = (unit * rng.randint(1, 12))[:rng.randint(1, 400)]
        for _ in range(rng.randint(0, 2)):
            body[rng.randrange(len(body))] = "x"
        out.append("\n".join(map(" ".join, [body[:50], body[50:], body[:70]])))
    return out + out[20:40] + [" ".join(f"w{i}" for i in range(3000)) + " u v w x y z" * 500]


def check_runs(got, doc_id, text, own):
    w = PLAIN.findall(text or "")
    w = [w[i] for i in own(doc_id, len(w))]
    runs = brute_runs(w)
    keep = [True] * len(w)
    for s, k, q in runs:
        keep[s + q:s + k] = [False] * (k - q)
    assert got.n_runs == len(runs)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    assert (got.start, got.length, got.period) == best
    assert got.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert got.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
    assert got.collapsed_sha256 == sha(" ".join(x for x, k in zip(w, keep) if k))
    return len(runs)


def brute_planted(doc_id, n):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return range(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [i if i < a else a + (i - a) % p for i in range(n)]


def test_periodic_runs(spark):
    texts = run_texts()
    rows = [(d, t, 1) for d, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    found = periodic_runs.periodic_runs(docs)
    got = {r.doc_id: r for r in periodic_runs.digest(found).collect()}
    total = sum(check_runs(got[d], d, t, lambda _, n: range(n)) for d, t in enumerate(texts))
    assert total > 100 and len(got) == len(texts)
    whole = {r.doc_id: r for r in found.collect()}
    assert whole[7].runs[0].asDict() == {"start": 0, "length": 1200, "period": 3}
    assert whole[7].collapsed_text == "A b c"
    planted = periodic_runs.digest(periodic_runs.periodic_runs(docs, reorder=periodic_runs.planted))
    for r in planted.collect():
        check_runs(r, r.doc_id, texts[r.doc_id], brute_planted)


def test_periodic_runs_of_odd_tables(spark):
    schema = "doc_id long, text string, runs string, best double"
    rows = [(5, "a b " * 30, "clash", 0.0)] * 3 + [(None, "a b " * 30, None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = periodic_runs.digest(periodic_runs.periodic_runs(docs)).collect()
    assert sorted((r.doc_id is None, r.n_runs) for r in got) == [(False, 1)] * 3 + [(True, 0), (True, 1)]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    # A text longer than a slice: 10 MB of a period of 300 words.
    long = " ".join(f"w{i}" for i in range(300)) + " "
    docs = spark.createDataFrame([(1, long * 7500)], "doc_id long, text string")
    r = periodic_runs.digest(periodic_runs.periodic_runs(docs)).head()
    assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 300 * 7500, 300)


def test_planted_runs_of_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = llm.queries()["op11_periodic_runs"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    assert sum(check_runs(r, r.doc_id, texts[r.doc_id], brute_planted) for r in rows
               if len(texts[r.doc_id] or "") < 20000) > 5


def test_prefix_hashes_do_not_decide_alone():
    # Words of two values in the order of Thue and Morse collide in polynomials modulo 2**64.
    order = [0]
    for _ in range(11):
        order += [1 - x for x in order]
    words = np.array([3, 5], np.uint64)[order + order[::-1] + order]
    repeats = periodic_runs.Repeats(words)
    for i, j in ((0, 2048), (2048, 4096), (100, 2148)):
        q, n = j - i, len(words)
        low, high = repeats.extents(*(np.array([x]) for x in (i, j, 0, n)))
        lo, hi = repeats.exact(i, j, 0, n, int(low[0]), int(high[0]))
        same = [words[k] == words[k + q] for k in range(n - q)]
        start = next((k + 1 for k in range(i - 1, -1, -1) if not same[k]), 0)
        end = next((k + q for k in range(i, n - q) if not same[k]), n)
        assert (lo, hi) == (start, end)


# --- conversation repair ------------------------------------------------------------------------

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_repair(rows):
    """Lightest (cost, audit, lines) by trying every order of edits, in Bellman's manner."""
    turned = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ())}

    def inserts(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                to = turned[state][0]
                new = (cost + 2, audit + "I", lines + (f"{turned[state]}:",))
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    for role, text, must_go, truncated in rows:
        after = {}
        for state, (cost, audit, lines) in inserts(best).items():
            ways = [(state, cost + 3, "D", lines)]
            if not must_go:
                to = NEXT.get((state, role[:1]))
                if to:
                    ways.append((to, cost + truncated, "K", lines + (f"{role}:{text}",)))
                want = turned[state]
                ways.append((want[0], cost + 2 + truncated, "R", lines + (f"{want}:{text}",)))
            for to, c, e, kept in ways:
                new = (c, audit + e, kept)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    best = inserts(best)
    return min(best[g] for g in ("", "a") if g in best)


def brute_digest(conversations):
    """Expected rows by conversation of (conv_id, turn, role, text)."""
    kept = {}
    for conv, turn, role, text in conversations:
        own = kept.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, typed = set(), [0, 0, 0], []
        for _, role, text in rows:
            core = text.strip(" \t\n\x0b\x0c\r")
            blank, again, cut = not core, (role, text) in seen, bool(core) and core[-1] not in ".!?"
            seen.add((role, text))
            if blank or again or cut:
                faults[0 if blank else 1 if again else 2] += 1
            typed.append((role, text, blank or again, int(cut)))
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, lines = brute_repair(typed)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults,
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)))
    return out


def conversations():
    rng = random.Random(11)
    out = []
    for conv in [None, *range(120)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None])
            text = rng.choice(["Hi.", "So?\n ", "What", " \t", "", None, "Yes! é", "a b.", f"Long {turn}."])
            out.append((conv, rng.choice([turn, turn, turn, 3, None, 40]), role, text))
    out += [(500, i, ("user", "assistant")[i % 2], f"Turn {i // 3}" + "." * (i % 5 > 0)) for i in range(700)]
    return out + [(501, None, "user", "Same.")] * 40 + [(600, None, None, None)]


@pytest.mark.parametrize("held", [4096, 16])
def test_conversation_repair(spark, monkeypatch, held):
    monkeypatch.setattr(repair, "HELD", held)
    rows = conversations()
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int"
                                  ).repartition(5)
    got = repair.repair_all(table, repair.damage(table), held=held).collect()
    want = brute_digest(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    assert repair.repair_all(table.limit(0), repair.damage(table.limit(0))).count() == 0


def test_conversations_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = llm.queries()["op12_conversation_repair"](spark, "/root/testdata/sf0.01").collect()
    want = brute_digest(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_all_rows_damaged_away(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(7, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair_all(table, repair.damage(table)).collect()] == [
        (7, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_agenda_equals_every_edit_script():
    for kinds in product([0, 1, 2, 3, 5, 10], repeat=3):
        rows = [("suat"[k % 4], "", k & 4, k >> 3) for k in kinds]
        cost, audit, _ = brute_repair(rows)
        assert repair.lightest(bytes(kinds)) == (cost, audit)
    rng = random.Random(2)
    kinds = bytes(rng.randrange(16) for _ in range(9000))
    cost, audit, _ = brute_repair([("suat"[k % 4], "", k & 4, k >> 3) for k in kinds])
    assert repair.lightest(kinds) == (cost, audit)


def test_repaired_turns(spark):
    table = spark.createDataFrame(
        [(1, 0, "assistant", "Hello."), (1, 1, "user", "Who are you?"), (1, 2, "user", "Tell"), (2, 0, "user", "Hm.")],
        "conv_id long, turn long, role string, text string")
    found = repair.repair(table)
    turns = repair.repaired_turns(table, found).orderBy("conv_id", "number").collect()
    lines = {}
    for r in turns:
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all("".join(line[0] for line in own).replace("ua", "") == "" for own in lines.values())
    assert {r.conv_id: r.repaired_sha256 for r in found.collect()} == {c: sha("\n".join(own)) for c, own in lines.items()}


# --- SimHash ------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """Smallest key reachable of each key over links of at most two differing bits."""
    by, low = {}, {}
    for d, f in prints.items():
        by.setdefault(f, []).append(d)
    todo = set(by)
    while todo:
        group, queue = [], [todo.pop()]
        while queue:
            x = queue.pop()
            group.append(x)
            near = {y for y in todo if bin(x ^ y).count("1") <= 2}
            todo -= near
            queue += near
        least = min(min(by[f]) for f in group)
        low.update({d: least for f in group for d in by[f]})
    return low


def near_texts():
    rng = random.Random(4)
    out = [None, "", "\n ", "one", "Two words", "ONE"]
    for _ in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(40, 300))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            own[rng.randrange(len(own))] = "Changed"
            out += [" ".join(own), "\t".join(own).upper()]
    return out


@pytest.mark.parametrize("shard, leaf", [(4096, 512), (24, 5)])
def test_simhash_components(spark, shard, leaf):
    texts = dict(enumerate(near_texts()))
    rows = [(d, t, "x") for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(4)
    got = {r.doc_id: r for r in simhash_vp.near_components(docs, shard=shard, leaf=leaf).collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in prints.items()}
    want = brute_classes(prints)
    assert {d: r.component_id for d, r in got.items()} == want
    assert len(set(want.values())) < len(set(prints.values()))


def test_simhash_of_odd_tables(spark):
    docs = spark.createDataFrame([(3, "a b c d")] * 3 + [(None, "a b c d"), (None, "only here now"), (9, None)],
                                 "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in simhash_vp.near_components(docs).select("doc_id", "component_id").collect())))
    assert got == sorted(map(str, [(3, 3)] * 3 + [(None, 3), (None, None), (9, 9)]))
    assert simhash_vp.near_components(docs.limit(0)).count() == 0


def test_vantage_points_lose_no_link():
    rng = np.random.default_rng(5)
    near = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = [rng.integers(0, 1 << 63, 2000, dtype=np.uint64)]
    for c in near:  # clusters whose members differ in few bits
        bits = rng.integers(0, 64, (60, 3)).astype(np.uint64)
        x.append(c ^ (np.uint64(1) << bits[:, 0]) ^ (np.uint64(1) << bits[:, 1]) ^ (np.uint64(1) << bits[:, 2]))
    x = np.unique(np.concatenate(x))
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 2, 1))
    node, root = comp.stars(a, b)
    want = dict(zip(x[node].tolist(), root.tolist()))
    tree = simhash_vp.grow(x[::3], 8, 1, np.random.default_rng(1))
    parts = simhash_vp.route(tree, x, 1)
    assert len(parts) > 20
    links = [simhash_vp.near_pairs(x[p], 2, 1, 4, np.random.default_rng(2)) for p in parts]
    a, b = (np.concatenate([part[k] for part in links]).view(np.uint64) for k in (0, 1))
    assert (np.bitwise_count(a ^ b) > 0).all()
    node, root = comp.stars(np.searchsorted(x, a), np.searchsorted(x, b))
    assert dict(zip(x[node].tolist(), root.tolist())) == want


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(comp, "LINKS_PER_TASK", held)
    rng = random.Random(9)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(50)] + [(k, k + 1) for k in range(200, 260)]
    want = {}
    a, b = np.array(links).T
    for node, root in zip(*comp.stars(*(x[a != b] for x in (a, b)))):
        want[int(node)] = int(root)
    edges = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert {r.node: r.root for r in comp.components(edges).collect()} == want
    assert all(want[x] == want[y] for x, y in links if x != y)
    assert comp.components(edges.limit(0)).count() == 0
