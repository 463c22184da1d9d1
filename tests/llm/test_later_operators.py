"""Fingerprints, phrases and conversation repair against brute-force versions, on the small tables and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tessera.llm import digests, phrases, queries, repair

AWKWARD = [
    None, "", " ", "\n\n\t", "a", "word " * 3, "word " * 300, "x" * 3000, "Σ ΑΣ É İ ǅ", "same text", "same text", "a b c d e f g " * 12,
    "tab\tand\r\nlines \x0b\x0c end  ", "１２ ½ 日本語 🙂🙂" * 9, "A.b,C;d:e!f?g\nh", "\x00 \x1c\x85 　", "z z z z z z z z z z z z z z z",
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Awkward texts, with columns whose names could clash, null ids and a repeated row."""
    rows = [(i, t, "en" if i % 2 else None, i, i, "p", 1, "w") for i, t in enumerate(AWKWARD)]
    schema = "doc_id long, text string, lang string, id long, part long, path string, n long, w1 string"
    return spark.createDataFrame([*rows, rows[9], (None, "no id here", "fr", None, None, None, None, None), (None, None, "fr", None, None, None, None, None)], schema).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Fingerprints


def slow_class(window):
    most = round(len(window) * math.log2(len(window)) * 65536) if len(window) > 1 else 0
    total = sum(round(c * math.log2(c) * 65536) for c in Counter(window).values())
    return (most - total) * 1000 // (64 * 6 * 65536 + 1)


def slow_windows(data):
    w = min(64, len(data))
    return [data[i : i + w] for i in range(len(data) - w + 1)] if data else []


def slow_ranks(texts):
    counts = Counter(slow_class(w) for t in texts for w in slow_windows((t or "").encode()))
    order = sorted(range(1000), key=lambda c: (c < 100, counts[c], c))
    return {c: i for i, c in enumerate(order)}


def slow_digest(data, ranks):
    windows = slow_windows(data)
    rank = [ranks[slow_class(w)] for w in windows]
    points = Counter()
    for begin in range(-63, len(windows)) if windows else ():
        near = [(rank[i], i) for i in range(max(begin, 0), min(begin + 64, len(windows)))]
        points[min(near)[1]] += 1
    found = list(dict.fromkeys(xxhash.xxh3_64_intdigest(windows[i]) for i in sorted(points) if points[i] >= 16))
    chain = []
    for at in range(0, len(found), 160):
        bits = {h >> 11 * k & 2047 for h in found[at : at + 160] for k in range(5)}
        chain.append(int("".join("1" if i in bits else "0" for i in range(2048)), 2))
    return chain


def slow_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    a, b = sorted((a, b), key=lambda c: (len(c), sum(x.bit_count() for x in c), c))
    total = 0.0
    for x in a:
        shares = [0.0]
        for y in b:
            p, q, common = x.bit_count(), y.bit_count(), (x & y).bit_count()
            chance = p * q / 2048
            if common > chance + 3 * math.sqrt(chance * (1 - p / 2048) * (1 - q / 2048)):
                shares.append((common - chance) / (min(p, q) - chance))
        total += max(shares) * x.bit_count()
    return min(1.0, total / sum(x.bit_count() for x in a))


def slow_rows(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0))
    ranks, rows = slow_ranks([t for _, t in rows]), sorted(((i, t or "") for i, t in rows), key=key)
    out = []
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        own, changed, theirs = (slow_digest(t.encode(), ranks) for t in (text, new, other))
        hexed = lambda c: "".join(f"{x:0512x}" for x in c)
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), hexed(own), hexed(changed), round(slow_likeness(own, changed), 4), round(slow_likeness(own, theirs), 4)))
    return out


def fast_rows(df):
    got = digests.compared(df, digests.rarity(df)).collect()
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 4), round(r.near_next, 4)) for r in got]


def test_fingerprints_equal_brute_force(spark, documents, awkward):
    some = documents.where("n_chars < 3000").orderBy("doc_id").limit(40)
    odd = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    for df in (some.repartition(5), some.limit(1), odd):
        assert sorted(fast_rows(df)) == sorted(slow_rows([(r.doc_id, r.text) for r in df.collect()]))


def test_fingerprints_of_awkward_rows(spark, awkward):
    rows = fast_rows(awkward)
    assert len(rows) == awkward.count()
    assert len({r[3] for r in rows if r[0] in (9, 10)}) == 1
    assert {r[3] for r in rows if r[0] in (0, 1)} == {""}
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in rows)
    assert fast_rows(awkward.where("false")) == []
    assert digests.fingerprints(awkward, digests.rarity(awkward)).columns == [*awkward.columns, "fingerprint"]


def test_fingerprints_of_long_texts_follow_what_they_share(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    base = " ".join(word() for _ in range(150_000))
    ranks = digests.rarity(spark.createDataFrame([(base,)], "text string"))
    own, other = digests.digest(base.encode(), ranks), digests.digest(" ".join(word() for _ in range(20_000)).encode(), ranks)
    assert len(own) > 50
    shifted = digests.digest(("new words ahead " + base).encode(), ranks)
    half = digests.digest((base[: len(base) // 2] + " ".join(word() for _ in range(75_000))).encode(), ranks)
    assert digests.likeness(own, shifted) > 0.7
    assert 0.35 < digests.likeness(own, half) < 0.65
    assert digests.likeness(own, other) < 0.05
    assert digests.likeness(half, own) == digests.likeness(own, half)


# Phrases


def slow_phrases(rows, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= 10]
        gone = {q for p in found if len(p) == 3 for q in (p[:2], p[1:]) if 100 * f[p] >= 50 * f[q]}
        scored = []
        for p in set(found) - gone:
            value, k = min((1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-value, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, phrase.decode(), -a, left, right, words[lang], -value) for i, (value, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def fast_phrases(df, **more):
    return sorted(tuple(r) for r in phrases.collocations(df, **more).collect())


def test_phrases_equal_brute_force_and_sql(spark, documents, awkward, sf_dir):
    for df in (documents, awkward, awkward.union(awkward).union(awkward).repartition(4)):
        want = slow_phrases([(r.lang, r.text) for r in df.collect()])
        assert want and fast_phrases(df) == want
    assert fast_phrases(awkward.where("false")) == []
    assert fast_phrases(documents, top=7) == slow_phrases([(r.lang, r.text) for r in documents.collect()], 7)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    assert sorted(con.execute(queries.OP12_SQL).fetchall()) == fast_phrases(documents)


def test_phrases_along_long_paths_circles_and_flushes(spark, monkeypatch):
    """A passage that compacts to one path, in rows of a few edges; a circle of unary nodes; hubs; counts that tasks hand on early."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [("x", passage)] * 12 + [("x", "a b c d " * 20)] * 3 + [("x", " ".join(f"w{rng.randrange(12)}" for _ in range(2000)))]
    rows += [("y", "hub " + f"v{i % 9} t{i % 9}") for i in range(200)] + [("x", "big " * 30 + ". " + passage)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = slow_phrases(rows)
    assert fast_phrases(df) == want
    monkeypatch.setattr(phrases, "LONGEST_PATH", 7)
    monkeypatch.setattr(phrases, "WORDS", 500)
    monkeypatch.setattr(phrases, "PART", 40)
    assert fast_phrases(df) == want
    held = [phrases.Counts(), phrases.Counts()]
    for counts in held:
        counts.add(("a b c. " * 50 + passage).encode())
    usual = [b.to_pylist() for b in held[0].rows("x")]
    monkeypatch.setattr(phrases, "VOCABULARY", 10)
    assert usual and [b.to_pylist() for b in held[1].rows("x")] == usual


def test_compacted_paths(spark):
    """The path of a passage is one row; its edges and flows are the graph's."""
    df = spark.createDataFrame([("x", " ".join(f"p{i}" for i in range(100)))] * 10, "lang string, text string")
    (row,) = phrases.paths(phrases.nodes_and_edges(phrases.flows(df))[1]).collect()
    assert row.words == [f"p{i}" for i in range(100)] and set(row.ns) == {10} and len(row.flows) == 98


# Conversation repair


def slow_repair(rows):
    """rows: (conv, turn, role, text). A conversation is repaired by the least (cost, letters) from each place and state."""
    text_of = lambda v: " " if v is None else str(v)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = by[conv]
        role, text = text_of(role), text_of(text)
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in kept if t is not None]
        faults, seen = [], set()
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        starts = [role[:1] for _, role, _ in kept]
        n, made = len(kept), {"": "u", "s": "u", "u": "a", "a": "u"}
        best = [dict.fromkeys(made) for _ in range(n + 1)]
        for i in range(n, -1, -1):
            for _ in range(3):
                for q in made:
                    ways = [(0, "")] if i == n and q in ("", "a") else []
                    if best[i][made[q]]:
                        ways.append((5 + best[i][made[q]][0], "I" + best[i][made[q]][1]))
                    if i < n:
                        more = 5 * (faults[i] == "t")
                        after = lambda cost, letter, to, i=i: [(cost + best[i + 1][to][0], letter + best[i + 1][to][1])] if best[i + 1][to] else []
                        ways += after(2, "D", q)
                        if faults[i] not in ("b", "d"):
                            ways += after(1 + more, "R", made[q])
                            if (q, starts[i]) in legal:
                                ways += after(more, "K", legal[q, starts[i]])
                    best[i][q] = min(ways, default=None)
        cost, audit = best[0][""]
        lines, q, i = [], "", 0
        for letter in audit:
            q = q if letter == "D" else legal[q, starts[i]] if letter == "K" else made[q]
            name = {"u": "user", "a": "assistant"}.get(q)
            if letter == "I":
                lines.append(f"{name}:")
            else:
                lines += [] if letter == "D" else [f"{kept[i][1] if letter == 'K' else name}:{kept[i][2]}"]
                i += 1
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


CONVERSATION = "conv_id long, turn long, role string, text string, conv long, position long, code string"


def made_up(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            said = rng.choice(["yes.", "no!", "cut off", " \t", "", "well? ", f"line {rng.randrange(50)}.", None])
            rows.append((c, rng.choice([t, t, t, t, t - 1, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), said))
    return rows + rows[:5] + [(None, 1, "user", "who."), (None, 2, "assistant", "me."), (None, None, None, None)]


def fast_repair(df):
    return sorted((tuple(r) for r in repair.repair(df).collect()), key=repr)


def test_repair_equals_brute_force(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert fast_repair(real) == slow_repair([(r.conv_id, r.turn, r.role, r.text) for r in real.collect()])
    rows = made_up(1, 120, 14)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CONVERSATION).repartition(3)
    assert fast_repair(df) == slow_repair(rows)
    assert fast_repair(df.where("false")) == []


def test_repair_of_conversations_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 5)
    rows = made_up(3, 9, 90)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CONVERSATION).repartition(3)
    assert fast_repair(df) == slow_repair(rows)


def test_auction_of_a_long_chunk():
    """Thousands of rows through one lattice cost what halves cost that meet at the best state."""
    rng = random.Random(4)
    codes = "".join(chr(65 + rng.choice([0, 1, 2, 2, 3, 3]) + 4 * rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(3000))
    cost, audit = repair.repaired(codes)
    prices = repair.boundary_prices([repair.distances(codes[:1300]), repair.distances(codes[1300:])])
    assert prices[0][0] == cost and len(audit.replace("I", "")) == 3000
    assert np.all(np.array(prices[-1]) == [0, 10, 5, 0])
