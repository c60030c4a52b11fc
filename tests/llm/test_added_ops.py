"""Periodic runs, conversation repair and line dedup against brute force on small, messy tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import conversation, langid, line_dedup, periodic, subword

from test_ops import documents, messy, prose

SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- periodic runs ----


def slow_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, q, e - s) for (s, e), q in out.items())


def slow_report(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = slow_runs(w)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, q, n in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(1, 8)):
            kinds, n = rng.choice([1, 2, 3, 8]), rng.choice([0, 1, 5, 6, 7, 30, 80, 200])
            w = [bytes([97 + rng.randrange(kinds)]) for _ in range(n)]
            if n > 30 and rng.random() < 0.7:
                a, p = rng.randrange(n - 20), rng.randint(1, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                w = w + w[::-1] + w if rng.random() < 0.5 else w
            texts.append(w)
        number, size = periodic._numbered(texts)
        got = periodic.runs_of(number, size)
        begin = np.cumsum(size) - size
        for b, t in zip(begin.tolist(), texts):
            own = got[(got[:, 0] >= b) & (got[:, 0] < b + len(t))]
            assert sorted((s - b, q, e - s) for s, e, q in own.tolist()) == slow_runs(t)


def test_runs_of_long_texts():
    """One word a million times, and a long period: linear, not quadratic."""
    for w, want in (([b"a"] * 500_000, [0, 500_000, 1]), ([b"%d" % k for k in range(7777)] * 40, [0, 311_080, 7777])):
        assert periodic.runs_of(*periodic._numbered([w])).tolist() == [want]


def test_periodic_query(spark):
    rng = random.Random(8)
    rows = messy() + [(k, prose(rng, rng.randint(1, 90)).replace(" ", rng.choice([" ", "\n", "\t\x0b "]))) for k in range(20, 160)]
    rows += [(200, "a b " * 50 + "x " + "y z " * 7), (201, "a b " * 50 + "x " + "y z " * 7), (202, "q " * 5), (203, "q\r" * 6)]
    got = periodic.digests(periodic.periodic_runs(documents(spark, rows), periodic.planted)).collect()
    assert sorted(repr((r[0], *r[1:])) for r in map(tuple, got)) == sorted(repr((i, *slow_report(i, t))) for i, t in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 5
    plain = {r["doc_id"]: r for r in periodic.periodic_runs(documents(spark, rows)).collect()}
    assert [tuple(x) for x in plain[200]["runs"]] == [(0, 100, 2), (101, 7, 1)] and plain[200]["collapsed"] == "a b x y z"
    assert periodic.periodic_runs(documents(spark, rows).limit(0)).isEmpty()


# ---- line dedup ----


def slow_lines(rows, least):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


def lined(seed, n=60, first=0):
    rng = random.Random(seed)
    common = [prose(rng, 3).title() for _ in range(12)] + ["K", "É"]
    return [(first + k, "\n".join(rng.choice([rng.choice(common), " \t" + rng.choice(common).upper() + "\r", prose(rng, 4), ""]) for _ in range(rng.randint(1, 12)))) for k in range(n)]


def found(df):
    return sorted(repr((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])) for r in df.collect())


def test_line_dedup(spark, tmp_path):
    rows = messy() + lined(1)
    table = documents(spark, rows)
    out = line_dedup.drop_frequent_lines(table)
    assert out.columns == [*table.columns, "n_lines", "n_dropped"]
    assert found(out) == slow_lines(rows, 10)
    assert all(r["part"] == 3 and r["z"] == 4 for r in out.collect())
    # the registered SQL says the same
    con = duckdb.connect()
    table.select("doc_id", "text").write.parquet(f"file://{tmp_path}/d.parquet")
    con.execute(f"create view documents as select * from '{tmp_path}/d.parquet/*.parquet'")
    want = sorted(repr(r) for r in con.execute(line_dedup.SQL).fetchall())
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert line_dedup.drop_frequent_lines(table.limit(0)).isEmpty()


def test_line_index_is_reversible(spark, tmp_path):
    a, b, c = messy() + lined(2, 40), lined(2, 30, 100), lined(3, 30, 200)
    table = {k: documents(spark, v) for k, v in (("a", a), ("b", b), ("c", c))}
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"), shards=3, least=6)
    index.insert(table["a"], "a")
    state = lambda: sorted(map(tuple, index.counts().collect()))
    before = state()
    index.insert(table["b"], "b")
    index.insert(table["b"], "b")  # done again
    assert index.version() == 2
    assert found(index.clean(table["a"].unionByName(table["b"]))) == slow_lines(a + b, 6)
    with pytest.raises(ValueError):
        index.delete(table["c"], "not in")
    again = line_dedup.LineIndex(spark, str(tmp_path / "index"), least=6)
    again.delete(table["b"], "b out")
    assert state() == before and again.version() == 3
    assert found(again.clean(table["a"])) == slow_lines(a, 6)
    # the filters hold the frequent keys of their shard and only as many fingerprints
    frequent = again.counts().where("n >= 6").groupBy("shard").count().collect()
    held = {r["shard"]: int((np.frombuffer(r["filter"], np.uint16) != 0).sum()) for r in again.filters().collect()}
    assert {s: n for s, n in held.items() if n} == {r["shard"]: r["count"] for r in frequent}
    again.delete(table["a"], "a out")
    assert again.counts().isEmpty() and found(again.clean(table["c"])) == sorted(repr((i, t, len(t.split("\n")), 0)) for i, t in c)


def test_filters_grow(spark, tmp_path):
    """A shard made for few keys takes many."""
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"), shards=1, least=2)
    rows = [(0, "x"), (1, "x")]
    index.insert(documents(spark, rows))
    more = [(k, "\n".join(str(v) for v in range(3000))) for k in (2, 3)]
    index.insert(documents(spark, more))
    assert found(index.clean(documents(spark, more + [(4, "2999\n3000\nx")]))) == sorted(map(repr, [(2, "", 3000, 3000), (3, "", 3000, 3000), (4, "3000", 3, 2)]))


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    f = line_dedup.Cuckoo.sized(len(keys))
    assert f.add(keys) and f.has(keys).all()
    assert f.has(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.001
    f.remove(keys[:25_000])
    assert f.has(keys[25_000:]).all() and f.has(keys[:25_000]).mean() < 0.001
    f.remove(keys[25_000:])
    assert not f.table.any()
    assert not line_dedup.Cuckoo.sized(10).add(keys)


# ---- conversations ----


def cheapest(rows):
    """Least (cost, audit) by a search over (row, state), rows: (initial, forced, truncated)."""
    best, heap = {}, [(0, "", 0, 0)]
    while heap:
        c, a, i, s = heapq.heappop(heap)
        if (i, s) in best:
            continue
        best[i, s] = (c, a)
        due, after = ("a", 3) if s == 2 else ("u", 2)
        heapq.heappush(heap, (c + 2, a + "I", i, after))
        if i < len(rows):
            initial, forced, t = rows[i]
            heapq.heappush(heap, (c + 3, a + "D", i + 1, s))
            if not forced:
                if initial == due:
                    heapq.heappush(heap, (c + t, a + "K", i + 1, after))
                if s == 0 and initial == "s":
                    heapq.heappush(heap, (c + t, a + "K", i + 1, 1))
                heapq.heappush(heap, (c + 2 + t, a + "R", i + 1, after))
    return min(best[len(rows), s] for s in (0, 3))


def slow_repair(rows, broken=True):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if broken else 9
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    if not out:
        return (0, 0, 0, 0, 0, 0, "", sha(""))
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [r[0] for r in out if r[0] is not None]
    seen, count, tokens = set(), [0, 0, 0], []
    for _, role, text in out:
        bare = text.strip(SPACE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            count[fault] += 1
        tokens.append((role[:1], fault in (0, 1), int(fault == 2)))
    cost, audit = cheapest(tokens)
    lines, i, state = [], 0, 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        due = "assistant" if state == 2 else "user"
        role, text = (due, "") if e == "I" else (out[i][1] if e == "K" else due, out[i][2])
        state = 1 if e == "K" and state == 0 and role[:1] == "s" else 2 if due == "user" else 3
        i += e != "I"
        lines.append(f"{role}:{text}")
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(tokens, tokens[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, sha("\n".join(lines)))


def talks():
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(120)]:
        n = rng.choice([1, 2, 3, 5, 8, 40])
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No", "", None, "\t\n", "Why? ", prose(rng, 5) + ".", prose(rng, 3) + "!\n"])
            at = None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 10])
            rows.append((conv, at, role, text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    rows += [(500, k, ("user", "assistant")[k % 2], f"turn {k}." if k % 7 else "again and again.") for k in range(700)]
    return rows + [(501, None, None, None), (501, None, "user", None), (502, 1, "user", "x" * 200_000 + "."), (503, 3, "assistant", "Only."), *[(504, 2, "user", "Same.")] * 9]


@pytest.mark.parametrize("limit", [conversation.BLOCK, 5])
@pytest.mark.parametrize("broken", [True, False])
def test_conversation_repair(spark, limit, broken):
    rows = talks()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    table = table.withColumns({"block": F.lit(1), "times": F.lit(2), "mark": F.lit("x"), "blank": F.lit(3), "kind": F.lit(4)})
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    got = {r[0]: tuple(r)[1:] for r in conversation.repair(table, broken, limit).collect()}
    assert got == {k: slow_repair(v, broken) for k, v in groups.items()}
    assert conversation.repair(table.limit(0), broken, limit).isEmpty()


def test_repaired_rows(spark):
    """The repaired conversations themselves, block by block."""
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "cut"), (2, 0, "system", "Be kind."), (2, 1, "user", " "), (2, 2, "assistant", "Hello!")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("times", F.lit(1).cast("long"))
    pieces = conversation.blocks(conversation.with_faults(table), limit=2)
    chosen = conversation.edits(pieces)
    made = defaultdict(list)
    for r in sorted(conversation.repaired(pieces, chosen).collect(), key=lambda r: (r["conv_id"], r["block"])):
        made[r["conv_id"]] += [tuple(e) for e in r["edits"]]
    audit = {k: cheapest(v) for k, v in ((1, [("u", False, 0), ("u", False, 0), ("a", False, 0), ("a", False, 1)]), (2, [("s", False, 0), ("u", True, 0), ("a", False, 0)]))}
    assert ["".join(e for e, _, _ in made[k]) for k in (1, 2)] == [audit[k][1].replace("D", "") for k in (1, 2)]
    assert [r for _, r, _ in made[2]] == ["system", "user", "assistant"] and made[2][1] == ("I", "user", "")


def test_earley_chart():
    """The chart against a search, and blocks put together against whole conversations."""
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "a", "u", "x", ""]), rng.random() < 0.2, int(rng.random() < 0.2)) for _ in range(rng.randint(0, 9))]
        want = cheapest(rows)
        assert conversation.least(conversation.parsed(rows))[0] == want
        column, at = {conversation.START: (0, "")}, 0
        while at < len(rows):
            stop = at + rng.randint(1, 4)
            column, _ = conversation.joined(column, {s: conversation.parsed(rows[at:stop], s) for s in conversation.KERNEL})
            at = stop
        assert not rows or conversation.least(column)[0] == want


# ---- language identification ----


def spoken(n, seed=6):
    rng = random.Random(seed)
    tongues = {"aa": "abcdeq", "bb": "defghq", "cc": "xyzqab"}
    return [(i, " ".join("".join(rng.choice(tongues[name]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 40))), name) for i, name in ((i, sorted(tongues)[i % 3]) for i in range(n))]


def test_language_scores_like_a_plain_loop():
    """Classes and calibrated scores of whole texts against means taken n-gram by n-gram."""
    rows = spoken(300)
    model = langid.fit([(t.encode(), name) for _, t, name in rows])
    texts = [t for _, t, _ in rows[:20]] + ["", "q", "12 x", "Zyx " * 300, None]

    def grams(word):
        padded = b"\0" + word.encode() + b"\0"
        for n in subword.ORDERS:
            for k in range(len(padded) - n + 1):
                h = (int.from_bytes(padded[k : k + n], "big") + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
                yield h >> 64 - subword.BITS

    got = langid.predict_texts(model, pa.array(texts))
    for text, name, score in zip(texts, *got):
        found = [g for w in re.findall(r"[0-9a-z]+", (text or "").lower()) for g in grams(w)]
        logit = np.array([sum(float(model.table[g, k]) for g in found) / max(len(found), 1) + float(model.bias[k]) for k in range(len(model.classes))])
        p = np.exp((logit - logit.max()) * model.scale)
        p /= p.sum()
        if re.search("[A-Za-z]", text or ""):
            assert name == model.classes[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-3)
        else:
            assert (name, score) == ("und", 0.0)


def test_language_columns(spark):
    """held_out is the checksum's, scores lie in 0 to 1, and what is accepted stands at the fitted level or above."""
    rows = spoken(600)
    docs = spark.createDataFrame([*rows, (700, None, "aa"), (701, "qq q", None), (None, "xyz", "cc")], "doc_id long, text string, lang string").withColumns({"held_out": F.lit(7), "accepted": F.lit(8)})
    model = langid.train_model(docs)
    assert model.scale > 0 and 0 <= model.floor <= 1
    got = langid.language(docs).collect()
    assert len(got) == 603
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "bb", "cc", "und")
    told = langid.identify(docs, model).collect()
    assert all(r["accepted"] == (r["lang_pred"] != "und" and r["score"] >= model.floor) for r in told)
    # held-out scores mean what they say: the mean score is near the share that is right
    name = {i: n for i, _, n in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in name]
    right = np.mean([r["lang_pred"] == name[r["doc_id"]] for r in held])
    assert right > 0.95 and abs(np.mean([r["score"] for r in held]) - right) < 0.1
