"""Operators 11 to 13 against brute force, on rows that hold every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_repair, spelling_variants, suffix_tree
from millrace.llm.common import WHITE, importable

SCHEMA = "doc_id long, text string, n long, word string, form string, id long, keys string, block int"


def sentence(rng, n, letters="abcde"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    copied = [sentence(rng, 60) for _ in range(4)]
    texts = [None, "", " \n\t ", "one", "One ONE one É é", "x" * 3000, sentence(rng, 4000), "a  b\n\n c\td", "héé🎉 日本語 \x1c\x85\xa0 wörd wörds", *copied * 6]
    texts += [sentence(rng, 20) + " " + copied[k % 4] + " " + sentence(rng, 20, "fgh") for k in range(30)]
    out = [(i, t, None, "w", None, 1, "k", i) for i, t in enumerate(texts)]
    return [*out, out[12], out[12], (None, copied[0], 1, None, None, None, None, None), (None, None, 1, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_model(rows, depth, support, gain, strength):
    """The suffix tree by dictionaries over tuples of words."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None]) for d, t, *_ in rows]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    train = [w for d, w in docs if not held(d)]
    n = [Counter(tuple(w[i - k : i + 1]) for w in train for i in range(k, len(w))) for k in range(depth + 1)]
    total, words = sum(n[0].values()), len(n[0])
    followers = [Counter(g[:-1] for g in n[k]) for k in range(depth + 1)]
    kept = {}

    def p(w, i, most, out=0):
        value = (n[0][w[i],] - out + 0.1) / (total - out + 0.1 * (words + 1))
        for k in range(1, most + 1):
            ctx = tuple(w[i - k : i])
            if i >= k and kept.get(ctx):
                weight = followers[k][ctx] + strength
                value = (n[k][ctx + (w[i],)] - out + weight * value) / (n[k - 1][ctx] - out + weight)
        return value

    for k in range(1, depth + 1):
        gains, once = defaultdict(float), Counter()
        for w in train:
            for i in range(k, len(w)):
                ctx, c = tuple(w[i - k : i]), n[k][tuple(w[i - k : i + 1])]
                if n[k - 1][ctx] >= support:
                    once[ctx] += c == 1
                    if c > 1:
                        gains[ctx] += math.log((c - 1) / p(w, i, k - 1, 1))
        level = {}
        for ctx, m in n[k - 1].items():
            if None not in ctx and m >= support:
                t = followers[k][ctx]
                left = max(t - 1, 0) + strength
                d = gains[ctx] - (m - once[ctx]) * math.log(m - 1 + t + strength) + once[ctx] * math.log(left / (m - 1 + left))
                level[ctx] = d >= gain
        kept.update(level)
    return [(d, held(d), len(w), sum(n[0][x,] > 0 for x in w), total, sum(math.log10(p(w, i, 0)) for i in range(len(w))), sum(math.log10(p(w, i, depth)) for i in range(len(w)))) for d, w in docs], kept


def test_suffix_tree_equals_brute_force(spark, docs, rows, monkeypatch):
    want, kept = plain_model(rows, suffix_tree.DEPTH, suffix_tree.SUPPORT, suffix_tree.GAIN, suffix_tree.STRENGTH)
    assert any(len(c) == 1 for c, v in kept.items() if v) and any(len(c) == 2 for c, v in kept.items() if v) and not all(kept.values())
    monkeypatch.setattr(suffix_tree, "BLOCK", 700)  # many blocks and buckets
    monkeypatch.setattr(suffix_tree, "BUCKET", 500)
    got = importable(lambda s: suffix_tree.score(docs))(spark).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])  # held-out rows that share passages are told better than by single words


def test_suffix_tree_probabilities_sum_to_one(rows):
    own = np.array([3, 1, 4, 1, 5], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row = suffix_tree._block(0, [1, 2], [False, False], [own, own[:3]]).to_pylist()[0]
    block = suffix_tree.Block(row)
    assert len(block.vocab) == 5 and block.back.tolist() == [0, 1, 2, 3, 4, 5, 0, 1, 2, 3] and block.ends.tolist() == [6, 10]
    block.known = np.bincount(block.tokens).astype(float)
    p = block.probabilities(10, 5, 0)
    each = {int(t): v for t, v in zip(block.tokens, p, strict=True)}
    assert math.isclose(sum(each.values()) + 0.1 / (10 + 0.1 * 6), 1.0)


def test_distinct_keys_also_where_first_bits_agree():
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 50, 3000, dtype=np.uint64), np.array([7], np.uint64), np.arange(2000, dtype=np.uint64)[::-1].copy()):
        a, b = suffix_tree._distinct(keys), np.unique(keys, return_inverse=True)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def plain_words(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            m = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{m}".encode())
            if h % 97 == 0:
                m = m[: h % len(m)] + m[h % len(m) + 1 :]
            n[m] += len(m) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def plain_variants(words):
    near = lambda a, b: (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))
    out, form = {}, {}
    for w in words:
        found = [x for x in words if x != w and near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
        out[w] = len(found)
    rooted = {}
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        rooted[w] = r
    return {w: (form[w], rooted[w], words[w], out[w], words[form[w]] if form[w] else None) for w in words}


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abÀÿé×") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    rows = []
    for k in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(base[: rng.choice([3, 20, 60])])
            if rng.random() < 0.4:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abz") + w[i:], w[:i] + rng.choice("abz") + w[i + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((k if k % 50 else None, rng.choice([" ", "-", "1", "日"]).join(words), 1, "w", None, 2, "k", 3))
    rows += [(900 + k, "aaaaaa aaaaa aaaaaaa " + "y" * 20_000 + " " + "y" * 19_999, 1, None, None, None, None, None) for k in range(5)] + [(1, None, 1, None, None, None, None, None), (2, "", 1, None, None, None, None, None)] * 2
    rows += [(2000 + k, "mmmnnn " + "mmmmnn " * (k < 9) + "mmmmmn" * (k < 4), 1, None, None, None, None, None) for k in range(24)]  # a chain of forms
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.word: tuple(r)[1:] for r in importable(lambda s: spelling_variants.group(df))(spark).collect()}
    want = plain_variants(plain_words(rows))
    assert got == want and any(v[0] for v in want.values()) and any(v[1] != v[0] and v[0] for v in want.values())


def test_deletion_keys_are_those_of_strings_and_collisions_make_no_pair():
    words = ["abcde", "abcd", "abdde", "ÿÿÿÿÿ", "ÿÿÿÿ"]
    key, word, at = spelling_variants.deletion_keys(words)
    of = defaultdict(set)
    for k, w, i in zip(key.tolist(), word.tolist(), at.tolist(), strict=True):
        of[k].add(words[w] if i < 0 else words[w][:i] + words[w][i + 1 :])
    assert all(len(v) == 1 for v in of.values()) and len(of) == len(set().union(*of.values()))
    import pyarrow as pa

    forged = pa.record_batch({"key": [5, 5, 5], "at": pa.array([2, 2, -1], pa.int32()), "id": [1, 2, 3], "word": ["abcde", "vwxyz", "hello"], "n": [3, 9, 4]})
    assert list(spelling_variants._taken(iter([forged]))) == []


def plain_repair(rows):
    """All edit scripts by a table over rows and states: conv -> the result's row."""
    out, groups = {}, defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t, r, x))
    for c, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, r, x in own:
            faults.append("b" if not x.strip(WHITE) else "d" if (r, x) in seen else "" if x.rstrip(WHITE)[-1] in ".!?" else "t")
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        best = {0: (0, "", ())}

        def inserted(best):
            todo = list(best)
            while todo:
                q = todo.pop(0)
                cost, audit, lines = best[q]
                to, role = (3, "assistant") if q == 2 else (2, "user")
                new = (cost + 2, audit + "I", (*lines, f"{role}:"))
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
                    todo.append(to)
            return best

        best = inserted(best)
        for (_, r, x), fault in zip(own, faults, strict=True):
            new: dict = {}

            def put(q, v, new=new):
                if q not in new or v[:2] < new[q][:2]:
                    new[q] = v

            for q, (cost, audit, lines) in best.items():
                put(q, (cost + 3, audit + "D", lines))
                if fault in ("b", "d"):
                    continue
                more = cost + (fault == "t")
                if r[:1] in conversation_repair.NEXT[q]:
                    put(conversation_repair.NEXT[q][r[:1]], (more, audit + "K", (*lines, f"{r}:{x}")))
                to, role = (3, "assistant") if q == 2 else (2, "user")
                put(to, (more + 2, audit + "R", (*lines, f"{role}:{x}")))
            best = inserted(new)
        cost, audit, lines = min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain_damage(rows):
    some = lambda v: " " if v is None else v
    for c, t, r, x in rows:
        kind, r, x = zlib.crc32(f"{some(c)}:{some(t)}".encode()) % 20, some(r), some(x)
        if kind:
            yield from [(c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)] * (2 if kind == 3 else 1)


@pytest.mark.parametrize("segment", [4096, 5])
def test_conversation_repair_equals_brute_force(spark, segment):
    rng = random.Random(segment)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "uncle"], ["a.", "b", "c!", " ", "", None, "d. x", "e?\n", " "]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in [*range(150), None] for _ in range(rng.randint(1, 9))]
    rows += [(1000, rng.choice([None, *range(200)]), rng.choice(roles), rng.choice([*texts, *map(str, range(99))])) for _ in range(250)] + [(1001, 5, "user", "x")] * 40 + [(1002, k, "user", "y.") for k in range(50)] + [(1003, 0, "system", "s.")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, audit string, seg int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in importable(lambda s: conversation_repair.repaired(df, segment))(spark).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = plain_repair(plain_damage(rows))
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}


def test_repair_of_given_cases(spark):
    turns = lambda c, *said: [(c, k, r, x) for k, (r, x) in enumerate(said)]
    rows = turns(1, ("system", "s."), ("user", "u."), ("assistant", "a.")) + turns(2, ("user", "u."), ("user", "v.")) + turns(3, ("assistant", "a.")) + turns(4, ("user", " ")) + turns(5, ("system", "s."))
    got = {r.conv_id: (r.cost, r.audit) for r in importable(lambda s: conversation_repair.repair(s.createDataFrame(rows, "conv_id long, turn long, role string, text string")))(spark).collect()}
    assert got == {1: (0, "KKK"), 2: (2, "KR"), 3: (2, "IK"), 4: (3, "D"), 5: (3, "D")}


@pytest.mark.parametrize("run", [suffix_tree.score, spelling_variants.group, lambda d: conversation_repair.repaired(d.selectExpr("doc_id conv_id", "n turn", "word role", "text"))])
def test_empty_tables(spark, run):
    assert importable(lambda s: run(s.createDataFrame([], SCHEMA)))(spark).count() == 0


def test_scores_do_not_depend_on_partitions(spark, docs):
    ask = lambda d: {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in importable(lambda s: suffix_tree.score(d))(spark).collect()}
    assert ask(docs) == ask(docs.repartition(1, F.col("text")))
