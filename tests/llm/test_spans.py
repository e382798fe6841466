"""Operators on spans of bytes, turns and words, against plain versions on small data."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from eventloom.llm import periods, suffixes, turns

DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- op11 ---------------------------------------------------------------------


def plain_bytes(rows, length):
    """Rows in the operator's order: by doc_id (null last); equal ids have equal texts here."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        spans = sum(1 for p in gone if p - 1 not in gone)
        out.append((doc_id, len(data), len(gone), spans, sha(bytes(b for p, b in enumerate(data) if p not in gone))))
    return sorted(out, key=str)


def some_texts(seed, longest, n=60):
    pick = random.Random(seed)
    letters = "ab" * 3 + "cdé𝄞 \n"
    passage = ["".join(pick.choice(letters) for _ in range(longest)) for _ in range(3)]
    texts = []
    for _ in range(n):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, longest)))
        if pick.random() < 0.6:
            own = pick.choice(passage)
            a, b = sorted(pick.randrange(len(own)) for _ in range(2))
            text += own[a:b] + text[:5] + own[: b - a]
        texts.append(text)
    return texts


@pytest.mark.parametrize(("length", "seed", "blocks"), [(12, 4, (4, 1)), (30, 5, (16, 8, 2, 1)), (100, 20, suffixes.BLOCKS)])
def test_repeated_bytes(spark, monkeypatch, length, seed, blocks):
    monkeypatch.setattr(suffixes, "BLOCKS", blocks)
    texts = some_texts(length, 3 * length) + [None, "", "short", "ab" * 4 * length, "a" * 5 * length]
    rows = list(enumerate(texts)) + [(1000, texts[4]), (1001, texts[4] + "x"), (1001, texts[4] + "x"), (None, texts[7]), (None, texts[7])]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], f"{DOCS}, core string, place int, copies int")
    got = suffixes.without_repeats(docs, length, seed).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == plain_bytes(rows, length)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 and sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)
    assert suffixes.without_repeats(docs.limit(0), length, seed).collect() == []


def test_long_and_hot_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "AT_ONCE", 700)  # a long text in several pieces
    pick = random.Random(5)
    passage = "".join(chr(pick.randrange(33, 127)) for _ in range(900))
    long_text = "".join(chr(pick.randrange(33, 127)) for _ in range(2500)) + passage + "".join(chr(pick.randrange(33, 127)) for _ in range(1500))
    rows = [(i, f"{pick.random()} {passage} {pick.random()}") for i in range(300)] + [(400 + i, "same " * 60) for i in range(200)]
    rows += [(-1, long_text), (700, long_text[1000:4500])] + [(800, "again and again " * 20)] * 500
    docs = spark.createDataFrame(rows, DOCS)
    got = suffixes.without_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == plain_bytes(rows, 100)


# -- op12 ---------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_repair(rows):
    """Cheapest edits by trying every edit in every state, turn after turn."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    blank = duplicate = truncated = illegal = 0
    seen, kinds = set(), []
    for _, role, text in rows:
        words = text.encode().split()
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1:] not in (b".", b"!", b"?") else ""
        blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
        seen.add((role, text))
        kinds.append((role[:1], fault))
    for (a, _), (b, _) in zip(kinds, kinds[1:]):
        illegal += a + b not in ("su", "ua", "au")

    def with_inserts(states):
        for _ in range(3):
            for last, (cost, audit, made) in list(states.items()):
                for role in ("user", "assistant"):
                    to = FOLLOWS.get((last, role[0]))
                    if to:
                        new = (cost + 5, audit + "I", [*made, f"{role}:"])
                        states[to] = min(states.get(to, new), new)
        return states

    states = with_inserts({"": (0, "", [])})
    for (_, role, text), (initial, fault) in zip(rows, kinds):
        after = {}

        def put(to, state, after=after):
            if to is not None:
                after[to] = min(after.get(to, state), state)

        more = 5 if fault == "truncated" else 0
        for last, (cost, audit, made) in states.items():
            put(last, (cost + 2, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                put(FOLLOWS.get((last, initial)), (cost + more, audit + "K", [*made, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    put(FOLLOWS.get((last, other[0])), (cost + more + 1, audit + "R", [*made, f"{other}:{text}"]))
        states = with_inserts(after)
    cost, audit, made = min(states[s] for s in ("", "a") if s in states)
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, sha("\n".join(made))


def some_turns(seed, n, longest):
    pick = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(pick.randint(1, longest)):
            role = pick.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "umpire"])
            text = pick.choice(["Yes.", "No!", "cut off", " \n", "", None, "Why?\t ", f"{pick.random()}.", "é. x"])
            rows.append((conv if conv else None, pick.choice([turn, turn, turn, None, 2 * turn, -turn]), role, text))
            if pick.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize(("block", "fan"), [(turns.BLOCK, turns.FAN), (3, 2)])
def test_conversation_repair(spark, monkeypatch, block, fan):
    monkeypatch.setattr(turns, "BLOCK", block)
    monkeypatch.setattr(turns, "FAN", fan)
    rows = some_turns(7, 150, 9) + some_turns(8, 2, 60)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{TURNS}, audit string, row_no int")
    found = turns.repairs(frame)
    hashes = {r.conv_id: r.repaired_sha256 for r in turns.digests(turns.repaired(frame, found)).collect()}
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    got = {r.conv_id: (*(r[c] for c in columns), hashes.get(r.conv_id, sha(""))) for r in found.collect()}
    by_conv = {}
    for conv, *rest in rows:
        by_conv.setdefault(conv, []).append(rest)
    assert got == {conv: plain_repair(own) for conv, own in by_conv.items()}
    kept = turns.repaired(frame, found).orderBy("conv_id", "place").collect()
    assert all(r.role[:1] in "sua" for r in kept)
    assert turns.repairs(frame.limit(0)).collect() == []
    assert turns.repaired(frame.limit(0), found.limit(0)).collect() == []


def test_cells_do_not_depend_on_the_split():
    """The cell made from halves is that of the full parse triangle, in which every split is tried."""
    pick = random.Random(3)
    for _ in range(60):
        kinds = "".join(pick.choice("suaoSUAOx") for _ in range(pick.randint(1, 9)))
        n = len(kinds)
        chart = {(i, i + 1): turns.turn_cell(kinds[i]) for i in range(n)}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                cells = [turns.combined(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
                chart[i, i + size] = tuple(min((c for c in options if c is not None), default=None) for options in zip(*cells))
        assert chart[0, n] == turns.cell_of(kinds)


def test_planted_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = sorted(map(tuple, turns.damaged(spark.createDataFrame(rows, TURNS)).collect()), key=str)
    want = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        if fault:
            text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
            want += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    assert got == sorted(want, key=str)


# -- op13 ---------------------------------------------------------------------


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                own = words[i : i + size]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(doc_id, text):
    words = (text or "").encode().split()
    runs = plain_runs(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    gone = {p for start, length, period in runs for p in range(start + period, start + length)}
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines), sha(kept))


def test_periodic_runs(spark):
    pick = random.Random(11)
    texts = []
    for _ in range(250):
        words = [pick.choice("abcd"[: pick.randint(1, 4)]) for _ in range(pick.randint(0, 70))]
        if words and pick.random() < 0.5:
            a = pick.randrange(len(words))
            p = pick.randint(1, 1 + (len(words) - a) // 3)
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
        texts.append(pick.choice([" ", "\n", " \t "]).join(words))
    texts += [None, "", " \n", "x " * 5, "x " * 6, "é ü " * 4, "a b c " * 4, "a b c " * 3 + "a b", texts[0], " ".join(map(str, range(50))), "p q " * 30_000]
    rows = list(enumerate(texts)) + [(None, texts[3]), (5, texts[9]), (5, texts[9])]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{DOCS}, runs string, period int")
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = periods.periodic_runs(docs).collect()
    long_one = next(i for i, t in rows if t and len(t) > 100_000)
    want = [plain_collapse(i, t) for i, t in rows if i != long_one]
    assert sorted((tuple(r[n] for n in names) for r in got if r.doc_id != long_one), key=str) == sorted(want, key=str)
    assert [(r.n_runs, r.start, r.length, r.period, r.collapsed_text) for r in got if r.doc_id == long_one] == [(1, 0, 60_000, 2, "p q")]
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def test_splitting_changes_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    for rounds in (0, 1, 64):
        monkeypatch.setattr(periods, "ROUNDS", rounds)
        for _ in range(40):
            ids = rng.integers(0, rng.integers(1, 40), rng.integers(1, 300))
            got = periods.scan(ids, periods.split(ids, np.zeros(len(ids), np.int64), 4, 6), 4, 6)
            assert list(zip(*(x.tolist() for x in got))) == plain_runs(ids.tolist())


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(200)] + [(None, "a b"), (3, None)]
    frame = spark.createDataFrame(rows, DOCS)
    got = frame.select("doc_id", periods.planted(frame.doc_id, frame.text).alias("text")).collect()
    want = []
    for doc_id, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
        want.append((doc_id, text))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
