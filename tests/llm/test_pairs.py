"""Operators that relate texts to each other, against plain versions on small data."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import decontam, links, neardup, repeats
from eventloom.llm.texts import distinct_texts

DOCS = "doc_id long, text string"


def words(text):
    return (text or "").encode().split()


def made_up(seed, n, vocabulary, longest, copies):
    """Random texts, near copies of them, and the awkward cases."""
    pick = random.Random(seed)
    texts = [" ".join(pick.choice(vocabulary) for _ in range(pick.randint(1, longest))) for _ in range(n)]
    for _ in range(copies):
        text = pick.choice(texts).split()
        text[pick.randrange(len(text))] = "changed"
        texts.append("  ".join(text))
    texts += [None, "", " \n\t", texts[0], texts[0].upper(), "one", "One", "é ñ é ñ", "x " * 3000]
    return list(enumerate(texts))


def components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[root(i)].append(doc_id)
    smallest = {r: min((x for x in own if x is not None), default=None) for r, own in ids.items()}
    return sorted(((doc_id, len(sets[i]), smallest[root(i)]) for i, (doc_id, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [neardup.BLOCK, 1])
def test_near_duplicates(spark, monkeypatch, block):
    """Also with blocks of single members."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    pick = random.Random(3)
    base = [str(pick.randrange(10**6)) for _ in range(120)]
    chain = []
    for _ in range(40):  # each a little further from the last
        base = list(base)
        base[pick.randrange(120)] = str(pick.randrange(10**6))
        chain.append(" ".join(base))
    rows = made_up(1, 120, ["the", "of", *map(str, range(4000))], 90, 120)
    rows += [(1000 + i, t) for i, t in enumerate(chain)] + [rows[3], rows[3], (5, "another text under a known id"), (None, rows[8][1])]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{DOCS}, node string, label int")
    got = neardup.near_duplicates(docs, 4, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(docs.limit(0), 4, 80).collect() == []


def tasks_of(spark, job):
    """The result of ``job`` and how many tasks it ran."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    try:
        out = job()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    tracker = context.statusTracker()
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("counted") for s in tracker.getJobInfo(j).stageIds]
    return out, sum(i.numCompletedTasks for i in infos if i)


def test_few_links_take_few_tasks_in_many_partitions(spark):
    """Rounds over a few rows do not start a task for each shuffle partition."""
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
        got, tasks = tasks_of(spark, lambda: sorted(map(tuple, links.components(chain).collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]
    assert tasks < 400


def test_components_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(links, "LABELS", 0)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert sorted(map(tuple, links.components(chain).collect())) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]
    assert links.components(chain.limit(0)).collect() == []


def test_equal_rows_are_compared_once(spark, monkeypatch):
    confirmed = neardup._Comparison.confirmed
    seen = []

    def counting(self, pairs):
        seen.append(pairs.join(self.texts.select(F.col("node").alias("a")), "a").join(self.texts.select(F.col("node").alias("b")), "b").count())
        return confirmed(self, pairs)

    monkeypatch.setattr(neardup._Comparison, "confirmed", counting)
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text)] * 80 + [(7, text.replace("w50", "other"))] * 80 + [(8, "something else altogether here")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 80).collect()
    assert sorted({(r.doc_id, r.component_id) for r in got}, key=str) == [(7, 7), (8, 8), (None, 7)] and len(got) == 161
    assert sum(seen) == 1


def test_texts_with_a_common_passage_leave_few_pairs(spark, monkeypatch):
    """Pairs just below the threshold are told apart within their blocks; links are kept."""
    apart, seen = neardup._apart, []

    def counting(*args):
        pairs = apart(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "_apart", counting)
    passage = [f"p{i}" for i in range(115)]
    for n in (40, 80):
        # 112 shingles of the passage and 17 own ones: a similarity of 0.767 for each pair.
        rows = [(i, " ".join(passage + [f"t{i}w{k}" for k in range(17)])) for i in range(n)]
        rows += [(n + i, rows[i][1].replace(f"t{i}w9", "other")) for i in range(0, n, 8)]
        rows += [(9000 + i, " ".join([f"q{k}" for k in range(115)] + [f"u{i}w{k}" for k in range(14)])) for i in range(2)]  # just 80 %
        got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 80).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows, 4, 80)
        assert seen.pop() < n


def test_parities_never_lose_a_link():
    import numpy as np

    from eventloom.llm.sketches import differing, parities
    from eventloom.llm.words import mix

    pick = random.Random(11)
    values = mix(np.arange(1, 5001, dtype=np.uint64))
    sets = []
    for n in (1, 2, 9, 16, 17, 31, 40, 63, 65, 128, 260, 1000, 4000):
        sets.append(values[:n])
        for _ in range(6):  # near the threshold, and on other places
            shift, more = pick.randrange(n // 9 + 2), pick.randrange(n // 9 + 2)
            sets.append(values[shift : n + more])
    sets = [np.sort(x) for x in [*sets, values[:0]]]
    rows = parities(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert all(4 * len(x) <= 8 * len(row) <= max(64, 8 * len(x)) for x, row in zip(sets, rows, strict=True))
    i, j = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    found = differing(rows, rows, i, j)
    assert (found <= apart).all() and (found[i == j] == 0).all()
    close = (apart > 0) & (apart <= 30) & (np.array([len(x) for x in sets])[i] > 200)
    assert close.any() and (found[close] >= 0.8 * apart[close]).all()


def test_equal_rows_add_no_spans(spark):
    """5,000 equal rows are one text: no more spans than for one of them."""
    text = " ".join(f"w{i}" for i in range(400))
    found = [
        repeats.repeated_windows(distinct_texts(spark.createDataFrame([(None, text)] * n + [(1, f"x {text}")], DOCS))).count() for n in (1, 5000)
    ]
    assert found[0] == found[1]
    out = repeats.without_repeats(spark.createDataFrame([(None, text)] * 5000, DOCS))
    assert [tuple(r) for r in out.groupBy("n_words", "n_removed").count().collect()] == [(400, 400, 5000)]


def test_registers_merge_and_estimate():
    import numpy as np

    from eventloom.llm.sketches import merged, plausible, sketch
    from eventloom.llm.words import mix

    values = mix(np.arange(1, 3001, dtype=np.uint64))
    a, b, union = (sketch(x, np.array([0, len(x)])) for x in (values[:2000], values[1000:], values))
    assert (merged(a, b) == union).all()
    assert 0.2 < (a == b).mean() < 0.5  # a third in common
    assert not plausible(a, b, np.array([2000]), np.array([2000]), 0.8, 12.5)[0]
    close = sketch(values[:1850], np.array([0, 1850]))
    assert plausible(a, close, np.array([2000]), np.array([1850]), 0.8, 12.5)[0]
    one = sketch(values[:1], np.array([0, 1]))
    assert (one > 0).all()


def without_repeats(rows, length):
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = {p for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for p in range(i, i + length)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "seed"), [(6, 3), (9, 9), (35, 12)])
def test_repeats(spark, length, seed):
    rows = made_up(length, 60, ["a", "b", "c", "d", *map(str, range(30))], 120, 40)
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(500, f"left {passage} right"), (501, f"{passage} end {passage}"), (None, passage), rows[2], (2, "another text")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{DOCS}, spans string, text_key int")
    got = repeats.without_repeats(docs, length, seed).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == without_repeats(rows, length)
    assert all(sum(x.stop - x.start for x in r.repeats) == r.n_removed for r in got)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.without_repeats(docs.limit(0), length, seed).collect() == []


def cut(text):
    import regex

    own = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    return regex.findall(rf"[{own}]|(?:(?![{own}])[\p{{L}}\p{{M}}\p{{N}}])+", (text or "").lower())


def overlaps(docs, items):
    """The 80 % rule at every alignment, without masks."""
    out = {}
    items = [(i, w) for i, w in ((i, cut(t)) for i, t in items) if len(w) >= 5]
    for doc_id, text in docs:
        doc = cut(text)
        places = defaultdict(list)
        for i, token in enumerate(doc):
            places[token].append(i)
        for item_id, item in items:
            shared = Counter(i - k for k, token in enumerate(item) for i in places[token])
            span = min(13, len(item))
            for begin in (b for b, n in shared.items() if 100 * n >= 80 * span):
                equal = [0 <= begin + k < len(doc) and doc[begin + k] == item[k] for k in range(len(item))]
                if any(100 * sum(equal[s : s + span]) >= 80 * span for s in range(len(item) - span + 1)):
                    key = (doc_id, item_id)
                    out[key] = (len(item), max(sum(equal), out.get(key, (0, 0))[1]))
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_overlaps(spark, monkeypatch):
    pick = random.Random(8)
    draw = lambda n: [pick.choice("abcdefghij") + str(pick.randrange(60)) for _ in range(n)]
    items = [(i, " ".join(draw(pick.randint(14, 40)))) for i in range(12)]
    items += [(20, "Six tokens make this Item up"), (21, "too few tokens"), (22, None), (23, ""), (None, items[1][1])]
    docs = []
    for i in range(40):
        text = draw(pick.randint(0, 60))
        passage = items[pick.randrange(12)][1].split()
        for _ in range(pick.randrange(6)):
            passage[pick.randrange(len(passage))] = "other"
        passage = passage[: pick.randint(8, len(passage))]
        at = pick.randint(0, len(text))
        docs.append((i, ", ".join(text[:at] + passage + text[at:])))
    items += [(30, "数学の問題を解く"), (31, "one two three four five six seven")]
    docs += [(90, None), (91, ""), (92, "say six TOKENS, make this item up!"), (93, "too few tokens"), (None, items[0][1]), docs[0]]
    docs += [(94, "この数学の問題を解いた"), (95, "two three four five six seven"), (96, "so one two three NEW five six seven"), (97, "one two new four new six seven")]
    frames = [
        spark.createDataFrame([(*r, "clash") for r in docs], f"{DOCS}, item_id string"),
        spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string"),
    ]
    want = overlaps(docs, items)
    assert len(want) > 20
    for seeds in (decontam.SEEDS_PER_BLOCK, 100):  # also in several passes
        monkeypatch.setattr(decontam, "SEEDS_PER_BLOCK", seeds)
        assert sorted(map(tuple, decontam.overlaps(*frames).collect()), key=str) == want
    assert decontam.overlaps(frames[0].limit(0), frames[1]).collect() == []
    assert decontam.overlaps(frames[0], frames[1].limit(0)).collect() == []


def accepted(docs, items):
    """The 80 % rule at every alignment, without masks and without counting first."""
    out = {}
    for doc_id, doc in docs:
        for item_id, item in items:
            span = min(13, len(item))
            for begin in range(1 - len(item), len(doc)):
                equal = [0 <= begin + k < len(doc) and doc[begin + k] == token for k, token in enumerate(item)]
                if any(100 * sum(equal[s : s + span]) >= 80 * span for s in range(len(item) - span + 1)):
                    key = (doc_id, item_id)
                    out[key] = (len(item), max(sum(equal), out.get(key, (0, 0))[1]))
    return sorted((*k, *v) for k, v in out.items())


def test_every_accepted_overlap_is_met(spark):
    from itertools import combinations

    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 20)]
    docs = []
    for n, item in items:
        # Substitutions at all places: all that the rule accepts, and one more for items of up to twelve tokens.
        for places in combinations(range(min(n, 13)), {5: 2, 6: 2, 7: 2, 8: 2, 9: 2}.get(n, 3 if n < 13 else 2)):
            for left in range(len(places) + 1):
                text = ["other" if k in places[left:] else t for k, t in enumerate(item[:13])]
                docs.append((len(docs), ["before"] * (left % 2) + text))
        docs.append((len(docs), item[-11:]))
        docs.append((len(docs), item[2:]))
    got = decontam.overlaps(
        spark.createDataFrame([(i, " ".join(t)) for i, t in docs], DOCS), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    )
    assert sorted(map(tuple, got.collect())) == accepted(docs, items)


def test_overlap_time_is_linear_in_the_text(spark):
    """Two long texts, the second four times the first; also that a passage deep inside is found."""
    import time

    pick = random.Random(4)
    word = lambda: pick.choice("abcdefghij") + str(pick.randrange(5000))
    item = " ".join(word() for _ in range(20))
    took = []
    for n in (100_000, 400_000):
        text = " ".join(word() for _ in range(n)) + f" {item}"
        frame = spark.createDataFrame([(1, text)], DOCS)
        benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
        decontam.overlaps(frame.limit(0), benchmark).collect()
        began = time.monotonic()
        assert [tuple(r) for r in decontam.overlaps(frame, benchmark).collect()] == [(1, 5, 20, 20)]
        took.append(time.monotonic() - began)
    assert took[1] < 8 * took[0] + 5


def test_components_of_a_long_chain(spark):
    from eventloom.llm.links import components as connected

    links = [(i, i + 1) for i in range(200) if i != 100] + [(500, 7), (500, 7)]
    got = connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {i: 0 if i <= 100 or i == 500 else 101 for i in [*range(202 - 1), 500]}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
