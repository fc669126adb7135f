import random
import re

from pyspark.sql import functions as F

from quern.llm import jaccard_join as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(frame, rows):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.components(frame(rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_odd_rows(frame, odd):
    check(frame, [*odd, (40, "One Two"), (41, "one  two\n"), (42, "one two three"), (43, "LONELY text of a row without an id")])


def test_chains_and_groups(frame):
    r = random.Random(9)
    rows, n = [], 0
    for _ in range(6):  # groups of near copies of which many are linked by way of others only
        base = [f"w{r.randrange(500)}" for _ in range(r.randrange(8, 60))]
        for _ in range(r.randrange(2, 25)):
            text = list(base)
            for _ in range(r.randrange(0, 4)):
                text[r.randrange(len(text))] = f"v{r.randrange(9999)}"
            rows.append((n, " ".join(text)))
            n += 1
            base = text if r.random() < 0.4 else base
    passage = [f"p{i}" for i in range(60)]
    for i in range(40):  # a shared passage that is not enough to link
        rows.append((n + i, " ".join([*passage, *(f"q{i}_{j}" for j in range(r.randrange(10, 60)))])))
    check(frame, rows)


def test_threshold_is_exact(frame):
    a = [f"a{i}" for i in range(11)]  # 7 shingles, of which an edit of the last word changes one: 6 / 8
    rows = [(1, " ".join(a)), (2, " ".join([*a[:-1], "z"])), (3, " ".join([*a[:-2], "y", "z"]))]
    check(frame, rows)
    assert {x[0]: x[2] for x in plain(rows)} == {1: 1, 2: 1, 3: 3}


def test_empty_table(frame):
    assert J.components(frame([])).count() == 0


def test_links_span_components(frame):
    rows = [(i, " ".join(f"w{j}" for j in range(30 + i % 2))) for i in range(6)]
    found = J.join(frame(rows))
    assert found.links.count() == 1 and found.labels.count() == 1 and found.documents.count() == 6


def test_templated_texts_and_copies_over_many_tasks(frame):
    r = random.Random(5)
    parts = [" ".join(f"t{p}_{i}" for i in range(9)) for p in range(40)]
    rows = [(i, " ".join(parts[p] for p in sorted(r.sample(range(40), 20)))) for i in range(90)]  # much shared, little linked
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # copies that meet in no task
    rows += [(2000 + i, f"{rows[3][1]} end{i}") for i in range(40)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.components(frame(rows, 16)).collect()]
    assert sorted(got) == sorted(plain(rows))


def test_blocks_of_two(frame, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 2)
    test_chains_and_groups(frame)


def test_small_batches(frame, monkeypatch):
    for name in ("TOGETHER", "SETS", "REMEMBERED"):
        monkeypatch.setattr(J, name, 3)
    test_chains_and_groups(frame)
    test_templated_texts_and_copies_over_many_tasks(frame)


def test_no_pairs_leave_a_block_of_unlike_sets(frame):
    r = random.Random(5)
    parts = [" ".join(f"t{p}_{i}" for i in range(9)) for p in range(60)]
    rows = [(i, " ".join(parts[p] for p in sorted(r.sample(range(60), 30)))) for i in range(120)]
    made = []
    inner = J._met

    def counted(percent, sketched):
        run = inner(percent, sketched)

        def counting(batches):
            for b in run(batches):
                assert not sketched, "a pair that can't link"
                yield b

        made.append(sketched)
        return counting

    J._met = counted
    try:
        assert J.components(frame(rows)).where("doc_id != component_id").count() == 0
    finally:
        J._met = inner
    assert made == [False, True]


def test_one_of_each(spark, frame, odd):
    near = [(70, "a b c d e f g h i j k l m n o p"), (71, "a b c d e f g h i j k l m n o q"), (None, "a b c d e f g h i j k l m n o r"), (71, "other words under the id seventy one"), (9, "one two"), (72, "One two")]
    docs = frame([*odd, *near]).withColumns({"_a": F.lit(1), "node": F.lit(2)})
    got = sorted(((r.doc_id, r.text) for r in J.one_of_each(docs).collect()), key=repr)
    want = {x for x in [*odd, *near] if x not in ((6, odd[6][1]), (71, near[1][1]), (None, near[2][1]), (72, "One two"))}
    assert got == sorted(want, key=repr)
    assert J.one_of_each(docs).columns == docs.columns and J.one_of_each(docs.limit(0)).count() == 0
