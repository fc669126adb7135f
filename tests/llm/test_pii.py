import hashlib
import random
import re

from quern.llm import pii

KINDS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(t):
    out = []
    for k, p in enumerate(KINDS):
        for m in p.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns():
    r = random.Random(0)
    for _ in range(30_000):
        t = "".join(r.choice(["a", "B", "1", "@", ".", "-", "+", " ", "(", "é", "_", "4111 1111 1111 1111", "+1 (499) 555-6503", "1.2.3.4", "a@b.c", "300.1.1.1"]) for _ in range(r.randrange(14)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("x" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []  # in linear time


def test_digest_of_odd_rows(frame, odd):
    rows = [*odd, (50, "é mail a.b@c.de, 1.2.3.4 or +44 20 7946 0958 4111-1111-1111-1111")]
    got = pii.digest(pii.detect(frame(rows))).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            want = plain(text[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(pii.text_form(want).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
    assert pii.digest(pii.detect(frame([]))).count() == 0


def _corpus():
    filler = ["the", "and", "with", "from", "that", "some"]
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(filler) for _ in range(40))) for i in range(60)]
    rows += [(100 + i, f"the zorblatt and quimby wrote with jane.doe@mail.org from that {'some ' * i}") for i in range(3)]
    return rows + [(200, "the quimby was there"), (201, "quimby and that")]


def test_disclosing_terms(frame):
    found = {r.doc_id: r for r in pii.detect(frame(_corpus())).collect()}
    kinds = {_corpus()[60][1][s["start"] : s["end"]]: pii.KINDS[s["kind"]] for s in found[100].spans}
    n, e, t = 65, 3, 5
    import math

    share = math.log(3 * n / (e * t)) / math.log(n / e)
    assert kinds["jane.doe@mail.org"] == "email" and kinds["zorblatt"] == "removed" and "the" not in kinds
    assert kinds.get("quimby") == ("removed" if share >= pii.REMOVE else "generalised" if share >= pii.GENERALISE else None)
    assert found[200].spans == [] and found[0].spans == []  # nothing to protect there


def test_disclosing_terms_far_from_the_entity(frame):
    heading = "jane.doe@mail.org " + "some " * 30
    rows = [*_corpus(), (110, heading + "zorblatt with zorblatt"), (111, "write to other@mail.org " + "some " * 30 + "zorblatt"), *((400 + i, "and with from that") for i in range(200)), (112, "é " * 9 + heading + "Zorblatt")]
    found = {r.doc_id: r for r in pii.detect(frame(rows)).collect()}
    text = dict(rows)
    terms = {i: [text[i][s["start"] : s["end"]] for s in found[i].spans if s["kind"] > 3 and s["start"] in (m.start() for m in re.finditer("(?i)zorblatt", text[i]))] for i in (100, 110, 111, 112)}
    assert terms[100] == ["zorblatt"] and terms[110] == ["zorblatt"] * 2 and terms[112] == ["Zorblatt"]
    assert terms[111] == []  # another entity's document
    out = {r.doc_id: r.text.lower() for r in pii.sanitise(frame(rows)).collect()}
    assert all("zorblatt" not in out[i] for i in (100, 110, 112)) and "zorblatt" in out[111]


def test_sanitise(frame):
    docs = frame([*_corpus(), (300, None), (301, "")])
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "jane" not in out[100].text and "zorblatt" not in out[100].text and "[EMAIL]" in out[100].text
    assert out[200].text == "the quimby was there" and out[300].text is None and out[301].text == ""
    assert out[100].spans == "spans" and pii.sanitise(docs).columns == docs.columns


def test_term_frequencies(frame):
    from quern.llm.arrays import TextBatch

    got = {r.t: r.df for r in pii.term_frequencies(frame([(1, "Abc abc ÄB"), (2, "abc xy"), (3, None)])).collect()}
    start, end, _, h = pii.terms(TextBatch(["abc äb"], lower=True))
    assert got[int(h[0])] == 2 and len(got) == 2


def test_disclosure_by_brute_force(frame):
    """Shares and spans over a random corpus, document by document."""
    import math
    from collections import Counter

    r = random.Random(11)
    pool, names = [f"w{i}" for i in range(40)] + ["x", "of", "Zorb", "éa"], [f"p{i}@mail.org" for i in range(8)]
    rows = []
    for i in range(160):
        words = [r.choice(pool) for _ in range(r.randrange(3, 40))]
        for _ in range(r.choice([0, 0, 1, 2])):
            who = r.randrange(8)
            words.insert(r.randrange(len(words) + 1), names[who])
            if r.random() < 0.7:
                words.insert(r.randrange(len(words) + 1), f"only{who}")
        rows.append((i, " ".join(words)))
    rows.append((999, None))
    term = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holds, near, df = Counter(), Counter(), Counter()
    long_enough = lambda m: len(m[0].encode()) >= pii.MIN_TERM
    free = {}
    for i, t in rows:
        t = t or ""
        spans = plain(t)
        df.update({m[0] for m in term.finditer(t.translate(low)) if long_enough(m)})
        free[i] = [m for m in term.finditer(t.translate(low)) if long_enough(m) and all(m.end() <= s or m.start() >= e for s, _, e in spans)]
        pairs = set()
        for s, _, e in spans:
            left, right = [m[0] for m in free[i] if m.end() <= s], [m[0] for m in free[i] if m.start() >= e]
            pairs.update((t[s:e], w) for w in left[-pii.REACH :] + right[: pii.REACH])
        holds.update({t[s:e] for s, _, e in spans})
        near.update(pairs)
    n, judged = len(rows), {}
    for (e, w), c in near.items():
        if c >= pii.SUPPORT and pii.SUPPORT <= holds[e] < n:
            share = math.log(c * n / (holds[e] * df[w])) / math.log(n / holds[e])
            if share >= pii.GENERALISE:
                judged[e, w] = 5 if share >= pii.REMOVE else 4
    got = {x.doc_id: x for x in pii.detect(frame(rows)).collect()}
    kinds = set()
    for i, t in rows:
        t = t or ""
        here = {t[s:e] for s, _, e in plain(t)}
        want = sorted([*plain(t), *((m.start(), k, m.end()) for m in free[i] if (k := max((judged.get((e, m[0]), 0) for e in here), default=0)))])
        assert [(s["start"], s["kind"], s["end"]) for s in got[i].spans] == want, i
        kinds.update(k for _, k, _ in want)
    assert kinds >= {0, 4, 5} or kinds >= {0, 5}
