import hashlib
import random
import re

import pytest

from lanewright.llm import pii

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]
TEXTS = [
    "a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0255 256.1.1.1 0.0.0.00000", "4111 1111 1111 1111 and 4111-1111-1111-1112 0", "+1 (017) 555-7713) +12 +1234567890123456 ++1 555 555 5555.",
    "é@é.com ñ a.b%c+d@x-y.z.q. 00000000000000 ünï 5500 0000 0000 0004", "9" * 5000, "a." * 3000 + "@" + "b." * 3000 + "c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "😀 joe@x.org 😀 10.0.0.1", "@" * 2000 + "a@b.c",
    " ".join(f"u{k}@h{k}.net" for k in range(700)),
]


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def base(text):
    spans = [(m.start(), no, m.end(), kind) for no, (kind, p) in enumerate(BASE) for m in p.finditer(text or "") if valid(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


def check(df, rows):
    got = sorted(((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in df.collect()))
    want = []
    for i, t in rows:
        b = base(t)
        want.append((i or -1, *(sum(x.startswith(k + ":") for x in b) for k in pii.KINDS), hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert got == sorted(want)
    texts = dict(rows)
    for r in df.collect():
        have = r.spans.split(",") if r.spans else []
        assert set(base(texts.get(r.doc_id))) <= set(have) and len(have) == r.n_spans and have == sorted(have, key=lambda s: (int(s.split(":")[1]), pii.MORE_KINDS.index(s.split(":")[0])))


def test_base_spans(spark):
    rows = list(enumerate(TEXTS, 1))
    check(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_documents(documents):
    check(pii.personal_data(documents), [tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_edge_rows(edge, edge_rows):
    got = sorted((r.doc_id or -1, r.base_sha256) for r in pii.personal_data(edge).collect())
    assert got == sorted((i or -1, hashlib.sha256(",".join(base(t)).encode()).hexdigest()) for i, t in edge_rows)


def test_added_spans(spark):
    text = "Mr. John Smith called. Mail bob [at] mail [dot] com; phone: 555-123-4567, ssn 123-45-6789"
    plain = ["order 123-456-7890 of version 20.10.3 at $ 12345678", "he met her at noon on a dot of red"]
    rows = [(k, t) for k, t in enumerate([text, *plain] + ["call +1 (555) 555-0100 now"] * 5)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[0].split(",")]
    assert "bob [at] mail [dot] com" in found and "123-45-6789" in found
    assert got[1] == "" and got[2] == ""


def planted(seed=11, copies=60):
    """Texts with spans of every kind that only the method can add, half of them
    after a cue, and texts with things that look alike; the spans; those with a cue."""
    rng = random.Random(seed)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    figures, small, mixed = "0123456789", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: draw(small, rng.randint(2, 9))
    real = {
        "email": lambda: ("write to ", f"{word()} [at] {word()} [dot] {rng.choice(['com', 'org', 'de', 'nl'])}"),
        "phone": lambda: (rng.choice(["phone ", "call me on ", "tel "]), f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"),
        "ssn": lambda: (rng.choice(["ssn ", "social security number "]), f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
        "name": lambda: (rng.choice(["dear ", "signed by "]), f"{rng.choice(['Mr', 'Mrs', 'Dr'])}. {rng.choice(['John', 'Maria', 'Pierre', 'Ursula', 'Kofi'])} {word().capitalize()}"),
        "secret": lambda: (rng.choice(["token = ", 'password: "', "api key "]), rng.choice([lambda: draw("0123456789abcdef", 40), lambda: "ghp_" + draw(mixed, 36), lambda: "AKIA" + draw("ABCDEFGHJKLMNPQR234567", 15) + "7"])()),
    }
    alike = [
        lambda: f"order {draw(figures, 9)}", lambda: f"isbn 978-{draw(figures, 1)}-{draw(figures, 4)}-{draw(figures, 4)}-1", lambda: f"version {rng.randint(1, 40)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}",
        lambda: f"invoice {draw(figures, 3)}-{draw(figures, 3)}-{draw(figures, 4)}", lambda: f"$ {draw('123456789', 8)}", lambda: f"commit {draw('0123456789abcdef', 39)}7",
        lambda: f"{word()}ing-{word()}ing-{word()}ed-2023-{word()}s", lambda: f"he looked at {word()} dot {word()}", lambda: f"{draw('123456789', 8)} kg", lambda: f"https://a.b/{word()}/{word()}s2/{word()}ing",
    ]
    rows, want, cued = [], [], set()
    for k in range(copies * (len(real) + len(alike))):
        text = " ".join(word() for _ in range(12)) + " "
        kind = list(real)[k % (len(real) + len(alike))] if k % (len(real) + len(alike)) < len(real) else None
        if kind:
            cue, found = real[kind]()
            helped = rng.random() < 0.5
            text += cue if helped else word() + " "
            want.append((k, kind, len(text), len(text) + len(found)))
            cued |= {want[-1]} if helped else set()
            text += found
        else:
            text += alike[k % (len(real) + len(alike)) - len(real)]()
        rows.append((k, text + rng.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(8))))
    return rows, set(want), cued


@pytest.mark.parametrize("seed", [11, 12])
def test_added_spans_precision_and_recall(spark, seed):
    """With a cue nearly all are found; without one those that other labelers tell."""
    rows, want, cued = planted(seed)
    got = {(r.doc_id, *s.split(":")) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans.split(",") if s}
    got = {(d, kind, int(a), int(b)) for d, kind, a, b in got}
    count = lambda spans, kind: sum(x[1] == kind for x in spans)
    figures = {kind: [count(x, kind) for x in (want & got, want, cued & got, cued, got)] for kind in ("email", "phone", "name", "ssn", "secret")}
    print("kind: found, planted, found with cue, planted with cue, given", figures)
    assert len(cued & got) >= 0.95 * len(cued), figures
    assert len(want & got) >= 0.8 * len(want), figures
    assert len(want & got) >= 0.95 * len(got), figures


def test_labelers_are_told_apart():
    """A labeler that votes at random gets less weight than two that agree."""
    rows = [(0, (1, 1, 1, 0), 300), (0, (1, 1, -1, 0), 300), (0, (-1, -1, 1, 0), 300), (0, (-1, -1, -1, 0), 300)]
    trust, share = pii.reliabilities(rows)
    assert trust[0, 1, 2] > 0.9 and trust[0, 0, 2] < 0.1 and abs(trust[2, 1, 2] - trust[2, 0, 2]) < 0.1
    assert share[0] == pytest.approx(0.5, abs=0.05)


def test_nothing(empty):
    assert pii.personal_data(empty).count() == 0
