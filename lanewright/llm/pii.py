"""Personal data by weak supervision. DataFrame functions only.

Labelers vote on candidate spans; expectation maximisation estimates how far
each can be trusted, and a classifier trained on its beliefs decides.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = (*KINDS, "name", "ssn", "secret")
#: A candidate is added from this belief on.
CERTAIN = 0.9

# The base patterns. Possessive repeats and a look-behind that
# only starts a match at the head of a run (or where the last match ended) find
# the same matches in linear time and without deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a look.
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]+\.", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}

#: Wider patterns, of bounded length, whose matches the labelers judge.
CANDIDATES = {
    "number": r"(?<![0-9A-Za-z.@+(-])[(+]?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])",
    "written": r"(?i)[a-z0-9_+-]{1,64}+(?:\.[a-z0-9_+-]{1,64}+){0,3} ?(?:[\[({]at[\])}]| at ) ?[a-z0-9-]{1,63}(?: ?(?:[\[({]dot[\])}]| dot ) ?[a-z0-9-]{2,63}){1,4}",
    "titled": r"(?<![A-Za-z])(?:Mrs|Mr|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?",
    "secret": r"(?<![A-Za-z0-9_+/@-])(?=[A-Za-z_+/-]{0,255}[0-9])(?=[0-9_+/-]{0,255}[A-Za-z])[A-Za-z0-9_+/-]{16,256}+={0,2}(?![A-Za-z0-9@])",
}
CANDIDATE_GUARD = {
    "number": r"[0-9](?:[ ().-]{0,2}[0-9]){6}",
    "written": r"(?i)[\[({]dot[\])}]| dot ",
    "titled": r"(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z]",
    "secret": r"[0-9](?:(?=[A-Za-z_+/-])|(?<=[A-Za-z_+/-][0-9]))",
}

# Gazetteers. Common top-level domains, first names of several
# languages, and the first two digits of country calling codes ("1" and "7"
# are whole zones; the others left out are not assigned).
DOMAINS = (
    "com org net edu gov mil int info biz name pro io ai app dev co me tv eu us ca mx br ar cl pe uk ie fr de at ch li be nl lu es pt it gr mt dk se no fi is ee lv lt "
    "pl cz sk hu ro bg hr si rs ua by ru tr il ae sa eg za ng ke in pk cn hk tw jp kr sg my th vn id ph au nz"
).split()
NAMES = (
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen christopher nancy daniel lisa matthew betty "
    "anthony margaret mark sandra paul ashley steven emily andrew donna kenneth michelle george carol kevin amanda brian laura edward anna peter julia alice emma olivia noah liam lucas mia "
    "hans klaus wolfgang juergen stefan andreas monika ursula sabine petra claudia heike jean pierre michel marie jacques philippe nathalie isabelle sophie camille antoine "
    "jose maria carlos juan luis carmen ana miguel javier sofia pablo lucia diego elena giuseppe giovanni mario luigi francesca giulia paolo marco ahmed mohammed fatima omar ali wei li ming yuki hiroshi"
).split()
CALLING_CODES = r"^(?:1|7|2[0-79]|[3-6][0-9]|8[0-24-8]|9[0-9])"
SECRET_HEADS = r"^(?:AKIA|ASIA|AIza|ya29|eyJ|gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|[spr]k[-_]|npm_|hf_)"

#: Words before a span that speak for a kind, and words that speak against any.
CUES = {
    "email": r"(?i)e-?mail|contact|write to|reach",
    "ip": r"(?i)\bip\b|host|server|address|login",
    "card": r"(?i)card|visa|mastercard|amex|credit|debit",
    "phone": r"(?i)phone|\btel\b|call|mobile|fax|whatsapp|\bcell\b",
    "name": r"(?i)name|contact|dear|signed|patient|by",
    "ssn": r"(?i)ssn|social security|tax id",
    "secret": r"(?i)token|secret|passw|\bpwd\b|key|credential|bearer|auth",
}
AGAINST = r"(?i)isbn|issn|doi|version|\bv\.?$|order|invoice|serial|page|figure|build|[#$€£]\s?$|=\s?$"
AGAINST_SECRET = r"(?i)sha-?[0-9]|md5|commit|checksum|hash|digest|uuid|etag|revision|https?:|file|path"
UNITS = r"^\s?(?:%|kg|km|mm|cm|usd|eur|ms\b|mb\b|gb\b|px\b)"

LABELERS = ("shape", "gazetteer", "context", "surroundings")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once. An expression named inside
    a lambda would be worked out again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Entries of one block, where sums or searches go by blocks.
_BLOCK = 128


def _running(lengths: Column) -> Column:
    """Sums of the entries up to each one, in blocks so that long arrays cost
    little more than short ones."""
    add = lambda s, x: s + x

    def body(entries: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(entries) - 1) / _BLOCK)))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(entries, (b * _BLOCK + 1).cast("int"), F.lit(_BLOCK)), F.lit(0), add))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

        def each(ahead: Column) -> Column:
            def upto(_: Column, i: Column) -> Column:
                head = F.floor(i / _BLOCK).cast("int")
                return F.get(ahead, head) + F.aggregate(F.slice(entries, head * _BLOCK + 1, i - head * _BLOCK + 1), F.lit(0), add)

            return F.transform(entries, upto)

        return _let(before, each)

    return _let(lengths, body)


def matches(text: Column, pattern: str, guard: str) -> Column:
    """array<struct<start, end, found, before, after>> of all matches, in
    characters; before and after are what stands next to a match, up to the
    matches beside it.

    The pieces between matches and the matches themselves, laid end to end,
    are the text; so their lengths give every position.
    """

    def spans(t: Column) -> Column:
        steps = F.transform(t["found"], lambda m, i: F.length(F.get(t["pieces"], i)) + F.length(m))
        zipped = F.arrays_zip(_running(steps).alias("end"), t["found"].alias("found"))

        def span(z: Column, i: Column) -> Column:
            near = F.right(F.get(t["pieces"], i), F.lit(40)).alias("before"), F.left(F.get(t["pieces"], i + 1), F.lit(6)).alias("after")
            return F.struct((z["end"] - F.length(z["found"])).alias("start"), z["end"].alias("end"), z["found"].alias("found"), *near)

        return F.transform(zipped, span)

    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    none = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")
    has = F.contains(text, F.lit(guard)) if len(guard) == 1 else text.rlike(guard)
    return F.when(has, _let(cut, spans)).otherwise(none)


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base span. Base spans are sorted; blocks
    of them that lie wholly before or after a candidate are passed over."""
    overlap = lambda c, b: (c["start"] < b["end"]) & (b["start"] < c["end"])

    def block(k: Column) -> Column:
        return _let(F.slice(base, (k * _BLOCK + 1).cast("int"), F.lit(_BLOCK)), lambda part: F.struct(F.element_at(part, 1)["start"].alias("start"), F.array_max(F.transform(part, lambda b: b["end"])).alias("end"), part.alias("part")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(base) - 1) / _BLOCK)), block)
    free = _let(blocks, lambda bs: F.filter(candidates, lambda c: ~F.exists(bs, lambda k: overlap(c, k) & F.exists(k["part"], lambda b: overlap(c, b)))))
    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), free).otherwise(candidates)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the check sum: from the right, every second
    digit counts double, less 9 if over 9."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(number, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.get(doubled, digit)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.(?!$)|$)){4}$")
    if kind == "card":
        number = digits(found)
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(found)).between(10, 15)
    return F.lit(True)


def _base(no: int, text: Column) -> Column:
    kind = KINDS[no]
    kept = F.filter(matches(text, BASE[kind], GUARD[kind]), lambda m: valid(kind, m["found"]))
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind_no, end>> of the base matches that are valid, sorted."""
    return F.array_sort(F.concat(*[_base(no, text) for no in range(len(KINDS))]))


def _vote(plus: Column, minus: Column) -> Column:
    return F.when(plus, 1).when(minus, -1).otherwise(0)


def candidate_spans(text: Column) -> Column:
    """Candidates with their kind, the four votes and the features."""

    def judge(family: str, m: Column) -> Column:
        found = m["found"]
        number = digits(found)
        n = F.length(number)
        if family == "number":
            is_ip = found.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
            is_ssn = found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
            kind = F.when(is_ip, MORE_KINDS.index("ip")).when(is_ssn, MORE_KINDS.index("ssn")).when(n >= 14, MORE_KINDS.index("card")).otherwise(MORE_KINDS.index("phone"))
            grouped = found.rlike(r"[0-9][ ().-]+[0-9]")
            shape = F.when(is_ip, _vote(valid("ip", found), F.lit(True))).when(is_ssn, _vote(~found.rlike("^(?:000|666|9)"), F.lit(True))).when(n >= 14, _vote(F.when(n >= 14, luhn(number)), F.lit(True)))
            shape = shape.otherwise(_vote(found.rlike(r"^(?:\+|\()") & (n >= 9) | found.rlike(r"^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), ~grouped))
            known = F.when(is_ip, _vote(~found.rlike(r"^(?:0|127|255)\."), F.lit(True))).when(n >= 14, _vote(number.rlike(r"^(?:4|5[1-5]|3[47]|6011|65)"), F.lit(True)))
            known = known.otherwise(_vote(found.startswith("+") & number.rlike(CALLING_CODES), F.lit(False)))
        elif family == "written":
            kind, grouped = F.lit(MORE_KINDS.index("email")), F.lit(False)
            shape = _vote(found.rlike(r"[\[({]"), F.lit(True))
            known = _vote(F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS), F.lit(True))
        elif family == "secret":
            kind, grouped = F.lit(MORE_KINDS.index("secret")), F.lit(False)
            mixed = found.rlike("[a-z]") & found.rlike("[A-Z]") & ~found.rlike("[/-]")
            shape = _vote(found.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | mixed, found.rlike(r"[A-Za-z]{3,}[/_-][A-Za-z]{3,}"))
            known = _vote(found.rlike(SECRET_HEADS), F.lit(False))
        else:
            kind, grouped = F.lit(MORE_KINDS.index("name")), F.lit(False)
            shape = _vote(found.rlike(r"\. [A-Z][a-z]+ [A-Z][a-z]+$"), F.lit(False))
            known = _vote(F.lower(F.regexp_extract(found, r"\. ([A-Za-z]+)", 1)).isin(NAMES), F.lit(False))
        before, after = m["before"], m["after"]
        against = AGAINST_SECRET if family == "secret" else AGAINST
        cue = F.lit(False)
        for k, name in enumerate(MORE_KINDS):
            cue = cue | ((kind == k) & before.rlike(CUES[name]))
        return F.struct(
            m["start"].alias("start"), kind.alias("kind_no"), m["end"].alias("end"),
            F.array(shape, known, _vote(cue, F.lit(False)), _vote(F.lit(False), before.rlike(against) | after.rlike(UNITS))).alias("votes"),
            F.least(F.lit(4), F.floor(n / 4)).cast("int").alias("digits"), grouped.cast("int").alias("grouped"),
        )

    def proposed(family: str) -> Column:
        return F.transform(matches(text, CANDIDATES[family], CANDIDATE_GUARD[family]), lambda m: judge(family, m))

    return F.concat(*[proposed(family) for family in CANDIDATES])


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation over (kind, votes, count) rows: P(vote | true or
    not) of each labeler, and the share of true spans of each kind.

    Labelers are taken to err independently. The start trusts a vote for its
    own side at 0.7; a small prior count keeps every probability inside (0, 1).
    """
    trust = np.empty((len(LABELERS), 2, 3))
    trust[:, 1] = 0.1, 0.3, 0.6
    trust[:, 0] = 0.6, 0.3, 0.1
    share = np.full(len(MORE_KINDS), 0.5)
    for _ in range(rounds):
        seen, of_kind = np.ones_like(trust) * 0.5 + trust * 2, np.ones((len(MORE_KINDS), 2))
        for kind, votes, n in patterns:
            p = belief(kind, votes, trust, share)
            of_kind[kind] += n * (1 - p), n * p
            for k, v in enumerate(votes):
                seen[k, :, v + 1] += n * (1 - p), n * p
        trust, share = seen / seen.sum(axis=2, keepdims=True), of_kind[:, 1] / of_kind.sum(axis=1)
    return trust, share


def belief(kind: int, votes: tuple[int, ...], trust: np.ndarray, share: np.ndarray) -> float:
    odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(trust[k, 1, v + 1] / trust[k, 0, v + 1]) for k, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _features(kind: int, votes: tuple[int, ...], n_digits: int, grouped: int) -> np.ndarray:
    x = np.zeros(len(MORE_KINDS) + 2 * len(LABELERS) + 6)
    x[kind] = 1
    for k, v in enumerate(votes):
        if v:
            x[len(MORE_KINDS) + 2 * k + (v > 0)] = 1
    x[len(MORE_KINDS) + 2 * len(LABELERS) + n_digits] = 1
    x[-1] = grouped
    return x


def train(rows: list[tuple[int, tuple[int, ...], int, int, int]]) -> np.ndarray:
    """Weights of a logistic span classifier, fitted on the beliefs of EM.

    Rows are (kind, votes, digits, grouped, count), one for each combination
    that occurs: 7 x 81 x 5 x 2 at most, whatever the size of the corpus.
    """
    trust, share = reliabilities([(k, v, n) for k, v, _, _, n in rows])
    size = len(_features(0, (0,) * len(LABELERS), 0, 0))
    weights = np.zeros(size)
    if not rows:
        return weights - 1e3
    x = np.array([_features(*r[:4]) for r in rows])
    y = np.array([belief(r[0], r[1], trust, share) for r in rows])
    n = np.array([r[4] for r in rows], float)
    n /= n.sum()
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(size), x.T @ (n * (p - y)) + 1e-3 * weights)
        weights -= step
        if np.abs(step).max() < 1e-10:
            break
    return weights


def _score(c: Column, weights: np.ndarray) -> Column:
    """The classifier's belief in a candidate, as an expression."""
    w = [float(x) for x in weights]
    at = F.get(F.array(*[F.lit(x) for x in w[: len(MORE_KINDS)]]), c["kind_no"])
    for k in range(len(LABELERS)):
        minus, plus = w[len(MORE_KINDS) + 2 * k : len(MORE_KINDS) + 2 * k + 2]
        v = F.get(c["votes"], F.lit(k))
        at = at + F.when(v > 0, plus).when(v < 0, minus).otherwise(0.0)
    tail = w[len(MORE_KINDS) + 2 * len(LABELERS) :]
    at = at + F.get(F.array(*[F.lit(x) for x in tail[:5]]), c["digits"]) + c["grouped"] * F.lit(tail[5])
    return 1 / (1 + F.exp(-at))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in MORE_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_spans (how many those are), and the spans as an array.

    Base spans are the valid matches of the four base patterns, leftmost and
    non-overlapping for each kind; kinds may overlap each other. They always
    stay. Wider patterns propose candidates (numbers, written-out addresses,
    titled names, long runs of letters and digits that may be keys or passwords); a shape, a gazetteer and two context labelers vote on them,
    expectation maximisation over the counts of vote patterns weighs the
    labelers, and a classifier trained on its beliefs adds the candidates of
    CERTAIN or more that overlap no base span. ``spans`` lists all as
    kind:start:end by start, then kind, comma-joined; positions count
    characters, the end exclusive. A null text is empty and has none; rows
    that repeat an id are judged each; no rows give no rows.

    Texts are read once; the spans are written, and only counts of vote
    patterns go to the driver.
    """
    text = text_or_empty(text_col)
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = materialise(read.select("doc_id", base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("more")), "spans")
    free = found.select("doc_id", "base", _apart(F.col("more"), F.col("base")).alias("more"))
    seen = free.select(F.explode("more").alias("c")).groupBy("c.kind_no", "c.votes", "c.digits", "c.grouped").agg(F.count("*").alias("n"))
    rows = sorted((r["kind_no"], tuple(r["votes"]), r["digits"], r["grouped"], r["n"]) for r in seen.collect())  # 5,670 rows at most
    weights = train(rows)
    added = F.transform(F.filter("more", lambda c: _score(c, weights) >= CERTAIN), lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end")))
    out = free.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", added))).alias("spans_found"))
    number = F.transform("base", lambda b: b["kind_no"])
    counts = [(F.size("base") - F.size(F.array_remove(number, no))).cast("long").alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans_found")).alias("spans"), F.size("spans_found").cast("long").alias("n_spans"), "spans_found")
