"""Base spans against plain regular expressions, and spans that patterns add."""

import hashlib
import math
import random
import re
from collections import defaultdict

from millrace.llm.pii import GOOD, KINDS, ROUNDS, SUPPORT, entities
from millrace.llm.queries import QUERIES


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out, text = [], text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m)) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def expected(text):
    spans = base(text)
    return (*(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(joined(spans).encode()).hexdigest())


def got(rows):
    return {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows}


ODD = [
    None, "", "a@b.c", "a@b.cd_e@f.g", "a@b.c@d.e", "x..y@z-.-.q.", "é a@b.é", "@a.b", "a@b", "%+-@1.2.3.4", "\U0001f600 a@b.c 1.2.3.4",
    "1.2.3.4.5.6.7.8", "256.1.1.1", "001.0255.3.4", "1.2.3", "12.3.4.5", "1..2.3.4", "٣.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111",
    "4111  1111 1111 1111", "0" * 12, "0" * 11, "0" * 19, "0" * 20, "0 " * 19, "1234567890123", "+1 (988) 555-2485.", "+1", "+12345678", "+123456789012345 6",
    "++49 30 123456", "+49 (30) 12 . - 3456 78)", "5555555555554444+4930123456", "a" * 3000 + "1" * 3000, "1." * 2000, "a@b.c," * 200, "\n4111111111111111\n",
]


def test_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert got(entities(df).collect()) == {i: expected(t) for i, t in enumerate(ODD)}


def test_random_texts(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("01 25.-+()@a_b,é4") for _ in range(r.randint(0, 120))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(entities(df).collect()) == {i: expected(t) for i, t in enumerate(texts)}


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op3_pii"](spark, sf_dir).collect()
    assert got(rows) == {r.doc_id: expected(r.text) for r in docs}
    text = {r.doc_id: r.text for r in docs}
    for r in rows:
        assert set(joined(base(text[r.doc_id])).split(",")) <= set(r.spans.split(","))


def test_patterns_find_what_no_form_matches(spark):
    rows = [(i, f"please write to user{i}@mail.example now or later number {i}00") for i in range(8)]
    rows += [(100, "please write to bob(at)7mail123 now or later"), (101, "we saw number 4711x99 there")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in entities(df).collect()}
    start = rows[8][1].index("bob")
    assert spans[100] == f"email:{start}:{start + len('bob(at)7mail123')}"
    assert spans[101] == "" and spans[3] == joined(base(rows[3][1]))


def test_labels_find_what_is_near_the_form(spark):
    rows = [(i, f"{'abcdefgh'[i]} tel: +1-555-010-200{i} {'klmnopqr'[i]}") for i in range(8)]
    rows += [(20 + i, f"{'abcdefgh'[i]} mail=user{i}@host.example {'klmnopqr'[i]}") for i in range(8)]
    rows += [(100, "x tel 1-555-010-3000 y"), (101, "so tel=1-555-010-4000. On"), (102, "my fax 1-555-010-3000 y"), (103, "x tel 12:30 y")]
    rows += [(104, "x mail:bob7@host_example.example y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in entities(df).collect()}
    assert spans[100] == "phone:6:20" and spans[101] == "phone:7:21"
    assert spans[102] == "" and spans[103] == "" and spans[104] == ""


def contexts(text, a, b, v):
    before = re.search(r"(\S+\s+)?\S+\s*\Z", text[max(0, a - 80) : a], re.A)
    after = re.match(r"\s*(\S+)", text[b : b + 60], re.A)
    left, right = before.group().lower() if before else "", after[1].lower() if after else ""
    words, out = left.split(), []
    if len(words) == 2:
        out.append(("two", *words))
    if words and right:
        out.append(("around", words[-1], right))
    label = re.sub("[^a-z0-9]+$", "", words[-1]) if words else ""
    label = re.sub("^[^a-z0-9]+", "", label)
    if label:
        shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", v.removeprefix("+")))
        out.append(("label", label, shape))
    return out


def bootstrap(texts):
    """All spans of each text, by plain loops over patterns and identifiers."""
    seeds, tokens, plain = defaultdict(set), [], [base(t) for t in texts]
    for i, t in enumerate(texts):
        for a, k, b in plain[i]:
            # The operator looks back to the match before only; words beyond it are too varied here to count.
            for p in contexts(t, a, b, t[a:b]):
                seeds[p, k].add(t[a:b])
        for m in re.finditer(r"(?<![^\s=:])[^\s0-9@=:]*[0-9@]\S*", t, re.A):
            core = re.search("[A-Za-z0-9+@](?:.*[A-Za-z0-9@])?", m.group())
            lead = len(re.match("[^A-Za-z0-9+@]*", m.group()).group())
            a, v = m.start() + lead, core.group()
            if len(v) < 5 or ("@" not in v and sum(c.isdigit() for c in v) < 3):
                continue
            if any(x < a + len(v) and a < y for x, _, y in plain[i]):
                continue
            # The context of a token ends where its match does.
            ps = contexts(t[: m.start()] + " " * (m.end() - m.start()) + t[m.end() :], m.start(), m.end(), v)
            tokens.append((i, a, a + len(v), v, ps))
    first = {pk: len(vs) for pk, vs in seeds.items() if len(vs) >= SUPPORT}
    use = {p for p, _ in first}
    edges = {(p, v) for *_, v, ps in tokens for p in ps if p in use}
    others = defaultdict(int)
    for p, _ in edges:
        others[p] += 1
    score = {(p, k): n / (n + others[p]) for (p, k), n in first.items()}
    for _ in range(ROUNDS):
        wrong = defaultdict(float)
        for p, v in edges:
            for k in range(4):
                if score.get((p, k), 0) >= GOOD:
                    wrong[v, k] += math.log(1 - min(score[p, k], 0.999999))
        gained = defaultdict(float)
        for p, v in edges:
            for k in range(4):
                if (v, k) in wrong and (p, k) in first:
                    gained[p, k] += 1 - math.exp(wrong[v, k])
        score = {(p, k): (n + gained[p, k]) / (n + others[p]) for (p, k), n in first.items()}
    best = {}
    for (p, k), s in score.items():
        if s >= GOOD and (p not in best or (s, -k) > best[p]):
            best[p] = (s, -k)
    out = [list(x) for x in plain]
    added = {(i, a, -best[p][1], b) for i, a, b, _, ps in tokens for p in ps if p in best}
    for i, a, k, b in added:
        out[i].append((a, k, b))
    return [joined(sorted(x)) for x in out]


def test_spans_against_a_plain_bootstrap(spark):
    r = random.Random(5)
    word = lambda: r.choice(["call", "mail=", "tel:", "ip", "or", "host", "card", "now"])
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    forms = [
        lambda: f"u{number(2)}@mail.example", lambda: f"+1-{number(3)}-{number(4)}-{number(2)}", lambda: f"10.0.{r.randint(0, 255)}.{r.randint(0, 99)}",
        lambda: f"1-{number(3)}-{number(4)}-{number(2)}", lambda: f"10.0.{r.randint(0, 255)}.{r.randint(300, 400)}", lambda: f"u{number(2)}(at)mail", word,
    ]
    label = {0: ["mail=", "write to "], 1: ["tel: ", "call "], 2: ["ip ", "host=", "from host "], 3: ["tel: ", "call "], 4: ["ip ", "host="], 5: ["mail=", "write to "], 6: ["", "or "]}

    def part():
        k = r.choice([0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 4, 5, 6, 6])
        return r.choice(label[k]) + forms[k]()

    texts = [" ".join(x for _ in range(r.randint(1, 4)) for x in (part(), *[word() for _ in range(r.randint(0, 2))])) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {x.doc_id: x.spans for x in entities(df).collect()}
    want = bootstrap(texts)
    assert spans == dict(enumerate(want))
    assert sum(w != joined(base(t)) for w, t in zip(want, texts)) > 20


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a@b.c", 5), (1, "a@b.c", 5), (None, "1.2.3.4", 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SPANS int")
    found = sorted((str(r.doc_id), r.spans) for r in entities(df).collect())
    assert found == [("1", "email:0:5"), ("1", "email:0:5"), ("None", ""), ("None", "ip:0:7")]
    assert entities(df.where("1 = 0")).collect() == []
