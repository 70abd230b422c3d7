"""Alignment and deletion against a plain version of the same rule."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import line_dedup
from millrace.llm.line_dedup import MIN_WORDS, patience, repeated, without_repeats

LONG = " ".join(f"w{i}" for i in range(40))
HALF = [" ".join(f"{c}{i}" for i in range(18)) for c in "ab"]


def sequence(text):
    out = []
    for place, line in enumerate((text or "").split("\n")):
        line = line.strip(" \t\r\x0b\x0c")
        if line:
            out.append({"number": len(out), "place": place, "h": line, "words": len(line.split())})
    return out


def common(b, c, min_words):
    """Places of the lines of c in blocks of consecutive lines, long enough, that b has too."""
    out = set()
    for x in range(len(b)):
        for y in range(len(c)):
            if x and y and b[x - 1]["h"] == c[y - 1]["h"]:
                continue
            k = 0
            while x + k < len(b) and y + k < len(c) and b[x + k]["h"] == c[y + k]["h"]:
                k += 1
            if sum(z["words"] for z in c[y : y + k]) >= min_words:
                out.update(z["place"] for z in c[y : y + k])
    return out


def expected(rows, min_words=MIN_WORDS):
    """Every block that any earlier document has."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda x: x[0])
    gone = defaultdict(set)
    for i, t in docs:
        for j, u in docs:
            if j < i:
                gone[i, t] |= common(sequence(u), sequence(t), min_words)
    out = []
    for i, t in rows:
        places = gone.get((i, t), set())
        lines = [x for k, x in enumerate((t or "").split("\n")) if k not in places]
        text = "\n".join(lines) if places else t
        out.append((i, "" if places and not text.strip() else text, len(places)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, without_repeats(df).collect()), key=str) == expected(rows)


def test_patience_finds_a_common_chain():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 12))] for _ in "ab")
        found = patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]


def crossing(r):
    """Two sequences of lines with common blocks in any order, repeats among them."""
    pool = [[f"b{k}x{i}" for i in range(r.randint(1, 6))] for k in range(5)]
    make = lambda: [x for _ in range(r.randint(1, 6)) for x in (r.choice(pool) if r.random() < 0.8 else [f"o{r.randrange(99)}"])]
    as_lines = lambda names: [{"number": n, "place": n, "h": h, "words": 9} for n, h in enumerate(names)]
    return as_lines(make()), as_lines(make())


def test_alignment_finds_every_block():
    r = random.Random(21)
    for _ in range(500):
        a, b = crossing(r)
        assert set(repeated(b, a)) == common(a, b, MIN_WORDS)


def test_nothing_goes_without_alignment(monkeypatch):
    """A mutation: with the alignment switched off the result must change."""
    r = random.Random(21)
    pairs = [crossing(r) for _ in range(50)]
    assert any(repeated(b, a) for a, b in pairs)
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert not any(repeated(b, a) for a, b in pairs)


def test_a_long_document_with_many_leaders(spark):
    """A pair holds the common lines, not the whole document."""
    blocks = [[f"d{k} " + " ".join(f"w{k}x{i}y{j}" for j in range(12)) for i in range(4)] for k in range(150)]
    rows = [(k, "\n".join([f"own {k}", *b])) for k, b in enumerate(blocks)]
    rows.append((900, "\n".join(x for b in blocks for x in [*b, "between " + b[0][:4]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = line_dedup.sharing_runs(line_dedup.shared_lines(df).groupBy("doc_id", "of").agg(F.sort_array(F.collect_set(F.struct("number", "place", "h", "words"))).alias("lines")))
    assert {len(p.lines) for p in pairs.collect()} == {4}
    got = {r.doc_id: r.n_lines_removed for r in without_repeats(df).collect()}
    assert got[900] == 600 and sum(got.values()) == 600


def test_cases(spark):
    check(
        spark,
        [
            (1, f"intro one\n{LONG}\nend one"), (2, f"intro two\n  {LONG} \r\nend two"), (3, LONG), (3, LONG), (4, "\n\n" + LONG + "\n"),
            (5, f"{HALF[0]}\n\n{HALF[1]}"), (6, f"x\n{HALF[0]}\n{HALF[1]}\ny"), (7, f"{HALF[0]}\nbetween\n{HALF[1]}"),
            (8, None), (9, ""), (None, LONG), (10, "short line\nshort line"), (11, "short line\nshort line"), (3, "other\n" + LONG),
        ],
    )


def test_random_documents(spark):
    r = random.Random(5)
    pool = [" ".join(f"p{k}x{i}" for i in range(r.randint(1, 25))) for k in range(25)]
    ids = r.sample(range(200), 60)
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 30)))) for i in ids]
    check(spark, rows)


def test_hot_line_and_other_columns(spark):
    rows = [(i, f"{LONG}\nown {i} " + "z" * (i % 3), i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_lines_removed int")
    got = without_repeats(df)
    assert got.columns == ["doc_id", "text", "n_lines_removed"]
    assert [r.n_lines_removed for r in got.orderBy("doc_id").collect()] == [0] + [1] * 599


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
